"""The resumable token source, completion under a quota, rejects above a share."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tenderlake import sinks
from tenderlake.operators import completion
from tenderlake.plans import facts, silver
from tenderlake.sources import clients, readers


def test_requests_are_built():
    day = datetime.date(2026, 3, 1)
    assert clients.notice_request(day, "72", years=1)["query"] == "classification-cpv=72* AND buyer-country=FRA AND publication-date>=20250301 AND form-type=result"
    assert clients.notice_request(day, country="BEL", years=2)["query"] == "buyer-country=BEL AND publication-date>=20240301 AND form-type=result"


def test_a_stopped_stream_goes_on_at_its_token(spark, tmp_path):
    log = str(tmp_path / "asked")

    def transport(method, url, parameters, headers):
        at = int(parameters.get("iterationNextToken", "0"))
        with open(log, "a") as f:
            f.write(f"{at}\n")
        rows = [{"n": 2 * at}, {"n": 2 * at + 1}] if at < 5 else []
        return 200, {}, json.dumps({"notices": rows, "iterationNextToken": str(at + 1), "totalNoticeCount": 10}).encode()

    spark.dataSource.register(clients.token_source(transport, "fake_tokens"))

    def run():
        stream = spark.readStream.format("fake_tokens").option("url", "u").option("pages", 2).load()
        query = stream.writeStream.option("checkpointLocation", f"file://{tmp_path}/progress").format("parquet").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(json.loads(r["avis"])["n"] for r in spark.read.schema("avis string").parquet(f"file://{tmp_path}/out").collect())

    got = []
    for _ in range(4):
        got.append(run())
    assert got[-1] == list(range(10)) and all(a == list(range(len(a))) for a in got)
    asked = [int(x) for x in open(log).read().split()]
    assert sorted(set(asked)) == list(range(5)) and len(asked) == len(set(asked))


def test_each_company_is_asked_once_over_two_runs(spark, tmp_path):
    log, path = str(tmp_path / "asked"), f"file://{tmp_path}/answers"
    rows = [(f"{i:09d}", None, None) for i in range(10)] + [("000000100", "62.01Z", None), ("BE1", None, None), ("000000101", None, "NON_DIFFUSIBLE"), ("x", None, None)]
    companies = spark.createDataFrame(rows, "siren string, code_naf string, etat_administratif string")

    def answer(method, url, parameters, headers):
        siren = url.rsplit("/", 1)[-1]
        with open(log, "a") as f:
            f.write(siren + "\n")
        n = int(siren)
        return {3: 403, 4: 404, 5: 500}.get(n, 200), {}, json.dumps({"uniteLegale": {"siren": siren}}).encode()

    ask = lambda siren: completion.register_answer(answer, "b", "k", siren, tries=1)
    nap = lambda s: None
    assert completion.complete_queue(companies, path, ask, wave=4, waves=1, sleep=nap) == 4
    assert completion.complete_queue(companies, path, ask, wave=4, sleep=nap) == 6
    asked = open(log).read().split()
    assert sorted(asked) == [f"{i:09d}" for i in range(10)]
    found = {int(r["siren"]): r["statut"] for r in completion.answers(spark, path).collect()}
    assert found == {i: {3: "restreint", 4: "introuvable", 5: "erreur"}.get(i, "trouve") for i in range(10)}
    assert completion.complete_queue(companies, path, lambda s: ("trouve", "{}"), sleep=nap) == 1  # the one that erred
    assert completion.answers(spark, path).where("statut = 'erreur'").count() == 0


def test_tasks_share_the_quota(spark, tmp_path):
    log = str(tmp_path / "naps")

    def nap(seconds):
        with open(log, "a") as f:
            f.write(f"{seconds}\n")

    companies = spark.createDataFrame([(f"{i:09d}", None, None) for i in range(8)], "siren string, code_naf string, etat_administratif string")
    completion.complete_queue(companies, f"file://{tmp_path}/a", lambda s: ("trouve", None), per_minute=30, tasks=2, sleep=nap)
    assert set(open(log).read().split()) == {"4.0"}


def test_too_many_rejects_are_not_published(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = lambda bad: spark.createDataFrame([(str(i), ["montant"] if i < bad else []) for i in range(10)], "uid string, rejets array<string>")
    none = spark.createDataFrame([], "uid string")
    assert silver.publish(rows(1), none, folder, 0.2) == {"marches": 10, "rejetes": 1, "version": 1}
    with pytest.raises(silver.TooManyRejects, match="3 of 10"):
        silver.publish(rows(3), none, folder, 0.2)
    assert sinks.version(spark, folder, "silver") == 1
    assert [r["uid"] for r in sinks.current(spark, folder, "silver", "rejets").collect()] == ["0"]


def test_slices_and_sections(spark):
    rows = spark.createDataFrame([("1", "b", "2020-01-01"), ("2", "b", None), ("3", "b", "2021-01-01"), ("4", "c", "2022-01-01"), ("0", "b", "2020-01-01")], "uid string, acheteur_id string, dateNotification string")
    assert [r["uid"] for r in readers.of_buyer(rows, "b", 3).collect()] == ["3", "0", "1"]
    sheets = spark.createDataFrame([([("a", 0.5), ("b", 0.0)],), ([("a", 0.0)],), ([],)], "faits array<struct<cle:string,couverture:double>>")
    assert {r["cle"]: (r["fiches"], r["renseignees"], r["couverture"]) for r in facts.section_coverage(sheets).collect()} == {"a": (2, 1, 0.25), "b": (1, 0, 0.0)}
