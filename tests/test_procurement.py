"""Sources with fake transports, sinks, text checks, the writer and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from tenderlake import cli, sinks, writer
from tenderlake.functions.verify import verify
from tenderlake.operators import quality, vectors
from tenderlake.plans import facts
from tenderlake.sources import clients, readers
from tenderlake.streaming import bronze

DATA = "/root/testdata/sf0.001"


def _answers(*answers):
    left = list(answers)

    def transport(method, url, parameters, headers):
        answer = left.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    return transport


def test_retries_wait_as_asked():
    slept = []
    transport = _answers((429, {"Retry-After": "7"}, b""), (500, {}, b""), OSError("down"), (200, {}, b"ok"))
    assert clients.fetch(transport, "GET", "u", sleep=slept.append) == (200, b"ok") and slept == [7, 2, 4]
    with pytest.raises(RuntimeError):
        clients.fetch(_answers(*[(503, {}, b"")] * 3), "GET", "u", tries=3, sleep=slept.append)


def test_token_pages_end():
    page = lambda rows, token: (200, {}, json.dumps({"notices": rows, "iterationNextToken": token, "totalNoticeCount": 9}).encode())
    assert list(clients.token_pages(_answers(page([1, 2], "a"), page([3], None)), "u", {})) == [1, 2, 3]
    assert list(clients.token_pages(_answers(page([1], "a"), page([2], "b")), "u", {}, pages=2)) == [1, 2]
    assert list(clients.token_pages(_answers(page([], "a")), "u", {})) == []


def test_register_answers():
    body = json.dumps({"uniteLegale": {"siren": "1"}}).encode()
    assert clients.company(_answers((200, {}, body)), "b", "1", "k")["uniteLegale"]["siren"] == "1"
    assert clients.company(_answers((404, {}, b"")), "b", "1", "k") is None
    with pytest.raises(clients.Restricted):
        clients.company(_answers((403, {}, b"")), "b", "1", "k")
    found = json.dumps({"etablissements": [{"siren": "1", "siret": "2", "etablissementSiege": True, "uniteLegale": {"denominationUniteLegale": "N"}}]}).encode()
    assert clients.companies_by_name(_answers((200, {}, found)), "b", "N", "k")[0]["denomination"] == "N"
    assert clients.companies_by_name(_answers((200, {}, b'{"unitesLegales": [1]}')), "b", "N", "k", past=True) == [1]
    assert clients.search_page(_answers(OSError("no")), "u", "q") == "" and clients.export(_answers((200, {}, b"[1]")), "u", {}) == [1]


def test_offset_pages_as_a_source(spark):
    def transport(method, url, parameters, headers):
        at, n = parameters["offset"], parameters["limit"]
        return 200, {}, json.dumps({"total_count": 25, "results": [{"i": i} for i in range(at, min(25, at + n))]}).encode()

    spark.dataSource.register(clients.paged_source(transport, "fake_pages"))
    rows = spark.read.format("fake_pages").option("url", "u").option("limit", "10").load()
    assert sorted(json.loads(r["avis"])["i"] for r in rows.collect()) == list(range(25)) and rows.rdd.getNumPartitions() == 3


def test_landing_and_archives(tmp_path):
    import zipfile

    target = str(tmp_path / "a" / "f.bin")
    assert clients.landed(_answers((200, {}, b"1")), "u", target) == target == clients.landed(_answers(), "u", target)
    archive = tmp_path / "z.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("x.csv", "a,b\n")
    assert clients.only_csv(str(archive), str(tmp_path)).endswith("x.csv")
    with zipfile.ZipFile(archive, "a") as z:
        z.writestr("y.csv", "")
    with pytest.raises(ValueError):
        clients.only_csv(str(archive), str(tmp_path))


def test_readers(spark):
    one = lambda v, f: spark.createDataFrame([(v,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]
    assert one('{"eng": ["E"], "fra": ["F", "G"]}', readers.multilingual) == "F" and one('{"deu": "D"}', readers.multilingual) == "D"
    assert one("plain", readers.multilingual) == "plain" and one('{"fra": []}', readers.multilingual) is None and one(None, readers.multilingual) is None
    assert one("2026-04-28+02:00", readers.first_date) == "2026-04-28" and one("2026", readers.first_date) is None
    assert str(one(" 2020-02-29T10:00 ", readers.tolerant_date)) == "2020-02-29" and one("2021-02-29", readers.tolerant_date) is None


def test_sheets_and_blocks():
    good = {"faits": [{"cle": "a", "valeur": None, "provenance": "p", "couverture": 0.5}], "couverture_globale": 0.5}
    assert sinks.check_sheet(good) is good and len(sinks.check_block(["x"] * 10)) == 10
    for bad in ({**good, "couverture_globale": 1.1}, {**good, "faits": [{**good["faits"][0], "provenance": ""}]}, {**good, "faits": [{**good["faits"][0], "valeur": {}}]}):
        with pytest.raises(ValueError):
            sinks.check_sheet(bad)
    for bad in ([], ["x"] * 11, [" "]):
        with pytest.raises(ValueError):
            sinks.check_block(bad)


@pytest.fixture(scope="module")
def mart(spark, tmp_path_factory):
    return cli.build_mart(cli.star_of(spark, DATA), "file://" + str(tmp_path_factory.mktemp("mart") / "m"))


def test_texts_pass_their_own_check_and_inventions_do_not(mart):
    assert verify(mart, facts.template_text()).where("NOT valide").count() == 0
    one = mart.where(F.size("faits") > 0).limit(1)
    for said, column in (("123456 euros", "nombres_non_justifies"), ("Zorglub Conseil", "noms_non_justifies"), ("QWERTZ SA", "noms_non_justifies"), ("le 31/02/2031", "dates_non_justifiees")):
        row = verify(one, F.concat(facts.template_text(), F.lit(" " + said))).first()
        assert not row["valide"] and row[column]


def test_writer_regenerates_then_falls_back(mart):
    sheet = mart.where(F.size("faits") > 0).limit(1)
    plain = sheet.select(facts.template_text().alias("t")).first()["t"]
    said = iter(["Zorglub 999999", plain])
    seen = []

    def client(instructions, messages):
        seen.append(len(messages))
        return next(said)

    assert writer.written(sheet, client) == plain and seen == [1, 3]
    assert writer.written(sheet, lambda i, m: "Zorglub") == plain and writer.written(sheet, lambda i, m: None) == plain == writer.written(sheet)

    def broken(instructions, messages):
        raise OSError("no network")

    assert writer.written(sheet, broken) == plain


def test_command_line(spark, mart, tmp_path, capsys):
    row = mart.where(F.size("faits") > 0).first()
    path = mart.inputFiles()[0].rsplit("/", 2)[0]
    base = ["--data", DATA, "--mart", path, "--cpv", row["code_cpv"]]
    assert cli.main([*base, "--acheteur", row["siret_acheteur"], "--json", str(tmp_path / "j.json"), "--rapport", str(tmp_path / "r.md")], spark) == 0
    assert "Sortant probable" in capsys.readouterr().out
    sheet, text = json.loads((tmp_path / "j.json").read_text()), (tmp_path / "r.md").read_text()
    assert len(sheet["faits"]) >= 9 and "Vérification mécanique : valide" in text and "## Marchés sources" in text
    assert cli.main([*base, "--acheteur", "Customer"], spark) == 2 and "préciser le SIRET" in capsys.readouterr().err
    assert cli.main([*base, "--acheteur", "personne de ce nom"], spark) == 2
    assert cli.main([*base[:-1], "99999999", "--acheteur", "12345678901234"], spark) == 0
    assert "DONNÉES INSUFFISANTES" in capsys.readouterr().out


def test_votes_and_vectors(spark):
    rows = spark.createDataFrame([("a", "72", [1.0, 0.0]), ("b", "73", [1.0, 0.1]), ("c", None, [1.0, 0.0]), ("d", "72", None)], "uid string, code_cpv string, objet_embedding array<float>")
    assert [r["uid"] for r in vectors.similar_to(rows, "a").collect()] == ["c", "b"] and vectors.similar_to(rows, "d").count() == 0
    assert {r["uid"] for r in vectors.similar_to(rows, "a", other_category=True).collect()} == {"b", "c"}
    tie = spark.createDataFrame([("1", "72", 0.9), ("2", "73", 0.9)], "uid string, code_cpv string, similarite double")
    assert vectors.vote(tie).first()["code_cpv"] == "73" and vectors.vote(tie, 0.95).first()["code_cpv"] is None
    done = vectors.embed(spark.createDataFrame([("x", "réseau"), ("y", None)], "uid string, objet string")).collect()
    assert len(done[0]["objet_embedding"]) == 384 and done[1]["objet_embedding"] is None


def test_purchasing_body_comes_first(spark):
    df = spark.createDataFrame([("Groupe uniha",), ("Mairie",)], "nom string")
    assert [r[0] for r in df.select(facts.purchasing_body(F.col("nom"))).collect()] == ["UNIHA", None]


def test_session_waves(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-01-20"), (1, "2024-04-01")], "k int, j string").withColumn("j", F.to_timestamp("j"))
    assert sorted(r["nb"] for r in bronze.waves(df, ["k"], "j").collect()) == [1, 2]


def test_accuracy_counts_false_positives(spark):
    cases = spark.createDataFrame([(1, "a", "9"), (2, "a", None), (3, "a", None)], "cas int, type_cas string, siren_attendu string")
    found = spark.createDataFrame([(1, "9"), (2, "8")], "cas int, siren string")
    row = quality.identity_accuracy(cases, found).first()
    assert (row["corrects"], row["total"]) == (2, 3)


def test_tasks_stay_small_as_tables_grow(spark, monkeypatch):
    from tenderlake.sources import adapters

    names = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {k: spark.conf.get(k) for k in names}
    try:
        spark.conf.set(names[0], "2")
        spark.conf.set(names[2], "16k")
        monkeypatch.setattr(adapters, "DEALT", 1 << 13)
        adapters.run(spark, "/root/testdata/sf0.001", "SELECT l_orderkey FROM lineitem")
        many = int(spark.conf.get(names[0]))
        assert many > 2 and spark.conf.get(names[1]) == str(adapters.READ) and spark.conf.get(names[2]) == "16k"
        adapters.run(spark, "/root/testdata/sf0.001", "SELECT r_name FROM region")
        assert int(spark.conf.get(names[0])) == many  # finer, never coarser
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_encoder_holds_bounded_batches(spark):
    from tenderlake.operators import vectors

    most = vectors.SLICE

    def encoder():
        def encode(texts):
            assert len(texts) <= most
            return [[float(len(t))] for t in texts]
        return encode

    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "CASE WHEN id % 7 > 0 THEN repeat('x', CAST(id AS INT)) END AS objet")
    got = vectors.embed(rows, encoder=encoder).select("id", "objet_embedding").collect()
    assert len(got) == 3000 and all((r["objet_embedding"] is None) if r["id"] % 7 == 0 else r["objet_embedding"] == [float(r["id"])] for r in got)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_what_a_sheet_allows_is_computed_once_a_row(spark):
    """Not again for every word and date of the text: both are columns that the last projection reads."""
    sheet = spark.sql("""SELECT array(named_struct('cle', 'x', 'texte', 'Alpha NORD 2024-01-02', 'nombre', 7305.0D, 'liste', array('Beta (1/2)'), 'provenance', 'p', 'couverture', 1.0D)) AS faits, 0.5D AS couverture_globale, CAST(NULL AS STRING) AS raison
      FROM range(3)""").localCheckpoint()  # not a constant
    checked = verify(sheet, F.lit("Alpha et Beta, 7 305 le 02/01/2024, 50%, NORD. Gamma et Gamma, 12 le 03/01/2024, ALPHA NORD"))
    read = checked.select("valide")._jdf.queryExecution().optimizedPlan().references().toString()
    assert "_jours#" in read and "_inconnus#" in read and "_ok#" in read
    assert [tuple(r) for r in checked.select("noms_non_justifies", "dates_non_justifiees", "valide").distinct().collect()] == [(["ALPHA NORD", "Gamma", "Gamma"], ["2024-01-03"], False)]
    assert "12" in checked.first()["nombres_non_justifies"] and "7305" not in checked.first()["nombres_non_justifies"]
