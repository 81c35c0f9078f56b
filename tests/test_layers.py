"""Gold, published versions, segments of large buyers, the index of names, stream state, splitting CSV."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlake import sinks
from tenderlake.functions.text import trigrams
from tenderlake.operators import identity, name_index
from tenderlake.plans import facts, gold, silver
from tenderlake.plans.family import FAMILY
from tenderlake.plans.star import Star
from tenderlake.sources import readers
from tenderlake.streaming import bronze

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, (r.asDict(recursive=True) for r in df.collect())))


@pytest.mark.parametrize("span", [1, 30, 400, 100_000])
def test_segments_of_any_length_give_the_same_families(spark, span):
    rng = np.random.default_rng(span)
    day = lambda n: datetime.date(2015, 1, 1) + datetime.timedelta(int(n))
    markets = [(f"m{i}", f"b{rng.integers(3)}", float(i), str(rng.choice(["72210000", "72220000"])), day(rng.integers(0, 900)) if rng.random() > 0.05 else None,
                float(rng.integers(0, 40)) if rng.random() > 0.3 else None, None) for i in range(400)]
    star = Star(
        spark.createDataFrame([("b0", "B0")], "siret string, nom string"),
        spark.createDataFrame(markets, "uid string, siret_acheteur string, montant double, code_cpv string, date_notification date, duree_mois double, duree_restante_mois double"),
        spark.createDataFrame([(f"s{k}", f"S{k}", "A") for k in range(5)], "siren string, denomination string, etat string"),
        spark.createDataFrame([(m[0], f"s{rng.integers(5)}") for m in markets for _ in range(2)], "uid string, siren string").distinct(),
    ).typed()
    for select in (f"SELECT {FAMILY}, uid, position, CAST(vague AS BIGINT) AS vague, fin, siren FROM chained", f"SELECT {FAMILY}, vague, debut, fin, nb FROM vagues",
                   f"SELECT {FAMILY}, nb_marches, nb_vagues, transitions, coherentes, ratio, confiance, sortant, date_expiration, slice(marches_support, 1, 30) AS m FROM families"):
        assert rows(star.families(select, (8, 4), large=100, span=span)) == rows(star.families(select, (8, 4)))


def test_no_task_holds_a_large_buyer_whole(spark):
    star = Star.of_tables(spark, DATA)
    plan = star.families("SELECT * FROM chained", large=1)._jdf.queryExecution().executedPlan().toString()
    assert "segment" in plan and "left_anti" in plan.lower().replace("leftanti", "left_anti")


def test_a_stopped_publication_changes_nothing(spark, tmp_path, monkeypatch):
    folder, table = f"file://{tmp_path}", lambda n: spark.range(n)
    assert sinks.version(spark, folder, "t") is None
    assert sinks.publish(table(1), folder, "t") == 1
    real = sinks._commit

    def stopped(*a):
        raise KeyboardInterrupt

    monkeypatch.setattr(sinks, "_commit", stopped)
    with pytest.raises(KeyboardInterrupt):
        sinks.publish(table(2), folder, "t")
    assert sinks.current(spark, folder, "t").count() == 1
    monkeypatch.setattr(sinks, "_commit", real)
    (tmp_path / "t" / "_versions" / "0000000002").write_text('{"": "half')  # a file that was cut short
    assert sinks.current(spark, folder, "t").count() == 1
    assert sinks.publish(table(3), folder, "t") == 3 and sinks.current(spark, folder, "t").count() == 3
    for n in (4, 5):
        sinks.publish(table(n), folder, "t")
    assert sinks.current(spark, folder, "t").count() == 5 and len(sinks._versions(spark, folder, "t")) == 2
    assert len(list((tmp_path / "t").glob("data-*"))) == 3  # two versions, and the folder of the stopped run, which is young
    sinks.clean(spark, folder, "t", hours=-1)
    assert len(list((tmp_path / "t").glob("data-*"))) == 2


def test_two_writers_get_two_numbers(spark, tmp_path):
    folder = f"file://{tmp_path}"
    assert [sinks._commit(spark, folder, "t", {"": str(k)}) for k in range(3)] == [1, 2, 3]
    files, at = sinks._files(spark, f"{folder}/t/_versions/0000000003")
    with pytest.raises(Exception, match="exists"):
        files.create(at, False)


def test_gold_keeps_what_it_has(spark, tmp_path):
    columns = "uid string, source string, siret_acheteur string, nom_acheteur string, objet string, montant double, code_cpv string, date_notification date, date_publication date, duree_mois double, duree_restante_mois double, modification_id int, doublon_probable_de string"
    market = lambda uid, buyer, name, cpv="72", twin=None: (uid, "DECP", buyer, name, None, 1.0, cpv, None, None, None, None, None, twin)
    awards = "uid string, siret_titulaire string, nom_titulaire string, source string, methode_resolution string, score_confiance double"
    one = spark.createDataFrame([market("1", "b", "Old"), market("2", None, "x"), market("3", "b", None, "45"), market("4", "c", None, "72", "1")], columns)
    won = spark.createDataFrame([("1", "123456789" + "00001", None, "DECP", "flou", 0.7), ("3", "9" * 14, "n", "DECP", None, None)], awards)
    first = gold.build(one, won)
    assert [r["uid"] for r in first.marches.collect()] == ["1"] and first.entreprises.first()["denomination"] == "Inconnu"
    assert first.attributions.first()["score_confiance"] == 0.7
    gold.publish(first, f"file://{tmp_path}")
    two = spark.createDataFrame([market("1", "b", "New", "721"), market("5", "d", None)], columns)
    second = gold.build(two, spark.createDataFrame([("5", "123456789" + "00002", "Named", "DECP", None, None)], awards), gold.current(spark, f"file://{tmp_path}"))
    assert {r["siret"]: r["nom"] for r in second.acheteurs.collect()} == {"b": "Old", "d": "Acheteur inconnu"}
    assert {r["uid"]: r["code_cpv"] for r in second.marches.collect()} == {"1": "72", "5": "72"}
    assert [r["denomination"] for r in second.entreprises.collect()] == ["Inconnu"] and second.attributions.count() == 2
    assert all(r["nb"] == 0 for r in gold.orphans(second).collect())
    assert [r["uid"] for r in gold.stale(second, two.where("uid = '5'")).collect()] == ["1"]
    broken = gold.Gold(second.acheteurs.limit(0), second.marches, second.entreprises, second.attributions)
    assert {r["lien"]: r["nb"] for r in gold.orphans(broken).collect()}["marches.siret_acheteur"] == 2
    units = spark.createDataFrame([("u", "62.01Z")], "siren string, activitePrincipaleUniteLegale string")
    places = spark.createDataFrame([("b", "u", "75001")], "siret string, siren string, codePostalEtablissement string")
    assert {(r["siret"], r["naf"], r["departement"]) for r in second.star(units, places).acheteurs.collect()} == {("b", "62.01Z", "75"), ("d", None, None)}
    sheets = facts.fact_sheets(second.star(units, places))
    assert sheets.count() == 2 and sheets.where("raison IS NULL").count() == 0  # undated markets are in no chain


def test_identities_meet_on_their_columns(spark):
    """A null name is not a null buyer: keys that one hash takes for the same stay apart."""
    asked = spark.createDataFrame([("i", "X", None, 1), ("i", None, "X", 2), (None, None, None, 3)], "identifiant string, nom string, acheteur string, n int")
    found = silver._by_keys(asked, ["identifiant", "nom", "acheteur"], lambda k: k.select("key", F.coalesce("nom", F.lit("none")).alias("siret")))
    assert {r["n"]: r["siret"] for r in found.collect()} == {1: "X", 2: "none", 3: "none"}


REGISTER = "siren string, denomination string, etat string, nom_personne string, prenoms array<string>, siret_siege string"


def test_the_sole_active_company_counts_only_with_its_seat(spark):
    register = spark.createDataFrame([
        ("1", "GAMMA", "A", None, None, "s1"), ("2", "GAMMA", "A", None, None, None),  # two active ones, of which one has a seat: in doubt
        ("3", "DELTA", "C", None, None, "s3"), ("4", "DELTA", "A", None, None, None),  # the active one has none: in doubt
        ("5", "OMEGA", "C", None, None, "s5"), ("6", "OMEGA", "A", None, None, "s6"), ("7", "OMEGA", None, None, None, "s7"),
        ("8", "SIGMA", "C", None, None, "s8"), ("9", "SIGMA", "C", None, None, "s9"),
    ], REGISTER)
    keys = spark.createDataFrame([(n,) for n in ("Gamma", "Delta", "Omega", "Sigma")], "nom string")
    found, doubt = identity.by_similarity(keys, register)
    assert [(r["nom"], r["siret"], r["methode"], r["score"]) for r in found.collect()] == [("Omega", "s6", "flou_desambigue_actif", 0.65)]
    assert {(r["nom"], r["siren"]) for r in doubt.collect()} == {("Gamma", "1"), ("Gamma", "2"), ("Delta", "3"), ("Delta", "4"), ("Sigma", "8"), ("Sigma", "9")}


@pytest.mark.parametrize("n", [20, 40, 100, 180])
def test_pairs_on_the_threshold_are_found(spark, n):
    """A name of n trigrams and one that holds eleven twentieths of them and no other."""
    words = [chr(0x4E00 + i) for i in range(n // 2)]  # a word of one letter has two trigrams
    whole = " ".join(words)
    register = spark.createDataFrame([("1", " ".join(words[: n * 11 // 40]) if n % 40 == 0 else None), ("2", whole)], "siren string, denomination string")
    sizes = {r["siren"]: r["n"] for r in register.select("siren", F.size(trigrams(F.upper("denomination"))).alias("n")).collect()}
    assert sizes["2"] == n
    index = name_index.of_register(register)
    plain = lambda n, t=name_index.THRESHOLD: -(-n * t.numerator // t.denominator)
    assert spark.range(1).select(name_index._least(F.lit(n), name_index.THRESHOLD).alias("x")).first()["x"] == plain(n) == n * 11 // 20
    near = spark.createDataFrame([("q", "1"), ("q", "2")], "nom string, siren string")
    grams = trigrams(F.lit(whole))
    got = index._decided(near, spark.range(1).select(F.lit("q").alias("nom"), grams.alias("g")), name_index.THRESHOLD)
    assert {r["siren"] for r in got.collect()} == ({"1", "2"} if sizes["1"] and sizes["1"] * 20 >= n * 11 else {"2"})


def _plan_above(df, table):
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, x in enumerate(lines) if table in x and "Scan" in x)
    depth, above = len(lines[at]) - len(lines[at].lstrip(" :+-*0123456789()")), []
    for x in reversed(lines[:at]):
        own = len(x) - len(x.lstrip(" :+-*0123456789()"))
        if own < depth:
            above.append(x)
            depth = own
            if "Join" in x:
                break
    return " ".join(above)


def test_a_stored_index_is_read_in_place_and_extended(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    people = [f"{a} {b}" for a in ("ALPHA", "BETA", "GAMMA", "OMEGA") for b in ("CONSEIL", "SERVICES", "TRAVAUX", "GROUPE")]
    register = spark.createDataFrame([(str(i), n) for i, n in enumerate(people)], "siren string, denomination string")
    index = name_index.build(register, folder, 4)
    asked = spark.createDataFrame([("Alpha Conseils",), ("beta service",), ("Omega groupe SAS",), ("zzz",)], "nom string")
    assert rows(index.similar(asked)) == rows(name_index.of_register(register).similar(asked))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for table in ("postings", "often"):
            assert "Exchange" not in _plan_above(index.similar(asked), name_index._table(folder, table))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    files = {p for p in tmp_path.rglob("*.parquet")}
    changed = [("0", "KAPPA CONSEIL"), ("99", "NOUVELLE MAISON"), ("5", None)]  # renamed, new, gone
    index = name_index.extend(spark, folder, spark.createDataFrame(changed, "siren string, denomination string"))
    assert files <= {p for p in tmp_path.rglob("*.parquet")}  # nothing is rewritten
    now = {str(i): n for i, n in enumerate(people)} | dict(changed)
    register = spark.createDataFrame([(k, v) for k, v in now.items() if v], "siren string, denomination string")
    asked = spark.createDataFrame([("Kappa conseil",), ("Alpha Conseil",), ("nouvelle maison",), ("Beta services",)], "nom string")
    for call in ("similar", "best"):
        assert rows(getattr(index, call)(asked)) == rows(getattr(name_index.of_register(register), call)(asked))


def test_stream_state_writes_what_changes(spark, tmp_path):
    base, schema = f"file://{tmp_path}", "k long, r long, v string"
    seen = {}

    def arrive(batch):
        for k, r, v in batch:
            if k not in seen or r >= seen[k][0]:
                seen[k] = (r, v)
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        bronze.keep_latest(spark, f"{base}/in", schema, f"{base}/state", ["k"], "r", most=3)  # each call is a restart
        got = bronze.kept(spark, f"{base}/state", ["k"], "r").collect()
        assert {r["k"]: (r["r"], r["v"]) for r in got} == seen

    arrive([(k, 5, "a") for k in range(100)])
    arrive([(1, 9, "b"), (2, 1, "late")])
    newest = [p for p in (tmp_path / "state").glob("run-0-1-1/*.parquet")]
    assert sum(spark.read.parquet(f"file://{p}").count() for p in newest) == 2
    for n in range(2, 10):
        arrive([(n, 10 + n, f"c{n}")])
    assert len(list((tmp_path / "state").glob("run-*"))) <= 4


def test_csv_splits_inside_quotes(spark, tmp_path):
    import csv

    rng = np.random.default_rng(3)
    table = [[str(i), "".join(rng.choice(list('ab,"\n\r ;é'), 40)), "" if i % 7 else 'x "y"\nz'] for i in range(400)]
    for name, part in (("a.csv", table[:300]), ("b.csv", table[300:])):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            writer = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\n")
            writer.writerows([["n", "a b", "c"], *part])
    settings = {"spark.sql.files.maxPartitionBytes": "997", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        whole = spark.read.text(f"file://{tmp_path}", lineSep="\n")
        assert whole.count() > 800 and whole.rdd.getNumPartitions() > 10  # records hold line ends, and blocks end within records
        df = readers.text_csv(spark, f"file://{tmp_path}")
        got = {r["n"]: (r["a b"], r["c"] or "") for r in df.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {n: (a, c) for n, a, c in table} and df.columns == ["n", "a b", "c"]


def test_buyers_with_the_same_comparable_ones_share_one_list(spark):
    buyers = spark.createDataFrame([(f"b{i:02d}", "62", "75") for i in range(50)] + [("z", "62", "13"), ("y", "63", None)], "siret string, naf string, departement string")
    got = facts.comparable_buyers(buyers).collect()
    lists = {}
    for r in got:
        lists.setdefault(r["liste"], set()).add(tuple(r["comparables"]))
    assert all(len(x) == 1 for x in lists.values()) and len(lists) == 20 + 1 + 1 + 1  # the first 20, all others, and the two without a neighbour
    assert sum(r["liste"]["sauf"] == "" and r["zone"] == "departement" for r in got) == 30


def test_companies_of_a_list_and_of_a_family_add_up(spark):
    """Twelve companies of a shared list, of which the incumbent and one more are the family's own."""
    day = datetime.date(2020, 1, 1)
    buyers = [(f"b{i:02d}", f"B{i}", "62", "75") for i in range(25)]
    markets = [("own", "b24", 5.0, "72210000", day, None, None, None)] + [(f"m{i}-{k}", f"b{i:02d}", 10.0 + i, "72210000", day, None, None, None) for i in range(20) for k in range(12) if i >= k]
    won = [("own", "s00"), ("own", "s03"), ("own", "s99")] + [(m[0], f"s{int(m[0].split('-')[1]):02d}") for m in markets[1:]]
    star = Star(
        spark.createDataFrame(buyers, "siret string, nom string, naf string, departement string"),
        spark.createDataFrame(markets, "uid string, siret_acheteur string, montant double, code_cpv string, date_notification date, duree_mois double, duree_restante_mois double, objet string"),
        spark.createDataFrame([(f"s{k:02d}", f"S{k:02d}", "ETRANGER" if k in (3, 5) else "A") for k in (*range(12), 99)], "siren string, denomination string, etat string"),
        spark.createDataFrame(won, "uid string, siren string"),
    ).typed()
    sheet = facts.fact_sheets(star).where("siret_acheteur = 'b24'").first()
    said = {f["cle"]: f for f in sheet["faits"]}
    total = 3 + len(markets) - 1
    near = {f"S{k:02d}": 20 - k for k in range(1, 12)} | {"S99": 1}
    near["S03"] += 1
    first = sorted(near.items(), key=lambda x: (-x[1], x[0] not in ("S03", "S99"), x[0]))[:10]
    assert said["concurrents_observes"]["liste"] == [f"{d}{' [hors France]' if d in ('S03', 'S05') else ''} ({n}/{total} attribution(s))" for d, n in first] + ["... et 2 autre(s) concurrent(s) observé(s)"]
    assert said["nb_concurrents_hors_france"]["nombre"] == 2 and (said["fourchette_prix_min"]["nombre"], said["fourchette_prix_max"]["nombre"]) == (5.0, 29.0)


def test_versions_are_put_in_order_once_not_once_a_winner(spark):
    decp = spark.sql("""SELECT 'm' AS uid, '1' AS acheteur_id, 'B' AS acheteur_nom, concat('w', id) AS titulaire_id, concat('W', id) AS titulaire_nom, 'o' AS objet, CAST(id % 2 AS STRING) AS montant,
      '72' AS code_cpv, '2020-01-01' AS date_notification, '' AS date_publication, '' AS duree_mois, '' AS duree_restante_mois, CAST(id % 2 AS STRING) AS modification_id, TIMESTAMP '2024-01-01 00:00:00' AS date_chargement FROM range(6)""")
    ted = spark.sql("""SELECT 't' AS publication_number, '' AS buyer_identifier, '' AS buyer_name, CAST(id AS STRING) AS winner_identifier, 'o' AS objet, 'n.c.' AS montant, '72' AS code_cpv, '' AS publication_date,
      TIMESTAMP '2024-01-01 00:00:00' AS date_chargement FROM range(3)""")
    got = silver.markets(decp, ted, F.lit("2024-01-01").cast("date"))
    assert {(r["uid"], r["modification_id"], tuple(r["rejets"])) for r in got.collect()} == {("m", 1, ()), ("TED-t", None, ("montant",))} and got.count() == 2
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "titulaire" not in plan and "winner" not in plan


def test_buyers_of_silver_need_no_winners(spark):
    from tenderlake.plans import procurement

    decp, ted, _ = procurement._bronze(spark, DATA)
    raw = silver._buyers(decp, ted)
    assert "l_orderkey" not in raw._jdf.queryExecution().optimizedPlan().toString()
    pairs = decp.selectExpr("uid", "acheteur_id AS i", "acheteur_nom", "date_chargement").unionByName(ted.selectExpr("'TED-' || publication_number AS uid", "buyer_identifier AS i", "buyer_name AS acheteur_nom", "date_chargement"))
    assert sorted(map(tuple, raw.collect())) == sorted(set(map(tuple, pairs.where("NOT i RLIKE '^[0-9]{14}$'").collect())))


def test_both_builds_of_gold_read_awards_that_are_stored(spark, monkeypatch):
    from tenderlake.plans import procurement

    columns = "uid string, source string, siret_acheteur string, nom_acheteur string, objet string, montant double, code_cpv string, date_notification date, date_publication date, duree_mois double, duree_restante_mois double, modification_id int, doublon_probable_de string"
    markets = spark.createDataFrame([(str(i), "DECP", "b", "n", None, 1.0, "72", None, None, None, None, None, None) for i in range(6)], columns)
    awards = markets.selectExpr("uid", "'12345678900001' AS siret_titulaire", "'t' AS nom_titulaire", "source", "CAST(NULL AS STRING) AS methode_resolution", "0.5D AS score_confiance").distinct()
    real, seen = gold.build, []
    monkeypatch.setattr(procurement, "_silver", lambda *a: (markets, awards))
    monkeypatch.setattr(gold, "build", lambda m, a, *rest: seen.append(a) or real(m, a, *rest))
    assert procurement._gold(spark, DATA)[0].attributions.count() == 6
    assert len(seen) == 2 and all("Aggregate" not in a._jdf.queryExecution().optimizedPlan().toString() for a in seen)


def test_lists_of_comparable_buyers_go_through_exchanges_as_numbers(spark):
    star = Star.of_tables(spark, DATA)
    asked = facts.comparable_buyers(star.acheteurs).select(F.monotonically_increasing_id().alias("fid"), F.col("siret").alias("siret_acheteur"), F.lit(2).alias("niveau"), F.lit("72").alias("famille"), "liste", F.lit("Supplier#000000001").alias("sortant"))
    plan = facts._rivals(star, asked)._jdf.queryExecution().optimizedPlan().toString()
    grouped = [x for x in plan.split("\n") if "Window [" in x or "Aggregate [" in x]
    assert any("lid#" in x for x in grouped) and not any("liste#" in x or "famille#" in x for x in grouped)
