"""Rules, names and levels of identity resolution on a small register."""

import json

from pyspark.sql import functions as F

from tenderlake.functions import text
from tenderlake.operators import identity, name_index, versions
from tenderlake.sources import readers


def _one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


def test_identifier_rules(spark):
    rules = lambda s: [tuple(r) for r in _one(spark, s, text.identifier_rules)]
    assert rules("123 456 789 00011") == [("12345678900011", "123456789", "espaces", None)]
    assert rules("SIRET : 12345678900011") == [("12345678900011", "123456789", "siret_exact_segmente", None)]
    assert rules("FR12123456789; 987654321") == [(None, "123456789", "tva_fr", None), (None, "987654321", "siren_seul", None)]
    assert rules("DE12") == [("DE120000000000", None, "etranger", "DE")]
    assert rules("FR99") == [] and rules("") == []
    assert rules("١٢٣٤٥٦٧٨٩") == []


def test_names_and_trigrams(spark):
    assert _one(spark, "Société Générale, S.A.", text.normalise_name) == "SOCIETE GENERALE S A"
    assert _one(spark, "Dupont SARL", text.normalise_name) == "DUPONT"
    assert _one(spark, None, text.normalise_name) == ""
    a, b = set(_one(spark, "word", text.trigrams)), set(_one(spark, "two words", text.trigrams))
    assert abs(len(a & b) / len(a | b) - 0.363636) < 1e-5


def test_mentions(spark):
    assert _one(spark, "7\u202f305 € et 2,480.25", text.numbers) == ["7305", "2480.25"]
    assert _one(spark, "le 31/12/2025 et 2024-01-02", text.dates) == ["2024-01-02", "2025-12-31"]
    assert _one(spark, "SIREN 123 456 789, 123.456.788 ou 1234567890.", text.siren_mentions) == ["123456789", "123456788"]
    assert _one(spark, "RÉGIE D'EAU NORD, Paul abC ABc X1", text.upper_names) == ["RÉGIE D'EAU NORD", "X1"]
    assert _one(spark, "Jean-Marc et PAUL Dupond", text.capitalised_words) == ["Jean-Marc", "Dupond"]


REGISTER = "siren string, denomination string, etat string, nom_personne string, prenoms array<string>, siret_siege string"


def test_cascade(spark):
    register = spark.createDataFrame([
        ("111111111", "ALPHA CONSEIL", "A", None, None, "11111111100001"),
        ("222222222", "BETA SERVICES", "A", None, None, "22222222200001"),
        ("333333333", "BETA SERVICES", "C", None, None, "33333333300001"),
        ("444444444", "GAMMA", "A", None, None, "44444444400001"),
        ("555555555", "GAMMA", "A", None, None, "55555555500001"),
        ("666666666", None, "A", "MARTIN", ["PAUL", "JEAN"], "66666666600001"),
    ], REGISTER)
    keys = spark.createDataFrame([
        (1, "SIREN 111111111", "x", "b"), (2, None, "Alpha Conseil SAS", "b"), (3, None, "Béta Services", "b"),
        (4, None, "Gamma", "b"), (5, None, "Jean Martin", "b"), (6, None, "Delta", "b"), (7, "", "Ancien Nom", "b"),
    ], "key long, identifiant string, nom string, acheteur string")
    awards = spark.createDataFrame([("b", "55555555500001")], "acheteur string, siret string")
    history = spark.createDataFrame([("777777777", "77777777700001", "Ancien Nom", "2020-01-01"), ("888888888", "8", "Delta", None)],
                                    "siren string, siret_siege string, denomination string, date_fin string")
    got = {r["key"]: (r["siret"], r["methode"], round(r["score"], 2)) for r in identity.resolve(keys, register, awards, history).collect()}
    assert got == {
        1: ("11111111100001", "siren_seul", 1.0), 2: ("11111111100001", "flou", 1.0), 3: ("22222222200001", "flou_desambigue_actif", 0.65),
        4: ("55555555500001", "continuite_acheteur", 0.75), 5: ("66666666600001", "personne_physique", 0.9),
        7: ("77777777700001", "historique", 0.8),
    }


def test_versions(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    new = spark.createDataFrame([(2, "b"), (3, "c")], "k long, v string")
    assert sorted(map(tuple, versions.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, versions.first_writer_wins(["k"], old.na.drop(), new).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, versions.fill_from(old, new, ["k"], ["v"]).collect())) == [(1, "a"), (2, "b")]
    assert [tuple(r) for r in versions.blanks_to_null(spark.createDataFrame([(" ", " x ")], "a string, b string")).collect()] == [(None, "x")]


def test_notices(spark):
    codes = lambda s: _one(spark, s, readers.category_codes)
    assert codes('{"OBJET": {"CPV": {"PRINCIPAL": "72"}}}') == ["72"]
    assert codes('{"OBJET": {"CPV": [{"PRINCIPAL": "72"}, {"PRINCIPAL": "48"}]}}') == ["72", "48"]
    assert codes("not json") is None and codes("{}") == []
    assert _one(spark, "<b>a &amp; b</b>", readers.plain_html) == "a & b"


def test_notices_are_parsed_once(spark):
    from tenderlake.sources import notices

    whole = '{"publication-number":"1","buyer-country":["FRA"],"buyer-name":{"eng":["E"],"deu":"D"},"classification-cpv":"72000000"}'
    raw = spark.createDataFrame([(x,) for x in (whole, "illisible", None, "", "[1]", '"x"', '{"publication-number":"2"', "{}")], "avis string")
    got = notices.ted_notices(raw, "72")
    assert [(r["publication_number"], r["buyer_name"], r["code_cpv"]) for r in got.collect()] == [("1", "E", "72000000")]
    assert notices.ted_notices(raw, None, None).count() == 2  # an empty object is a notice
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(got).count("from_json(StructField") == 1 and "get_json_object" not in plan(got)
    said = ['{"OBJET":{"CPV":{"PRINCIPAL":"72"}}}', '{"OBJET":{"CPV":[{"PRINCIPAL":"45"},{"X":1},{"PRINCIPAL":"72"}]}}', "{}", "[1]", "x", None]
    rows = [(json.dumps({"idweb": str(i), "code_departement": ["75"], "donnees": x}),) for i, x in enumerate(said)] + [("x",), (None,)]
    results = spark.createDataFrame(rows, "avis string")
    assert [(r["idweb"], r["codes_cpv"]) for r in notices.boamp_notices(results, None).collect()] == [("0", ["72"]), ("1", ["45", "72"]), ("2", [])]
    kept = notices.boamp_notices(results)
    assert [r["idweb"] for r in kept.collect()] == ["0", "1"] and plan(kept).count("from_json(StructField") == 2  # the notice, and the text within it
    periods = '{"uniteLegale":{"denominationUniteLegale":"","periodesUniteLegale":[{"denominationUniteLegale":"P","etatAdministratifUniteLegale":"A"}]}}'
    answers = notices.company_answers(spark.createDataFrame([("1", periods), ("2", "x"), ("3", None)], "siren string, reponse string"))
    assert [(r["siren"], r["denomination"], r["est_active"]) for r in answers.collect()] == [("1", "P", True), ("2", None, False), ("3", None, False)]
    assert plan(answers.where("est_active")).count("from_json(") == 1


def test_of_names_with_the_same_trigrams_the_very_name_counts(spark, tmp_path):
    register = spark.createDataFrame([("1", "S 000001000", "A", "s1"), ("2", "S 000010000", "A", "s2"), ("3", "T 000001000", "A", "s3"), ("4", "T-000001000", "A", "s4")],
                                     "siren string, denomination string, etat string, siret_siege string").selectExpr("*", "CAST(NULL AS STRING) AS nom_personne", "CAST(NULL AS ARRAY<STRING>) AS prenoms")
    keys = spark.createDataFrame([("a", "", "S#000001000"), ("b", "", "S#000010000"), ("c", "", "S#000100000"), ("d", "", "T#000001000")], "key string, identifiant string, nom string")
    for index in (None, name_index.build(register, f"file://{tmp_path}/i", 2)):
        sure, doubt = identity.by_similarity(keys, register, index)
        assert {r["key"]: (r["siren"], r["score"]) for r in sure.collect()} == {"a": ("1", 1.0), "b": ("2", 1.0)}
        assert sorted((r["key"], r["siren"]) for r in doubt.collect()) == [("c", "1"), ("c", "2"), ("d", "3"), ("d", "4")]


def test_a_bucket_of_the_index_is_one_file(spark, tmp_path):
    register = spark.range(0, 200, 1, 8).selectExpr("CAST(id AS STRING) AS siren", "concat('NOM ', id) AS denomination")
    name_index.build(register, f"file://{tmp_path}/i", 3)
    assert all(len(list((tmp_path / "i" / part).glob("part-*"))) <= 3 for part in ("names", "often", "postings", "equals"))


def test_keys_in_doubt_are_not_repeated_for_every_company(spark, monkeypatch):
    """Thirty companies of one name and forty keys that ask for it: nothing that is stored has a row for each pair."""
    register = spark.createDataFrame([(f"{i:09}", "GAMMA", "A", None, None, f"{i:09}00001") for i in range(30)], REGISTER)
    keys = spark.createDataFrame([(k, "", "Gamma", f"b{k % 4}") for k in range(40)], "key long, identifiant string, nom string, acheteur string")
    awards = spark.createDataFrame([("b0", "00000000500001"), ("b1", "00000000600001"), ("b1", "00000000700001"), ("b2", "99999999900001")], "acheteur string, siret string")
    real, seen = identity.stored, []

    def counted(df):
        seen.append((kept := real(df)).count())
        return kept

    monkeypatch.setattr(identity, "stored", counted)
    got = {r["key"]: (r["siret"], r["methode"], r["score"]) for r in identity.resolve(keys, register, awards).collect()}
    assert got == {k: ("00000000500001", "continuite_acheteur", 0.75) for k in range(0, 40, 4)} and max(seen) == 40
    _, doubt = identity.by_similarity(keys, register)  # the same from the pairs themselves
    assert {r["key"]: (r["siret"], r["methode"], r["score"]) for r in identity.by_continuity(doubt, awards).collect()} == got
