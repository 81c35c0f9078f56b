"""All queries of the procurement engine by name, with the SQL that states their result.

Plain relational queries are written once against the canonical relations.  Everything that
the library computes by its own functions is a query of ``procurement`` or of this module, and
its SQL is written apart, in ``oracles`` or beside it.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tenderlake.functions import text
from tenderlake.operators import graph, identity, versions
from tenderlake.plans import oracles, procurement
from tenderlake.sources.adapters import CANON, run
from tenderlake.streaming import bronze

MINIMUM = 0.55


def _canon(body):
    return f"WITH {CANON}\n{body}"


_ELIGIBLE = "m.siret_acheteur IS NOT NULL AND m.code_cpv LIKE '72%'"

#: Plain relational queries, by name.
SQL = {
    "semi_in_scope": _canon("SELECT uid, siren FROM attributions a WHERE uid IN (SELECT uid FROM marches WHERE code_cpv LIKE '72%')"),
    "anti_unawarded": _canon("SELECT uid, siret_acheteur, code_cpv FROM marches m WHERE NOT EXISTS (SELECT 1 FROM attributions a WHERE a.uid = m.uid)"),
    "left_market_counts": _canon("""
SELECT b.siret, b.nom, count(m.uid) AS nb_marches FROM acheteurs b LEFT JOIN marches m ON m.siret_acheteur = b.siret GROUP BY b.siret, b.nom"""),
    "buyer_search": _canon("""
SELECT b.siret, b.nom, count(m.uid) AS nb_marches FROM acheteurs b LEFT JOIN marches m ON m.siret_acheteur = b.siret
WHERE b.nom ILIKE '%00001%' GROUP BY b.siret, b.nom"""),
    "self_co_award": _canon("SELECT DISTINCT a.siren AS siren_a, b.siren AS siren_b FROM attributions a JOIN attributions b ON a.uid = b.uid AND a.siren <> b.siren"),
    "having_correlated": _canon("""
SELECT m.siret_acheteur, m.code_cpv, a.siren, count(*) AS nb FROM marches m JOIN attributions a ON m.uid = a.uid
GROUP BY m.siret_acheteur, m.code_cpv, a.siren
HAVING count(*) >= (SELECT count(*) * 0.5 FROM marches f WHERE f.siret_acheteur = m.siret_acheteur AND f.code_cpv = m.code_cpv)"""),
    "gold_buyers": _canon(f"""
SELECT b.siret, coalesce(min(b.nom), 'Acheteur inconnu') AS nom FROM acheteurs b JOIN marches m ON m.siret_acheteur = b.siret
WHERE {_ELIGIBLE} GROUP BY b.siret"""),
    "gold_markets": _canon(f"SELECT m.uid, m.siret_acheteur, m.montant, m.code_cpv, m.date_notification, m.duree_mois FROM marches m WHERE {_ELIGIBLE}"),
    "gold_companies": _canon(f"""
SELECT a.siren, coalesce(min(e.denomination), 'Inconnu') AS denomination FROM attributions a JOIN marches m ON m.uid = a.uid
LEFT JOIN entreprises e ON e.siren = a.siren WHERE {_ELIGIBLE} GROUP BY a.siren"""),
    "gold_awards": _canon(f"SELECT DISTINCT a.uid, a.siren, m.source FROM attributions a JOIN marches m ON m.uid = a.uid WHERE {_ELIGIBLE}"),
    "stale_gold": _canon("""
SELECT count(*) AS perimes FROM (SELECT uid FROM marches WHERE code_cpv LIKE '722%') g
WHERE NOT EXISTS (SELECT 1 FROM marches s WHERE s.uid = g.uid AND s.code_cpv LIKE '7221%')"""),
    "out_of_scope": _canon("SELECT uid, code_cpv FROM marches WHERE code_cpv IS NULL OR code_cpv NOT LIKE '72%'"),
    "plausible_dates": _canon("""
SELECT uid, CASE WHEN date_notification BETWEEN DATE '1993-01-01' AND DATE '1997-12-31' THEN date_notification END AS date_notification FROM marches"""),
    "award_method_distribution": _canon("SELECT source, left(code_cpv, 4) AS famille, count(*) AS nb FROM marches GROUP BY source, left(code_cpv, 4)"),
    "distinct_filtered": _canon("""
SELECT m.code_cpv, count(DISTINCT a.siren) AS titulaires, count(DISTINCT a.siren) FILTER (WHERE e.etat = 'ETRANGER') AS etrangers
FROM marches m JOIN attributions a ON m.uid = a.uid LEFT JOIN entreprises e ON e.siren = a.siren GROUP BY m.code_cpv"""),
    "recent_sources": _canon("""
SELECT uid, siret_acheteur, CAST(n AS BIGINT) AS n FROM (SELECT uid, siret_acheteur,
  row_number() OVER (PARTITION BY siret_acheteur ORDER BY date_notification DESC NULLS LAST, uid) AS n FROM marches) x WHERE n <= 30"""),
    "latest_version_per_key": """SELECT user_id, event_id, event_type, value FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, ts DESC) AS n FROM events) x WHERE n = 1""",
    "first_writer_wins": """SELECT user_id, event_type, CAST(stage AS BIGINT) AS stage, event_id FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY stage, event_id) AS n FROM (
  SELECT user_id, event_type, CASE WHEN value >= 50 THEN 0 ELSE 1 END AS stage, event_id FROM events) y) x WHERE n = 1""",
    "upsert_rows": """SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0
 UNION ALL SELECT c_custkey, concat(c_name, ' (maj)') AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0""",
    "update_from_enrich": """SELECT s_suppkey, s_name, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN n_name END, r_name) AS libelle
 FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
}

#: Trigrams of part names: the pairs of distinct names and their similarity.
_GRAMS = """WITH names AS (SELECT DISTINCT p_name AS nom FROM part),
words AS (SELECT nom, unnest(list_filter(regexp_split_to_array(lower(nom), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM names),
grams AS (SELECT DISTINCT nom, substring('  ' || w || ' ', i, 3) AS g FROM words, range(1, 64) r(i) WHERE i <= length(w) + 1),
sizes AS (SELECT nom, count(*) AS n FROM grams GROUP BY nom),
met AS (SELECT a.nom AS a, b.nom AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.nom <> b.nom GROUP BY a.nom, b.nom),
scored AS (SELECT a, b, CAST(k AS DOUBLE) / (x.n + y.n - k) AS score FROM met JOIN sizes x ON x.nom = a JOIN sizes y ON y.nom = b)
"""
TRIGRAM_SQL = _GRAMS + f"SELECT a AS nom, b AS candidat, round(score, 5) AS score FROM scored WHERE score >= {MINIMUM}"
BEST_SQL = _GRAMS + f"""SELECT nom, candidat, round(score, 5) AS score FROM (SELECT a AS nom, b AS candidat, score, max(score) OVER (PARTITION BY a) AS m FROM scored
WHERE score >= {MINIMUM}) x WHERE score = m"""


def trigram_match(spark, sf_dir):
    names = run(spark, sf_dir, "SELECT DISTINCT p_name AS nom FROM part")
    hits = identity.similar_names(names, names.select(F.col("nom").alias("siren"), F.col("nom").alias("denomination")), MINIMUM)
    return hits.where("nom <> siren").select("nom", F.col("siren").alias("candidat"), F.round(F.col("score").cast("double"), 5).alias("score"))


def trigram_best_with_ties(spark, sf_dir):
    from pyspark.sql import Window

    hits = trigram_match(spark, sf_dir)
    return hits.withColumn("_m", F.max("score").over(Window.partitionBy("nom"))).where("score = _m").drop("_m")


def normalise_names(spark, sf_dir):
    return run(spark, sf_dir, "SELECT s_suppkey, concat('SARL ', s_name, ' S.A. É-', n_name) AS brut FROM supplier JOIN nation ON s_nationkey = n_nationkey").select(
        "s_suppkey", text.normalise_name(F.col("brut")).alias("nom")
    )


NAMES_SQL = """SELECT s_suppkey, concat(regexp_replace(upper(s_name), '[^A-Z0-9]+', ' ', 'g'), ' S A E ', n_name) AS nom FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def person_name_match(spark, sf_dir):
    people = run(spark, sf_dir, "SELECT concat('P', p_partkey) AS key, concat(split(p_name, ' ')[1], ' ', split(p_name, ' ')[0]) AS nom FROM part")
    register = run(spark, sf_dir, """SELECT DISTINCT upper(split(p_name, ' ')[0]) AS nom_personne, array(upper(split(p_name, ' ')[1])) AS prenoms,
      upper(p_name) AS siren, upper(p_name) AS siret_siege, CAST(NULL AS STRING) AS denomination FROM part""")
    return identity.by_person(people, register).select("key", "siren", "score")


PERSON_SQL = """WITH p AS (SELECT DISTINCT upper(split_part(p_name, ' ', 1)) AS nom_personne, upper(split_part(p_name, ' ', 2)) AS prenom, upper(p_name) AS siren FROM part),
k AS (SELECT 'P' || p_partkey AS key, upper(split_part(p_name, ' ', 1)) AS a, upper(split_part(p_name, ' ', 2)) AS b FROM part),
met AS (SELECT DISTINCT key, siren FROM k JOIN p ON (nom_personne = a AND prenom = b) OR (nom_personne = b AND prenom = a))
SELECT key, min(siren) AS siren, 0.9 AS score FROM met GROUP BY key HAVING count(*) = 1"""


def buyer_continuity(spark, sf_dir):
    rows = run(spark, sf_dir, f"WITH {CANON} SELECT m.uid, m.source, m.siret_acheteur AS acheteur, a.siren FROM marches m JOIN attributions a ON a.uid = m.uid")
    past = rows.where("source = 'DECP'").select("acheteur", F.concat("siren", F.lit("00001")).alias("siret")).distinct()
    asked = rows.where("source = 'TED'").select(F.col("uid").alias("key"), "acheteur", "siren").distinct()
    return identity.by_continuity(asked, past).select("key", "siret", "score")


CONTINUITY_SQL = f"""WITH {CANON}, r AS (SELECT m.uid, m.source, m.siret_acheteur AS acheteur, a.siren FROM marches m JOIN attributions a ON a.uid = m.uid),
past AS (SELECT DISTINCT acheteur, siren FROM r WHERE source = 'DECP')
SELECT r.uid AS key, concat(min(r.siren), '00001') AS siret, 0.75 AS score FROM r JOIN past USING (acheteur, siren)
WHERE source = 'TED' GROUP BY r.uid HAVING count(DISTINCT r.siren) = 1"""


def co_winners_transitive(spark, sf_dir):
    awards = run(spark, sf_dir, f"WITH {CANON} SELECT a.uid, a.siren FROM attributions a")
    return graph.co_winners(awards, "000000001").select("siren", F.col("depth").cast("long").alias("profondeur"), "uid")


CO_WINNERS_SQL = f"""WITH RECURSIVE {CANON}, a AS (SELECT uid, siren FROM attributions),
g AS (SELECT '000000001' AS siren, 0 AS depth UNION SELECT b.siren, g.depth + 1 FROM g JOIN a x ON x.siren = g.siren JOIN a b ON b.uid = x.uid AND b.siren <> x.siren
WHERE g.depth < 2 AND b.siren <> '000000001')
, d AS (SELECT siren, min(depth) AS depth FROM g GROUP BY siren)
SELECT d.siren, CAST(d.depth AS BIGINT) AS profondeur, min(x.uid) AS uid FROM d JOIN a x ON x.siren = d.siren JOIN a y ON y.uid = x.uid JOIN d e ON e.siren = y.siren AND e.depth = d.depth - 1
WHERE d.depth > 0 GROUP BY ALL"""


def first_writer(spark, sf_dir):
    e = run(spark, sf_dir, "SELECT user_id, event_type, event_id, value FROM events")
    stages = (e.where("value >= 50"), e.where("value < 50 OR value IS NULL"))
    tagged = [s.select("user_id", "event_type", F.lit(i).cast("long").alias("stage"), "event_id") for i, s in enumerate(stages)]
    one = [versions.latest(s, ["user_id", "event_type"], F.col("event_id")) for s in tagged]
    return versions.first_writer_wins(["user_id", "event_type"], *one)


def upsert_rows(spark, sf_dir):
    old = run(spark, sf_dir, "SELECT c_custkey, c_name, c_acctbal FROM customer")
    new = old.where("c_custkey % 3 = 0").select("c_custkey", F.concat("c_name", F.lit(" (maj)")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return versions.upsert(old, new, ["c_custkey"])


def stream_bronze_append(spark, sf_dir):
    """Events by the streaming bronze layer, then the last version of each user."""
    from tenderlake.sources.adapters import shared

    base = shared(spark)
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    source.write.parquet(f"{base}/in")
    bronze.append(spark, f"{base}/in", source.schema, f"{base}/bronze", f"{base}/progress")
    got = bronze.latest_versions(spark.read.parquet(f"{base}/bronze"), "user_id", "event_id")
    return got.select("user_id", "event_id", "event_type", "value")


WINNERS = f"""WITH {CANON}
SELECT m.uid, m.date_notification, m.montant, array_join(array_sort(collect_set(e.denomination)), ', ') AS titulaires FROM marches m
LEFT JOIN attributions a ON a.uid = m.uid LEFT JOIN entreprises e ON e.siren = a.siren GROUP BY m.uid, m.date_notification, m.montant"""
WINNERS_SQL = f"""WITH {CANON}
SELECT uid, date_notification, montant, coalesce((SELECT string_agg(d, ', ' ORDER BY d) FROM (
  SELECT DISTINCT e.denomination AS d FROM attributions a JOIN entreprises e ON e.siren = a.siren WHERE a.uid = m.uid) x), '') AS titulaires FROM marches m"""


QUERIES = {name: partial(lambda spark, sf_dir, q: run(spark, sf_dir, q), q=q) for name, q in (SQL | {"winners_list": WINNERS}).items()}
QUERIES |= procurement.QUERIES
QUERIES |= {
    "trigram_match": trigram_match,
    "trigram_best_with_ties": trigram_best_with_ties,
    "normalise_names": normalise_names,
    "person_name_match": person_name_match,
    "buyer_continuity": buyer_continuity,
    "co_winners_transitive": co_winners_transitive,
    "first_writer_wins": first_writer,
    "upsert_rows": upsert_rows,
    "stream_bronze_append": stream_bronze_append,
}

ORACLE_SQL = SQL | oracles.ORACLE_SQL | {
    "winners_list": WINNERS_SQL,
    "trigram_match": TRIGRAM_SQL,
    "trigram_best_with_ties": BEST_SQL,
    "normalise_names": NAMES_SQL,
    "person_name_match": PERSON_SQL,
    "buyer_continuity": CONTINUITY_SQL,
    "co_winners_transitive": CO_WINNERS_SQL,
    "stream_bronze_append": SQL["latest_version_per_key"],
}
