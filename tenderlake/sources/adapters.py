"""The generated star schema as canonical procurement relations, in either SQL dialect."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

CANON = """
acheteurs AS (
  SELECT lpad(CAST(c_custkey AS STRING), 14, '0') AS siret, c_name AS nom, c_nationkey AS departement, c_mktsegment AS naf FROM customer),
entreprises AS (
  SELECT lpad(CAST(s_suppkey AS STRING), 9, '0') AS siren, s_name AS denomination,
         CASE WHEN n_regionkey = 0 THEN 'ETRANGER' ELSE 'A' END AS etat FROM supplier JOIN nation ON s_nationkey = n_nationkey),
marches AS (
  SELECT CAST(o_orderkey AS STRING) AS uid, lpad(CAST(o_custkey AS STRING), 14, '0') AS siret_acheteur, o_totalprice AS montant,
         CAST(o_orderdate AS DATE) AS date_notification,
         CASE left(o_orderpriority, 1) WHEN '1' THEN '72210000' WHEN '2' THEN '72212900' WHEN '3' THEN '72220000'
              WHEN '4' THEN '72267000' ELSE '45000000' END AS code_cpv,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 1 + o_orderkey % 48 END AS duree_mois,
         CAST(NULL AS DOUBLE) AS duree_restante_mois, CASE WHEN o_orderkey % 2 = 0 THEN 'TED' ELSE 'DECP' END AS source FROM orders),
attributions AS (
  SELECT DISTINCT CAST(l_orderkey AS STRING) AS uid, lpad(CAST(l_suppkey AS STRING), 9, '0') AS siren FROM lineitem)
"""

#: Bronze text of the two sources: two versions of each market, raw ids of every shape, text that does not cast.
BRONZE = """
brut AS (
  SELECT o_orderkey, o_custkey, o_totalprice, n, lpad(CAST(o_custkey AS STRING), 14, '0') AS s, c_name,
         CASE left(o_orderpriority, 1) WHEN '1' THEN '72210000' WHEN '2' THEN '72212900' WHEN '3' THEN '72220000' WHEN '4' THEN '72267000' ELSE '45000000' END AS cpv,
         CASE WHEN o_orderkey % 19 = 0 THEN '0206-06-23' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS jour,
         CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN 'n.c.' ELSE CAST(o_totalprice + n AS STRING) END AS prix,
         CASE WHEN o_orderkey % 4 = 1 THEN 2 - n ELSE n + 1 END AS charge
  FROM orders JOIN customer ON o_custkey = c_custkey CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 AS n) v),
acheteur AS (
  SELECT *, CASE o_custkey % 7 WHEN 3 THEN concat(left(s, 3), ' ', substring(s, 4, 3), ' ', substring(s, 7, 3), ' ', right(s, 5))
                 WHEN 4 THEN 'sans numero' WHEN 5 THEN '' ELSE s END AS acheteur_id,
         CASE WHEN o_custkey % 11 = 0 THEN '' ELSE c_name END AS acheteur_nom FROM brut),
titulaire AS (
  SELECT DISTINCT l_orderkey, s_name, CASE l_suppkey % 5 WHEN 0 THEN concat(lpad(CAST(l_suppkey AS STRING), 9, '0'), '00001')
         WHEN 1 THEN concat('SIREN ', lpad(CAST(l_suppkey AS STRING), 9, '0')) WHEN 2 THEN concat('FR12', lpad(CAST(l_suppkey AS STRING), 9, '0'))
         WHEN 3 THEN concat('BE', lpad(CAST(l_suppkey AS STRING), 9, '0')) ELSE 'sans numero' END AS titulaire_id
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
bronze_decp AS (
  SELECT CAST(o_orderkey AS STRING) AS uid, acheteur_id, acheteur_nom, titulaire_id, s_name AS titulaire_nom, concat('objet ', CAST(n AS STRING)) AS objet, prix AS montant,
         cpv AS code_cpv, jour AS date_notification, jour AS date_publication, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(1 + o_orderkey % 48 AS STRING) END AS duree_mois,
         CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderkey % 24 AS STRING) END AS duree_restante_mois, CASE n WHEN 0 THEN '' ELSE CAST(o_orderkey % 3 AS STRING) END AS modification_id,
         CAST(concat('2024-01-0', CAST(charge AS STRING), ' 00:00:00') AS TIMESTAMP) AS date_chargement
  FROM acheteur LEFT JOIN titulaire ON o_orderkey = l_orderkey WHERE o_orderkey % 2 = 1),
bronze_ted AS (
  SELECT CAST(o_orderkey AS STRING) AS publication_number, acheteur_id AS buyer_identifier, acheteur_nom AS buyer_name, titulaire_id AS winner_identifier, s_name AS winner_name,
         concat('objet ', CAST(n AS STRING)) AS objet, prix AS montant, cpv AS code_cpv, jour AS publication_date,
         CAST(concat('2024-01-0', CAST(charge AS STRING), ' 00:00:00') AS TIMESTAMP) AS date_chargement
  FROM acheteur LEFT JOIN titulaire ON o_orderkey = l_orderkey WHERE o_orderkey % 2 = 0),
registre AS (
  SELECT lpad(CAST(s_suppkey AS STRING), 9, '0') AS siren, s_name AS denomination, CASE WHEN s_suppkey % 40 IN (14, 34) THEN 'C' ELSE 'A' END AS etat,
         concat(lpad(CAST(s_suppkey AS STRING), 9, '0'), '00001') AS siret_siege FROM supplier
  UNION ALL SELECT concat('8', lpad(CAST(s_suppkey AS STRING), 8, '0')), s_name, CASE WHEN s_suppkey % 40 IN (4, 24) THEN 'C' ELSE 'A' END,
         CASE WHEN s_suppkey % 40 IN (9, 34) THEN NULL ELSE concat('8', lpad(CAST(s_suppkey AS STRING), 8, '0'), '00001') END FROM supplier WHERE s_suppkey % 5 = 4 AND s_suppkey % 40 <> 39
  UNION ALL SELECT concat('9', lpad(CAST(c_custkey AS STRING), 8, '0')), c_name, 'A', concat('9', lpad(CAST(c_custkey AS STRING), 8, '0'), '00002') FROM customer)
"""


#: Bytes of Parquet that one task reads, that are counted for one shuffle partition, and of shuffled rows that one task takes.
READ, DEALT, TAKEN = 8 << 20, 4 << 20, 2 << 20


def small_tasks(spark: SparkSession, paths: list[str]) -> None:
    """Settings of the session by which a task holds about as much however large the tables are: windows, joins and
    groupings are dealt to a number of partitions that grows with them.  A setting is made finer, never coarser."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    size = sum(at(p).getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at(p)).getLength() for p in paths)
    if (n := -(-size // DEALT)) > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
    for setting, most in (("spark.sql.files.maxPartitionBytes", READ), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", TAKEN)):
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting)) > most:
            spark.conf.set(setting, str(most))


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the Parquet tables of a folder; only those it names are registered."""
    paths = {name: f"{sf_dir}/{name}.parquet" for name in TABLES if re.search(rf"\b{name}\b", sql)}
    for name, path in paths.items():
        spark.read.parquet(path).createOrReplaceTempView(name)
    small_tasks(spark, list(paths.values()))
    return spark.sql(sql)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what an Arrow batch that goes to Python holds, in rows and in bytes; never coarser than it was."""
    for setting, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", READ)):
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting))
        if not 0 < now <= most:
            spark.conf.set(setting, str(most))


def shared(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which must be set where there are executors;
    a private one only where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='tenderlake-')).rstrip('/')}/run-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: a plan that several others build on is
    computed once, and a lost executor does not recompute it."""
    path = f"{shared(df.sparkSession)}/stage"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
