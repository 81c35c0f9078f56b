"""An index of company names by trigrams: built once, extended by changes, looked up without moving the register.

Two sets of trigrams with a Jaccard similarity of t or more share one of the rarest
n - ceil(t n) + 1 of each, in any fixed order of trigrams.  The order is that of how many names held
a trigram when the index was built; it stays as it is, so that later names keep to it.  Four
relations make the index, bucketed by the column that a lookup joins on: ``often`` (t, df),
``postings`` (t, siren, m) of the rarest trigrams of each name, ``equals`` (x, siren) by the hash of
all its trigrams, and ``names`` (siren, h, w, version), by which every candidate is decided: ``w`` are the
words of a name, as different names may have one set of trigrams.  The names of the last version of a company count; a posting of an older name only makes a candidate.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderlake.functions.text import normalise_name, trigrams, words
from tenderlake.sources.adapters import stored

THRESHOLD = Fraction(11, 20)
_COLUMNS = {"often": ("t", "t string, df long"), "postings": ("t", "t string, siren string, m int"), "equals": ("x", "x long, siren string"), "names": ("siren", "siren string, h array<string>, w string, version long")}


def _least(n: Column, t: Fraction) -> Column:
    """ceil(t n) in whole numbers."""
    return F.floor((n * t.numerator + (t.denominator - 1)) / t.denominator).cast("int")


def rarest(rows: DataFrame, key: list[str], grams: str, often: DataFrame, t: Fraction) -> DataFrame:
    """(key, n, t): of each row's ``n`` trigrams the rarest, of which alike sets share one."""
    ordered = rows.select(*key, F.size(grams).alias("n"), F.explode(grams).alias("t")).join(often, "t", "left").groupBy(*key, "n").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t"))).alias("o"))  # the trigrams of one name
    return ordered.select(*key, "n", F.explode(F.slice("o", F.lit(1), F.col("n") - _least(F.col("n"), t) + 1)).alias("x")).select(*key, "n", F.col("x.t").alias("t"))


def _known(register: DataFrame) -> DataFrame:
    return register.where("denomination IS NOT NULL").select("siren", trigrams(F.upper("denomination")).alias("h"), words(F.upper("denomination")).alias("w")).distinct()


def _postings(known: DataFrame, often: DataFrame, t: Fraction) -> DataFrame:
    names = known.where(F.size("h") > 0).select("siren", "h").distinct()
    return rarest(names, ["siren", "h"], "h", often, t).select("t", "siren", F.col("n").alias("m")).distinct()


def _equals(known: DataFrame) -> DataFrame:
    return known.where(F.size("h") > 0).select(F.xxhash64(F.array_sort("h")).alias("x"), "siren").distinct()


@dataclass(frozen=True)
class NameIndex:
    often: DataFrame
    postings: DataFrame
    equals: DataFrame
    names: DataFrame
    threshold: Fraction = THRESHOLD

    def _decided(self, near: DataFrame, asked: DataFrame, least: Fraction) -> DataFrame:
        """Of candidates (nom, siren) those whose present names are as similar as ``least``, with the score;
        ``exact`` where one has the very words of ``nom``, which ``asked`` then holds as ``_w``."""
        exact = F.coalesce(F.col("w") == F.col("_w"), F.lit(False)) if "_w" in asked.columns else F.lit(False)
        met = near.join(self.names, "siren").withColumn("_v", F.max("version").over(Window.partitionBy("nom", "siren"))).where("version = _v AND h IS NOT NULL")
        met = met.join(asked, "nom").withColumn("c", F.size(F.array_intersect("g", "h"))).withColumn("u", F.size("g") + F.size("h") - F.col("c"))
        return met.where(F.col("c") * least.denominator >= F.col("u") * least.numerator).groupBy("nom", "siren").agg(
            F.max((F.col("c") / F.col("u")).cast("float")).alias("score"), F.max(exact).alias("exact"))

    @staticmethod
    def _asked(names: DataFrame) -> DataFrame:
        return names.where("nom IS NOT NULL").select("nom").distinct().withColumn("_w", words(normalise_name(F.col("nom")))).withColumn("g", trigrams(F.col("_w"))).where(F.size("g") > 0)

    def similar(self, names: DataFrame) -> DataFrame:
        """(nom, siren, score): companies whose upper-cased name is as similar as the threshold to the normalised ``nom``."""
        t, asked, low, high = self.threshold, self._asked(names), F.least("n", "m"), F.greatest("n", "m")
        near = rarest(asked, ["nom"], "g", self.often, t).join(self.postings, "t").where(low * t.denominator >= high * t.numerator).select("nom", "siren").distinct()
        return self._decided(near, asked, t).drop("exact")

    def best(self, names: DataFrame) -> DataFrame:
        """(nom, siren, score): the most similar companies of each name, all of them where they tie.

        A name with all trigrams of a company's has the greatest score there is, so only names without
        such a company are looked up by similarity.  Of those companies the ones with the very words of the name are meant,
        if there are any: ``000001000`` and ``000010000`` have the same trigrams."""
        asked = self._asked(names)
        same = stored(self._decided(asked.select("nom", F.xxhash64(F.array_sort("g")).alias("x")).join(self.equals, "x").select("nom", "siren").distinct(), asked, Fraction(1)))
        rest = self.similar(names.join(same.select("nom"), "nom", "left_anti"))
        first = rest.withColumn("_r", F.rank().over(Window.partitionBy("nom").orderBy(F.col("score").desc()))).where("_r = 1").drop("_r")
        same = same.withColumn("_e", F.max("exact").over(Window.partitionBy("nom"))).where("exact = _e").drop("exact", "_e")
        return same.unionByName(first)


def of_register(register: DataFrame, threshold=THRESHOLD) -> NameIndex:
    """The index as plain relations of a register (siren, denomination), for one use."""
    t = Fraction(threshold).limit_denominator(1000)
    known = _known(register)
    often = known.select(F.explode("h").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    return NameIndex(often, _postings(known, often, t), _equals(known), known.withColumn("version", F.lit(0).cast("long")), t)


def _table(folder: str, part: str) -> str:
    return f"tl_names_{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}_{part}"


def _write(rows: DataFrame, folder: str, part: str, buckets: int) -> None:
    """Rows are dealt by the key as buckets are, so that a bucket is one file and not one of each task."""
    key = _COLUMNS[part][0]
    rows.repartition(buckets, key).write.mode("append").bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/{part}").saveAsTable(_table(folder, part))


def build(register: DataFrame, folder: str, buckets: int | None = None, threshold=THRESHOLD) -> NameIndex:
    """Write the index of a register to a new ``folder`` that all executors share, and open it."""
    spark, folder = register.sparkSession, folder.rstrip("/")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = Fraction(threshold).limit_denominator(1000)
    known = _known(register)
    _write(known.withColumn("version", F.lit(0).cast("long")), folder, "names", buckets)
    known = spark.table(_table(folder, "names")).drop("version")
    _write(known.select(F.explode("h").alias("t")).groupBy("t").agg(F.count("*").alias("df")), folder, "often", buckets)
    _write(_postings(known, spark.table(_table(folder, "often")), t), folder, "postings", buckets)
    _write(_equals(known), folder, "equals", buckets)
    head = json.dumps({"buckets": buckets, "threshold": [t.numerator, t.denominator]})
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{folder}/index")
    return open_(spark, folder)


def open_(spark: SparkSession, folder: str) -> NameIndex:
    """The index that ``build`` has finished below ``folder``, in any session."""
    folder = folder.rstrip("/")
    head = json.loads(spark.read.text(f"{folder}/index").first()["value"])
    for part, (key, columns) in _COLUMNS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {_table(folder, part)} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {head['buckets']} BUCKETS LOCATION '{folder}/{part}'")
    return NameIndex(*(spark.table(_table(folder, p)) for p in _COLUMNS), Fraction(*head["threshold"]))


def extend(spark: SparkSession, folder: str, changed: DataFrame) -> NameIndex:
    """Take over changes (siren, denomination): all names that a changed company has now, or one null if it is gone.

    Only rows of changed companies are written.  Names come last: a run that stops before them
    leaves candidates without a name, and can be run again.
    """
    folder, index = folder.rstrip("/"), open_(spark, folder)
    buckets = json.loads(spark.read.text(f"{folder}/index").first()["value"])["buckets"]
    version = (index.names.agg(F.max("version")).first()[0] or 0) + 1
    _write(_postings(_known(changed), index.often, index.threshold), folder, "postings", buckets)
    _write(_equals(_known(changed)), folder, "equals", buckets)
    gone = changed.groupBy("siren").agg(F.count("denomination").alias("n")).where("n = 0").select("siren", F.lit(None).cast("array<string>").alias("h"), F.lit(None).cast("string").alias("w"))
    _write(_known(changed).unionByName(gone).withColumn("version", F.lit(version).cast("long")), folder, "names", buckets)
    for part in _COLUMNS:
        spark.catalog.refreshTable(_table(folder, part))
    return open_(spark, folder)
