"""Sources and normalisation of nested notices."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def decp(spark: SparkSession, path: str, columns: list[str], siret: str | None = None, cpv_prefix: str | None = None) -> DataFrame:
    """A projection with an equality and a prefix predicate, both pushed to the Parquet scan."""
    df = spark.read.parquet(path)
    if siret is not None:
        df = df.where(F.col("acheteur_id") == siret)
    if cpv_prefix is not None:
        df = df.where(F.col("codeCPV").startswith(cpv_prefix))
    return df.select(*columns)


def of_buyer(df: DataFrame, siret: str, limit: int = 50) -> DataFrame:
    """The newest markets of a buyer, ``limit`` at most, in a total order."""
    return df.where(F.col("acheteur_id") == siret).orderBy(F.col("dateNotification").desc_nulls_last(), "uid").limit(limit)


def in_window(df: DataFrame, today: Column, months: int = 36) -> DataFrame:
    """Current rows published within ``months`` of ``today``."""
    return df.where(F.col("donneesActuelles") & (F.to_date("datePublicationDonnees") >= F.add_months(today, -months)))


def text_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header and quoted line ends, every column a string, read by several tasks.

    Lines are read in blocks of the files.  A line begins a record if the quotes before it in its file are
    even in number: counts within a block are added to those of the blocks before, of which there is
    one row each.  The lines of a record are put together, across blocks too, and parsed once.  Files
    that Spark can't split (compressed ones) are one block each.  All files have the header of the first.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    lines = lines.withColumn("q", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    block = Window.partitionBy("f", "b")
    scanned = lines.withColumn("own", F.coalesce(F.sum("q").over(block.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    borders = lines.groupBy("f", "b").agg(F.sum("q").alias("q")).select(
        "f", "b", F.coalesce(F.sum("q").over(Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("past"))
    marked = scanned.join(borders, ["f", "b"]).withColumn("begins", (F.col("own") + F.col("past")) % 2 == 0)
    # The record of a line is the last that has begun in its block, else the last of the blocks before.
    marked = marked.withColumn("r", F.last(F.when(F.col("begins"), F.struct("b", "i")), ignorenulls=True).over(block.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    last = marked.groupBy("f", "b").agg(F.max(F.when(F.col("begins"), F.struct("b", "i"))).alias("z")).select(
        "f", "b", F.last("z", ignorenulls=True).over(Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("open"))
    marked = marked.join(last, ["f", "b"]).withColumn("r", F.coalesce("r", "open"))
    records = marked.groupBy("f", "r").agg(F.array_sort(F.collect_list(F.struct("b", "i", "value"))).alias("l")).select(
        "f", "r", F.regexp_replace(F.array_join(F.transform("l", lambda x: x["value"]), "\n"), "\r\\z", "").alias("value"))
    head = spark.read.text(path, lineSep="\n").where("_metadata.file_block_start = 0").first()
    if head is None:
        return spark.createDataFrame([], "value string").select()
    names = next(csv.reader([head["value"].lstrip("\ufeff").rstrip("\r")]))
    first = records.groupBy("f").agg(F.min("r").alias("h"))
    body = records.join(first, "f").where(F.col("r") != F.col("h")).where("value <> ''")
    schema = ", ".join(f"`{n}` string" for n in names)
    return body.select(F.from_csv("value", schema, {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}).alias("x")).select("x.*")


def multilingual(value: Column) -> Column:
    """A string, or a JSON map of language to string or list: French first, else the first
    language that has one; null if none has."""
    one = lambda v: F.when(v.startswith("["), F.get(F.from_json(v, "array<string>"), 0)).otherwise(v)
    said = F.filter(
        F.transform(F.map_entries(F.from_json(value, "map<string,string>")), lambda e: F.struct(e["key"].alias("k"), one(e["value"]).alias("v"))),
        lambda x: x["v"].isNotNull() & (x["v"] != ""),
    )
    french = F.get(F.filter(said, lambda x: x["k"] == "fra"), 0)["v"]
    return F.when(value.startswith("{"), F.coalesce(french, F.get(said, 0)["v"])).otherwise(F.nullif(value, F.lit("")))


def first_date(value: Column) -> Column:
    return F.when(F.length(value) >= 10, F.substring(value, 1, 10))


def scoped_code(codes: Column, prefix: str | None) -> Column:
    """The first code with the prefix, else the first code."""
    first = F.get(codes, 0)
    return first if prefix is None else F.coalesce(F.get(F.filter(codes, lambda c: c.startswith(prefix)), 0), first)


def subject_codes(subject: Column) -> Column:
    """Principal categories of the JSON of a notice's subject, whose ``CPV`` is an object or a list; none if there are none."""
    told = F.get_json_object(subject, "$.CPV")
    many = F.when(told.startswith("["), told).otherwise(F.concat(F.lit("["), told, F.lit("]")))
    listed = F.from_json(many, "array<struct<PRINCIPAL:string>>")
    return F.coalesce(F.filter(F.transform(listed, lambda x: x["PRINCIPAL"]), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def category_codes(notice: Column) -> Column:
    """Principal categories of a JSON notice, by its ``OBJET``; null if it is unreadable."""
    one = F.array(F.from_json(notice, "OBJET string, _illisible string", {"columnNameOfCorruptRecord": "_illisible"}))
    return F.get(F.transform(one, lambda x: F.when(x.isNotNull() & x["_illisible"].isNull(), subject_codes(x["OBJET"]))), 0)


def tolerant_date(value: Column) -> Column:
    """The day of an ISO date or instant; null where there is none."""
    return F.substring(F.trim(value), 1, 10).try_cast("date")


def plain_html(html: Column) -> Column:
    """Without tags, three entities decoded."""
    x = F.regexp_replace(html, "<[^>]*>", "")
    for a, b in (("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(x)
