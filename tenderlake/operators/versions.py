"""Versions, conflicts and updates as joins and windows over immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order (null order spelt by the caller)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_writer_wins(keys: list[str], *stages: DataFrame) -> DataFrame:
    """Insert-or-ignore: rows of earlier stages stand, later ones fill keys that are free."""
    out = None
    for n, stage in enumerate(stages):
        part = stage.withColumn("_stage", F.lit(n))
        out = part if out is None else out.unionByName(part)
    rest = [c for c in out.columns if c not in (*keys, "_stage")]
    return latest(out, keys, F.col("_stage"), *(F.col(c).asc_nulls_last() for c in rest)).drop("_stage")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def fill_from(df: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Null columns take the value of ``other``, of which one row a key counts; others stay."""
    side = other.groupBy(*keys).agg(*(F.min(c).alias(f"_{c}") for c in columns))
    joined = df.join(side, keys, "left")
    return joined.select(*(F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in df.columns))


def blanks_to_null(df: DataFrame) -> DataFrame:
    """Trim every string column; empty strings become null."""
    return df.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def last_of_key(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """One row a key, that ingested last; rows without a key all stay."""
    keyed = latest(df.where(F.col(key).isNotNull()), [key], F.col(sequence).desc_nulls_last())
    return keyed.unionByName(df.where(F.col(key).isNull()))
