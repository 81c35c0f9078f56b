"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Targets share the corpus by weight; a source never exceeds ``max_epochs`` times its size,
and what a clamped source leaves is reshared by weight until none is above.  With sources
in order of size/weight the clamped ones form a prefix, so running sums give the level.

A source's ratio of target to size is then taken as whole repetitions of all its documents
and one fractional repetition: documents in seeded hash order, whole, until the rest of
the target is met; those at the last hash are cut.  The last hash is found from sums by
hash bucket and then by hash within one bucket, so no source is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import MANY, materialize, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0
SEED = 42
_BUCKETS = 4096


def targets(sizes: DataFrame, max_epochs: float = MAX_EPOCHS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, null too.
    Empty sources have a target of zero, an empty table no rows; ties in order of sources."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sizes.withColumn("_n", F.row_number().over(order) - 1).withColumn(
        "_w", F.element_at(cycle, (F.col("_n") % len(weights) + 1).cast("int"))
    ).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_n")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    # The level once all poorer sources are clamped; the first source not above its cap sets it.
    held = ranked.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("_w") <= F.col("_cap"))
    first = F.min(F.when(F.col("_free"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), "_n", "_level"))).over(every)
    return held.withColumn("_first", first).select(
        "source", "source_size",
        F.when(F.col("_first").isNull(), F.col("_cap"))
        .otherwise(F.least(F.col("_cap"), F.col("_first._level") * F.col("_w"))).alias("target"),
    )


def plan(sized: DataFrame, max_epochs: float = MAX_EPOCHS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row a source: target, whole repetitions, and where the fractional one ends.

    ``sized`` has (source, size, _hash); a null source is a source.  Without rows, no plans.
    """
    bucket = F.shiftrightunsigned("_hash", 52)
    by_bucket = materialize(sized.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size").alias("_words")), "mix")
    aims = targets(by_bucket.groupBy("source").agg(F.sum("_words").alias("source_size")), max_epochs, weights)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = materialize(
        aims.withColumn("_whole", F.floor(epochs).cast("long"))
        .withColumn("_need", F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size"))), "mix"
    )
    run = lambda *by: Window.partitionBy("source").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    aim = aims.select(F.col("source").alias("_source"), "_need")
    reached = by_bucket.withColumn("_sum", F.sum("_words").over(run("_bucket"))).join(aim, F.col("source").eqNullSafe(F.col("_source")))
    edge = materialize(reached.where((F.col("_sum") > F.col("_need")) & (F.col("_sum") - F.col("_words") <= F.col("_need"))).select(
        "_source", "_bucket", (F.col("_need") - (F.col("_sum") - F.col("_words"))).alias("_left")
    ), "mix")
    inside = _with_source(sized, "source", edge).where(bucket == F.col("_bucket")).groupBy(
        "source", "_hash", "_left"
    ).agg(F.sum("size").alias("_words")).withColumn("_sum", F.sum("_words").over(run(_unsigned("_hash"))))
    last = inside.where((F.col("_sum") > F.col("_left")) & (F.col("_sum") - F.col("_words") <= F.col("_left"))).select(
        F.col("source").alias("_source"), F.col("_hash").alias("_last"),
        ((F.col("_left") - (F.col("_sum") - F.col("_words"))) / F.col("_words")).alias("_share"),
    )
    return materialize(aims.join(last, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        F.col("source").alias("_source"), "source_size", "target", "_whole", "_need", "_last", "_share"
    ), "mix")


def _with_source(rows: DataFrame, column: str, plans: DataFrame, salts: int = 64) -> DataFrame:
    """``rows`` with the row of ``plans`` for their source; rows of no plan go.

    A source may hold a third of all rows.  Plans of up to ``MANY`` sources are broadcast; more
    are joined by (source, salt), each plan once for every salt, so no source is one task.
    """
    same = F.col(column).eqNullSafe(F.col("_source"))
    if plans.count() <= MANY:
        return rows.join(F.broadcast(plans), same)
    salted = plans.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.withColumn("_own", F.pmod("_hash", F.lit(salts).cast("long"))).join(salted, same & (F.col("_own") == F.col("_salt"))).drop("_own", "_salt")


def _unsigned(name: str):
    """Orders a 64-bit hash as unsigned."""
    return F.col(name).bitwiseXOR(F.lit(-(1 << 63)))


RESULTS = ("size", "source_size", "target", "whole", "taken")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    max_epochs: float = MAX_EPOCHS, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED, keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (default: id) with size, source_size, target, whole and taken; a kept
    column named like one of these gives way to it.

    ``whole`` is the number of whole repetitions of the row and ``taken`` the words over all
    repetitions: ``taken - whole * size`` words belong to a last, partial one.  Null texts
    have no words; a null source is a source, last in order; rows with equal ids share a
    hash and are cut alike; an empty table gives an empty result.  Equal inputs give equal
    results under any partitioning.
    """
    keep = [c for c in (keep if keep is not None else [id_col]) if c not in RESULTS]
    inner = {c: f"_keep{i}" for i, c in enumerate(keep)}  # no name clashes with those of the plan
    sized = docs.select(
        *(F.col(c).alias(i) for c, i in inner.items()), F.col(source_col).alias("_src"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("_hash"),
    )
    if keep == [id_col]:
        sized = materialize(sized, "mix")
    plans = plan(sized.select(F.col("_src").alias("source"), "size", "_hash"), max_epochs, weights)
    joined = _with_source(sized, "_src", plans)
    more = (
        F.when(F.col("_last").isNull(), F.lit(0).cast("long"))
        .when(_unsigned("_hash") < _unsigned("_last"), F.col("size"))
        .when(F.col("_hash") == F.col("_last"), F.round(F.col("_share") * F.col("size")).cast("long"))
        .otherwise(F.lit(0).cast("long"))
    )
    return joined.withColumn("_more", more).select(
        *(F.col(i).alias(c) for c, i in inner.items()), "size", "source_size", "target",
        (F.col("_whole") + F.when((F.col("_more") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)).alias("whole"),
        (F.col("_whole") * F.col("size") + F.col("_more")).alias("taken"),
    )


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus itself: rows of ``docs`` repeated, a last partial one cut at the end of
    the last word taken, with its white space as it was.

    Documents without words carry no weight and stay once.
    """
    inner = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # no name clashes with those of the plan
    text = inner[text_col]
    mixed = mix(docs.toDF(*inner.values()), inner[id_col], text, inner[source_col], keep=list(inner.values()))
    part = F.col("taken") - F.col("whole") * F.col("size")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("whole") + F.when(part > 0, 1).otherwise(0)).cast("long")
    rows = mixed.withColumn("_part", part).where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    # Each word with the white space before it: the text up to the end of the last word taken.
    words = F.slice(F.regexp_extract_all(F.col(text), F.lit(rf"([\x20\x09-\x0D]*{WORD})"), 1), F.lit(1), F.col("_part").cast("int"))
    short = (F.col("size") > 0) & (F.col("_copy") > F.col("whole"))
    cut = F.when(short, F.array_join(words, "")).otherwise(F.col(text))
    return rows.select(*((cut if c == text_col else F.col(i)).alias(c) for c, i in inner.items()))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each row of ``documents``; null texts have none."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
