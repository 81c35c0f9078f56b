"""Similar markets by cosine, and the category that the nearest vote for."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.operators.graph import cosine
from tenderlake.sources.adapters import small_batches

#: Neighbours that vote, and the similarity below which there is no vote.
NEIGHBOURS, LEAST = 20, 0.7
#: Texts that are encoded at once.
SLICE = 128


def hashed_trigrams(texts: list[str], size: int = 384) -> list[list[float]]:
    """Unit vectors of hashed character trigrams: an encoder that needs no model."""
    out = []
    for t in texts:
        v = [0.0] * size
        padded = f"  {(t or '').lower()} "
        for i in range(len(padded) - 2):
            v[int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest(), "big") % size] += 1.0
        norm = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / norm for x in v])
    return out


def embed(rows: DataFrame, column: str = "objet", encoder: Callable[[], Callable[[list[str]], list[list[float]]]] = lambda: hashed_trigrams) -> DataFrame:
    """``rows`` with ``objet_embedding``; null texts have none.  ``encoder`` makes the model, once
    for each Python worker, and vectors are made in Arrow batches of bounded rows and bytes; a worker holds
    the numbers of ``SLICE`` texts as Python objects at most."""
    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for texts in batches:
            some, out = texts.dropna().tolist(), []
            for at in range(0, len(some), SLICE):
                out += [np.asarray(v, np.float32) for v in encode(some[at : at + SLICE])]
            made = iter(out)
            yield pd.Series([next(made) if has else None for has in texts.notna()], index=texts.index, dtype=object)

    small_batches(rows.sparkSession)

    return rows.withColumn("objet_embedding", vectors(F.col(column)))


def embed_missing(old: DataFrame, rows: DataFrame, key: str = "uid", **options) -> DataFrame:
    """``old`` (key, objet_embedding) with the rows that it lacks, which alone are encoded."""
    return old.unionByName(embed(rows.join(old.select(key), key, "left_anti"), **options).select(*old.columns))


def similar(markets: DataFrame, reference: list[float], k: int = 10, uid: str | None = None, category: str | None = None, other_category: bool = False) -> DataFrame:
    """(uid, code_cpv, similarite) of the k nearest of (uid, code_cpv, objet_embedding), ties to
    the smaller uid; without ``uid`` itself and, with ``other_category``, without its category
    (a market of no category stays).  One distributed top-k."""
    ref = F.array(*(F.lit(float(x)) for x in reference))
    rows = markets.where(~F.col("uid").eqNullSafe(F.lit(uid))) if uid is not None else markets
    if other_category:
        rows = rows.where(~F.col("code_cpv").eqNullSafe(F.lit(category)))
    return rows.select("uid", "code_cpv", F.round(cosine(F.col("objet_embedding"), ref), 6).alias("similarite")).where("similarite IS NOT NULL").orderBy(
        F.desc("similarite"), "uid").limit(k)


def similar_to(markets: DataFrame, uid: str, k: int = 10, other_category: bool = False) -> DataFrame:
    """The nearest of a market by its uid; none if it is unknown or has no vector."""
    row = markets.where(F.col("uid") == uid).select("code_cpv", "objet_embedding").first()
    if row is None or row["objet_embedding"] is None:
        return markets.select("uid", "code_cpv", F.lit(0.0).alias("similarite")).limit(0)
    return similar(markets, row["objet_embedding"], k, uid, row["code_cpv"], other_category)


def vote(neighbours: DataFrame, least: float = LEAST, key: str | None = None) -> DataFrame:
    """One row, or one for each ``key``: the category of most similarity among the neighbours (uid, code_cpv, similarite),
    ties to the greatest code, with its votes; refused (code null) where the nearest is below ``least``."""
    known = neighbours.where("code_cpv IS NOT NULL")
    keys = [key] if key else []
    by = known.groupBy(*keys, "code_cpv").agg(F.sum("similarite").alias("poids"), F.count("*").alias("voix"), F.max("similarite").alias("meilleure"))
    best = by.groupBy(*keys).agg(F.max(F.struct("poids", "code_cpv", "voix", "meilleure")).alias("m"), F.sum("voix").alias("voisins"), F.max("meilleure").alias("proche"))
    sure = F.col("proche") >= least
    pick: Callable[[str], Column] = lambda c: F.when(sure, F.col(f"m.{c}")).alias(c)
    return best.select(*keys, pick("code_cpv"), pick("voix"), "voisins", F.round("proche", 6).alias("proche"), F.round(F.when(sure, F.col("m.poids")), 4).alias("poids"))
