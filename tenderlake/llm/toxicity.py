"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, word pairs and pairs with one word between, hashed to
``2 ** bits`` columns.  Per-coordinate learning rates and an L1 term leave few non-zero
weights; the bounded weight vector is broadcast to the scoring tasks.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pack, small_batches, table, trimmed_batches, unpack

#: ASCII characters that are no letter or digit part words.
_PART = bytes(i if chr(i).isalnum() or i >= 128 else 32 for i in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows that training reads (a documented bound of the
    fit alone; every row is scored).  Columns of fewer than ``least`` of them are not learnt."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    epochs: int = 8
    least: int = 5
    sample: int = 12_000
    threshold: float = 0.7
    seed: int = 42


def features(text: str | None, bits: int) -> np.ndarray:
    """Distinct columns of a whole text, ascending."""
    words = (text or "").lower().encode().translate(_PART).split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    one = h * _MIX
    two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * np.uint64(3) + one[1:]
    gap = (one[:-2] ^ (one[:-2] >> np.uint64(31))) * np.uint64(5) + one[2:]
    every = np.concatenate([one, two * _MIX, gap * _MIX])
    every ^= every >> np.uint64(32)
    return np.unique((every * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; column ``2 ** bits`` is the bias, free of L1."""

    def __init__(self, s: Settings):
        self.s = s
        self.z = np.zeros((1 << s.bits) + 1)
        self.n = np.zeros((1 << s.bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        s, z = self.s, self.z[at]
        l1 = np.where(at == 1 << s.bits, 0.0, s.l1)
        w = -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> np.ndarray:
    """Weights (float32, bias last) from rows of ``docs`` that ``labels`` marks 0 or 1.

    Labels without id or mark are not used; of repeated ids the largest mark counts.  Where
    more than ``s.sample`` are marked, a seeded hash of the id picks that many on average.
    Without marked rows every score is that of a zero vector.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).cast("long").alias("_id")
    ).agg(F.max(label_col).cast("int").alias("_y"))
    share = min(1.0, s.sample / max(1, marked.count()))
    order = F.xxhash64(F.lit(s.seed), F.col("_id"))
    marked = marked.where(F.pmod(order, F.lit(1_000_000)) < int(share * 1_000_000))
    chosen = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(
        F.broadcast(marked), "_id"  # no more than about s.sample rows
    )

    def columns(batches):
        for b in batches:
            rows = [np.asarray(features(t, s.bits), np.uint32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.binary())], names=["_id", "_y", "_x"])

    def train(batches):
        data = [(y, np.frombuffer(x, np.uint32)) for b in batches for y, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        rows = np.zeros((1 << s.bits) + 1, np.int32)
        for _, x in data:
            rows[x] += 1
        bias = np.array([1 << s.bits], np.int32)
        data = [(y, np.concatenate([x[rows[x] >= s.least].astype(np.int32), bias])) for y, x in data]
        model = Ftrl(s)
        for _ in range(s.epochs):
            for y, x in data:
                model.learn(x, y)
        w = model.weights(np.arange(len(model.z))).astype(np.float32)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([pack((at.astype(np.uint32), w[at]))], pa.binary())], names=["w"])

    rows = (
        chosen.select("_id", "_text", "_y").mapInArrow(trimmed_batches(columns), "_id long, _y int, _x binary")
        .repartition(1).sortWithinPartitions(order, "_id", "_x").mapInArrow(trimmed_batches(train), "w binary").collect()
    )
    w = np.zeros((1 << s.bits) + 1, np.float32)
    for row in rows:
        at, values = unpack(row["w"])
        w[at] = values
    return w


def score(docs: DataFrame, weights: np.ndarray, s: Settings = Settings(), text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) with ``score`` (0 to 1) and ``predicted``.

    Whole texts are scored; a null or empty text has the score of the bias.  Input columns
    named like the two results give way to them.  Repeated rows are scored each by itself; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("score", "predicted")]
    at = np.flatnonzero(weights)
    sent = spark.sparkContext.broadcast(pack((at.astype(np.uint32), weights[at])))

    def run(batches):
        where, values = unpack(sent.value)
        w = np.zeros((1 << s.bits) + 1)
        w[where] = values
        for b in batches:
            sums = np.array([w[features(t, s.bits)].sum() for t in b.column(b.num_columns - 1).to_pylist()]) + w[-1]
            p = 1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(p, pa.float64()), pa.array((p >= s.threshold).astype(np.int32))],
                names=[*keep, "score", "predicted"],
            )

    src = docs.select(*keep, F.col(text_col).cast("string").alias("_scored"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]]
    return src.mapInArrow(trimmed_batches(run), ", ".join([*kept, "score double", "predicted int"]))


def _held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each row of ``documents`` by the rows of ``labels`` that are not held out; a null
    id is not held out, a null or empty text has the score of the bias."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = fit(docs, labels.where(~_held_out()))
    return score(docs, weights, keep=["doc_id"]).select(
        "doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", "predicted"
    )
