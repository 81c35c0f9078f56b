"""Quality by supervised subword embeddings: averaged n-gram vectors and a softmax, trained by numpy.

A document's features are its words, the byte n-grams of each word between marks of its ends, and
pairs of neighbouring words (a word that follows itself is one feature, whatever the word), hashed to
``2 ** bits`` rows of vectors.  A document is the mean of its features' vectors.  As the output layer
is linear, scoring tasks get the product of vectors and output weights: a few numbers a row, of a size
that the settings bound.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pack, small_batches, table, trimmed_batches, unpack

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: ASCII white space tells words apart.
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows that training reads, and ``sample_bytes`` what it reads of each, in pieces
    spread over the text (documented bounds of the fit alone; whole texts of all rows are scored)."""

    bits: int = 18
    size: int = 12
    grams: tuple[int, ...] = (2, 3, 4)
    epochs: int = 4
    rate: float = 0.6
    sample: int = 6_000
    sample_bytes: int = 16 << 10
    sample_pieces: int = 4
    threshold: float = 0.5
    seed: int = 42
    chunk_words: int = 1 << 20


def _rows(keys: np.ndarray, bits: int) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(31))) * _MIX
    return ((keys ^ (keys >> np.uint64(29))) * _MIX >> np.uint64(64 - bits)).astype(np.int64)


def word_rows(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(word, row) of the features of each word: itself, and its n-grams between marks."""
    hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    of, keys = [np.arange(len(words))], [hashes | np.uint64(1 << 62)]
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(flat))
    key = np.zeros(len(flat), np.uint64)
    for n in range(1, max(s.grams) + 1):
        key = key[: len(flat) - n + 1] | flat[n - 1 :] << np.uint64(8 * (n - 1))
        if n in s.grams:
            at = np.flatnonzero(left[: len(key)] >= n)
            of.append(word[at])
            keys.append(key[at] | np.uint64(n << 56))
    return np.concatenate(of), _rows(np.concatenate(keys), s.bits)


def pair_rows(words: list[bytes], a: np.ndarray, b: np.ndarray, s: Settings) -> np.ndarray:
    """The rows of pairs of numbered words; a word and itself share one row."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    key = (h[a] << np.uint64(29)) ^ h[b] | np.uint64(1 << 63)
    return _rows(np.where(a == b, np.uint64(1 << 61), key), s.bits)


def chunks(texts: list[bytes | None], s: Settings):
    """(words, codes, document, own) of runs of words of consecutive texts; a first word that is not own was in the run before."""

    def close():
        sizes = [len(x) for x in codes]
        own = np.ones(sum(sizes), bool)
        own[0] = not again
        return list(numbers), np.concatenate(codes), np.repeat(docs, sizes), own

    fresh = lambda: (defaultdict(count().__next__), [], [], 0, False)
    numbers, codes, docs, held, again = fresh()
    for k, text in enumerate(texts):
        text, at, last = text or b"", 0, None
        while at < len(text):
            end = at + 8 * s.chunk_words
            if end < len(text) and (cut := _BLANK.search(text, end)):
                end = cut.start()
            else:
                end = len(text)
            words, at = text[at:end].split(), end
            if words and codes and held + len(words) > s.chunk_words:
                yield close()
                numbers, codes, docs, held, again = fresh()
                if last is not None:
                    codes, docs, held, again = [np.array([numbers[last]], np.int64)], [k], 1, True
            if words:
                codes.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                docs.append(k)
                held += len(words)
                last = words[-1]
    if codes:
        yield close()


def features(texts: list[bytes | None], s: Settings):
    """(words, codes and documents of words, rows and documents of pairs) of each run."""
    for words, codes, docs, own in chunks(texts, s):
        pair = np.flatnonzero((docs[1:] == docs[:-1]) & own[1:])
        yield words, codes[own], docs[own], pair_rows(words, codes[pair], codes[pair + 1], s), docs[pair]


def logits(texts: list[bytes | None], told: np.ndarray, bias: np.ndarray, s: Settings) -> np.ndarray:
    """The output layer's sums of each text; ``told`` has a row of them for each feature row."""
    out, many = np.zeros((len(texts), len(bias))), np.zeros(len(texts))
    for words, codes, docs, pairs, pair_docs in features(texts, s):
        of, rows = word_rows(words, s)
        n = np.bincount(of, minlength=len(words))
        many += np.bincount(docs, weights=n[codes], minlength=len(texts)) + np.bincount(pair_docs, minlength=len(texts))
        for c in np.flatnonzero(told.any(axis=0)).tolist():
            by_word = np.bincount(of, weights=told[rows, c], minlength=len(words))
            out[:, c] += np.bincount(docs, weights=by_word[codes], minlength=len(texts))
            out[:, c] += np.bincount(pair_docs, weights=told[pairs, c], minlength=len(texts))
    return out / np.maximum(many, 1)[:, None] + bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def bag(text: bytes | None, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(rows, shares) of one document's features."""
    every = np.zeros(0, np.int64)
    for words, codes, _, pairs, _ in features([text], s):
        of, rows = word_rows(words, s)
        n = np.bincount(of, minlength=len(words))
        order = np.argsort(of, kind="stable")
        starts = np.cumsum(n) - n
        own = n[codes]
        at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(starts[codes], own)
        every = np.concatenate([every, rows[order][at], pairs])
    rows, n = np.unique(every, return_counts=True)
    return rows.astype(np.uint32), (n / max(1, n.sum())).astype(np.float32)


def train(data: list[tuple[int, np.ndarray, np.ndarray]], classes: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(output sums of each feature row, bias) by stochastic gradient descent over (class, rows, shares).

    The rate falls to zero in equal steps, and the order of rows is a seeded shuffle of each epoch.
    """
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.size, 1 / s.size, (1 << s.bits, s.size)).astype(np.float32)
    weights, bias = np.zeros((classes, s.size), np.float32), np.zeros(classes, np.float32)
    steps, done = max(1, s.epochs * len(data)), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(data)):
            y, rows, share = data[i]
            rate = s.rate * (1 - done / steps)
            done += 1
            own = vectors[rows]
            hidden = share @ own
            g = softmax(weights @ hidden + bias)
            g[y] -= 1
            back = g @ weights
            weights -= rate * np.outer(g, hidden)
            bias -= 0.1 * rate * g
            # Shares of a long text are small: its rows move by 64 times their share, and by a whole step at most.
            vectors[rows] = own - rate * np.outer(np.minimum(share * 64, 1), back)
    return vectors @ weights.T, bias


def _sampled(text: bytes | None, s: Settings) -> bytes:
    """A text, or ``sample_pieces`` pieces spread over it that have ``sample_bytes`` together."""
    text = text or b""
    if len(text) <= s.sample_bytes:
        return text
    one = s.sample_bytes // s.sample_pieces
    return b" ".join(text[i : i + one] for i in np.linspace(0, len(text) - one, s.sample_pieces).astype(int).tolist())


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """The model from rows of ``docs`` that ``labels`` marks 0 or 1.

    Labels without id or mark are not used; of repeated ids the largest mark counts.  Where more than
    ``s.sample`` are marked, a seeded hash of the id picks that many on average.  Rows of ``docs`` that
    repeat an id are all read.  Without marked rows every score is 0.5.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(
        F.max(label_col).cast("int").alias("_y"))
    share = min(1.0, s.sample / max(1, marked.count()))
    order = F.xxhash64(F.lit(s.seed), F.col("_id"))
    marked = marked.where(F.pmod(order, F.lit(1_000_000)) < int(share * 1_000_000))
    chosen = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text")).join(
        F.broadcast(marked), "_id")  # no more than about s.sample rows

    def bags(batches):
        for b in batches:
            rows = [bag(_sampled(t, s), s) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([r.tobytes() for r, _ in rows], pa.binary()), pa.array([x.tobytes() for _, x in rows], pa.binary())],
                names=["_id", "_y", "_rows", "_share"])

    def learn(batches):
        data = [(y, np.frombuffer(r, np.uint32), np.frombuffer(x, np.float32)) for b in batches for y, r, x in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
        told, bias = train(data, 2, s)
        # Only differences of the two sums count.
        yield pa.RecordBatch.from_arrays([pa.array([pack(((told[:, 1] - told[:, 0]).astype(np.float16), bias))], pa.binary())], names=["m"])

    model = (
        chosen.select("_id", "_text", "_y").mapInArrow(trimmed_batches(bags), "_id long, _y int, _rows binary, _share binary")
        .repartition(1).sortWithinPartitions(order, "_id", "_rows", "_share").mapInArrow(trimmed_batches(learn), "m binary").collect()
    )
    if not model:
        return np.zeros((1 << s.bits, 2), np.float32), np.zeros(2, np.float32)
    edge, bias = unpack(model[0]["m"])
    return np.stack([np.zeros(len(edge), np.float32), edge.astype(np.float32)], axis=1), bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], s: Settings = Settings(), text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) with ``score`` (0 to 1, of label 1) and ``predicted``.

    Whole texts are scored, a row at a time whatever its copies; a null or empty text, or one of blanks,
    has the score of the bias.  Input columns named like the two results give way to them; an empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("score", "predicted")]
    told, bias = model
    sent = spark.sparkContext.broadcast(pack((told.astype(np.float32), bias)))

    def run(batches):
        told, bias = unpack(sent.value)
        for b in batches:
            p = softmax(logits(b.column(b.num_columns - 1).to_pylist(), told, bias, s))[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(p, pa.float64()), pa.array((p >= s.threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    src = docs.select(*keep, F.col(text_col).cast("string").cast("binary").alias("_scored"))
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), "score double", "predicted int"]
    return src.mapInArrow(trimmed_batches(run), ", ".join(fields))


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` scored by a model of the labelled rows that are not held out; a null id is not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
