"""Language of texts: script ranges narrow the candidates, Viterbi labels spans.

A word's scores are log-likelihoods of its byte trigrams and of the whole word under each
language, cut off at a floor.  Script ranges leave only languages that use the word's
script.  Viterbi with a switching penalty then labels every word; runs of one label are the
spans of a mixed text, and the label of most letters is the language of the document.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import MANY, materialize, pack, small_batches, table, trim, trimmed_batches, unpack

_WORD = re.compile(r"[^\W\d_]+").findall
#: First code points of script ranges, ascending: Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Indic, Thai,
#: Georgian, Hangul, Latin, Greek, other, Kana, Hangul, Han, Hangul, other.
_RANGES = np.array([0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0xE00, 0x10A0, 0x1100, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3130, 0x3400, 0xAC00, 0xD7B0])
_SCRIPT = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 1, 10, 11, 9, 12, 9, 10])
_SCRIPTS = 13


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the documents that training reads for each language (a bound of the
    fit alone; every row is labelled)."""

    bits: int = 16
    sample: int = 1500
    floor: float = -8.0
    penalty: float = 12.0
    share: float = 0.005
    seed: int = 42


def words_of(text: str | None) -> list[str]:
    return _WORD(text.lower()) if text else []


def _columns(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed trigrams of all words, first of each word, hashed whole words)."""
    raw = [w.encode() for w in words]
    flat = np.frombuffer(b" " + b" ".join(raw) + b"  ", np.uint8).astype(np.uint32)
    tri = ((flat[:-2] * np.uint32(65599) + flat[1:-1]) * np.uint32(65599) + flat[2:]) * np.uint32(2654435761) >> np.uint32(32 - bits)
    lens = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    first = np.cumsum(lens) - lens
    whole = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)) * np.uint32(2654435761) >> np.uint32(32 - bits)
    return tri.astype(np.int64), first, whole.astype(np.int64)


def _scripts(words: list[str]) -> np.ndarray:
    return _SCRIPT[np.searchsorted(_RANGES, np.fromiter((ord(w[0]) for w in words), np.int64, len(words)), side="right") - 1]


@dataclass
class Model:
    langs: list[str]
    tri: np.ndarray  # [2 ** bits, languages]
    whole: np.ndarray
    scripts: np.ndarray  # [scripts, languages]: whether the language uses it

    def scores(self, words: list[str], s: Settings) -> np.ndarray:
        tri, first, whole = _columns(words, s.bits)
        got = np.add.reduceat(self.tri[tri], first, axis=0) + self.whole[whole]
        allowed = self.scripts[_scripts(words)]
        some = allowed.any(axis=1, keepdims=True)
        got = np.where(allowed, got, -np.inf)
        got = np.maximum(got - np.where(some, got.max(axis=1, keepdims=True), 0.0), s.floor)
        return np.where(some, got, 0.0)


def fit(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts from labelled rows; rows without text or language are not used, repeated rows
    count as often as they come.  An empty table gives a model without languages."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    rates = src.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(s.sample)) / F.count("*")).alias("rate"))
    pick = F.pmod(F.xxhash64(F.lit(s.seed), "id"), F.lit(1_000_000)) < F.col("rate") * 1_000_000
    rates = materialize(rates, "rates")
    if rates.count() <= MANY:  # a row a language: texts stay where they are
        rates = F.broadcast(rates)
    chosen = src.join(rates, "lang").where(pick).select("lang", "text")
    n = 1 << s.bits

    def counts(batches):
        got: dict = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                if words:
                    tri, _, whole = _columns(words, s.bits)
                    t, w, c = got.setdefault(lang, (np.zeros(n), np.zeros(n), np.zeros(_SCRIPTS)))
                    t += np.bincount(tri, minlength=n)
                    w += np.bincount(whole, minlength=n)
                    c += np.bincount(_scripts(words), minlength=_SCRIPTS)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got)), pa.array([pack(x) for x in got.values()], pa.binary())], names=["lang", "n"])

    def add(group: pa.Table) -> pa.Table:
        total = None
        for blob in group.column("n").to_pylist():
            x = unpack(blob)
            total = x if total is None else tuple(a + b for a, b in zip(total, x))
        return pa.table({"lang": group.column("lang")[:1], "n": pa.array([pack(total)], pa.binary())})

    rows = chosen.mapInArrow(trimmed_batches(counts), "lang string, n binary").groupBy("lang").applyInArrow(add, "lang string, n binary").collect()
    got = sorted((r["lang"], unpack(r["n"])) for r in rows)
    if not got:
        return Model([], np.zeros((n, 0), np.float32), np.zeros((n, 0), np.float32), np.zeros((_SCRIPTS, 0), bool))
    logs = lambda i: np.stack([np.log((g[i] + 0.1) / (g[i].sum() + 0.1 * n)) for _, g in got], axis=1).astype(np.float32)
    scripts = np.stack([g[2] / g[2].sum() >= s.share for _, g in got], axis=1)
    return Model([k for k, _ in got], logs(0), logs(1), scripts)


def viterbi(e: np.ndarray, penalty: float) -> np.ndarray:
    """The best labels for word scores ``e`` where each change of label costs ``penalty``."""
    total = e.sum(axis=0)
    best = int(total.argmax())
    # A stretch of another label gains at most the largest rise of these sums; k stretches that
    # leave out the best label cost only k - 1 changes, so twice the rise must not exceed one.
    gain = np.cumsum(np.vstack([np.zeros(e.shape[1]), e - e[:, best : best + 1]]), axis=0)
    if (gain - np.minimum.accumulate(gain, axis=0)).max() * 2 <= penalty:
        return np.full(len(e), best)
    v, back = e[0].tolist(), []
    for row in e[1:].tolist():
        top = max(range(len(v)), key=v.__getitem__)
        jump = v[top] - penalty
        back.append([i if x >= jump else top for i, x in enumerate(v)])
        v = [max(x, jump) + y for x, y in zip(v, row)]
    at = max(range(len(v)), key=v.__getitem__)
    path = [at]
    for b in reversed(back):
        at = b[at]
        path.append(at)
    return np.array(path[::-1])


def label(docs: DataFrame, model: Model, s: Settings = Settings(), text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` with lang_pred, score and spans (words ``start`` to ``stop`` of a language).

    ``und`` where a text is null or has no letter, or no language was learnt.  The score is
    the share of letters that the predicted language labels.  Input columns named like the
    results give way to them.  Every row is labelled by itself: repeated rows have equal
    results, an empty table an empty one; of equal scores the first language by name counts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    mine = ("lang_pred", "score", "spans")
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in mine]
    sent = spark.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        m = sent.value
        for b in batches:
            numbers: dict = defaultdict(count().__next__)
            docs_ = [words_of(t) for t in b.column(b.num_columns - 1).to_pylist()]
            codes = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in docs_]
            words = list(numbers)
            known = m.scores(words, s) if words and m.langs else None
            size = np.array([len(w) for w in words])
            preds, scores, spans = [], [], []
            for w, c in zip(docs_, codes):
                if known is None or not any(x.isalpha() for y in w for x in y):
                    preds.append("und")
                    scores.append(0.0)
                    spans.append([])
                    continue
                path = viterbi(known[c], s.penalty)
                mass = np.bincount(path, size[c], len(m.langs))
                top = int(mass.argmax())
                preds.append(m.langs[top])
                scores.append(float(mass[top] / mass.sum()))
                cut = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
                spans.append([{"start": i, "stop": j, "lang": m.langs[path[i]]} for i, j in zip(cut, cut[1:])])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span)], names=[*keep, *mine]
            )
        trim()

    src = docs.select(*keep, F.col(text_col).cast("string").alias("_labelled"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{schema}lang_pred string, score double, spans array<struct<start:int,stop:int,lang:string>>")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each row of ``documents``, learnt from rows that are not held out; null
    texts and texts without letters are ``und``, a null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return label(docs, fit(docs.where(~held)), keep=["doc_id"]).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
