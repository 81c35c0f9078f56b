"""Importance resampling against a plain rewrite of its rules."""

import hashlib
import math
import re
import zlib
from collections import Counter
from dataclasses import replace

import pytest

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, weight double, rank string"
ODD = [(1, None), (2, ""), (3, "...!"), (4, "One two, THREE two"), (5, "É é x" * 9), (5, "É é x" * 9), (None, "tail a b"), (7, "w " * 50), (8, "k " * 30),
       (9, " ".join(f"n{i % 97}" for i in range(5000)))]


def plain(docs, target, percent=5, least=20, seed=42):
    def grams(text):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        return len(words), [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    def bucket(g):
        return zlib.crc32(g) % 10_000

    own = [(i, *grams(t)) for i, t in docs]
    s, t = Counter(bucket(g) for *_, gs in own for g in gs), Counter(bucket(g) for x in target for g in grams(x)[1])
    s_all, t_all, out = sum(s.values()), sum(t.values()), []
    for i, words, gs in own:
        w = sum(math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10_000.0) / ((s[b] + 1.0) * (t_all + 10_000.0)))) for b in map(bucket, gs))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(gs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(repr, (r[:5] for r in out)))


def rows(df):
    return sorted(repr(list(r)) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_all_rows_as_the_rules_say(spark):
    from tenderlake.llm import importance

    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("text").collect()]
    assert rows(importance.op13_importance(spark, SMALL)) == plain(docs, target)


@pytest.mark.parametrize("pieces", [{}, {"piece_words": 7, "slice_bytes": 40, "block_words": 60, "part_words": 100}])
def test_odd_rows_in_whole_and_in_pieces(spark, pieces):
    """Null, empty and long texts, repeated rows and ids, a null id, clashing names; pieces change nothing."""
    from tenderlake.llm import importance

    docs = spark.createDataFrame([(i, t, "x", 1.5, "clash") for i, t in ODD], COLUMNS)
    target = spark.createDataFrame([("two three W w",), (None,), ("n1 n2 n3",)], "text string")
    s = replace(importance.Settings(percent=60), **pieces)
    assert rows(importance.resample(docs, target, s)) == plain(ODD, ["two three W w", None, "n1 n2 n3"], percent=60)


def test_empty_tables(spark):
    from tenderlake.llm import importance

    docs = spark.createDataFrame([(i, t, "x", 1.5, "clash") for i, t in ODD], COLUMNS)
    none = docs.limit(0)
    assert importance.resample(none, docs).count() == 0
    assert rows(importance.resample(docs, none, importance.Settings(percent=100))) == plain(ODD, [], percent=100)


def test_equal_scores_go_to_the_smaller_id(spark):
    from pyspark.sql import functions as F

    from tenderlake.llm import importance

    held = spark.range(100).select(F.lit(7).alias("x"), (99 - F.col("id")).alias("doc_id"))
    got = importance.ranked(held, [F.col("x").desc(), F.col("doc_id")], "n").collect()
    assert sorted((r["doc_id"], r["n"]) for r in got) == [(i, i + 1) for i in range(100)]


def test_a_word_without_end_is_one_word():
    from tenderlake.llm import importance

    s = importance.Settings(piece_words=3, slice_bytes=10)
    text = b"a" * 57 + b" b c d  e f g h i " + b"x" * 31
    got = [w for own, _ in importance.pieces(text, s) for w in own]
    assert got == text.split()
    assert all(len(after) <= 2 for _, after in importance.pieces(text, s))
