"""Importance resampling towards a target distribution over hashed word n-grams.

Every distinct n-gram of the corpus and of the target is counted, hashed once and summed into its
bucket; a bucket's gain says how much likelier the target holds it, and the gains return to the
n-grams of each document.  Documents are drawn by their summed gains plus seeded Gumbel noise, the
largest first.

Exchanges are packed.  A block of documents sends each distinct run of three words once, with its
count, to a part that its words name; a row for a part holds the words that it uses once, and the runs
as sorted numbers of these.  The part joins the rows of all blocks into one dictionary of the n-grams
that the runs begin with, and answers every block with the buckets of what it sent.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import (
    materialize, materialize_bucketed, materialize_freed, pack, partitions, planes, small_batches, table, trim, trimmed, trimmed_batches,
    trimmed_pair, unpack, unplanes,
)

#: A-Z become small, and ASCII that is no digit or letter separates words.
_WORDS = bytes((i | 32) if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """``block_words`` and ``part_words`` bound what a task holds of one block or of one part of the dictionary;
    a longer text is dealt over several blocks, in pieces that know the two words after them."""

    buckets: int = 10_000
    percent: int = 5
    least_words: int = 20
    seed: int = 42
    block_words: int = 1_500_000
    part_words: int = 1_500_000
    piece_words: int = 1 << 18
    slice_bytes: int = 4 << 20


def _slices(text: bytes, size: int):
    """Lists of the words of consecutive slices of a text."""
    text = text.translate(_WORDS)
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            if cut < 0:
                cut = text.find(b" ", end)
            end = len(text) if cut < 0 else cut + 1
        yield text[at:end].split()
        at = end


def pieces(text: bytes, s: Settings):
    """(own words, up to two words that follow them); the own words of all pieces are those of the text."""
    if len(text) <= s.slice_bytes:
        words = text.translate(_WORDS).split()
        if len(words) <= s.piece_words + 2:
            yield words, []
            return
        rest, more = words, iter(())
    else:
        rest, more = [], _slices(text, s.slice_bytes)
    while True:
        while len(rest) >= s.piece_words + 2:
            yield rest[: s.piece_words], rest[s.piece_words : s.piece_words + 2]
            rest = rest[s.piece_words :]
        if (words := next(more, None)) is None:
            yield rest, []
            return
        rest = rest + words


def _to_blocks(batches, s: Settings):
    """Rows (target, block, words, payload) of columns (id, target, text)."""

    def flush(block, target, ids, home, own, lens, codes, numbers):
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        words = list(numbers)
        often = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")  # small numbers for frequent words
        number = np.empty(len(words), np.uint32)
        number[often] = np.arange(len(words), dtype=np.uint32)
        words = [words[i] for i in often.tolist()]
        sizes = np.array([len(w) for w in words], np.uint32)
        blob = pack((ids, np.array(home, np.int64).reshape(-1, 2), np.array(own, np.int64), np.array(lens, np.int64),
                     planes(number[flat]), planes(sizes), b"".join(words)))
        return pa.RecordBatch.from_arrays(
            [pa.array([target], pa.int32()), pa.array([block]), pa.array([len(flat)], pa.int64()), pa.array([blob], pa.binary())],
            names=["target", "block", "words", "payload"],
        )

    def fresh(target):
        return uuid.uuid4().int >> 65, target, [], [], [], [], [], defaultdict(count().__next__)

    now, size = None, 0
    for b in batches:
        for doc, target, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            first = None
            for words, after in pieces(text or b"", s):
                if now is None or now[1] != target:
                    if now is not None:
                        yield flush(*now)
                    now, size = fresh(target), 0
                block, _, ids, home, own, lens, codes, numbers = now
                first = first or (block, len(ids))
                ids.append(doc)
                home.append(first)
                own.append(len(words))
                lens.append(len(words) + len(after))
                codes.append(np.fromiter(map(numbers.__getitem__, words + after), np.uint32, lens[-1]))
                size += lens[-1] + 16
                if size >= s.block_words:
                    yield flush(*now)
                    now, size = None, 0
                    trim()
    if now is not None:
        yield flush(*now)


def _triples(a: np.ndarray, b: np.ndarray, c: np.ndarray, v: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct (a, b, c) below ``v``, ascending, and the number of each row's."""
    if v < 2_000_000:  # three numbers fit one of 63 bits
        key = (a * v + b) * v + c
        rest = lambda k: [k // v // v, k // v % v, k % v]
    else:
        pairs, pair = np.unique(a * v + b, return_inverse=True)
        key = pair.reshape(-1) * v + c
        rest = lambda k: [pairs[k // v] // v, pairs[k // v] % v, k % v]
    order = np.argsort(key)
    own = key[order]
    new = np.diff(own, prepend=-1) != 0
    of = np.empty(len(key), np.int64)
    of[order] = np.cumsum(new) - 1
    return rest(own[new]), of


def _starts(a: np.ndarray, b: np.ndarray, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where, in rows ordered by (part, a, b), another first word and another pair begin."""
    one = np.diff(a, prepend=-1) != 0
    if part is not None:
        one |= np.diff(part.astype(np.int64), prepend=-1) != 0
    return one, one | (np.diff(b, prepend=-1) != 0)


class Block:
    """A block's distinct runs of up to three words (0 stands for no word), in the order of the rows that it sends.

    A run stands for the n-grams that start with it: its first word, its first two and all three.  Runs
    go to parts by their first word, those of a frequent first word by two, and those of a frequent pair
    by all three, so that no part gets more than a few hundredths of a block for one word.
    """

    def __init__(self, payload: bytes, parts: int):
        self.ids, self.home, self.own, self.lens, flat, sizes, joined = unpack(payload)
        flat, self.sizes = unplanes(flat).astype(np.int64) + 1, unplanes(sizes).astype(np.int64)
        starts = np.cumsum(self.lens) - self.lens
        left = np.repeat(starts + self.lens, self.lens) - np.arange(len(flat))  # words from here to the end of the piece
        mine = np.flatnonzero(np.arange(len(flat)) < np.repeat(starts + self.own, self.lens))
        follow, left = np.concatenate([flat, [0, 0]]), left[mine]
        a, b, c = flat[mine], np.where(left > 1, follow[mine + 1], 0), np.where(left > 2, follow[mine + 2], 0)
        self.grams = 1 + (b > 0) + (c > 0)
        (a, b, c), self.of = _triples(a, b, c, len(self.sizes) + 1)
        self.many = np.bincount(self.of, minlength=len(a))
        ends = np.cumsum(self.sizes)
        self.words = [joined[e - z : e] for e, z in zip(ends.tolist(), self.sizes.tolist())]
        h = np.fromiter(map(zlib.crc32, self.words), np.uint64, len(self.words)) + np.uint64(1)
        h, most = np.concatenate([[np.uint64(0)], h]), max(64, len(mine) >> 9)
        one, two = _starts(a, b)
        mixed = self._mix(h[a])
        for begin, word in ((one, h[b]), (two, h[c])):
            at = np.flatnonzero(begin)
            often = np.repeat(np.add.reduceat(self.many, at) if len(at) else at, np.diff(np.append(at, len(a)))) > most
            mixed = np.where(often, self._mix(mixed + word), mixed)
        part = ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.uint32)
        self.order = np.argsort(part, kind="stable")
        self.a, self.b, self.c, self.part = a[self.order], b[self.order], c[self.order], part[self.order]

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(29))) * _MIX
        return (x ^ (x >> np.uint64(32))) * _MIX

    def rows(self, parts: int):
        """(part, payload) for all parts that some run goes to."""
        cuts, many = np.searchsorted(self.part, np.arange(parts + 1)), self.many[self.order].astype(np.uint32)
        used = np.zeros(len(self.words) + 1, bool)
        for part in np.flatnonzero(np.diff(cuts)).tolist():
            at = slice(cuts[part], cuts[part + 1])
            runs = [x[at] for x in (self.a, self.b, self.c)]
            used[:] = False
            for x in runs:
                used[x] = True
            used[0] = False
            words = np.flatnonzero(used)
            local = np.zeros(len(used), np.uint32)
            local[words] = np.arange(1, len(words) + 1, dtype=np.uint32)
            body = b"\n".join([self.words[i] for i in (words - 1).tolist()])
            yield part, pack((body, [planes(local[x]) for x in runs], planes(many[at])))

    def sums(self, answers: list, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, summed gain) of each piece, from the buckets that the parts answered in their order."""
        one, two = _starts(self.a, self.b, self.part)
        got = [gain[np.concatenate([unplanes(x[i]) for x in answers] or [np.zeros(0, np.uint16)])] for i in range(3)]
        total = np.empty(len(self.a), np.int64)
        if len(total):
            total[self.order] = (got[0][np.cumsum(one) - 1] + np.where(self.b > 0, got[1][np.cumsum(two) - 1], 0) + np.where(self.c > 0, got[2], 0))
        end = np.cumsum(self.own)
        many, total = (np.concatenate([[0], np.cumsum(x)]) for x in (self.grams, total[self.of]))
        return many[end] - many[end - self.own], total[end] - total[end - self.own]


def _send(batches, parts: int):
    for b in batches:
        for target, block, payload in zip(*(b.column(c).to_pylist() for c in ("target", "block", "payload"))):
            rows = list(Block(payload, parts).rows(parts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([target] * len(rows), pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([p for p, _ in rows], pa.int32()),
                 pa.array([x for _, x in rows], pa.binary())],
                names=["target", "block", "part", "payload"],
            )
            trim()


@lru_cache(maxsize=1)
def _shifts(upto: int) -> np.ndarray:
    """[n, k, v]: the CRC-32 register ``v << 8 k`` after n zero bytes; a register is the exclusive or of its bytes' own."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)
    out = np.empty((upto + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(upto):
        out[n + 1] = out[n] >> 8 ^ step[out[n] & 255]
    return out


class Hashes:
    """CRC-32 of n-grams of numbered words (from 1), each from the hashes of its words: crc(xy) is crc(x) moved by the length of y, and crc(y)."""

    UPTO = 64

    def __init__(self, words: list[bytes]):
        self.words = words
        self.one = np.fromiter(map(zlib.crc32, [b"", *words]), np.uint32, len(words) + 1)
        self.next = np.fromiter((zlib.crc32(b" " + w) for w in (b"", *words)), np.uint32, len(words) + 1)
        self.sizes = np.fromiter(map(len, [b"", *words]), np.int64, len(words) + 1) + 1

    def add(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Hashes of n-grams that go on, after a space, with one more word."""
        size = self.sizes[word]
        table, n = _shifts(self.UPTO), np.minimum(size, self.UPTO)
        out = self.next[word] ^ table[n, 0, before & 255] ^ table[n, 1, before >> 8 & 255] ^ table[n, 2, before >> 16 & 255] ^ table[n, 3, before >> 24]
        for i in np.flatnonzero(size > self.UPTO).tolist():
            at = int(before[i])
            for _ in range(size[i]):
                at = at >> 8 ^ int(_shifts(self.UPTO)[1, 0, at & 255])
            out[i] = at ^ int(self.next[word[i]])
        return out


def _dictionary(group: pa.Table, buckets: int) -> pa.Table:
    """One part: every distinct n-gram counted and hashed once; bucket sums, and an answer to every block of the corpus."""
    number, rows, sizes = defaultdict(count(1).__next__), [], []
    for blob in group.column("payload").to_pylist():
        body, runs, many = unpack(blob)
        mine = np.array([0, *map(number.__getitem__, body.split(b"\n"))], np.int64)
        rows.append(([mine[unplanes(x)] for x in runs], unplanes(many)))
        sizes.append(len(rows[-1][1]))
    target, block = group.column("target").to_numpy(), group.column("block").to_pylist()
    (a, b, c), of = _triples(*(np.concatenate([r[0][i] for r in rows]) for i in range(3)), len(number) + 1)
    many, ours = np.concatenate([r[1] for r in rows]), np.repeat(target, sizes)
    counts = [np.bincount(of[ours == k], weights=many[ours == k], minlength=len(a)) for k in (0, 1)]
    hashes, starts = Hashes(list(number)), _starts(a, b)
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    sums, found, held = np.zeros((2, buckets), np.int64), [], None
    for level, (begin, word) in enumerate(((starts[0], a), (starts[1], b), (np.ones(len(a), bool), c))):
        at = np.flatnonzero(begin)
        held = hashes.one[word[at]] if held is None else hashes.add(held[up[at]], word[at])  # noqa: F821
        up = np.cumsum(begin) - 1  # the n-gram of this length that a run begins with
        bucket = (held % np.uint32(buckets)).astype(kind)
        real = word[at] > 0
        for k in (0, 1):
            n = np.add.reduceat(counts[k], at) if level < 2 else counts[k]
            sums[k] += np.bincount(bucket[real], weights=n[real], minlength=buckets).astype(np.int64)
        found.append((bucket, up))
    answers, end = [], 0
    for (runs, _), size, t, k in zip(rows, sizes, target.tolist(), block):
        mine, end = of[end : end + size], end + size
        if not t:
            one, two = _starts(runs[0], runs[1])
            answers.append((k, pack([planes(bucket[up[mine[w]]]) for (bucket, up), w in zip(found, (one, two, slice(None)))])))
    part = group.column("part")[0].as_py()
    return pa.table({
        "block": pa.array([None, *(k for k, _ in answers)], pa.int64()), "part": pa.array([part] * (len(answers) + 1), pa.int32()),
        "payload": pa.array([pack(sums), *(x for _, x in answers)], pa.binary()),
    })


def _bucket_rows(batches):
    for b in batches:
        for blob in b.column(0).to_pylist():
            sums = unpack(blob)
            at = np.flatnonzero(sums.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["bucket", "s", "t"])


def gains(s_counts: np.ndarray, t_counts: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of every bucket, in doubles."""
    b, s_all, t_all = len(s_counts), float(s_counts.sum()), float(t_counts.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(s_counts.tolist(), t_counts.tolist())
    ], np.int64)


def weigh(docs: DataFrame, target: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight): the summed gains of all runs of one to three words of each row of ``docs``.

    Whole texts count, repeats included; a null or empty text has no features and weight 0.  Repeated
    rows and repeated ids are kept as they are, null ids stay null, and other columns, whatever their
    names, are not read.  An empty ``docs`` gives an empty result; without target rows all gains are those of T = 0.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def read(df: DataFrame, which: int, key: Column) -> DataFrame:
        return df.select(key.alias("id"), F.lit(which).alias("target"), F.col(text_col).cast("string").cast("binary").alias("text"))

    src = read(docs, 0, F.col(id_col).cast("long")).unionByName(read(target, 1, F.lit(None).cast("long")))
    blocks = materialize_bucketed(
        src.mapInArrow(trimmed_batches(lambda it: _to_blocks(it, s)), "target int, block long, words long, payload binary"), "importance", "block"
    )
    words = blocks.agg(F.sum("words")).first()[0] or 0
    parts = max(partitions(spark), math.ceil(words / s.part_words))
    sent = blocks.mapInArrow(trimmed_batches(lambda it: _send(it, parts)), "target int, block long, part int, payload binary")
    buckets = s.buckets
    answers = materialize_freed(
        sent.groupBy("part").applyInArrow(trimmed(lambda g: _dictionary(g, buckets)), "block long, part int, payload binary"), "importance-answers"
    )
    sums = answers.where("block IS NULL").select("payload").mapInArrow(trimmed_batches(_bucket_rows), "bucket long, s long, t long")
    held = np.zeros((2, buckets), np.int64)
    for r in sums.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():  # no more rows than buckets
        held[:, r["bucket"]] = r["s"], r["t"]
    gain = spark.sparkContext.broadcast(gains(*held))

    def join_back(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for payload in left.column("payload").to_pylist():
            block = Block(payload, parts)
            got = sorted(zip(right.column("part").to_pylist(), right.column("payload").to_pylist()))
            many, total = block.sums([unpack(x) for _, x in got], gain.value)
            home = block.home
            out.append(pa.table({
                "home": pa.array(home[:, 0]), "place": pa.array(home[:, 1]), "id": pa.array(block.ids, pa.int64()), "n_words": pa.array(block.own),
                "n_features": pa.array(many), "weight": pa.array(total),
            }))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("home", "place", "id", "n_words", "n_features", "weight")})

    by_piece = blocks.where("target = 0").select("block", "payload").groupBy("block").cogroup(
        answers.where("block IS NOT NULL").groupBy("block")
    ).applyInArrow(trimmed_pair(join_back), "home long, place long, id long, n_words long, n_features long, weight long")
    return by_piece.groupBy("home", "place", F.col("id").alias(id_col)).agg(
        *(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight"))
    ).drop("home", "place")


def noise(id_: Column, seed: int) -> Column:
    """floor of 1000 times seeded Gumbel noise; a null id counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` numbered from 1 in ``order``: sorted by ranges, so that no task has all rows, and numbered within each."""
    ranges = materialize(
        rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "ranked"
    )
    before = ranges.groupBy("_range").count().select(  # a row a range
        "_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before")
    )
    return ranges.join(F.broadcast(before), "_range").withColumn(
        name, F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    ).drop("_range", "_before")


def draw(weighed: DataFrame, s: Settings = Settings(), id_col: str = "doc_id") -> DataFrame:
    """(id, n_features, weight, score, rank) of all rows; ``rank`` is null where a row is not drawn.

    Of the N rows with ``least_words`` words or more, the floor(``percent`` N / 100) of highest score
    are drawn; equal scores go to the smaller id, and null ids come last.
    """
    held = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col(id_col), s.seed)), "weighed")
    able = F.col("n_words") >= s.least_words
    n = held.where(able).count() * s.percent // 100
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("n_features"), F.col("weight")]
    place = ranked(held.where(able), order, "_rank").withColumn("rank", F.when(F.col("_rank") <= n, F.col("_rank")).cast("long"))
    out = [id_col, "n_features", "weight", "score", "rank"]
    return place.select(*out).unionByName(held.where(~able).withColumn("rank", F.lit(None).cast("long")).select(*out))


def resample(docs: DataFrame, target: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``draw`` of ``weigh``: every row of ``docs`` with its score, and the drawn ones with their rank."""
    return draw(weigh(docs, target, s, id_col, text_col), s, id_col)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` weighed against the texts of ``benchmark``."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
