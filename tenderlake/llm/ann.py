"""Nearest neighbours by cross-polytope hashing.

Fast Hadamard pseudo-rotations (three rounds of random signs and a Walsh-Hadamard transform)
turn unit vectors, whose hash is the nearest signed axis.  Each table concatenates ``hashes``
of them, more where there are more vectors, so that buckets stay small.  Every vector is
indexed once a table; a query probes the buckets of a table that lie nearest by the squared
distance of its rotated coordinates from the best ones, and what it meets is ranked by the
exact inner product of the original vectors.  How many buckets are probed is fitted on a
bounded sample of queries, whose exact neighbours say which share would be met.

Rows are dealt by the first axis alone and the others are matched inside a group, so a query
is sent once for all its buckets with one first axis, not once for each bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ._common import materialize, small_batches, table, trimmed_batches, trimmed_pair

TABLES, SEED = 12, 42
#: A further hash is taken once there are this many vectors to a bucket.
FULL = 64
#: Nearest axes of a hash, and buckets of a table, that probing looks at at most; where that
#: misses the recall asked for, one hash less is concatenated.
WIDE, MOST = 32, 512
#: Vectors of a group that one task ranks at a time, and of a block where all are ranked.
CHUNK, BLOCK = 8192, 1 << 16


def _rotate(x: np.ndarray, table_: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng([seed, table_])
    d = x.shape[1]
    for _ in range(3):
        x = x * rng.choice([-1.0, 1.0], d)
        h = 1
        while h < d:
            x = x.reshape(len(x), -1, 2, h)
            x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(-1, d)
            h *= 2
    return x


def _rotated(x: np.ndarray, tables: int, hashes: int, seed: int):
    """For each table its rotations of the unit vectors as [rows, 2 d] scores of signed axes."""
    d = 1 << max(0, int(x.shape[1] - 1).bit_length())
    unit = np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, d - x.shape[1])))
    for t in range(tables):
        rotations = [_rotate(unit, t * hashes + j, seed) for j in range(hashes)]
        yield [np.concatenate([y, -y], axis=1) for y in rotations]


def _own(x: np.ndarray, tables: int, hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """([rows, tables] first axes, [rows, tables] codes of the others): the bucket of each vector."""
    first, rest = [], []
    for scores in _rotated(x, tables, hashes, seed):
        axes = [s.argmax(axis=1) for s in scores]
        first.append(axes[0])
        code = np.zeros(len(x), np.int64)
        for a, s in zip(axes[1:], scores[1:]):
            code = code * s.shape[1] + a
        rest.append(code)
    return np.stack(first, axis=1), np.stack(rest, axis=1)


def _probes(x: np.ndarray, probes: int, tables: int, hashes: int, seed: int):
    """For each table ([rows, probes] first axes, codes of the others), the nearest buckets of
    those made of the ``WIDE`` nearest axes of each hash."""
    for scores in _rotated(x, tables, hashes, seed):
        total = codes = None
        for s in scores:
            axes = np.argsort(-s, axis=1, kind="stable")[:, : probes if hashes == 1 else WIDE]
            lost = np.take_along_axis(s, axes, 1)
            lost = (lost[:, :1] - lost) ** 2
            if total is None:
                total, first, codes = lost, axes, np.zeros_like(axes)
                continue
            every = (total[:, :, None] + lost[:, None, :]).reshape(len(x), -1)
            best = np.argpartition(every, probes - 1, axis=1)[:, :probes] if probes < every.shape[1] else np.broadcast_to(np.arange(every.shape[1]), every.shape)
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(every, best, 1), axis=1, kind="stable"), 1)
            at, axis = best // axes.shape[1], best % axes.shape[1]
            total = np.take_along_axis(every, best, 1)
            first = np.take_along_axis(first, at, 1)
            codes = np.take_along_axis(codes, at, 1) * s.shape[1] + np.take_along_axis(axes, axis, 1)
        yield first, codes


def _needed(pairs: list[tuple], target: float, tables: int, hashes: int, seed: int) -> int | None:
    """The probes a table with which the share ``target`` of (query, neighbour) vectors meet."""
    ranks = []
    for q, v in pairs:
        first, rest = _own(v, tables, hashes, seed)
        least = np.full(len(q), MOST)
        for t, (axis, code) in enumerate(_probes(q, MOST, tables, hashes, seed)):
            same = (axis == first[:, t : t + 1]) & (code == rest[:, t : t + 1])
            least = np.minimum(least, np.where(same.any(axis=1), same.argmax(axis=1), MOST))
        ranks.append(least)
    ranks = np.sort(np.concatenate(ranks)) if ranks else np.zeros(1, np.int64)
    need = int(ranks[min(len(ranks) - 1, int(target * len(ranks)))]) + 1
    return need if need <= MOST else None


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _matrix(column, kind: str) -> np.ndarray:
    """The vectors of one length of a binary column, in double precision."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64) if raw else np.zeros((0, 1))


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k distinct ids of highest score, the highest first, ties to the smaller id."""
    take = 2 * k
    while True:
        part = np.arange(len(ids)) if take >= len(ids) else np.flatnonzero(score >= np.partition(score, -take)[-take])
        order = part[np.lexsort((ids[part], -score[part]))]
        once = np.sort(np.unique(ids[order], return_index=True)[1])
        if len(once) >= k or take >= len(ids):
            order = order[once[:k]]
            return ids[order], score[order]
        take *= 4


def _rank(left: pa.Table, right: pa.Table, k: int, kind: str, every: bool = False) -> pa.Table:
    """The k nearest of a chunk of vectors for each query, among those in its buckets or ``every``."""
    ids, x = left.column("vec_id").to_numpy(), _matrix(left.column("v"), kind)
    qs, q = right.column("query_id").to_numpy(), _matrix(right.column("q"), kind)
    names, near, score = [], [], []

    def keep(i, at):
        at = at[ids[at] != qs[i]]
        if len(at):
            found, value = _best(ids[at], _dots(x, at, q, np.full(len(at), i)), k)
            names.append(qs[i])
            near.append(found)
            score.append(value)

    if every:
        for i in range(len(qs) if len(ids) else 0):
            rough = x @ q[i]
            take = 4 * k  # more where ids repeat
            while True:
                at = np.flatnonzero(rough >= np.partition(rough, -take)[-take] - 1e-9) if take < len(ids) else np.arange(len(ids))
                if take >= len(ids) or len(np.unique(ids[at])) > k:
                    break
                take *= 4
            keep(i, at)
    elif len(ids) and len(qs):
        code = left.column("code").to_numpy()
        order = np.argsort(code, kind="stable")
        ids, x, code = ids[order], x[order], code[order]
        wanted = right.column("codes").combine_chunks()
        of, codes = np.repeat(np.arange(len(qs)), np.diff(wanted.offsets.to_numpy())), wanted.flatten().to_numpy()
        begin, end = np.searchsorted(code, codes), np.searchsorted(code, codes, side="right")
        for i in range(0, len(qs), 64):
            some = slice(*np.searchsorted(of, [i, i + 64]))
            n = (end - begin)[some]
            at = np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            who = np.repeat(of[some], n)
            at, who = at[(other := ids[at] != qs[who])], who[other]
            value = _dots(x, at, q, who)
            cuts = np.searchsorted(who, np.arange(i, min(len(qs), i + 64) + 1))
            for j, (u, w) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()), i):
                if w > u:
                    found, best = _best(ids[at[u:w]], value[u:w], k)
                    names.append(qs[j])
                    near.append(found)
                    score.append(best)
    return pa.table({
        "query_id": pa.array(names, pa.int64()), "near": pa.array(near, pa.list_(pa.int64())), "score": pa.array(score, pa.list_(pa.float64())),
    })


def _dots(x: np.ndarray, at: np.ndarray, q: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Inner products of pairs, with one order of additions for every pair."""
    out = np.empty(len(at))
    for i in range(0, len(at), 1 << 14):
        out[i : i + (1 << 14)] = (x[at[i : i + (1 << 14)]] * q[who[i : i + (1 << 14)]]).sum(axis=1)
    return out


def _merge(group: pa.Table, k: int) -> pa.Table:
    flat = lambda c: group.column(c).combine_chunks().flatten().to_numpy()
    ids, score = _best(flat("near"), flat("score"), k)
    return pa.table({
        "query_id": pa.array([group.column("query_id")[0].as_py()] * len(ids), pa.int64()),
        "rank": pa.array(np.arange(1, len(ids) + 1), pa.int32()), "vec_id": pa.array(ids), "score": pa.array(score),
    })


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    ).where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))


def _by_length(batches):
    """(ids, vectors of one length) of the rows of batches."""
    for b in batches:
        flat, ids = b.column(1).flatten().to_numpy(zero_copy_only=False), b.column(0).to_numpy()
        lens = np.diff(b.column(1).offsets.to_numpy())
        start = np.cumsum(lens) - lens
        for n in np.unique(lens):
            own = np.flatnonzero(lens == n)
            yield ids[own], flat[start[own][:, None] + np.arange(n)].astype(np.float64)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    tables: int = TABLES, recall: float = 0.95, sample: int = 128, seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found by inner product of unit-like vectors.

    Vectors that are null, zero or hold null or non-finite components take no part, nor does a
    query meet its own id; ties go to the smaller id; a repeated id counts once, with its best
    vector, and a repeated query has one result.  Only vectors of a query's length are its
    candidates.  Every vector is indexed and every bucket is ranked whole, in chunks; a query
    that meets fewer than ``k`` ids is ranked against all vectors, in blocks, so it has all
    candidates where there are fewer.  Empty tables give an empty result.

    As many hashes are concatenated in a table as keep about ``FULL`` vectors or fewer to a
    bucket, one at least.  ``sample`` bounds the queries whose exact neighbours fit the number
    of probes to ``recall`` (a bound of the fit alone; every query is searched).
    """
    spark = vectors.sparkSession
    small_batches(spark, 4000)
    kind = "<f4" if isinstance(vectors.schema[vec_col].dataType.elementType, FloatType) else "<f8"
    made = "query_id long, near array<long>, score array<double>"
    result = "query_id long, rank int, vec_id long, score double"

    def bare(batches):
        for ids, x in _by_length(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), _binary([r.tobytes() for r in x.astype(kind)])], names=["id", "v"])

    every = usable(vectors, id_col, vec_col)
    asked = usable(queries, id_col, vec_col).dropDuplicates(["vec_id"])
    size = every.select(F.count("*"), F.max(F.size("v"))).first()
    blocks = -(-size[0] // BLOCK) or 1

    def exact(some: DataFrame) -> DataFrame:
        """The nearest of (query_id, q) among all vectors, in blocks."""
        block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks).cast("long")).alias("block")
        left = every.mapInArrow(trimmed_batches(bare), "vec_id long, v binary").select("vec_id", "v", block, F.length("v").alias("bytes"))
        right = some.select("query_id", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.length("q").alias("bytes"))
        ranked = left.groupBy("block", "bytes").cogroup(right.groupBy("block", "bytes")).applyInArrow(lambda a, b: _rank(a, b, k, kind, True), made)
        return ranked.groupBy("query_id").applyInArrow(lambda g: _merge(g, k), result)

    plain = asked.mapInArrow(trimmed_batches(bare), "query_id long, q binary")
    few = materialize(plain.orderBy(F.xxhash64(F.lit(seed), "query_id"), "query_id").limit(sample), "sample")
    true = exact(few).select("query_id", "vec_id").join(few, "query_id").join(every, "vec_id").dropDuplicates(["query_id", "vec_id"])
    by_length: dict[int, list] = {}
    for r in true.select("q", "v").collect():  # at most ``sample`` times ``k`` rows
        by_length.setdefault(len(r["v"]), []).append((np.frombuffer(r["q"], kind).astype(np.float64), np.array(r["v"])))
    pairs = [tuple(np.stack(x) for x in zip(*p)) for p in by_length.values()]
    axes = 2 << max(0, max(1, size[1] or 1) - 1).bit_length()
    hashes = 1
    while size[0] > FULL * axes**hashes:
        hashes += 1
    while (probes := _needed(pairs, recall, tables, hashes, seed)) is None and hashes > 1:
        hashes -= 1
    probes = probes or MOST

    def key(length, t, axis):
        return (length << 40) + (np.asarray(t, np.int64) << 24) + axis

    def index(batches):
        for ids, x in _by_length(batches):
            first, rest = _own(x, tables, hashes, seed)
            keys = key(x.shape[1], np.arange(tables), first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), _binary([r.tobytes() for r in x.astype(kind)]), pa.array(list(keys)), pa.array(list(rest))],
                names=["vec_id", "v", "key", "code"],
            )

    def probe(batches):
        for ids, x in _by_length(batches):
            raw = [r.tobytes() for r in x.astype(kind)]
            for t, (first, codes) in enumerate(_probes(x, probes, tables, hashes, seed)):
                rows = []
                for i in range(len(ids)):
                    order = np.argsort(first[i], kind="stable")
                    axis, cut = np.unique(first[i][order], return_index=True)
                    rows += [(ids[i], raw[i], key(x.shape[1], t, a), c) for a, c in zip(axis.tolist(), np.split(codes[i][order], cut[1:]))]
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*rows), kinds)], names=["query_id", "q", "key", "codes"])

    rows = materialize(every.mapInArrow(trimmed_batches(index), "vec_id long, v binary, key array<long>, code array<long>"), "index")
    spread = rows.select("vec_id", "v", F.explode(F.arrays_zip("key", "code")).alias("b")).select("vec_id", "v", "b.key", "b.code")
    sent = asked.mapInArrow(trimmed_batches(probe), "query_id long, q binary, key long, codes array<long>")
    chunks = F.broadcast(  # at most tables times signed axes
        rows.select(F.explode("key").alias("key")).groupBy("key").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("n"))
    )
    left = spread.join(chunks, "key").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "n").cast("int")).drop("n")
    right = sent.join(chunks, "key").select("query_id", "q", "key", "codes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"))
    met = left.groupBy("key", "chunk").cogroup(right.groupBy("key", "chunk")).applyInArrow(trimmed_pair(lambda a, b: _rank(a, b, k, kind)), made)
    found = materialize(met.groupBy("query_id").applyInArrow(lambda g: _merge(g, k), result), "nearest")
    full = found.where(F.col("rank") == k).select("query_id")
    short = materialize(plain.join(full, "query_id", "left_anti"), "short")
    if short.isEmpty():
        return found
    return found.join(full, "query_id", "left_semi").unionByName(exact(short))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector id among all other rows of ``embeddings``."""
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 20 = 0"))
