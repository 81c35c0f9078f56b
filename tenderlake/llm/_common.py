"""Shared plumbing of the training-data operators.

Intermediate results are cut from their lineage by writing a Parquet table to the
folder that the session names in ``spark.checkpoint.dir``; executors may be lost
at any time without losing such a table.  A private folder is used only where the
setting is absent (unit tests on one machine).
"""

from __future__ import annotations

import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A table of a few numbers a row is broadcast up to so many rows (some 10 MB), and joined otherwise.
MANY = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``; an error where it is
    unset and executors are not the driver itself."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tl-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch holds, whatever the length of a text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_freed(df: DataFrame, tag: str) -> DataFrame:
    """As ``materialize``; the files of the exchanges of ``df`` go as soon as the table is written."""
    spark, setting = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        return materialize(df, tag)
    finally:
        spark.conf.set(setting, before)


def materialize_bucketed(df: DataFrame, tag: str, key: str, kind: str | None = None) -> DataFrame:
    """As ``materialize``, bucketed by ``key``: later groupings by it need no exchange."""
    spark = df.sparkSession
    name = f"tl_{tag}_{uuid.uuid4().hex}"
    out = df.write.option("compression", "uncompressed").bucketBy(partitions(spark), key)
    if kind:
        out = out.partitionBy(kind)
    out.option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pack(obj) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(obj, 5))


def unpack(blob: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def planes(a: np.ndarray) -> tuple[str, bytes]:
    """An integer array as byte planes, which compress better than its words."""
    return a.dtype.str, np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def unplanes(x: tuple[str, bytes]) -> np.ndarray:
    dtype, raw = np.dtype(x[0]), x[1]
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
    """Concatenation of ``flat[s:s + n]`` over all (s, n), with index arrays for ``chunk`` of them at a time."""
    ends = np.cumsum(lens)
    out = np.empty(int(ends[-1]) if len(ends) else 0, flat.dtype)
    done = 0
    for i in range(0, len(ends), chunk):
        own, upto = lens[i : i + chunk], int(ends[min(len(ends), i + chunk) - 1])
        shift = np.repeat(starts[i : i + chunk] - (ends[i : i + chunk] - own), own)
        out[done:upto] = flat[np.arange(done, upto, dtype=np.int64) + shift]
        done = upto
    return out


def trim() -> None:
    """Give memory that a Python worker no longer uses back to the machine."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(work):
    """``work`` on a group, with unused memory given back afterwards."""

    def run(group):
        out = work(group)
        trim()
        return out

    return run


def trimmed_pair(work):
    """As ``trimmed``, for two groups of one key."""

    def run(left, right):
        out = work(left, right)
        trim()
        return out

    return run


def trimmed_batches(work):
    """As ``trimmed``, for a function over the batches of a partition."""

    def run(batches):
        yield from work(batches)
        trim()

    return run


def to_blocks(batches, block_bytes: int):
    """Rows (block, payload): ids, offsets, the bytes of whole documents, carried columns."""

    def flush(ids, texts, more):
        lens = np.array([len(t) for t in texts], np.int64)
        carried = pa.Table.from_batches(more).combine_chunks() if more and more[0].num_columns else None
        blob = pack((ids, np.concatenate([[0], np.cumsum(lens)]), b"".join(texts), carried))
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().int >> 65]), pa.array([int(lens.sum())]), pa.array([blob], pa.binary())],
            names=["block", "bytes", "payload"],
        )

    ids, texts, more, size = [], [], [], 0
    for b in batches:
        rest, begin = b.select(range(2, b.num_columns)), 0
        for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist())):
            ids.append(i)
            texts.append(t or b"")
            size += len(t or b"")
            if size >= block_bytes:
                yield flush(ids, texts, [*more, rest.slice(begin, k + 1 - begin)])
                ids, texts, more, size, begin = [], [], [], 0, k + 1
        more.append(rest.slice(begin))
    if ids:
        yield flush(ids, texts, more)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected (u, v) links.

    Alternating large-star and small-star contraction; every round is written to the
    shared folder and all links stay distributed.
    """
    cur = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    seen = None
    for _ in range(rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        )
        cur = materialize(small, "links")
        state = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
