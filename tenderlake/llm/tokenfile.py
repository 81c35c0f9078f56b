"""Token-id files with a shared zstandard dictionary.

A shard is one byte string: magic, format, hash of the dictionary, number of documents, then
the index (offset and number of ids of each document) and the frames.  Every document is a
frame of its own, compressed with the dictionary trained on serialized id arrays, so one
short document is read with one seek.  Shards are written through Spark in ascending order
of ids, one binary value each, to any store that Spark writes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, partitions, small_batches, table, trim
from .bpe import split

_HEAD = struct.Struct("<4sHH32sQ")
_MAGIC = b"TLTK"


def write_shard(docs: list[bytes], width: int, dictionary: bytes) -> bytes:
    """A shard of documents given as little-endian ids of ``width`` bytes."""
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(level=1, dict_data=data, write_content_size=True, write_dict_id=False)
    frames = [packer.compress(d) for d in docs]
    ends = np.cumsum([0, *map(len, frames)]).astype("<u8")
    counts = np.array([len(d) // width for d in docs], "<u8")
    head = _HEAD.pack(_MAGIC, 1, width, hashlib.sha256(dictionary).digest(), len(docs))
    return b"".join([head, ends.tobytes(), counts.tobytes(), *frames])


class Shard:
    """Random access to the documents of a shard; ``dictionary`` must be the one it was written with."""

    def __init__(self, raw: bytes, dictionary: bytes):
        magic, version, self.width, digest, n = _HEAD.unpack_from(raw)
        if magic != _MAGIC or version != 1 or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a shard of this format and dictionary")
        at = _HEAD.size
        self.ends = np.frombuffer(raw, "<u8", n + 1, at)
        self.counts = np.frombuffer(raw, "<u8", n, at + 8 * (n + 1))
        self.raw, self.base = raw, at + 8 * (2 * n + 1)
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.reader = zstandard.ZstdDecompressor(dict_data=data)

    def __len__(self) -> int:
        return len(self.counts)

    def ids(self, i: int) -> np.ndarray:
        frame = self.raw[self.base + int(self.ends[i]) : self.base + int(self.ends[i + 1])]
        return np.frombuffer(self.reader.decompress(frame), f"<u{self.width}")


class _Words(dict):
    """Ids of pre-tokens, as bytes, by the tokenizers library's model; bounded."""

    def __init__(self, raw: bytes, most: int = 600_000):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(raw.decode())
        self.model, self.most, self.whole = tokenizer.model, most, tokenizer
        # Texts that hold an added token are encoded by the library as a whole.
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4
        # The byte-level alphabet: printable bytes stand for themselves, others follow from 256.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.letters = {b: b if b in plain else next(rest) for b in range(256)}

    def __missing__(self, word: str) -> bytes:
        mapped = word.encode().decode("latin-1").translate(self.letters)
        ids = np.array([t.id for t in self.model.tokenize(mapped)], f"<u{self.width}").tobytes()
        if len(self) >= self.most:
            self.clear()
        self[word] = ids
        return ids


@lru_cache(maxsize=1)
def _words(raw: bytes) -> _Words:
    return _Words(raw)


def _encode(text: str | None, words: _Words, pattern: str, end_id: int) -> bytes:
    text = text or ""
    if any(t in text for t in words.added):
        ids = np.array(words.whole.encode(text, add_special_tokens=False).ids, f"<u{words.width}").tobytes()
    else:
        ids = b"".join(map(words.__getitem__, split(text, pattern)))
    return ids + end_id.to_bytes(words.width, "little")


def pieces(ids: bytes, most: int, length: int) -> list[bytes]:
    """At most ``most`` pieces of ``length`` bytes, spread evenly over a whole document."""
    if len(ids) <= most * length:
        return [ids]
    step = (len(ids) - length) // (most - 1) if most > 1 else 0
    return [ids[i * step // 4 * 4 :][:length] for i in range(most)]


def train(docs: DataFrame, tokenizer: bytes, pattern: str, end_id: int, samples: int = 2000, most: int = 4, length: int = 4096,
          size: int = 1 << 16, seed: int = 42) -> bytes:
    """The shared dictionary, of at most ``size`` bytes, trained on serialized id arrays.

    Training reads about ``samples`` documents, picked by a seeded hash of the id, and of each
    at most ``most`` pieces of ``length`` bytes spread over the whole document (bounds of the
    fit alone: every document is written whole).  Where they are too few to train on, they are
    the dictionary themselves; an empty table has an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)
    share = min(1.0, samples / max(1, docs.count()))

    def run(batches):
        for b in batches:
            words = _words(sent.value)
            rows = [p for t in b.column(0).to_pylist() for p in pieces(_encode(t, words, pattern, end_id), most, length)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])

    pick = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < int(share * 1_000_000)
    got = sorted(bytes(r["ids"]) for r in docs.where(pick).select("text").mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(size, got).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(got)[:size]


def write(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
          shard_bytes: int = 4 << 20) -> tuple[DataFrame, bytes]:
    """The table of shards (part, chunk, ids array, n_tokens, shard) and their dictionary.

    Documents lie in ascending order of ids (null first, repeated ids side by side) by part,
    chunk and place; a null text is empty and holds the end id alone.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, "rb") as f:
        tokenizer = f.read()
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    dictionary = train(src, tokenizer, pattern, end_id)
    sent = spark.sparkContext.broadcast((tokenizer, dictionary))

    def run(batches):
        raw, shared = sent.value
        words, part, chunk = _words(raw), TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def flush():
            n = sum(map(len, texts)) // words.width
            cols = [[part], [chunk], [ids], [n], [write_shard(texts, words.width, shared)]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["part", "chunk", "ids", "n_tokens", "shard"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append(_encode(t, words, pattern, end_id))
                size += len(texts[-1])
                if size >= shard_bytes:
                    yield flush()
                    ids, texts, size, chunk = [], [], 0, chunk + 1
        if ids:
            yield flush()
        trim()

    ranged = src.repartitionByRange(partitions(spark), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
    shards = ranged.mapInArrow(run, "part int, chunk int, ids array<long>, n_tokens long, shard binary")
    return materialize(shards, "tokens"), dictionary


def read(shards: DataFrame, dictionary: bytes) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of all documents, from the shards themselves.  Repeated
    ids follow each other in any order; no shards, no rows."""
    spark = shards.sparkSession
    sent = spark.sparkContext.broadcast(dictionary)
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_part_start"))
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = shards.select("part", "chunk", "n_tokens").withColumn("_start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    starts = chunks.join(parts, "part").select("part", "chunk", (F.col("_start") + F.col("_part_start")).alias("start"))

    def run(batches):
        for b in batches:
            for ids, raw, start in zip(*(b.column(i).to_pylist() for i in range(3))):
                shard = Shard(raw, sent.value)
                n = shard.counts.astype(np.int64)
                crc = [zlib.crc32(shard.ids(i).astype("<u4").tobytes()) for i in range(len(shard))]
                begin = start + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(begin), pa.array(n), pa.array(crc, pa.int64())],
                    names=["id", "start", "n_tokens", "ids_crc32"],
                )

    found = shards.select("part", "chunk", "ids", "shard").join(starts, ["part", "chunk"])
    return found.select("ids", "shard", "start").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of each row of ``documents`` in its token file, read from the
    file; a null text is empty and holds the end id alone, a null id comes first."""
    import public_tokenizers as P

    shards, dictionary = write(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.PATTERN)
    return read(shards, dictionary).withColumnRenamed("id", "doc_id")
