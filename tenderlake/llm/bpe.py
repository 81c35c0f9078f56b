"""Byte-level BPE by a global distinct-word shuffle.

1. Documents are split into pre-tokens; blocks of documents keep, per document, the
   sequence of local word numbers (the positions) and, per hash bucket, the block's
   distinct words.
2. The distinct words are shuffled by bucket; every word is encoded exactly once.
3. The ids go back to the blocks, which reassemble each document by position; decoding
   gathers from the token-byte table.

Only distinct words and their ids are exchanged, packed in one row per (block, bucket),
so a frequent word costs one entry a block and cannot become a hot key.
"""

from __future__ import annotations

import base64
import re
import unicodedata
import uuid
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import gather, materialize_bucketed, pack, partitions, planes, small_batches, table, trim, trimmed, trimmed_pair, unpack, unplanes

#: The code points that the fast splitter covers.
_LOW = 0x250


def _char_class(major: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(_LOW) if unicodedata.category(chr(i))[0] == major)


@lru_cache(maxsize=1)
def _splitters(pattern: str):
    """The pattern by the regex library and, for texts below U+0250, an equal one by re."""
    import regex

    letter, number, space = _char_class("L"), _char_class("N"), "\t-\r \x85\xa0"
    low = re.compile(
        f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )
    return regex.compile(pattern).findall, low.findall, re.compile("[^\x00-ɏ]").search


def split(text: str, pattern: str) -> list[str]:
    """The matches of ``pattern`` (the published GPT-2 pattern) in ``text``."""
    general, low, high = _splitters(pattern)
    return low(text) if text.isascii() or not high(text) else general(text)


@lru_cache(maxsize=1)
def _ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


@lru_cache(maxsize=1)
def _encoder(raw: bytes, pattern: str):
    """Encodes one pre-token by the library's merges."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=_ranks(raw), special_tokens={})._core_bpe.encode_single_piece


@lru_cache(maxsize=1)
def _token_table(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all tokens by id, start, length)."""
    ranks = _ranks(raw)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    lens = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lens) - lens, lens


def _blocks(batches, buckets: int, pattern: str, block_bytes: int):
    """Rows (kind, block, part, payload): kind 0 the sequences, kind 1 words of a bucket."""

    def flush(ids, lens, codes, numbers):
        words = [w.encode() for w in numbers]
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        # Frequent words get small numbers, and the words of a bucket lie in order: both compress better.
        often = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        number = np.empty(len(words), np.uint32)
        number[often] = np.arange(len(words), dtype=np.uint32)
        flat, words = number[flat], [words[i] for i in often.tolist()]
        part = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        order = order[np.argsort(part[order], kind="stable")]
        place = np.empty(len(words), np.uint32)
        place[order] = np.arange(len(words), dtype=np.uint32)
        block = uuid.uuid4().int >> 65
        rows = [(0, block, -1, pack((ids, np.array(lens, np.int64), planes(flat), planes(place))))]
        cuts = np.searchsorted(part[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            own = [words[i] for i in order[cuts[b] : cuts[b + 1]]]
            rows.append((1, block, int(b), pack((planes(np.array([len(w) for w in own], np.uint32)), b"".join(own)))))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
            names=["kind", "block", "part", "payload"],
        )

    fresh = lambda: ([], [], [], defaultdict(count().__next__))
    ids, lens, codes, numbers = fresh()
    size = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = split(text or "", pattern)
            ids.append(doc)
            lens.append(len(words))
            codes.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            size += len(text or "")
            if size >= block_bytes:
                yield flush(ids, lens, codes, numbers)
                ids, lens, codes, numbers = fresh()
                size = 0
                trim()
    if ids:
        yield flush(ids, lens, codes, numbers)


def _encode_bucket(group: pa.Table, raw: bytes, pattern: str) -> pa.Table:
    """Encode every distinct word of a bucket once; a row of ids for each block."""
    encode, known, out = _encoder(raw, pattern), {}, []
    for blob in group.column("payload").to_pylist():
        sizes, joined = unpack(blob)
        ends = np.cumsum(unplanes(sizes)).tolist()
        ids, begin = [], 0
        for end in ends:
            word = joined[begin:end]
            if (x := known.get(word)) is None:
                x = known[word] = encode(word)
            ids.append(x)
            begin = end
        n = np.array([len(x) for x in ids], np.uint32)
        flat = np.fromiter((t for x in ids for t in x), np.uint32, int(n.sum()))
        out.append(pack((planes(n), planes(flat))))
    return pa.table({"block": group.column("block"), "part": group.column("part"), "payload": pa.array(out, pa.binary())})


def _reassemble(left: pa.Table, right: pa.Table, raw: bytes, id_type) -> pa.Table:
    """The documents of a block: ids by position, bytes from the token-byte table."""
    ids, lens, flat, place = unpack(left.column("payload")[0].as_py())
    codes, place = unplanes(flat), unplanes(place)
    parts = sorted(zip(right.column("part").to_pylist(), right.column("payload").to_pylist()))
    got = [unpack(p) for _, p in parts]
    n = np.concatenate([unplanes(g[0]) for g in got] or [np.zeros(0, np.uint32)]).astype(np.int64)
    tokens = np.concatenate([unplanes(g[1]) for g in got] or [np.zeros(0, np.uint32)])
    at = place[codes]
    count_ = n[at]
    seq = gather(tokens, (np.cumsum(n) - n)[at], count_)
    word_end = np.concatenate([[0], np.cumsum(count_)])
    id_off = word_end[np.concatenate([[0], np.cumsum(lens)])]
    table_bytes, start, size = _token_table(raw)
    byte_end = np.concatenate([[0], np.cumsum(size[seq])])
    data = gather(table_bytes, start[seq], size[seq])
    byte_off = byte_end[id_off]
    if max(byte_off[-1], id_off[-1]) > 0x7FFFFFFF:
        raise ValueError("a block of documents holds 2 GiB or more: choose smaller blocks")
    decoded = pa.BinaryArray.from_buffers(
        pa.binary(), len(ids), [None, pa.py_buffer(byte_off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    )
    return pa.table({
        "id": pa.array(ids, id_type),
        "ids": pa.ListArray.from_arrays(pa.array(id_off.astype(np.int32)), pa.array(seq.astype(np.int32))),
        "decoded": decoded,
    })


def encode_decode(
    docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20
) -> DataFrame:
    """(id, ids array<int>, decoded binary), one row for each row of ``docs``.

    A null text is empty and has no ids.  Repeated rows and repeated ids are kept, a null id
    stays null, an empty table gives an empty result, other columns of ``docs`` (whatever
    their names) are not read.  ``vocab_path`` is a file of base64 tokens and ranks that the
    driver reads and broadcasts (its size is that of the vocabulary).  A text, its ids and its
    decoded bytes are values of Spark and so below 2 GiB each; a block that would exceed this
    raises.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocab_path, "rb") as f:
        vocab = spark.sparkContext.broadcast(f.read())
    buckets = partitions(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    stored = materialize_bucketed(
        src.mapInArrow(lambda it: _blocks(it, buckets, pattern, block_bytes), "kind int, block long, part int, payload binary"),
        "bpe", "block", "kind",
    )
    words = stored.where("kind = 1").select("block", "part", "payload").groupBy("part")
    encoded = words.applyInArrow(trimmed(lambda g: _encode_bucket(g, vocab.value, pattern)), "block long, part int, payload binary")
    seqs = stored.where("kind = 0").select("block", "payload").groupBy("block")
    return seqs.cogroup(encoded.groupBy("block")).applyInArrow(
        trimmed_pair(lambda a, b: _reassemble(a, b, vocab.value, pa.int64())), "id long, ids array<int>, decoded binary"
    ).select(F.col("id").alias(id_col), "ids", "decoded")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded bytes of all ``documents``; a null text counts as empty."""
    import public_tokenizers as P

    return digests(encode_decode(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
