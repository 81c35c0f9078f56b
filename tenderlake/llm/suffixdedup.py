"""Removal of repeated byte passages by a distributed, common-prefix-aware suffix merge sort.

A passage is a string of ``width`` bytes that also starts earlier (smaller id, or the same
document).  Sorting all suffixes is not needed to find every one of them:

1. Anchors.  In every window of ``width`` bytes, the ``seed``-byte substring of least hash
   (leftmost first) is its anchor.  Equal windows have their anchor at the same offset, so
   only suffixes that start at anchors, about one in 35, are sorted; each knows the run of
   windows that it answers for.
2. Filter.  Anchor hashes that occur once in the corpus answer for no repeated window.
   Hashes are exchanged as sorted byte planes and one bit an anchor comes back.
3. Runs.  Of suffixes of a block that answer for the same bytes only the earliest goes on,
   the windows of the others being repeats of its own, so a passage that many documents hold
   is sent once a block.  Every block sorts what remains and front-codes it: shared prefix
   length, then the other bytes.  Runs are exchanged by the hash of the seed, so equal
   seeds meet and a frequent seed cannot shift the boundaries of others.
4. Merge.  A loser tree merges the runs of a partition.  Each loser keeps its common prefix
   with the string it lost to, so bytes known to be equal are not compared again, and the
   merge yields the common prefixes of its output.
5. Windows.  For each offset j, suffixes with common prefixes of width - j bytes and equal
   j bytes before the anchor hold the same window; all but the earliest are repeats.

Blocks of documents are written once, bucketed by block, so texts are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize_bucketed, pack, partitions, small_batches, table, to_blocks, trim, trimmed, trimmed_pair, unpack

WIDTH, SEED_BYTES = 100, 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
#: Bits of a sort key that hold the position; the same for all blocks, as ties of the rest fall to the leftmost.
_PLACE = np.uint64(32)


def _rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-byte substring, k a power of two."""
    h, base, span = data.astype(np.uint64) + np.uint64(1), _BASE, 1
    while span < k:
        h = h[: len(h) - span] * base + h[span:]
        base, span = np.uint64(int(base) ** 2 & _MASK), 2 * span
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH, seed: int = SEED_BYTES, chunk: int = 1 << 18):
    """(position, first window, last window, hash) of the anchors of concatenated documents.

    ``bounds`` are the documents' offsets, one more than documents.  Windows never cross them.
    Windows are taken ``chunk`` at a time, so that memory does not grow with a long document.
    """
    windows = len(data) - width + 1
    none = np.zeros(0, np.int64)
    if windows <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    valid = np.zeros(len(data) + 1, np.int8)
    long_ = np.diff(bounds) >= width
    np.add.at(valid, bounds[:-1][long_], 1)
    np.add.at(valid, bounds[1:][long_] - width + 1, -1)
    inside = np.cumsum(valid, dtype=np.int8)[:windows] > 0
    found = []
    for begin in range(0, windows, chunk):
        here = inside[begin : begin + chunk]
        if here.any():
            found.append(_anchors_of(data[begin : begin + len(here) + width - 1], begin, here, width - seed + 1, seed))
    if not found:
        return none, none, none, np.zeros(0, np.uint64)
    at, starts, stops, h = (np.concatenate(x) for x in zip(*found))
    # A run of windows that two chunks share is one.
    fresh = np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != stops[:-1] + 1)])
    return at[fresh], starts[fresh], stops[np.concatenate([fresh[1:], [True]])], h[fresh]


def _anchors_of(data: np.ndarray, begin: int, inside: np.ndarray, want: int, seed: int):
    """The anchors of windows from ``begin`` on, each the least of ``want`` hashes."""
    h = _rolling(data, seed)
    low = ((h >> _PLACE) << _PLACE) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= want:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < want:
        low = np.minimum(low[: len(low) - (want - span)], low[want - span :])
    at = (low & np.uint64(0xFFFFFFFF)).view(np.int64)
    turn = at[1:] != at[:-1]
    starts = np.flatnonzero(inside & np.concatenate([[True], turn | ~inside[:-1]]))
    stops = np.flatnonzero(inside & np.concatenate([turn | ~inside[1:], [True]]))
    return at[starts] + begin, starts + begin, stops + begin, h[at[starts]]


def _seed_hashes(batches, parts: int, width: int, seed: int):
    """Rows (block, part, payload): the distinct 48-bit seed hashes of a block in a part."""
    for b in batches:
        for block, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            _, bounds, raw, _ = unpack(blob)
            h, twice = np.unique(anchors(np.frombuffer(raw, np.uint8), bounds, width, seed)[3] >> np.uint64(16), return_counts=True)
            part = (h % np.uint64(parts)).astype(np.int64)
            rows = []
            for p in np.unique(part):
                own = h[part == p]
                raw6 = np.ascontiguousarray(own.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()
                rows.append((block, int(p), pack((raw6, np.packbits(twice[part == p] > 1).tobytes()))))
            if rows:
                yield _batch(rows)
        trim()


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], names=["block", "part", "payload"]
    )


def _repeated(group: pa.Table) -> pa.Table:
    """For each block of a part, a bit for each of its hashes: whether it recurs anywhere."""
    got = []
    for blob in group.column("payload").to_pylist():
        raw6, twice = unpack(blob)
        six = np.frombuffer(raw6, np.uint8).reshape(6, -1)
        h = np.zeros((six.shape[1], 8), np.uint8)
        h[:, :6] = six.T
        got.append((h.view(np.uint64).ravel(), np.unpackbits(np.frombuffer(twice, np.uint8))[: six.shape[1]].astype(bool)))
    every, place = np.unique(np.concatenate([h for h, _ in got]), return_inverse=True)
    n = np.bincount(place, minlength=len(every)) + np.bincount(place, np.concatenate([t for _, t in got]), minlength=len(every))
    marks = np.split(n[place] > 1, np.cumsum([len(h) for h, _ in got])[:-1])
    return pa.table({
        "block": group.column("block"), "part": group.column("part"),
        "payload": pa.array([np.packbits(m).tobytes() for m in marks], pa.binary()),
    })


def _shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, hi = known, n  # the first difference lies in [lo, hi)
    while hi - lo > 8:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    while a[lo] == b[lo]:
        lo += 1
    return lo


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(common prefix with the one before, length, other bytes) of a sorted run."""
    lcp, rest, last = [], [], b""
    for s in suffixes:
        n = _shared(last, s, 0)
        lcp.append(n)
        rest.append(s[n:])
        last = s
    return np.array(lcp, np.uint16), np.array([len(s) for s in suffixes], np.uint16), b"".join(rest)


def _read_run(lcp, size, rest):
    """Yields (suffix, common prefix with the one before) of a front-coded run."""
    last, at = b"", 0
    for n, m in zip(lcp.tolist(), size.tolist()):
        last = last[:n] + rest[at : at + m - n]
        at += m - n
        yield last, n


def merge_runs(runs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge front-coded runs by a loser tree: (run, place in it, prefix shared with the one before).

    Every loser holds the prefix it shares with the winner it lost to.  At a replay the
    candidate and the loser have both been compared with the same last winner: if their
    prefixes with it differ, the longer one is smaller and no byte is read; if they are
    equal, comparison starts behind it.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    feeds = [_read_run(*r) for r in runs] + [iter(())] * (k - len(runs))
    heads: list = [None] * k
    known = [0] * k
    for i, f in enumerate(feeds):
        if (x := next(f, None)) is not None:
            heads[i], known[i] = x[0], 0
    losers = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        if heads[a] is None or (heads[b] is not None and heads[b] < heads[a]):
            a, b = b, a
        losers[node] = b
        if heads[b] is not None:
            known[b] = _shared(heads[a], heads[b], 0)
        return a

    win = build(1) if k > 1 else 0
    order_run, order_at, lcps = [], [], []
    at = [0] * k
    prefix = 0
    while heads[win] is not None:
        order_run.append(win)
        order_at.append(at[win])
        lcps.append(prefix)
        at[win] += 1
        nxt = next(feeds[win], None)
        heads[win], known[win] = nxt if nxt is not None else (None, 0)
        cand, node = win, (win + k) >> 1
        while node:
            other = losers[node]
            ho = heads[other]
            if ho is not None:
                hc = heads[cand]
                if hc is None:
                    losers[node], cand = cand, other
                else:
                    kc, ko = known[cand], known[other]
                    if ko > kc:
                        losers[node], cand = cand, other  # the loser keeps kc: it differs there from both
                    elif ko == kc:
                        n = _shared(hc, ho, kc)
                        if ho[n:] < hc[n:]:
                            known[cand] = n
                            losers[node], cand = cand, other
                        else:
                            known[other] = n
            node >>= 1
        win, prefix = cand, known[cand]
    return np.array(order_run, np.int64), np.array(order_at, np.int64), np.array(lcps, np.int64)


def _runs(left: pa.Table, right: pa.Table, parts: int, width: int, seed: int) -> pa.Table:
    """The front-coded runs of a block, one a part."""
    block, blob = left.column("block")[0].as_py(), left.column("payload")[0].as_py()
    ids, bounds, raw, _ = unpack(blob)
    at, first, last, h = anchors(np.frombuffer(raw, np.uint8), bounds, width, seed)
    code = h >> np.uint64(16)
    part = (code % np.uint64(parts)).astype(np.int64)
    marks = dict(zip(right.column("part").to_pylist(), right.column("payload").to_pylist()))
    names = np.array([-(1 << 63) if i is None else i for i in ids], np.int64)
    rows = []
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[p] : cuts[p + 1]]
        distinct, place = np.unique(code[own], return_inverse=True)
        bits = np.unpackbits(np.frombuffer(marks.get(int(p), b""), np.uint8))[: len(distinct)].astype(bool)
        own = own[bits[place]]
        if not len(own):
            continue
        doc = np.searchsorted(bounds, at[own], side="right") - 1
        own = own[np.lexsort((at[own], at[own] - bounds[doc], names[doc]))]
        seen: dict = {}
        fresh = np.empty(len(own), bool)
        for i, (s, e, f) in enumerate(zip(first[own].tolist(), (last[own] + width).tolist(), (at[own] - first[own]).tolist())):
            fresh[i] = seen.setdefault((raw[s:e], f), i) == i
        again, own = own[~fresh], own[fresh]
        suffix = [raw[s:e] for s, e in zip(at[own].tolist(), (last[own] + width).tolist())]
        rank = sorted(range(len(own)), key=suffix.__getitem__)
        own = own[rank]
        doc = np.searchsorted(bounds, at[own], side="right") - 1
        before = b"".join([raw[s:e] for s, e in zip(first[own].tolist(), at[own].tolist())])
        # Windows are numbered by their start in the block; order among rows is (id, start in the document).
        blob = pack((*front_code([suffix[i] for i in rank]), (first[again].astype(np.uint32), last[again].astype(np.uint32)),
                     at[own], (at[own] - first[own]).astype(np.int32),
                     (at[own] - last[own]).astype(np.int32), before, names[doc], at[own] - bounds[doc]))
        rows.append((block, int(p), blob))
    return pa.Table.from_batches([_batch(rows)]) if rows else pa.table(
        {"block": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())}
    )


def _repeats(group: pa.Table, width: int) -> pa.Table:
    """(firsts, lasts) of runs of repeated windows, by block, from all runs of a part."""
    blocks, runs, cols, known = [], [], [], []
    blobs = sorted(zip(group.column("block").to_pylist(), group.column("payload").to_pylist()))
    for block, blob in blobs:
        lcp, size, rest, again, *more = unpack(blob)
        runs.append((lcp, size, rest))
        known.append(again)
        cols.append(more)
        blocks.append(block)
    run, place, lcp = merge_runs(runs)
    base = np.concatenate([[0], np.cumsum([len(r[0]) for r in runs])])
    pick = base[run] + place
    join = lambda i: np.concatenate([c[i] for c in cols])[pick]
    at, far, near, name, start = join(0), join(1), join(2), join(4), join(5)
    # Where the bytes before an anchor lie.
    offsets = np.concatenate([np.concatenate([[0], np.cumsum(c[1])[:-1]]) + s for c, s in
                              zip(cols, np.concatenate([[0], np.cumsum([len(c[3]) for c in cols])]))])[pick]
    flat = np.frombuffer(b"".join(c[3] for c in cols), np.uint8)
    deep = int(far.max(initial=0))
    ends = offsets + far
    order = np.lexsort((at, run, start, name))
    rank = np.empty(len(at), np.int64)
    rank[order] = np.arange(len(at))
    hits_row, hits_at = [], []
    # Classes of equal j bytes before the anchor, refined byte by byte: exact, not hashed.
    before = np.zeros(len(at), np.int64)
    for j in range(deep + 1):
        if j:
            # The byte j before the anchor; rows that reach less far are in no class from here on.
            have = far >= j
            both = before * 256
            both[have] += flat[ends[have] - j]
            before = np.unique(both, return_inverse=True)[1].ravel()
        rows = np.flatnonzero((near <= j) & (j <= far))
        if len(rows) < 2:
            continue
        prefix = np.cumsum(lcp < width - j)[rows]
        key = prefix * (len(at) + 1) + before[rows]
        by = rows[np.lexsort((rank[rows], key))]
        ordered = np.sort(key)
        again = by[np.concatenate([[False], ordered[1:] == ordered[:-1]])]
        # The earliest of a class stays.
        hits_row.append(again)
        hits_at.append(at[again] - j)
    none = np.zeros(0, np.int64)
    hit, where = np.concatenate([none, *hits_row]), np.concatenate([none, *hits_at])
    which, out = run[hit], []
    for r, (firsts, lasts) in enumerate(known):
        own = np.unique(where[which == r])
        if len(own) or len(firsts):
            turn = np.flatnonzero(np.diff(own) != 1)
            begin = own[np.concatenate([[0], turn + 1])] if len(own) else own
            end = own[np.concatenate([turn, [len(own) - 1]])] if len(own) else own
            out.append((blocks[r], 0, pack((np.concatenate([begin.astype(np.uint32), firsts]), np.concatenate([end.astype(np.uint32), lasts])))))
    return pa.Table.from_batches([_batch(out)]) if out else pa.table(
        {"block": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())}
    )


def _cut(left: pa.Table, right: pa.Table, width: int, as_text: bool) -> pa.Table:
    """The documents of a block without their repeated bytes."""
    ids, bounds, raw, carried = unpack(left.column("payload")[0].as_py())
    runs = [unpack(b) for b in right.column("payload").to_pylist()]
    edge = np.zeros(len(raw) + 1, np.int32)
    for firsts, lasts in runs:
        np.add.at(edge, firsts.astype(np.int64), 1)
        np.add.at(edge, lasts.astype(np.int64) + width, -1)
    gone = np.cumsum(edge)[: len(raw)] > 0
    data = np.frombuffer(raw, np.uint8)
    kept, spans = [], []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        g = gone[s:e]
        if not g.any():
            kept.append(raw[s:e])
            spans.append([])
            continue
        turn = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
        spans.append([{"start": int(a), "stop": int(b)} for a, b in turn.reshape(-1, 2)])
        if as_text:  # a character goes whole
            char = np.cumsum((data[s:e] & 0xC0) != 0x80)
            g = (np.bincount(char, g) > 0)[char]
        kept.append(data[s:e][~g].tobytes())
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    out = [pa.array(ids, pa.int64()), pa.array(np.diff(bounds)), pa.array(kept, pa.binary()), pa.array(spans, span)]
    if as_text:
        out[2] = out[2].cast(pa.string())
    names = ["_id", "_n_bytes", "_kept", "_removed"]
    if carried is not None:
        out, names = [*out, *carried.columns], [*names, *carried.column_names]
    return pa.Table.from_arrays(out, names=names)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED_BYTES,
    block_bytes: int = 2 << 20, part_bytes: int = 16 << 20, carry: list[str] | None = None, as_text: bool = False,
) -> DataFrame:
    """(id, n_bytes, kept binary, removed array<struct<start, stop>>), one row for each row.

    The columns ``carry`` follow as they were; one named like a result gives way to it.  With ``as_text``, ``kept`` is a string: of a
    character that loses a byte, all bytes go.

    ``removed`` lists the maximal runs of removed bytes, on the bytes of the input.  Null texts
    are empty; texts shorter than ``width`` keep all.  A null id counts as smallest; repeated
    ids count as one id whose rows have equal claims, of which an arbitrary one leads (the
    results of identical rows are the same as a whole).  Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    carry = [c for c in carry or [] if c not in (id_col, "n_bytes", "kept", "removed")]
    src = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"),
        *(F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)),
    )
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in src.schema.fields[2:])
    blocks = materialize_bucketed(
        src.mapInArrow(lambda it: to_blocks(it, block_bytes), "block long, bytes long, payload binary"), "suffix", "block"
    )
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    parts = max(partitions(spark), -(-total // part_bytes))
    row = "block long, part int, payload binary"
    bare = blocks.select("block", "payload")
    seeds = bare.mapInArrow(lambda it: _seed_hashes(it, parts, width, seed), row)
    marks = seeds.groupBy("part").applyInArrow(trimmed(_repeated), row)
    runs = bare.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(
        trimmed_pair(lambda a, b: _runs(a, b, parts, width, seed)), row
    )
    hits = runs.groupBy("part").applyInArrow(trimmed(lambda g: _repeats(g, width)), row)
    kind = "string" if as_text else "binary"
    return bare.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(
        trimmed_pair(lambda a, b: _cut(a, b, width, as_text)),
        f"_id long, _n_bytes long, _kept {kind}, _removed array<struct<start:long,stop:long>>{more}",
    ).select(
        F.col("_id").alias(id_col), F.col("_n_bytes").alias("n_bytes"), F.col("_kept").alias("kept"),
        F.col("_removed").alias("removed"), *(F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)),
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each row of ``documents`` without repeated passages; null texts are empty."""
    width = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", width.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
