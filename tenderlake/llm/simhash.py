"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within four bits of each other meet: each flips at most two of
the differing bits and both reach the same word.  Done on whole words that is 2,081
variants a fingerprint, so it is done in two tiers, without losing a link:

* Halves.  Four differing bits leave at most two in one 32-bit half, so every fingerprint
  emits, for both halves, all 33 variants within one bit.  Fingerprints that collide on a
  half are verified pair by pair where at most ``dense`` of them meet; of the pairs that hold
  only a spanning forest leaves the task, fewer rows than came in, with the same closure.
* Whole words.  Fingerprints of fuller buckets emit all 2,081 variants within two bits.
  All that meet on such a variant are within four bits of each other, so a star to the
  smallest of them states every link without listing pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import (connected_components, materialize, materialize_bucketed, pack, partitions, small_batches, table, to_blocks as _to_blocks, trim,
                      trimmed, trimmed_batches, trimmed_pair, unpack)

SEED = 42
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
#: All words of at most two set bits.
_BALL = np.array([0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))], np.uint64)
_CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of the word shingles of a whole text; a text without words gives zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    n = len(words) - width + 1
    hash_ = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        stop = min(n, at + _CHUNK)
        spans = zip(starts[at:stop].tolist(), ends[at + width - 1 : stop + width - 1].tolist())
        h = np.fromiter((hash_(joined[s:e], SEED) for s, e in spans), np.uint64, stop - at)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(_BITS[2 * votes > n].sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp long): one row for each row; null texts count as empty."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(trimmed_batches(run), "id long, fp long")


def _groups(batches):
    """Whole groups of equal keys as (keys, values) arrays from sorted batches.

    The last group of a batch is carried on, so no more than a batch and one group's
    carried part are held; ``_pairs`` and ``_stars`` bound the latter.
    """
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0).to_numpy(), batch.column(1).to_numpy()


def _forest(us, vs):
    """Those of the links (us, vs) that hold together what all of them hold together: a spanning
    forest.  Each root takes its link to the least smaller root, until no link joins two trees."""
    nodes, at = np.unique(np.concatenate([us, vs]), return_inverse=True)
    a, b = at[: len(us)], at[len(us) :]
    root, left, kept = np.arange(len(nodes)), np.arange(len(us)), [np.zeros(0, np.int64)]
    while True:
        x, y = root[a[left]], root[b[left]]
        left, high, low = left[x != y], np.maximum(x, y)[x != y], np.minimum(x, y)[x != y]
        if not len(left):
            kept = np.concatenate(kept)
            return us[kept], vs[kept]
        order = np.lexsort((low, high))
        one = order[np.concatenate([[True], np.diff(high[order]) > 0])]
        kept.append(left[one])
        root[high[one]] = low[one]
        while not np.array_equal(up := root[root], root):
            root = up


def _pairs(batches, dense: int, radius: int):
    """Verified links of small half buckets, as a forest; members of fuller ones, as (fp, null)."""

    def flush(keys, values, heavy):
        # heavy: whether the first group has already been found to be full
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(keys)]]))
        full = sizes > dense
        if heavy:
            full[0] = True
        members = values[np.repeat(full, sizes)]
        light = ~np.repeat(full, sizes)
        k, v = keys[light], values[light]
        us, vs = [], []
        for d in range(1, int(sizes[~full].max(initial=1))):
            same = np.flatnonzero(k[d:] == k[:-d])
            a, b = v[same], v[same + d]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
            us.append(a[near])
            vs.append(b[near])
        none = np.zeros(0, np.int64)
        return members, np.concatenate([none, *us]), np.concatenate([none, *vs])

    def rows(members, us, vs):
        links = np.unique(np.stack(_forest(np.maximum(us, vs), np.minimum(us, vs))), axis=1)
        members = np.unique(members)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([members, links[0]])),
                pa.concat_arrays([pa.nulls(len(members), pa.int64()), pa.array(links[1])]),
            ],
            names=["u", "v"],
        )

    keys = values = np.zeros(0, np.int64)
    heavy = False
    for k, v in _groups(batches):
        keys, values = np.concatenate([keys, k]), np.concatenate([values, v])
        last = int(np.searchsorted(keys, keys[-1]))
        if last == 0 and len(keys) <= dense and not heavy:
            continue
        if last == 0:  # one group fills all that is held, and it is full
            yield rows(*flush(keys, values, True))
            heavy, keys, values = True, keys[-1:], values[-1:]
            continue
        yield rows(*flush(keys[:last], values[:last], heavy))
        keys, values, heavy = keys[last:], values[last:], False
    yield rows(*flush(keys, values, heavy))


def _stars(batches):
    """Links of all members of a group to its smallest, from rows sorted by (key, value)."""
    key = low = None
    for k, v in _groups(batches):
        first = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
        lows = np.where(first, v, 0)
        at = np.maximum.accumulate(np.where(first, np.arange(len(k)), -1))
        least = np.where(at >= 0, lows[np.maximum(at, 0)], low if low is not None else 0)
        keep = least != v
        links = np.unique(np.stack([v[keep], least[keep]]), axis=1)
        key, low = k[-1], least[-1]
        yield pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], names=["u", "v"])


def links(fps: DataFrame, radius: int = 4, dense: int = 128) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fp`` whose closure is that of all pairs
    within ``radius`` (at most 4) bits; no pair outside that radius is linked."""
    if radius != 4:
        raise ValueError("the half balls are those of radius 4")
    n = partitions(fps.sparkSession)
    masks = F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(32)))
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    halves = fps.select("fp").distinct().select(
        "fp", F.explode(F.array(high, low.bitwiseOR(F.lit(1 << 32)))).alias("half")
    ).select("fp", "half", F.explode(masks).alias("mask")).select(F.col("half").bitwiseXOR(F.col("mask")).alias("key"), "fp")
    met = materialize(
        halves.repartition(n, "key").sortWithinPartitions("key").mapInArrow(trimmed_batches(lambda it: _pairs(it, dense, radius)), "u long, v long"),
        "halves",
    )
    full = met.where("v is null").select("u").distinct()

    def balls(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 64):
                part = fp[at : at + 64]
                variants = (part[:, None] ^ _BALL[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(variants), pa.array(np.repeat(part, len(_BALL)).view(np.int64))], names=["key", "fp"]
                )

    stars = (
        full.mapInArrow(trimmed_batches(balls), "key long, fp long").repartition(n, "key").sortWithinPartitions("key", "fp")
        .mapInArrow(trimmed_batches(_stars), "u long, v long")
    )
    return met.where("v is not null").unionByName(stars).distinct()


def components(fps: DataFrame) -> DataFrame:
    """(fp, component_id): the smallest id reachable from a fingerprint."""
    found = connected_components(links(fps))
    least = fps.groupBy("fp").agg(F.min("id").alias("id"))
    rooted = least.join(found, least["fp"] == found["node"], "left").select(
        "fp", "id", F.coalesce("component", "fp").alias("root")
    )
    low = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.select("fp", "root").join(low, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp long, component_id), one row for each row of ``docs``.

    Texts without words (null, empty, blank) have fingerprint zero and are linked like any
    other.  Repeated rows and ids stay; a null id stays null and never names a component
    unless the whole component has null ids.  Other columns are not read.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return fps.join(components(fps), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


#: Words of a long signature, and the differing bits of all of them at a similarity of 0.8:
#: shingle sets of Jaccard similarity J have the cosine 2J / (1 + J), and each bit differs
#: with probability acos(cosine) / pi, 0.15 at 0.8; 45 of 256 bits leave room for chance.
LONG_WORDS, LONG_RADIUS = 4, 45


#: Texts are near copies from this shingle-set similarity on, as a fraction.
LEAST = (4, 5)


class _Words(dict):
    """64-bit hashes of words; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


_WORDS = _Words()


def shingles(text: bytes, width: int) -> np.ndarray:
    """The set of word shingles of a whole text, as ascending hashes; empty without words.  A
    text of fewer words has one shingle, all of them."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(27)))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of ``LEAST`` or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= LEAST[0] * (len(a) + len(b) - both)


def signature(h: np.ndarray) -> np.ndarray:
    """256-bit SimHash of a set of shingles."""
    if not len(h):
        return np.zeros(LONG_WORDS, np.uint64)
    votes = np.zeros((LONG_WORDS, 64), np.int64)
    for at in range(0, len(h), _CHUNK):
        part = h[at : at + _CHUNK]
        for w in range(LONG_WORDS):
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes[w] += np.add.reduce(bits, axis=0, dtype=np.int64)
            part = part * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
            part ^= part >> np.uint64(31)
            part *= np.uint64(0xBF58476D1CE4E5B9)
            part ^= part >> np.uint64(30)
    return (_BITS * (2 * votes > len(h))).sum(axis=1, dtype=np.uint64)


def prefix(h: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, places): the shingles of which two alike sets share one, namely all but the
    last ``LEAST`` of a set, and one more, in one order for all sets.  ``often`` says how many
    texts hold each; the rarest come first, and those of one text are left out, as no other
    text shares them.  The order decides how many sets meet, not which pairs must."""
    n = len(h) - -(-LEAST[0] * len(h) // LEAST[1]) + 1 if len(h) else 0
    order = np.lexsort((h, often))[:n]
    place = np.flatnonzero(often[order] > 1)
    return h[order[place]], place


def profile(h: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall into each of 256 classes, 255 at most."""
    return np.minimum(np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8)


def _sets(raw: bytes, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    return [shingles(raw[i:j], width) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _hold(batches, parts: int, width: int):
    """Rows (block, part, payload): the distinct 40-bit shingles of a block that fall into a part,
    and how many of its texts hold each, 255 at most."""
    for b in batches:
        for block, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            _, bounds, raw, _ = unpack(blob)
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *_sets(raw, bounds, width)]) >> np.uint64(24), return_counts=True)
            part, rows = (h % np.uint64(parts)).astype(np.int64), []
            for p in np.unique(part):
                own = part == p
                five = np.ascontiguousarray(h[own].view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()
                rows.append((block, int(p), pack((five, np.minimum(n[own], 255).astype(np.uint8).tobytes()))))
            if rows:
                yield _parts(rows)
        trim()


def _parts(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], names=["block", "part", "payload"])


def _count(group: pa.Table) -> pa.Table:
    """For each block of a part, the level of each of its shingles: the number of texts that hold
    it up to 128, then eight levels for each doubling."""
    got = []
    for blob in group.column("payload").to_pylist():
        five, n = unpack(blob)
        h = np.zeros((len(n), 8), np.uint8)
        h[:, :5] = np.frombuffer(five, np.uint8).reshape(5, -1).T
        got.append((h.view(np.uint64).ravel(), np.frombuffer(n, np.uint8)))
    every, place = np.unique(np.concatenate([h for h, _ in got]), return_inverse=True)
    total = np.bincount(place, np.concatenate([n for _, n in got]), minlength=len(every))
    level = np.minimum(np.where(total <= 128, total, 128 + 8 * np.log2(np.maximum(total, 128) / 128)), 255).astype(np.uint8)
    cuts = np.cumsum([len(h) for h, _ in got])[:-1]
    return pa.table({
        "block": group.column("block"), "part": group.column("part"),
        "payload": pa.array([pack(x.tobytes()) for x in np.split(level[place], cuts)], pa.binary()),
    })


def _sign(left: pa.Table, right: pa.Table, parts: int, width: int) -> pa.Table:
    """A row for each text of a block: its set's hash and size and, where it shares a shingle of
    its prefix, the prefix, signature and profile."""
    block, (ids, bounds, raw, _) = left.column("block")[0].as_py(), unpack(left.column("payload")[0].as_py())
    sets = _sets(raw, bounds, width)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    h, at = np.unique(flat >> np.uint64(24), return_inverse=True)
    part, level = (h % np.uint64(parts)).astype(np.int64), np.zeros(len(h), np.uint8)
    for p, blob in zip(right.column("part").to_pylist(), right.column("payload").to_pylist()):
        level[part == p] = np.frombuffer(unpack(blob), np.uint8)
    often = np.split(level[at], np.cumsum([len(x) for x in sets])[:-1]) if sets else []
    keys = [prefix(x, n) for x, n in zip(sets, often)]
    met = [len(k) > 0 for k, _ in keys]
    sig = np.array([signature(x if m else x[:0]) for x, m in zip(sets, met)], np.uint64).reshape(-1, LONG_WORDS).view(np.int64)
    long = lambda x: pa.array(x, pa.int64())
    return pa.table({
        "block": long([block] * len(ids)), "row": long(range(len(ids))), "id": long(ids),
        "hash": long(np.array([xxhash.xxh64_intdigest(raw[i:j], SEED) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())], np.uint64).view(np.int64)),
        "node": long(np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)),
        "size": long([len(x) for x in sets]),
        **{f"s{w}": pa.array(np.ascontiguousarray(sig[:, w])) for w in range(LONG_WORDS)},
        "prefix": pa.array([k.tobytes() for k, _ in keys], pa.binary()), "places": pa.array([p.astype(np.int32).tobytes() for _, p in keys], pa.binary()),
        "profile": pa.array([profile(x).tobytes() if m else b"" for x, m in zip(sets, met)], pa.binary()),
    })


def _met(batches):
    """The rows of groups of two or more, from rows sorted by key."""
    held = None
    for k, v in _groups(batches):
        if held is not None:
            k, v = np.concatenate([held[0], k]), np.concatenate([held[1], v])
        same = k[1:] == k[:-1]
        again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        held = None if again[-1] else (k[-1:], v[-1:])
        # The last row of a group that goes on in the next batch is met there by the row kept for it.
        if again[-1]:
            held = (k[-1:], v[-1:])
        yield pa.RecordBatch.from_arrays([pa.array(k[again]), pa.array(v[again])], names=["key", "node"])


def _lead(batches, radius: int):
    """Links of the members of a group to its leaders: each row within ``radius`` bits of a
    leader is linked to it, any other becomes a leader.  Work and links grow with rows times
    leaders, not with pairs.  A row is not compared with later rows once it has a leader;
    ``_cross`` takes such pairs where their components are still apart."""
    key, leaders, names = None, np.zeros((0, LONG_WORDS), np.uint64), np.zeros(0, np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        k, v = b.column(0).to_numpy(), b.column(1).to_numpy()
        x = np.stack([b.column(2 + w).to_numpy() for w in range(LONG_WORDS)], axis=1).view(np.uint64)
        cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        us, vs = [], []
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if k[s] != key:
                key, leaders, names = k[s], leaders[:0], names[:0]
            rest, at = x[s:e], v[s:e]
            n = 0
            while len(rest):
                if n == len(leaders):
                    leaders, names = np.concatenate([leaders, rest[:1]]), np.concatenate([names, at[:1]])
                near = np.bitwise_count(rest ^ leaders[n]).sum(axis=1) <= radius
                us.append(at[near])
                vs.append(np.full(int(near.sum()), names[n]))
                rest, at = rest[~near], at[~near]
                n += 1
        u, w = np.concatenate(us), np.concatenate(vs)
        links_ = np.unique(np.stack([u[u != w], w[u != w]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(links_[0]), pa.array(links_[1])], names=["u", "v"])


def _cross(batches, most: int = 1 << 17):
    """Pairs (u, v, cu, cv) of a group that lie in different components and whose sizes and
    places of the shared shingle allow that they are alike; rows come sorted by key."""

    def rows(parts):
        pairs = np.unique(np.concatenate(parts, axis=1), axis=1) if parts else np.zeros((4, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["u", "v", "cu", "cv"])

    def near(n, at, i, j):
        """Whether rows i and j may be alike: from the sizes, and from what is left after the shared place."""
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        upto = np.minimum(n[i] - at[i], n[j] - at[j])
        return (small * LEAST[1] >= large * LEAST[0]) & (upto * (LEAST[0] + LEAST[1]) >= LEAST[0] * (n[i] + n[j]))

    held, parts, size = None, [], 0
    for b in batches:
        if not b.num_rows:
            continue
        k, v, c, n, at = (b.column(i).to_numpy() for i in range(5))
        if held is not None:
            k, v, c, n, at = (np.concatenate(x) for x in zip(held, (k, v, c, n, at)))
        fresh = 0 if held is None else len(held[0])  # pairs of held rows have been taken
        last = int(np.searchsorted(k == k[-1], True)) if k[0] != k[-1] else 0
        first = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
        longest = int(np.diff(np.concatenate([first, [len(k)]])).max())
        for d in range(1, longest):
            j = np.arange(max(fresh, d), len(k))
            j = j[k[j] == k[j - d]]
            j = j[c[j] != c[j - d]]
            j = j[near(n, at, j, j - d)]
            if len(j):
                i, swap = j - d, v[j] < v[j - d]
                x, y = np.where(swap, i, j), np.where(swap, j, i)
                parts.append(np.stack([v[x], v[y], c[x], c[y]]))
                size += len(j)
            if size > most:
                yield rows(parts)
                parts, size = [], 0
        held = tuple(x[last:] for x in (k, v, c, n, at))
    yield rows(parts)


def _alike(pairs: DataFrame, nodes: DataFrame, blocks: DataFrame, shingle: int) -> DataFrame:
    """The rows of ``pairs`` (u, v and others) whose texts are alike by their whole sets of shingles.

    Two sets differ by at least as many shingles as their profiles do, so a pair whose profiles
    differ by more than alike sets can is settled without its texts.  The other texts are taken
    from their blocks, which stay where they are.
    """
    names = pairs.columns
    kinds = ", ".join(f"{c} long" for c in names)

    def may_be(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(b.num_columns - i).to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16) for i in (4, 2))
            n = b.column(b.num_columns - 3).to_numpy() + b.column(b.num_columns - 1).to_numpy()
            apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
            yield b.select(range(len(names))).filter(pa.array(apart * (LEAST[0] + LEAST[1]) <= (LEAST[1] - LEAST[0]) * n))

    ends = [nodes.select(F.col("node").alias(c), F.col("profile").alias(f"p{c}"), F.col("size").alias(f"n{c}")) for c in "uv"]
    seen = pairs.join(ends[0], "u").join(ends[1], "v").select(*names, "pu", "nu", "pv", "nv")
    pairs = materialize(seen.mapInArrow(trimmed_batches(may_be), kinds), "close")
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    asked = nodes.join(ends, "node").select("f.block", "f.row", "node")

    def texts(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            _, bounds, raw, _ = unpack(left.column("payload")[0].as_py())
            found = [raw[bounds[i] : bounds[i + 1]] for i in right.column("row").to_pylist()]
        return pa.table({"node": right.column("node") if found else pa.array([], pa.int64()), "text": pa.array(found, pa.binary())})

    held = materialize(blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(trimmed_pair(texts), "node long, text binary"), "texts")
    left, right = held.select(F.col("node").alias("v"), F.col("text").alias("y")), held.select(F.col("node").alias("u"), F.col("text").alias("x"))

    def check(batches):
        key = one = None
        for b in batches:
            keep = []
            for u, x, y in zip(*(b.column(b.num_columns - i).to_pylist() for i in (3, 2, 1))):
                if u != key:
                    key, one = u, shingles(x, shingle)
                keep.append(alike(one, shingles(y, shingle)))
            yield b.select(range(len(names))).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(left, "v").join(right, "u").select(*names, F.col("u").alias("_u"), "x", "y")
    return materialize(met.mapInArrow(trimmed_batches(check), kinds), "alike")


def _signed(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, block_bytes: int = 2 << 20, part_bytes: int = 32 << 20
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, rows by set of shingles, (node, component)).

    1. Documents are stored once in blocks.  Blocks exchange their shingles, as sorted byte
       planes, to count over all documents how many texts hold each, and get the counts back.
    2. Two alike sets share one of their rarest shingles (``prefix``).  A text that shares none
       of these has no near copy and goes no further.
    3. SimHash: 256-bit signatures are taken as eight 32-bit words; every word emits all variants
       within one bit, and those that collide on any are compared on all 256 bits.  That joins
       most near copies, dense groups among them, by few pairs, but neither all pairs of 0.8 or
       more nor only such, so each pair found is decided by its whole sets.
    4. Pairs that are still in different components meet on the shingles of their prefixes and
       are decided likewise: no pair of 0.8 or more is left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    cols = [f"s{w}" for w in range(LONG_WORDS)]
    src = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(text_col).isNull().alias("_null"),
        *(F.col(c).alias(f"_carry{i}") for i, c in enumerate(docs.columns) if c != text_col),
    )
    stored = materialize_bucketed(src.mapInArrow(lambda it: _to_blocks(it, block_bytes), "block long, bytes long, payload binary"), "near", "block")
    total = stored.agg(F.sum("bytes")).first()[0] or 0
    blocks, parts, row = stored.select("block", "payload"), max(n, -(-total // part_bytes)), "block long, part int, payload binary"
    held = blocks.mapInArrow(lambda it: _hold(it, parts, shingle), row)
    levels = held.groupBy("part").applyInArrow(trimmed(_count), row)
    longs = ", ".join(f"{c} long" for c in cols)
    signed = materialize(
        blocks.groupBy("block").cogroup(levels.groupBy("block")).applyInArrow(
            trimmed_pair(lambda a, b: _sign(a, b, parts, shingle)),
            f"block long, row long, id long, hash long, node long, size long, {longs}, prefix binary, places binary, profile binary",
        ), "signatures",
    )
    whole = ("size", "prefix", "places", "profile", *cols)
    firsts = materialize(
        signed.where(F.length("prefix") > 0).groupBy("node").agg(_first(), *(F.first(c).alias(c) for c in whole)), "firsts"
    )
    nodes = firsts.select("node", *cols)
    low, high = (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))), (lambda c: F.shiftrightunsigned(c, 32))
    words = [f(c).bitwiseOR(F.lit(i << 32)) for i, (c, f) in enumerate((c, f) for c in cols for f in (low, high))]
    masks = F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(32)))
    variants = (
        nodes.select("node", F.explode(F.array(*words)).alias("word")).select("node", "word", F.explode(masks).alias("mask"))
        .select(F.col("word").bitwiseXOR(F.col("mask")).alias("key"), "node")
    )
    met = materialize(variants.repartition(n, "key").sortWithinPartitions("key").mapInArrow(trimmed_batches(_met), "key long, node long"), "met")
    led = (
        met.distinct().join(nodes, "node").select("key", "node", *cols).repartition(n, "key")
        .sortWithinPartitions("key", "node").mapInArrow(trimmed_batches(lambda it: _lead(it, radius)), "u long, v long")
    )
    close = connected_components(_alike(materialize(led.distinct(), "led"), firsts, blocks, shingle))

    def heads(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                keys = [np.frombuffer(x, np.int64) for x in part.column(3).to_pylist()]
                at = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int32) for x in part.column(4).to_pylist())])
                lens = [len(x) for x in keys]
                cols_ = [np.repeat(part.column(c).to_numpy(), lens) for c in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (np.concatenate([np.zeros(0, np.int64), *keys]), *cols_, at.astype(np.int64))], names=["key", "node", "c", "n", "at"]
                )

    schema = "key long, node long, c long, n long, at long"
    rooted = firsts.join(close, "node", "left").select("node", F.coalesce("component", "node").alias("c"), "size", "prefix", "places")
    pairs = (
        rooted.mapInArrow(trimmed_batches(heads), schema).repartition(n, "key").sortWithinPartitions("key", "node")
        .mapInArrow(trimmed_batches(_cross), "u long, v long, cu long, cv long").distinct()
    )
    more = _alike(materialize(pairs, "pairs"), firsts, blocks, shingle).select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    wider = connected_components(more).select(F.col("node").alias("c"), F.col("component").alias("wide"))
    roots = rooted.join(wider, "c", "left").select("node", F.coalesce("wide", "c").alias("component"))
    return blocks, signed.select("block", "row", "id", "hash", "node"), materialize(roots, "roots")


def _first():
    """The leader of a group: its least (id, hash), null ids last; of equal rows an arbitrary one."""
    return F.min(F.struct(F.col("id").isNull().alias("n"), "id", "hash", "block", "row")).alias("f")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = LONG_RADIUS) -> DataFrame:
    """(id, hash, lead, lead_hash): the group leader of each row by shingle-set similarity.
    ``hash`` is that of the text, so rows of one id stay apart; a null text counts as empty,
    and texts without words are copies of each other."""
    _, signed, found = _signed(docs, id_col, text_col, shingle, radius)
    rooted = signed.join(found, "node", "left").withColumn("root", F.coalesce("component", "node"))
    first = rooted.groupBy("root").agg(_first())
    return rooted.select("id", "hash", "root").join(first, "root").select("id", "hash", F.col("f.id").alias("lead"), F.col("f.hash").alias("lead_hash"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = LONG_RADIUS) -> DataFrame:
    """One row of ``docs`` for each group of ``similar``: its leader, with all its columns.

    Texts without words, null ones too, are copies of each other.  Of repeated rows (equal id
    and text) an arbitrary one stays.  An empty table gives an empty result.  Copies are reduced
    before they move, so neither a set nor a component that many rows share lands in one task;
    texts are not shuffled, as leaders are taken from their blocks.
    """
    blocks, signed, found = _signed(docs, id_col, text_col, shingle, radius)
    nodes = signed.groupBy("node").agg(_first()).join(found, "node", "left")
    first = nodes.groupBy(F.coalesce("component", "node").alias("root")).agg(F.min("f").alias("f"))
    kept = materialize(first.select("f.block", "f.row"), "kept")
    fields = [f for f in docs.schema.fields if f.name != text_col]

    def take(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, bounds, raw, carried = unpack(left.column("payload")[0].as_py())
        rows = pa.array(sorted(right.column("row").to_pylist()), pa.int64())
        null = carried.column(0).to_pylist()
        text = [None if null[i] else raw[bounds[i] : bounds[i + 1]] for i in rows.to_pylist()]
        return pa.Table.from_arrays(
            [pa.array(text, pa.binary()).cast(pa.string()), *(c.take(rows) for c in carried.columns[1:])], names=["_text", *(f"_c{i}" for i in range(len(fields)))]
        )

    schema = "".join(f", _c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))
    out = blocks.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(trimmed_pair(take), f"_text string{schema}")
    place = {f.name: F.col(f"_c{i}") for i, f in enumerate(fields)} | {text_col: F.col("_text")}
    return out.select(*(place[c].alias(c) for c in docs.columns))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each row of ``documents``; texts without words, null ones
    too, have fingerprint zero and are linked like any other."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
