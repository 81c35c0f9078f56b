"""An inverted file of vectors: lists around centres, stored once, of which a search reads a few.

Centres are fitted on a bounded sample of vectors (``LISTS`` times ``EACH`` at most); every vector is then
put into the list of its nearest centre.  Lists are folders of Parquet files, so a search prunes to the
folders that it asks for; a list that holds many vectors is several files, read by several tasks.
Searches for many queries take lists in groups of some ``CHUNK`` vectors, so a query goes to each group
once however many of its lists it opens, and as many tasks compare as there are groups to meet.
How many lists a search opens is measured when the index is built: the nearest of ``ASKED`` of the
vectors are found by a scan of all, and as many lists are opened as find the wanted share of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderlake.operators import vectors

#: Most lists (their centres are sent to all tasks: 8 MB at 512 dimensions), sampled vectors a list, and
#: vectors whose nearest are counted to choose how many lists are opened.
LISTS, EACH, ASKED = 4096, 16, 128
#: Vectors of one list or group of lists, and queries, that meet in one task, queries that are compared at once,
#: and found rows that one task puts in order.
CHUNK, BLOCK, FOUND = 16384, 128, 1 << 19
_NEAR = "cle string, uid string, code_cpv string, similarite double"


def usable(rows: DataFrame) -> DataFrame:
    """(uid, code_cpv, objet_embedding) with a direction: null, empty, zero and non-finite vectors have none."""
    v = F.col("objet_embedding").cast("array<double>")
    size = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return rows.select(F.col("uid").cast("string").alias("uid"), F.col("code_cpv").cast("string").alias("code_cpv"), v.alias("objet_embedding")).where(
        (size > 0) & (size < float("inf")))


def _directed(queries: DataFrame) -> DataFrame:
    """(cle, vecteur) of the queries with a direction, a row a key."""
    rows = usable(queries.select(F.col("cle").alias("uid"), F.lit(None).cast("string").alias("code_cpv"), F.col("vecteur").alias("objet_embedding")))
    return rows.dropDuplicates(["uid"]).select(F.col("uid").alias("cle"), F.col("objet_embedding").alias("vecteur"))


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of unit length; all vectors must be of one size."""
    if not len(column):
        return np.zeros((0, 0))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().unique()
    if len(size) > 1:
        raise ValueError("vectors of several sizes")
    v = column.flatten().to_numpy().reshape(len(column), -1)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; the products of ``BLOCK`` rows are held at once."""
    return np.concatenate([np.zeros(0, np.int64), *((rows[at : at + BLOCK] @ centres.T).argmax(axis=1) for at in range(0, len(rows), BLOCK))])


def _groups(sizes: np.ndarray) -> np.ndarray:
    """The group of each list: lists one after another, ``CHUNK`` vectors at most; a longer list is a group alone."""
    out, held = [], 0
    for n in sizes.tolist():
        fresh = not out or held + n > CHUNK
        out.append(0 if not out else out[-1] + fresh)
        held = n if fresh else held + n
    return np.array(out, np.int64)


def _first(rows: DataFrame, n: int, total: int, order) -> DataFrame:
    """The ``n`` of ``total`` rows that ``order``, a hash of 64 bits, puts first.  Rows far behind are left out before they
    are put in order, so one task does not see all of them, unless equal hashes leave fewer than ``n``."""
    share = (n + 8 * n**0.5 + 64) / max(total, 1)
    if share < 1:
        near = rows.where(order < int(share * 2**64) - 2**63)
        rows = near if near.count() >= n else rows
    return rows.orderBy(order, "uid").limit(n)


def _fit(sample: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of unit length by k-means on cosines; a centre that no vector is near stays as it was."""
    centres = sample[np.sort(np.random.default_rng(seed).choice(len(sample), lists, replace=False))]
    for _ in range(rounds):
        own = _closest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1.0), centres)
    return centres


def _best(score: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest finite scores, ties to the smaller uid."""
    at = np.flatnonzero(score > -np.inf)
    if len(at) > k:
        some = score[at]
        at = at[some >= np.partition(some, len(at) - k)[len(at) - k]]
    return np.array(sorted(at.tolist(), key=lambda i: (-score[i], uids[i]))[:k], np.int64)


def _compare(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k nearest among ``rows`` of each query but itself; queries with ``listes`` see the rows of these lists."""
    out: dict[str, list] = {"cle": [], "uid": [], "code_cpv": [], "similarite": []}
    if queries.num_rows and rows.num_rows:
        listed = "listes" in queries.column_names
        if listed:  # queries that open like lists are compared at once
            queries = queries.take(np.argsort([x[0] for x in queries.column("listes").to_pylist()], kind="stable"))
            opened, of = queries.column("listes").to_pylist(), rows.column("liste").to_numpy()
        uids = np.array(rows.column("uid").to_pylist(), object)
        own: dict[str, list[int]] = {}
        for i, uid in enumerate(uids.tolist()):
            own.setdefault(uid, []).append(i)
        asked, held = _unit(queries.column("vecteur")), _unit(rows.column("objet_embedding"))
        keys, codes, every = queries.column("cle").to_pylist(), rows.column("code_cpv").to_pylist(), np.arange(len(uids))
        for at in range(0, len(keys), BLOCK):
            seen, some = every, keys[at : at + BLOCK]
            if listed:
                lists, place = np.unique(np.concatenate(opened[at : at + BLOCK]), return_inverse=True)
                open_ = np.zeros((len(some), len(lists)), bool)
                open_[np.repeat(np.arange(len(some)), [len(x) for x in opened[at : at + BLOCK]]), place] = True
                seen = np.flatnonzero(np.isin(of, lists))
            scores = np.round(asked[at : at + BLOCK] @ (held if seen is every else held[seen]).T, 6)
            if listed:
                scores[~open_[:, np.searchsorted(lists, of[seen])]] = -np.inf
            names = uids[seen]
            for cle, line in zip(some, scores):
                mine = own.get(cle, [])
                line[np.flatnonzero(np.isin(seen, mine)) if listed and mine else mine] = -np.inf
                for i in _best(line, names, k).tolist():
                    for name, value in zip(out, (cle, names[i], codes[seen[i]], float(line[i]))):
                        out[name].append(value)
    return pa.table(out, pa.schema([("cle", pa.string()), ("uid", pa.string()), ("code_cpv", pa.string()), ("similarite", pa.float64())]))


def _nearest_of(found: DataFrame, k: int) -> DataFrame:
    """(cle, rang, uid, code_cpv, similarite): the k best of each query over all that tasks have found."""
    order = Window.partitionBy("cle").orderBy(F.desc("similarite"), "uid")
    return found.withColumn("rang", F.row_number().over(order)).where(F.col("rang") <= k).select("cle", "rang", "uid", "code_cpv", "similarite")


def scan(rows: DataFrame, queries: DataFrame, k: int = vectors.NEIGHBOURS) -> DataFrame:
    """The same as ``VectorIndex.nearest`` over every vector, for a bounded number of queries (cle,
    vecteur), which are collected and sent to all tasks."""
    asked = _directed(queries).toArrow()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _compare(asked, pa.Table.from_batches([b]), k).to_batches()

    return _nearest_of(usable(rows).mapInArrow(run, _NEAR), k)


@dataclass(frozen=True)
class VectorIndex:
    """Lists (liste, uid, code_cpv, objet_embedding), their centres, sizes and pieces, and how many a search opens."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    sizes: np.ndarray
    lots: np.ndarray  # pieces of each list
    open: int

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema("uid string, code_cpv string, objet_embedding array<double>, liste int, lot int").parquet(f"{self.path}/listes")

    def lists(self, queries: np.ndarray, k: int, most: int | None = None) -> list[list[int]]:
        """The lists that each query opens, the nearest first: more than ``open`` where these hold no
        k + 1 vectors."""
        out = []
        for line in np.argsort(-(queries @ self.centres.T), axis=1, kind="stable"):
            held = np.cumsum(self.sizes[line])
            out.append(line[: max(most or self.open, int(np.searchsorted(held, k + 1)) + 1)].tolist())
        return out

    def similar(self, reference: list[float], k: int = vectors.NEIGHBOURS) -> DataFrame:
        """(uid, code_cpv, similarite) of the k nearest of one vector: the plan reads the folders of its lists only."""
        v = np.asarray(reference, np.float64)[None]
        size = float((v * v).sum())
        if not len(self.sizes) or not 0 < size < float("inf"):
            return self.rows.select("uid", "code_cpv", F.lit(0.0).alias("similarite")).limit(0)
        return vectors.similar(self.rows.where(F.col("liste").isin(self.lists(v / size**0.5, k)[0])), reference, k)

    def nearest(self, queries: DataFrame, k: int = vectors.NEIGHBOURS) -> DataFrame:
        """(cle, rang, uid, code_cpv, similarite): the k nearest of each query (cle, vecteur), ties to the
        smaller uid, without the vector whose uid is the query's own key.

        Queries go to the groups of lists they open; some ``CHUNK`` of them meet ``CHUNK`` vectors in
        a task, so a list that holds, or is asked by, a third of all vectors is shared out.  Meetings, and the
        rows they find, are dealt to as many tasks as bound what one holds.  Queries
        without a direction have no rows; an empty index gives an empty result; repeated keys count as one query.
        """
        asked, none = _directed(queries), "cle string, rang int, uid string, code_cpv string, similarite double"
        if not len(self.sizes):
            return self.spark.createDataFrame([], none)
        groups = _groups(self.sizes)
        bare = VectorIndex(None, self.path, self.centres, self.sizes, self.lots, self.open)  # what tasks need of it

        def grouped(lists: list[int]) -> list[tuple[int, list[int]]]:
            out: dict[int, list[int]] = {}
            for i, g in zip(lists, groups[lists].tolist()):
                out.setdefault(g, []).append(i)
            return list(out.items())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("groupe", pa.int32()), ("listes", pa.list_(pa.int32()))]))
            for b in batches:
                for at in range(0, b.num_rows, BLOCK):
                    some = b.slice(at, BLOCK)
                    opened = [[{"groupe": g, "listes": x} for g, x in grouped(lists)] for lists in bare.lists(_unit(some.column(1)), k)]
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(opened, kind)], names=["cle", "vecteur", "ouvre"])

        to = asked.mapInArrow(run, "cle string, vecteur array<double>, ouvre array<struct<groupe:int,listes:array<int>>>").select(
            "cle", "vecteur", F.inline("ouvre"))
        counts = {r["groupe"]: r["count"] for r in to.groupBy("groupe").count().collect()}  # a row a group
        if not counts:
            return self.spark.createDataFrame([], none)
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        lots = {g: int(self.lots[groups == g].max()) for g in counts}
        most = -(-tasks // sum(lots.values()))  # groups are few: queries are dealt to more tasks
        parts = {g: max(-(-n // CHUNK), min(most, -(-n // (8 * BLOCK)))) for g, n in counts.items()}
        sizes = F.broadcast(self.spark.createDataFrame([(g, n, lots[g]) for g, n in parts.items()], "groupe int, parts int, lots int"))
        lists = F.broadcast(self.spark.createDataFrame([(i, g, parts[g]) for i, g in enumerate(groups.tolist()) if g in parts], "liste int, groupe int, parts int"))
        to = to.join(sizes, "groupe").select(
            "cle", "vecteur", "listes", "groupe", F.pmod(F.xxhash64("cle"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
        held = self.rows.join(lists, "liste").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        compare = lambda q, r: _compare(q, r, k)
        meet = ["groupe", "lot", "part"]
        # Twice as many partitions as meetings, as some fall together.
        dealt = lambda rows: rows.repartition(max(tasks, 2 * sum(n * lots[g] for g, n in parts.items())), *meet).groupBy(*meet)
        found = dealt(to).cogroup(dealt(held)).applyInArrow(compare, _NEAR)
        return _nearest_of(found.repartition(max(tasks, -(-k * sum(n * lots[g] for g, n in counts.items()) // FOUND)), "cle"), k)


def build(rows: DataFrame, path: str, k: int = vectors.NEIGHBOURS, wanted: float = 0.97, lists: int | None = None, rounds: int = 10, seed: int = 42) -> VectorIndex:
    """An index of (uid, code_cpv, objet_embedding) below ``path``, which replaces one there.

    ``lists`` is the square root of the number of vectors by default, ``LISTS`` at most.  Every
    vector with a direction is indexed; vectors of another size than the others' raise.
    """
    spark, some = rows.sparkSession, usable(rows)
    total = some.count()
    count = max(1, min(LISTS, lists or round(total**0.5), total)) if total else 0
    order = F.xxhash64(F.lit(seed), "uid")
    centres = np.zeros((0, 0))
    if count:
        sample = _unit(_first(some, count * EACH, total, order).select("objet_embedding").toArrow().column(0))
        centres = _fit(sample, count, rounds, seed)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _closest(_unit(b.column(2)), centres) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32())], names=["uid", "code_cpv", "objet_embedding", "liste"])

    put_rows = some.mapInArrow(put, "uid string, code_cpv string, objet_embedding array<double>, liste int")
    pieces = put_rows.groupBy("liste").agg(F.ceil(F.count("*") / CHUNK).alias("lots"))  # a row a list
    dealt = put_rows.join(F.broadcast(pieces), "liste", "left").withColumn("lot", F.pmod(order, F.coalesce("lots", F.lit(1))).cast("int")).drop("lots")
    dealt.repartition("liste", "lot").write.mode("overwrite").partitionBy("liste", "lot").parquet(f"{path}/listes")
    sizes, lots = np.zeros(count, np.int64), np.zeros(count, np.int64)
    written = VectorIndex(spark, path, centres, sizes, lots, count)
    for r in written.rows.groupBy("liste").agg(F.count("*").alias("n"), (F.max("lot") + 1).alias("lots")).collect():
        sizes[r["liste"]], lots[r["liste"]] = r["n"], r["lots"]
    opened = _opened(written, some, total, order, k, wanted) if count > 1 else count
    head = json.dumps({"centres": centres.tolist(), "sizes": sizes.tolist(), "lots": lots.tolist(), "open": opened})
    spark.createDataFrame([(head,)], "index string").coalesce(1).write.mode("overwrite").parquet(f"{path}/tete")
    return VectorIndex(spark, path, centres, sizes, lots, opened)


def _opened(index: VectorIndex, some: DataFrame, total: int, order, k: int, wanted: float) -> int:
    """The least number of lists in which the wanted share of the nearest of ``ASKED`` vectors lie."""
    asked = _first(some, ASKED, total, order).select(F.col("uid").alias("cle"), F.col("objet_embedding").alias("vecteur"))
    where = index.rows.select("uid", "liste").join(F.broadcast(scan(some, asked, k).select("cle", "uid")), "uid").select("cle", "liste").collect()
    table = asked.toArrow()
    ranks = {c: {x: i for i, x in enumerate(line)} for c, line in zip(table.column("cle").to_pylist(), index.lists(_unit(table.column("vecteur")), k, len(index.sizes)))}
    depth = np.sort([ranks[r["cle"]][r["liste"]] for r in where])
    return int(depth[min(len(depth) - 1, int(np.ceil(wanted * len(depth))) - 1)]) + 1 if len(depth) else len(index.sizes)


def load(spark: SparkSession, path: str) -> VectorIndex:
    head = json.loads(spark.read.schema("index string").parquet(f"{path}/tete").first()["index"])
    return VectorIndex(spark, path, np.array(head["centres"]), np.array(head["sizes"], np.int64), np.array(head["lots"], np.int64), head["open"])
