"""The inverted file of vectors against a scan of all."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlake import cli
from tenderlake.operators import vector_index, vectors
from tenderlake.plans import procurement

SMALL = "/root/testdata/sf0.001"
ROW = "uid string, code_cpv string, objet_embedding array<double>"


def _asked(rows):
    return rows.select(F.col("uid").alias("cle"), F.col("objet_embedding").alias("vecteur"))


def _sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cle"], {})[r["uid"]] = r["similarite"]
    return out


def test_scan_by_brute_force(spark):
    rows = procurement._vectors(spark, SMALL)
    have = {r["uid"]: np.array(r["objet_embedding"], float) for r in rows.collect()}
    got = _sets(vector_index.scan(rows, _asked(rows.where("uid % 100 = 0")), 7))
    for cle, near in got.items():
        cos = {u: round(float(v @ have[cle] / np.sqrt((v @ v) * (have[cle] @ have[cle]))), 6) for u, v in have.items() if u != cle}
        assert list(near.values()) == pytest.approx([cos[u] for u in sorted(cos, key=lambda u: (-cos[u], u))[:7]], abs=2e-6)


def test_recall_of_the_index(spark, tmp_path, monkeypatch):
    rows = procurement._vectors(spark, SMALL)
    asked = _asked(rows.where("uid % 10 = 0"))
    exact = _sets(vector_index.scan(rows, asked))
    index = vector_index.build(rows, str(tmp_path / "a"))
    assert index.rows.count() == vector_index.usable(rows).count() == int(index.sizes.sum())
    near = _sets(index.nearest(asked))
    assert all(n.items() <= {**exact[c], **n}.items() and len(n) == len(exact[c]) for c, n in near.items()) and set(near) == set(exact)
    recall = sum(len(exact[c].keys() & near[c].keys()) for c in exact) / sum(map(len, exact.values()))
    assert recall >= 0.95
    assert _sets(vector_index.load(spark, str(tmp_path / "a")).nearest(asked)) == near
    # All lists opened find what a scan finds, with lists and queries in many pieces too.
    monkeypatch.setattr(vector_index, "CHUNK", 9)
    many = vector_index.build(rows, str(tmp_path / "b"), lists=5, wanted=1.0)
    whole = vector_index.VectorIndex(spark, many.path, many.centres, many.sizes, many.lots, 5)
    assert _sets(whole.nearest(asked)) == exact and max(r["lot"] for r in many.rows.select("lot").distinct().collect()) > 2


def test_one_vector_reads_its_lists(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(f"{g}-{i}", str(g), (np.eye(8)[g] + rng.normal(0, 0.05, 8)).tolist()) for g in range(8) for i in range(40)], ROW)
    index = vector_index.build(rows, str(tmp_path), k=10, lists=8)
    got = index.similar(np.eye(8)[3].tolist(), 10)
    assert {r["code_cpv"] for r in got.collect()} == {"3"} and "PartitionFilters: [isnotnull(liste" in got._jdf.queryExecution().toString() or index.open == 8
    want = vectors.similar(rows, np.eye(8)[3].tolist(), 10)
    assert [r["uid"] for r in got.collect()] == [r["uid"] for r in want.collect()]
    votes = vectors.vote(index.nearest(_asked(rows.where("uid LIKE '%-7'")), 10), 0.5, "cle").collect()
    assert {(r["cle"][0], r["code_cpv"]) for r in votes} == {(str(g), str(g)) for g in range(8)}


def test_odd_vectors(spark, tmp_path):
    odd = [("a", "1", [1.0, 0.0]), ("b", "1", [2.0, 0.0]), ("c", None, [0.0, 1.0]), ("d", "2", None), ("e", "2", []), ("f", "2", [0.0, 0.0]),
           ("g", "2", [float("nan"), 1.0]), ("h", "2", [float("inf"), 1.0]), ("i", "2", [None, 1.0]), ("b", "1", [2.0, 0.0])]
    rows = spark.createDataFrame(odd, ROW).withColumn("liste", F.lit("clash"))
    index = vector_index.build(rows, str(tmp_path / "odd"))
    got = index.nearest(_asked(rows), 5).orderBy("cle", "rang").collect()
    assert {r["cle"] for r in got} == {"a", "b", "c"}  # the others have no direction
    assert [(r["uid"], r["similarite"]) for r in got if r["cle"] == "a"] == [("b", 1.0), ("b", 1.0), ("c", 0.0)]
    assert [r["uid"] for r in got if r["cle"] == "b"] == ["a", "c"] and index.similar([0.0, 0.0]).count() == 0
    none = vector_index.build(rows.limit(0), str(tmp_path / "none"))
    assert none.nearest(_asked(rows)).count() == 0 and none.similar([1.0, 0.0]).count() == 0
    assert vector_index.load(spark, str(tmp_path / "none")).nearest(_asked(rows)).count() == 0
    with pytest.raises(cli.Ambiguous):
        cli.category(none, "texte")


def test_told_categories(spark):
    rows = procurement._vectors(spark, SMALL)
    got = {r["cle"]: r for r in procurement.told_categories(spark, SMALL).collect()}
    unknown = rows.where("code_cpv IS NULL")
    want = {r["cle"]: r for r in vectors.vote(vector_index.scan(rows, _asked(unknown)), 0.0, "cle").collect()}
    assert got.keys() == want.keys()
    assert sum(got[c]["code_cpv"] == want[c]["code_cpv"] for c in want) >= 0.9 * len(want)


def test_meetings_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """Many lists are one group, a query goes there once, and partitions grow with what meets and what is found."""
    assert vector_index._groups(np.array([9000, 9000, 40000, 1, 16383, 1])).tolist() == [0, 1, 2, 3, 3, 4]
    rows = procurement._vectors(spark, SMALL)
    asked = _asked(rows.where("uid % 10 = 0"))
    index = vector_index.build(rows, str(tmp_path / "a"), lists=12, wanted=1.0)
    whole = vector_index.VectorIndex(spark, index.path, index.centres, index.sizes, index.lots, 12)
    exact = _sets(vector_index.scan(rows, asked))
    assert _sets(whole.nearest(asked)) == exact
    monkeypatch.setattr(vector_index, "CHUNK", 150)
    monkeypatch.setattr(vector_index, "FOUND", 100)
    got = whole.nearest(asked)
    plan = got._jdf.queryExecution().executedPlan().toString()
    met, found = (max(int(n) for n in re.findall(rf"hashpartitioning\({c}#[^)]*, (\d+)\), REPARTITION_BY_NUM", plan)) for c in ("groupe", "cle"))
    groups = int(vector_index._groups(index.sizes)[-1]) + 1
    assert 1 < groups < 12 and met >= 2 * groups and found * 100 >= 20 * groups * len(exact)
    assert _sets(got) == exact


def test_samples_are_the_first_by_hash(spark):
    rows = spark.range(20000).select(F.col("id").cast("string").alias("uid"))
    order = F.xxhash64(F.lit(42), "uid")
    first = [r["uid"] for r in rows.orderBy(order, "uid").limit(50).collect()]
    got = vector_index._first(rows, 50, 20000, order)
    assert [r["uid"] for r in got.collect()] == first and "<" in got._jdf.queryExecution().optimizedPlan().toString()
    same = rows.withColumn("uid", F.lit("7"))  # equal hashes: none may be left out
    assert vector_index._first(same, 50, 20000, order).count() == 50
