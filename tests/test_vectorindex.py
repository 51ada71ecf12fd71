"""The persisted vector index: exact by bounds, whole after changes, measured when approximate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomill.operators import vectorindex
from foliomill.operators.vectorindex import VectorIndex

rng = np.random.default_rng(6)
CENTRES = rng.normal(size=(12, 10)) * 3
POINTS = CENTRES[rng.integers(0, 12, 900)] + rng.normal(size=(900, 10))
POINTS[100:160] = POINTS[100]  # ties


def frame(spark, points, names="id long, vector array<double>"):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in points.items()], names).repartition(3)


def brute(points, queries, k, own=True):
    out = {}
    for q, x in queries.items():
        near = sorted((float(np.sqrt(np.square(np.asarray(x) - v).sum())), i) for i, v in points.items() if own or i != q)
        out[q] = [(i, round(d, 9)) for d, i in near[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["id"], round(r["distance"], 9)))
    return out


@pytest.fixture(scope="module")
def points():
    return dict(enumerate(POINTS))


@pytest.fixture(scope="module")
def index(spark, points, tmp_path_factory):
    return VectorIndex(spark, str(tmp_path_factory.mktemp("vectors"))).build(frame(spark, points), list_rows=60)


@pytest.fixture(scope="module")
def queries(points):
    return {i: points[i] for i in range(0, 900, 30)} | {5000: np.zeros(10), 5001: np.full(10, 40.0), 5002: points[100]}


@pytest.mark.parametrize("k, own", [(1, True), (7, True), (7, False), (70, False)])
def test_exact_search_equals_all_pairs(spark, index, points, queries, k, own):
    asked = frame(spark, queries, "query_id long, query array<double>")
    assert found(index.nearest(asked, k, leave_out_own=not own)) == brute(points, queries, k, own)


def test_small_blocks_change_nothing(spark, index, points, queries, monkeypatch):
    monkeypatch.setattr(vectorindex, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vectorindex, "BLOCK_QUERIES", 3)
    assert found(index.nearest(frame(spark, queries, "query_id long, query array<double>"), 5)) == brute(points, queries, 5)


def test_bounds_leave_lists_out(spark, index, queries):
    """What is read for one near query is a part of the index."""
    asked = frame(spark, {1: POINTS[1]}, "query_id long, query array<double>")
    read = []
    real = vectorindex.blocks_of

    def counted(rows, asked, lengths, kept):
        read.append(asked.count())
        return real(rows, asked, lengths, kept)

    vectorindex.blocks_of = counted
    try:
        index.nearest(asked, 3).collect()
    finally:
        vectorindex.blocks_of = real
    assert sum(read) < index.info().first()["lists"] / 2


def test_only_allowed_ids(spark, index, points, queries):
    may = {i: v for i, v in points.items() if i % 9 == 0}
    ids = spark.createDataFrame([(i,) for i in may] + [(None,), (99_999,)], "book long")
    assert found(index.nearest(frame(spark, queries, "query_id long, query array<double>"), 6, where=ids)) == brute(may, queries, 6)
    few = spark.createDataFrame([(3,), (4,)], "book long")
    assert {len(x) for x in found(index.nearest(frame(spark, queries, "query_id long, query array<double>"), 6, where=few)).values()} == {2}


def test_recall_of_some_lists(spark, index, points, queries):
    asked = frame(spark, {i: points[i] for i in range(0, 900, 10)}, "query_id long, query array<double>")
    exact, some = found(index.nearest(asked, 10)), found(index.nearest(asked, 10, lists=5))
    assert np.mean([len(set(exact[q]) & set(some[q])) / 10 for q in exact]) >= 0.9


def test_changes(spark, points, queries, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "v")).build(frame(spark, points), list_rows=100)
    index.build(frame(spark, points | {2000: np.ones(10)}))
    assert index.info().first()["vectors"] == 901 and index.rows().groupBy("id").count().filter("count > 1").isEmpty()
    index.upsert(frame(spark, {1: np.zeros(10), 2001: np.full(10, 2.0)}))
    index.delete(spark.createDataFrame([(2,), (None,), (31_000,)], "id long"))
    now = points | {2000: np.ones(10), 1: np.zeros(10), 2001: np.full(10, 2.0)}
    del now[2]
    asked = frame(spark, queries, "query_id long, query array<double>")
    assert found(index.nearest(asked, 4)) == brute(now, queries, 4)
    assert index.info().first()["segments"] == 4
    index.compact()
    index.versions.sweep()
    assert index.info().first()["segments"] == 1
    assert found(index.nearest(asked, 4)) == brute(now, queries, 4)
    index.build(frame(spark, {7: np.ones(10)}), force=True)
    assert [r["id"] for r in index.rows().collect()] == [7]


def test_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 5.0]), (None, [1.0, 1.0]), (2, None), (3, []), (4, [1.0, None]), (5, [float("nan"), 0.0]), (6, [float("inf"), 1.0]), (7, [0.0, 0.0])], "id long, vector array<double>")
    index = VectorIndex(spark, str(tmp_path / "v")).build(rows)
    assert {r["id"]: r["vector"] for r in index.rows().collect()} == {1: [0.0, 5.0], 7: [0.0, 0.0]}
    with pytest.raises(Exception, match="2 components"):
        index.upsert(frame(spark, {9: np.ones(3)}))
    assert index.rows().count() == 2
    empty = VectorIndex(spark, str(tmp_path / "e")).build(rows.limit(0))
    assert empty.rows().count() == 0
    assert empty.nearest(spark.createDataFrame([(1, [1.0])], "query_id long, query array<double>"), 3).collect() == []
    with pytest.raises(ValueError):
        VectorIndex(spark, str(tmp_path / "none")).rows()


def test_registered_recall(spark):
    from foliomill import registry

    r = registry.queries()["knn_join_recall"](spark, "/root/testdata/sf0.001").first()
    assert r["wanted"] > 0 and r["recall"] >= 0.5
