"""The trained index against the flat one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cell_index
from tessera.operators.vector_index import FlatIndex, make_index

SCHEMA = "vec_id long, embedding array<double>"


def clustered(n=600, groups=12, d=6, spread=0.05, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, d)) * 3
    return [(i, [float(x) for x in middle[i % groups] + spread * rng.normal(size=d)]) for i in range(n)]


def rows_of(df):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.distance, 6)) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_answers_are_those_of_a_flat_index(spark, metric, monkeypatch):
    monkeypatch.setattr(cell_index, "PART_ROWS", 50)
    monkeypatch.setattr(cell_index, "PART_QUERIES", 20)
    monkeypatch.setattr(cell_index, "SLICE", 7)
    rows = clustered() + [(1000 + i, clustered()[5][1]) for i in range(300)]  # a third are copies
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    queries = df.where("vec_id % 7 = 0 or vec_id > 1200").withColumnRenamed("vec_id", "query_id")
    want = rows_of(FlatIndex(df, metric).search_batch(queries, 5))
    index = make_index(df, "IVF12,Flat", metric)
    assert not index.is_trained
    index.train().build()
    assert index.is_trained and sum(n for n, _, _ in index.stats.values()) == len(rows)
    assert rows_of(index.search_batch(queries, 5)) == want and 0 < index.read < index.of / 2
    joined = index.nearest_join(queries, 5, counts=True)
    assert rows_of(joined) == want
    met = sum(r.compared for r in joined.select("query_id", "compared").distinct().collect())
    assert met < queries.count() * len(rows) * 0.6


def test_vectors_without_structure(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=20)]) for i in range(200)], SCHEMA)
    queries = df.withColumnRenamed("vec_id", "query_id")
    index = make_index(df, "IVF8,Flat").train().build()
    want = rows_of(FlatIndex(df).search_batch(queries, 3))
    assert rows_of(index.search_batch(queries, 3)) == want == rows_of(index.nearest_join(queries, 3))


def test_edge_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [0.0, 0.0]), (None, [1.0, 1.0]), (8, [0.5, 0.5])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("cell", "radius", "v", "limit", "at")})
    for metric, found in (("l2", {1, 7, 8}), ("cosine", {1, 8})):
        index = make_index(df, "IVF3,Flat", metric).train().build()
        queries = df.where("vec_id is not null").withColumnRenamed("vec_id", "query_id")
        for got in (index.search_batch(queries, 9), index.nearest_join(queries, 9)):
            assert {r.vec_id for r in got.collect()} == found == {r.query_id for r in got.collect()}
    empty = make_index(df.limit(0), "IVF3,Flat").train().build()
    assert empty.search_batch(queries).count() == 0 == empty.nearest_join(queries).count()
    assert index.search_batch(queries.limit(0)).count() == 0 == index.nearest_join(queries.limit(0)).count()


def test_descriptors(spark):
    df = spark.createDataFrame(clustered(30), SCHEMA)
    for bad in ("IVF0,Flat", "IVF9999,Flat", "HNSW32", ""):
        with pytest.raises(ValueError):
            make_index(df, bad)
    with pytest.raises(ValueError):
        make_index(df, "IVF4,Flat", "l1")
    with pytest.raises(ValueError):
        make_index(df, "IVF4,Flat").build()
    sampled = make_index(df, "IVF4,Flat").train(df.where("vec_id < 10"), rounds=2)
    with pytest.raises(ValueError):
        sampled.search_batch(df.withColumnRenamed("vec_id", "query_id"))
    assert sampled.build().search_batch(df.withColumnRenamed("vec_id", "query_id"), 1).count() == 30


def test_rows_of_another_cell_that_tie_when_rounded(spark):
    df = spark.createDataFrame([(10, [0.4999999]), (11, [0.4999999]), (1, [0.50001]), (2, [0.9]), (3, [0.0]), (4, [1.0])], SCHEMA)
    index = make_index(df, "IVF2,Flat")
    index.means = np.array([[0.0], [1.0]])
    index.build()
    queries = df.where("vec_id = 11").withColumnRenamed("vec_id", "query_id")
    want = rows_of(FlatIndex(df).search_batch(queries, 2))
    assert [r[2] for r in want] == [1, 10]
    assert rows_of(index.nearest_join(queries, 2)) == want == rows_of(index.search_batch(queries, 2))


@pytest.mark.parametrize("scale", [1.0, 1e-6, 1e9])
def test_pairs_that_single_precision_leaves_are_all_there(scale):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(3000, 9)), np.repeat(rng.normal(size=(3, 9)), 400, 0)]) * scale + 3 * scale
    radius = np.sqrt(((x - x.mean(0)) ** 2).sum(1))
    x, radius, ids = x[np.argsort(radius)], np.sort(radius), rng.permutation(len(x))
    q = np.concatenate([x[::9], rng.normal(size=(50, 9)) * scale])
    away, d = np.sqrt(((q - x.mean(0)) ** 2).sum(1)), np.round(np.maximum(((q[:, None] - x) ** 2).sum(2), 0), 9)
    for limit in (np.full(len(q), np.inf), np.sqrt(np.sort(d, 1)[:, 3] + cell_index.ROUNDED) + cell_index.SLACK):
        (i, found, got), _ = cell_index.nearest(q, away, limit, x, radius, ids, 4, 1.0)
        assert len(i) == 4 * len(q)
        for a in range(len(q)):
            best = np.sort(d[a])[:4]
            assert np.allclose(got[i == a], best, rtol=1e-9, atol=1e-9 + 1e-13 * scale**2)
            if scale == 1.0:
                assert set(found[i == a]) == set(ids[np.lexsort((ids, d[a]))[:4]])


def test_queries_are_sent_once_a_block(spark, monkeypatch):
    from tessera.plans import staging

    rows = clustered(n=2000, groups=40, spread=3.0)
    df = spark.createDataFrame(rows, SCHEMA)
    index = make_index(df, "IVF64,Flat").train(rounds=1).build()
    block, parts = index._blocks()
    assert max(block) <= 2 and set(parts) == {1}
    twice = []

    def looked_at(rows, label):
        out = staging.staged(rows, label)
        if label == "sent":
            twice.append(out.groupBy("query_id", "block").count().where("count > 1").count())
        return out

    monkeypatch.setattr(cell_index, "staged", looked_at)
    queries = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    assert rows_of(index.nearest_join(queries, 3)) == rows_of(FlatIndex(df).search_batch(queries, 3))
    assert twice == [0, 0]
