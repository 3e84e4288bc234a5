"""Neighbours and ranges against all pairs; how many pairs are looked at."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsight.operators import cluster, nearest


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(a) for a in r]) for i, r in zip(range(len(x)) if ids is None else ids, x)], "id long, v array<double>").repartition(3)


def blobs(rng, n=400, d=3):
    centres = rng.normal(0, 8, (8, d))
    return np.round(centres[rng.integers(0, 8, n)] + rng.normal(0, 0.5, (n, d)), 1)  # rounded: many ties and equal rows


@pytest.mark.parametrize("metric, block, k", [("euclidean", 16, 5), ("manhattan", 4096, 3), ("euclidean", 4096, 70)])
def test_neighbours_equal_all_pairs(spark, metric, block, k):
    rng = np.random.default_rng(1)
    x, q = blobs(rng), np.vstack([blobs(rng, 30), rng.normal(0, 20, (10, 3))])
    got = nearest.neighbours(frame(spark, q), frame(spark, x), k, metric, block).collect()
    d = nearest.distances(q, x, metric)
    for i in range(len(q)):
        want = sorted(range(len(x)), key=lambda j: (d[i, j], j))[:k]
        assert [r["b"] for r in sorted((r for r in got if r["q"] == i), key=lambda r: r["rank"])] == want


def test_few_and_no_vectors(spark):
    x = np.zeros((3, 2))
    assert nearest.neighbours(frame(spark, x), frame(spark, x), 5).count() == 9
    assert nearest.neighbours(frame(spark, x), frame(spark, x).limit(0), 5).count() == 0
    assert nearest.neighbours(frame(spark, x).limit(0), frame(spark, x), 5).count() == 0


def test_search_skips_most_pairs(spark):
    rng = np.random.default_rng(2)
    x = blobs(rng, 2000)
    cells = nearest.Cells(frame(spark, x))
    assert nearest.neighbours(frame(spark, x), cells, 5).count() == 10000
    assert cells.compared < 0.25 * len(x) ** 2
    cells.compared = 0
    n = {r["id"]: r["n"] for r in nearest.count_within(frame(spark, x), cells, 0.5).collect()}
    assert cells.compared < 0.25 * len(x) ** 2
    d = nearest.distances(x, x)
    assert n == dict(enumerate((d <= 0.5).sum(1)))


def slow_dbscan(x, eps, m):
    near = nearest.distances(x, x) <= eps
    core = np.flatnonzero(near.sum(1) >= m)
    root = {int(i): int(i) for i in core}
    for _ in range(len(x)):
        new = {i: min([root[j] for j in root if near[i, j]]) for i in root}
        if new == root:
            break
        root = new
    number = {r: k for k, r in enumerate(sorted(set(root.values())))}
    return {i: number[root[i]] if i in root else min([number[root[j]] for j in root if near[i, j]], default=-1) for i in range(len(x))}


@pytest.mark.parametrize("eps, m", [(0.45, 5), (0.9, 8), (1e-9, 2), (100.0, 5)])
def test_dbscan_equals_its_definition(spark, eps, m):
    rng = np.random.default_rng(3)
    x = np.vstack([blobs(rng, 150), rng.normal(0, 10, (30, 3))])
    assert {r["id"]: r["cluster"] for r in cluster.dbscan(frame(spark, x), eps, m).collect()} == slow_dbscan(x, eps, m)


def test_links_join_what_chains_join_without_all_pairs(spark):
    x = np.vstack([np.zeros((300, 2)), np.ones((200, 2)) * 9])  # two groups of equal rows
    links = nearest.links_within(nearest.Cells(frame(spark, x), block=64), 0.5)
    assert links.count() < 500 * 12
    roots = {r["id"]: r["root"] for r in cluster.connected(links, frame(spark, x).select("id")).collect()}
    assert set(roots.values()) == {0, 300}
    assert frame(spark, x).select(F.max("id")).first()[0] == 499


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev"])
def test_wide_vectors_bounded_in_single_precision_give_exact_neighbours(spark, metric):
    rng = np.random.default_rng(5)
    x = rng.normal(1000, 1, (300, 40)).astype(np.float32).astype(float)  # far from the origin
    x[250:] = x[:50] + rng.normal(0, 1e-7, (50, 40))  # nearer than single precision can tell
    got = nearest.neighbours(frame(spark, x), frame(spark, x), 4, metric, 64).collect()
    d = nearest.distances(x, x, metric)
    found = {}
    for r in got:
        found.setdefault(r["q"], {})[r["rank"]] = r["b"]
    assert found == {i: dict(enumerate(sorted(range(300), key=lambda j: (d[i, j], j))[:4], 1)) for i in range(300)}


def test_no_vector_is_copied_for_a_visit(spark):
    """In many dimensions every query visits every cell; what tasks exchange stays in proportion to the vectors."""
    from cellsight.operators import storage

    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (3000, 32))
    root = storage.shared_root(spark.range(1))
    before = _written(spark)
    assert nearest.neighbours(frame(spark, x), frame(spark, x), 3).count() == 9000
    assert root and _written(spark) - before < 10 * x.nbytes


def _written(spark):
    """Bytes that shuffles have written so far."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))
