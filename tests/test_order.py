"""Order statistics over ranges against slow versions, and figures that overflow longs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsight.operators import cluster
from cellsight.operators import heuristics as H
from cellsight.operators import metrics as M
from cellsight.operators import order


@pytest.fixture(autouse=True, params=[0, 1 << 18])
def direct(request, monkeypatch):
    """Everything by ranges, and everything in one go."""
    monkeypatch.setattr(order, "DIRECT", request.param)


def test_running_sums_and_numbers(spark):
    rng = random.Random(0)
    rows = [(rng.choice("abc"), k, rng.randint(0, 9)) for k in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "g string, k long, n long")
    got = {(r["g"], r["k"]): r["n_before"] for r in order.running_before(df, ["g"], [F.desc("k")], ["n"]).collect()}
    assert got == {(g, k): sum(n for h, j, n in rows if h == g and j > k) for g, k, _ in rows}
    got = {r["k"]: r["i"] for r in order.numbered(df, [], ["k"], "i").collect()}
    assert got == {k: i for i, k in enumerate(sorted(k for _, k, _ in rows))}
    assert order.running_before(df.limit(0), [], ["k"], ["n"]).count() == 0


def slow_ranks(v):
    return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]


def test_rank_correlation(spark):
    rng = random.Random(1)
    rows = [(g, float(rng.randint(0, 8)), float(rng.randint(0, 8))) for g in "pq" for _ in range(60)]
    got = {r["col_name"]: r["gain"] for r in H.gain_numeric(spark.createDataFrame(rows, "col_name string, x double, y double")).collect()}
    for g in "pq":
        x, y = zip(*[(a, b) for h, a, b in rows if h == g])
        assert got[g] == pytest.approx(0.5 + 0.5 * np.corrcoef(slow_ranks(x), slow_ranks(y))[0, 1])


def test_millions_of_equal_values(spark):
    n = 3_000_000
    df = spark.range(2 * n).select((F.col("id") % 2).alias("g"), F.when(F.col("id") < 2 * n - 1, 5.0).otherwise(6.0).alias("v"))
    r = M.mann_whitney(df, "g", "v").first()
    assert r["n1"] == r["n2"] == n and r["u"] == pytest.approx(n * n / 2 + n / 2) and 0 <= r["p"] <= 1
    assert M.roc_auc(df.select((2 * F.col("g") - 1).alias("y_true"), F.col("v").alias("score"))).first()["auc"] == pytest.approx(0.5 + 0.5 / n)


def test_p_value(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(1 if i % 3 else 0, rng.random() + (0.1 if i % 3 else 0)) for i in range(200)], "g int, v double")
    r = M.mann_whitney(df, "g", "v").first()
    assert r["p"] == pytest.approx(M.normal_tail(r["z"]), abs=1e-6)


def test_components_of_large_ids(spark):
    big = 2**62
    edges = spark.createDataFrame([(big, big + 1), (big + 1, big + 2), (7, big + 9)], "a long, b long")
    nodes = spark.createDataFrame([(big + i,) for i in (0, 1, 2, 9)] + [(7,), (8,)], "id long")
    got = {r["id"]: r["root"] for r in cluster.connected(edges, nodes).collect()}
    assert got == {big: big, big + 1: big, big + 2: big, big + 9: 7, 7: 7, 8: 8}


def test_sweep_equals_all_products(spark):
    rng = random.Random(4)
    cases = [(rng.choice([1, -1]), rng.choice([None, 0.0, 0.5, 1.0, rng.random()])) for _ in range(200)]
    levels = [0.0, 0.25, 0.5, 1.0, 2.0]
    got = {r["threshold"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in M.threshold_sweep(spark.createDataFrame(cases, "y_true int, score double"), spark.createDataFrame([(x,) for x in levels], "threshold double")).collect()}
    for x in levels:
        flag = [s is not None and s >= x for _, s in cases]
        want = tuple(sum((t == 1) == a and f == b for (t, _), f in zip(cases, flag)) for a, b in ((True, True), (False, True), (True, False), (False, False)))
        assert got[x] == want


def test_diagonal_mixture(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 20, (4, 70))
    rows = [(i, (centres[i % 4] + rng.normal(0, 1, 70)).tolist()) for i in range(120)]
    found, bic, aic = cluster.diagonal_mixture(spark.createDataFrame(rows, "id long, v array<double>"), 4)
    parts = {}
    for r in found.collect():
        parts.setdefault(r["id"] % 4, set()).add(r["cluster"])
    assert all(len(p) == 1 for p in parts.values()) and np.isfinite(bic) and aic < bic


def test_quantiles_equal_percentile(spark):
    draw = random.Random(9)
    rows = [(draw.choice(["a", "b", None]), draw.choice([None, float("nan") if draw.random() < 0.1 else 1.0, draw.random() * 100, float(draw.randint(0, 4))])) for _ in range(500)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = [0.0, 0.05, 0.25, 0.5, 0.77, 1.0]
    exact = F.percentile("x", F.array(*[F.lit(s) for s in shares]))
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(exact.alias("q")).collect() if r["q"] is not None}
    got = {r["g"]: r["q"] for r in order.quantiles(df, ["g"], "x", shares).collect()}
    assert str(got) == str({g: want[g] for g in got}) and set(got) == set(want)
    assert str(order.quantiles(df, [], "x", shares).first()["q"]) == str(df.agg(exact).first()[0])
    assert order.quantile(df.limit(0), "x", 0.5) is None
    m = {r["g"]: r["m"] for r in order.medians(df, ["g"], {"x": "m"}).collect()}
    assert m.keys() == {"a", "b", None, "one", "none"} and m["none"] is None and m["one"] == 3.0
