"""Nearest-neighbour mutual information against the definitions over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsight.operators import information as I


def psi(n):
    return -0.5772156649015329 + sum(1 / j for j in range(1, int(n)))


def slow_class(labels, x, k=3):
    x, out = np.array(x), []
    size = {c: labels.count(c) for c in labels}
    kept = [i for i in range(len(x)) if size[labels[i]] > 1]
    for i in kept:
        d = np.abs(x[kept] - x[i])
        own = np.sort(np.abs(x[[j for j in kept if labels[j] == labels[i]]] - x[i]))
        m = min(k, size[labels[i]] - 1)
        r = own[m]
        inside = (d <= r * (1 - 1e-9)).sum()
        out.append(psi(m if r > 0 else (own == 0).sum()) - psi(size[labels[i]]) - psi(inside))
    return max(0.0, psi(len(kept)) + float(np.mean(out)))


def slow_numbers(x, y, k=3):
    x, y = np.array(x) / (np.std(x) or 1), np.array(y) / (np.std(y) or 1)
    out = []
    for i in range(len(x)):
        dx, dy = np.abs(x - x[i]), np.abs(y - y[i])
        d = np.sort(np.maximum(dx, dy))
        r = d[k]
        out.append(psi(k if r > 0 else (d == 0).sum()) - psi((dx <= r * (1 - 1e-9)).sum()) - psi((dy <= r * (1 - 1e-9)).sum()))
    return max(0.0, psi(len(x)) + float(np.mean(out)))


def test_digamma(spark):
    got = spark.range(1, 400).select(I.digamma(F.col("id"))).collect()
    assert all(abs(r[0] - psi(n)) < 1e-9 for n, r in enumerate(got, 1))


@pytest.mark.parametrize("block", [8, 1 << 14])
def test_number_and_class(spark, block):
    rng = np.random.default_rng(1)
    rows = []
    for pair, make in {"dependent": lambda c: rng.normal(c * 2), "free": lambda c: rng.normal(), "few": lambda c: float(rng.integers(0, 3) + c), "code": lambda c: float(c)}.items():
        rows += [(pair, int(c), float(make(c))) for c in rng.integers(0, 3, 90)]
    rows += [("dependent", 9, 1.0), ("dependent", None, 2.0), ("free", 1, None), ("two", 4, 1.0), ("two", 4, 5.0)]
    got = {r["pair"]: r["mi"] for r in I.with_class(spark.createDataFrame(rows, "pair string, label int, x double").repartition(3), block=block).collect()}
    for pair in ("dependent", "free", "few", "code", "two"):
        own = [(c, x) for p, c, x in rows if p == pair and c is not None and x is not None]
        assert got[pair] == pytest.approx(slow_class([c for c, _ in own], [x for _, x in own]), abs=1e-8)
    assert got["dependent"] > got["free"] + 0.2 and got["code"] == pytest.approx(math.log(3), abs=0.1)


def test_two_numbers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=150)
    for y in (x + 0.1 * rng.normal(size=150), rng.normal(size=150), np.round(x), np.zeros(150)):
        got = I.of_numbers(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"))
        assert got == pytest.approx(slow_numbers(x, y), abs=1e-8)
    few = np.repeat([[1.0, 2.0], [3.0, 4.0]], 10, axis=0)
    assert I.of_numbers(spark.createDataFrame(few.tolist(), "x double, y double")) == pytest.approx(slow_numbers(few[:, 0], few[:, 1]), abs=1e-8)
    assert I.of_numbers(spark.createDataFrame([(1.0, 2.0)], "x double, y double")) == 0.0
