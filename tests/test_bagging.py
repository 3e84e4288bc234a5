"""Out-of-bag predictions equal a slow count over single trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsight.operators.bagging import BaggedForest, draws


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=300), rng.normal(size=300)
    return spark.createDataFrame([(i, float(x[i]), float(z[i]), float(x[i] > 0) + float(z[i] > 1), float(3 * x[i] + rng.normal() / 10), float(rng.integers(2))) for i in range(300)], "row_idx long, x double, z double, kind double, y double, coin double").repartition(3).checkpoint()


def test_draws_are_poisson(spark):
    got = dict(spark.range(100_000).groupBy(draws("id", 3).alias("k")).count().collect())
    assert got[0] / 1e5 == pytest.approx(np.exp(-1), abs=0.01) and sum(k * n for k, n in got.items()) / 1e5 == pytest.approx(1, abs=0.02)
    other = spark.range(100_000).where((draws("id", 3) == 0) & (draws("id", 4) == 0)).count()
    assert other / 1e5 == pytest.approx(np.exp(-2), abs=0.01)


@pytest.mark.parametrize("label, classes", [("y", None), ("kind", 3)])
def test_equals_slow_count(rows, label, classes):
    forest = BaggedForest(["x", "z"], label, classes, trees=6, depth=3).fit(rows)
    got = {r["row_idx"]: r for r in forest.out_of_bag(rows).collect()}
    n = len(forest.trees)
    slow = forest.answers(rows).withColumns({f"w{i}": draws("row_idx", i) for i in range(n)}).collect()
    errors, values = [], []
    for r in slow:
        lacking = [r[f"__t{i}"] for i in range(n) if r[f"w{i}"] == 0]
        want = None if not lacking else float(np.mean(lacking)) if classes is None else float(np.argmax(np.sum(lacking, axis=0)))
        assert got[r["row_idx"]]["n_trees"] == len(lacking)
        assert got[r["row_idx"]]["expected"] == (None if want is None else pytest.approx(want))
        if want is not None:
            errors.append((want - r[label]) ** 2 if classes is None else float(want != r[label]))
            values.append(r[label])
    assert forest.error(rows) == pytest.approx(np.mean(errors) / (np.var(values) if classes is None else 1))
    assert forest.error(rows) < 0.3


def test_a_coin_is_not_learnt_out_of_bag(rows):
    forest = BaggedForest(["x", "z", "y"], "coin", 2, trees=8, depth=8).fit(rows)
    seen = rows.join(forest.predict(rows), "row_idx").agg(F.avg((F.col("coin") != F.col("expected")).cast("double"))).first()[0]
    assert seen < 0.25 and forest.error(rows) > 0.38
