"""Draws by ranges equal those of one ordered list, and strata meet their target."""

import random

import pytest
from pyspark.sql import functions as F

from cellsight.operators import order
from cellsight.operators import sampling as S


@pytest.fixture(params=[order.DIRECT, 10], ids=["direct", "ranges"])
def limit(request, monkeypatch):
    monkeypatch.setattr(order, "DIRECT", request.param)


def _rows(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, None]), rng.randrange(1000)) for i in range(120)]
    return rows, spark.createDataFrame(rng.sample(rows, 120), "row_idx long, cluster int, k int")


def _firsts(rows, n):
    return {r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))[:n]}


def test_draw_uniform_and_folds(spark, limit):
    rows, df = _rows(spark)
    got = S.draw(df, {0: 7, 1: 3, 2: 500}, order=F.col("k"))
    assert {r["row_idx"] for r in got.collect()} == set().union(*[_firsts([r for r in rows if r[1] == c], n) for c, n in ((0, 7), (1, 3), (2, 500))])
    assert set(got.columns) == set(df.columns)
    assert {r[0] for r in S.uniform(df, 0.25, F.col("k")).collect()} == _firsts(rows, 30)
    dealt = {r["row_idx"]: r["fold"] for r in S.folds(df, "cluster", 4, F.col("k")).collect()}
    for c in (0, 1, 2, None):
        own = sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[0]))
        assert [dealt[r[0]] for r in own] == [i % 4 for i in range(len(own))]
    assert {r[0] for r in S.stratified(df, ["cluster"], 2, F.col("k")).collect()} == set().union(*[_firsts([r for r in rows if r[1] == c], 2) for c in (0, 1, 2, None)])


@pytest.mark.parametrize("share, strata", [(0.3, 3), (0.02, 40), (0.5, 1)])
def test_stratified_share_equals_plain_version(spark, limit, share, strata):
    rng = random.Random(strata)
    rows = [(rng.randrange(100), rng.choice([None, *range(strata)])) for _ in range(250)]
    df = spark.createDataFrame(rows + [(None, 0)], "rec long, stratum int")
    groups = {}
    for r, s in rows:
        groups.setdefault(s, set()).add(r)
    place = lambda r: (r * 37 % 101, r)
    chosen = {r for g in groups.values() for r in sorted(g, key=place)[: max(1, int(len(g) * share))]}
    every = {r for r, _ in rows}
    want = set(sorted(every, key=lambda r: (r not in chosen, place(r)))[: int(len(every) * share)])
    got = [tuple(r) for r in S.stratified_share(df, ["stratum"], share, "rec", F.col("rec") * 37 % 101).collect()]
    assert sorted(got, key=str) == sorted([r for r in rows if r[0] in want], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "row_idx long, cluster int")
    assert S.uniform(df, 0.5).count() == S.folds(df, "cluster").count() == S.stratified_share(df, ["cluster"], 0.5, "row_idx").count() == 0
