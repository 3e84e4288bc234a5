"""Merges in rounds against merging the closest pair again and again."""

import numpy as np
import pytest

from cellsight.operators import cluster, linkage
from tests.test_nearest import frame


def slow_heights(x, how):
    groups = [[i] for i in range(len(x))]
    d = np.sqrt(np.square(x[:, None] - x[None]).sum(2))
    out = []

    def far(a, b):
        if how == "average":
            return d[np.ix_(a, b)].mean()
        return 2 * len(a) * len(b) / (len(a) + len(b)) * np.square(x[a].mean(0) - x[b].mean(0)).sum()

    while len(groups) > 1:
        h, i, j = min((far(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        out.append((min(groups[i] + groups[j]), max(min(groups[i]), min(groups[j])), h, sorted(groups[i] + groups[j])))
        groups[i] = groups[i] + groups[j]
        del groups[j]
    return out


def sets(spark, x, k, **more):
    found = {}
    for r in cluster.agglomerative(frame(spark, x), k, **more).collect():
        found.setdefault(r["cluster"], set()).add(r["id"])
    return sorted(map(sorted, found.values()))


def slow_sets(x, k, how):
    groups = {i: [i] for i in range(len(x))}
    for lo, hi, _, _ in slow_heights(x, how)[: len(x) - k]:
        groups[lo] = sorted(groups[lo] + groups.pop(hi))
    return sorted(groups.values())


def test_rounds_give_the_merges_of_one_by_one(spark):
    x = np.random.default_rng(1).normal(0, 3, (50, 3))
    want = sorted((lo, hi, round(h, 6)) for lo, hi, h, _ in slow_heights(x, "ward"))
    for small in (20, 2048):
        got = sorted((r["lo"], r["hi"], round(r["height"], 6)) for r in linkage.merges(frame(spark, x), small, block=16).collect())
        assert got == want


@pytest.mark.parametrize("k", [1, 4])
def test_labels_below_and_above_the_bound_of_one_task(spark, k):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (40, 2)), rng.normal(8, 1, (30, 2)), [[90.0, 90.0]]])
    want = slow_sets(x, k, "ward")
    assert sets(spark, x, k) == want and sets(spark, x, k, small=40, block=16) == want


def test_average_linkage_few_and_no_vectors(spark):
    x = np.random.default_rng(3).normal(0, 1, (40, 2))
    assert sets(spark, x, 5, linkage="average") == slow_sets(x, 5, "average")
    with pytest.raises(ValueError):
        linkage.merges(frame(spark, x), 16, "average")
    assert sets(spark, x[:2], 5) == [[0], [1]] and sets(spark, x[:0], 5) == []
    assert len(sets(spark, np.ones((24, 2)), 3, small=12)) == 3
