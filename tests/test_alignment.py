"""Alignment in chunks equals the plain walk."""

import random

import pytest

from cellsight.operators.alignment import align


def walk(left, right, ahead):
    """The definition: one group, rows in order."""
    at, out = 0, []
    for place, key in left:
        hit = next((j for j in range(at, min(at + ahead + 1, len(right))) if key is not None and right[j][1] == key), None)
        out.append((place, None if hit is None else right[hit][0]))
        at = at if hit is None else hit + 1
    return out


@pytest.mark.parametrize("seed, alphabet, ahead, chunk", [(1, 1000, 3, 4), (2, 6, 3, 5), (3, 40, 5, 8), (4, 2, 2, 7), (5, 200, 0, 3)])
def test_equals_walk(spark, seed, alphabet, ahead, chunk):
    rng = random.Random(seed)
    rows, want = {"left": [], "right": []}, []
    for part in ("a", "b", None):
        keys = [None if rng.random() < 0.03 else f"k{rng.randrange(alphabet)}" if alphabet < 1000 else f"k{i}" for i in range(0 if part == "b" and seed == 3 else 150)]
        right = [(2 * i, k) for i, k in enumerate(keys)]
        left = [(i, k) for i, (_, k) in enumerate(r for r in right if rng.random() < 0.7)]
        left = [(i, f"new{i}" if rng.random() < 0.1 else k) for i, k in left]
        rows["right"] += [(part, *r) for r in right]
        rows["left"] += [(part, *r) for r in left]
        want += [(part, *r) for r in walk(left, right, ahead)]
    l, r = (spark.createDataFrame(rng.sample(rows[s], len(rows[s])), "part string, position long, key string") for s in ("left", "right"))
    got = [tuple(x) for x in align(l, r, ahead=ahead, chunk=chunk).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_one_group_is_walked_by_several_tasks(spark):
    rows = spark.range(3000).selectExpr("'one' AS part", "id AS position", "id AS key")
    out = align(rows.where("key % 7 <> 0"), rows, chunk=64)
    assert {(r["left_position"], r["right_position"]) for r in out.collect()} == {(i, i) for i in range(3000) if i % 7}


def test_a_gap_longer_than_the_look_ahead_ends_the_walk(spark):
    rows = spark.range(100).selectExpr("0 AS part", "id AS position", "id AS key")
    got = {r["left_position"]: r["right_position"] for r in align(rows.where("key < 30 OR key > 60"), rows, chunk=32).collect()}
    assert [got[i] for i in (29, 61, 99)] == [29, None, None]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "part string, position long, key string")
    some = spark.createDataFrame([("a", 1, "x")], "part string, position long, key string")
    assert align(none, some).count() == 0
    assert [tuple(r) for r in align(some, none).collect()] == [("a", 1, None)]
