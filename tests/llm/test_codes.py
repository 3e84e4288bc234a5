import hashlib
import math
import random

import numpy as np
import pyspark.sql.functions as F

from cellsight.llm import codes, queries
from tests.test_queries import SF

SCHEMA = "vec_id long, embedding array<float>, label int, key string, code int, of int"


def slow(rows, rounds=6):
    """All entries compared with all parts, in Python's integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    width = max(1, -(-max(len(r[1]) for r in kept) // 8)) * 8
    size = width // 8
    cut = lambda v: [math.floor(4096 * x) for x in v] + [0] * (width - len(v))
    ints = [cut(r[1]) for r in kept]
    first = [cut(r[1]) for r in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]]
    books = [[v[p * size : (p + 1) * size] for v in first] for p in range(8)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    def assign():
        return [[nearest(v[p * size : (p + 1) * size], books[p]) for p in range(8)] for v in ints]

    for _ in range(rounds):
        found = assign()
        for p in range(8):
            for j in range(len(books[p])):
                own = [v[p * size : (p + 1) * size] for v, f in zip(ints, found) if f[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{j:02x}" for _, j in f), e, by_label[r[2]], digest) for r, f, e in zip(kept, found, errors)]


def check(spark, rows):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in codes.codes_and_errors(df).collect()]
    assert sorted(got, key=str) == sorted(slow(rows), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(16)], rng.choice([None, 0, 1, 2])) for i in range(200)]
    rows += [(900, None, 1), (901, [0.1, None] + [0.0] * 14, 1), (902, [math.nan] + [0.0] * 15, None), (903, [math.inf] * 16, 0), (None, [0.5] * 16, None), (None, [0.4] * 16, 5)]
    check(spark, rows + rows[:30])  # repeated rows


def test_ties_and_coarse_values(spark):
    rng = random.Random(2)
    check(spark, [(i, [rng.choice([-1, 0, 1]) / 4096 for _ in range(8)], i % 2) for i in range(120)])
    check(spark, [(i, [0.25] * 8, None) for i in range(40)])


def test_small_uneven_and_large_values(spark):
    check(spark, [])
    check(spark, [(1, None, None)])
    check(spark, [(3, [], 1), (2, [], None)])
    check(spark, [(5, [1.0, -2.5, 3.25], 1), (4, [0.5] * 11, None), (4, [0.5] * 9, 1), (6, [-0.0001], 2)])
    rng = random.Random(3)
    check(spark, [(i, [rng.choice([1e5, -3e4, 1.0, 2.0]) for _ in range(8)], 0) for i in range(30)])


def test_search_walks_fewer_entries_and_loses_none():
    rng = np.random.default_rng(0)
    entries = rng.integers(-500, 500, (16, 8))
    book = codes.Codebook(entries)
    x = entries[rng.integers(0, 16, 500)] + rng.integers(-60, 60, (500, 8))
    far = np.square(x[:, None] - entries[None]).sum(2)
    for start in (np.zeros(500, np.int64), far.argmin(1), rng.integers(0, 16, 500)):
        best, least = book.search(x, start)
        assert (best == far.argmin(1)).all() and (least == far.min(1)).all()
    near = far.argmin(1)
    assert (book.far[near] <= 4 * far.min(1)[:, None]).sum() < 500 * 16 / 2


def test_query_and_round_trip(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = [tuple(r) for r in queries.QUERIES["op13_vector_codes"](spark, SF).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got) == sorted(slow(rows))
    coded, books = codes.compress(spark.read.parquet(f"{SF}/embeddings.parquet"))
    back = codes.decode(coded, books)
    ints = {i: [math.floor(4096 * x) for x in v] for i, v, _ in rows}
    for r in back.where(F.col("key") % 50 == 0).collect():
        assert sum((a - b) ** 2 for a, b in zip(ints[r["key"]], r["vector"])) == int(r["error"])
