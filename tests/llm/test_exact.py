import hashlib
import random

from pyspark.sql import functions as F

from cellsight.llm import exact

SCHEMA = "doc_id long, text string, key string, id int, sha string, n int, bucket int, kept int"
LOWER = {65 + i: 97 + i for i in range(26)}


def slow(rows):
    norm = [(t or "").translate(LOWER) for _, t in rows]
    out = []
    for (i, _), t in zip(rows, norm):
        ids = [r[0] for r, u in zip(rows, norm) if u == t]
        out.append((i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return out


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4) for r in rows], SCHEMA).repartition(3)
    got = exact.deduplicate(df, **more).collect()
    assert sorted((tuple(r)[:3] + (r["text_sha256"],) for r in got), key=str) == sorted(slow(rows), key=str)
    stays = {}
    for r in got:
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            stays[r["text_sha256"]] = stays.get(r["text_sha256"], 0) + 1
    assert set(stays) == {r["text_sha256"] for r in got} and set(stays.values()) <= {1}


def texts(rng, n):
    pool = ["", None, "A", "a", "É", "é", "ÀB", "Àb", "à b", "K", "K", "İ", "x" * 9000, "X" * 9000, "\n", " ", "Ａ", "ß", "ẞ"]
    return [(i, rng.choice(pool) if rng.random() < 0.7 else f"T{rng.randint(0, 60)}") for i in range(n)]


def test_equals_brute_force(spark):
    rng = random.Random(4)
    rows = texts(rng, 300) + [(None, "a"), (None, "only null"), (None, "only null"), (7, "twice"), (7, "twice")]
    check(spark, rows)
    check(spark, rows, bucket_keys=2, hot_copies=5)
    check(spark, [])


def test_chains_of_one_key(spark):
    rng = random.Random(5)
    length = lambda c: (F.char_length(F.col(c)) % 3).cast("long")
    check(spark, texts(rng, 200), hashed=length, bucket_keys=2, hot_copies=20)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "B")], "doc_id long, text string")
    index = exact.build(df, exact.digests(df, hashed=length), hashed=length)
    assert sorted(r["chain"] for r in index.pages.collect()) == [0, 1]


def test_directory_splits_only_overfull_buckets(spark):
    rng = random.Random(6)
    keys = [rng.getrandbits(62) for _ in range(300)] + [-rng.getrandbits(63) for _ in range(20)]
    found = exact.directory(spark.createDataFrame([(k,) for k in keys], "key long"), bucket_keys=16).collect()
    cell = lambda k: (k % 2**64) >> 48
    load = lambda depth, bucket: sum(cell(k) >> (16 - depth) == bucket for k in keys)
    assert {r["entry"] for r in found} == {cell(k) for k in keys}
    for r in found:
        assert r["bucket"] == r["entry"] >> (16 - r["depth"]) and load(r["depth"], r["bucket"]) <= 16
        assert r["depth"] == 0 or load(r["depth"] - 1, r["bucket"] >> 1) > 16
