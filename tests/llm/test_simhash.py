import random

import numpy as np
import xxhash

from cellsight.llm import simhash
from cellsight.llm.components import components


def slow_fingerprint(text):
    w = text.encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs):
    """pairs: (id, fingerprint) -> least id reachable."""
    label = {i: k for k, (i, _) in enumerate(pairs)}
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            if bin(pairs[a][1] ^ pairs[b][1]).count("1") <= 3:
                parent[find(a)] = find(b)
    least = {}
    for i, k in label.items():
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: least[find(k)] for i, k in label.items()}


def test_fingerprint():
    rng = random.Random(0)
    for text in ["", " \n", "one", "One two", "a b c", "ÄB äb x y z q"] + [" ".join(rng.choice("abcde") for _ in range(n)) for n in (3, 4, 50, 500)]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_every_close_pair_meets():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    _, kx, hx = simhash.anchors(x)
    rx = simhash.anchors(x)[0]
    ry, ky, _ = simhash.anchors(y)
    for i in range(len(x)):
        home = set(kx[(rx == i) & hx].tolist())
        assert len(home) == 2 and home & set(ky[ry == i].tolist())


def spread(seed, n, centres, flips):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(centres)]
    out = set()
    for _ in range(n):
        f = rng.choice(base)
        for _ in range(rng.randint(0, flips)):
            f ^= 1 << rng.randrange(64)
        out.add(f)
    return sorted(out)


def test_links_keep_components(spark):
    for seed, n, centres, flips, hot in ((0, 300, 8, 8, 4096), (1, 300, 2, 5, 10), (2, 200, 50, 3, 4)):
        fps = spread(seed, n, centres, flips)
        signed = [f - 2**64 if f >> 63 else f for f in fps]
        edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), hot=hot)
        assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 3 for r in edges.collect())
        got = {r["node"]: r["root"] for r in components(edges).collect()}
        want = slow_components([(s, f) for s, f in zip(signed, fps)])
        groups = lambda m: {frozenset(k for k in signed if m.get(k, k) == v) for v in {m.get(k, k) for k in signed}}
        assert groups(got) == groups(want)


def test_table(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(60)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[3]), (101, texts[3].upper()), (102, None), (103, ""), (None, texts[4]), (104, texts[5] + " tail"), (5, texts[5])]
    df = spark.createDataFrame([(i, t, "fp") for i, t in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    own = [(i, slow_fingerprint(t or "")) for i, t in rows]
    want = slow_components([(k if i is None else i, f) for k, (i, f) in ((10**6 + n, x) for n, x in enumerate(own))])
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]]
            assert r["fingerprint"] == f"{dict(own)[r['doc_id']]:016x}"
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = {r["doc_id"] for r in simhash.keep_one(df).collect()}
    assert kept == {r["component_id"] for r in got}


def test_components_on_hub_and_chain(spark):
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 3), (101, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(40)) and all(got[100 + i] == 100 for i in range(31))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_documents(spark):
    rng = random.Random(7)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 400))] for _ in range(60)]
    rows, far = [(k, " ".join(w)) for k, w in enumerate(base)], 1000
    copies = []
    for k, w in enumerate(base[:40]):
        for _ in range(2):
            c = list(w)
            for i in rng.sample(range(len(c)), max(1, len(c) // 120)):
                c[i] = f"n{rng.randint(0, 10**6)}"
            rows.append((far, " ".join(c).upper()))
            copies.append((k, far))
            far += 1
    half = [(far + k, " ".join(w[: len(w) // 2] + [f"z{k}x{i}" for i in range(len(w) // 2)])) for k, w in enumerate(base[40:])]
    rows += half + [(5000, None), (5001, ""), (None, rows[0][1]), (5002, "a b"), (5003, "A  b")]

    def jaccard(a, b):
        s = [{tuple(x.lower().split()[i : i + 5]) for i in range(len(x.split()) - 4)} for x in (a, b)]
        return len(s[0] & s[1]) / len(s[0] | s[1])

    text = dict(r for r in rows if r[0] is not None)
    close = [(a, b) for a, b in copies if jaccard(text[a], text[b]) >= 0.85]
    assert len(close) > 40
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, a int")
    got = {r["doc_id"] for r in simhash.keep_dissimilar(df).collect()}
    assert set(range(60)) <= got and {k for k, _ in half} <= got and {5000, 5001, None, 5002} <= got
    assert 5003 not in got and not {b for _, b in close} & got
    assert simhash.keep_dissimilar(df.limit(0)).count() == 0


def test_similarity_of_sketches():
    x, y = np.arange(0, 100, dtype=np.uint64), np.arange(10, 110, dtype=np.uint64)
    assert simhash.similarity_of(x.tobytes(), y.tobytes()) == 90 / 110


def edited_copies(rng, n, words=200, edits=4):
    """An original and copies with edits at places of their own, so copies are less like each other than like the original."""
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        c = list(base)
        for i in rng.sample(range(3, words - 3), edits):
            c[i] = f"n{rng.randint(0, 10**9)}"
        out.append(" ".join(c))
    return " ".join(base), out


def test_similar_documents_around_an_original_in_the_middle(spark, monkeypatch):
    for name, value in (("HOME_DOCS", 8), ("PASSING", 32)):  # groups are dealt out in both directions
        monkeypatch.setattr(simhash, name, value, raising=False)
    original, copies = edited_copies(random.Random(3), 100)
    ids = [*range(50), *range(51, 101)]
    df = spark.createDataFrame([(50, original), *zip(ids, copies)], "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.keep_dissimilar(df).collect()] == [0]
    # without the hub's help every pair of a group still meets once
    sets = simhash.shingle_sets(df)
    members = df.selectExpr("0L as g", "doc_id", "200L as n_shingles", "doc_id as label", "true as home")
    linked = {r["node"]: r["root"] for r in components(simhash.similar_links(members, sets, 0.8)).collect()}
    assert linked == dict.fromkeys(range(101), 0)


def test_similarity_near_the_limit_is_exact_for_long_documents(spark):
    rng = random.Random(11)
    rows, twins = [], []
    for k in range(40):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(1204)]
        # 1,200 shingles each; those of the common first words are shared
        kept = 1066 + (2 if k % 2 else -2) + 4
        rows += [(k, " ".join(base)), (1000 + k, " ".join(base[:kept] + [f"n{rng.randint(0, 10**9)}" for _ in range(1204 - kept)]))]
        shared = kept - 4
        twins.append((1000 + k, shared / (2400 - shared) >= 0.8))
    assert {near for _, near in twins} == {True, False}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.keep_dissimilar(df).collect()}
    assert got == set(range(40)) | {d for d, near in twins if not near}
