import hashlib
import random
import shutil

from cellsight.llm import substring


def brute(docs, size=13):
    words = {k: (t or "").encode().split() for k, t in docs}
    first = {}
    for k in sorted(words):
        for i in range(len(words[k]) - size + 1):
            first.setdefault(tuple(words[k][i : i + size]), k)
    out = {}
    for k, w in words.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < k:
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[k] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for k in range(n):
        w = [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            a = rng.randint(0, 45)
            w[rng.randint(0, len(w)) : 0] = passage[a : a + rng.randint(5, 30)]
        docs.append((k * 3, rng.choice([" ", "\n", "\t "]).join(w)))
    docs += [(1000, docs[5][1]), (1001, docs[5][1]), (1002, None), (1003, ""), (1004, "a " * 40), (1005, "a " * 41), (1006, "x y"), (1007, " ".join(passage * 200))]
    return docs


def test_equals_brute_force(spark):
    for seed, batches in ((0, 1), (1, 2), (2, 4)):
        docs = corpus(seed)
        random.Random(9).shuffle(docs)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(df, batches).collect()}
        assert got == brute(docs)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a " * 20, "s"), (1, "b " * 20, "s"), (1, "b " * 20, "s"), (2, "b " * 13, None)], "doc_id long, text string, places string")
    got = sorted((r["doc_id"] or -1, r["n_removed"], len(r["kept_text"].split())) for r in substring.remove_repeats(df).collect())
    assert got == [(-1, 0, 20), (1, 0, 20), (1, 0, 20), (2, 13, 0)]
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_index_grows_and_compacts_without_the_old_texts(spark, tmp_path):
    docs = sorted(corpus(3, 90))
    want = brute(docs)
    index, found, most = substring.FingerprintIndex(spark), [], 0
    step = -(-len(docs) // 10)
    for i in range(0, len(docs), step):
        path = tmp_path / f"batch{i}"
        spark.createDataFrame(docs[i : i + step], "doc_id long, text string").write.parquet(str(path))
        found += index.ingest(spark.read.parquet(str(path))).collect()
        shutil.rmtree(path)
        most = max(most, len(index.runs["anchors"]))
        index.compact()
        assert all(sum(t == u for u, _ in runs) < index.fan_out for runs in index.runs.values() for t, _ in runs)
    assert most == 5 and {t for t, _ in index.runs["windows"]} == {0, 1}
    gone = {}
    for r in found:
        gone.setdefault(r["doc_id"], set()).update(range(r["place"], r["place"] + 13))
    assert {k: len(v) for k, v in gone.items()} == {k: v[1] for k, v in want.items() if v[1]}
    index.close()
