import random

import corpus_pipeline
from cellsight.llm import simhash


def text_of(rng, n):
    return " ".join(rng.choice("the of and to in is".split()) if rng.random() < 0.4 else "".join(rng.choice("aeinrstlo") for _ in range(6)) for _ in range(n))


def corpus():
    rng = random.Random(11)
    shared = text_of(rng, 60)
    rows = []
    for k in range(60):
        t = text_of(rng, 120)
        if k % 6 == 0:
            t = f"{t} unique{k} {shared}"
        rows.append((k, "menu of the site\n" + t if k % 2 else t, "en", "s0", 0))
    rows += [(100, rows[3][1], "en", "s0", 0), (101, " ".join("x1###" for _ in range(3)), "en", "s0", 0), (102, None, None, None, 0)]
    return rows


def test_stages(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_duplicates", "substrings", "packing"]
    docs, seen = df, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, ""), "t")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    quality, lines, near, sub = seen
    assert set(quality) == set(range(60)) | {100}
    assert not any("menu" in t for t in lines.values()) and set(lines) == set(quality)
    assert 100 not in near and 3 in near and len({simhash.fingerprint(t) for t in near.values()}) == len(near)
    assert len(sub[0].split()) == 181 and all(len(sub[k].split()) == 121 for k in range(6, 60, 6) if k in sub)
    assert all(sub[k] == near[k] for k in near if k % 6)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} == set(sub)


def test_rows_that_share_an_id_keep_their_own_texts(spark):
    rng = random.Random(2)
    shared, alpha, beta = text_of(rng, 40), text_of(rng, 60), text_of(rng, 60)
    rows = [(1, shared, "en", "a", 0, 1), (5, f"{alpha} {shared}", "en", "a", 0, 2), (5, beta, "en", "b", 0, 3), (None, f"{beta} {shared}", None, None, 0, 4), (None, None, None, None, 0, 5), (6, None, "en", "a", 0, 6), (7, "", "en", "a", 0, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, places int")
    got = sorted((tuple(r) for r in corpus_pipeline.drop_repeats(spark, df, "").collect()), key=repr)
    want = sorted([(1, shared, "en", "a"), (5, alpha, "en", "a"), (5, beta, "en", "b"), (None, f"{beta} {shared}", None, None), (None, None, None, None), (6, None, "en", "a"), (7, "", "en", "a")], key=repr)
    assert [r[:4] for r in got] == sorted((w for w in want), key=lambda w: repr((*w, None if w[1] is None else len(w[1]))))
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in got)


def test_stages_on_empty_tables_and_odd_rows(spark):
    rng = random.Random(8)
    text = text_of(rng, 80)
    rows = [(1, text, "en", "s", 0, "x"), (1, text_of(rng, 90), "en", "s", 0, "x"), (None, text_of(rng, 70), None, None, None, "x"), (2, text + " end", None, "s", 0, None), (3, "wort " * 5000, "de", "s", 0, None), (4, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __id string")
    for docs, want in ((df, [1, 1, None]), (df.limit(0), [])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.settle(stage(spark, docs, ""), name)
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        assert sorted((r["doc_id"] for r in docs.collect()), key=repr) == sorted(want, key=repr)
        corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
