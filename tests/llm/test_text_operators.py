import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cellsight.llm import chat, html, lines, quality, queries
from cellsight.llm.common import word_hashes, word_spans, byte_view


def test_words_and_hashes():
    texts = ["a bb  ccc", "", None, "\tx\n", "a", "bb" * 20 + " " + "bb" * 20, "é é é"]
    raw, offsets = byte_view(pa.array(texts))
    starts, ends, first = word_spans(raw, offsets)
    words = [raw[a:b].tobytes() for a, b in zip(starts, ends)]
    assert words == [w for t in texts for w in (t or "").encode().split()] and np.diff(first).tolist() == [len((t or "").encode().split()) for t in texts]
    h = word_hashes(raw, starts, ends)
    assert len(set(h.tolist())) == len(set(words)) and len({(w, x) for w, x in zip(words, h.tolist())}) == len(set(words))
    sliced = pa.array(["zz", *texts, "yy"]).slice(1, len(texts))
    assert byte_view(sliced)[0].tobytes() == raw.tobytes()


def slow_measure(text):
    w = (text or "").encode().split()
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    ls = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(s) for s in "#*$%&|<>"), len(ls) - len(set(ls)), len(cover)


def test_quality_counts():
    rng = random.Random(0)
    texts = [None, "", " \n\n ", "a\na\n b", "x " * 7, "x " * 9, "#*$%&|<> é ü "] + [rng.choice([" ", "\n"]).join(rng.choice(["a", "bé", "c#", "dd"]) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    m = quality.measure(pa.array(texts))
    got = list(zip(*(m[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert got == [slow_measure(t) for t in texts]


def slow_distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a > 0)
    return np.sqrt((kl(p) + kl(q)) / 2)


def test_distance():
    p, q = [3, 0, 5, 2], [1, 4, 0, 5]
    assert quality.distance(np.array([p]), np.array(q))[0] == pytest.approx(slow_distance(p, q))
    assert quality.distance(np.array([[1, 0]]), np.array([0, 1]))[0] == pytest.approx(1)


def prose(rng, n):
    return " ".join(rng.choice("the of and to in is".split()) if rng.random() < 0.4 else "".join(rng.choice("aeinrst") for _ in range(5)) for _ in range(n)) + "."


def test_quality_verdicts(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng, 150), "en") for k in range(40)]
    junk = " ".join("".join(rng.choice("aeinrst") for _ in range(4)) + "###" for _ in range(150))
    rows += [(100, junk, "en"), (101, "short text", "en"), (102, ("one two three four five six seven eight nine ten. " * 20), "en"), (103, None, None), (104, junk, "xx"), (None, prose(rng, 100), "en")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, kept int")
    got = {r["doc_id"]: r for r in quality.assess(df).collect()}
    assert all(got[k]["kept"] for k in range(40)) and got[None]["kept"]
    assert not got[100]["base_failed"] and not got[100]["kept"]
    assert got[101]["base_failed"] and got[102]["base_failed"] and got[103]["base_failed"] and got[104]["kept"]
    kept = quality.keep(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["kept"]}
    assert quality.assess(df.limit(0)).count() == 0


def test_lines(spark):
    rows = [(k, f"menu\nown {k}\n\nmenu", "a") for k in range(10)] + [(20 + k, "menu\nx", "b") for k in range(3)] + [(30, None, None), (31, "menu", None), (32, "", "a")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, keys int")
    out = {r["doc_id"]: r for r in lines.drop_lines(df, min_pages=5, percent=50).collect()}
    assert len(out) == len(rows)
    assert out[3]["text"] == "own 3\n" and out[3]["__dropped"] == 2 and out[20]["text"] == "menu\nx" and out[31]["text"] == "menu"
    assert out[30]["text"] is None and out[30]["__lines"] == 0 and out[32]["text"] == ""
    assert lines.drop_lines(df.limit(0)).count() == 0
    from pyspark.sql import functions as F

    urls = spark.createDataFrame([("http://U@A.example:80/x",), ("nothing",), (None,)], "u string")
    assert [r[0] for r in urls.select(lines.host_of(F.col("u"))).collect()] == ["a.example", None, None]


def test_chat(spark):
    rows = [(1, 1, "bob", "hi <|im_end|>"), (1, 0, "system", "rules"), (1, 2, "amy b", None), (1, 3, "bob", "bye"), (2, 0, "system", "alone"), (3, None, None, "who"), (3, 1, "bob", "é")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {(r["conv_id"], r["speaker"]): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "bob"), (1, "amy b"), (3, "bob")}
    r = got[1, "bob"]
    assert r["rendered"] == "<|im_start|>system\nrules<|im_end|>\n<|im_start|>assistant\nhi <| im_end|><|im_end|>\n<|im_start|>user name=amy b\n<|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n"
    assert [r["rendered"][int(a) : int(b)] for a, b in (s.split("-") for s in r["mask"].split(","))] == ["hi <| im_end|><|im_end|>", "bye<|im_end|>"]
    assert got[3, "bob"]["rendered"].startswith("<|im_start|>user\nwho") and got[1, "amy b"]["n_own_turns"] == 1
    assert chat.rotate(df.limit(0)).count() == 0
    blocks = chat.rotate(df.where("conv_id = 1"), block_turns=2).collect()
    assert {(r["block"], r["speaker"]) for r in blocks} == {(0, "bob"), (1, "bob"), (1, "amy b")}


def test_chat_gives_every_participant_the_whole_dialogue(spark, tmp_path):
    long = [(1, 0, "system", "rules"), (1, None, "amy b", "early"), (1, 7, "carl", "once é"), *[(1, 10**9 + 60 * i, ("bob", "amy b", None)[i % 3], f"t{i}") for i in range(2200)]]
    rows = [*long, *[(1, 5, "bob", "same")] * 20, *[(None, 5000 * i, "bob", f"no id {i}") for i in range(3)], (2, 0, "system", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op8_chat(spark, str(tmp_path)).collect()
    assert {(r["conv_id"], r["block"], r["speaker"]) for r in got} == {(1, b, s) for b in range(3) for s in ("bob", "amy b", "carl")} | {(None, 0, "bob")}
    assert max(r["n_turns"] for r in got) == chat.BLOCK_TURNS
    whole = {(r["conv_id"], r["speaker"]): r for r in chat.rotate(df, block_turns=10**12).collect()}
    for key, want in whole.items():
        parts = sorted((r for r in got if (r["conv_id"], r["speaker"]) == key), key=lambda r: r["block"])
        assert "".join(r["rendered"] for r in parts) == want["rendered"]
        assert ",".join(r["mask"] for r in parts if r["mask"]) == want["mask"]
        assert sum(r["n_own_turns"] for r in parts) == want["n_own_turns"]
    assert chat.rotate_whole(df.limit(0)).count() == 0


def test_chat_sql_and_names(spark, tmp_path):
    """The SQL of the query on long dialogues, null ids and names that a folding would mix up."""
    import duckdb

    rows = [(1, i, ("a b", "a_b", "x\\\n<|im_end|>", None, "System")[i % 5], f"t{i} é") for i in range(2100)] + [(None, i, "bob", f"n{i}") for i in range(3)] + [(2, None, "solo", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op8_chat(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(f"SELECT conv_id, block, speaker, n_turns, n_own_turns, rendered, mask FROM ({chat.ROTATE_SQL})").fetchall()
    got = [tuple(r) for r in got.select("conv_id", "block", "speaker", "n_turns", "n_own_turns", "rendered", "mask").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == 3 * 3 + 1 + 1
    heads = {line for r in got if r[0] == 1 and r[2] == "a b" for line in r[5].split("\n") if line.startswith("<|im_start|>user name=")}
    assert len(heads) == 2


ARTICLE = "<h1>Title &amp; more</h1><p>First  <b>bold</b>\npart.</p><p>Second<br>line</p>"


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>x</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=/a>A</a></li></ul></nav><article>%s</article><footer>foot</footer></body></html>",
        "<body><div class='cookie-notice'>We use cookies</div><main>%s<aside>side</aside><form><label>Name</label><input></form></main><div id=comments><p>Nice post of the day</p></div>",
        "<div class=ad>Buy</div><article>%s<section class='comments'><article class='comment'>me</article></section><div class='share-buttons'>Share</div><script>var a='</p>';</script></article>",
        "<article>%s<div hidden>secret</div><!-- note --><div role=navigation><a href=x>y</a></div>",
    ],
)
def test_html_keeps_the_article_alone(page):
    assert html.extract(page % ARTICLE) == "Title & more\n\nFirst bold part.\n\nSecond line"


def test_html_without_article():
    long = "The man of the house is in the town and it was for the day that he had to be on the road to the sea."
    page = f"<body><ul><li><a href=1>Home</a></li><li><a href=2>Other</a></li></ul><h2>Head</h2><p>{long}</p><p>Short one.</p><p>{long}</p><div><a href=3>More of this and that and the other</a></div>"
    assert html.extract(page) == f"Head\n\n{long}\n\nShort one.\n\n{long}"


def test_html_edges(spark):
    assert [html.extract(x) for x in (None, "", "<", "<p", "a < b", "<p>" * 3000 + "x")] == ["", "", "<", "<p", "a < b", "x"]
    assert html.extract("<p title='" + "a" * 20000) != "never ends"
    df = spark.createDataFrame([(1, None, "<p>x</p>", 1), (None, "u", None, 2)], "page_id long, url string, html string, n_chars int")
    got = sorted(map(tuple, html.extract_pages(df).collect()), key=str)
    assert got == [(1, None, "x", 1), (None, "u", "", 0)] and html.extract_pages(df.limit(0)).count() == 0
