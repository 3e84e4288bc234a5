import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from cellsight.llm import audio, packing, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = ["Hello, WORLD", None, "", "  a\tb  ", "é日本 x" * 30, "same", "same", "<|endoftext|> odd ́ mark", "word " * 3000]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_codes_random_access():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 50_000, 3000), rng.integers(0, 256, 600), [0, 255, 256, 65535, 65536, 2**32 - 1]]).astype(np.uint32)
    data = token_files.write_codes(ids, [1, None, 3], np.array([10, 10, len(ids)]))
    c = token_files.Codes(data)
    assert c.range(0, len(ids)).tolist() == ids.tolist()
    for a in (0, 1, 7, 511, 512, 513, 1024, len(ids) - 1):
        assert c.get(a) == ids[a] and c.range(a, min(a + 700, len(ids))).tolist() == ids[a : a + 700].tolist()
    assert c.valid.tolist() == [True, False, True] and c.ends.tolist() == [10, 10, len(ids)]
    with pytest.raises(IndexError):
        c.get(len(ids))
    assert token_files.Codes(token_files.write_codes(np.zeros(0, np.uint32), [], np.zeros(0))).n == 0


def test_token_files(spark, monkeypatch):
    lib = library("word_bpe_49k.json")
    rows = [(10 * k % 7 + k, t, "n") for k, t in enumerate(TEXTS)]
    monkeypatch.setattr(token_files, "FILE_IDS", 64)
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r for r in token_files.store(df).collect()}
    start = 0
    for d, t, _ in sorted(rows):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    assert token_files.store(df.limit(0)).count() == 0
    twice = token_files.store(df.union(df)).collect()
    assert len(twice) == 2 * len(rows) and sum(r["n_tokens"] for r in twice) == 2 * start


ODD = ["a", "É", "ß", "İ", "Σ", "ª", "µ", "×", "÷", "ÿ", "日", "1", "'", "'S", "'ll", ".", ",", "!", "~", "\u0301", "\u0338", "=", "<", "\x1c", "\xa0", "\u2003", "\x00", "<|endoftext|>", "<|", "|>", "_", " ", "\n", "the"]


def test_words_of_one_stem_go_to_the_model_once(monkeypatch):
    lib = library("word_bpe_49k.json")
    tok = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    asked, whole, model = [], [], tok.library.model

    class Model:
        def tokenize(self, word):
            asked.append(word)
            return model.tokenize(word)

    pieces, tok.model = tok._encode_pieces, Model()
    monkeypatch.setattr(tok, "_encode_pieces", lambda odd: whole.extend(odd) or pieces(odd))
    text = "Zebra zebra, zebra. ZEBRA!! (zebra) zebra's ÉTÉ, été !!"
    for _ in range(2):
        assert np.frombuffer(tok.encode_packed([text])[0], "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) == 5 and asked.count("zebra") == 1 and "(zebra)" in whole and "zebra," not in whole


@pytest.mark.parametrize("limits", [(300_000, 64), (3, 2)])
def test_words_equal_the_library(monkeypatch, limits):
    monkeypatch.setattr(token_files, "MAX_WORDS", limits[0])
    monkeypatch.setattr(token_files, "LONG_WORD", limits[1])
    lib = library("word_bpe_49k.json")
    tok = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + ["ab" * 3000 + ".", "É" * 65 + " " + "é" * 65 + ",", "x" + "!" * 200, ""]
    texts += [f"{chr(c)}{mark} x{chr(c)}{mark}" for c in range(0x21, 0x250) for mark in ("", ".", "'", "<")]
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        assert [np.frombuffer(x, "<u4").tolist() for x in tok.encode_packed(part)] == [e.ids for e in lib.encode_batch(part, add_special_tokens=False)]
    assert all(len(w) <= limits[1] for w in tok.fresh)


def test_packing(spark):
    lib = library("byte_bpe_50k.json")
    rng = random.Random(2)
    rows = [(k, t, 1) for k, t in enumerate(TEXTS)] + [(100 + k, " ".join(rng.choice(["the", "of", "zebra"]) for _ in range(rng.randint(0, 900))), 2) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(df, with_ids=True).collect()
    by, seq = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append(r)
    for d, t, _ in rows:
        ids, at = lib.encode(t or "", add_special_tokens=False).ids + [0], 0
        for r in sorted(by[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids"] == ids[at : at + r["length"]] and r["ids_crc32"] == crc(r["ids"])
            at += r["length"]
        assert at == len(ids)
    for rs in seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack(df.limit(0)).count() == 0


def test_step_groups_are_balanced():
    sizes = [1024] * 50 + [512] * 30 + [128] * 40
    groups = packing.step_groups(sizes, 8192)
    load = {}
    for s, g in zip(sizes, groups):
        load[g] = load.get(g, 0) + s
    assert len(load) == -(-sum(sizes) // 8192) and max(load.values()) - min(load.values()) <= 1024


def test_companding_tables():
    # known points of G.711
    assert audio.MULAW_TABLE[0xFF] == 0 and audio.MULAW_TABLE[0x00] == -32124 and audio.MULAW_TABLE[0x80] == 32124
    assert audio.ALAW_TABLE[0xD5] == 8 and audio.ALAW_TABLE[0x55] == -8 and audio.ALAW_TABLE[0xAA] == 32256 and audio.ALAW_TABLE[0x2A] == -32256
    for kind in (audio.MULAW, audio.ALAW):
        codes = np.arange(256, dtype=np.uint8)
        assert (audio.expand(audio.compand(audio.expand(codes, kind), kind), kind) == audio.expand(codes, kind)).all()


def slow_ima(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.IMA_STEPS[index])
            move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + int(audio.IMA_INDEX[code & 7])))
            out.append(value)
    return out


def test_adpcm():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (20, 192), dtype=np.uint8)
    got = audio.ima_decode(blocks)
    assert [r.tolist() for r in got] == [slow_ima(b.tobytes()) for b in blocks]
    wave = (8000 * np.sin(np.arange(3000) / 20)).astype(np.int16)
    back = audio.ima_decode(audio.ima_encode(wave)).ravel()[: len(wave)]
    assert np.abs(back.astype(int) - wave).mean() < 200
    data = audio.wav(audio.ima_encode(wave).tobytes(), audio.IMA, 8000, 192)
    samples, rate = audio.samples_of(data)
    assert rate == 8000 and (samples[: len(wave)] == back).all()


def slow_resample(samples, rate, target):
    """Every output sample by itself, in fractions: a point between two samples, or the mean over its interval."""
    out = []
    for i in range(len(samples) * target // rate):
        begin = Fraction(i * rate, target)
        if target > rate:
            k = int(begin)
            after = samples[min(k + 1, len(samples) - 1)]
            out.append(samples[k] + (after - samples[k]) * (begin - k))
        else:
            end = begin + Fraction(rate, target)
            out.append(sum(s * (min(end, k + 1) - max(begin, k)) for k, s in enumerate(samples) if k < end and k + 1 > begin) / (end - begin))
    return out


def slow_feature(payload):
    s = [int(audio.MULAW_TABLE[b]) for b in payload]
    s = [round((a + b) / 2) for a, b in zip(s[::2], s[1::2])]  # from 8 to 4 kHz
    ima = [v for i in range(0, len(payload), 192) for v in slow_ima(payload[i : i + 192])]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(s, s[1:]))
    return f"n={len(s)};energy={sum(x * x for x in s)};crossings={crossings};peak={max(map(abs, s))};alaw={sum(abs(int(audio.ALAW_TABLE[b])) for b in payload)};ima_peak={max(ima)};ima_sum={sum(map(abs, ima))}"


def test_resampling():
    rng = np.random.default_rng(0)
    for rate, target in ((8000, 4000), (8000, 6000), (8000, 16000), (16000, 8000), (8000, 11025)):
        for n in (1, 2, 7, 150):
            s = rng.integers(-30000, 30000, n).astype(np.int16)
            assert all(abs(a - b) < 0.501 for a, b in zip(audio.resample(s, rate, target).tolist(), slow_resample(s.tolist(), rate, target), strict=True))
    at = np.arange(4000)
    for f, level in ((3700, 0.15), (300, 0.98)):
        wave = (10000 * np.sin(2 * np.pi * f / 8000 * at)).astype(np.int16)
        out = audio.resample(wave, 8000, 4000)[100:-100].astype(float)
        ratio = np.sqrt((out**2).mean()) / np.sqrt((wave.astype(float) ** 2).mean())
        assert ratio < level if f > 3000 else ratio > level  # no alias from above half the lower rate


def test_media_table(spark):
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(TEXTS)], "doc_id long, text string, media int")
    got = {r["doc_id"]: r for r in audio.store_and_read(df).collect()}
    for k, t in enumerate(TEXTS):
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        stored = audio.wav(p, audio.MULAW)
        assert r["media_bytes"] == len(stored) and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
        assert r["feature"] == slow_feature(p)
    assert got[5]["feature"] == got[6]["feature"] and audio.law_features([b"a" * 192, b"b" * 384])[0] == audio.law_features([b"a" * 192])[0]
    assert audio.store_and_read(df.limit(0)).count() == 0
    stereo, no_block = bytearray(audio.wav(b"\x10" * 100, audio.MULAW)), bytearray(audio.wav(b"\x10" * 192, audio.IMA, block=192))
    stereo[22], no_block[32] = 2, 0
    media = [(1, bytearray(audio.wav(b"\x10" * 100, audio.MULAW))), (2, None), (3, bytearray(b"junk")), (4, stereo), (5, no_block)]
    pcm = audio.to_pcm(spark.createDataFrame(media, "doc_id long, media binary"), 16000).collect()
    assert [r["n_samples"] for r in sorted(pcm)] == [200, None, None, None, None]
