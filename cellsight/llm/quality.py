"""Op 10: quality rules by the divergence of a document's histograms from language references.

One pass over the text gives every document its base counts, a histogram of
character classes and a histogram of common words. References are sums of these
histograms over all documents of a language that pass the base rules (a row for
each of the languages below, so their size is fixed). A document of enough words
is rejected if its Jensen-Shannon distance to the nearest reference exceeds the
limit for its length in either histogram; shorter documents stand by the base rules alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.llm.common import byte_view, covered, map_arrow, settle, texts_of, window_hashes, window_starts, word_hashes, word_spans

#: Common words of the languages with a reference, each at most eight bytes long.
COMMON_WORDS = {
    "en": "the of and to in a is that was for it with as on be by at from this are or an not have he you but they his her",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so dass sie nach bei aus",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son être",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si",
}
WORDS = sorted({w for ws in COMMON_WORDS.values() for w in ws.split()})
LANGUAGES = sorted(COMMON_WORDS)
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "latin", "other")
#: Production limits: words below which only the base rules count, and (a, b) of the largest distance that passes,
#: a + b / sqrt(words): chance alone moves the histogram of n words by about 1 / sqrt(n).
MIN_WORDS = 40
CLASS_LIMIT = (0.09, 1.25)
WORD_LIMIT = (0.11, 1.95)
#: Documents with more than one symbol in so many characters of words don't count towards the references.
REFERENCE_SYMBOLS = 20
BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _class_table() -> np.ndarray:
    """Class of every lead byte; bytes inside a code point have class 8 and are not counted."""
    t = np.full(256, 7, np.uint8)
    t[:128] = 5
    t[97:123], t[65:91], t[48:58] = 0, 1, 2
    t[[9, 10, 11, 12, 13, 32]] = 3
    t[[ord(c) for c in ".,;:!?'\"()-"]] = 4
    t[0xC2:0xCA] = 6
    t[0x80:0xC0] = 8
    return t


CLASS_OF = _class_table()
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
TRAILING = np.zeros(256, bool)
TRAILING[[ord(c) for c in ".,;:!?\"')"]] = True
WORD_KEYS = np.array([int.from_bytes(w.encode(), "little") for w in WORDS], np.uint64)
WORD_ORDER = np.argsort(WORD_KEYS)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """Base counts and both histograms of every text of a column, in numpy over all texts at once."""
    raw, offsets = byte_view(texts)
    n = len(offsets) - 1
    starts, ends, first = word_spans(raw, offsets)
    sums = lambda flags, at: (lambda c: c[at[1:]] - c[at[:-1]])(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)]))
    kinds = CLASS_OF[raw]
    doc_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    classes = np.bincount(doc_of_byte * 9 + kinds, minlength=9 * n).reshape(n, 9)[:, :8] if n else np.zeros((0, 8), np.int64)
    out = {"n_words": np.diff(first), "word_chars": classes.sum(1) - classes[:, 3], "n_symbols": sums(SYMBOL[raw], offsets), "classes": classes}
    hashes = word_hashes(raw, starts, ends)
    at, doc = window_starts(first, 8)
    if len(at):
        keys = window_hashes(hashes, 8)[at] + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        repeated = covered(at[twice], 8, len(starts))
    else:
        repeated = np.zeros(len(starts), bool)
    out["n_repeat_words"] = sums(repeated, first)
    # common words: lower case A-Z, without trailing punctuation, compared as eight bytes
    lower = np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)
    stop = ends.copy()
    for _ in range(2):
        stop -= (TRAILING[raw[stop - 1]] & (stop - starts > 1)) if len(stop) else 0
    size = stop - starts
    short = size <= 8
    lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate([lower, np.zeros(8, np.uint8)]), 8)
    key = np.ascontiguousarray(lanes[starts[short]]).view("<u8").ravel()
    keep = size[short].astype(np.uint64) * np.uint64(8)
    key = np.where(keep < 64, key & ((np.uint64(1) << np.minimum(keep, np.uint64(63))) - np.uint64(1)), key)
    place = np.minimum(np.searchsorted(WORD_KEYS[WORD_ORDER], key), len(WORDS) - 1)
    hit = WORD_KEYS[WORD_ORDER][place] == key
    doc_of_word = np.repeat(np.arange(n), np.diff(first))
    out["common"] = np.bincount(doc_of_word[short][hit] * len(WORDS) + WORD_ORDER[place[hit]], minlength=n * len(WORDS)).reshape(n, len(WORDS)) if n else np.zeros((0, len(WORDS)), np.int64)
    dup = []
    for t in texts_of(texts):
        lines = [x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
        dup.append(len(lines) - len(set(lines)))
    out["n_dup_lines"] = np.array(dup, np.int64)
    return out


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence in bits, 0 to 1) of every row of counts ``p`` to counts ``q``."""
    p = p / np.maximum(p.sum(-1, keepdims=True), 1)
    q = q / max(q.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(p > 0, p * np.log2(p / m), 0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip(kl / 2, 0, 1))


def distances(classes: np.ndarray, common: np.ndarray, n_words: np.ndarray, references: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Smallest distance of each document to any reference, by character classes and by common words (with one bin for all others)."""
    by_class, by_word = np.ones(len(classes)), np.ones(len(classes))
    for language, (ref_classes, ref_words) in references.items():
        own = [WORDS.index(w) for w in COMMON_WORDS[language].split()]
        mine = common[:, own]
        mine = np.hstack([mine, (n_words - mine.sum(1))[:, None]])
        by_class = np.minimum(by_class, distance(classes, ref_classes))
        by_word = np.minimum(by_word, distance(mine, np.append(ref_words[own], ref_words[-1] - ref_words[own].sum())))
    return by_class, by_word


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """One row for each input row: id, language, base counts, ``classes`` and ``common`` histograms.

    A null text counts as empty; a missing language column as null; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(batch.column(2))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().astype(np.int32)))
        base = [pa.array(m[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *base, lists(m["classes"]), lists(m["common"])], names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common"])

    lang = docs[lang_column].cast("string") if lang_column in docs.columns else F.lit(None).cast("string")
    frame = docs.select(docs[id_column].cast("long").alias("doc_id"), lang.alias("lang"), docs[text_column].cast("string").alias("text"))
    return map_arrow(frame, run, f"doc_id long, lang string, {BASE_SCHEMA}, classes array<int>, common array<int>")


def references(measured: DataFrame, min_words: int = MIN_WORDS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sums over all documents of each language that pass the base rules and aren't full of symbols: classes, and common words followed by all words.

    At most one row for each language of ``COMMON_WORDS`` comes to the driver.
    """
    passing = measured.where((F.col("n_words") >= max(20, min_words)) & (100 * F.col("n_repeat_words") <= 30 * F.col("n_words")) & (REFERENCE_SYMBOLS * F.col("n_symbols") <= F.col("word_chars")) & F.col("lang").isin(LANGUAGES))
    sums = [F.sum(F.col("classes")[i].cast("long")).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.col("common")[i].cast("long")).alias(f"w{i}") for i in range(len(WORDS))]
    rows = passing.groupBy("lang").agg(*sums, F.sum("n_words").alias("n")).collect()
    return {r["lang"]: (np.array([r[f"c{i}"] for i in range(len(CLASSES))], float), np.array([r[f"w{i}"] for i in range(len(WORDS))] + [r["n"]], float)) for r in rows}


def verdict(n_words, n_repeat_words, classes, common, langs, refs, min_words: int = MIN_WORDS, class_limit: tuple = CLASS_LIMIT, word_limit: tuple = WORD_LIMIT):
    """Base rules failed, kept, not judged by distance, and both distances, for rows of histograms."""
    failed = base_failed(n_words, n_repeat_words)
    known = np.array([x is None or x in refs for x in langs], bool)
    skip = (n_words < min_words) | ~known | (not refs)
    by_class, by_word = distances(classes, common, n_words, refs)
    root = np.sqrt(np.maximum(n_words, 1))
    kept = ~failed & (skip | ((by_class <= class_limit[0] + class_limit[1] / root) & (by_word <= word_limit[0] + word_limit[1] / root)))
    return failed, kept, skip, by_class, by_word


def judge(measured: DataFrame, refs: dict, **limits) -> DataFrame:
    """``doc_id``, base counts, ``base_failed``, ``class_distance``, ``word_distance``, ``kept``.

    Distances are null below ``min_words`` words, for a named language without a reference, and if there is no reference at all;
    such documents are kept if the base rules pass.
    """

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                n_words, repeat = col["n_words"].to_numpy(), col["n_repeat_words"].to_numpy()
                classes = col["classes"].flatten().to_numpy().reshape(-1, len(CLASSES))
                common = col["common"].flatten().to_numpy().reshape(-1, len(WORDS))
                failed, kept, skip, by_class, by_word = verdict(n_words, repeat, classes, common, col["lang"].to_pylist(), refs, **limits)
                yield pa.RecordBatch.from_arrays(
                    [*(col[k] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(kept), pa.array(by_class, mask=skip), pa.array(by_word, mask=skip)],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"],
                )

    return measured.mapInArrow(run, f"doc_id long, {BASE_SCHEMA}, base_failed boolean, kept boolean, class_distance double, word_distance double")


def assess(docs: DataFrame, **limits) -> DataFrame:
    """Base counts and verdict of every document; the text is read once, the histograms are kept in the shared folder."""
    measured = settle(features(docs), "quality")
    return judge(measured, references(measured), **limits)


def keep(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows of ``docs`` (all columns) that the rules keep.

    The references are aggregated in a first pass over the text; the second judges every row for itself, so ids may be
    null or repeat and no text moves between tasks.
    """
    refs = references(features(docs, id_column, text_column, lang_column))
    columns = docs.columns
    text_at, lang_at = columns.index(text_column), columns.index(lang_column) if lang_column in columns else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(batch.column(text_at).cast(pa.string()))
        langs = batch.column(lang_at).to_pylist() if lang_at is not None else [None] * batch.num_rows
        return batch.filter(pa.array(verdict(m["n_words"], m["n_repeat_words"], m["classes"], m["common"], langs, refs)[1]))

    return map_arrow(docs, run, docs.schema, text_column)
