"""Op 2: substring deduplication with a log-structured index of fingerprints.

A word is removed if a window of 13 words covers it whose word sequence also
starts in a document with a smaller id. Every window has an anchor: the five-word
gram with the least hash among the nine in it. Equal windows have equal anchors,
so a window can repeat only where its anchor does; neighbouring windows share
anchors, so there is one for about five windows.

The index holds immutable runs of three kinds, one of each for a batch.
Evidence: the word hashes of every text, so no text is read again. Anchors: one
row for each anchor hash, with the least id that has it and whether a second one
does. Windows: the 96-bit fingerprints of all 13 words of windows whose anchor
repeats, each with the least id where it starts. A new batch's anchors are
aggregated to a run and merge-joined with the runs before; windows of repeated
anchors are verified from the evidence, of this batch and, where an anchor was
unique so far, of its owner's. When ``fan_out`` runs of a tier have come together
they are compacted to one of the next tier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsight.llm.common import bound_batches, byte_view, covered, dropping_shuffles, map_arrow, scratch_path, window_hashes, window_starts, word_hashes, word_spans

WINDOW = 13
GRAM = 5
FAN_OUT = 4
#: Rounds in which the query feeds the index, each with a range of ids.
BATCHES = 3
#: Bytes of a word's hash in the evidence.
WORD_BYTES = 6
SECOND_BASE = 0x165667B19E3779F9


def _evidence_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The word hashes of every text of at least one window, six bytes each."""
    raw, offsets = byte_view(batch.column(1))
    starts, ends, first = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends).view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]
    long = np.flatnonzero(np.diff(first) >= WINDOW)
    found = [words[first[i] : first[i + 1]].tobytes() for i in long.tolist()]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(long)), batch.column(2).take(pa.array(long)), pa.array(found, pa.binary())], names=["doc_id", "row", "words"])


def word_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of a column of evidence, and the number of words before each of its texts."""
    values = column.to_pylist()
    first = np.concatenate([[0], np.cumsum([len(x) // WORD_BYTES for x in values], dtype=np.int64)]).astype(np.int64)
    words = np.zeros((first[-1], 8), np.uint8)
    words[:, :WORD_BYTES] = np.frombuffer(b"".join(values), np.uint8).reshape(-1, WORD_BYTES)
    return words.view(np.uint64).ravel(), first


def anchored(words: np.ndarray, first: np.ndarray, size: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, text and anchor's hash (the least gram hash in the window) of every window of texts of word hashes."""
    at, doc = window_starts(first, size)
    if not len(at):
        return at, doc, np.zeros(0, np.uint64)
    grams = window_hashes(words, gram)
    least, span, width = grams, size - gram + 1, 1
    while 2 * width <= span:  # least of 1, 2, 4, 8 neighbours
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (span - width)], least[span - width :]) if span > width else least
    return at, doc, least[at]


def _anchors_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    _, doc, anchor = anchored(*word_view(batch.column(1)))
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(doc):
        return None
    change = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    doc, anchor = doc[change], anchor[change]
    order = np.lexsort((anchor, doc))
    doc, anchor = doc[order], anchor[order]
    keep = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    return pa.RecordBatch.from_arrays([pa.array(anchor[keep].astype(np.int64)), pa.array(ids[doc[keep]])], names=["anchor", "doc_id"])


def _windows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Both fingerprints and the place of every window whose anchor is listed for its document."""
    words, first = word_view(batch.column(2))
    at, doc, anchor = anchored(words, first)
    lists = batch.column(3)
    sizes = np.diff(np.asarray(lists.offsets))
    flat = lists.flatten().to_numpy().astype(np.uint64)
    salt = lambda d: d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    wanted = np.sort(flat + salt(np.repeat(np.arange(len(sizes)), sizes)))
    mine = anchor + salt(doc)
    place = np.minimum(np.searchsorted(wanted, mine), max(len(wanted) - 1, 0))
    pick = np.flatnonzero(wanted[place] == mine) if len(wanted) else np.zeros(0, np.int64)
    if not len(pick):
        return None
    ids, rows = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy().astype(np.int32)
    begin, doc = at[pick], doc[pick]
    second = window_hashes(words, WINDOW, SECOND_BASE)
    return pa.RecordBatch.from_arrays(
        [pa.array(window_hashes(words, WINDOW)[begin].astype(np.int64)), pa.array((second[begin] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(ids[doc]), pa.array(rows[doc]), pa.array((begin - first[:-1][doc]).astype(np.int32))],
        names=["fp", "check", "doc_id", "row", "place"],
    )


def _remaining(texts: pa.Array, lists: pa.Array) -> Iterator[tuple[int, int, bytes]]:
    """Words, removed words, and the others joined by spaces, for every text and the places of its repeated windows."""
    raw, offsets = byte_view(texts)
    starts, ends, first = word_spans(raw, offsets)
    lists = lists.fill_null([]) if lists.null_count else lists
    sizes = np.diff(np.asarray(lists.offsets))
    flat = lists.flatten().to_numpy().astype(np.int64)
    gone = covered(flat + np.repeat(first[:-1], sizes), WINDOW, len(starts))
    data = raw.tobytes()
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        out = gone[a:b]
        n = int(out.sum())
        if n:
            stay = np.flatnonzero(~out) + a
            yield int(b - a), n, b" ".join([data[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist())])
        else:
            yield int(b - a), 0, b" ".join(data[offsets[i] : offsets[i + 1]].split())


def _kept_of(batch: pa.RecordBatch, with_text: bool = True) -> pa.RecordBatch:
    """Counts and the joined remaining words (or their digest alone), from the places of repeated windows."""
    found = list(_remaining(batch.column(1), batch.column(2)))
    columns = [batch.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for *_, x in found], pa.string())]
    columns += [pa.array([x.decode() for *_, x in found], pa.string())] * with_text
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)


PLACES = "doc_id long, row int, place int"


def row_of(text: str) -> Column:
    """What tells rows of one id apart."""
    return F.hash(F.col(text).cast("string"))


class FingerprintIndex:
    """Grows by batches of documents with ascending ids; ``ingest`` returns the repeated windows of a batch."""

    EVIDENCE = "doc_id long, row int, words binary"
    ANCHORS = "anchor long, least long, shared boolean"
    WINDOWS = "fp long, check int, least long"
    FOUND = "fp long, check int, doc_id long, row int, place int"

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT):
        self.spark, self.fan_out = spark, fan_out
        self.evidence: list[str] = []
        #: Runs by kind, oldest first: ``(tier, path)``.
        self.runs: dict[str, list[tuple[int, str]]] = {"anchors": [], "windows": []}

    def _write(self, df: DataFrame, name: str) -> str:
        path = scratch_path(self.spark, name)
        with dropping_shuffles(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return path

    def _read(self, schema: str, *paths: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths)

    def _drop(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _history(self, kind: str, schema: str) -> DataFrame | None:
        paths = [p for _, p in self.runs[kind]]
        return self._read(schema, *paths) if paths else None

    @staticmethod
    def merge_anchors(rows: DataFrame) -> DataFrame:
        """One row for each anchor: the least id that has it, and whether another one does."""
        merged = rows.groupBy("anchor").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("shared").alias("shared"))
        return merged.select("anchor", "least", (F.col("shared") | (F.col("least") < F.col("most"))).alias("shared")).sortWithinPartitions("anchor")

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Index ``batch`` (``doc_id, text``) and return ``doc_id, row, place`` of its windows that start in a document with a smaller id.

        ``row`` is a hash of the text, so that rows which share an id keep their own places. All ids of a batch must be greater
        than those of the batches before; null ids are left out. The batch is read once.
        """
        bound_batches(self.spark)
        texts = batch.where("doc_id is not null").select("doc_id", "text", row_of("text").alias("row"))
        evidence = self._write(map_arrow(texts, _evidence_of, self.EVIDENCE), "evidence")
        own = self._read(self.EVIDENCE, evidence)
        postings_path = self._write(map_arrow(own.select("doc_id", "words"), _anchors_of, "anchor long, doc_id long", "words"), "postings")
        postings = self._read("anchor long, doc_id long", postings_path)
        rows = postings.select("anchor", F.col("doc_id").alias("least"), F.col("doc_id").alias("most"), F.lit(False).alias("shared"))
        run = self._write(self.merge_anchors(rows), "anchors")
        new, old = self._read(self.ANCHORS, run), self._history("anchors", self.ANCHORS)
        if old is None:
            live_path, targets = self._write(new.where("shared").select("anchor"), "live"), None
        else:
            # merge join of the new run with all before: anchors of the batch that repeat, and first owners not yet verified
            past = old.groupBy("anchor").agg(F.min("least").alias("owner"), (F.max("shared") | (F.count("*") > 1)).alias("known"))
            live_path = self._write(new.join(past, "anchor", "left").where("shared or owner is not null").select("anchor", "owner", "known"), "live")
            targets = self._read("anchor long, owner long, known boolean", live_path).where("owner is not null and not known").select("anchor", F.col("owner").alias("doc_id"))
        lists = lambda rows: rows.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
        live = self._read("anchor long", live_path)
        found = [self._verify(lists(postings.join(live, "anchor").select("anchor", "doc_id")), [evidence])]
        self._drop(postings_path)
        if targets is not None:
            found.append(self._verify(lists(targets), self.evidence))
        self._drop(live_path)
        low = own.agg(F.min("doc_id")).first()[0]
        self.evidence.append(evidence)
        windows = self._read(self.FOUND, *found)
        firsts = windows.groupBy("fp", "check").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        window_run = self._write(firsts.sortWithinPartitions("fp"), "windows")
        known = self._read(self.WINDOWS + ", most long", window_run)
        past = self._history("windows", self.WINDOWS)
        if past is not None:
            past = past.groupBy("fp", "check").agg(F.min("least").alias("past"))
            known = known.join(past, ["fp", "check"], "left").select("fp", "check", F.least("least", "past").alias("least"), "most")
        known = known.where("least < most").drop("most")
        known_path = self._write(known, "known")
        known = self._read(self.WINDOWS, known_path)
        mine = windows.where(F.col("doc_id") >= F.lit(low)) if low is not None else windows
        out_path = self._write(mine.join(known, ["fp", "check"]).where("least < doc_id").select("doc_id", "row", "place"), "repeats")
        for p in (*found, known_path):
            self._drop(p)
        self.runs["anchors"].append((0, run))
        self.runs["windows"].append((0, window_run))
        return self._read(PLACES, out_path)

    def _verify(self, wanted: DataFrame, evidence: list[str]) -> str:
        """Write the fingerprints and places of all windows of the wanted anchors (``doc_id, anchors``)."""
        wanted_path = self._write(wanted, "wanted")
        lists = self._read("doc_id long, anchors array<long>", wanted_path)
        words = self._read(self.EVIDENCE, *evidence).join(lists.hint("shuffle_hash"), "doc_id").select("doc_id", "row", "words", "anchors")
        path = self._write(map_arrow(words, _windows_of, self.FOUND, "words"), "windows")
        self._drop(wanted_path)
        return path

    def compact(self) -> None:
        """Merge runs until no tier has ``fan_out`` of them."""
        for kind, schema in (("anchors", self.ANCHORS), ("windows", self.WINDOWS)):
            runs = self.runs[kind]
            while full := [t for t in {t for t, _ in runs} if sum(t == u for u, _ in runs) >= self.fan_out]:
                tier = min(full)
                old = [p for t, p in runs if t == tier]
                rows = self._read(schema, *old)
                merged = self.merge_anchors(rows.withColumn("most", F.col("least"))) if kind == "anchors" else rows.groupBy("fp", "check").agg(F.min("least").alias("least")).sortWithinPartitions("fp")
                path = self._write(merged, kind)
                runs[:] = [r for r in runs if r[1] not in old] + [(tier + 1, path)]
                for p in old:
                    self._drop(p)

    def close(self) -> None:
        """Remove the index; what ``ingest`` returned stays."""
        for p in [*self.evidence, *(p for runs in self.runs.values() for _, p in runs)]:
            self._drop(p)
        self.evidence, self.runs = [], {"anchors": [], "windows": []}


def repeated_places(frame: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``__id, __row, __places`` of ``doc_id, text``: where the repeated windows of every document that has some start."""
    spark = frame.sparkSession
    index, found = FingerprintIndex(spark), []
    # ranges of ids with about equally many documents; a range of equal cuts is empty
    cuts = frame.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10000).alias("cuts"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first() if batches > 1 else frame.agg(F.lit(None).alias("cuts"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    if cuts["low"] is not None:
        edges = sorted({cuts["low"], *(cuts["cuts"] or []), cuts["high"] + 1})
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            found.append(index.ingest(frame.where((F.col("doc_id") >= a) & (F.col("doc_id") < b))))
            if k + 2 < len(edges):
                index.compact()
    index.close()
    places = reduce(DataFrame.union, found) if found else spark.createDataFrame([], PLACES)
    return places.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_list("place").alias("__places"))


def _with_places(docs: DataFrame, id_column: str, text_column: str, batches: int) -> DataFrame:
    """``docs`` with the key of every row and its places (null where it has none)."""
    keyed = docs.withColumn("__doc", docs[id_column].cast("long")).withColumn("__hash", row_of(text_column))
    frame = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    found = repeated_places(frame, batches)
    return keyed.join(found.hint("shuffle_hash"), (F.col("__doc") == F.col("__id")) & (F.col("__hash") == F.col("__row")), "left")


def remove_repeats(docs: DataFrame, batches: int = BATCHES, id_column: str = "doc_id", text_column: str = "text", with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and, unless told otherwise, ``kept_text`` of every row.

    The index is fed with ``batches`` ranges of ids. Null texts have no words; rows with a null id lose none; rows that
    share an id are one document (windows they share are no repeats), each with its own text; texts under 13 words lose none.
    """
    joined = _with_places(docs.select(docs[id_column], docs[text_column]), id_column, text_column, batches)
    rows = joined.select(F.col("__doc").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.col("__places").alias("places"))
    return map_arrow(rows, partial(_kept_of, with_text=with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def drop_repeats(docs: DataFrame, batches: int = BATCHES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns: repeated words are taken out of the text, the others joined by spaces.

    A text that loses none stays as it is, nulls too. Rows and ids are treated as in ``remove_repeats``.
    """
    joined = _with_places(docs, id_column, text_column, batches)
    names = docs.columns
    n, at = len(names), names.index(text_column)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        hit = np.flatnonzero(batch.column(n).is_valid().to_numpy(zero_copy_only=False))
        if len(hit):
            for i, (_, removed, text) in zip(hit.tolist(), _remaining(batch.column(at).take(pa.array(hit)), batch.column(n).take(pa.array(hit)))):
                if removed:
                    texts[i] = text.decode()
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(n)], names=names)

    rows = joined.select(*[F.col(c).cast("string").alias(c) if c == text_column else F.col(c) for c in docs.columns], "__places")
    return map_arrow(rows, run, rows.drop("__places").schema, text_column)
