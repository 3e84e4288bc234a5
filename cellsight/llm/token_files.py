"""Op 6: token ids in files of directly addressable codes.

A file holds ids as chunks of eight bits on levels. Level 0 has the low chunk
of every id, level k the next chunk of those ids that go on; a bitmap on every
level tells which go on, and a rank directory (set bits before each block of
512) gives an id's place on the next level. Any id, and any range of ids, is
read without decoding what comes before it.

Layout, all little-endian: the magic ``DACT``, version u32, number of ids u64,
number of documents u64, number of levels u32, zero u32; for every level its
length u64, chunks, bitmap, rank directory u64[]; then doc ids i64[], their
validity u8[] and the end of every document u64[]. Arrays start at multiples of eight.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellsight.llm.bpe import byte_alphabet
from cellsight.llm.common import bound_batches, chunks, scratch_path, settle, texts_of

MAGIC = b"DACT"
CHUNK = 8
RANK_BLOCK = 512
#: Ids in a file at most, but for one longer document.
FILE_IDS = 4 << 20
#: Bounds of one generation of the cache of encoded words, and of the length of a word kept there.
MAX_WORDS = 300_000
LONG_WORD = 64
#: The settings under which a piece that ``PLAIN`` matches is the two words of the model that it finds.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
LETTERS, MARKS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]", r"[!-/:-@\[-`{-~]"
PLAIN = re.compile(f"({LETTERS}+)({MARKS}*)")
PLAIN_PART = re.compile(f"{LETTERS}*{MARKS}*")
STAND_INS = {b: c for c, b in byte_alphabet().items()}


def _padded(b: bytes) -> bytes:
    return b + bytes(-len(b) % 8)


def write_codes(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
    """The bytes of one file; ``ids`` unsigned 32-bit, ``ends`` the end of every document among them."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        high = rest >> np.uint32(CHUNK)
        more = high > 0
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more.astype(np.int64), np.arange(0, len(more), RANK_BLOCK)) if len(more) else np.zeros(0, np.int64)
        ranks = (np.cumsum(counts) - counts).astype("<u8")
        levels.append(len(rest).to_bytes(8, "little") + _padded((rest & np.uint32(255)).astype(np.uint8).tobytes()) + _padded(bits.tobytes()) + ranks.tobytes())
        rest = high[more]
        if not len(rest):
            break
    head = MAGIC + (1).to_bytes(4, "little") + len(ids).to_bytes(8, "little") + len(doc_ids).to_bytes(8, "little") + len(levels).to_bytes(4, "little") + bytes(4)
    tail = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + _padded(np.array([x is not None for x in doc_ids], np.uint8).tobytes()) + np.asarray(ends, "<u8").tobytes()
    return head + b"".join(levels) + tail


class Codes:
    """Random access to the ids of one file's bytes (or of a memory map of it)."""

    def __init__(self, data):
        raw = np.frombuffer(data, np.uint8)
        if raw[:4].tobytes() != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        word = lambda at, kind="<u8", n=1: np.frombuffer(data, kind, n, at)
        self.n, n_docs, n_levels, at = int(word(8)[0]), int(word(16)[0]), int(word(24, "<u4")[0]), 32
        self.levels = []
        for _ in range(n_levels):
            n, at = int(word(at)[0]), at + 8
            chunk, at = raw[at : at + n], at + n + -n % 8
            bits, at = raw[at : at + (n + 7) // 8], at + (m := (n + 7) // 8) + -m % 8
            blocks = -(-n // RANK_BLOCK)
            self.levels.append((chunk, bits, word(at, "<u8", blocks)))
            at += 8 * blocks
        self.doc_ids, at = word(at, "<i8", n_docs), at + 8 * n_docs
        self.valid, at = raw[at : at + n_docs].astype(bool), at + n_docs + -n_docs % 8
        self.ends = word(at, "<u8", n_docs).astype(np.int64)

    def rank(self, level: int, i: int) -> int:
        """Set bits before place ``i`` of a level's bitmap."""
        _, bits, ranks = self.levels[level]
        block = i // RANK_BLOCK
        if block >= len(ranks):
            if not len(ranks):
                return 0
            block = len(ranks) - 1
        begin = block * RANK_BLOCK // 8
        window = np.unpackbits(bits[begin : (i + 7) // 8], bitorder="little")
        return int(ranks[block]) + int(window[: i - block * RANK_BLOCK].sum())

    def get(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k, (chunk, bits, _) in enumerate(self.levels):
            out |= int(chunk[i]) << (CHUNK * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self.rank(k, i)
        return out

    def range(self, a: int, b: int) -> np.ndarray:
        """The ids at places ``a`` to ``b`` (exclusive)."""
        out = np.zeros(b - a, np.uint32)
        at = np.arange(b - a)
        for k, (chunk, bits, _) in enumerate(self.levels):
            out[at] |= chunk[a:b].astype(np.uint32) << np.uint32(CHUNK * k)
            begin = a // 8
            more = np.unpackbits(bits[begin : (b + 7) // 8], bitorder="little")[a - 8 * begin : b - 8 * begin].astype(bool)
            at = at[more]
            if not len(at):
                break
            a = self.rank(k, a)
            b = a + len(at)
        return out


class WordEncoder:
    """Ids of whole texts by the tokenizers library, which sees every distinct white-space-free piece once while it is cached.

    The file's normaliser and splitter never look across ASCII white space, so a text's ids are those of its pieces in turn.
    With the known normaliser and splitter a piece of Latin-1 letters and ASCII marks after them is two words of the model, the
    letters in lower case and the marks; the library's model gets such words directly, each once while it is cached.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder()
        special = sorted(i for i, t in added.items() if t.special and not (t.single_word or t.lstrip or t.rstrip))
        self.mark_id = special[0] if special else None
        self.mark = self.library.id_to_token(special[0]) if special else None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        known = (spec.get("normalizer"), spec.get("pre_tokenizer")) == (NORMALISER, SPLITTER) and not any(PLAIN_PART.fullmatch(t.content) for t in added.values())
        self.model = self.library.model if known else None
        self.fresh: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each piece. Many pieces go to the library as one text with a special token between them, which cuts it as the start of a text does."""
        if self.mark is None or any(self.mark in p for p in pieces):
            return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        out = []
        for i in range(0, len(pieces), 20_000):
            part = pieces[i : i + 20_000]
            ids = np.array(self.library.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id)
            begins, ends = np.append(0, cuts + 1) * 4, np.append(cuts, len(ids)) * 4
            raw = ids.astype("<u4").tobytes()
            out += [raw[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
        return out

    def _model_word(self, word: str) -> bytes:
        """Packed ids of a normalised word that the splitter leaves whole."""
        key = word.encode()
        ids = self.fresh.get(key)
        if ids is None:
            ids = self.old.get(key)
            if ids is None:
                # the model works on the printable stand-ins of the bytes
                ids = array("I", [t.id for t in self.model.tokenize(word if word.isascii() else key.decode("latin-1").translate(STAND_INS))]).tobytes()
            if len(key) <= LONG_WORD:
                self.fresh[key] = ids
        return ids

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        found = [t.encode().split() for t in texts]
        if len(self.fresh) > MAX_WORDS:
            self.old, self.fresh = self.fresh, {}
        fresh, old, odd, long = self.fresh, self.old, [], []
        plain, model_word = PLAIN.fullmatch if self.model else lambda w: None, self._model_word
        for w in set().union(*found).difference(fresh):
            ids = old.get(w)
            if ids is None:
                if len(w) > LONG_WORD:
                    long.append(w)
                m = plain(w.decode())
                if m is None:
                    odd.append(w)
                    continue
                letters, marks = m.groups()
                ids = model_word(letters.lower()) + model_word(marks) if marks else model_word(letters.lower())
            fresh[w] = ids
        fresh.update(zip(odd, self._encode_pieces([w.decode() for w in odd])))
        out = [b"".join(map(fresh.__getitem__, parts)) for parts in found]
        for w in long:
            del fresh[w]
        return out


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def open_folder(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


def write_files(docs: DataFrame, root: str, path: str | None = None, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id`` and write files under ``root`` in ascending order of id; returns the manifest.

    The manifest (settled in the shared folder) has a row for each file: ``part, file_no, name, n_docs, n_ids``; a file
    that it doesn't name belongs to a failed attempt. Order: null ids first, then by id, rows of one id as they come. A null or
    empty text is one end id. Rows are dealt out by ranges of ids, so no key gathers in one task.
    """
    path, spark = path or default_path(), docs.sparkSession
    where, folder = open_folder(root)
    where.create_dir(folder, recursive=True)
    bound_batches(spark)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        part, n_file = TaskContext.get().partitionId(), 0
        ids, doc_ids, sizes, size = [], [], [], 0

        def flush():
            nonlocal ids, doc_ids, sizes, size, n_file
            data = write_codes(np.frombuffer(b"".join(ids), "<u4"), doc_ids, np.cumsum(sizes))
            name = f"part-{part:06d}-{n_file:05d}-{uuid.uuid4().hex}.dact"
            out, base = open_folder(root)
            with out.open_output_stream(f"{base}/{name}") as f:
                f.write(data)
            row = {"part": [part], "file_no": [n_file], "name": [name], "n_docs": [len(doc_ids)], "n_ids": [size]}
            ids, doc_ids, sizes, size, n_file = [], [], [], 0, n_file + 1
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int64()), ("file_no", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            for piece in chunks(batch, "text"):
                for d, x in zip(piece.column(0).to_pylist(), word_encoder(path).encode_packed(texts_of(piece.column(1)))):
                    n = len(x) // 4 + 1
                    if doc_ids and size + n > FILE_IDS:
                        yield flush()
                    ids += [x, end]
                    doc_ids.append(d)
                    sizes.append(n)
                    size += n
        if doc_ids:
            yield flush()

    frame = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    # rows that share an id, or have none, go as they come and can still be dealt to several tasks; the cuts need no text
    keyed = frame.withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), "tie"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return settle(ordered.mapInArrow(run, "part long, file_no long, name string, n_docs long, n_ids long"), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the ids before each file: sums by part on the driver (a row for each task), by file within a part."""
    spark: SparkSession = manifest.sparkSession
    totals = sorted((r["part"], r["n"]) for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    rows, before = [], 0
    for part, n in totals:
        rows.append((part, before))
        before += n
    parts = spark.createDataFrame(rows, "part long, base long")
    w = W.partitionBy("part").orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)
    return manifest.join(parts, "part").select("part", "file_no", "name", "n_docs", "n_ids", (F.col("base") + F.coalesce(F.sum("n_ids").over(w), F.lit(0))).alias("start"))


def read_digests(manifest: DataFrame, root: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where, folder = open_folder(root)
                with where.open_input_file(f"{folder}/{name}") as f:
                    codes = Codes(f.read_buffer())
                begins = np.concatenate([[0], codes.ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(codes.range(a, b).astype("<u4").tobytes()) for a, b in zip(begins.tolist(), codes.ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes.doc_ids, pa.int64(), mask=~codes.valid), pa.array(begins + base), pa.array(codes.ends - begins), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = with_starts(manifest).select("name", "start")
    spread = files.repartition(max(1, min(files.sparkSession.sparkContext.defaultParallelism * 4, 10_000)))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store(docs: DataFrame, path: str | None = None, root: str | None = None, end_id: int = 1) -> DataFrame:
    """Write the files, read them back and return the digests of :func:`read_digests`."""
    root = root or scratch_path(docs.sparkSession, "tokens")
    return read_digests(write_files(docs, root, path, end_id), root)
