"""Op 1: byte-level BPE by a prefix-sharing trie of distinct words.

The last token of a word's encoding depends on the word's bytes up to that
point alone: the encoding of a prefix is the encoding of a shorter prefix plus
one token that is compatible with that shorter prefix's last token. Distinct
words go into a trie in sorted order, which visits it depth first; every new
node gets its last token from the states on the path to it, so a prefix that
many words share is encoded once. A word's ids are read back along its path.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cellsight.llm.common import map_arrow, texts_of

#: Words longer than this many characters are encoded but not kept in the cache.
LONG_WORD = 64
#: Bounds of one generation of the word cache and of the pairs of tokens judged so far, for each Python worker.
MAX_WORDS = 300_000
MAX_PAIRS = 600_000
ENDLESS = 1 << 40
#: The pattern that splits text into words before the merges.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same for texts of ASCII, Latin letters and some punctuation alone, where the faster engine's classes are plain ranges.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
PLAIN_PATTERN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+")
BEYOND_PLAIN = re.compile(f"[^\t-\r -~\u00a1\u00ab\u00bb\u00bf{LATIN}\u2013\u2014\u2018-\u201d\u2026]")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Encoder and decoder of one tokenizer file (byte-level BPE); holds a bounded trie and word cache."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = model["vocab"]
        self.id_of = {to_bytes(s): i for s, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * n
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.rank, self.formed, self.left, self.right = {}, [-1] * n, [0] * n, [0] * n
        for r, pair in enumerate(model["merges"]):
            a, b = (vocab[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            ab = self.id_of[self.bytes_of[a] + self.bytes_of[b]]
            if (a << 20 | b) not in self.rank:
                self.rank[a << 20 | b] = r
                if self.formed[ab] < 0:
                    self.formed[ab], self.left[ab], self.right[ab] = r, a, b
        # a token takes part only if its own bytes encode to it
        self.pairs: dict[int, bool] = {}
        self.canonical = {b: i for b, i in self.id_of.items() if len(b) == 1 or (self.formed[i] >= 0 and self.compatible(self.left[i], self.right[i], self.formed[i]))}
        self.pairs.clear()
        self.packed = [i.to_bytes(4, "little") for i in range(n)]
        self.pattern = regex.compile(WORD_PATTERN)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.path, self._library, self._odd = path, None, None
        self.fresh: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.sizes = [len(b) for b in self.bytes_of]
        self.table = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.size_table = np.array(self.sizes, np.int64)
        self.begin_table = np.cumsum(self.size_table) - self.size_table
        self._automaton()

    def compatible(self, a: int, b: int, until: int = ENDLESS) -> bool:
        """Whether no merge across the border of tokens a and b comes before the merges that make them up.

        The merges on both sides are undone latest first. What stands at the border at some time may
        merge across it if that pair ranks before the merges which take the two symbols away; on equal
        ranks the merge further left is first.
        """
        formed, rank = self.formed, self.rank
        end_a = end_b = until
        while True:
            r = rank.get(a << 20 | b)
            if r is not None and r < end_a and (r <= end_b if end_b != until else r < until):
                return False
            fa, fb = formed[a], formed[b]
            if fa < 0 and fb < 0:
                return True
            if fa > fb:
                end_a, a = fa, self.right[a]
            else:
                end_b, b = fb, self.left[b]

    def _automaton(self) -> None:
        """Suffix automaton of the tokens: its state after some bytes gives the longest token that ends there, shorter ones follow by ``shorter``."""
        step: dict[int, int] = {}
        ends, fail, parent = [-1], [0], [(0, 0)]
        for raw in sorted(self.canonical, key=len):  # states in order of their length
            at = 0
            for byte in raw:
                key = at << 8 | byte
                nxt = step.get(key)
                if nxt is None:
                    nxt = step[key] = len(ends)
                    ends.append(-1)
                    fail.append(0)
                    parent.append((at, byte))
                at = nxt
            ends[at] = self.canonical[raw]
        depth = [0] * len(ends)
        for s in range(1, len(ends)):
            depth[s] = depth[parent[s][0]] + 1
        self.shorter = [-1] * len(self.bytes_of)
        for s in sorted(range(1, len(ends)), key=depth.__getitem__):
            at, byte = parent[s]
            if at:
                f = fail[at]
                while (n := step.get(f << 8 | byte)) is None and f:
                    f = fail[f]
                fail[s] = n or 0
            if ends[s] < 0:
                ends[s] = ends[fail[s]]
            else:
                self.shorter[ends[s]] = ends[fail[s]]
        self.step, self.ends, self.fail, self.n_steps = step, ends, fail, len(step)

    def _advance(self, state: int, byte: int) -> int:
        f = state
        while (n := self.step.get(f << 8 | byte)) is None:
            f = self.fail[f]
        if len(self.step) < 4 * self.n_steps:
            self.step[state << 8 | byte] = n
        return n

    def encode_words(self, words) -> dict[str, bytes]:
        """Ids of distinct words, packed as little-endian 32-bit integers, by one depth-first pass over their trie.

        In sorted order each word leaves the path of the one before at their common prefix: that is the trie's
        depth-first order, and the two lists below are the states on the path to the present node.
        """
        out = {}
        todo = sorted((w.encode(), w) for w in words)
        pairs, packed, sizes, shorter, ends, step = self.pairs, self.packed, self.sizes, self.shorter, self.ends, self.step
        states: list[int] = []  # the last token at each depth
        suffixes: list[int] = [0]  # the automaton's state at each depth, the root's first
        before = b""
        for raw, word in todo:
            n = len(raw)
            depth = min(n, len(before))
            differ = int.from_bytes(before[:depth]) ^ int.from_bytes(raw[:depth])
            depth -= (differ.bit_length() + 7) >> 3
            del states[depth:], suffixes[depth + 1 :]
            at = suffixes[-1]
            for byte in raw[depth:]:
                depth += 1
                nxt = step.get(at << 8 | byte)
                at = self._advance(at, byte) if nxt is None else nxt
                token = ends[at]
                while (size := sizes[token]) < depth:
                    key = states[depth - size - 1] << 20 | token
                    ok = pairs.get(key)
                    if ok is None:
                        if len(pairs) > MAX_PAIRS:
                            pairs.clear()
                        ok = pairs[key] = self.compatible(key >> 20, token)
                    if ok:
                        break
                    token = shorter[token]
                states.append(token)
                suffixes.append(at)
            before = raw
            ids = []
            while n:
                t = states[n - 1]
                ids.append(packed[t])
                n -= sizes[t]
            ids.reverse()
            out[word] = b"".join(ids)
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens. Characters that Unicode left unassigned are the library's to judge."""
        if BEYOND_PLAIN.search(text) is None:
            return PLAIN_PATTERN.findall(text)
        if self._odd is None:
            self._odd = unassigned()
        return self._library_words(text) if self._odd.search(text) else self.pattern.findall(text)

    def _library_words(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
            self._alphabet = byte_alphabet()
        return [bytes(self._alphabet[c] for c in piece).decode() for piece, _ in self._library.pre_tokenize_str(text)]

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        found = []
        for text in texts:
            if self.splitter is not None and any(s in text for s in self.special):
                parts = []
                for part in self.splitter.split(text):
                    parts += [part] if part in self.special else self.words(part)
                found.append((parts, True))
            else:
                found.append((self.words(text), False))
        need = set()
        for parts, _ in found:
            need.update(parts)
        fresh, old = self.fresh, self.old
        if len(fresh) > MAX_WORDS:
            self.old = old = fresh
            self.fresh = fresh = {}
        missing = []
        here = {}
        for w in need:
            ids = fresh.get(w)
            if ids is None:
                ids = old.get(w)
                if ids is None:
                    missing.append(w)
                    continue
                fresh[w] = ids
            here[w] = ids
        for w, ids in self.encode_words(missing).items():
            here[w] = ids
            if len(w) <= LONG_WORD:
                fresh[w] = ids
        marked = here | {s: self.packed[i] for s, i in self.special.items()}
        return [b"".join(map((marked if special else here).__getitem__, parts)) for parts, special in found]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Every token's bytes, gathered from one table."""
        size = self.size_table[ids]
        shift = self.begin_table[ids] - (np.cumsum(size) - size)
        return self.table[np.repeat(shift, size) + np.arange(size.sum())].tobytes()


@lru_cache(1)
def unassigned():
    """A pattern for the characters without a category; only these may change class between Unicode versions."""
    ranges, begin = [], None
    for c in range(0x110001):
        odd = c < 0x110000 and unicodedata.category(chr(c)) == "Cn"
        if odd and begin is None:
            begin = c
        elif not odd and begin is not None:
            ranges.append((begin, c - 1))
            begin = None
    return regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


@lru_cache(2)
def encoder(path: str) -> TrieEncoder:
    """One encoder for each worker process and file."""
    return TrieEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, n_tokens``: ids of every whole text.

    A null or empty text has no ids; a null id stays null; repeated rows give repeated rows; other columns are not read.
    The file at ``path`` must be readable on every executor (it is a parameter and is never copied).
    """
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = encoder(path).encode_packed(texts_of(batch.column(1)))
        arrays = [np.frombuffer(x, "<u4").astype(np.int32) for x in packed]
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
        flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        return pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(np.diff(offsets).astype(np.int64))], names=["doc_id", "ids", "n_tokens"])

    frame = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return map_arrow(frame, run, "doc_id long, ids array<int>, n_tokens long")


def decode(encoded: DataFrame, path: str | None = None, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``doc_id, text``: the text of every row's ids; null ids give the empty text, an id outside the vocabulary is an error."""
    path = path or default_path()

    def run(batches):
        for batch in batches:
            tok = encoder(path)
            out = [tok.decode(np.asarray(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    frame = encoded.select(encoded[id_column].cast("long").alias("doc_id"), encoded[ids_column].cast("array<int>").alias("ids"))
    return frame.mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode and decode every text and return digests: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tok = encoder(path)
        packed = tok.encode_packed(texts_of(batch.column(1)))
        sha = lambda b: hashlib.sha256(b).hexdigest()
        back = [sha(tok.decode(np.frombuffer(x, "<u4")).encode()) for x in packed]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(map(sha, packed), pa.string()), pa.array(back, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    frame = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return map_arrow(frame, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
