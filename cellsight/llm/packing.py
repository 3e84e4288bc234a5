"""Op 7: hierarchical packing into windows of several lengths.

A document's full windows of the longest context stand alone; what is left goes
to the tier of the shortest context that holds it. Tiers are packed from long to
short: a window takes one piece of its own tier, then the longest pieces of
shorter tiers that fit its gap, then a part cut from the next piece, whose rest
is routed again. When no pieces are left, the last window is dealt out into
windows whose lengths are powers of two. So no window needs padding. Windows of
all tiers are then assigned to step groups of about equal numbers of tokens.

Packing is local to a task: it moves no rows, and a retry gives the same windows.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cellsight.llm.bpe import default_path, encoder
from cellsight.llm.common import bound_batches, chunks, texts_of

CONTEXT = 1024
TIERS = (128, 256, 512, 1024)
#: Tokens of one packing round and of one step group.
ROUND_TOKENS = 1 << 20
STEP_TOKENS = 1 << 15
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


class Round:
    """Packs the documents of one round; pieces are ``(length, document, start)``."""

    def __init__(self, tiers=TIERS):
        self.tiers = sorted(tiers)
        self.queues: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}
        self.windows: list[list[tuple[int, int, int]]] = []

    def route(self, length: int, doc: int, start: int) -> None:
        """Full windows of the longest context at once; the rest to the shortest tier that holds it."""
        top = self.tiers[-1]
        while length >= top:
            self.windows.append([(top, doc, start)])
            start, length = start + top, length - top
        if length:
            tier = next(t for t in self.tiers if t >= length)
            insort(self.queues[tier], (length, doc, start))

    def _fitting(self, gap: int, below: int):
        """The longest waiting piece of at most ``gap`` tokens in tiers up to ``below``."""
        for t in reversed(self.tiers):
            if t <= below and (q := self.queues[t]):
                i = bisect_right(q, (gap, 1 << 62, 0))
                if i:
                    return q.pop(i - 1)
        return None

    def pack(self) -> list[list[tuple[int, int, int]]]:
        for tier in reversed(self.tiers):
            while self.queues[tier]:
                piece = self.queues[tier].pop()
                window, gap = [piece], tier - piece[0]
                while gap:
                    got = self._fitting(gap, tier)
                    if got is None:
                        longer = next((q for t in self.tiers if t <= tier and (q := self.queues[t])), None)
                        if longer is None:
                            break
                        n, doc, start = longer.pop(0)
                        got = (gap, doc, start)
                        self.route(n - gap, doc, start + gap)
                    window.append(got)
                    gap -= got[0]
                self.windows += [window] if not gap else self._binary(window)
        return self.windows

    @staticmethod
    def _binary(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
        """The same tokens in windows whose lengths are powers of two, longest first."""
        total, out, parts = sum(p[0] for p in window), [], list(window)[::-1]
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            new = []
            while size:
                n, doc, start = parts.pop()
                take = min(n, size)
                new.append((take, doc, start))
                if n > take:
                    parts.append((n - take, doc, start + take))
                size -= take
            out.append(new)
        return out


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each window: the longest first, each to the group with the fewest tokens."""
    n = max(1, -(-sum(sizes) // step_tokens))
    heap = [(0, g) for g in range(n)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (load + sizes[i], g))
    return out


def pack(docs: DataFrame, path: str | None = None, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: where it starts and how long it is, its sequence and its offset there.

    A null or empty text is one ``end_id``; a null id stays null; repeated rows are packed each for itself; other
    columns are not read. Every id lies in exactly one piece. ``with_ids`` adds the piece's ``ids``.
    """
    path = path or default_path()
    bound_batches(docs.sparkSession)
    end = end_id.to_bytes(4, "little")
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids

    def run(batches):
        base, done, groups = TaskContext.get().partitionId() << 36, 0, 0
        held, tokens = [], 0

        def flush():
            nonlocal held, tokens, done, groups
            round_ = Round()
            for i, (_, x) in enumerate(held):
                round_.route(len(x) // 4, i, 0)
            windows = round_.pack()
            sizes = [sum(p[0] for p in w) for w in windows]
            group = step_groups(sizes)
            rows = []
            for k, (w, size) in enumerate(zip(windows, sizes)):
                offset = 0
                for n, i, start in w:
                    d, x = held[i]
                    ids = x[4 * start : 4 * (start + n)]
                    rows.append((d, start, n, zlib.crc32(ids), len(x) // 4, base + done + k, offset, size, base + groups + group[k], *([np.frombuffer(ids, "<u4").tolist()] if with_ids else ())))
                    offset += n
            done, groups = done + len(windows), groups + 1 + max(group, default=0)
            held, tokens = [], 0
            for i in range(0, len(rows), 20_000):
                columns = zip(*rows[i : i + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n, c in zip(names, columns)], names=names)

        for batch in batches:
            for piece in chunks(batch, "text"):
                for d, x in zip(piece.column(0).to_pylist(), encoder(path).encode_packed(texts_of(piece.column(1)))):
                    held.append((d, x + end))
                    tokens += len(x) // 4 + 1
                    if tokens >= ROUND_TOKENS:
                        yield from flush()
        if held:
            yield from flush()

    frame = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return frame.mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)
