"""Op 13: vector code compression by product quantisation with exponion searches in exact integers.

Vectors are cut into equal parts; each part position has a codebook that a fixed number of rounds refines. A search
starts at the entry that the vector's part had in the round before, at squared distance u, and walks the list of that
entry's neighbours by distance: an entry as near as the start lies within twice the start's distance of it (triangle
inequality), so the walk ends at the first neighbour whose squared distance exceeds 4u. Distances are integers, so
equal ones are seen as equal and the lower index wins, as in a search of all entries.

A round is one scan: every batch follows its parts through the codebooks so far, each search starting where the last
one ended, and a task gives back the sums of its parts by entry. So nothing of the size of the table is written
between rounds, and a lost task is computed again from the input alone. The driver holds only codebooks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.llm.common import bound_batches, settle

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers within this bound have squared distances of eight components that 64 bits hold; others take Python's integers.
NARROW = 1 << 27
#: Rows of one numpy step.
STEP = 1 << 14


def whole(values: np.ndarray) -> np.ndarray:
    """floor(4096 * x) of every component: 64-bit integers where all are within NARROW, else Python's."""
    down = np.floor(values.astype(np.float64) * SCALE)
    if not down.size or np.abs(down).max() <= NARROW:
        return down.astype(np.int64)
    return np.array([int(np.floor(x)) * SCALE if abs(x) > 1e300 else int(d) for x, d in zip(values.astype(np.float64).ravel(), down.ravel())], dtype=object).reshape(down.shape)


def usable(column: pa.Array) -> np.ndarray:
    """Which vectors are there and have finite components only."""
    if isinstance(column, pa.ExtensionArray):
        column = column.storage
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    good = pc.fill_null(pc.is_finite(flat), False).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(good)])
    ends = np.cumsum(lengths)
    return pc.is_valid(column).to_numpy(zero_copy_only=False) & (total[ends] - total[ends - lengths] == lengths)


def matrix(column: pa.Array, keep: np.ndarray, width: int) -> np.ndarray:
    """The kept vectors as integers, filled up with zeros to ``width``."""
    column = column.filter(pa.array(keep))
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return whole(flat.reshape(len(lengths), width))
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return whole(out)


class Codebook:
    """Entries of one part position with every entry's neighbours, nearest first, and their squared distances."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k = len(entries)
        far = np.square(entries[:, None] - entries[None]).sum(2)
        self.order = np.array([sorted(range(k), key=lambda j: (far[i, j], j)) for i in range(k)], dtype=np.int64).reshape(k, k)
        self.far = np.take_along_axis(far, self.order, 1)

    def search(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of ``x`` and its squared distance; ``start``: an entry for each row."""
        u = np.square(x - self.entries[start]).sum(1)
        best, least = start.copy(), u.copy()
        todo = np.arange(len(x))
        for step in range(len(self.entries)):
            todo = todo[self.far[start[todo], step] <= 4 * u[todo]]  # lists are sorted, so who is out stays out
            if not len(todo):
                break
            entry = self.order[start[todo], step]
            d = np.square(x[todo] - self.entries[entry]).sum(1)
            nearer = (d < least[todo]) | ((d == least[todo]) & (entry < best[todo]))
            at = todo[nearer]
            best[at], least[at] = entry[nearer], d[nearer]
        return best, least


def follow(x: np.ndarray, history: list[list[Codebook]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, a column for each part, after a search in every generation of codebooks."""
    width = x.shape[1] // PARTS
    codes, far = np.zeros((len(x), PARTS), np.int64), np.zeros((len(x), PARTS), x.dtype)
    for part in range(PARTS):
        own = np.ascontiguousarray(x[:, part * width : (part + 1) * width])
        at = codes[:, part]
        for books in history:
            at, d = books[part].search(own, at)
        codes[:, part], far[:, part] = at, d
    return codes, far


def _pieces(batches, width: int, column: str):
    """Batches in steps, with the integers of what is kept."""
    for batch in batches:
        for k in range(0, batch.num_rows, STEP):
            part = batch.slice(k, STEP)
            keep = usable(part.column(column))
            if keep.any():
                yield part.filter(pa.array(keep)), matrix(part.column(column), keep, width)


def _sums(rows: DataFrame, history: list[list[Codebook]], width: int, column: str) -> list:
    """Count and component sums of every entry that parts chose: at most parts times entries rows."""
    size = width // PARTS

    def of_task(batches):
        count = np.zeros((PARTS, ENTRIES), np.int64)
        total = np.zeros((PARTS, ENTRIES, size), dtype=object)
        for _, x in _pieces(batches, width, column):
            codes, _ = follow(x, history)
            for part in range(PARTS):
                for entry in np.unique(codes[:, part]):
                    chosen = x[codes[:, part] == entry, part * size : (part + 1) * size]
                    count[part, entry] += len(chosen)
                    total[part, entry] += chosen.sum(0).astype(object)
        part, entry = np.nonzero(count)
        sums = [[str(v) for v in total[p, e]] for p, e in zip(part, entry)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.array(sums, pa.list_(pa.string()))], names=["part", "entry", "n", "sums"])

    found = rows.mapInArrow(of_task, "part long, entry long, n long, sums array<string>")
    each = found.select("part", "entry", "n", F.posexplode("sums").alias("pos", "s"))
    # entries that chose n rows, component by component: parts * entries * size rows, whatever the table holds
    return each.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()


def train(rows: DataFrame, width: int, first: list[np.ndarray], column: str, rounds: int = ROUNDS) -> list[list[Codebook]]:
    """Every generation of codebooks, the first and the last included."""
    size = width // PARTS
    entries = [np.array([v[p * size : (p + 1) * size] for v in first]).reshape(len(first), size) for p in range(PARTS)]
    history = [[Codebook(e) for e in entries]]
    for _ in range(rounds):
        new = [[list(row) for row in book.entries] for book in history[-1]]
        for r in _sums(rows, history, width, column):
            new[r["part"]][r["entry"]][r["pos"]] = int(r["s"]) // r["n"]
        bound = max((abs(v) for book in new for row in book for v in row), default=0)
        history.append([Codebook(np.array(book, dtype=np.int64 if bound <= NARROW else object).reshape(len(first), size)) for book in new])
    return history


def compress(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``key, label, code, error`` of every usable vector (a settled table), and the final codebooks (entries by components, by part).

    Vectors that are null or hold a null, NaN or infinite component give no row. The first codebooks are the parts of the 16
    usable vectors with the smallest keys; among equal keys the vector counts, and null keys come last. With fewer usable
    vectors the codebooks have fewer entries. Vectors may differ in length: all count as filled up with zeros to the longest,
    and that to a multiple of eight. Repeated rows count each and get a row each. No usable vector gives no row and empty codebooks.
    Components are exact for any finite double; sums of an entry's components must stay below 1e38.
    """
    bound_batches(vectors.sparkSession, 10000)
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(column).cast("array<double>").alias("v"))
    inf = float("inf")
    ok = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    longest = rows.where(ok).agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // PARTS)) * PARTS
    least = rows.where(ok).orderBy(F.col("key").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()  # sixteen rows
    first = [whole(np.array([*r["v"], *[0.0] * (width - len(r["v"]))])) for r in least]
    out = f"key {rows.schema['key'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error decimal(38,0)"
    if not first:
        return settle(vectors.sparkSession.createDataFrame([], out), "codes"), [np.zeros((0, width // PARTS), np.int64)] * PARTS
    history = train(rows, width, first, "v", rounds)

    def assign(batches):
        for part, x in _pieces(batches, width, "v"):
            codes, far = follow(x, history)
            names = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            errors = [str(e) for e in far.sum(1)]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), pa.array(names), pa.array(errors).cast(pa.decimal128(38, 0))], names=["key", "label", "code", "error"])

    return settle(rows.mapInArrow(assign, out), "codes"), [book.entries for book in history[-1]]


def codes_and_errors(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable vector of ``vec_id, embedding, label``, see :func:`compress`.

    Labels are summed with a combine before the shuffle; the join back is one that can be split where a label is hot. Sums that
    64 bits don't hold are an error.
    """
    coded, books = compress(vectors)
    digest = hashlib.sha256(",".join(str(v) for book in books for row in book for v in row).encode()).hexdigest()
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").cast("long").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("key").alias("vec_id"), "code", F.col("error").cast("long").alias("error"), "label_error", F.lit(digest).alias("codebooks_sha256"))


def decode(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``coded`` with ``vector``: the components (integers) that each code stands for."""
    tables = [[[int(v) for v in row] for row in book] for book in books]

    def look_up(batches):
        for batch in batches:
            out = [[v for p in range(PARTS) for v in tables[p][int(c[2 * p : 2 * p + 2], 16)]] for c in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names, "vector"])

    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    return coded.mapInArrow(look_up, StructType([*coded.schema.fields, StructField("vector", ArrayType(LongType()))]))
