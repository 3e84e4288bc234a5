"""Exact neighbour and range search that compares only what the triangle inequality leaves.

The base is dealt into cells around pivots, each vector into that of its nearest pivot. Of a cell the least and the
largest distance of its members to the pivot are known, so the distance of a query to the pivot bounds that to every
member from below: a query visits only cells whose bound is within its reach. Cells are written as parts of at most some
``block`` members to the shared folder. Queries are dealt by cell too; a task holds those of one partition, what they have
found so far and one part at a time, which it reads itself, so no vector is copied for a visit.

Tiles of queries and members are first compared by lower bounds (one matrix product for Euclidean distances, in single
precision for wide vectors) with the rounding error taken off; only pairs whose bound is within reach get their distance.
The driver holds pivots and a few numbers for each cell, at most MAX_CELLS.
"""

from __future__ import annotations

import copy
import re
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.operators.storage import shared_root, stored

MAX_CELLS, BLOCK = 1024, 4096
#: Bounds are loosened by this share, so that rounding loses nothing.
SLACK = 1e-9
#: Queries in a task, and those of one cell that are searched together; pairs in a tile.
VISITORS, GROUP, TILE = 2048, 1024, 1 << 20
#: Vectors of at least so many dimensions are bounded in single precision.
WIDE = 24


def distances(x: np.ndarray, y: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """All distances between the rows of two matrices, by differences."""
    d = x[:, None, :] - y[None, :, :]
    if metric == "chebyshev":
        return np.abs(d).max(2)
    return np.abs(d).sum(2) if metric == "manhattan" else np.sqrt(np.square(d).sum(2))


def paired(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows ``i`` of x to the rows ``j`` of y, by differences."""
    out = np.zeros(len(i))
    step = max(1, (1 << 21) // max(1, x.shape[1]))
    for s in range(0, len(i), step):
        d = x[i[s : s + step]] - y[j[s : s + step]]
        out[s : s + step] = np.abs(d).max(1) if metric == "chebyshev" else np.abs(d).sum(1) if metric == "manhattan" else np.sqrt(np.square(d).sum(1))
    return out


def _steps(x: np.ndarray, y: np.ndarray) -> Iterator[slice]:
    """Slices of ``x`` whose differences to ``y`` take some 32 MB."""
    step = max(1, (1 << 22) // max(1, y.size))
    return (slice(i, i + step) for i in range(0, len(x), step))


def _spread(sample: np.ndarray, k: int, metric: str) -> np.ndarray:
    """``k`` rows of a bounded sample, each the farthest from those before."""
    chosen, far = [0], distances(sample, sample[:1], metric)[:, 0]
    while len(chosen) < k and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(sample, sample[chosen[-1:]], metric)[:, 0])
    return sample[chosen]


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n if n else 0)


class Shape:
    """What the driver and the tasks know of the cells."""

    def __init__(self, pivots: np.ndarray, metric: str):
        self.pivots, self.metric = pivots, metric
        self.count, self.lo, self.hi = np.zeros(len(pivots), np.int64), np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        return np.vstack([distances(x[s], self.pivots, self.metric) for s in _steps(x, self.pivots)])

    def at_home(self, batches):
        for batch in batches:
            if batch.num_rows:
                d = self.to_pivots(matrix(batch.column(1)))
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=[*batch.schema.names, "cell", "r"])

    def homes(self, d: np.ndarray) -> np.ndarray:
        """Of each row of distances to the pivots, the cell with members whose pivot is nearest."""
        return np.where(self.count[None] > 0, d, np.inf).argmin(1)

    def home(self, x: np.ndarray) -> np.ndarray:
        """Queries by cells: whether it is the home of the query."""
        return np.arange(len(self.pivots))[None] == self.homes(self.to_pivots(x))[:, None]

    def visitors(self, batches):
        for batch in batches:
            if batch.num_rows:
                cell = self.homes(self.to_pivots(matrix(batch.column(1))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "home"])

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances of queries to all pivots, and the least and largest distances that their members can have."""
        d = self.to_pivots(x)
        low = np.maximum(np.maximum(d - self.hi[None], self.lo[None] - d), 0.0)
        # a member is no nearer to another pivot than to its own
        low = np.maximum(low, (d - d.min(1, keepdims=True)) / 2)
        return d, low * (1 - SLACK), (d + self.hi[None]) * (1 + SLACK)


class Part:
    """Some members of the cells: ids, vectors, cells and further columns."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, cell: np.ndarray, more: dict[str, np.ndarray]):
        self.ids, self.x, self.cell, self.more = ids, x, cell, more

    def of(self, cells: np.ndarray) -> Part:
        """The members of the cells that a mask has; all if it has all."""
        at = cells[self.cell]
        if at.all():
            return self
        return Part(self.ids[at], self.x[at], self.cell[at], {k: v[at] for k, v in self.more.items()})


def above(bound: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Bounds in the precision of a tile, loosened and rounded up."""
    loose = bound + np.abs(bound) * SLACK + (1e-36 if tile.dtype == np.float32 else 0.0)
    return np.nextafter(loose.astype(tile.dtype), tile.dtype.type(np.inf))


class Search:
    """What some queries of one home cell know while parts of the members pass. Classes below say what they look for."""

    def __init__(self, shape: Shape, home: int, ids: np.ndarray, x: np.ndarray, columns: dict[str, np.ndarray]):
        self.shape, self.ids, self.x, self.columns, self.metric = shape, ids, x, columns, shape.metric
        _, self.low, self.high = shape.bounds(x)
        self.centre = shape.pivots[home]
        self.near = x - self.centre
        self.norms = self._norms(self.near)

    def _norms(self, x: np.ndarray) -> np.ndarray:
        if self.metric == "euclidean":
            return np.square(x).sum(1)
        return np.abs(x).sum(1) if self.metric == "manhattan" else np.abs(x).max(1, initial=0.0)

    def key(self, d):
        """Bounds are of squared distances for the Euclidean metric, else of distances."""
        return np.square(d) if self.metric == "euclidean" else d

    def tiles(self, rows: np.ndarray, part: Part) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Queries ``rows``, some at a time, with lower bounds of keys to all members and by how much these may be too low."""
        x, y, mine = self.near[rows], part.x - self.centre, self.norms[rows]
        norms = self._norms(y)
        wide = y.shape[1] >= WIDE and max(norms.max(initial=0.0), mine.max(initial=0.0)) < 1e30
        kind = np.float32 if wide else np.float64
        # twice the share of the norms that rounding may take in the sums below
        share = (4 * y.shape[1] + 64) * float(np.finfo(kind).eps) / 2
        error = 2 * share * (mine + norms.max(initial=0.0)) * 1.01
        step = max(1, TILE // max(1, len(y)))
        if self.metric == "euclidean":
            left = np.hstack([x, (mine * (1 - share))[:, None], np.ones((len(x), 1))]).astype(kind)
            right = np.hstack([-2 * y, np.ones((len(y), 1)), (norms * (1 - share))[:, None]]).astype(kind).T
            for s in range(0, len(rows), step):
                yield rows[s : s + step], left[s : s + step] @ right, error[s : s + step]
            return
        left, right, step = x.astype(kind), np.ascontiguousarray(y.T.astype(kind)), min(step, 64)
        off, other, add = (share * mine).astype(kind), (share * norms).astype(kind), np.add if self.metric == "manhattan" else np.maximum
        buffer = np.empty((step, len(y)), kind)
        for s in range(0, len(rows), step):
            a = left[s : s + step]
            out, some = np.zeros((len(a), len(y)), kind), buffer[: len(a)]
            for j in range(a.shape[1]):
                np.subtract(a[:, j, None], right[j][None], out=some)
                add(out, np.abs(some, out=some), out=out)
            out -= off[s : s + step, None]
            out -= other[None]
            yield rows[s : s + step], out, error[s : s + step]

    def within(self, rows: np.ndarray, part: Part, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Queries, some at a time, with a mask of the members at most eps away; only pairs that rounding leaves open are worked out."""
        most = self.key(eps)
        for at, tile, error in self.tiles(rows, part):
            sure = tile <= -above(error - most * (1 - SLACK), tile)[:, None]
            i, j = np.nonzero((tile <= above(np.full(1, most), tile)) & ~sure)
            sure[i, j] = paired(self.x, part.x, at[i], j, self.metric) <= eps
            yield at, sure

    def visits(self, cells: np.ndarray) -> np.ndarray:
        """Queries by ``cells``: whose members may matter still."""
        raise NotImplementedError

    def see(self, rows: np.ndarray, part: Part) -> None:
        raise NotImplementedError

    def found(self) -> list[np.ndarray]:
        raise NotImplementedError


class Cells:
    """The vectors ``id, v`` and further number columns ``extra``, dealt into cells. ``compared`` adds up the pairs that searches look at."""

    def __init__(self, base: DataFrame, metric: str = "euclidean", block: int = BLOCK, cells: int | None = None, extra: tuple[str, ...] = ()):
        self.metric, self.block, self.extra = metric, block, extra
        data = base.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), *extra)
        self.spark = data.sparkSession
        self.pairs = self.spark.sparkContext.accumulator(0)
        self.n = data.count()
        k = cells or int(np.clip(round(self.n**0.5 / 2), 1, MAX_CELLS))
        sample = [r["v"] for r in data.orderBy(F.xxhash64("id"), "id").select("v").limit(4 * k).collect()]  # bounded by MAX_CELLS
        self.shape = shape = Shape(_spread(np.array(sample), k, metric) if sample else np.zeros((0, 0)), metric)
        types = "".join(f", {c} {data.schema[c].dataType.simpleString()}" for c in extra)
        placed = stored(data.mapInArrow(Shape(shape.pivots, metric).at_home, f"id long, v array<double>{types}, cell int, r double"))
        for s in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect():  # a row for each cell
            shape.count[s["cell"]], shape.lo[s["cell"]], shape.hi[s["cell"]] = s["n"], s["lo"], s["hi"]
        self.first, self.chunks, part, room = [], [], -1, 0  # small cells share a part, large ones are cut
        for n in map(int, shape.count):
            self.chunks.append(max(1, -(-n // block)))
            if part < 0 or n > room:
                part, room = part + 1, block
            self.first.append(part)
            part, room = part + self.chunks[-1] - 1, max(0, room - n)
        self.parts = part + 1
        table = self.spark.createDataFrame([(c, self.first[c], self.chunks[c]) for c in map(int, np.flatnonzero(shape.count))], "cell int, first int, chunks int")
        self._write(placed.join(F.broadcast(table), "cell").withColumn("part", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("chunks"))).cast("int")).select("id", "v", *extra, "cell", "r", "part"))

    def _write(self, placed: DataFrame) -> None:
        path = f"{shared_root(placed)}/cells-{uuid.uuid4().hex}"
        placed.repartition(max(1, self.parts), "part").sortWithinPartitions("part", "cell", "r").write.partitionBy("part").parquet(path)
        self.members = self.spark.read.schema(placed.schema).parquet(path)
        self.files: dict[int, list[str]] = {}
        for f in self.members.inputFiles() if self.n else []:  # a file for each part
            self.files.setdefault(int(re.search(r"/part=(\d+)/", f)[1]), []).append(f)

    def joined(self, more: DataFrame, *columns: str) -> Cells:
        """The same cells with further number columns of ``more`` (a row for each id)."""
        out = copy.copy(self)
        out.extra = (*self.extra, *columns)
        out._write(self.members.join(more.select("id", *columns), "id").select("id", "v", *out.extra, "cell", "r", "part"))
        return out

    @property
    def compared(self) -> int:
        return self.pairs.value

    @compared.setter
    def compared(self, value: int) -> None:
        self.pairs.value = value

    def meet(self, queries: DataFrame, search: Callable[..., Search], schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
        """What ``search(shape, home, ids, vectors, columns)`` finds for the queries ``id, v`` and the number columns ``carry``."""
        if not self.n:
            return self.spark.createDataFrame([], schema)
        shape, files, extra, pairs, first, chunks = self.shape, self.files, self.extra, self.pairs, self.first, self.chunks
        cells_of: dict[int, list[int]] = {p: [] for p in files}
        for c in map(int, np.flatnonzero(shape.count)):
            for p in range(first[c], first[c] + chunks[c]):
                cells_of.setdefault(p, []).append(c)
        names = [x.split()[0] for x in schema.split(", ")]
        asked = queries.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), *carry)
        types = "".join(f", {c} {asked.schema[c].dataType.simpleString()}" for c in carry)
        asked = stored(asked.mapInArrow(shape.visitors, f"id long, v array<double>{types}, home int"))
        n = asked.count()
        each = int(np.clip(n // (4 * self.spark.sparkContext.defaultParallelism), min(256, VISITORS), VISITORS))

        def load(part: int) -> Part:
            found = []
            for f in files[part]:
                store, path = fs.FileSystem.from_uri(f)
                with store.open_input_file(path) as opened:
                    found.append(pq.read_table(opened, columns=["id", "v", "cell", *extra], use_threads=False))
            table = pa.concat_tables(found)
            one = lambda c: table.column(c).combine_chunks()
            return Part(one("id").to_numpy(), matrix(one("v")), one("cell").to_numpy(), {c: one(c).to_numpy(zero_copy_only=False) for c in extra})

        def look(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(batches).sort_by("home")
            one = lambda c: table.column(c).combine_chunks()
            home, ids, x = one("home").to_numpy(), one("id").to_numpy(), matrix(one("v"))
            columns = {c: one(c).to_numpy(zero_copy_only=False) for c in carry}
            starts = np.flatnonzero(np.diff(home, prepend=-1))
            groups = []
            for s, e in zip(starts, [*starts[1:], len(home)]):
                for i in range(s, e, GROUP):
                    at = slice(i, min(i + GROUP, e))
                    groups.append((int(home[s]), search(shape, int(home[s]), ids[at], x[at], {c: v[at] for c, v in columns.items()})))
            total = 0

            def show(state: Search, part: Part, cells: list[int]) -> int:
                asks = state.visits(np.array(cells, int))
                if not asks.any():
                    return 0
                wanted = np.zeros(len(shape.pivots), bool)
                wanted[np.array(cells, int)[asks.any(0)]] = True
                rows, some = np.flatnonzero(asks.any(1)), part.of(wanted)
                if len(some.ids):
                    state.see(rows, some)
                return len(rows) * len(some.ids)

            # the home cell first: what it holds shortens the reach
            last, at_hand = -1, None
            for cell, state in groups:
                for part in range(first[cell], first[cell] + chunks[cell]):
                    if part in files:
                        if part != last:
                            last, at_hand = part, load(part)
                        total += show(state, at_hand, [cell])
            for part in sorted(files):
                todo = [(state, cells) for cell, state in groups if (cells := [c for c in cells_of[part] if c != cell])]
                if not any(state.visits(np.array(cells, int)).any() for state, cells in todo):
                    continue
                if part != last:
                    last, at_hand = part, load(part)
                for state, cells in todo:
                    total += show(state, at_hand, cells)
            pairs.add(total)
            for _, state in groups:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in state.found()], names=names)

        def run(batches):
            waiting, rows = [], 0
            for batch in batches:
                if batch.num_rows:
                    waiting.append(batch)
                    rows += batch.num_rows
                if rows >= 2 * VISITORS:
                    yield from look(waiting)
                    waiting, rows = [], 0
            if rows:
                yield from look(waiting)

        return asked.repartitionByRange(max(1, -(-n // each)), "home", F.xxhash64("id")).mapInArrow(run, schema)


class Near(Search):
    """The k nearest members of every query, ties by id."""

    def __init__(self, *args, k: int):
        super().__init__(*args)
        self.k = k
        self.d, self.b = np.full((len(self.ids), k), np.inf), np.full((len(self.ids), k), np.iinfo(np.int64).max)
        # the bound of the nearest cells that hold k together
        order = np.argsort(self.high, axis=1)
        enough = (np.cumsum(self.shape.count[order], axis=1) >= min(k, self.shape.count.sum())).argmax(1)
        self.reach = np.take_along_axis(self.high, order, 1)[np.arange(len(order)), enough]
        del self.high

    def visits(self, cells):
        return self.low[:, cells] <= (self.reach * (1 + SLACK) + SLACK)[:, None]

    def see(self, rows, part):
        k = self.k
        for at, tile, error in self.tiles(rows, part):
            new = np.flatnonzero(np.isinf(self.d[at, -1]))
            if len(new) and tile.shape[1] > k:  # no k yet: the k-th least bound here is one
                least = np.partition(tile[new], k - 1, axis=1)[:, k - 1].astype(float) + error[new]
                self.reach[at[new]] = np.minimum(self.reach[at[new]], (np.sqrt(np.maximum(least, 0)) if self.metric == "euclidean" else np.maximum(least, 0)) * (1 + SLACK) + 1e-18)
            mask = tile <= above(self.key(self.reach[at]), tile)[:, None]
            full = np.flatnonzero(self.d[at, -1] == 0)  # among equal vectors only lesser ids count
            mask[full] &= part.ids[None] < self.b[at[full], -1][:, None]
            i, j = np.nonzero(mask)
            d = paired(self.x, part.x, at[i], j, self.metric)
            kept = d <= self.d[at[i], -1]
            q, j, d = at[i[kept]], j[kept], d[kept]
            if not len(q):
                continue
            some = np.unique(q)
            q, d, b = np.concatenate([np.repeat(some, k), q]), np.concatenate([self.d[some].ravel(), d]), np.concatenate([self.b[some].ravel(), part.ids[j]])
            order = np.lexsort((b, d, q))
            best = order[np.searchsorted(q[order], some)[:, None] + np.arange(k)[None]]
            self.d[some], self.b[some] = d[best], b[best]
            self.reach[some] = np.minimum(self.reach[some], self.d[some, -1])

    def found(self):
        q, rank = np.nonzero(np.isfinite(self.d))
        return [self.ids[q], self.b[q, rank], self.d[q, rank], (rank + 1).astype(np.int32)]


def neighbours(queries: DataFrame, base: DataFrame | Cells, k: int, metric: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """``q, b, d, rank``: the k nearest base vectors (``id, v array<double>``) of every query, exact; ties by id. A query finds itself."""
    cells = base if isinstance(base, Cells) else Cells(base, metric, block)
    return stored(cells.meet(queries, partial(Near, k=int(k)), "q long, b long, d double, rank int"))  # readers join it with itself


class Within(Search):
    """What looks at the members at most eps away."""

    def __init__(self, *args, eps: float):
        super().__init__(*args)
        self.eps = eps
        del self.high

    def visits(self, cells):
        return self.low[:, cells] <= self.eps


class Count(Within):
    def __init__(self, *args, **more):
        super().__init__(*args, **more)
        self.n = np.zeros(len(self.ids), np.int64)

    def see(self, rows, part):
        for at, mask in self.within(rows, part, self.eps):
            self.n[at] += mask.sum(1)

    def found(self):
        return [self.ids, self.n]


def count_within(vectors: DataFrame, cells: Cells, eps: float) -> DataFrame:
    """``id, n``: how many base vectors are at most eps away; only counts leave a task."""
    return cells.meet(vectors, partial(Count, eps=eps), "id long, n long")


def _least_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of the component of each of n nodes, for a few links."""
    label = np.arange(n)
    while True:
        least, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Links(Within):
    """Links to members with larger ids. Of a dense tile only those stay that join parts which those before have not joined."""

    def __init__(self, *args, **more):
        super().__init__(*args, **more)
        self.a, self.b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def see(self, rows, part):
        for at, mask in self.within(rows, part, self.eps):
            mask &= self.ids[at][:, None] < part.ids[None]
            n, m = mask.shape
            if np.count_nonzero(mask) <= n + m:
                self._add(at, part, *np.nonzero(mask))
                continue
            links = np.zeros((2, 0), np.int64)
            while mask.any():  # the first link of every row and column
                i, j = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
                new = np.unique(np.hstack([[i, mask[i].argmax(1)], [mask[:, j].argmax(0), j]]), axis=1)
                self._add(at, part, *new)
                links = np.hstack([links, new])
                label = _least_of(n + m, links[0], links[1] + n)
                mask &= label[:n, None] != label[None, n:]

    def _add(self, at, part, i, j):
        self.a.append(self.ids[at[i]])
        self.b.append(part.ids[j])

    def found(self):
        return [np.concatenate(self.a), np.concatenate(self.b)]


def links_within(cells: Cells, eps: float) -> DataFrame:
    """``a, b``: links at most eps long that join all vectors of ``cells`` which chains of such links join.

    A tile of visitors and members gives a few links for each of them at most, however dense it is.
    """
    return cells.meet(cells.members, partial(Links, eps=eps), "a long, b long")


class Least(Within):
    def __init__(self, *args, value: str, **more):
        super().__init__(*args, **more)
        self.value, self.least = value, np.full(len(self.ids), np.iinfo(np.int64).max)

    def see(self, rows, part):
        values, most = part.more[self.value], np.iinfo(np.int64).max
        for at, mask in self.within(rows, part, self.eps):
            self.least[at] = np.minimum(self.least[at], np.where(mask, values[None], most).min(1))

    def found(self):
        some = self.least < np.iinfo(np.int64).max
        return [self.ids[some], self.least[some]]


def least_within(vectors: DataFrame, cells: Cells, eps: float, value: str) -> DataFrame:
    """``id, least``: the least ``value`` (a column of the cells, long) among base vectors at most eps away; ids without one are left out."""
    return cells.meet(vectors, partial(Least, eps=eps, value=value), "id long, least long")
