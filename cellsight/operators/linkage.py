"""Ward's hierarchical clusters by rounds of reciprocal nearest neighbours.

A pair of clusters that are each other's nearest merges in any order of merging, as a merge brings no cluster nearer
to a third (the linkage is reducible); so all such pairs merge at once, their centres and sizes give the distances of the
new ones (Lance and Williams), and heights tell afterwards which merges are the last. Nearest clusters are searched
around pivots with bounds for both the distance of centres and the factor of sizes. What is left when few clusters
remain is merged in one task; the merges are the same however many rounds went before.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.operators.cells import with_row_index
from cellsight.operators.nearest import SLACK, Cells, Search, above, paired
from cellsight.operators.storage import stored

#: Clusters that one task merges to the end (their squared distances take 32 MB).
SMALL = 2048
MERGE = "lo long, hi long, height double, seq long"


def _factor(a, b):
    return 2.0 * a * b / (a + b)


def merge_all(ids: np.ndarray, x: np.ndarray, size: np.ndarray, height: np.ndarray, linkage: str = "ward") -> list[tuple[int, int, float, int]]:
    """Every merge ``(lo, hi, height, order)`` of a few clusters, the closest first; a cluster goes by its least id."""
    order = np.argsort(ids)
    ids, x, size, height = ids[order], x[order], size[order].astype(float), height[order].astype(float)
    d = np.vstack([np.square(x[i : i + 64, None] - x[None]).sum(2) for i in range(0, len(x), 64)]) if len(x) else np.zeros((0, 0))
    d = np.sqrt(d) if linkage == "average" else d * _factor(size[:, None], size[None])
    np.fill_diagonal(d, np.inf)
    near = d.argmin(1) if len(x) else np.zeros(0, int)
    best = d[np.arange(len(x)), near]
    out = []
    for step in range(len(x) - 1):
        i = int(best.argmin())
        i, j = sorted((i, int(near[i])))
        at = max(d[i, j], height[i], height[j])
        out.append((int(ids[i]), int(ids[j]), float(at), step))
        a, b = size[i], size[j]
        merged = ((a + size) * d[i] + (b + size) * d[j] - size * d[i, j]) / (a + b + size) if linkage == "ward" else (a * d[i] + b * d[j]) / (a + b)
        gone = ~np.isfinite(d[i]) | ~np.isfinite(d[j])
        merged[gone] = np.inf
        d[i] = d[:, i] = merged
        d[j] = d[:, j] = np.inf
        size[i] += b
        height[i], best[j] = at, np.inf
        alive = np.isfinite(best)
        stale = np.flatnonzero(alive & ((near == i) | (near == j)) | (np.arange(len(x)) == i))
        near[stale] = d[stale].argmin(1)
        best[stale] = d[stale, near[stale]]
        closer = alive & (d[:, i] < best)
        near[closer], best[closer] = i, d[closer, i]
    return out


class Closest(Search):
    """The shortest Ward edge of every cluster; of equal ones that of the least ids. ``small`` and ``large``: sizes in a cell."""

    def __init__(self, *args, small: np.ndarray, large: np.ndarray):
        super().__init__(*args)
        self.small, self.size = small, self.columns["size"].astype(float)
        n = len(self.ids)
        # the farthest that a cell with another member can be
        others = self.shape.count[None] - self.shape.home(self.x) > 0
        self.reach = np.where(others, np.square(np.where(others, self.high, 0.0)) * _factor(self.size[:, None], np.maximum(large, 1)[None]), np.inf).min(1)
        self.w, self.lo, self.hi = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        del self.high

    def visits(self, cells):
        return np.square(self.low[:, cells]) * _factor(self.size[:, None], self.small[cells][None]) <= (self.reach * (1 + SLACK))[:, None]

    def see(self, rows, part):
        sizes = part.more["size"].astype(float)
        for at, tile, _ in self.tiles(rows, part):
            tile *= _factor(self.size[at][:, None].astype(tile.dtype), sizes[None].astype(tile.dtype))
            new = np.flatnonzero(np.isinf(self.w[at]))
            if len(new) and len(sizes) > 1:  # one edge shortens the reach
                other = np.where(self.ids[at[new]][:, None] == part.ids[None], np.inf, tile[new]).argmin(1)
                w = np.square(paired(self.x, part.x, at[new], other, "euclidean")) * _factor(self.size[at[new]], sizes[other])
                self.reach[at[new]] = np.minimum(self.reach[at[new]], w)
            # factors in single precision are off by some 1e-7
            i, j = np.nonzero(tile <= above(self.reach[at] * (1 + 1e-6), tile)[:, None])
            i, j = i[self.ids[at[i]] != part.ids[j]], j[self.ids[at[i]] != part.ids[j]]
            q = at[i]
            w = np.square(paired(self.x, part.x, q, j, "euclidean")) * _factor(self.size[q], sizes[j])
            kept = w <= self.reach[q]
            q, j, w = q[kept], j[kept], w[kept]
            if not len(q):
                continue
            lo, hi = np.minimum(self.ids[q], part.ids[j]), np.maximum(self.ids[q], part.ids[j])
            some = np.unique(q)
            q, w, lo, hi = (np.concatenate([a, b]) for a, b in ((some, q), (self.w[some], w), (self.lo[some], lo), (self.hi[some], hi)))
            order = np.lexsort((hi, lo, w, q))
            best = order[np.diff(q[order], prepend=-1) > 0]
            self.w[some], self.lo[some], self.hi[some] = w[best], lo[best], hi[best]
            self.reach[some] = np.minimum(self.reach[some], self.w[some])

    def found(self):
        some = np.isfinite(self.w)
        return [self.ids[some], self.w[some], self.lo[some], self.hi[some]]


def _nearest(clusters: DataFrame, block: int) -> DataFrame:
    """``id, w, lo, hi``: the shortest Ward edge of every cluster ``id, v, size``; of equal ones that of the least ids."""
    cells = Cells(clusters, "euclidean", block, extra=("size",))
    k = len(cells.shape.pivots)
    small, large = np.ones(k), np.zeros(k)
    for r in cells.members.groupBy("cell").agg(F.min("size").alias("a"), F.max("size").alias("b")).collect():  # a row for each cell
        small[r["cell"]], large[r["cell"]] = r["a"], r["b"]
    return cells.meet(cells.members, partial(Closest, small=small, large=large), "id long, w double, lo long, hi long", ("size",))


def merges(vectors: DataFrame, small: int = SMALL, linkage: str = "ward", block: int = 4096) -> DataFrame:
    """``lo, hi, height, seq`` of the n - 1 merges of the vectors ``id, v``; of equal heights the one with the larger ``seq`` is later.

    Average linkage has no centres to go by: it is done for at most ``small`` vectors.
    """
    now = stored(vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("height")))
    out: list[DataFrame] = []
    seq = 0
    while (n := now.count()) > small:
        if linkage != "ward":
            raise ValueError(f"average linkage takes at most {small} vectors")
        edges = stored(_nearest(now, block))
        back = edges.select(F.when(F.col("id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("id"), F.col("lo").alias("l"), F.col("hi").alias("h"))
        pairs = stored(edges.join(back, "id").where("id = lo AND lo = l AND hi = h").select("lo", "hi", "w"))
        role = pairs.select(F.explode(F.array(F.struct("lo", F.col("lo").alias("id"), "w"), F.struct("lo", F.col("hi").alias("id"), "w"))).alias("r")).select("r.*")
        grouped = now.join(role, "id", "left").select(F.coalesce("lo", "id").alias("id"), "v", "size", "height", "w")
        weighted = F.transform("v", lambda x: x * F.col("size"))
        add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
        both = grouped.groupBy("id").agg(F.collect_list(F.struct(weighted.alias("v"), "size")).alias("of"), F.max(F.greatest("height", F.coalesce("w", "height"))).alias("height"))  # two at most
        total = F.aggregate("of", F.lit(0).cast("long"), lambda s, o: s + o["size"])
        centre = F.when(F.size("of") == 1, F.col("of")[0]["v"]).otherwise(add(F.col("of")[0]["v"], F.col("of")[1]["v"]))
        after = stored(both.select("id", F.transform(centre, lambda x: x / total).alias("v"), total.alias("size"), "height"))
        out.append(pairs.join(after.select(F.col("id").alias("lo"), "height"), "lo").select("lo", "hi", "height", F.lit(seq).cast("long").alias("seq")))
        now, seq = after, seq + 1

    def finish(p: pd.DataFrame) -> pd.DataFrame:
        rows = merge_all(p["id"].to_numpy(), np.vstack(p["v"].to_numpy()), p["size"].to_numpy(), p["height"].to_numpy(), linkage)
        return pd.DataFrame([(a, b, h, seq + s) for a, b, h, s in rows], columns=["lo", "hi", "height", "seq"])

    if n > 1:
        out.append(now.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(finish, MERGE))
    found = vectors.sparkSession.createDataFrame([], MERGE)
    for some in out:
        found = found.union(some)
    return stored(found)


def agglomerative(vectors: DataFrame, k: int = 15, linkage: str = "ward", small: int = SMALL, block: int = 4096) -> DataFrame:
    """``id, cluster``: the k clusters that are left when all merges but the last k - 1 are made, numbered by their least id.

    Fewer than k vectors are clusters of their own; no vectors give no rows.
    """
    from cellsight.operators.cluster import connected

    tree = merges(vectors, small, linkage, block)
    last = tree.orderBy(F.desc("height"), F.desc("seq"), F.desc("lo"), F.desc("hi")).limit(k - 1)
    kept = tree.join(last.select("lo", "hi"), ["lo", "hi"], "left_anti")
    roots = stored(connected(kept.select(F.col("lo").alias("a"), F.col("hi").alias("b")), vectors.select(F.col("id").cast("long").alias("id"))))
    number = with_row_index(roots.select("root").distinct(), ["root"], "cluster").select("root", F.col("cluster").cast("int").alias("cluster"))
    return roots.join(F.broadcast(number), "root").select("id", "cluster")  # k rows
