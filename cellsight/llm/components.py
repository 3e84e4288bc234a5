"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.llm.common import settle

MAX_ROUNDS = 50


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["s"], r["x"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (a, b) with a > b. Minima are aggregated before the shuffle; the join back is an ordinary one, which AQE can split where a hub is hot."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "star")
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = settle(edges.groupBy("a").agg(F.min("b").alias("m")), "star")
        out = edges.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return settle(out.where("a > b").distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` (longs); the root is the least node of its component.

    Null ends and loops are ignored; repeated and reversed edges count once; no edges give no rows.
    """
    e = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _signature(e)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        e = _star(_star(e, True), False)
        now = _signature(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
