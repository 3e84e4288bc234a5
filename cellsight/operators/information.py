"""Mutual information from nearest neighbours: of a number and a class, and of two numbers.

A row's radius is the distance to its k-th neighbour, within its class or in the plane of both numbers; how many rows
lie within that radius along one number alone says how much the other one tells. Numbers are placed in ranges: neighbours
of a class come from blocks of its ranks that share k rows with the next, and rows within a radius are the difference of
two running counts, so no task sees a column. Radii are open, as the estimators ask; equal numbers are counted where the
radius is 0 (no noise is added to tell them apart), which for a number with few values gives the plug-in estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellsight.operators.nearest import neighbours
from cellsight.operators.order import numbered, running_before
from cellsight.operators.storage import stored

NEIGHBOURS = 3
#: Ranks of a class that one task looks at.
BLOCK = 1 << 14
#: Share of a radius within which numbers count as inside the open one.
INSIDE = 1 - 1e-9


def digamma(x: Column) -> Column:
    """Of numbers from 1 on: six steps of the recurrence, then the asymptotic series (error below 1e-9)."""
    x = x.cast("double")
    y = x + 6
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * F.pow(y, F.lit(4.0))) - 1 / (252 * F.pow(y, F.lit(6.0)))
    return series - sum((1 / (x + j) for j in range(6)), F.lit(0.0))


DIGAMMA_SQL = "(ln({0} + 6.0) - 1 / (2 * ({0} + 6.0)) - 1 / (12 * ({0} + 6.0) ** 2) + 1 / (120 * ({0} + 6.0) ** 4) - 1 / (252 * ({0} + 6.0) ** 6) - 1.0 / {0} - 1 / ({0} + 1.0) - 1 / ({0} + 2.0) - 1 / ({0} + 3.0) - 1 / ({0} + 4.0) - 1 / ({0} + 5.0))"


def count_inside(rows: DataFrame, by: list[str], value: str, radius: str, name: str, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` (with a unique ``row``) and how many rows of the group lie within the open radius of each along ``value``, itself included.

    ``counts``: what is counted, as ``by, value, n``, if not the rows themselves.
    """
    ends = [(-1, F.col(value) - F.col(radius) * INSIDE), (1, F.col(value) + F.col(radius) * INSIDE)]
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    whole = rows.groupBy(*by, value).agg(F.count("*").alias("n")) if counts is None else counts
    points = whole.select(*by, F.col(value).alias("__x"), F.col("n").alias("__n")).withColumn("__side", F.lit(0)).withColumn("row", F.lit(None).cast("long"))
    for side, at in ends:
        points = points.unionByName(rows.select(*by, at.alias("__x"), zero.alias("__n"), F.lit(side).alias("__side"), "row"))
    placed = running_before(points, by, ["__x", "__side"], ["__n"]).where("row IS NOT NULL")
    counted = placed.groupBy("row").agg(F.sum(F.when(F.col("__side") == 1, F.col("__n_before")).otherwise(-F.col("__n_before"))).alias(name))
    return rows.join(counted, "row")


def with_class(rows: DataFrame, k: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """``pair, mi`` (nats, at least 0) of ``pair, label, x`` for every pair: a class and a number.

    Rows without a class or number don't count, nor do classes of one row. Pairs without rows are left out.
    """
    counts = rows.where("label IS NOT NULL AND x IS NOT NULL").groupBy("pair", "label", F.col("x").cast("double").alias("x")).agg(F.count("*").alias("n"))
    counts = stored(counts)
    sizes = counts.groupBy("pair", "label").agg(F.sum("n").alias("size")).where("size > 1")
    joined = stored(counts.join(sizes, ["pair", "label"]).withColumn("k", F.least(F.lit(k), F.col("size") - 1)))
    totals = joined.groupBy("pair", "x").agg(F.sum("n").alias("inside"))
    # a number that has k more of its kind in the class has radius 0; of the others k + 1 copies are all that neighbours can need
    tied = joined.where("n > k").join(totals, ["pair", "x"]).select("pair", "n", "size", F.col("n").alias("own"), "inside")
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(k + 1)))))
    placed = numbered(copies, ["pair", "label"], ["x", "copy"], "rank")
    rank = F.col("rank")
    homes = F.array_distinct(F.array(F.floor(rank / block), F.floor(F.greatest(rank - k, F.lit(0)) / block), F.floor((rank + k) / block)))
    near = placed.withColumn("block", F.explode(homes))
    w = W.partitionBy("pair", "label", "block").orderBy("rank")
    far = F.lit(None).cast("double")
    for m in range(1, k + 1):  # the m-th neighbour is the far end of the tightest run of m + 1 around the row
        for o in range(m + 1):
            left = F.col("x") - (F.lag("x", o).over(w) if o else F.col("x"))
            right = (F.lead("x", m - o).over(w) if o < m else F.col("x")) - F.col("x")
            far = F.least(far, F.when((F.col("k") == m) & left.isNotNull() & right.isNotNull(), F.greatest(left, right)))
    radius = near.withColumn("radius", far).where((F.col("block") == F.floor(rank / block)) & (F.col("copy") == 1) & (F.col("n") <= F.col("k")))
    rows_ = stored(radius.select("pair", "x", "n", "size", "k", "radius", F.monotonically_increasing_id().alias("row")))
    loose = count_inside(rows_, ["pair"], "x", "radius", "inside", totals.select("pair", "x", F.col("inside").alias("n")))
    every = tied.union(loose.select("pair", "n", "size", F.col("k").alias("own"), "inside"))
    term = digamma(F.col("own")) - digamma(F.col("size")) - digamma(F.col("inside"))
    return every.groupBy("pair").agg(F.greatest(F.lit(0.0), digamma(F.sum("n")) + F.sum(F.col("n") * term) / F.sum("n")).alias("mi"))


def of_numbers(rows: DataFrame, k: int = NEIGHBOURS) -> float:
    """Mutual information (nats, at least 0) of two numbers ``x, y``, both over their deviation; 0 for fewer than two rows.

    The k-th neighbour goes by the larger of both differences and comes from a search around pivots.
    """
    some = rows.where("x IS NOT NULL AND y IS NOT NULL").select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    s = some.agg(F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.count("*").alias("n")).first()
    n, k = s["n"], min(k, s["n"] - 1)
    if k < 1:
        return 0.0
    data = stored(some.select((F.col("x") / (s["sx"] or 1.0)).alias("x"), (F.col("y") / (s["sy"] or 1.0)).alias("y"), F.monotonically_increasing_id().alias("row")))
    points = data.select(F.col("row").alias("id"), F.array("x", "y").alias("v"))
    radius = neighbours(points, points, k + 1, "chebyshev").groupBy(F.col("q").alias("row")).agg(F.max("d").alias("radius"))
    same = data.groupBy("x", "y").agg(F.count("*").alias("same"))
    placed = stored(data.join(radius, "row").join(same, ["x", "y"]).withColumn("all", F.lit(0)))
    counted = count_inside(stored(count_inside(placed, ["all"], "x", "radius", "nx")), ["all"], "y", "radius", "ny")
    own = F.when(F.col("radius") > 0, F.lit(k)).otherwise(F.col("same"))
    mi = counted.agg(F.avg(digamma(own) - digamma(F.col("nx")) - digamma(F.col("ny"))) + digamma(F.lit(n))).first()[0]
    return max(0.0, float(mi))
