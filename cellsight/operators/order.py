"""Order statistics that no task has to see whole: ranges of the order, totals before each range, running sums within it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellsight.operators.storage import stored

#: Rows that one task may order.
DIRECT = 1 << 18


def running_before(rows: DataFrame, by: list[str], order: list[Column | str], sums: list[str]) -> DataFrame:
    """``rows`` with ``<name>_before`` for each name in ``sums``: its sum over the rows of the same group that come earlier.

    Rows are stored and dealt into ranges of (group, order), stored again, as the cuts come from a sample. Only the totals of
    each range and group, at most ranges plus groups, are added up in one place. At most ``DIRECT`` rows are ordered without
    ranges, to the same sums: no group has more. Group columns must not be null.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(rows)
    if rows.count() <= DIRECT:
        w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return rows.select(*rows.columns, *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"{s}_before") for s in sums])
    ranged = stored(rows.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()))
    earlier = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "__part").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    before = totals.select(*by, "__part", *[F.coalesce(F.sum(f"__t_{s}").over(earlier), F.lit(0)).alias(f"__b_{s}") for s in sums])
    within = W.partitionBy(*by, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return ranged.join(before, [*by, "__part"]).select(*rows.columns, *[(F.coalesce(F.sum(s).over(within), F.lit(0)) + F.col(f"__b_{s}")).alias(f"{s}_before") for s in sums])


def numbered(rows: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with their number from 0 in the order of their group; the order must leave no ties."""
    return running_before(rows.withColumn("__one", F.lit(1).cast("long")), by, order, ["__one"]).withColumnRenamed("__one_before", name).drop("__one")


def mid_ranks(rows: DataFrame, by: str, value: str, name: str, count: str) -> DataFrame:
    """``by, value, name``: the mean rank, from 1, of each distinct value among what ``count`` counts in its group; values are counted first."""
    counts = rows.groupBy(by, value).agg(F.sum(count).alias("__n"))
    ranked = running_before(counts, [by], [value], ["__n"])
    return ranked.select(by, value, (F.col("__n_before") + (F.col("__n") + 1) / 2).cast("double").alias(name))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], name: str = "q") -> DataFrame:
    """``by, name``: exact quantiles of ``value`` in each group, an array in the order of ``shares``, interpolated as ``percentile`` does.

    Values are counted first, then ranges of the distinct ones are added up, and only the values that hold a rank go on: no task
    sees a group's values whole. Nulls don't count; a group of nothing else gives no row. Null groups are a group.
    """
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(key.alias("__g"), F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    placed = running_before(counts, ["__g"], ["__v"], ["__n"])
    totals = placed.groupBy("__g").agg(F.sum("__n").alias("__total"))
    asked = totals.select("__g", "__total", F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("__i", "__s")).withColumn("__at", (F.col("__total") - 1) * F.col("__s"))
    asked = asked.groupBy("__g").agg(F.collect_list(F.struct("__i", "__at")).alias("__asked"))
    end = F.col("__n_before") + F.col("__n")
    holds = lambda at: (at >= F.col("__n_before")) & (at < end)
    hit = placed.join(asked, "__g").select("__g", "__v", F.explode(F.filter("__asked", lambda a: holds(F.floor(a["__at"])) | holds(F.ceil(a["__at"])))).alias("__a"), "__n_before", "__n")
    low, high = F.floor(F.col("__a.__at")), F.ceil(F.col("__a.__at"))
    ends = hit.groupBy("__g", "__a").agg(F.max(F.when(holds(low), F.col("__v"))).alias("lo"), F.max(F.when(holds(high), F.col("__v"))).alias("hi"))
    at = F.col("__a.__at")
    x = F.when((low == high) | (F.col("lo") == F.col("hi")), F.col("lo")).otherwise((high - at) * F.col("lo") + (at - low) * F.col("hi"))
    found = ends.select("__g", F.struct(F.col("__a.__i").alias("i"), x.alias("x")).alias("__x")).groupBy("__g").agg(F.transform(F.array_sort(F.collect_list("__x")), lambda e: e["x"]).alias(name))
    return found.select(*[F.col(f"__g.{c}").alias(c) for c in by], name)


def column_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns of a table, on the driver: a few figures for each column of the schema."""
    if not columns:
        return {}
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns])))
    found = {r["col_name"]: list(r["q"]) for r in quantiles(long, ["col_name"], "x", shares).collect()}
    return {c: found.get(c, [None] * len(shares)) for c in columns}


def medians(df: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """``by`` and the exact median of each column under its new name, for every group of ``df`` (null groups are one)."""
    key = F.struct(*[F.col(b) for b in by])
    long = df.select(key.alias("__k"), F.inline(F.array(*[F.struct(F.lit(c).alias("__c"), F.col(f"`{c}`").cast("double").alias("__x")) for c in columns])))
    q = quantiles(long, ["__k", "__c"], "__x", [0.5])
    wide = q.groupBy("__k").agg(*[F.max(F.when(F.col("__c") == c, F.col("q")[0])).alias(name) for c, name in columns.items()])
    groups = df.select(key.alias("__k")).distinct()
    return groups.join(wide, "__k", "left").select(*[F.col(f"__k.{b}").alias(b) for b in by], *columns.values())


def quantile(rows: DataFrame, value: str, share: float) -> float | None:
    """One quantile of a whole column; None without values."""
    r = quantiles(rows, [], value, [share]).first()
    return None if r is None else r["q"][0]
