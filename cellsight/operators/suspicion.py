"""Suspicion of single cells from their column, their neighbours and a detector's confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.functions import numbers as N
from cellsight.operators.detect import neighbours
from cellsight.operators.heuristics import column_statistics

WEIGHTS = {"counterfactual": 0.35, "local": 0.30, "validator": 0.20, "deviation": 0.15}


def value_shares(counts: DataFrame) -> DataFrame:
    """``col_name, value, share`` of counted values (``k``): each count over its column's total."""
    totals = counts.groupBy("col_name").agg(F.sum("k").alias("total"))
    return counts.join(F.broadcast(totals), "col_name").select("col_name", "value", (F.col("k") / F.col("total")).alias("share"))  # a row for each column


def deviation_scores(cells: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """``row_idx, col_name, deviation``: sigmoid of |z| - 3 for numbers (sample deviation), 1 - relative frequency for text, 1 if unknown."""
    stats = statistics if statistics is not None else column_statistics(cells)
    freq = cells.where("mask = 0 AND value IS NOT NULL").groupBy("col_name", "value").agg(F.count("*").alias("k"))
    share = value_shares(freq)
    j = cells.join(F.broadcast(stats.select("col_name", "col_type", "mean", "std_samp")), "col_name").join(share, ["col_name", "value"], "left")
    z = F.abs((N.number("value") - F.col("mean")) / F.nullif("std_samp", F.lit(0.0)))
    s = F.when(F.col("col_type") == "num", F.coalesce(N.sigmoid(z - 3), F.lit(0.0))).otherwise(1 - F.coalesce("share", F.lit(0.0)))
    return j.select("row_idx", "col_name", s.alias("deviation"))


def local_scores(queries: DataFrame, clean: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """``row_idx, col_name, local``: sigmoid of |z| - 2 against the k nearest clean rows (numeric columns scaled by their deviation)."""
    m = clean.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]).first().asDict()
    vec = F.array(*[(F.coalesce(F.col(c).cast("double"), F.lit(m[f"m_{c}"] or 0.0)) - F.lit(m[f"m_{c}"] or 0.0)) / F.lit(m[f"s_{c}"] or 1.0) for c in columns])
    near = neighbours(queries.select(F.col("row_idx").alias("id"), vec.alias("v")), clean.select(F.col("row_idx").alias("id"), vec.alias("v")), k)
    j = near.join(clean.select(F.col("row_idx").alias("b"), *columns), "b").groupBy("q").agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    own = queries.select(F.col("row_idx").alias("q"), *columns).join(j, "q")
    cell = lambda c: F.struct(F.lit(c).alias("col_name"), F.coalesce(N.sigmoid(F.abs((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0))) - 2), F.lit(0.0)).alias("local"))
    return own.select(F.col("q").alias("row_idx"), F.inline(F.array(*[cell(c) for c in columns])))


def counterfactual_scores(rows: DataFrame, columns: list[str], typical: dict[str, float], confidence) -> DataFrame:
    """``row_idx, col_name, counterfactual``: drop of ``confidence(row columns -> Column)`` when a cell takes its typical value, over the row's largest drop."""
    now = confidence({c: F.col(c) for c in columns})
    drops = [F.greatest(F.lit(0.0), now - confidence({o: (F.lit(typical[o]) if o == c else F.col(o)) for o in columns})) for c in columns]
    flat = rows.select("row_idx", *[d.alias(f"__d{i}") for i, d in enumerate(drops)])
    top = F.greatest(*[F.col(f"__d{i}") for i in range(len(columns))], F.lit(0.0))
    cell = lambda i, c: F.struct(F.lit(c).alias("col_name"), F.coalesce(F.col(f"__d{i}") / F.nullif(top, F.lit(0.0)), F.lit(0.0)).alias("counterfactual"))
    return flat.select("row_idx", F.inline(F.array(*[cell(i, c) for i, c in enumerate(columns)])))


def combine(parts: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """``row_idx, col_name, suspicion``: weighted sum of the scores given, with weights renormalised over all methods; a missing validator counts 0."""
    weights = weights or WEIGHTS
    total = sum(weights.values())
    out = None
    for name, df in parts.items():
        out = df if out is None else out.join(df, ["row_idx", "col_name"], "outer")
    s = sum((F.coalesce(F.col(n), F.lit(0.0)) * F.lit(weights[n] / total) for n in parts), F.lit(0.0))
    return out.select("row_idx", "col_name", N.clip(s, 0.0, 1.0).alias("suspicion"))
