"""Reference values and comparison of cells with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsight.functions import numbers as N
from cellsight.functions import text as T
from cellsight.operators.order import column_quantiles, medians, numbered


def typical(df: DataFrame, by: list[str], columns: dict[str, str], name: Callable[[str], str]) -> DataFrame:
    """``by`` and, for each column, the median of its numbers or the mode of its text (least on ties)."""
    num = {c: name(c) for c, kind in columns.items() if kind == "num"}
    text = [F.mode(c, deterministic=True).alias(name(c)) for c, kind in columns.items() if kind != "num"]
    key = F.struct(*[F.col(b) for b in by], F.lit(0).alias("__all"))
    out = df.groupBy(key.alias("__k")).agg(F.lit(0).alias("__none"), *text)
    if num:
        out = out.join(medians(df.withColumn("__k", key), ["__k"], num), "__k", "left")
    return out.select(*[F.col(f"__k.{b}").alias(b) for b in by], *[name(c) for c in columns])


def pseudo_clean(df: DataFrame, keys: tuple[str, str], columns: dict[str, str]) -> DataFrame:
    """``columns`` (name -> num or cat) replaced by the typical value of (g1, g2), else g1, else g2, else all rows.

    A level only falls back where its value is null. The four aggregates are small next to the table; the planner joins them.
    """
    g1, g2 = keys
    out = df
    levels = [[g1, g2], [g1], [g2], []]
    for i, by in enumerate(levels):
        agg = typical(df, by, columns, lambda c, i=i: f"__{i}_{c}")
        if by:
            named = agg.select(*[F.col(b).alias(f"__k{i}_{b}") for b in by], *[f"__{i}_{c}" for c in columns])
            on = [F.col(b).eqNullSafe(F.col(f"__k{i}_{b}")) for b in by]
            cond = on[0] if len(on) == 1 else on[0] & on[1]
            out = out.join(named, cond, "left").drop(*[f"__k{i}_{b}" for b in by])
        else:
            out = out.join(F.broadcast(agg), F.lit(True), "left")  # one row
    value = lambda c: F.coalesce(*[F.col(f"__{i}_{c}") for i in range(4)]).alias(c)
    return out.select(*[value(c) if c in columns else F.col(c) for c in df.columns])


def median_broadcast(df: DataFrame, where: Column, columns: list[str]) -> DataFrame:
    """Every row with the medians of the rows that pass ``where`` as ``<column>_typical``."""
    found = column_quantiles(df.where(where), columns, [0.5])
    return df.withColumns({f"{c}_typical": F.lit(q[0]).cast("double") for c, q in found.items()})


def group_median(df: DataFrame, group: str, column: str, name: str = "group_median") -> DataFrame:
    med = medians(df, [group], {column: name})
    return df.join(med, group, "left")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """``value`` of a dimension (first row of each key), or a default."""
    first = table.groupBy(key).agg(F.min(value).alias(value))
    return df.join(first, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def value_codes(pairs: DataFrame) -> DataFrame:
    """``col_name, v, code``: values of a column (old or new) numbered from 0 in order."""
    values = pairs.select("col_name", F.explode(F.array("old", "new")).alias("v")).where("v IS NOT NULL").distinct()
    return numbered(values.where("col_name IS NOT NULL"), ["col_name"], ["v"], "code").withColumn("code", F.col("code").cast("int"))


def change_statistics(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Ten figures of each flagged pair (old, new): sizes, direction, logarithms and codes. Text counts as 0, a changed text as 1.

    Codes are those of all pairs given, so pass clean cells too.
    """
    codes = value_codes(pairs)
    place = F.element_at(F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(float(i)))]), F.col("col_name"))
    old, new = N.number_or_zero("old"), N.number_or_zero("new")
    size = F.when((F.abs(new - old) == 0) & ~F.col("old").eqNullSafe(F.col("new")), 1.0).otherwise(F.abs(new - old))
    flagged = pairs.where("mask <> 0")
    coded = flagged.join(codes.withColumnRenamed("v", "old").withColumnRenamed("code", "oc"), ["col_name", "old"], "left").join(codes.withColumnRenamed("v", "new").withColumnRenamed("code", "nc"), ["col_name", "new"], "left")
    return coded.select(
        "row_idx", "col_name", size.alias("stat_change_magnitude"), (size / (F.abs(old) + 1)).alias("stat_relative_change"), F.signum(new - old).alias("stat_change_direction"), F.abs(old).alias("stat_original_magnitude"),
        F.abs(new).alias("stat_new_magnitude"), F.log1p(F.abs(old)).alias("stat_original_log"), F.log1p(F.abs(new)).alias("stat_new_log"), place.alias("stat_feature_name_encoded"),
        F.coalesce("oc", F.lit(-1)).cast("double").alias("stat_original_value_encoded"), F.coalesce("nc", F.lit(-1)).cast("double").alias("stat_new_value_encoded"),
    )


def diagnostics(results: DataFrame, alpha: float = 1.0, eps: float = 1e-6) -> DataFrame:
    """Direction, size, relative and weighted change of imputation results (observed_value, imputed_value, col_type, sigma_tree)."""
    num = F.col("col_type") == "num"
    obs, imp = N.number_or_zero("observed_value"), N.number_or_zero("imputed_value")
    a, b = F.trim(F.coalesce("observed_value", F.lit(""))), F.trim(F.coalesce("imputed_value", F.lit("")))
    share = T.edit_share(a, b)
    return results.select(
        "*",
        F.when(num, F.signum(obs - imp)).otherwise((a != b).cast("double")).alias("change_direction"),
        F.when(num, F.abs(obs - imp)).otherwise(T.edit_distance(a, b).cast("double")).alias("change_magnitude"),
        F.when(num, N.scaled_change(imp, obs, eps)).otherwise(share).alias("raw_relative_change"),
        F.when(num, N.weighted_change(imp, obs, F.col("sigma_tree"), alpha, eps)).otherwise(N.weighted_edit(share, F.col("sigma_tree"), alpha)).alias("wrc"),
        N.confidence("sigma_tree").alias("confidence_tree"),
        (~num).cast("int").alias("is_categorical"),
    )


def reference_features(pairs: DataFrame, reference: str = "old", observed: str = "new", suffix: str = "_oracle") -> DataFrame:
    """Direction, size and relative change from any reference column (true, imputed, or naive), named with a suffix."""
    ref, obs = F.col(reference), F.col(observed)
    return pairs.select(
        "row_idx", "col_name", F.signum(obs - ref).alias(f"direction{suffix}"), F.abs(obs - ref).alias(f"magnitude{suffix}"), (F.abs(obs - ref) / F.greatest(F.abs(ref), F.lit(1e-6))).alias(f"relative{suffix}")
    )


def variant_aggregates(changes: DataFrame) -> DataFrame:
    """Ten aggregates of each changed record (variant_record_id; feature_name, original_value, new_value, change_magnitude)."""
    rel = F.col("change_magnitude") / (F.abs("original_value") + 1)
    m = "change_magnitude"
    return changes.groupBy("variant_record_id").agg(
        F.count("*").alias("n_changes"), F.avg(m).alias("mean_magnitude"), F.coalesce(F.stddev_pop(m), F.lit(0.0)).alias("std_magnitude"), F.min(m).alias("min_magnitude"), F.max(m).alias("max_magnitude"), F.percentile(m, F.lit(0.5)).alias("median_magnitude"),
        F.min("original_value").alias("min_original"), F.max("new_value").alias("max_new"), F.avg(rel).alias("mean_relative_change"), F.max_by("feature_name", F.struct(m, "feature_name")).alias("max_change_feature"),
    )
