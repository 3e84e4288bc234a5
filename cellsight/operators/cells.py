"""The long cell table: one row ``(row_idx, col_name, value, mask)`` for each cell, and what is done to masks.

``value`` is text, ``mask`` is +1 (intended), -1 (accident), 0 (clean).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellsight.functions.numbers import mask_value, number
from cellsight.functions.text import is_null_string
from cellsight.operators.storage import settled


def unpivot(wide: DataFrame, columns: list[str], key: str = "row_idx", masks: dict[str, str] | None = None) -> DataFrame:
    """Cells of ``columns``; ``masks`` maps a column to the one with its mask (absent: 0). One pass, no shuffle."""
    masks = masks or {}
    cell = lambda c: F.struct(F.lit(c).alias("col_name"), F.col(f"`{c}`").cast("string").alias("value"), (F.col(f"`{masks[c]}`").cast("int") if c in masks else F.lit(0)).alias("mask"))
    return wide.select(F.col(key).cast("long").alias("row_idx"), F.inline(F.array(*[cell(c) for c in columns])))


def shared_columns(a: DataFrame, b: DataFrame, drop: tuple[str, ...] = ()) -> list[str]:
    """Columns of both tables in the first one's order."""
    return [c for c in a.columns if c in set(b.columns) and c not in drop]


def with_row_index(df: DataFrame, order: list[str], name: str = "row_idx", parts: int | None = None) -> DataFrame:
    """Rows numbered from 0 in the given order without gathering them: ranges, a number within each, and the counts before."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    counts = dict(ranged.groupBy("__part").count().collect())
    before, total = [], 0
    for k in range(n):
        before.append(total)
        total += counts.get(k, 0)
    within = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    base = F.element_at(F.array(*[F.lit(x).cast("long") for x in before]), F.col("__part") + 1)
    return ranged.withColumn(name, base + within - 1).drop("__part")


def detect_types(cells: DataFrame, threshold: float = 0.9, overrides: dict[str, str] | None = None) -> DataFrame:
    """``col_name, n_values, n_numeric, col_type``: ``num`` if more than ``threshold`` of the non-null values parse."""
    stats = cells.groupBy("col_name").agg(F.count("value").alias("n_values"), F.count(number("value")).alias("n_numeric"))
    kind = F.when((F.col("n_values") > 0) & (F.col("n_numeric") > F.lit(threshold) * F.col("n_values")), "num").otherwise("cat")
    for c, t in (overrides or {}).items():
        kind = F.when(F.col("col_name") == c, t).otherwise(kind)
    return stats.withColumn("col_type", kind)


def merge_masks(intended: Column, accident: Column) -> Column:
    """Two 0/1 masks in one; an accident overwrites."""
    return F.when(accident == 1, -1).when(intended == 1, 1).otherwise(0)


def normalise_mask(code: Column) -> Column:
    """Subtype codes to their sign; what doesn't parse is clean."""
    return F.signum(mask_value(code)).cast("int")


def blind(mask: Column) -> Column:
    return (mask != 0).cast("int")


def row_errors(cells: DataFrame) -> DataFrame:
    """``row_idx, n_errors, is_erroneous`` of every row."""
    n = F.sum(blind(F.col("mask"))).cast("long")
    return cells.groupBy("row_idx").agg(n.alias("n_errors")).withColumn("is_erroneous", (F.col("n_errors") > 0).cast("int"))


def clean_rows(cells: DataFrame) -> DataFrame:
    return row_errors(cells).where("n_errors = 0").select("row_idx")


def error_histogram(cells: DataFrame) -> DataFrame:
    """``n_errors, n_rows``"""
    return row_errors(cells).groupBy("n_errors").agg(F.count("*").alias("n_rows"))


def errors(cells: DataFrame) -> DataFrame:
    return cells.where("mask <> 0")


def vocabulary(cells: DataFrame, case_blind_nulls: bool = True) -> DataFrame:
    """Distinct values of each column's clean cells with their count and first row, without null strings (or without the empty one alone)."""
    keep = ~is_null_string("value") if case_blind_nulls else (F.col("value").isNotNull() & (F.col("value") != ""))
    return cells.where("mask = 0").where(keep).groupBy("col_name", "value").agg(F.count("*").alias("n"), F.min("row_idx").alias("first_row"))


def with_variants(clean: DataFrame, key: str = "row_idx", copies: int = 3) -> DataFrame:
    """Every clean row once for each of its dirty variants, whose row number is copies * row + 0, 1, 2."""
    return clean.withColumn("__v", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn(key, F.col(key) * copies + F.col("__v")).drop("__v")


def clean_index(dirty_index: Column, copies: int = 3) -> Column:
    return F.floor(dirty_index / copies)


def paired_cells(clean: DataFrame, dirty: DataFrame, copies: int = 1) -> DataFrame:
    """``row_idx, col_name, mask, old, new``: dirty cells with the clean value of their row."""
    c = clean.select(F.col("row_idx").alias("clean_idx"), "col_name", F.col("value").alias("old"))
    d = dirty.select("row_idx", "col_name", "mask", F.col("value").alias("new"), clean_index(F.col("row_idx"), copies).alias("clean_idx"))
    return d.join(c, ["clean_idx", "col_name"]).select("row_idx", "col_name", "mask", "old", "new")


def overlay(cells: DataFrame, corrections: DataFrame) -> DataFrame:
    """Cells with the values of ``corrections`` (row_idx, col_name, value) where there is one."""
    fix = corrections.select("row_idx", "col_name", F.col("value").alias("__fix"), F.lit(True).alias("__is"))
    joined = cells.join(fix, ["row_idx", "col_name"], "left")
    return joined.withColumn("value", F.when(F.col("__is"), F.col("__fix")).otherwise(F.col("value"))).drop("__fix", "__is")


def attach_labels(features: DataFrame, cells: DataFrame) -> DataFrame:
    """Features with the intent of their cell; cells that are clean drop out."""
    return features.join(errors(cells).select("row_idx", "col_name", F.col("mask").alias("intent")), ["row_idx", "col_name"])


def priority_flags(flags: DataFrame, value: str = "cell_value", rank=None) -> DataFrame:
    """One flag for each cell: intended before accident before none."""
    order = rank if rank is not None else F.when(F.col(value) == 1, 2).when(F.col(value) == -1, 1).otherwise(0)
    return flags.groupBy("row_idx", "col_name").agg(F.max_by(value, order).alias(value))


def column_summary(flags: DataFrame, value: str = "cell_value") -> DataFrame:
    """``col_name, n_intended, n_accident`` of columns with any flag."""
    s = flags.groupBy("col_name").agg(F.count_if(F.col(value) == 1).alias("n_intended"), F.count_if(F.col(value) == -1).alias("n_accident"))
    return s.where("n_intended + n_accident > 0")


def tier_label(tier: Column) -> Column:
    return F.when(tier.isin("SUSPICIOUS", "COUNTERFEIT"), 1).otherwise(0)


def error_kind(error_type: Column, exact: tuple[str, ...], prefixes: tuple[str, ...] = ()) -> Column:
    """A if the type is in the set or starts with a prefix, else B."""
    hit = error_type.isin(*exact)
    for p in prefixes:
        hit = hit | error_type.startswith(p)
    return F.when(hit, "A").otherwise("B")


def mask_from_labels(cells: DataFrame, labels: DataFrame, behavioural: list[str]) -> DataFrame:
    """Mask of behavioural cells by their row's external label (1 intended, 0 accident); other cells are clean."""
    known = labels.select("row_idx", F.col("label").alias("__label"))
    joined = cells.join(known, "row_idx", "left")
    mask = F.when(~F.col("col_name").isin(*behavioural) | F.col("__label").isNull(), 0).when(F.col("__label") == 1, 1).otherwise(-1)
    return joined.withColumn("mask", mask).drop("__label")


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)
