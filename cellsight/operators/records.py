"""Changed records, places of values among clean ones, and a learnt cell attributor."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.functions import numbers as N
from cellsight.functions import text as T
from cellsight.operators import cells as C
from cellsight.operators.heuristics import column_statistics
from cellsight.operators.models import IntentClassifier
from cellsight.operators.order import running_before
from cellsight.operators.reference_values import value_codes
from cellsight.operators.storage import stored
from cellsight.operators.suspicion import value_shares

CELL_FEATURES = ["z", "abs_z", "place", "share", "known", "length", "digits", "special", "obfuscated", "is_null"]


def change_records(pairs: DataFrame, copies: int = 3) -> DataFrame:
    """One row for each changed cell of a variant: both values, size, direction, logarithm, relative change, codes, kind of column."""
    codes = value_codes(pairs)
    old, new = N.number_or_zero("old"), N.number_or_zero("new")
    size = F.when((F.abs(new - old) == 0) & ~F.col("old").eqNullSafe(F.col("new")), 1.0).otherwise(F.abs(new - old))
    j = pairs.where("mask <> 0").join(codes.withColumnsRenamed({"v": "old", "code": "old_code"}), ["col_name", "old"], "left").join(codes.withColumnsRenamed({"v": "new", "code": "new_code"}), ["col_name", "new"], "left")
    return j.select(
        F.col("row_idx").alias("variant_record_id"), C.clean_index(F.col("row_idx"), copies).alias("original_record_id"), (F.col("row_idx") % copies).alias("variant_idx"), F.col("col_name").alias("feature_name"), F.col("old").alias("original_value"),
        F.col("new").alias("new_value"), size.alias("change_magnitude"), F.signum(new - old).alias("change_direction"), F.log1p(size).alias("log_magnitude"), N.signed_relative_change(old, new).alias("relative_change"),
        F.coalesce("old_code", F.lit(-1)).alias("old_code"), F.coalesce("new_code", F.lit(-1)).alias("new_code"), T.feature_kind("col_name").alias("feature_kind"), F.col("mask").alias("intent_label"),
    )


def closest_baseline(results: DataFrame, baselines: DataFrame, metric: str = "f1") -> DataFrame:
    """``method, metric, baseline, gap``: the baseline (a few rows) whose figure is nearest."""
    b = baselines.select(F.col("method").alias("baseline"), F.col(metric).alias("__b"))
    gap = F.abs(F.col(metric) - F.col("__b"))
    return results.join(F.broadcast(b), F.lit(True)).groupBy("method", metric).agg(F.min_by("baseline", F.struct(gap, "baseline")).alias("baseline"), F.min(gap).alias("gap"))


def strict_percentile(values: DataFrame, clean: DataFrame) -> DataFrame:
    """``row_idx, col_name, below``: share of a column's clean numbers that are less. Inputs are (row_idx, col_name, x).

    Both sides are reduced to distinct values, which are added up in ranges.
    """
    known = clean.where("x IS NOT NULL").groupBy("col_name", "x").agg(F.count("*").alias("n"))
    asked = values.where("x IS NOT NULL").select("col_name", "x", F.lit(0).cast("long").alias("n")).distinct()
    both = known.unionByName(asked).groupBy("col_name", "x").agg(F.sum("n").alias("n"))
    totals = both.groupBy("col_name").agg(F.sum("n").alias("total"))
    placed = running_before(both, ["col_name"], ["x"], ["n"]).join(F.broadcast(totals), "col_name")  # a row for each column
    share = placed.select("col_name", "x", (F.col("n_before") / F.nullif("total", F.lit(0))).alias("below"))
    return values.join(share, ["col_name", "x"]).select("row_idx", "col_name", "below")


def diverse_records(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``id, cluster``: the vector nearest to each of k centres."""
    data = vectors.select("id", "v", array_to_vector("v").alias("features"))
    model = KMeans(k=k, seed=seed).fit(data)
    centres = [list(map(float, c)) for c in model.clusterCenters()]
    table = F.array(*[F.array(*map(F.lit, c)) for c in centres])
    out = model.transform(data).withColumn("c", F.element_at(table, F.col("prediction") + 1))
    d = F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return out.groupBy(F.col("prediction").alias("cluster")).agg(F.min_by("id", F.struct(d, "id")).alias("id"))


def cell_vectors(cells: DataFrame) -> DataFrame:
    """Ten features of every cell against its column's clean cells."""
    stats = column_statistics(cells).select("col_name", "col_type", "mean", "std_samp")
    freq = cells.where("mask = 0 AND value IS NOT NULL").groupBy("col_name", "value").agg(F.count("*").alias("k"))
    share = value_shares(freq)
    numbers = cells.select("row_idx", "col_name", N.number("value").alias("x"), "mask").where("x IS NOT NULL")
    place = strict_percentile(numbers.drop("mask"), numbers.where("mask = 0"))
    j = cells.join(F.broadcast(stats), "col_name").join(share, ["col_name", "value"], "left").join(place, ["row_idx", "col_name"], "left")
    z = F.when(F.col("col_type") == "num", F.coalesce(N.z_score(N.number("value"), "mean", "std_samp"), F.lit(0.0))).otherwise(0.0)
    v = F.coalesce("value", F.lit(""))
    return j.select(
        "row_idx", "col_name", "mask", z.alias("z"), F.abs(z).alias("abs_z"), F.coalesce("below", F.lit(0.0)).alias("place"), F.coalesce("share", F.lit(0.0)).alias("share"), F.col("share").isNotNull().cast("double").alias("known"), F.char_length(v).cast("double").alias("length"),
        T.has_digit(v).cast("double").alias("digits"), T.has_special(v).cast("double").alias("special"), T.is_obfuscation_token(v).cast("double").alias("obfuscated"), F.col("value").isNull().cast("double").alias("is_null"),
    )


def learned_suspicion(cells: DataFrame, columns: list[str], trees: int = 20, depth: int = 6) -> DataFrame:
    """``row_idx, col_name, suspicion``: chance of being flagged, from a forest for each column (of the schema).

    Features are stored once: every pass of every forest reads them.
    """
    vectors = stored(cell_vectors(cells).withColumn("flagged", F.when(F.col("mask") != 0, 1).otherwise(-1)))
    parts = []
    for c in columns:
        own = vectors.where(F.col("col_name") == c)
        parts.append(IntentClassifier(CELL_FEATURES, "flagged", trees, depth).fit(own).transform(own).select("row_idx", "col_name", F.col("proba").alias("suspicion")))
    return reduce(DataFrame.unionByName, parts)


def record_labels(cells: DataFrame, value: str = "intent", key: str = "row_idx") -> DataFrame:
    """``majority_intent, any_intent, n_cells`` of every record with a decided cell: the more frequent sign (ties: +1), and +1 if any cell has it."""
    plus, minus = F.count_if(F.col(value) == 1), F.count_if(F.col(value) == -1)
    c = cells.groupBy(key).agg(plus.alias("__p"), minus.alias("__m")).where("__p + __m > 0")
    return c.select(key, F.when(F.col("__p") >= F.col("__m"), 1).otherwise(-1).alias("majority_intent"), F.when(F.col("__p") > 0, 1).otherwise(-1).alias("any_intent"), (F.col("__p") + F.col("__m")).alias("n_cells"))


def first_records(cells: DataFrame, n: int, key: str = "row_idx") -> DataFrame:
    """Cells of the records numbered below ``n``."""
    return cells.where(F.col(key) < n)


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``name, n``: sizes of union, intersection and differences of two tables' keys."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    parts = {"union": left.union(right).distinct(), "both": left.intersect(right), "left_only": left.join(right, key, "left_anti"), "right_only": right.join(left, key, "left_anti")}
    return reduce(DataFrame.union, [d.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, d in parts.items()])
