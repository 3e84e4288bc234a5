"""Fingerprint features of flagged cells in five groups. Statistics are learnt from all cells, flagged ones included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellsight.functions import numbers as N
from cellsight.functions import text as T
from cellsight.operators import cells as C
from cellsight.operators.heuristics import column_statistics
from cellsight.operators.order import medians


def vocabulary(cells: DataFrame) -> DataFrame:
    return cells.where("value IS NOT NULL").select("col_name", F.trim("value").alias("entry")).distinct()


def plausibility(cells: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """Range tests of numbers; vocabulary test and least edit distance (lower case) of text.

    Cells count towards the vocabulary themselves, so the distance is only taken for values that are not in it.
    """
    stats = statistics if statistics is not None else column_statistics(cells, clean_only=False)
    vocab = vocabulary(cells)
    flagged = C.errors(cells).join(F.broadcast(stats.select("col_name", "col_type", "p5", "p95", "low", "high")), "col_name")
    known = vocab.select("col_name", F.col("entry").alias("__v"), F.lit(1).alias("known"))
    v = F.trim(F.coalesce("value", F.lit("")))
    j = flagged.withColumn("__v", v).join(known, ["col_name", "__v"], "left")
    odd = j.where("col_type = 'cat' AND known IS NULL").select("col_name", "__v").distinct()
    near = odd.join(vocab, "col_name").groupBy("col_name", "__v").agg(F.min(T.edit_distance(F.lower("__v"), F.lower("entry"))).alias("d"))
    x, num = N.number("value"), F.col("col_type") == "num"
    inside = lambda a, b: F.when(num, F.coalesce(x.between(F.col(a), F.col(b)), F.lit(False)).cast("int"))
    return j.join(near, ["col_name", "__v"], "left").select(
        "row_idx", "col_name", inside("p5", "p95").alias("plaus_in_range"), inside("low", "high").alias("plaus_in_minmax"), F.when(~num, F.coalesce("known", F.lit(0))).alias("plaus_in_vocab"), F.when(~num, F.coalesce("d", F.lit(0))).alias("plaus_min_edit_dist")
    )


def distribution(cells: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """z (sample deviation, at least 1e-6) and place in the range of numbers; frequency, majority, rank from 0 of text (by count, then value)."""
    stats = statistics if statistics is not None else column_statistics(cells, clean_only=False)
    key = F.lower(F.trim("value"))
    freq = cells.where("value IS NOT NULL").groupBy("col_name", key.alias("k")).agg(F.count("*").alias("n"))
    w = W.partitionBy("col_name")
    ranked = freq.select("col_name", "k", (F.col("n") / F.sum("n").over(w)).alias("share"), (F.row_number().over(w.orderBy(F.desc("n"), "k")) - 1).alias("rank"), F.count("*").over(w).alias("size"))
    sizes = freq.groupBy("col_name").agg(F.count("*").alias("n_unique"))
    j = C.errors(cells).withColumn("k", key).join(F.broadcast(stats.select("col_name", "col_type", "mean", "std_samp", "low", "high")), "col_name").join(ranked.drop("size"), ["col_name", "k"], "left").join(F.broadcast(sizes), "col_name", "left")
    x, num = N.number("value"), F.col("col_type") == "num"
    z = (x - F.col("mean")) / F.greatest(F.coalesce("std_samp", F.lit(1.0)), F.lit(1e-6))
    n = lambda c: F.when(num, F.coalesce(c, F.lit(0.0)))
    return j.select(
        "row_idx", "col_name", n(z).alias("dist_z_score"), n(F.abs(z)).alias("dist_abs_z"), n(F.when(x.isNotNull(), N.position(x, "low", "high"))).alias("dist_percentile_approx"), F.when(~num, F.coalesce("share", F.lit(0.0))).alias("dist_value_freq"),
        F.when(~num, F.coalesce(F.col("rank") == 0, F.lit(False)).cast("int")).alias("dist_is_majority"), F.when(~num, F.coalesce("rank", "n_unique")).cast("long").alias("dist_freq_rank"), F.when(~num, 1 / F.col("n_unique")).alias("dist_n_unique_ratio"),
    )


def strings(cells: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Obfuscation, typo pattern, length against the median of the vocabulary, digits and special characters."""
    types = types if types is not None else C.detect_types(cells).select("col_name", "col_type")
    median = medians(vocabulary(cells).withColumn("length", F.char_length("entry")), ["col_name"], {"length": "median_length"})
    j = C.errors(cells).join(F.broadcast(types), "col_name").join(F.broadcast(median), "col_name", "left")
    v, cat = F.trim(F.coalesce("value", F.lit(""))), F.col("col_type") == "cat"
    return j.select(
        "row_idx", "col_name", T.is_obfuscation_token(v, T.FINGERPRINT_OBFUSCATION_TOKENS).cast("int").alias("str_is_obfuscation"), F.when(cat, T.typo_score(v)).otherwise(0.0).alias("str_typo_score"),
        F.when(cat, F.coalesce(T.length_anomaly(v, "median_length"), F.lit(0.0))).otherwise(0.0).alias("str_len_anomaly"), F.when(cat, T.has_digit(v).cast("int")).alias("str_has_digits"), F.when(cat, T.has_special(v).cast("int")).alias("str_has_special"),
    )


def pattern(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Errors in the row, whether there are several, and the column's identity."""
    n = F.count("*").over(W.partitionBy("row_idx"))
    return C.errors(cells).select("row_idx", "col_name", n.alias("pat_n_errors_in_row"), (n > 1).cast("int").alias("pat_multi_error"), *[(F.col("col_name") == c).cast("int").alias(f"pat_col_{c}") for c in columns])


def coherence(bank, flagged: DataFrame) -> DataFrame:
    """Match with the value expected from the row, confidence, and normalised residual, from a bank of predictors."""
    parts = []
    for c, t in bank.types.items():
        own = flagged.where(F.col("col_name") == c).select("row_idx", "col_name")
        if c not in bank.models:
            parts.append(own.select("row_idx", "col_name", F.lit(0).alias("coher_predicted_match"), F.lit(0.0).alias("coher_confidence"), F.lit(0.0).alias("coher_residual_norm")))
            continue
        p, sd = bank.predict(c), bank.std[c]
        gap = F.abs(F.col("observed") - F.col("expected"))
        if t == "cat":
            cols = [(gap == 0).cast("int"), F.col("probability"), 1 - F.col("probability")]
        else:
            cols = [(gap < sd).cast("int"), N.confidence("sigma"), gap / F.lit(sd + 1e-6)]
        names = ("coher_predicted_match", "coher_confidence", "coher_residual_norm")
        parts.append(own.join(p.select("row_idx", *[c_.alias(n) for c_, n in zip(cols, names)]), "row_idx").select("row_idx", "col_name", *names))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def fingerprint(cells: DataFrame, columns: list[str], bank=None) -> DataFrame:
    """All groups joined on the cell; coherence where a bank is given."""
    stats = column_statistics(cells, clean_only=False)
    types = stats.select("col_name", "col_type")
    parts = [plausibility(cells, stats), pattern(cells, columns), distribution(cells, stats), strings(cells, types)] + ([coherence(bank, C.errors(cells))] if bank else [])
    out = C.errors(cells).select("row_idx", "col_name")
    for p in parts:
        out = out.join(p, ["row_idx", "col_name"])
    return out
