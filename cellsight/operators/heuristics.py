"""The eight heuristics on flagged cells: each learns from clean cells and adds its columns to the flagged ones.

All of them read the long cell table. Statistics of columns have one row for each column of the schema, so they are
broadcast; vocabularies grow with the data and are joined by the planner's choice.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellsight.functions import numbers as N
from cellsight.functions import text as T
from cellsight.operators import cells as C
from cellsight.operators.encode import label_codes
from cellsight.operators.order import mid_ranks, numbered, quantiles
from cellsight.operators.storage import settled

LARGE_VOCABULARY, KEPT_VOCABULARY = 200, 50
MI_THRESHOLD, MI_COLUMNS, MI_ROWS = 0.5, 20, 100
GAIN_ROWS = 5
#: Fixed order of the feature columns.
FEATURES = (
    "h1_plausible", "h2_min_edit_distance", "h2_is_obfuscation", "h3_distribution_score", "h4_coherence_score", "h5_error_count", "h5_codependent_flag",
    "h6_column_importance", "h7_gain_direction", "h7_comprehensibility", "h8_is_sensitive", "h8_is_majority_value",
)


def column_statistics(cells: DataFrame, clean_only: bool = True, types: dict[str, str] | None = None) -> DataFrame:
    """One row for each column: type, quantiles, moments and extremes of its numbers.

    Quantiles are exact and come from ranges of the values, see :func:`quantiles`.
    """
    kinds = C.detect_types(cells, overrides=types).select("col_name", "col_type")
    x = N.number("value")
    clean = cells.where("mask = 0") if clean_only else cells
    q = quantiles(clean.select("col_name", x.alias("x")), ["col_name"], "x", [0.05, 0.25, 0.5, 0.75, 0.95])  # a row for each column
    s = clean.groupBy("col_name").agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std_pop"), F.stddev_samp(x).alias("std_samp"), F.min(x).alias("low"), F.max(x).alias("high"), F.count("value").alias("n"), F.count(x).alias("n_num")
    ).join(F.broadcast(q), "col_name", "left")
    named = s.select("col_name", *[F.col("q")[i].alias(p) for i, p in enumerate(("p5", "p25", "p50", "p75", "p95"))], "mean", "std_pop", "std_samp", "low", "high", "n", "n_num")
    return kinds.join(named, "col_name", "left")


def _with_stats(cells: DataFrame, statistics: DataFrame) -> DataFrame:
    return C.errors(cells).join(F.broadcast(statistics), "col_name")


def h1_plausibility(cells: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """In the clean vocabulary (text) or within p5..p95 (numbers). A value that doesn't parse in a numeric column misses both."""
    statistics = statistics if statistics is not None else column_statistics(cells)
    words = C.vocabulary(cells).select("col_name", "value", F.lit(1).alias("known"))
    x = N.number("value")
    in_range = F.when((F.col("col_type") == "num") & x.isNotNull(), x.between(F.col("p5"), F.col("p95")).cast("int"))
    in_vocab = F.when((F.col("col_type") == "cat") | x.isNull(), F.coalesce("known", F.lit(0)))
    joined = _with_stats(cells, statistics).join(words, ["col_name", "value"], "left")
    in_vocab = F.when((F.col("col_type") == "num") & x.isNull(), F.lit(0)).otherwise(in_vocab)
    return joined.select("row_idx", "col_name", F.coalesce(in_range, in_vocab).alias("h1_plausible"), in_vocab.alias("h1_in_vocab"), in_range.alias("h1_in_range"))


def capped_vocabulary(cells: DataFrame) -> DataFrame:
    """Vocabulary of each text column; beyond 200 values only the 50 most frequent (first seen first)."""
    v = settled(C.vocabulary(cells, case_blind_nulls=False))
    sizes = v.groupBy("col_name").agg(F.count("*").alias("size"))
    # the planner keeps the first 200 of each column in every task before the shuffle
    rank = F.row_number().over(W.partitionBy("col_name").orderBy(F.desc("n"), "first_row"))
    ranked = v.withColumn("rank", rank).where(F.col("rank") <= LARGE_VOCABULARY).join(F.broadcast(sizes), "col_name")
    return ranked.where((F.col("size") <= LARGE_VOCABULARY) | (F.col("rank") <= KEPT_VOCABULARY)).select("col_name", F.col("value").alias("entry"))


def h2_string_anomaly(cells: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Least capped edit distance to the clean vocabulary and the obfuscation test, for text columns.

    Distances are taken once for each distinct value, and a column has at most 200 entries to compare with.
    """
    types = types if types is not None else C.detect_types(cells)
    flagged = C.errors(cells).join(F.broadcast(types.where("col_type = 'cat'").select("col_name")), "col_name").withColumn("value", F.coalesce("value", F.lit("")))
    values = flagged.select("col_name", "value").distinct()
    entries = capped_vocabulary(cells)
    near = F.min(F.when(F.col("value") == F.col("entry"), 0).otherwise(T.edit_distance_capped("value", "entry")))
    suffix = F.bool_or((F.col("value") != F.col("entry")) & T.has_obfuscation_suffix("value", "entry"))
    compared = values.join(entries, "col_name", "left").groupBy("col_name", "value").agg(near.alias("d"), suffix.alias("s"))
    obfuscated = (F.col("value") != "") & (T.is_obfuscation_token("value") | F.coalesce("s", F.lit(False)) | T.is_placeholder("value"))
    scored = compared.select("col_name", "value", F.coalesce("d", F.lit(T.EDIT_CAP)).cast("int").alias("h2_min_edit_distance"), obfuscated.cast("int").alias("h2_is_obfuscation"))
    return flagged.select("row_idx", "col_name", "value").join(scored, ["col_name", "value"]).select("row_idx", "col_name", "h2_min_edit_distance", "h2_is_obfuscation")


def frequency_ranks(cells: DataFrame) -> DataFrame:
    """``col_name, value, n, rank, size`` of clean non-null values: the most frequent first, then by value."""
    v = cells.where("mask = 0 AND value IS NOT NULL").groupBy("col_name", "value").agg(F.count("*").alias("n"))
    ranked = settled(numbered(v, ["col_name"], [F.desc("n"), F.col("value")], "rank").withColumn("rank", F.col("rank") + 1))
    return ranked.join(F.broadcast(ranked.groupBy("col_name").agg(F.count("*").alias("size"))), "col_name").select("col_name", "value", "n", "rank", "size")


def h3_distribution(cells: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """Numbers: 1 at the mean to 0 at three deviations (population). Text: by frequency rank."""
    statistics = statistics if statistics is not None else column_statistics(cells)
    ranks = frequency_ranks(cells)
    sizes = ranks.groupBy("col_name").agg(F.max("size").alias("vocab_size"))
    joined = _with_stats(cells, statistics).join(ranks.select("col_name", "value", "rank"), ["col_name", "value"], "left").join(F.broadcast(sizes), "col_name", "left")
    numeric = N.centrality(N.number("value"), "mean", "std_pop")
    score = F.when(F.col("col_type") == "num", numeric).otherwise(N.rank_score("rank", "vocab_size"))
    return joined.select("row_idx", "col_name", score.cast("double").alias("h3_distribution_score"))


def mutual_information_pairs(cells: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, mi`` (nats) of every pair of columns over clean rows, from pair counts; at most 20 columns.

    A row's cells meet in one array, so the pairs come from one shuffle by row.
    """
    kept = sorted(columns)[:MI_COLUMNS] if len(columns) > MI_COLUMNS else sorted(columns)
    rows = cells.join(C.clean_rows(cells), "row_idx", "left_semi").where(F.col("col_name").isin(kept))
    wide = rows.groupBy("row_idx").agg(*[F.max(F.when(F.col("col_name") == c, F.coalesce("value", F.lit("")))).alias(f"c{i}") for i, c in enumerate(kept)])
    pairs = wide.select(F.inline(F.array(*[F.struct(F.lit(kept[i]).alias("a"), F.lit(kept[j]).alias("b"), F.col(f"c{i}").alias("x"), F.col(f"c{j}").alias("y")) for i, j in combinations(range(len(kept)), 2)])))
    joint = pairs.groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    px = joint.groupBy("a", "b", "x").agg(F.sum("n").alias("nx"))
    py = joint.groupBy("a", "b", "y").agg(F.sum("n").alias("ny"))
    total = joint.groupBy("a", "b").agg(F.sum("n").alias("t"))
    all_ = joint.join(px, ["a", "b", "x"]).join(py, ["a", "b", "y"]).join(F.broadcast(total), ["a", "b"])
    p = F.col("n") / F.col("t")
    return all_.groupBy("a", "b").agg(F.sum(p * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"))


def codependent_pairs(columns: list[str], user_pairs: list[tuple[str, str]] = (), mi_pairs: list[tuple[str, str]] = ()) -> set[tuple[str, str]]:
    """User pairs (of known columns), pairs alike by name, and pairs by mutual information."""
    known = set(columns)
    given = {tuple(sorted(p)) for p in [*user_pairs, *mi_pairs] if set(p) <= known}
    return given | T.similar_names(columns)


def h5_error_pattern(cells: DataFrame, pairs: set[tuple[str, str]]) -> DataFrame:
    """Errors in the cell's row, and whether a partner column is flagged there too: one aggregation by row."""
    flagged = C.errors(cells)
    partners: dict[str, list[str]] = {}
    for a, b in pairs:
        partners.setdefault(a, []).append(b)
        partners.setdefault(b, []).append(a)
    by_row = flagged.groupBy("row_idx").agg(F.collect_set("col_name").alias("flagged"))
    hit = F.lit(False)
    for c, ps in sorted(partners.items()):
        hit = F.when(F.col("col_name") == c, F.arrays_overlap("flagged", F.array(*[F.lit(p) for p in sorted(ps)]))).otherwise(hit)
    return by_row.select("row_idx", "flagged", F.explode("flagged").alias("col_name")).select("row_idx", "col_name", F.size("flagged").alias("h5_error_count"), hit.cast("int").alias("h5_codependent_flag"))


def gain_numeric(pairs: DataFrame) -> DataFrame:
    """``col_name, gain`` = 0.5 + 0.5 * Spearman correlation of ``x`` and ``y`` (0.5 below three rows or for constants).

    Rows are counted by their pair of values; only distinct values are ranked, in ranges.
    """
    counts = settled(pairs.where("x IS NOT NULL AND y IS NOT NULL").groupBy("col_name", "x", "y").agg(F.count("*").alias("c")))
    rank = lambda v, name: mid_ranks(counts.withColumnRenamed("c", "__c"), "col_name", v, name, "__c")
    ranked = counts.join(rank("x", "rx"), ["col_name", "x"]).join(rank("y", "ry"), ["col_name", "y"])
    c, rx, ry = F.col("c").cast("double"), F.col("rx"), F.col("ry")
    s = ranked.groupBy("col_name").agg(
        F.sum(c).alias("n"), F.sum(c * rx).alias("sx"), F.sum(c * ry).alias("sy"), F.sum(c * rx * rx).alias("sxx"), F.sum(c * ry * ry).alias("syy"), F.sum(c * rx * ry).alias("sxy")
    )
    spread = F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")))
    r = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(spread, F.lit(0.0))
    return s.select("col_name", F.when(F.col("n") < 3, 0.5).otherwise(N.clip(0.5 + 0.5 * F.coalesce(r, F.lit(0.0)), 0.0, 1.0)).alias("gain"))


def gain_categorical(pairs: DataFrame) -> DataFrame:
    """``col_name, value, gain``: 1 for the upper half of values by mean target (at least one; ties by value), else 0."""
    means = pairs.where("value IS NOT NULL AND y IS NOT NULL").groupBy("col_name", "value").agg(F.avg("y").alias("m"))
    ranked = settled(numbered(means, ["col_name"], [F.desc("m"), F.col("value")], "rank"))
    sizes = ranked.groupBy("col_name").agg(F.count("*").alias("size"))
    return ranked.join(F.broadcast(sizes), "col_name").select("col_name", "value", (F.col("rank") < F.greatest(F.lit(1), F.floor(F.col("size") / 2))).cast("double").alias("gain"))


def h7_incentive(cells: DataFrame, target: str | None, types: DataFrame | None = None, mutability: dict[str, float] | None = None) -> DataFrame:
    """``h7_mutability, h7_gain_direction, h7_comprehensibility`` of flagged cells; the target's own gain is 1, without a target 0.5."""
    types = types if types is not None else C.detect_types(cells)
    flagged = C.errors(cells)
    names = [r[0] for r in types.select("col_name").collect()]  # columns of the schema
    score = lambda of: F.element_at(F.create_map(*[x for n in names for x in (F.lit(n), F.lit(float(of(n))))]), F.col("col_name"))
    fixed = [score(lambda n: (mutability or {}).get(n, T.mutability(n))).alias("h7_mutability"), score(T.comprehensibility).alias("h7_comprehensibility")]
    if target is None:
        return flagged.select("row_idx", "col_name", F.lit(0.5).alias("h7_gain_direction"), *fixed)
    clean = cells.join(C.clean_rows(cells), "row_idx", "left_semi")
    outcome = clean.where(F.col("col_name") == target).select("row_idx", "value")
    codes = label_codes(outcome, "value").select("value", F.col("code").cast("double").alias("code"))
    y = outcome.join(codes, "value").select("row_idx", F.coalesce(N.number("value"), "code").alias("y"))
    pairs = clean.where(F.col("col_name") != target).join(y, "row_idx").join(F.broadcast(types.select("col_name", "col_type")), "col_name")
    numeric = gain_numeric(pairs.where("col_type = 'num'").select("col_name", N.number("value").alias("x"), "y"))
    by_value = gain_categorical(pairs.where("col_type = 'cat'").select("col_name", "value", "y"))
    enough = y.count() >= GAIN_ROWS
    joined = flagged.join(F.broadcast(numeric.withColumnRenamed("gain", "g_num")), "col_name", "left").join(by_value.withColumnRenamed("gain", "g_cat"), ["col_name", "value"], "left")
    gain = F.when(F.col("col_name") == target, 1.0).otherwise(F.coalesce("g_num", "g_cat", F.lit(0.5)) if enough else F.lit(0.5))
    return joined.select("row_idx", "col_name", gain.alias("h7_gain_direction"), *fixed)


def h8_sensitivity(cells: DataFrame, sensitive: list[str] | None = None, types: DataFrame | None = None) -> DataFrame:
    """Whether the column is sensitive (given, or by its name) and, if it holds text, whether the value is its clean majority (ties: the least)."""
    types = types if types is not None else C.detect_types(cells)
    hit = F.col("col_name").isin(list(sensitive)) if sensitive is not None else F.lower("col_name").rlike("|".join(T.SENSITIVE_KEYWORDS))
    majority = cells.where("mask = 0 AND value IS NOT NULL").where(hit).groupBy("col_name").agg(F.mode("value", deterministic=True).alias("majority"))
    joined = C.errors(cells).join(F.broadcast(types.select("col_name", "col_type")), "col_name").join(F.broadcast(majority), "col_name", "left")
    is_majority = hit & (F.col("col_type") == "cat") & (F.col("value") == F.col("majority"))
    return joined.select("row_idx", "col_name", hit.cast("int").alias("h8_is_sensitive"), F.coalesce(is_majority, F.lit(False)).cast("int").alias("h8_is_majority_value"))


def assemble(cells: DataFrame, target: str | None = None, pairs: set | None = None, sensitive: list[str] | None = None, extra: list[DataFrame] = ()) -> DataFrame:
    """All heuristic columns of every flagged cell, joined on (row_idx, col_name); ``extra`` adds H4 and H6 where they are fitted."""
    statistics = settled(column_statistics(cells))
    types = statistics.select("col_name", "col_type")
    columns = [r[0] for r in types.select("col_name").collect()]
    parts = [
        h1_plausibility(cells, statistics), h2_string_anomaly(cells, types), h3_distribution(cells, statistics),
        h5_error_pattern(cells, pairs if pairs is not None else codependent_pairs(columns)), h7_incentive(cells, target, types), h8_sensitivity(cells, sensitive, types), *extra,
    ]
    out = C.errors(cells).select("row_idx", "col_name")
    for p in parts:
        out = out.join(p, ["row_idx", "col_name"], "left")
    return out


def complete(features: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    """The named feature columns in order, absent ones as 0, nulls as ``fill``."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(fill)) if c in features.columns else F.lit(0.0)
    return features.select("row_idx", "col_name", *[value(c).alias(c) for c in columns])
