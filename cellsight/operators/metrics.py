"""Metrics of predictions, scores and imputed values: aggregations with conditional sums, rank sums by mid-ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsight.operators.order import quantiles, running_before


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def confusion(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", positive: int = 1, by: list[str] = ()) -> DataFrame:
    """``tp, fp, fn, tn, precision, recall, f1, accuracy`` in one aggregation."""
    t, p = F.col(truth) == positive, F.col(pred) == positive
    agg = df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return agg.select(*by, "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def weighted_f1(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", by: list[str] = ()) -> DataFrame:
    """``accuracy, f1_pos, f1_neg, f1_weighted, f1_macro`` for labels +1 and -1."""
    t, p = F.col(truth), F.col(pred)
    agg = df.groupBy(*by).agg(F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == -1) & (p == 1)).alias("fp"), F.count_if((t == 1) & (p == -1)).alias("fn"), F.count_if((t == -1) & (p == -1)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    one, other = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    n = tp + fp + fn + tn
    classes = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    return agg.select(*by, ratio(tp + tn, n).alias("accuracy"), one.alias("f1_pos"), other.alias("f1_neg"), ratio(one * (tp + fn) + other * (tn + fp), n).alias("f1_weighted"), ratio(F.when(tp + fn > 0, one).otherwise(0.0) + F.when(tn + fp > 0, other).otherwise(0.0), classes).alias("f1_macro"))


def score_counts(df: DataFrame, truth: str = "y_true", score: str = "score") -> DataFrame:
    """Positives and negatives of every distinct score, with those below it.

    Rows are counted by score before anything is ordered, and the distinct scores are added up in ranges.
    """
    by = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))
    return running_before(by, [], ["s"], ["pos", "neg"]).select("s", "pos", "neg", F.col("neg_before").alias("neg_below"), (F.col("pos_before") + F.col("neg_before")).alias("below"))


def roc_auc(df: DataFrame, truth: str = "y_true", score: str = "score") -> DataFrame:
    """``auc, n_pos, n_neg`` with ties at half; null if there is one class only."""
    c = score_counts(df, truth, score)
    s = c.agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return s.select((F.col("u") / F.nullif(F.col("n_pos").cast("double") * F.col("n_neg"), F.lit(0.0))).alias("auc"), "n_pos", "n_neg")


def mann_whitney(df: DataFrame, group: str, value: str) -> DataFrame:
    """``u, z, p, n1, n2`` for rows with group 1 against the others, two-sided with tie correction and continuity."""
    c = score_counts(df.withColumn("__g", F.when(F.col(group) == 1, 1).otherwise(0)), "__g", value)
    t = (F.col("pos") + F.col("neg")).cast("double")
    s = c.agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("n1"), F.sum("neg").alias("n2"), F.sum(t * t * t - t).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    z = (F.greatest(F.col("u"), n1 * n2 - F.col("u")) - n1 * n2 / 2 - 0.5) / F.sqrt(var)
    # erfc(x / sqrt 2) by the rational form 7.1.26 of Abramowitz and Stegun, within 1.5e-7
    x = F.abs(z) / math.sqrt(2)
    k = 1 / (1 + 0.3275911 * x)
    poly = k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429))))
    return s.select("u", z.alias("z"), F.least(F.lit(1.0), poly * F.exp(-x * x)).alias("p"), "n1", "n2")


def normal_tail(z: float) -> float:
    """Two-sided p-value of a standard normal statistic (a single figure, on the driver)."""
    return math.erfc(abs(z) / math.sqrt(2))


def threshold_sweep(df: DataFrame, thresholds: DataFrame, truth: str = "y_true", score: str = "score") -> DataFrame:
    """Confusion figures at every threshold: positive if score >= threshold; a null score is negative.

    Cases are counted by score, and scores and thresholds run through one order; nothing is multiplied.
    """
    own = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))
    none = F.lit(None).cast("double")
    zero = F.lit(0).cast("long")
    # a threshold comes before an equal score, so what is before it is below it
    asked = thresholds.select(F.col("threshold").cast("double").alias("s"), zero.alias("pos"), zero.alias("neg"), F.lit(0).alias("kind"), "threshold").distinct()
    both = own.select("s", "pos", "neg", F.lit(1).alias("kind"), none.alias("threshold")).unionByName(asked)
    below = running_before(both, [], [F.col("s").asc_nulls_first(), F.col("kind")], ["pos", "neg"]).where("kind = 0")
    total = own.agg(F.coalesce(F.sum("pos"), zero).alias("p"), F.coalesce(F.sum("neg"), zero).alias("n"))
    fn, tn = F.col("pos_before"), F.col("neg_before")
    c = below.join(F.broadcast(total), F.lit(True)).select("threshold", (F.col("p") - fn).alias("tp"), (F.col("n") - tn).alias("fp"), fn.alias("fn"), tn.alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("threshold", "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def best_threshold(sweep: DataFrame, metric: str = "f1") -> DataFrame:
    return sweep.agg(F.max_by("threshold", F.struct(metric, -F.col("threshold"))).alias("threshold"), F.max(metric).alias(metric))


def percentile_thresholds(df: DataFrame, score: str = "score", n: int = 50) -> DataFrame:
    """``threshold``: scores at n percentiles from 1 to 99."""
    ps = [0.01 + 0.98 * i / (n - 1) for i in range(n)]
    return quantiles(df, [], score, ps).select(F.explode("q").alias("threshold"))


def calibration(df: DataFrame, truth: str = "y_true", prob: str = "prob", bins: int = 10) -> DataFrame:
    """``bin, n, mean_prob, rate`` of equal right-closed bins; 0 is in the first."""
    b = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(F.col(prob) * bins))).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("mean_prob"), F.avg((F.col(truth) == 1).cast("double")).alias("rate"))


def calibration_error(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.col("n") * F.abs(F.col("mean_prob") - F.col("rate"))) / F.sum("n")).alias("ece"))


def spearman(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """Rank correlation by group (mid-ranks)."""
    from cellsight.operators.heuristics import gain_numeric

    g = F.col(by) if by else F.lit("all")
    r = gain_numeric(df.select(g.alias("col_name"), F.col(x).alias("x"), F.col(y).alias("y")))
    return r.select(F.col("col_name").alias(by or "group"), (2 * F.col("gain") - 1).alias("spearman"))


def imputation_errors(df: DataFrame, truth: str, guess: str, by: str = "col_name") -> DataFrame:
    """``rmse, mae, nrmse, n`` by column; nrmse over the range of true values."""
    d = F.col(guess) - F.col(truth)
    a = df.groupBy(by).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), (F.max(truth) - F.min(truth)).alias("span"), F.count("*").alias("n"))
    return a.select(by, "rmse", "mae", ratio(F.col("rmse"), F.col("span")).alias("nrmse"), "n")


def hit_rate(df: DataFrame, truth: str, guess: str, by: str = "col_name") -> DataFrame:
    return df.groupBy(by).agg(F.avg(F.col(truth).eqNullSafe(F.col(guess)).cast("double")).alias("hit_rate"), F.count("*").alias("n"))


def group_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """``n, mean, median, std`` (population) of each group."""
    a = df.groupBy(F.col(group).alias("__g")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    q = quantiles(df.select(group, value), [group], value, [0.5])
    return a.join(q, F.col("__g").eqNullSafe(F.col(group)), "left").select(F.col("__g").alias(group), "n", "mean", F.col("q")[0].alias("median"), "std")


def score_distribution(df: DataFrame, group: str, score: str) -> DataFrame:
    a = df.groupBy(F.col(group).alias("__g")).agg(F.min(score).alias("low"), F.max(score).alias("high"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    q = quantiles(df.select(group, score), [group], score, [0.25, 0.5, 0.75])
    return a.join(q, F.col("__g").eqNullSafe(F.col(group)), "left").select(F.col("__g").alias(group), "low", *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))], "high", "mean", "std")


def suspicion_summary(df: DataFrame, score: str = "suspicion", tau: float = 0.5) -> DataFrame:
    n = F.count_if(F.col(score) > tau)
    return df.groupBy("col_name").agg(F.avg(score).alias("mean"), F.max(score).alias("high"), n.alias("n_over"), (100.0 * n / F.count("*")).alias("pct_over"))


def top_cells(df: DataFrame, score: str = "suspicion", k: int = 20) -> DataFrame:
    return df.orderBy(F.desc(score), "row_idx", "col_name").limit(k)


def agreement(df: DataFrame, old: str = "old", new: str = "new", imputed: str = "imputed", by: list[str] = ()) -> DataFrame:
    """Share of cells whose direction of change from the imputed value is that from the true one, and mean and median magnitude ratio."""
    d_true, d_imp = F.col(new) - F.col(old), F.col(new) - F.col(imputed)
    r = F.abs(d_imp) / F.nullif(F.abs(d_true), F.lit(0.0))
    rows = df.select(F.struct(*by, F.lit(0).alias("__all")).alias("__g"), (F.signum(d_true) == F.signum(d_imp)).cast("double").alias("same"), r.cast("double").alias("r"))
    a = rows.groupBy("__g").agg(F.avg("same").alias("direction_match"), F.avg("r").alias("ratio_mean"), F.count("*").alias("n"))
    joined = a.join(quantiles(rows, ["__g"], "r", [0.5]), "__g", "left")
    return joined.select(*[F.col(f"__g.{c}").alias(c) for c in by], "direction_match", "ratio_mean", F.col("q")[0].alias("ratio_median"), "n")


def mean_std(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and deviation over repeated runs."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std"))


def pivot_metric(df: DataFrame, row: str, column: str, value: str, columns: list | None = None) -> DataFrame:
    return df.groupBy(row).pivot(column, columns).agg(F.max(value))


def single_class(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Figures where every case is positive: precision is 1 if anything was predicted."""
    hit, n = F.count_if(F.col(pred) == F.col(truth)), F.count("*")
    r = df.agg(hit.alias("hit"), n.alias("n"))
    recall = ratio(F.col("hit"), F.col("n"))
    return r.select("hit", "n", recall.alias("recall"), ratio(2 * recall, 1 + recall).alias("f1"))
