"""Queries of masks, reference values, metrics, samplers, encoders, votes and answers of a language model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.functions import decisions as D
from cellsight.functions import text as T
from cellsight.operators import cells as C
from cellsight.operators import cluster, detect, encode
from cellsight.operators import metrics as M
from cellsight.operators import reference_values as R
from cellsight.operators import sampling as S
from cellsight.plans import fixtures as X
from cellsight.plans.fixtures import FX_FLAGS, FX_PRED

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# masks and labels ---------------------------------------------------------------------


@query("SELECT event_id, sign(coalesce(try_cast(CASE WHEN event_id % 11 = 0 THEN 'x' ELSE (event_id % 7 - 3)::VARCHAR END AS DOUBLE), 0))::INT AS intent FROM events")
def mask_normalise(spark, sf_dir):
    code = F.when(F.col("event_id") % 11 == 0, "x").otherwise((F.col("event_id") % 7 - 3).cast("string"))
    return X.table(spark, sf_dir, "events").select("event_id", C.normalise_mask(code).alias("intent"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS intent FROM events")
def mask_merge(spark, sf_dir):
    i, u = (F.col("event_id") % 3 == 0).cast("int"), (F.col("event_id") % 5 == 0).cast("int")
    return X.table(spark, sf_dir, "events").select("event_id", C.merge_masks(i, u).alias("intent"))


@query(f"SELECT row_idx, col_name, (CASE WHEN max((cell_value = 1)::INT) = 1 THEN 1 WHEN max((cell_value = -1)::INT) = 1 THEN -1 ELSE 0 END)::INT AS cell_value FROM ({FX_FLAGS}) GROUP BY 1, 2")
def priority_dedup(spark, sf_dir):
    return C.priority_flags(X.flags(spark, sf_dir))


@query(f"SELECT col_name, count(*) FILTER (cell_value = 1) AS n_intended, count(*) FILTER (cell_value = -1) AS n_accident FROM ({FX_FLAGS}) GROUP BY 1 HAVING count(*) FILTER (cell_value <> 0) > 0")
def column_summary(spark, sf_dir):
    return C.column_summary(X.flags(spark, sf_dir))


@query(f"SELECT tier, (tier IN ('SUSPICIOUS', 'COUNTERFEIT'))::INT AS label, count(*) AS n FROM ({FX_FLAGS}) GROUP BY 1, 2")
def tier_label(spark, sf_dir):
    return X.flags(spark, sf_dir).groupBy("tier", C.tier_label(F.col("tier")).alias("label")).agg(F.count("*").alias("n"))


@query("""SELECT event_id AS row_idx, col_name, (CASE WHEN col_name = 'props' OR user_id % 4 = 3 THEN 0 WHEN user_id % 4 = 1 THEN 1 ELSE -1 END)::INT AS mask
FROM events CROSS JOIN (SELECT unnest(['event_type', 'value', 'props']) AS col_name)""")
def mask_from_label(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").withColumnRenamed("event_id", "row_idx")
    cells = C.unpivot(e, ["event_type", "value", "props"])
    labels = e.where(F.col("user_id") % 4 != 3).select("row_idx", (F.col("user_id") % 4 == 1).cast("int").alias("label"))
    return C.mask_from_labels(cells, labels, ["event_type", "value"]).select("row_idx", "col_name", "mask")


@query("SELECT event_id AS dirty_idx, floor(event_id / 3)::BIGINT AS clean_idx FROM events")
def variant_index(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select(F.col("event_id").alias("dirty_idx"), C.clean_index(F.col("event_id")).alias("clean_idx"))


@query("SELECT c_custkey * 3 + v AS row_idx, c_mktsegment FROM customer CROSS JOIN (SELECT unnest([0, 1, 2]) AS v)")
def variant_expansion(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_idx"), "c_mktsegment")
    return C.with_variants(c)


@query("SELECT c_custkey AS row_idx, CASE WHEN c_custkey % 9 = 0 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS value FROM customer")
def correction_overlay(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_idx"), F.lit("c_mktsegment").alias("col_name"), F.col("c_mktsegment").alias("value"))
    fix = c.where("row_idx % 9 = 0").withColumn("value", F.concat(F.upper("value"), F.lit("!")))
    return C.overlay(c, fix).select("row_idx", "value")


# reference values ---------------------------------------------------------------------

_PART = "p AS (SELECT p_partkey, p_brand, p_type, CASE WHEN p_brand = 'Brand#2' AND p_type = 'ECONOMY' OR p_brand = 'Brand#1' THEN NULL ELSE p_retailprice END AS price, CASE WHEN p_brand = 'Brand#1' THEN NULL ELSE p_name END AS name FROM part)"
_MODE = "SELECT {k}, name FROM (SELECT {k}, name, row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, name) AS r FROM p WHERE name IS NOT NULL GROUP BY {k}, name) WHERE r = 1"


@query(f"""WITH {_PART}, a AS (SELECT p_brand, p_type, quantile_cont(price, 0.5) AS v FROM p GROUP BY 1, 2), b AS (SELECT p_brand, quantile_cont(price, 0.5) AS v FROM p GROUP BY 1), c AS (SELECT p_type, quantile_cont(price, 0.5) AS v FROM p GROUP BY 1), d AS (SELECT quantile_cont(price, 0.5) AS v FROM p),
am AS ({_MODE.format(k='p_brand, p_type')}), bm AS ({_MODE.format(k='p_brand')}), cm AS ({_MODE.format(k='p_type')})
SELECT p_partkey, p.p_brand, p.p_type, round(coalesce(a.v, b.v, c.v, d.v), 6) AS price, coalesce(am.name, bm.name, cm.name) AS name FROM p LEFT JOIN a USING (p_brand, p_type) LEFT JOIN b USING (p_brand) LEFT JOIN c USING (p_type) CROSS JOIN d
LEFT JOIN am USING (p_brand, p_type) LEFT JOIN bm USING (p_brand) LEFT JOIN cm USING (p_type)""")
def pseudo_clean(spark, sf_dir):
    gone = (F.col("p_brand") == "Brand#2") & (F.col("p_type") == "ECONOMY") | (F.col("p_brand") == "Brand#1")
    p = X.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.when(~gone, F.col("p_retailprice")).alias("price"), F.when(F.col("p_brand") != "Brand#1", F.col("p_name")).alias("name"))
    return R.pseudo_clean(p, ("p_brand", "p_type"), {"price": "num", "name": "cat"}).withColumn("price", F.round("price", 6))


@query("SELECT c_custkey, c_acctbal, round((SELECT quantile_cont(c_acctbal, 0.5) FROM customer WHERE c_mktsegment = 'BUILDING'), 6) AS c_acctbal_typical FROM customer")
def median_broadcast(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer")
    return R.median_broadcast(c, F.col("c_mktsegment") == "BUILDING", ["c_acctbal"]).select("c_custkey", "c_acctbal", *r6("c_acctbal_typical"))


@query("SELECT c_custkey, c_nationkey, round(m, 6) AS group_median FROM customer JOIN (SELECT c_nationkey, quantile_cont(c_acctbal, 0.5) AS m FROM customer GROUP BY 1) USING (c_nationkey)")
def group_median_map(spark, sf_dir):
    return R.group_median(X.table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal").select("c_custkey", "c_nationkey", *r6("group_median"))


_CHANGES = "SELECT user_id AS variant_record_id, event_type AS feature_name, value AS original_value, value * (1 + event_id % 5) AS new_value, value * (event_id % 5) AS change_magnitude FROM events"


@query(f"""WITH c AS ({_CHANGES}) SELECT variant_record_id, count(*) AS n_changes, round(avg(change_magnitude), 6) AS mean_magnitude, round(stddev_pop(change_magnitude), 6) AS std_magnitude, round(min(change_magnitude), 6) AS min_magnitude,
  round(max(change_magnitude), 6) AS max_magnitude, round(quantile_cont(change_magnitude, 0.5), 6) AS median_magnitude, round(min(original_value), 6) AS min_original, round(max(new_value), 6) AS max_new,
  round(avg(change_magnitude / (abs(original_value) + 1)), 6) AS mean_relative_change, max((change_magnitude, feature_name)).feature_name AS max_change_feature
FROM (SELECT *, struct_pack(change_magnitude := change_magnitude, feature_name := feature_name) AS s FROM c) GROUP BY 1""".replace("max((change_magnitude, feature_name)).feature_name", "max(s).feature_name"))
def variant_aggregates(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    c = e.select(F.col("user_id").alias("variant_record_id"), F.col("event_type").alias("feature_name"), F.col("value").alias("original_value"), (F.col("value") * (1 + F.col("event_id") % 5)).alias("new_value"), (F.col("value") * (F.col("event_id") % 5)).alias("change_magnitude"))
    return R.variant_aggregates(c).select("variant_record_id", "n_changes", *r6("mean_magnitude", "std_magnitude", "min_magnitude", "max_magnitude", "median_magnitude", "min_original", "max_new", "mean_relative_change"), "max_change_feature")


# metrics --------------------------------------------------------------------------------

_CM = f"WITH p AS ({FX_PRED}), c AS (SELECT count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = -1 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = -1) AS fn, count(*) FILTER (y_true = -1 AND y_pred = -1) AS tn FROM p)"


@query(f"{_CM} SELECT tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy FROM c")
def confusion_prf(spark, sf_dir):
    return M.confusion(X.predictions(spark, sf_dir)).select("tp", "fp", "fn", "tn", *r6("precision", "recall", "f1", "accuracy"))


@query(f"""{_CM}, f AS (SELECT *, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS a, 2 * tn / (2 * tn + fp + fn)::DOUBLE AS b, (tp + fp + fn + tn)::DOUBLE AS n FROM c)
SELECT round((tp + tn) / n, 6) AS accuracy, round(a, 6) AS f1_pos, round(b, 6) AS f1_neg, round((a * (tp + fn) + b * (tn + fp)) / n, 6) AS f1_weighted, round((a + b) / 2, 6) AS f1_macro FROM f""")
def weighted_f1(spark, sf_dir):
    return M.weighted_f1(X.predictions(spark, sf_dir)).select(*r6("accuracy", "f1_pos", "f1_neg", "f1_weighted", "f1_macro"))


_RANK = f"WITH p AS ({FX_PRED}), r AS (SELECT y_true, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM p), s AS (SELECT sum(rk) FILTER (y_true = 1) AS rs, count(*) FILTER (y_true = 1) AS n1, count(*) FILTER (y_true <> 1) AS n2 FROM r)"


@query(f"{_RANK} SELECT round((rs - n1 * (n1 + 1) / 2.0) / (n1 * n2), 6)::DOUBLE AS auc, n1::BIGINT AS n_pos, n2::BIGINT AS n_neg FROM s")
def roc_auc(spark, sf_dir):
    return M.roc_auc(X.predictions(spark, sf_dir)).select(*r6("auc"), "n_pos", "n_neg")


@query(f"""{_RANK}, t AS (SELECT sum(n * n * n - n)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS n FROM p GROUP BY score)), u AS (SELECT (rs - n1 * (n1 + 1) / 2.0)::DOUBLE AS u, n1::DOUBLE AS a, n2::DOUBLE AS b, n1, n2, ties FROM s CROSS JOIN t)
SELECT round(u, 6) AS u, round((greatest(u, a * b - u) - a * b / 2 - 0.5) / sqrt(a * b / 12 * ((a + b + 1) - ties / ((a + b) * (a + b - 1)))), 6) AS z, n1::BIGINT AS n1, n2::BIGINT AS n2 FROM u""")
def mann_whitney(spark, sf_dir):
    return M.mann_whitney(X.predictions(spark, sf_dir), "y_true", "score").select(*r6("u", "z"), "n1", "n2")


@query(f"""WITH p AS ({FX_PRED}), t AS (SELECT unnest(range(0, 21)) * 500.0::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (y_true = 1 AND score >= threshold) AS tp, count(*) FILTER (y_true <> 1 AND score >= threshold) AS fp, count(*) FILTER (y_true = 1 AND score < threshold) AS fn FROM p CROSS JOIN t GROUP BY 1)
SELECT threshold::DOUBLE AS threshold, tp, fp, fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM c""")
def threshold_sweep(spark, sf_dir):
    t = spark.range(21).select((F.col("id") * 500.0).alias("threshold"))
    return M.threshold_sweep(X.predictions(spark, sf_dir), t).select("threshold", "tp", "fp", "fn", *r6("f1"))


_PROB = f"WITH p AS (SELECT y_true, least(1.0, score / 20000.0)::DOUBLE AS prob FROM ({FX_PRED})), b AS (SELECT greatest(1, least(10, ceil(prob * 10)))::INT AS bin, count(*) AS n, avg(prob) AS mp, avg((y_true = 1)::INT) AS rate FROM p GROUP BY 1)"


def _prob(spark, sf_dir) -> DataFrame:
    return X.predictions(spark, sf_dir).withColumn("prob", F.least(F.lit(1.0), F.col("score") / 20000.0))


@query(f"{_PROB} SELECT bin, n, round(mp, 6) AS mean_prob, round(rate, 6) AS rate FROM b")
def calibration_bins(spark, sf_dir):
    return M.calibration(_prob(spark, sf_dir)).select("bin", "n", *r6("mean_prob", "rate"))


@query(f"{_PROB} SELECT round(sum(n * abs(mp - rate)) / sum(n), 6) AS ece FROM b")
def calibration_ece(spark, sf_dir):
    return M.calibration_error(M.calibration(_prob(spark, sf_dir))).select(*r6("ece"))


@query("""WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT l_returnflag, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1""")
def spearman(spark, sf_dir):
    return M.spearman(X.table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag").select("l_returnflag", *r6("spearman"))


@query("SELECT event_type, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def score_distribution(spark, sf_dir):
    return M.score_distribution(X.table(spark, sf_dir, "events"), "event_type", "value").select("event_type", "low", *r6("q1", "median", "q3"), "high", *r6("mean", "std"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def pivot_metric(spark, sf_dir):
    counts = X.table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    p = M.pivot_metric(counts, "o_orderpriority", "o_orderstatus", "n", ["F", "O", "P"])
    return p.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("F", "O", "P")])


# samples --------------------------------------------------------------------------------

#: Arithmetic draw, the same in both engines.
_DRAW = "(event_id * 7919 + 13) % 100003"
_EV = f"e AS (SELECT event_id, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN -1 ELSE (SELECT count(DISTINCT event_type) FROM events x WHERE x.event_type < e.event_type) END::INT AS cluster, {_DRAW} AS k FROM events e)"
_SIZES = "s AS (SELECT cluster, count(*) AS n FROM e GROUP BY 1), t AS (SELECT greatest({rounding}(sum(n) * 0.01), 2) AS target FROM s), v AS (SELECT sum(n) AS total FROM s WHERE cluster <> -1)"


def _events(spark, sf_dir) -> DataFrame:
    e = X.table(spark, sf_dir, "events")
    kinds = e.select("event_type").distinct()
    codes = encode.label_codes(kinds, "event_type").select(F.col("value").alias("event_type"), F.when(F.col("code") == 0, -1).otherwise(F.col("code")).cast("int").alias("cluster"))
    return e.join(codes, "event_type").select(F.col("event_id").alias("row_idx"), "cluster", ((F.col("event_id") * 7919 + 13) % 100003).alias("k"))


def _sampled(df: DataFrame) -> DataFrame:
    return df.select(F.col("row_idx").alias("event_id"), "cluster")


@query(f"WITH {_EV}, n AS (SELECT greatest(round_even(count(*) * 0.01, 0), 2)::BIGINT AS n FROM e), r AS (SELECT *, row_number() OVER (ORDER BY k, event_id) AS i FROM e) SELECT event_id, cluster FROM r CROSS JOIN n WHERE i <= n")
def sample_uniform(spark, sf_dir):
    return _sampled(S.uniform(_events(spark, sf_dir), 0.01, F.col("k")))


def _allocated(alloc: str) -> str:
    return f"WITH {_EV}, {_SIZES.format(rounding='round')}, {alloc}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY k, event_id) AS i FROM e) SELECT event_id, r.cluster FROM r JOIN a ON r.cluster = a.cluster WHERE i <= m"


@query(_allocated("a AS (SELECT cluster, greatest(1, round_even(n / (sum(n) OVER ())::DOUBLE * target, 0))::BIGINT AS m FROM s CROSS JOIN t)"))
def sample_prop_noise(spark, sf_dir):
    return _sampled(S.proportional(_events(spark, sf_dir), 0.01, S.with_noise, order=F.col("k")))


@query(_allocated("""b AS (SELECT cluster, n, round_even(n / total::DOUBLE * target, 0)::BIGINT AS m FROM s CROSS JOIN t CROSS JOIN v WHERE cluster <> -1), o AS (SELECT sum(m)::BIGINT - (SELECT target FROM t)::BIGINT AS over FROM b),
a AS (SELECT cluster, m - CASE WHEN row_number() OVER (ORDER BY m DESC, cluster::VARCHAR) <= abs(over) THEN sign(over)::BIGINT ELSE 0 END AS m FROM b CROSS JOIN o)"""))
def sample_prop_floor0(spark, sf_dir):
    return _sampled(S.proportional(_events(spark, sf_dir), 0.01, S.without_floor, order=F.col("k")))


@query(_allocated("""b AS (SELECT cluster, n, greatest(5, round_even(n / total::DOUBLE * target, 0))::BIGINT AS m FROM s CROSS JOIN t CROSS JOIN v WHERE cluster <> -1), o AS (SELECT sum(m)::BIGINT - (SELECT target FROM t)::BIGINT AS over, count(*) AS c FROM b),
g AS (SELECT *, row_number() OVER (ORDER BY m DESC, cluster::VARCHAR) AS i FROM b), a AS (SELECT cluster, greatest(CASE WHEN over > 0 THEN 5 ELSE 0 END, m - sign(over)::BIGINT * ((abs(over) - i + c) // c)) AS m FROM g CROSS JOIN o)"""))
def sample_prop_floor5(spark, sf_dir):
    return _sampled(S.proportional(_events(spark, sf_dir), 0.01, S.with_floor, order=F.col("k")))


_OWN_SIZES = "b AS (SELECT cluster, n, greatest(1, round_even(n / total::DOUBLE * target, 0))::BIGINT AS m FROM s CROSS JOIN t CROSS JOIN v WHERE cluster <> -1), o AS (SELECT sum(m)::BIGINT - (SELECT target FROM t)::BIGINT AS over FROM b)"
#: Allocations shrink from the highest level down: one unit of each level of each cluster above the first.
_LOWERED = "w AS (SELECT cluster, row_number() OVER (ORDER BY u DESC, cluster::VARCHAR) AS i FROM (SELECT cluster, unnest(range(2, m + 1)) AS u FROM {0})), l AS (SELECT w.cluster, count(*) AS less FROM w CROSS JOIN {1} WHERE i <= over GROUP BY 1)"


@query(_allocated(f"""{_OWN_SIZES}, {_LOWERED.format("b", "o")},
a AS (SELECT b.cluster, m - coalesce(less, 0) + CASE WHEN over < 0 AND row_number() OVER (ORDER BY n DESC, b.cluster::VARCHAR) = 1 THEN -over ELSE 0 END AS m FROM b CROSS JOIN o LEFT JOIN l ON b.cluster = l.cluster)"""))
def sample_prop_trimmed(spark, sf_dir):
    return _sampled(S.proportional(_events(spark, sf_dir), 0.01, S.trimmed, order=F.col("k")))


@query(f"""WITH {_EV}, s AS (SELECT cluster, count(*) AS n FROM e WHERE cluster <> -1 GROUP BY 1), b AS (SELECT cluster, n, least(10, greatest(1, round_even(n / (sum(n) OVER ())::DOUBLE * 40, 0)))::BIGINT AS m FROM s),
o AS (SELECT sum(m)::BIGINT - 40 AS over FROM b), {_LOWERED.format("b", "o")},
g AS (SELECT *, row_number() OVER (ORDER BY n DESC, cluster::VARCHAR) AS place FROM b), x AS (SELECT cluster, row_number() OVER (ORDER BY u, place) AS i FROM (SELECT cluster, place, unnest(range(least(10, n) - m)) AS u FROM g)),
y AS (SELECT cluster, count(*) AS more FROM x CROSS JOIN o WHERE i <= -over GROUP BY 1), a AS (SELECT b.cluster, m - coalesce(less, 0) + coalesce(more, 0) AS m FROM b LEFT JOIN l ON b.cluster = l.cluster LEFT JOIN y ON b.cluster = y.cluster),
r AS (SELECT event_id, cluster, intent, row_number() OVER (PARTITION BY cluster, intent ORDER BY k, event_id) AS i FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 1 ELSE -1 END AS intent FROM e))
SELECT event_id, r.cluster, intent FROM r JOIN a ON r.cluster = a.cluster WHERE i <= CASE WHEN intent = 1 THEN (m + 1) // 2 ELSE m // 2 END""")
def sample_mixed_pool(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("intent", F.when(F.col("row_idx") % 3 == 0, 1).otherwise(-1))
    return S.mixed_pool(e, 40, order=F.col("k")).select(F.col("row_idx").alias("event_id"), "cluster", "intent")


@query("SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY (doc_id * 7919 + 13) % 100003, doc_id) - 1) % 5)::INT AS fold FROM labels")
def kfold_stratified(spark, sf_dir):
    return S.folds(X.table(spark, sf_dir, "labels"), "quality", 5, (F.col("doc_id") * 7919 + 13) % 100003, "doc_id").select("doc_id", "quality", "fold")


@query("SELECT o_orderkey, o_custkey, ((o_custkey * 7919 + 13) % 1000000 < 200000)::INT AS is_test FROM orders")
def group_split(spark, sf_dir):
    return S.group_split(X.table(spark, sf_dir, "orders"), "o_custkey", order=(F.col("o_custkey") * 7919 + 13) % 1000000).select("o_orderkey", "o_custkey", "is_test")


@query("SELECT o_orderkey, o_orderpriority, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY (o_orderkey * 7919 + 13) % 100003, o_orderkey) AS i FROM orders) WHERE i <= 10")
def stratified_records(spark, sf_dir):
    return S.stratified(X.table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], 10, (F.col("o_orderkey") * 7919 + 13) % 100003, "o_orderkey").select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, (l_orderkey * 7919 + 13) % 100003 AS k FROM lineitem), p AS (SELECT DISTINCT l_returnflag, l_linestatus, l_orderkey, k FROM l),
r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM p WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY k, l_orderkey)),
c AS (SELECT l_orderkey, k, max((i <= greatest(1, floor(n * 0.05)))::INT) AS chosen FROM r GROUP BY 1, 2), o AS (SELECT l_orderkey, row_number() OVER (ORDER BY chosen DESC, k, l_orderkey) AS i, count(*) OVER () AS n FROM c)
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM l JOIN o USING (l_orderkey) WHERE i <= floor(n * 0.05)""")
def stratified_share(spark, sf_dir):
    """A twentieth of the orders, by flag and status of their lines, trimmed to the target."""
    li = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return S.stratified_share(li, ["l_returnflag", "l_linestatus"], 0.05, "l_orderkey", (F.col("l_orderkey") * 7919 + 13) % 100003)


@query("SELECT * EXCLUDE (i, own) FROM (SELECT *, row_number() OVER (PARTITION BY toxic = 1 ORDER BY (doc_id * 7919 + 13) % 100003, doc_id) AS i, (SELECT count(*) FROM labels WHERE toxic = 1) AS own FROM labels) WHERE toxic = 1 OR i <= 200 - own")
def validation_sample(spark, sf_dir):
    return S.validation_sample(X.table(spark, sf_dir, "labels"), F.col("toxic") == 1, 200, "doc_id", (F.col("doc_id") * 7919 + 13) % 100003)


@query(f"SELECT doc_id, y_true, 1 AS all_intended, -1 AS all_accident, CASE WHEN (doc_id * 7919 + 13) % 1000 < 300 THEN 1 ELSE -1 END AS biased FROM ({FX_PRED})")
def guess_baselines(spark, sf_dir):
    p = X.predictions(spark, sf_dir).select("doc_id", "y_true")
    p = S.guesses(S.guesses(p, "all_intended").withColumnRenamed("y_pred", "all_intended"), "all_accident").withColumnRenamed("y_pred", "all_accident")
    return p.withColumn("biased", F.when((F.col("doc_id") * 7919 + 13) % 1000 < 300, 1).otherwise(-1))


# encoders, detectors and votes ------------------------------------------------------------

_KEY4 = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"""WITH s AS (SELECT {', '.join(f'quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}, avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _NUM)} FROM lineitem),
h AS (SELECT {_KEY4}, {' + '.join(f'({c} < a_{c} - 1.5 * (b_{c} - a_{c}) OR {c} > b_{c} + 1.5 * (b_{c} - a_{c}))::INT' for c in _NUM)} AS iqr_hits, ({' OR '.join(f'abs({c} - m_{c}) > 3 * s_{c}' for c in _NUM)})::INT AS z_flag FROM lineitem CROSS JOIN s)
SELECT {_KEY4}, iqr_hits, (iqr_hits >= 3)::INT AS iqr_flag, z_flag FROM h""")
def zscore_iqr_flags(spark, sf_dir):
    li = X.table(spark, sf_dir, "lineitem").select(*_KEY4.split(", "), "l_quantity", "l_discount", "l_tax")
    return detect.outlier_flags(li, _NUM).select(*_KEY4.split(", "), "iqr_hits", "iqr_flag", "z_flag")


@query(f"SELECT {_KEY4}, round((l_quantity - lo) / (hi - lo), 6) AS l_quantity FROM lineitem CROSS JOIN (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)")
def minmax_scale(spark, sf_dir):
    li = X.table(spark, sf_dir, "lineitem").select(*_KEY4.split(", "), "l_quantity")
    return encode.Scaler("minmax").fit(li, ["l_quantity"]).transform(li).withColumn("l_quantity", F.round("l_quantity", 6))


@query("SELECT c_custkey, round((c_acctbal - m) / s, 6) AS c_acctbal FROM customer CROSS JOIN (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)")
def standard_scale(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return encode.Scaler("standard").fit(c, ["c_acctbal"]).transform(c).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("SELECT o_orderkey, (o_orderstatus = 'O')::INT AS \"o_orderstatus_O\", (o_orderstatus = 'P')::INT AS \"o_orderstatus_P\" FROM orders")
def onehot_dropfirst(spark, sf_dir):
    return encode.one_hot(X.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query("SELECT p_partkey, p_type, (dense_rank() OVER (ORDER BY p_type) - 1)::INT AS p_type_code FROM part")
def label_encode(spark, sf_dir):
    return encode.label_encode(X.table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type")


_VEC = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"
_NEAR = "{name} AS (SELECT a.id AS q, b.id AS b, {dist} AS d FROM v a CROSS JOIN v b{where})"
_L2 = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
_L1 = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))"


def vectors(spark, sf_dir) -> DataFrame:
    return X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


@query(f"WITH {_VEC}, {_NEAR.format(name='n', dist=_L2, where='')} SELECT q, b, round(d, 5) AS d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, b) AS i FROM n) WHERE i <= 5")
def knn_self(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return detect.neighbours(v, v, 5).select("q", "b", F.round("d", 5).alias("d"))


_PAIR_L1 = _NEAR.format(name="n", dist=_L1, where=" WHERE a.id <> b.id")


def _lof(k: int) -> str:
    return f"""k{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, b) AS i FROM n) WHERE i <= {k}), r{k} AS (SELECT q, max(d) AS kd FROM k{k} GROUP BY 1),
l{k} AS (SELECT k.q, 1 / (avg(greatest(k.d, r.kd)) + 1e-10) AS lrd FROM k{k} k JOIN r{k} r ON k.b = r.q GROUP BY 1),
f{k} AS (SELECT k.q AS id, avg(b.lrd) / any_value(a.lrd) AS lof FROM k{k} k JOIN l{k} b ON k.b = b.q JOIN l{k} a ON k.q = a.q GROUP BY k.q)"""


@query(f"WITH {_VEC}, {_PAIR_L1}, {_lof(20)} SELECT id, round(lof, 5) AS lof FROM f20")
def lof_scores(spark, sf_dir):
    return detect.local_outlier_factor(vectors(spark, sf_dir), 20).select("id", F.round("lof", 5).alias("lof"))


@query(f"""WITH {_VEC}, {_PAIR_L1}, {_lof(10)}, {_lof(20)}, {_lof(30)}, a AS (SELECT *, (lof > (SELECT quantile_cont(lof, 0.95) FROM f10))::INT AS f FROM f10 UNION ALL SELECT *, (lof > (SELECT quantile_cont(lof, 0.95) FROM f20))::INT FROM f20
UNION ALL SELECT *, (lof > (SELECT quantile_cont(lof, 0.95) FROM f30))::INT FROM f30) SELECT id, round(avg(lof), 5) AS lof_mean, sum(f)::INT AS votes, (2 * sum(f) > 3)::INT AS is_outlier FROM a GROUP BY id""")
def multi_k_lof(spark, sf_dir):
    return detect.multi_k_lof(vectors(spark, sf_dir), [10, 20, 30]).select("id", F.round("lof_mean", 5).alias("lof_mean"), "votes", "is_outlier")


_FLAGS3 = "f AS (SELECT event_id, (value > 20)::INT AS a, (event_id % 9 = 0)::INT AS b, (event_type = 'error')::INT AS c FROM events)"


@query(f"WITH {_FLAGS3} SELECT event_id, a + b + c AS vote_count, round((2 * a + b + c) / 4.0, 6)::DOUBLE AS confidence, (2 * a + b + c >= 2)::INT AS is_suspicious FROM f")
def vote_weighted(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select("event_id", (F.col("value") > 20).cast("int").alias("a"), (F.col("event_id") % 9 == 0).cast("int").alias("b"), (F.col("event_type") == "error").cast("int").alias("c"))
    return detect.weighted_vote(e, {"a": 2.0, "b": 1.0, "c": 1.0}).select("event_id", "vote_count", *r6("confidence"), "is_suspicious")


@query("SELECT user_id, votes, (votes >= 3)::INT AS is_suspicious FROM (SELECT user_id, sum(((user_id * 31 + s * 17) % 3 = 0)::INT)::BIGINT AS votes FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT unnest(range(5)) AS s) GROUP BY 1)")
def vote_multi_seed(spark, sf_dir):
    u = X.table(spark, sf_dir, "events").select("user_id").distinct().withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return detect.seed_vote(u.withColumn("f", ((F.col("user_id") * 31 + F.col("s") * 17) % 3 == 0).cast("int")), "user_id", "f", 5)


@query("SELECT event_type, (CASE WHEN 2 * count(*) FILTER (user_id % 2 = 0) >= count(*) THEN 1 ELSE -1 END)::INT AS majority, count(*) AS n, round(greatest(count(*) FILTER (user_id % 2 = 0), count(*) FILTER (user_id % 2 <> 0)) / count(*)::DOUBLE, 6) AS purity FROM events GROUP BY 1")
def cluster_majority(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1).alias("intent"))
    return cluster.cluster_majority(e, "event_type").select("event_type", "majority", "n", *r6("purity"))


# answers of a language model -----------------------------------------------------------------


@query("SELECT event_id AS row_id, event_type AS \"column\", (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END)::INT AS decision FROM events WHERE event_id % 7 <> 0")
def llm_parse_decisions(spark, sf_dir):
    return D.decisions(X.answers(spark, sf_dir))


@query("SELECT event_id AS row_id, event_type AS \"column\", (CASE WHEN event_id % 7 = 0 THEN -1 WHEN event_id % 2 = 0 THEN 1 ELSE -1 END)::INT AS decision FROM events")
def llm_default_decisions(spark, sf_dir):
    keys = X.table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.col("event_type").alias("column"))
    return D.with_defaults(keys, D.decisions(X.answers(spark, sf_dir)), ["row_id", "column"])


_RECORD = "'{\"row_id\":' || event_id || ',\"changed\":[{\"column\":\"event_type\",\"value\":\"' || event_type || '\"}]}'"


@query(f"SELECT (event_id // 7)::BIGINT AS chunk_no, '[' || string_agg({_RECORD}, ',' ORDER BY event_id) || ']' AS payload FROM events GROUP BY 1")
def llm_prompt_payload(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select(F.col("event_id").alias("row_idx"), F.lit("event_type").alias("col_name"), F.col("event_type").alias("value"))
    return D.prompt_payload(e)


@query("SELECT DISTINCT (event_id // 7)::BIGINT AS chunk_no FROM events WHERE (event_id // 7) % 3 <> 0")
def llm_resume(spark, sf_dir):
    chunks = X.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 7).alias("chunk_no")).distinct()
    done = chunks.select("chunk_no", F.when(F.col("chunk_no") % 3 == 0, "{}").when(F.col("chunk_no") % 3 == 1, "").alias("raw"))
    return D.pending(chunks, done)


@query("""SELECT event_id, (CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN 1 WHEN 3 THEN -1 WHEN 4 THEN 1 END)::DOUBLE AS decision FROM events""")
def llm_single_decision(spark, sf_dir):
    k = F.col("event_id") % 6
    raw = F.when(k == 0, "1").when(k == 1, '{"decision": -1}').when(k == 2, '<think>is it -1?</think>```json {"intent": 1}```').when(k == 3, '{"0": "-1"}').when(k == 4, '[1, -1]').otherwise("no idea")
    return X.table(spark, sf_dir, "events").select("event_id", D.single_decision(raw).cast("double").alias("decision"))


# values and names ------------------------------------------------------------------------------


@query("""SELECT p_partkey, least(levenshtein(p_name, p_type), 10)::INT AS capped, levenshtein(p_name, p_type)::INT AS distance, round(levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))::DOUBLE, 6) AS share,
  regexp_matches(p_brand, '\\d') AS digits, regexp_matches(p_brand, '[^\\w\\s\\-.]') AS special, substring(p_name, 1, 4) AS prefix FROM part""")
def text_functions(spark, sf_dir):
    return X.table(spark, sf_dir, "part").select(
        "p_partkey", T.edit_distance_capped("p_name", "p_type").alias("capped"), T.edit_distance("p_name", "p_type").alias("distance"), F.round(T.edit_share("p_name", "p_type"), 6).alias("share"), T.has_digit("p_brand").alias("digits"), T.has_special("p_brand").alias("special"), T.prefix_key("p_name").alias("prefix")
    )
