"""Queries of summaries, answers, labels and small table operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellsight.functions import decisions as D
from cellsight.functions import numbers as N
from cellsight.operators import cells as C
from cellsight.operators import encode, records, rules
from cellsight.operators import ensemble as E
from cellsight.operators import heuristics as H
from cellsight.operators import metrics as M
from cellsight.operators import reference_values as R
from cellsight.operators import suspicion as SU
from cellsight.plans import fixtures as X
from cellsight.plans.fixtures import CELLS, FX_FLAGS, FX_ORDERS, FX_PRED, ORDER_COLUMNS, ORDER_MASKS
from cellsight.plans.queries_attribution import ORACLES as ATTRIBUTION
from cellsight.plans.queries_attribution import RULES, order_cells, r6
from cellsight.plans.queries_tables import ORACLES as TABLES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def group_summary(spark, sf_dir):
    return M.group_summary(X.table(spark, sf_dir, "events"), "event_type", "value").select("event_type", "n", *r6("mean", "median", "std"))


@query(f"SELECT y_true, round(avg((y_true IS NOT DISTINCT FROM y_pred)::INT), 6) AS hit_rate, count(*) AS n FROM ({FX_PRED}) GROUP BY 1")
def hit_rate(spark, sf_dir):
    return M.hit_rate(X.predictions(spark, sf_dir), "y_true", "y_pred", "y_true").select("y_true", *r6("hit_rate"), "n")


@query("SELECT user_id % 10 AS run_group, round(avg(value), 6) AS mean, round(coalesce(stddev_pop(value), 0), 6) AS std FROM events GROUP BY 1")
def mean_std_over_runs(spark, sf_dir):
    return M.mean_std(X.table(spark, sf_dir, "events").withColumn("run_group", F.col("user_id") % 10), ["run_group"], "value").select("run_group", *r6("mean", "std"))


@query(f"SELECT count(*) FILTER (y_pred = y_true) AS hit, count(*) AS n, round(count(*) FILTER (y_pred = y_true) / count(*)::DOUBLE, 6) AS recall, round(2 * count(*) FILTER (y_pred = y_true) / (count(*) + count(*) FILTER (y_pred = y_true))::DOUBLE, 6) AS f1 FROM ({FX_PRED}) WHERE y_true = 1")
def single_class(spark, sf_dir):
    return M.single_class(X.predictions(spark, sf_dir).where("y_true = 1")).select("hit", "n", *r6("recall", "f1"))


@query("SELECT CASE WHEN event_id % 7 = 0 THEN 'unanswered' ELSE 'answered' END AS status, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark, sf_dir):
    asked = X.answers(spark, sf_dir)
    found = D.decisions(asked, keep=("event_id",)).select("event_id", F.lit("answered").alias("found"))
    return D.status_counts(asked.join(found, "event_id", "left").withColumn("status", F.coalesce("found", F.lit("unanswered"))))


@query(" UNION ALL ".join(f"SELECT '{r.id}' AS rule, count(*) FILTER (\"signal_{r.id}\" <> 0) AS n_fired FROM s" for r in RULES).join((f"WITH s AS ({ATTRIBUTION['rule_signals']}) ", "")))
def rule_coverage(spark, sf_dir):
    return rules.coverage(rules.signals(X.orders(spark, sf_dir), RULES, ORDER_MASKS, columns=ORDER_COLUMNS), RULES)


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '1,-1,null' WHEN 1 THEN '-1,null,1' WHEN 2 THEN '1,1,-1' END AS decisions FROM events")
def triplet_decisions(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select("event_id")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, 'Here: [{"decision": 1}, {"intent": "-1"}, {"label": "maybe"}]').when(k == 1, "```json\n[-1, 5, 1]\n```").when(k == 2, '{"0": 1, "1": "1", "2": -1}').otherwise("no answer")
    found = D.triplet_decisions(raw)
    return e.select("event_id", F.array_join(F.transform(found, lambda d: d.cast("string")), ",", "null").alias("decisions"))


@query("SELECT event_id, 'g1' AS \"group\", (event_id % 10)::VARCHAR AS row, c AS \"column\", CASE WHEN c = 'a' THEN (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) ELSE -1 END AS decision FROM events CROSS JOIN (SELECT unnest(['a', 'b']) AS c) WHERE event_id % 3 <> 0")
def nested_decisions(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select("event_id")
    body = F.concat(F.lit('{"g1": {"'), (F.col("event_id") % 10).cast("string"), F.lit('": {"a": '), F.when(F.col("event_id") % 2 == 0, "1").otherwise('"-1"'), F.lit(', "unknown": 1}}}'))
    return D.nested_decisions(e.withColumn("raw", F.when(F.col("event_id") % 3 == 0, "sorry").otherwise(body)), "raw", ["a", "b"], ("event_id",))


@query("SELECT event_id, (CASE WHEN event_id % 5 = 0 OR event_id % 10 >= 5 THEN 1 ELSE 0 END)::INT AS y_pred, (CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE (event_id % 10) / 10.0 END)::DOUBLE AS suspicion FROM events")
def suspicion_mask(spark, sf_dir):
    k = F.col("event_id")
    return D.suspicion_mask(X.table(spark, sf_dir, "events").select(k, F.when(k % 5 != 0, (k % 10) / 10.0).alias("suspicion"))).select("event_id", "y_pred", "suspicion")


_HOLES = "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer"


@query(f"""WITH h AS ({_HOLES}), m AS (SELECT c_mktsegment AS top FROM h WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT c_custkey, round(coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM h)), 6) AS c_acctbal, coalesce(c_mktsegment, top) AS c_mktsegment FROM h CROSS JOIN m""")
def impute_median_mode(spark, sf_dir):
    k = F.col("c_custkey")
    holes = X.table(spark, sf_dir, "customer").select(k, F.when(k % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(k % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return encode.impute(holes, ["c_acctbal"], ["c_mktsegment"]).select("c_custkey", *r6("c_acctbal"), "c_mktsegment")


@query(f"""WITH f AS (SELECT row_idx, sum((cell_value = 1)::INT) AS a, sum((cell_value = -1)::INT) AS b FROM ({FX_FLAGS}) GROUP BY 1)
SELECT row_idx, (CASE WHEN a >= b THEN 1 ELSE -1 END)::INT AS majority_intent, (CASE WHEN a > 0 THEN 1 ELSE -1 END)::INT AS any_intent, (a + b)::BIGINT AS n_cells FROM f WHERE a + b > 0""")
def record_labels(spark, sf_dir):
    return records.record_labels(X.flags(spark, sf_dir), "cell_value")


@query(f"SELECT row_idx, col_name, value FROM (SELECT * FROM ({FX_FLAGS.replace('event_type AS col_name', 'event_type AS col_name, value')})) WHERE row_idx < 100")
def first_records(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    return records.first_records(e.select((F.col("event_id") % 2000).alias("row_idx"), F.col("event_type").alias("col_name"), "value"), 100)


@query("SELECT event_id, CASE WHEN event_type = 'click' OR event_type LIKE 'p%' THEN 'A' ELSE 'B' END AS kind FROM events")
def error_kinds(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select("event_id", C.error_kind(F.col("event_type"), ("click",), ("p",)).alias("kind"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE 1 END::INT AS mask, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END::INT AS blind FROM customer")
def mask_coerce(spark, sf_dir):
    k = F.col("c_custkey") % 3
    m = N.mask_value(F.when(k == 0, "junk").when(k == 1, "-1.0").otherwise("1"))
    return X.table(spark, sf_dir, "customer").select("c_custkey", m.alias("mask"), C.blind(m).alias("blind"))


@query(f"SELECT row_idx, 'o_totalprice' AS col_name, sign(n - o)::DOUBLE AS direction_oracle, round(abs(n - o), 6)::DOUBLE AS magnitude_oracle, round(abs(n - o) / greatest(abs(o), 1e-6), 6)::DOUBLE AS relative_oracle, sign(n - 150000)::DOUBLE AS direction_imputed, round(abs(n - 150000), 6)::DOUBLE AS magnitude_imputed, round(abs(n - 150000) / 150000, 6)::DOUBLE AS relative_imputed FROM (SELECT row_idx, f.o_totalprice::DOUBLE AS n, o.o_totalprice::DOUBLE AS o FROM ({FX_ORDERS}) f JOIN orders o ON row_idx = o_orderkey WHERE m_t <> 0)")
def oracle_vs_imputed(spark, sf_dir):
    dirty = X.orders(spark, sf_dir).where("m_t <> 0").select("row_idx", F.lit("o_totalprice").alias("col_name"), F.col("o_totalprice").cast("double").alias("new"))
    pairs = dirty.join(X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_idx"), F.col("o_totalprice").cast("double").alias("old")), "row_idx").withColumn("imputed", F.lit(150000.0))
    both = R.reference_features(pairs).join(R.reference_features(pairs, "imputed", suffix="_imputed"), ["row_idx", "col_name"])
    return both.select("row_idx", "col_name", *[f(c) for s in ("oracle", "imputed") for c, f in ((f"direction_{s}", F.col), (f"magnitude_{s}", lambda c: F.round(c, 6).alias(c)), (f"relative_{s}", lambda c: F.round(c, 6).alias(c)))])


@query(f"SELECT * FROM ({TABLES['threshold_sweep']}) ORDER BY f1 DESC, threshold LIMIT 1".join(("SELECT threshold, f1 FROM (", ")")))
def best_threshold(spark, sf_dir):
    t = spark.range(21).select((F.col("id") * 500.0).alias("threshold"))
    return M.best_threshold(M.threshold_sweep(X.predictions(spark, sf_dir), t)).select("threshold", *r6("f1"))


@query(f"WITH {CELLS} SELECT row_idx, col_name, 0.0::DOUBLE AS h1_plausible, -999.0::DOUBLE AS h2_min_edit_distance FROM cells WHERE mask <> 0")
def missing_columns(spark, sf_dir):
    """Feature columns that a table lacks are 0; nulls take the fill value."""
    flagged = C.errors(order_cells(spark, sf_dir)).select("row_idx", "col_name", F.lit(None).cast("double").alias("h2_min_edit_distance"))
    return H.complete(flagged, ["h1_plausible", "h2_min_edit_distance"], -999.0)


_CUSTOMERS = "SELECT c_custkey AS row_idx, CASE WHEN c_custkey * 7 % 11 = 0 THEN c_acctbal * 3 + 1000 ELSE c_acctbal END AS balance, c_nationkey::DOUBLE AS nation, (c_custkey * 7 % 11 = 0)::INT AS mask FROM customer"
_SIGMOID = "1 / (1 + exp(-({})))"
_SURE = "(least(1.0, abs({b} - 4500) / 10000) * 0.8 + {n} / 25 * 0.2)"
_DROP_B, _DROP_N = (f"greatest(0.0, {_SURE.format(b='balance', n='nation')} - {_SURE.format(b=b, n=n)})" for b, n in ((4500.0, "nation"), ("balance", 12.0)))


@query(f"""WITH t AS ({_CUSTOMERS}), c AS (SELECT * FROM t WHERE mask = 0), s AS (SELECT avg(balance) AS mb, stddev_samp(balance) AS sb, avg(nation) AS mn, stddev_samp(nation) AS sn FROM c), e AS (SELECT * FROM t CROSS JOIN s WHERE mask <> 0),
p AS (SELECT e.row_idx AS q, c.balance, c.nation, row_number() OVER (PARTITION BY e.row_idx ORDER BY sqrt(pow((e.balance - mb) / sb - (c.balance - mb) / sb, 2) + pow((e.nation - mn) / sn - (c.nation - mn) / sn, 2)), c.row_idx) AS i FROM e CROSS JOIN c),
l AS (SELECT q, avg(balance) AS lb, stddev_pop(balance) AS vb, avg(nation) AS ln, stddev_pop(nation) AS vn FROM p WHERE i <= 10 GROUP BY q),
d AS (SELECT *, {_DROP_B} AS db, {_DROP_N} AS dn FROM e JOIN l ON e.row_idx = q),
u AS (SELECT row_idx, 'balance' AS col_name, coalesce({_SIGMOID.format("abs(balance - lb) / nullif(vb, 0) - 2")}, 0) AS local, coalesce(db / nullif(greatest(db, dn), 0), 0) AS counterfactual, {_SIGMOID.format("abs(balance - mb) / sb - 3")} AS deviation FROM d
  UNION ALL SELECT row_idx, 'nation', coalesce({_SIGMOID.format("abs(nation - ln) / nullif(vn, 0) - 2")}, 0), coalesce(dn / nullif(greatest(db, dn), 0), 0), {_SIGMOID.format("abs(nation - mn) / sn - 3")} FROM d)
SELECT row_idx, col_name, round(local, 5) AS local, round(counterfactual, 5) AS counterfactual, round(0.35 * counterfactual + 0.3 * local + 0.15 * deviation, 5) AS suspicion FROM u""")
def suspicion_weighted(spark, sf_dir):
    """Neighbourhood, counterfactual and deviation of changed customers; nothing plays the validator."""
    k = F.col("c_custkey") * 7 % 11 == 0
    t = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_idx"), F.when(k, F.col("c_acctbal") * 3 + 1000).otherwise(F.col("c_acctbal")).alias("balance"), F.col("c_nationkey").cast("double").alias("nation"), k.cast("int").alias("mask"))
    columns, dirty, clean = ["balance", "nation"], t.where("mask <> 0"), t.where("mask = 0")
    sure = lambda c: F.least(F.lit(1.0), F.abs(c["balance"] - 4500) / 10000) * 0.8 + c["nation"] / 25 * 0.2
    cells = C.unpivot(t, columns, masks=dict.fromkeys(columns, "mask"))
    deviation = SU.deviation_scores(cells).join(C.errors(cells).select("row_idx", "col_name"), ["row_idx", "col_name"])
    local, counter = SU.local_scores(dirty, clean, columns), SU.counterfactual_scores(dirty, columns, {"balance": 4500.0, "nation": 12.0}, sure)
    whole = SU.combine({"counterfactual": counter, "local": local, "deviation": deviation})
    both = whole.join(local, ["row_idx", "col_name"]).join(counter, ["row_idx", "col_name"])
    return both.select("row_idx", "col_name", *[F.round(c, 5).alias(c) for c in ("local", "counterfactual", "suspicion")])


_FLAGS = "(({b} - vb) / ub > 2 OR (vb - {b}) / ub > 2 OR ({n} - vn) / un > 2 OR (vn - {n}) / un > 2)::INT + ({b} < b1 - 1.5 * (b3 - b1) OR {b} > b3 + 1.5 * (b3 - b1) OR {n} < n1 - 1.5 * (n3 - n1) OR {n} > n3 + 1.5 * (n3 - n1))::INT + ({m} > cut)::INT"
_MAHA = "((({b} - vb) * ({b} - vb) * (cn + 1e-6) - 2 * ({b} - vb) * ({n} - vn) * cbn + ({n} - vn) * ({n} - vn) * (cb + 1e-6)) / ((cb + 1e-6) * (cn + 1e-6) - cbn * cbn))"


def _confidence_sql(b: str, n: str) -> str:
    return f"(({_FLAGS.format(b=b, n=n, m=_MAHA.format(b=b, n=n))}) / 3.0)"


@query(f"""WITH t AS ({_CUSTOMERS}), c AS (SELECT * FROM t WHERE mask = 0),
s AS (SELECT avg(balance) AS mb, stddev_samp(balance) AS sb, avg(nation) AS mn, stddev_samp(nation) AS sn, quantile_cont(balance, 0.5) AS tb, quantile_cont(nation, 0.5) AS tn FROM c),
a AS (SELECT avg(balance) AS vb, stddev_pop(balance) AS ub, avg(nation) AS vn, stddev_pop(nation) AS un, var_pop(balance) AS cb, var_pop(nation) AS cn, covar_pop(balance, nation) AS cbn, quantile_cont(balance, 0.25) AS b1, quantile_cont(balance, 0.75) AS b3, quantile_cont(nation, 0.25) AS n1, quantile_cont(nation, 0.75) AS n3 FROM t),
g AS (SELECT quantile_cont({_MAHA.format(b="balance", n="nation")}, 0.99) AS cut FROM t CROSS JOIN a), e AS (SELECT * FROM t CROSS JOIN s CROSS JOIN a CROSS JOIN g WHERE mask <> 0),
p AS (SELECT e.row_idx AS q, c.balance, c.nation, row_number() OVER (PARTITION BY e.row_idx ORDER BY sqrt(pow((e.balance - mb) / sb - (c.balance - mb) / sb, 2) + pow((e.nation - mn) / sn - (c.nation - mn) / sn, 2)), c.row_idx) AS i FROM e CROSS JOIN c),
l AS (SELECT q, avg(balance) AS lb, stddev_pop(balance) AS wb, avg(nation) AS ln, stddev_pop(nation) AS wn FROM p WHERE i <= 10 GROUP BY q),
d AS (SELECT *, greatest(0.0, {_confidence_sql("balance", "nation")} - {_confidence_sql("tb", "nation")}) AS db, greatest(0.0, {_confidence_sql("balance", "nation")} - {_confidence_sql("balance", "tn")}) AS dn FROM e JOIN l ON e.row_idx = q),
u AS (SELECT row_idx, 'balance' AS col_name, coalesce({_SIGMOID.format("abs(balance - lb) / nullif(wb, 0) - 2")}, 0) AS local, coalesce(db / nullif(greatest(db, dn), 0), 0) AS counterfactual, {_SIGMOID.format("abs(balance - mb) / sb - 3")} AS deviation FROM d
  UNION ALL SELECT row_idx, 'nation', coalesce({_SIGMOID.format("abs(nation - ln) / nullif(wn, 0) - 2")}, 0), coalesce(dn / nullif(greatest(db, dn), 0), 0), {_SIGMOID.format("abs(nation - mn) / sn - 3")} FROM d)
SELECT row_idx, col_name, round(counterfactual, 5) AS counterfactual, round(local, 5) AS local, round(deviation, 5) AS deviation, round(0.35 * counterfactual + 0.3 * local + 0.15 * deviation, 5) AS suspicion FROM u""")
def suspicion_ensemble(spark, sf_dir):
    """The attributor's scores against the vote of detectors fitted on the whole table."""
    k = F.col("c_custkey") * 7 % 11 == 0
    balance = F.col("c_acctbal").cast("double")
    t = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_idx"), F.when(k, balance * 3 + 1000).otherwise(balance).alias("balance"), F.col("c_nationkey").cast("double").alias("nation"), k.cast("int").alias("mask"))
    columns = ["balance", "nation"]
    model = E.EnsembleDetector([E.ZDetector(columns, 2.0), E.FenceDetector(columns, 1), E.MahalanobisDetector(columns)]).fit(t)
    out = E.attribute(model, t.where("mask <> 0"), t.where("mask = 0"), C.unpivot(t, columns, masks=dict.fromkeys(columns, "mask")), columns)
    return out.select("row_idx", "col_name", *[F.round(c, 5).alias(c) for c in ("counterfactual", "local", "deviation", "suspicion")])
