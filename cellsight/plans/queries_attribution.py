"""Queries of the attribution operators on the orders and line item fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.functions import numbers as N
from cellsight.operators import cells as C
from cellsight.operators import detect, fingerprint, records, rules
from cellsight.operators import heuristics as H
from cellsight.operators import reference_values as R
from cellsight.operators import suspicion
from cellsight.operators.alignment import align
from cellsight.plans import fixtures as X
from cellsight.plans.fixtures import CELLS, FX_LINEITEM, FX_ORDERS, ORDER_COLUMNS, ORDER_MASKS

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


def with_nulls(df: DataFrame, *names: str) -> DataFrame:
    """Columns that hold nulls as doubles: a table of another engine may not have integers with nulls."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def order_cells(spark, sf_dir) -> DataFrame:
    return C.unpivot(X.orders(spark, sf_dir), ORDER_COLUMNS, masks=ORDER_MASKS)


STATS = """stats AS (SELECT quantile_cont(x, 0.05) AS p5, quantile_cont(x, 0.95) AS p95, avg(x) AS m, stddev_pop(x) AS sd FROM cells WHERE mask = 0 AND x IS NOT NULL)"""


@query(f"WITH {CELLS} SELECT row_idx, col_name, value, mask, (mask <> 0)::INT AS is_flagged FROM cells WHERE col_name <> 'o_totalprice'")
def unpivot_cells(spark, sf_dir):
    cells = C.unpivot(X.orders(spark, sf_dir), ORDER_COLUMNS[:2], masks=ORDER_MASKS)
    return cells.withColumn("is_flagged", C.blind(F.col("mask")))


@query(f"""WITH {CELLS} SELECT col_name, count(coalesce(value, x::VARCHAR)) AS n_values, count(coalesce(x, try_cast(value AS DOUBLE))) AS n_numeric,
  CASE WHEN count(coalesce(x, try_cast(value AS DOUBLE))) > 0.9 * count(coalesce(value, x::VARCHAR)) THEN 'num' ELSE 'cat' END AS col_type FROM cells GROUP BY col_name""")
def detect_types(spark, sf_dir):
    return C.detect_types(order_cells(spark, sf_dir))


@query(f"""WITH {CELLS} SELECT row_idx, sum((mask <> 0)::INT)::BIGINT AS n_errors, (sum((mask <> 0)::INT) > 0)::INT AS is_erroneous FROM cells GROUP BY row_idx""")
def is_erroneous(spark, sf_dir):
    return C.row_errors(order_cells(spark, sf_dir))


@query(f"""WITH {CELLS}, r AS (SELECT row_idx, sum((mask <> 0)::INT)::BIGINT AS n_errors FROM cells GROUP BY row_idx) SELECT n_errors, count(*) AS n_rows FROM r GROUP BY n_errors""")
def error_hist(spark, sf_dir):
    return C.error_histogram(order_cells(spark, sf_dir))


@query(f"""WITH {CELLS}, {STATS}, v AS (SELECT DISTINCT col_name, value FROM cells WHERE mask = 0 AND value IS NOT NULL AND lower(trim(value)) NOT IN ('nan', 'none', ''))
SELECT row_idx, c.col_name, CASE WHEN x IS NOT NULL THEN (x BETWEEN p5 AND p95)::INT ELSE (v.value IS NOT NULL)::INT END AS h1_plausible,
  CASE WHEN x IS NULL THEN (v.value IS NOT NULL)::INT END::DOUBLE AS h1_in_vocab, CASE WHEN x IS NOT NULL THEN (x BETWEEN p5 AND p95)::INT END::DOUBLE AS h1_in_range
FROM cells c CROSS JOIN stats LEFT JOIN v ON c.col_name = v.col_name AND c.value = v.value WHERE mask <> 0""")
def h1_plausibility(spark, sf_dir):
    return with_nulls(H.h1_plausibility(order_cells(spark, sf_dir)), "h1_in_vocab", "h1_in_range")


_H2 = f"""WITH {CELLS}, v AS (SELECT col_name, value AS entry, count(*) AS n, min(row_idx) AS f FROM cells WHERE mask = 0 AND value IS NOT NULL AND value <> '' GROUP BY 1, 2),
e AS (SELECT col_name, entry FROM (SELECT *, count(*) OVER (PARTITION BY col_name) AS s, row_number() OVER (PARTITION BY col_name ORDER BY n DESC, f) AS k FROM v) WHERE s <= 200 OR k <= 50),
q AS (SELECT DISTINCT col_name, value FROM cells WHERE mask <> 0 AND col_name <> 'o_totalprice'),
d AS (SELECT q.col_name, q.value, min(least(levenshtein(q.value, entry), 10)) AS d,
  bool_or(q.value <> entry AND starts_with(lower(q.value), lower(entry)) AND substring(q.value, length(entry) + 1, 1) IN ('-', '_', ' ')
    AND lower(substring(q.value, length(entry) + 2)) IN ('dmv', 'obf', 'high', 'low', '1', '2', 'x', '?', '—')) AS s FROM q JOIN e USING (col_name) GROUP BY 1, 2)"""


@query(f"{_H2} SELECT row_idx, col_name, d::INT AS h2_min_edit_distance FROM cells JOIN d USING (col_name, value) WHERE mask <> 0")
def h2_edit_distance(spark, sf_dir):
    return H.h2_string_anomaly(order_cells(spark, sf_dir)).drop("h2_is_obfuscation")


@query(f"""{_H2} SELECT row_idx, col_name, (lower(trim(value)) IN ('nan', 'none', 'n/a', 'na', 'unknown', 'unk', '?', '—', '-', '--', 'null', 'nil', 'missing', 'not available', 'not applicable', '0', '-1', '999', '9999', '99999')
  OR s OR length(trim(value)) = 1 OR NOT regexp_matches(value, '[\\p{{L}}\\p{{N}}]'))::INT AS h2_is_obfuscation FROM cells JOIN d USING (col_name, value) WHERE mask <> 0""")
def h2_obfuscation(spark, sf_dir):
    return H.h2_string_anomaly(order_cells(spark, sf_dir)).drop("h2_min_edit_distance")


@query(f"""WITH {CELLS}, {STATS}, f AS (SELECT col_name, value, count(*) AS n FROM cells WHERE mask = 0 AND value IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY col_name ORDER BY n DESC, value) AS rk FROM f), s AS (SELECT col_name, count(*) AS v FROM f GROUP BY 1)
SELECT row_idx, c.col_name, round(CASE WHEN x IS NOT NULL THEN greatest(0.0, 1 - least(1.0, abs((x - m) / sd) / 3.0)) ELSE greatest(0.0, 1 - (coalesce(rk, v + 1) - 1) / greatest(1, v)::DOUBLE) END, 6)::DOUBLE AS h3_distribution_score
FROM cells c CROSS JOIN stats LEFT JOIN k ON c.col_name = k.col_name AND c.value = k.value LEFT JOIN s ON c.col_name = s.col_name WHERE mask <> 0""")
def h3_distribution(spark, sf_dir):
    return H.h3_distribution(order_cells(spark, sf_dir)).select("row_idx", "col_name", *r6("h3_distribution_score"))


#: The name rule finds no pair here; price and priority are given.
PAIRS = {("o_orderpriority", "o_totalprice")}


@query(f"""WITH {CELLS}, e AS (SELECT row_idx, col_name FROM cells WHERE mask <> 0)
SELECT row_idx, col_name, (count(*) OVER (PARTITION BY row_idx))::INT AS h5_error_count,
  (CASE col_name WHEN 'o_orderpriority' THEN max((col_name = 'o_totalprice')::INT) OVER (PARTITION BY row_idx) WHEN 'o_totalprice' THEN max((col_name = 'o_orderpriority')::INT) OVER (PARTITION BY row_idx) ELSE 0 END)::INT AS h5_codependent_flag FROM e""")
def h5_error_pattern(spark, sf_dir):
    return H.h5_error_pattern(order_cells(spark, sf_dir), H.codependent_pairs(ORDER_COLUMNS, PAIRS))


@query(f"""WITH f AS ({FX_ORDERS}), k AS (SELECT * FROM f WHERE m_p = 0 AND m_s = 0 AND m_t = 0),
p AS (SELECT 'o_orderpriority' AS a, 'o_orderstatus' AS b, o_orderpriority AS x, o_orderstatus AS y FROM k UNION ALL SELECT 'o_orderpriority', 'o_totalprice', o_orderpriority, o_totalprice::VARCHAR FROM k
  UNION ALL SELECT 'o_orderstatus', 'o_totalprice', o_orderstatus, o_totalprice::VARCHAR FROM k),
t AS (SELECT a, b, count(*) AS t FROM p GROUP BY 1, 2), j AS (SELECT a, b, x, y, count(*) AS n FROM p GROUP BY 1, 2, 3, 4), c AS (SELECT a, b, x, count(*) AS nx FROM p GROUP BY 1, 2, 3), d AS (SELECT a, b, y, count(*) AS ny FROM p GROUP BY 1, 2, 3)
SELECT a, b, round(sum(n / t::DOUBLE * ln(n * t / (nx * ny)::DOUBLE)), 6) AS mi FROM j JOIN c USING (a, b, x) JOIN d USING (a, b, y) JOIN t USING (a, b) GROUP BY a, b""")
def h5_mi_pairs(spark, sf_dir):
    return H.mutual_information_pairs(order_cells(spark, sf_dir), ORDER_COLUMNS).select("a", "b", *r6("mi"))


_CLEAN = f"f AS ({FX_ORDERS}), c AS (SELECT *, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::DOUBLE AS y FROM f WHERE m_p = 0 AND m_s = 0 AND m_t = 0)"


def _gain_pairs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    cells = order_cells(spark, sf_dir)
    return cells, H.h7_incentive(cells, "o_orderstatus", C.detect_types(cells))


@query(f"""WITH {_CLEAN}, r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM c),
g AS (SELECT round(0.5 + 0.5 * corr(rx, ry), 6) AS g FROM r) SELECT o_orderkey AS row_idx, g AS h7_gain_direction FROM (SELECT row_idx AS o_orderkey FROM f WHERE m_t <> 0) CROSS JOIN g""")
def h7_gain_numeric(spark, sf_dir):
    return _gain_pairs(spark, sf_dir)[1].where("col_name = 'o_totalprice'").select("row_idx", *r6("h7_gain_direction"))


@query(f"""WITH {_CLEAN}, a AS (SELECT o_orderpriority AS v, avg(y) AS m FROM c GROUP BY 1), k AS (SELECT v, (row_number() OVER (ORDER BY m DESC, v) <= greatest(1, count(*) OVER () // 2))::INT::DOUBLE AS g FROM a)
SELECT row_idx, coalesce(g, 0.5) AS h7_gain_direction FROM f LEFT JOIN k ON o_orderpriority = v WHERE m_p <> 0""")
def h7_gain_categorical(spark, sf_dir):
    return _gain_pairs(spark, sf_dir)[1].where("col_name = 'o_orderpriority'").select("row_idx", "h7_gain_direction")


@query(f"""WITH {CELLS}, m AS (SELECT value AS top FROM cells WHERE mask = 0 AND col_name = 'o_orderstatus' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT row_idx, col_name, (col_name IN ('o_orderstatus', 'o_totalprice'))::INT AS h8_is_sensitive, (col_name = 'o_orderstatus' AND value = top)::INT AS h8_is_majority_value FROM cells CROSS JOIN m WHERE mask <> 0""")
def h8_sensitivity(spark, sf_dir):
    return H.h8_sensitivity(order_cells(spark, sf_dir), ["o_orderstatus", "o_totalprice"])


_ALL = f"""WITH {CELLS}, s AS (SELECT avg(x) AS m, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi FROM cells WHERE x IS NOT NULL),
q AS (SELECT col_name, lower(trim(value)) AS k, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, n / (sum(n) OVER (PARTITION BY col_name))::DOUBLE AS share, row_number() OVER (PARTITION BY col_name ORDER BY n DESC, k) - 1 AS rk, count(*) OVER (PARTITION BY col_name) AS u FROM q)"""


@query(f"""{_ALL} SELECT row_idx, c.col_name, round((x - m) / sd, 6) AS dist_z_score, round(abs((x - m) / sd), 6) AS dist_abs_z, round((x - lo) / (hi - lo), 6) AS dist_percentile_approx, round(share, 6) AS dist_value_freq,
  (rk = 0)::INT::DOUBLE AS dist_is_majority, rk::DOUBLE AS dist_freq_rank, round(1 / u::DOUBLE, 6) AS dist_n_unique_ratio
FROM cells c CROSS JOIN s LEFT JOIN k ON c.col_name = k.col_name AND lower(trim(c.value)) = k.k WHERE mask <> 0""")
def fingerprint_distribution(spark, sf_dir):
    d = with_nulls(fingerprint.distribution(order_cells(spark, sf_dir)), "dist_is_majority", "dist_freq_rank")
    return d.select("row_idx", "col_name", *r6("dist_z_score", "dist_abs_z", "dist_percentile_approx", "dist_value_freq"), "dist_is_majority", "dist_freq_rank", *r6("dist_n_unique_ratio"))


@query(f"""WITH {CELLS}, m AS (SELECT col_name, quantile_cont(length(entry), 0.5) AS md FROM (SELECT DISTINCT col_name, trim(value) AS entry FROM cells WHERE value IS NOT NULL) GROUP BY 1)
SELECT row_idx, c.col_name, (lower(trim(coalesce(value, ''))) IN ('unknown', 'n/a', 'na', '—', '-', '?', 'none', 'null', 'nan', 'not available', 'not specified', 'other', 'unspecified'))::INT AS str_is_obfuscation,
  round(CASE WHEN value IS NULL OR length(value) <= 2 THEN 0.0 ELSE least(1.0, 0.3 * len(list_filter(range(1, length(value) - 1), lambda i: lower(value)[i] = lower(value)[i + 2]))) END, 6)::DOUBLE AS str_typo_score,
  round(CASE WHEN value IS NULL THEN 0.0 ELSE abs(length(value) - md) / (md + 1) END, 6)::DOUBLE AS str_len_anomaly,
  CASE WHEN value IS NOT NULL THEN regexp_matches(value, '\\d')::INT END::DOUBLE AS str_has_digits, CASE WHEN value IS NOT NULL THEN regexp_matches(value, '[^\\w\\s\\-.]')::INT END::DOUBLE AS str_has_special
FROM cells c LEFT JOIN m USING (col_name) WHERE mask <> 0""")
def fingerprint_string(spark, sf_dir):
    return with_nulls(fingerprint.strings(order_cells(spark, sf_dir)), "str_has_digits", "str_has_special").select("row_idx", "col_name", "str_is_obfuscation", *r6("str_typo_score", "str_len_anomaly"), "str_has_digits", "str_has_special")


_STAMPS = ", ".join(f"(c.col_name = '{c}')::INT AS pat_col_{c}" for c in ORDER_COLUMNS)


@query(f"""WITH {CELLS}, q AS (SELECT quantile_cont(x, 0.05) AS p5, quantile_cont(x, 0.95) AS p95, min(x) AS lo, max(x) AS hi FROM cells WHERE x IS NOT NULL), g AS (SELECT row_idx, count(*) AS k FROM cells WHERE mask <> 0 GROUP BY 1),
p AS (SELECT c.row_idx, c.col_name, (x BETWEEN p5 AND p95)::INT::DOUBLE AS plaus_in_range, (x BETWEEN lo AND hi)::INT::DOUBLE AS plaus_in_minmax, CASE WHEN value IS NOT NULL THEN 1.0 END::DOUBLE AS plaus_in_vocab, CASE WHEN value IS NOT NULL THEN 0.0 END::DOUBLE AS plaus_min_edit_dist,
  k AS pat_n_errors_in_row, (k > 1)::INT AS pat_multi_error, {_STAMPS} FROM cells c JOIN g ON c.row_idx = g.row_idx CROSS JOIN q WHERE mask <> 0)
SELECT * FROM p JOIN ({ORACLES["fingerprint_distribution"]}) USING (row_idx, col_name) JOIN ({ORACLES["fingerprint_string"]}) USING (row_idx, col_name)""")
def fingerprint_all(spark, sf_dir):
    """Cells are in the vocabulary they make, so text is always known here."""
    own = ("plaus_in_range", "plaus_in_minmax", "plaus_in_vocab", "plaus_min_edit_dist", "dist_is_majority", "dist_freq_rank", "str_has_digits", "str_has_special")
    f = with_nulls(fingerprint.fingerprint(order_cells(spark, sf_dir), ORDER_COLUMNS), *own)
    rounded = [c for c in f.columns if c.startswith("dist_") and c not in own] + ["str_typo_score", "str_len_anomaly"]
    return f.select(*[c for c in f.columns if c not in rounded], *r6(*rounded))


# clean and dirty line items ---------------------------------------------------------

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "clean_price"]
_LINES = f"li AS (SELECT *, row_number() OVER (ORDER BY {', '.join(LINE_KEY)}) - 1 AS row_idx FROM ({FX_LINEITEM}))"
_PAIRS = f"""{_LINES}, p AS (SELECT row_idx, 'qty' AS col_name, m_qty AS mask, clean_qty AS o, dirty_qty AS n FROM li UNION ALL SELECT row_idx, 'price', m_price, clean_price, dirty_price FROM li)"""


def line_pairs(spark, sf_dir) -> DataFrame:
    """Clean and dirty values side by side (old, new as numbers)."""
    li = C.with_row_index(X.lineitem(spark, sf_dir), LINE_KEY)
    cell = lambda name, mask, a, b: F.struct(F.lit(name).alias("col_name"), F.col(mask).alias("mask"), F.col(a).alias("old"), F.col(b).alias("new"))
    return li.select("row_idx", F.inline(F.array(cell("qty", "m_qty", "clean_qty", "dirty_qty"), cell("price", "m_price", "clean_price", "dirty_price"))))


_STAT = ("stat_change_magnitude", "stat_relative_change", "stat_change_direction", "stat_original_magnitude", "stat_new_magnitude", "stat_original_log", "stat_new_log", "stat_feature_name_encoded")


@query(f"""WITH {_PAIRS} SELECT row_idx, col_name, round(abs(n - o), 6) AS stat_change_magnitude, round(abs(n - o) / (abs(o) + 1), 6) AS stat_relative_change, sign(n - o)::DOUBLE AS stat_change_direction, round(abs(o), 6) AS stat_original_magnitude,
  round(abs(n), 6) AS stat_new_magnitude, round(ln(1 + abs(o)), 6) AS stat_original_log, round(ln(1 + abs(n)), 6) AS stat_new_log, (CASE col_name WHEN 'qty' THEN 0 ELSE 1 END)::DOUBLE AS stat_feature_name_encoded FROM p WHERE mask <> 0""")
def ref_stats(spark, sf_dir):
    text = line_pairs(spark, sf_dir).withColumns({"old": F.col("old").cast("string"), "new": F.col("new").cast("string")})
    return R.change_statistics(text, ["qty", "price"]).select("row_idx", "col_name", *r6(*_STAT))


@query(f"""WITH {_PAIRS} SELECT row_idx, col_name, sign(n - o)::DOUBLE AS change_direction, round(abs(n - o), 6) AS change_magnitude, round(abs(n - o) / (abs(o) + 1e-6), 6) AS raw_relative_change,
  round(abs(n - o) / (abs(o) * (1 + (row_idx % 10) / 10.0) + 1e-6), 6) AS wrc, round(1 / (1 + (row_idx % 10) / 10.0), 6) AS confidence_tree FROM p WHERE mask <> 0""")
def wrc_features(spark, sf_dir):
    p = line_pairs(spark, sf_dir).where("mask <> 0")
    results = p.select("row_idx", "col_name", F.col("new").cast("string").alias("observed_value"), F.col("old").cast("string").alias("imputed_value"), F.lit("num").alias("col_type"), ((F.col("row_idx") % 10) / 10.0).alias("sigma_tree"))
    return R.diagnostics(results).select("row_idx", "col_name", *r6("change_direction", "change_magnitude", "raw_relative_change", "wrc", "confidence_tree"))


@query(f"""WITH {_PAIRS}, i AS (SELECT *, o * (1 + ((row_idx % 7) - 3) / 20.0) AS g FROM p WHERE mask <> 0), r AS (SELECT *, abs(n - g) / nullif(abs(n - o), 0) AS q FROM i)
SELECT col_name, round(avg((sign(n - o) = sign(n - g))::INT), 6) AS direction_match, round(avg(q), 6) AS ratio_mean, round(quantile_cont(q, 0.5), 6) AS ratio_median, count(*) AS n FROM r GROUP BY col_name""")
def oracle_agreement(spark, sf_dir):
    from cellsight.operators.metrics import agreement

    p = line_pairs(spark, sf_dir).where("mask <> 0").withColumn("imputed", F.col("old") * (1 + ((F.col("row_idx") % 7) - 3) / 20.0))
    return agreement(p, by=["col_name"]).select("col_name", *r6("direction_match", "ratio_mean", "ratio_median"), "n")


@query(f"""WITH {_PAIRS} SELECT col_name, round(sqrt(avg((n - o) * (n - o))), 6) AS rmse, round(avg(abs(n - o)), 6) AS mae, round(sqrt(avg((n - o) * (n - o))) / (max(o) - min(o)), 6) AS nrmse, count(*) AS n FROM p WHERE mask <> 0 GROUP BY col_name""")
def rmse_by_column(spark, sf_dir):
    from cellsight.operators.metrics import imputation_errors

    return imputation_errors(line_pairs(spark, sf_dir).where("mask <> 0"), "old", "new").select("col_name", *r6("rmse", "mae", "nrmse"), "n")


RULES = [
    rules.Rule("C1", ("o_orderpriority",), "row['o_orderpriority'] in ('Unknown', 'n/a')", 1, motive="obfuscation"),
    rules.Rule("C2", ("o_totalprice", "o_orderstatus"), "(lambda v: float(v) <= 0)(row['o_totalprice'])", -1),
    rules.Rule("C3", ("o_totalprice",), "float(row['o_totalprice']) > 500000 and row['o_orderstatus'] == 'O'", 1, motive="gain_targeted"),
    rules.Rule("C4", ("o_orderstatus",), "row['o_orderstatus'].strip().lower() not in ('o', 'f', 'p') or len(row['o_orderstatus']) != 1", -1),
]


@query(f"""WITH f AS ({FX_ORDERS}), s AS (SELECT *, (o_orderpriority IN ('Unknown', 'n/a'))::INT AS c1, -(o_totalprice <= 0)::INT AS c2, (o_totalprice > 500000 AND o_orderstatus = 'O')::INT AS c3,
  -(lower(trim(o_orderstatus)) NOT IN ('o', 'f', 'p') OR length(o_orderstatus) <> 1)::INT AS c4 FROM f)
SELECT row_idx, 'o_orderpriority' AS col_name, c1 AS "signal_C1", 0 AS "signal_C2", 0 AS "signal_C3", 0 AS "signal_C4", 1 AS n_applicable, c1 AS cell_signal_sum, c1::DOUBLE AS cell_signal_ratio, c1 + c2 + c3 + c4 AS row_signal_sum FROM s WHERE m_p <> 0
UNION ALL SELECT row_idx, 'o_orderstatus', 0, c2, 0, c4, 2, c2 + c4, (c2 + c4) / 2.0::DOUBLE, c1 + c2 + c3 + c4 FROM s WHERE m_s <> 0
UNION ALL SELECT row_idx, 'o_totalprice', 0, c2, c3, 0, 2, c2 + c3, (c2 + c3) / 2.0::DOUBLE, c1 + c2 + c3 + c4 FROM s WHERE m_t <> 0""")
def rule_signals(spark, sf_dir):
    return rules.signals(X.orders(spark, sf_dir), RULES, ORDER_MASKS, columns=ORDER_COLUMNS)


# ECOD ---------------------------------------------------------------------------------

_TAILS = """v AS (SELECT col_name, o AS x, count(*) AS n FROM p GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY col_name) AS t, sum(n) OVER (PARTITION BY col_name ORDER BY x) AS up FROM v),
mo AS (SELECT col_name, avg(o) AS m FROM p GROUP BY 1), sk AS (SELECT col_name, avg(pow(o - m, 3)) / pow(avg(pow(o - m, 2)), 1.5) AS skew FROM p JOIN mo USING (col_name) GROUP BY 1),
tl AS (SELECT col_name, x, -ln(up / t::DOUBLE) AS l, -ln((t - up + n) / t::DOUBLE) AS r FROM w), mx AS (SELECT col_name, max(greatest(l, r)) AS most FROM tl GROUP BY 1)"""


def _line_values(spark, sf_dir) -> DataFrame:
    from cellsight.operators.storage import settled

    return settled(line_pairs(spark, sf_dir))


@query(f"""WITH {_PAIRS}, {_TAILS}, a AS (SELECT row_idx, p.col_name, l, r, CASE WHEN skew < 0 THEN l ELSE r END AS z FROM p JOIN tl ON p.col_name = tl.col_name AND p.o = tl.x JOIN sk ON p.col_name = sk.col_name)
SELECT row_idx, round(greatest(sum(l), sum(r), sum(z)), 6) AS score FROM a GROUP BY row_idx""")
def ecod_scores(spark, sf_dir):
    x = _line_values(spark, sf_dir).select("row_idx", "col_name", F.col("old").alias("x"))
    return detect.ecod_scores(detect.ecod_terms(x, detect.ecod_tails(x))).select("row_idx", *r6("score"))


@query(f"""WITH {_PAIRS}, {_TAILS}, lt AS (SELECT col_name, x, l FROM tl), rt AS (SELECT col_name, x, r FROM tl),
d AS (SELECT row_idx, p.col_name, mask, p.o, n AS x, coalesce(lt.l, most) AS l FROM p JOIN mx USING (col_name) ASOF LEFT JOIN lt ON p.col_name = lt.col_name AND p.n >= lt.x),
e AS (SELECT d.*, coalesce(rt.r, most) AS r FROM d JOIN mx USING (col_name) ASOF LEFT JOIN rt ON d.col_name = rt.col_name AND d.x <= rt.x),
g AS (SELECT e.*, CASE WHEN skew < 0 THEN e.l ELSE e.r END AS z, c.l AS l0, c.r AS r0, CASE WHEN skew < 0 THEN c.l ELSE c.r END AS z0 FROM e JOIN sk USING (col_name) JOIN tl c ON e.col_name = c.col_name AND e.o = c.x),
s AS (SELECT row_idx, sum(l) AS sl, sum(r) AS sr, sum(z) AS sz FROM g GROUP BY 1)
SELECT row_idx, col_name, round(greatest(sl, sr, sz) - greatest(sl - l + l0, sr - r + r0, sz - z + z0), 5) AS delta_score FROM g JOIN s USING (row_idx) WHERE mask <> 0""")
def ecod_loo(spark, sf_dir):
    p = _line_values(spark, sf_dir)
    dirty, clean = p.select("row_idx", "col_name", F.col("new").alias("x")), p.select("row_idx", "col_name", F.col("old").alias("x"))
    return detect.ecod_leave_one_out(dirty, clean, p.where("mask <> 0")).select("row_idx", "col_name", F.round("delta_score", 5).alias("delta_score"))


# suspicion ------------------------------------------------------------------------------

_DEV = f"""WITH {CELLS}, s AS (SELECT avg(x) AS m, stddev_samp(x) AS sd FROM cells WHERE mask = 0 AND x IS NOT NULL), f AS (SELECT col_name, value, count(*) AS k FROM cells WHERE mask = 0 AND value IS NOT NULL GROUP BY 1, 2),
h AS (SELECT *, k / (sum(k) OVER (PARTITION BY col_name))::DOUBLE AS share FROM f),
d AS (SELECT row_idx, c.col_name, round(CASE WHEN x IS NOT NULL THEN 1 / (1 + exp(-(abs((x - m) / sd) - 3))) ELSE 1 - coalesce(share, 0) END, 6) AS suspicion FROM cells c CROSS JOIN s LEFT JOIN h ON c.col_name = h.col_name AND c.value = h.value)"""


def _suspicion(spark, sf_dir) -> DataFrame:
    return suspicion.deviation_scores(order_cells(spark, sf_dir)).select("row_idx", "col_name", F.round("deviation", 6).alias("suspicion"))


@query(f"{_DEV} SELECT row_idx, col_name, suspicion FROM d ORDER BY suspicion DESC, row_idx, col_name LIMIT 20")
def suspicion_topk(spark, sf_dir):
    from cellsight.operators.metrics import top_cells

    return top_cells(_suspicion(spark, sf_dir))


@query(f"{_DEV} SELECT col_name, round(avg(suspicion), 6) AS mean, max(suspicion) AS high, count(*) FILTER (suspicion > 0.5) AS n_over, round(100.0 * count(*) FILTER (suspicion > 0.5) / count(*), 6) AS pct_over FROM d GROUP BY col_name")
def suspicion_summary(spark, sf_dir):
    from cellsight.operators.metrics import suspicion_summary as summary

    return summary(_suspicion(spark, sf_dir)).select("col_name", *r6("mean"), "high", "n_over", *r6("pct_over"))


# records ----------------------------------------------------------------------------------


@query(f"""WITH {_PAIRS}, c AS (SELECT col_name, o FROM p WHERE mask = 0), t AS (SELECT col_name, count(*) AS t FROM c GROUP BY 1), v AS (SELECT DISTINCT col_name, n FROM p WHERE mask <> 0),
b AS (SELECT v.col_name, v.n, count(c.o) AS k FROM v LEFT JOIN c ON v.col_name = c.col_name AND c.o < v.n GROUP BY 1, 2)
SELECT row_idx, col_name, round(k / t::DOUBLE, 6) AS below FROM p JOIN b USING (col_name, n) JOIN t USING (col_name) WHERE mask <> 0""")
def strict_percentile(spark, sf_dir):
    p = line_pairs(spark, sf_dir)
    asked, clean = p.where("mask <> 0").select("row_idx", "col_name", F.col("new").alias("x")), p.where("mask = 0").select("row_idx", "col_name", F.col("old").alias("x"))
    return records.strict_percentile(asked, clean).select("row_idx", "col_name", *r6("below"))


@query(f"""WITH {_PAIRS} SELECT row_idx AS variant_record_id, floor(row_idx / 3)::BIGINT AS original_record_id, row_idx % 3 AS variant_idx, col_name AS feature_name, round(abs(n - o), 6) AS change_magnitude, sign(n - o)::DOUBLE AS change_direction,
  round(ln(1 + abs(n - o)), 6) AS log_magnitude, round((n - o) / (o + 1e-10), 5) AS relative_change, mask AS intent_label FROM p WHERE mask <> 0""")
def change_records(spark, sf_dir):
    text = line_pairs(spark, sf_dir).withColumns({"old": F.col("old").cast("string"), "new": F.col("new").cast("string")})
    r = records.change_records(text)
    return r.select("variant_record_id", "original_record_id", "variant_idx", "feature_name", *r6("change_magnitude"), "change_direction", *r6("log_magnitude"), F.round("relative_change", 5).alias("relative_change"), "intent_label")


@query("""WITH e AS (SELECT event_type, avg(value) AS f FROM events GROUP BY 1), b AS (SELECT 'low' AS baseline, 10.0::DOUBLE AS f UNION ALL SELECT 'mid', 20.0 UNION ALL SELECT 'high', 40.0),
x AS (SELECT event_type AS method, e.f AS f1, baseline, abs(e.f - b.f) AS gap, row_number() OVER (PARTITION BY event_type ORDER BY abs(e.f - b.f), baseline) AS i FROM e CROSS JOIN b)
SELECT method, round(f1, 6) AS f1, baseline, round(gap, 6) AS gap FROM x WHERE i = 1""")
def closest_baseline(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("method")).agg(F.avg("value").alias("f1"))
    b = spark.createDataFrame([("low", 10.0), ("mid", 20.0), ("high", 40.0)], "method string, f1 double")
    return records.closest_baseline(e, b).select("method", *r6("f1"), "baseline", *r6("gap"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer) SELECT 'union' AS name, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS n
UNION ALL SELECT 'both', (SELECT count(*) FROM a WHERE k IN (SELECT k FROM b)) UNION ALL SELECT 'left_only', (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) UNION ALL SELECT 'right_only', (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a))""")
def key_sets(spark, sf_dir):
    a, b = X.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return records.key_sets(a, b, "k")


@query("SELECT event_type AS part, event_id AS left_position, event_id AS right_position FROM events WHERE event_id % 3 <> 0")
def aligned_rows(spark, sf_dir):
    """Two thirds of each group's rows find their partners again."""
    e = X.table(spark, sf_dir, "events").select(F.col("event_type").alias("part"), F.col("event_id").alias("position"), F.col("event_id").alias("key"))
    return align(e.where("position % 3 <> 0"), e)


@query("SELECT 'events' AS part, event_id AS left_position, event_id AS right_position FROM events WHERE event_id % 3 <> 0")
def aligned_table(spark, sf_dir):
    """The same with all rows in one group, walked in chunks."""
    e = X.table(spark, sf_dir, "events").select(F.lit("events").alias("part"), F.col("event_id").alias("position"), F.col("event_id").alias("key"))
    return align(e.where("position % 3 <> 0"), e, chunk=2048)
