"""Queries of fitted and iterative operators; few of them have an SQL form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.operators import cells as C
from cellsight.operators import cluster, detect, records
from cellsight.operators import heuristics as H
from cellsight.operators import information as I
from cellsight.operators import models as M
from cellsight.operators.bagging import out_of_bag_errors
from cellsight.operators.recurrent import RecurrentAutoencoder
from cellsight.operators.storage import settled
from cellsight.plans import fixtures as X
from cellsight.plans import scenario
from cellsight.plans.fixtures import ORDER_COLUMNS, ORDER_MASKS
from cellsight.plans.queries_attribution import PAIRS, RULES, order_cells
from cellsight.plans.queries_tables import _L2, _NEAR, _VEC, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TYPES = {"o_orderpriority": "cat", "o_orderstatus": "cat", "o_totalprice": "num"}
#: Columns of line items for record detectors.
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def query_as(sql: str):
    def add(f):
        ORACLES[f.__name__] = sql
        return query(f)

    return add


def _bank(spark, sf_dir, trees: int = 10, depth: int = 5) -> M.PredictorBank:
    return M.PredictorBank(TYPES, trees, depth).fit(X.orders(spark, sf_dir), ORDER_MASKS)


#: Labelled vectors and all distances.
_LABELLED = f"{_VEC}, {_NEAR.format(name='n', dist=_L2, where='')}, seeds AS (SELECT id, CASE WHEN label % 2 = 0 THEN 1 ELSE -1 END AS intent FROM v WHERE (id * 7919 + 13) % 10 = 0)"


def _seeds(v: DataFrame) -> DataFrame:
    """A tenth of the vectors are labelled, as a fixture of few labels."""
    return v.where((F.col("id") * 7919 + 13) % 10 == 0).select("id", F.when(F.col("label") % 2 == 0, 1).otherwise(-1).alias("intent"))


@query
def kmeans_cells(spark, sf_dir):
    return cluster.kmeans(vectors(spark, sf_dir), 8, 3)


@query
def gmm_cells(spark, sf_dir):
    return cluster.diagonal_mixture(vectors(spark, sf_dir))[0]


@query
def dbscan_cells(spark, sf_dir):
    return cluster.dbscan(vectors(spark, sf_dir))


@query
def agglomerative_cells(spark, sf_dir):
    return cluster.agglomerative(vectors(spark, sf_dir), 15)


@query
def hdbscan_cells(spark, sf_dir):
    """Hierarchical density clusters and outlier scores, clusters of five and more."""
    return cluster.density_clusters(vectors(spark, sf_dir), 5, 5).withColumn("score", F.round("score", 6))


@query
def silhouette_score(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return spark.createDataFrame([(cluster.silhouette(v, cluster.kmeans(v, 8, 1)),)], "silhouette double")


@query
def cluster_vote(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return cluster.vote_labels(cluster.kmeans(v, 8, 1), _seeds(v))


@query_as(f"""WITH {_LABELLED}, k AS (SELECT q, d, intent, row_number() OVER (PARTITION BY q ORDER BY d, b) AS i FROM n JOIN seeds ON b = seeds.id)
SELECT q AS id, coalesce(max(intent) FILTER (d = 0), CASE WHEN sum(intent / d) FILTER (d > 0) >= 0 THEN 1 ELSE -1 END)::INT AS y_pred FROM k WHERE i <= 7 GROUP BY q""")
def knn_classifier(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return cluster.knn_labels(v, _seeds(v))


def _spread(step: str) -> str:
    return f"""WITH RECURSIVE {_LABELLED}, k AS (SELECT q, b FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, b) AS i FROM n) WHERE i <= 8 AND q <> b), g AS (SELECT q, b FROM k UNION SELECT b, q FROM k),
st AS (SELECT v.id, intent::DOUBLE AS y FROM v LEFT JOIN seeds ON v.id = seeds.id),
it AS (SELECT id, y, coalesce(y, 0)::DOUBLE AS s, 1.0::DOUBLE AS moved, 0 AS r FROM st
  UNION ALL SELECT id, y, t, max(abs(t - s)) OVER (), r + 1 FROM (SELECT it.id, it.y, it.s, it.r, {step} AS t FROM it LEFT JOIN (SELECT g.q, avg(o.s) AS m FROM g JOIN it o ON g.b = o.id GROUP BY g.q) z ON z.q = it.id WHERE it.moved >= 0.001 AND it.r < 1000))
SELECT id, CASE WHEN s >= 0 THEN 1 ELSE -1 END::INT AS y_pred, round(s, 6) AS score FROM it WHERE r = (SELECT max(r) FROM it)"""


@query_as(_spread("coalesce(it.y, z.m, 0)"))
def label_propagation(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return cluster.spread_labels(v, _seeds(v)).withColumn("score", F.round("score", 6))


@query_as(_spread("0.2 * coalesce(z.m, 0) + 0.8 * coalesce(it.y, 0)"))
def label_spread(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return cluster.spread_labels(v, _seeds(v), alpha=0.2).withColumn("score", F.round("score", 6))


@query
def density_outliers(spark, sf_dir):
    """The detector at its production parameters."""
    return cluster.density_outliers(vectors(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query
def h4_coherence(spark, sf_dir):
    return M.h4_coherence(_bank(spark, sf_dir), C.errors(order_cells(spark, sf_dir)))


@query
def feature_assembly(spark, sf_dir):
    """The twelve heuristic features of every flagged cell in their fixed order, fitted ones included."""
    table, names = scenario.feature_table(X.orders(spark, sf_dir), ORDER_MASKS, "B", target="o_orderstatus", pairs=PAIRS, bank=_bank(spark, sf_dir), sensitive=["o_orderstatus", "o_totalprice"])
    return table.select("row_idx", "col_name", *names)


@query
def h6_importance(spark, sf_dir):
    cells = order_cells(spark, sf_dir)
    return M.h6_importance(cells, "o_orderstatus", C.detect_types(cells))


_PSI = I.DIGAMMA_SQL.format


@query_as(f"""WITH l AS (SELECT 'o_orderstatus' AS pair, o_orderstatus AS label, o_totalprice::DOUBLE AS x FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority, o_totalprice::DOUBLE FROM orders),
a AS (SELECT *, count(*) OVER (PARTITION BY pair, label) AS size, row_number() OVER (PARTITION BY pair, label ORDER BY x) AS i FROM l),
b AS (SELECT *, lag(x, 1) OVER w AS p1, lag(x, 2) OVER w AS p2, lag(x, 3) OVER w AS p3, lead(x, 1) OVER w AS n1, lead(x, 2) OVER w AS n2, lead(x, 3) OVER w AS n3 FROM a WHERE size > 3 WINDOW w AS (PARTITION BY pair, label ORDER BY i)),
r AS (SELECT *, list_min(list_filter([n3 - x, CASE WHEN p1 + n2 IS NOT NULL THEN greatest(x - p1, n2 - x) END, CASE WHEN p2 + n1 IS NOT NULL THEN greatest(x - p2, n1 - x) END, x - p3], lambda e: e IS NOT NULL)) AS radius FROM b),
q AS (SELECT row_number() OVER () AS row, pair, label, x, size, radius, x - radius * (1 - 1e-9) AS lo, x + radius * (1 - 1e-9) AS hi FROM r),
v AS (SELECT pair, x, count(*) AS n FROM q GROUP BY ALL),
m AS (SELECT q.row, any_value(q.pair) AS pair, any_value(q.size) AS size, any_value(q.radius) AS radius, any_value(q.label) AS label, any_value(q.x) AS x, sum(v.n)::DOUBLE AS inside FROM q JOIN v ON q.pair = v.pair AND v.x >= q.lo AND v.x <= q.hi GROUP BY q.row),
s AS (SELECT pair, label, x, count(*)::DOUBLE AS same FROM q GROUP BY ALL),
e AS (SELECT m.*, CASE WHEN radius > 0 THEN 3.0 ELSE same END AS own FROM m JOIN s USING (pair, label, x))
SELECT pair, round(greatest(0.0, {_PSI("count(*)")} + avg({_PSI("own")} - {_PSI("size")} - {_PSI("inside")})), 6) AS mi FROM e GROUP BY pair""")
def nearest_information(spark, sf_dir):
    """What the price of an order tells about its status and priority, from nearest neighbours."""
    o = X.table(spark, sf_dir, "orders")
    pair = lambda c: o.select(F.lit(c).alias("pair"), F.col(c).alias("label"), F.col("o_totalprice").cast("double").alias("x"))
    return I.with_class(pair("o_orderstatus").union(pair("o_orderpriority"))).select("pair", F.round("mi", 6).alias("mi"))


@query_as(f"""WITH p AS (SELECT p_retailprice / (SELECT stddev_pop(p_retailprice) FROM part) AS x, p_size / (SELECT stddev_pop(p_size) FROM part) AS y, row_number() OVER () AS i FROM part),
d AS (SELECT a.i, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS d, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM p a CROSS JOIN p b),
r AS (SELECT i, d AS radius FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d) AS k FROM d) WHERE k = 4),
m AS (SELECT d.i, any_value(radius) AS radius, count(*) FILTER (dx <= radius * (1 - 1e-9))::DOUBLE AS nx, count(*) FILTER (dy <= radius * (1 - 1e-9))::DOUBLE AS ny, count(*) FILTER (d = 0)::DOUBLE AS same FROM d JOIN r USING (i) GROUP BY d.i),
e AS (SELECT *, CASE WHEN radius > 0 THEN 3.0 ELSE same END AS own FROM m)
SELECT round(greatest(0.0, {_PSI("count(*)")} + avg({_PSI("own")} - {_PSI("nx")} - {_PSI("ny")})), 6) AS mi FROM e""")
def nearest_information_numbers(spark, sf_dir):
    """Of the price and the size of parts."""
    p = X.table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("x"), F.col("p_size").alias("y"))
    return spark.createDataFrame([(round(I.of_numbers(p), 6),)], "mi double")


@query
def rf_intent(spark, sf_dir):
    """Metrics of scenario BC with one hundredth of the cells as seeds."""
    table, names = scenario.feature_table(X.orders(spark, sf_dir), ORDER_MASKS, "BC", rules=RULES, target="o_orderstatus", pairs=PAIRS, bank=_bank(spark, sf_dir))
    return scenario.run_scenario(table, names, trees=20, depth=6)[1]


def _scenario(spark, sf_dir, name: str, clustering: str) -> DataFrame:
    table, names = scenario.feature_table(X.orders(spark, sf_dir), ORDER_MASKS, name, rules=RULES, target="o_orderstatus", pairs=PAIRS, bank=_bank(spark, sf_dir))
    return scenario.run_scenario(table, names, trees=20, depth=6, clustering=clustering)[1]


@query
def scenario_b_clustered(spark, sf_dir):
    """Scenario B with seeds by density clusters of the features."""
    return _scenario(spark, sf_dir, "B", "dbscan")


@query
def scenario_bc_clustered(spark, sf_dir):
    """Scenario BC with seeds by K-Means clusters of the features."""
    return _scenario(spark, sf_dir, "BC", "kmeans")


@query
def scenario_c(spark, sf_dir):
    """Scenario C: the signals of the rules alone, uniform seeds."""
    table, names = scenario.feature_table(X.orders(spark, sf_dir), ORDER_MASKS, "C", rules=RULES)
    return scenario.run_scenario(table, names)[1]


@query
def rf_cross_validation(spark, sf_dir):
    table, names = scenario.feature_table(X.orders(spark, sf_dir), ORDER_MASKS, "C", rules=RULES)
    return M.cross_validate(table.withColumn("row_idx", F.xxhash64("row_idx", "col_name")), names, k=3, trees=10, depth=5)


@query
def mice_impute(spark, sf_dir):
    bank = _bank(spark, sf_dir, 5, 4)
    return M.impute_cells(bank, C.errors(order_cells(spark, sf_dir)), rounds=2, errors=out_of_bag_errors(bank))


@query
def mice_errors(spark, sf_dir):
    """Out-of-bag error of each order column's predictor."""
    bank = _bank(spark, sf_dir)
    return spark.createDataFrame(list(out_of_bag_errors(bank).items()), "col_name string, oob_error double")


def _lines(spark, sf_dir) -> DataFrame:
    return X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *MEASURES)


@query
def isolation_forest(spark, sf_dir):
    li = _lines(spark, sf_dir).withColumn("id", F.xxhash64("l_orderkey", "l_linenumber", "l_extendedprice"))
    return detect.isolation_forest(li, MEASURES, "id", trees=50)


@query
def statistical_ensemble(spark, sf_dir):
    return detect.statistical_ensemble(_lines(spark, sf_dir), MEASURES).select("l_orderkey", "l_linenumber", "mahalanobis", "vote_count", "is_suspicious")


@query
def gmm_detector(spark, sf_dir):
    scored = detect.mixture_score(_lines(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"], 3)
    return detect.flag_top(scored, "nll").select("l_orderkey", "l_linenumber", "nll", "flag")


@query
def reconstruction_detector(spark, sf_dir):
    return detect.flag_top(detect.reconstruction_error(_lines(spark, sf_dir), MEASURES), "reconstruction").select("l_orderkey", "l_linenumber", "reconstruction", "flag")


@query
def recurrent_detector(spark, sf_dir):
    """Customers whose orders an autoencoder doesn't rebuild well; the network and the rounds are the defaults."""
    o = X.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("orders"), F.avg(F.col("o_totalprice").cast("double")).alias("mean"), F.max(F.col("o_totalprice").cast("double")).alias("most"), F.stddev_pop(F.col("o_totalprice").cast("double")).alias("spread"))
    c = X.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("balance")).join(o, "c_custkey", "left").na.fill(0.0)
    return RecurrentAutoencoder(["balance", "orders", "mean", "most", "spread"], "c_custkey").fit(c).transform(c).select("c_custkey", "reconstruction", "flag")


@query
def model_attribution(spark, sf_dir):
    """Decisions of the stub scorer for every flagged order cell, -1 where it gives none."""
    cells = C.errors(order_cells(spark, sf_dir))
    return scenario.model_attribution(cells)


@query
def diverse_records(spark, sf_dir):
    return records.diverse_records(vectors(spark, sf_dir), 10)


@query
def learned_suspicion(spark, sf_dir):
    return records.learned_suspicion(order_cells(spark, sf_dir), ORDER_COLUMNS)
