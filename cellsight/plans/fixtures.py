"""Dirty tables made from the star-schema tables by arithmetic on keys; the same SQL runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FX_ORDERS = """
SELECT o_orderkey AS row_idx,
  CASE WHEN m_p<>0 THEN CASE o_orderkey%3 WHEN 0 THEN 'Unknown'
       WHEN 1 THEN concat(substring(o_orderpriority,1,2),substring(o_orderpriority,4,1),substring(o_orderpriority,3,1),substring(o_orderpriority,5))
       ELSE concat(o_orderpriority,'-x') END ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN m_s<>0 THEN CASE WHEN o_orderkey%2=0 THEN 'O' ELSE '?' END ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN m_t<>0 THEN CASE WHEN o_orderkey%2=0 THEN o_totalprice*10 ELSE 0.0 END ELSE o_totalprice END AS o_totalprice,
  m_p, m_s, m_t
FROM (SELECT *,
  CASE WHEN (o_orderkey*7+1)%29=0 THEN CASE WHEN o_orderkey%2=0 THEN 1 ELSE -1 END ELSE 0 END AS m_p,
  CASE WHEN (o_orderkey*7+2)%29=0 THEN CASE WHEN o_orderkey%3=0 THEN 1 ELSE -1 END ELSE 0 END AS m_s,
  CASE WHEN (o_orderkey*7+1)%29=0 AND o_orderkey%4=0 THEN 1 WHEN (o_orderkey*11+3)%31=0 THEN -1 ELSE 0 END AS m_t FROM orders) b
"""
#: One row for each line item; the key is unique, so row numbers are not needed for pairing.
FX_LINEITEM = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS clean_price, l_quantity AS clean_qty,
  CASE WHEN (l_orderkey*7+l_linenumber)%23=0 THEN CASE WHEN l_orderkey%2=0 THEN 1 ELSE -1 END ELSE 0 END AS m_qty,
  CASE WHEN (l_orderkey*5+l_linenumber)%37=0 THEN -1 ELSE 0 END AS m_price,
  CASE WHEN (l_orderkey*7+l_linenumber)%23=0 THEN CASE WHEN l_orderkey%2=0 THEN l_quantity*10 ELSE l_quantity+0.5 END ELSE l_quantity END AS dirty_qty,
  CASE WHEN (l_orderkey*5+l_linenumber)%37=0 THEN -l_extendedprice ELSE l_extendedprice END AS dirty_price
FROM lineitem
"""
FX_PRED = """
SELECT l.doc_id, CASE WHEN l.quality=1 THEN 1 ELSE -1 END AS y_true,
  CASE WHEN d.n_chars>1000 THEN 1 ELSE -1 END AS y_pred, CAST(d.n_chars AS DOUBLE) AS score
FROM labels l JOIN documents d ON l.doc_id=d.doc_id
"""
FX_FLAGS = """
SELECT event_id%2000 AS row_idx, event_type AS col_name,
  CASE WHEN user_id%5=0 THEN 1 WHEN user_id%5 IN (1,2) THEN -1 ELSE 0 END AS cell_value,
  CASE user_id%3 WHEN 0 THEN 'LEGIT' WHEN 1 THEN 'SUSPICIOUS' ELSE 'COUNTERFEIT' END AS tier
FROM events
"""
FX_LLM = """
SELECT event_id, concat('```json {"feature_decisions":[{"row_id":',cast(event_id as varchar(20)),',"column":"',event_type,'","decision":',
  CASE WHEN event_id%7=0 THEN '3' WHEN event_id%2=0 THEN '1' ELSE '-1' END,'}]} ```') AS raw
FROM events
"""
ORDER_COLUMNS = ["o_orderpriority", "o_orderstatus", "o_totalprice"]
ORDER_MASKS = {"o_orderpriority": "m_p", "o_orderstatus": "m_s", "o_totalprice": "m_t"}
#: Cells of the orders fixture in DuckDB; numbers keep their own column, so they are never turned into text and back.
CELLS = f"""
fx AS ({FX_ORDERS}),
cells AS (
  SELECT row_idx, 'o_orderpriority' AS col_name, o_orderpriority AS value, NULL::DOUBLE AS x, m_p AS mask FROM fx
  UNION ALL SELECT row_idx, 'o_orderstatus', o_orderstatus, NULL, m_s FROM fx
  UNION ALL SELECT row_idx, 'o_totalprice', NULL, o_totalprice::DOUBLE, m_t FROM fx)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A fixture's SQL over the named tables."""
    for n in names:
        sql = sql.replace(f" {n} ", f" {{{n}}} ").replace(f" {n})", f" {{{n}}})").replace(f" {n}\n", f" {{{n}}}\n")
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir, FX_ORDERS, "orders")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir, FX_LINEITEM, "lineitem")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined by the frame API: the braces of the SQL form are kept for single tables."""
    from pyspark.sql import functions as F

    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = table(spark, sf_dir, "labels").join(d, "doc_id")
    return j.select("doc_id", F.when(F.col("quality") == 1, 1).otherwise(-1).alias("y_true"), F.when(F.col("n_chars") > 1000, 1).otherwise(-1).alias("y_pred"), F.col("n_chars").cast("double").alias("score"))


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir, FX_FLAGS, "events")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    decision = F.when(F.col("event_id") % 7 == 0, "3").when(F.col("event_id") % 2 == 0, "1").otherwise("-1")
    raw = F.concat(F.lit('```json {"feature_decisions":[{"row_id":'), F.col("event_id").cast("string"), F.lit(',"column":"'), F.col("event_type"), F.lit('","decision":'), decision, F.lit("}]} ```"))
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
