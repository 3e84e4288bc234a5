"""Op 3: line deduplication by site-relative frequency.

A line is boilerplate on a host if it stands on more than a share of the host's
pages, and on a least number of them. Lines without a word are never counted nor dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsight.llm.common import settle

#: Production limits: more than this many hundredths of a host's pages, and at least so many pages.
PERCENT = 8
MIN_PAGES = 5
HAS_WORD = r"[^\x20\x09-\x0D]"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _key(line: Column) -> Column:
    """A 128-bit key of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(docs: DataFrame, host: Column, text_column: str = "text", percent: int = PERCENT, min_pages: int = MIN_PAGES) -> DataFrame:
    """``__site, __keys``: the boilerplate lines of every host that has some.

    A page counts a line once, and counts are aggregated before the shuffle, so neither a hot host nor a hot line gathers
    rows. With distinct lines of L a page, a host has at most 100 * L / percent such lines.
    """
    pages = docs.select(host.alias("host"), docs[text_column].cast("string").alias("text"))
    lines = pages.select("host", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.col("line").rlike(HAS_WORD))
    counts = lines.select("host", _key(F.col("line")).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("pages")).withColumnRenamed("host", "site")
    over = counts.join(totals, F.col("host").eqNullSafe(F.col("site"))).where(100 * F.col("n") > percent * F.col("pages"))
    return settle(over.groupBy("host").agg(F.collect_list("key").alias("keys")).withColumnRenamed("host", "__site").withColumnRenamed("keys", "__keys"), "boilerplate")


def drop_lines(docs: DataFrame, host: Column | None = None, text_column: str = "text", percent: int = PERCENT, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and ``__lines`` and ``__dropped`` (both long).

    ``host`` defaults to the column ``source``; null hosts are one host. A null text stays null with no lines; a text whose
    lines are all dropped is empty. Repeated rows count as pages each. The few columns that are added start with two underscores.
    """
    host = docs["source"] if host is None else host
    found = boilerplate(docs, host, text_column, percent, min_pages)
    joined = docs.withColumn("__host", host.cast("string")).join(found, F.col("__host").eqNullSafe(F.col("__site")), "left")
    lines = F.split(F.col(text_column), "\n")
    bad = lambda line: line.rlike(HAS_WORD) & F.array_contains(F.col("__keys"), _key(line))
    kept = F.when(F.col("__keys").isNull(), lines).otherwise(F.filter(lines, lambda line: ~bad(line)))
    out = joined.withColumn("__kept", kept)
    return out.select(
        *[F.array_join("__kept", "\n").alias(c) if c == text_column else F.col(c) for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("__lines"),
        F.coalesce(F.size(lines) - F.size("__kept"), F.lit(0)).cast("long").alias("__dropped"),
    )


def digests(docs: DataFrame, **limits) -> DataFrame:
    """``doc_id, source, n_lines, n_dropped, kept_sha256`` of every row; the digest of a null text is that of the empty one."""
    return drop_lines(docs.select("doc_id", "source", "text"), **limits).select(
        "doc_id", "source", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


DIGESTS_SQL = rf"""
WITH l AS (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents),
f AS (SELECT source, line, count(*) AS n FROM l WHERE regexp_matches(line, '{HAS_WORD}') GROUP BY source, line),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
b AS (SELECT f.source, list(line) AS ls FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source WHERE n >= {MIN_PAGES} AND 100 * n > {PERCENT} * pages GROUP BY f.source),
k AS (SELECT doc_id, d.source, string_split(text, chr(10)) AS al, ls FROM documents d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source),
r AS (SELECT doc_id, source, al, CASE WHEN ls IS NULL THEN al ELSE list_filter(al, lambda x: NOT list_contains(ls, x)) END AS kl FROM k)
SELECT doc_id, source, coalesce(len(al), 0)::BIGINT AS n_lines, coalesce(len(al) - len(kl), 0)::BIGINT AS n_dropped,
  sha256(coalesce(array_to_string(kl, chr(10)), '')) AS kept_sha256 FROM r
"""
