"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellsight.llm import audio, bpe, chat, codes, exact, html, lines, packing, quality, repair, simhash, substring, token_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


OP2_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM p),
firsts AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN firsts USING (k) WHERE least < doc_id),
gone AS (SELECT doc_id, list(j) AS js FROM hit GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(js, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.store(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_whole(table(spark, sf_dir, "conversations"))


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.store_and_read(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.codes_and_errors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_bpe": op1_bpe, "op2_substring": op2_substring, "op3_lines": op3_lines, "op4_html": op4_html, "op5_simhash": op5_simhash, "op6_token_files": op6_token_files, "op7_packing": op7_packing, "op8_chat": op8_chat, "op9_audio": op9_audio, "op10_quality": op10_quality, "op11_exact": op11_exact, "op12_repair": op12_repair, "op13_vector_codes": op13_vector_codes}
ORACLES: dict[str, str] = {"op2_substring": OP2_SQL, "op3_lines": lines.DIGESTS_SQL, "op8_chat": chat.ROTATE_SQL, "op11_exact": exact.DEDUPLICATE_SQL}
