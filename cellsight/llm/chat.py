"""Op 8: chat formatting by perspective rotation, in DataFrame functions only.

Every participant of a dialogue takes the assistant's place once: its turns are
the assistant's and open in the mask, all others are users with names, system
turns stay. Long dialogues come in blocks, so that no group grows beyond a fixed
number of turns. ``rotate_whole`` numbers turns by rank and gives every
participant of the conversation every block, so the parts make up one whole
rendering; ``rotate`` cuts by turn numbers and renders a block for those who
speak in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellsight.llm.common import settle

#: Turns (of ``rotate``: turn numbers) of one rendered block.
BLOCK_TURNS = 1024
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _header(role: Column, speaker: Column) -> Column:
    # a backslash marks what would end the header; no two names come out alike
    name = F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("<|im_"), F.lit("<\\|im_"))
    return F.concat(
        F.lit(BEGIN),
        F.when(role == speaker, F.lit("assistant")).when(F.lower(role) == "system", F.lit("system")).when(role.isNull(), F.lit("user")).otherwise(F.concat(F.lit("user name="), name)),
        F.lit("\n"),
    )


def _turns(c: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return c.select(c[conv].alias("conv_id"), c[turn].cast("long").alias("turn"), c[role].cast("string").alias("role"), F.replace(F.coalesce(c[text].cast("string"), F.lit("")), F.lit("<|im_"), F.lit("<| im_")).alias("text"))


def _takes_part(role: Column) -> Column:
    return role.isNotNull() & (F.lower(role) != "system")


def _render(each: DataFrame) -> DataFrame:
    """The output columns from ``conv_id, block, speaker, turns, offset``; spans count from the offset."""
    piece = lambda t: F.struct(_header(t["role"], F.col("speaker")).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), F.coalesce(t["role"] == F.col("speaker"), F.lit(False)).alias("own"))
    pieces = each.select("conv_id", "block", "speaker", "offset", F.transform("turns", piece).alias("p"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.char_length(p["head"])
        end = begin + F.char_length(p["body"])
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(F.concat_ws("-", begin.cast("string"), end.cast("string"))))).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.col("offset").alias("at"), F.array().cast("array<string>").alias("spans"))
    spans = F.aggregate("p", start, step, lambda acc: acc["spans"])
    rendered = F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    return pieces.select("conv_id", "block", "speaker", F.size("p").cast("long").alias("n_turns"), F.size(F.filter("p", lambda p: p["own"])).cast("long").alias("n_own_turns"), rendered.alias("rendered"), F.array_join(spans, ",").alias("mask"))


def rotate(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """``conv_id, block, speaker, n_turns, n_own_turns, rendered, mask``: one row for each dialogue block and speaker in it.

    ``mask`` has the spans of the speaker's turns, their end marks included, as ``start-end`` in code points, separated by
    commas. Turns go by number, then role, then text. Null texts are empty; null turn numbers come first, in block 0; a null role is a user without
    a name and no participant; a block without participants gives no row. Markers inside texts are broken by a space.
    Repeated rows are turns of their own; other columns are not read.
    """
    turns = _turns(conversations, conv, turn, role, text)
    block = F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(0)).cast("long")
    grouped = turns.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    people = F.array_distinct(F.transform(F.filter("turns", lambda t: _takes_part(t["role"])), lambda t: t["role"]))
    return _render(grouped.select("conv_id", "block", "turns", F.explode(people).alias("speaker"), F.lit(0).cast("long").alias("offset")))


def rotate_whole(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The columns of ``rotate``: one row for each participant of a conversation and block of ``block_turns`` turns by rank.

    Turns are ordered as in ``rotate``; those without a conversation id make up one conversation. The ``rendered`` parts of a participant, put together by block, are the whole
    dialogue, silent blocks included, and the spans of ``mask`` count from its start. Ranks are made in ranges, so no task
    gathers a conversation.
    """
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["turn", "role", "text", "tie"]  # the tie deals out repeated rows
    keyed = _turns(conversations, conv, turn, role, text).select(F.struct("conv_id").alias("conv"), "turn", "role", "text", F.monotonically_increasing_id().alias("tie"))
    ranged = settle(keyed.repartitionByRange(n, "conv", *order).withColumn("part", F.spark_partition_id()), "turns")
    of_conv = W.partitionBy("conv")
    counts = ranged.groupBy("conv", "part").agg(F.count("*").alias("here"))
    counts = settle(counts.select("conv", "part", (F.sum("here").over(of_conv.orderBy("part")) - F.col("here")).alias("before"), F.sum("here").over(of_conv).alias("total")), "counts")

    def numbered(some: DataFrame) -> DataFrame:
        rank = F.col("before") + F.row_number().over(W.partitionBy("conv", "part").orderBy(*order)) - 1
        return ranged.join(some, ["conv", "part"]).withColumn("rank", rank).withColumn("block", F.floor(F.col("rank") / block_turns).cast("long"))

    people = ranged.where(_takes_part(F.col("role"))).select("conv", F.col("role").alias("speaker")).distinct()
    blocks = counts.select("conv", F.ceil(F.col("total") / block_turns).cast("long").alias("blocks")).distinct()
    seats = people.join(blocks, "conv").select("conv", "speaker", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))

    # what lies before a block, as this speaker sees it: only the heads of the speaker's own turns have another length
    head = F.char_length(_header(F.col("role"), F.lit(None).cast("string")))
    lengths = numbered(counts.where(F.col("total") > block_turns)).groupBy("conv", "block", "role").agg(F.sum(head + F.char_length("text") + len(END) + 1).alias("all"), F.sum(F.lit(len(f"{BEGIN}assistant\n")) - head).alias("more"))
    lengths = settle(lengths, "lengths")
    own = lengths.select("conv", "block", F.col("role").alias("speaker"), "more")
    size = F.col("all") + F.coalesce("more", F.lit(0))
    before = F.sum(size).over(W.partitionBy("conv", "speaker").orderBy("block")) - size
    offsets = seats.join(lengths.groupBy("conv", "block").agg(F.sum("all").alias("all")), ["conv", "block"]).join(own, ["conv", "block", "speaker"], "left").select("conv", "block", "speaker", before.alias("offset"))

    grouped = numbered(counts).groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("rank", "role", "text"))).alias("turns"))
    each = grouped.join(seats.join(offsets, ["conv", "block", "speaker"], "left"), ["conv", "block"])
    return _render(each.select("conv.conv_id", "block", "speaker", "turns", F.coalesce("offset", F.lit(0).cast("long")).alias("offset")))


ROTATE_SQL = rf"""
WITH r AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) - 1 AS rank FROM r),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role IS NOT NULL AND lower(role) <> 'system'),
x AS (SELECT t.*, rank // {BLOCK_TURNS} AS block, p.speaker, coalesce(t.role = p.speaker, false) AS own,
  '{BEGIN}' || CASE WHEN t.role = p.speaker THEN 'assistant' WHEN lower(t.role) = 'system' THEN 'system' WHEN t.role IS NULL THEN 'user'
    ELSE 'user name=' || replace(replace(replace(t.role, '\', '\\'), chr(10), '\n'), '<|im_', '<\|im_') END || chr(10) AS head, t.text || '{END}' AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
y AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY rank ROWS UNBOUNDED PRECEDING) - 1 AS e FROM x)
SELECT conv_id, block::BIGINT AS block, speaker, count(*) AS n_turns, count(*) FILTER (own) AS n_own_turns,
  string_agg(head || body || chr(10), '' ORDER BY e) AS rendered,
  coalesce(string_agg((e - length(body))::BIGINT || '-' || e::BIGINT, ',' ORDER BY e) FILTER (own), '') AS mask
FROM y GROUP BY conv_id, block, speaker
"""
