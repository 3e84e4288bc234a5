"""Prompts for a language model and its answers, as column functions: tolerant JSON, decisions of +1 and -1, defaults."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cellsight.functions import as_column as _c

DECISIONS = "struct<feature_decisions: array<struct<row_id: bigint, column: string, decision: string, reason: string>>>"
NAMED_KEYS = ("decision", "intent", "intentional", "label", "result")


def strip_thinking(text) -> Column:
    """Without <think> blocks, closed or not."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(text), r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))


def strip_fences(text) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"```(?:json|JSON)?", ""))


def outermost(text) -> Column:
    """From the first opening bracket to the last closing one of its kind."""
    t = strip_fences(strip_thinking(text))
    brace, bracket = F.instr(t, "{"), F.instr(t, "[")
    obj = (brace > 0) & ((bracket == 0) | (brace < bracket))
    return F.when(obj, F.regexp_extract(t, r"(?s)(\{.*\})", 1)).when(bracket > 0, F.regexp_extract(t, r"(?s)(\[.*\])", 1))


@F.pandas_udf(StringType())
def first_fragment(texts: pd.Series) -> pd.Series:
    """The first balanced object or array, by counting brackets outside strings (for answers with text on both sides)."""
    token = re.compile(r'"(?:\\.|[^"\\])*"|[{}\[\]]')
    pair = {"}": "{", "]": "["}

    def one(text):
        begin, stack = None, []
        for m in token.finditer(text or ""):
            t = m.group()
            if t in "{[":
                begin = m.start() if begin is None else begin
                stack.append(t)
            elif t in pair and stack:
                if stack.pop() != pair[t]:
                    return None
                if not stack:
                    return text[begin : m.end()]
        return None

    return texts.map(one)


def to_sign(value) -> Column:
    """+1 or -1, null for anything else."""
    v = F.trim(_c(value).cast("string")).try_cast("double")
    return F.when(v == 1, 1).when(v == -1, -1)


def decisions(answers: DataFrame, raw: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """``row_id, column, decision``: the valid decisions of every answer; others drop out. No Python on this path."""
    parsed = F.from_json(outermost(raw), DECISIONS)
    rows = answers.select(*keep, F.explode(parsed["feature_decisions"]).alias("d"))
    return rows.select(*keep, F.col("d.row_id").alias("row_id"), F.col("d.column").alias("column"), to_sign("d.decision").alias("decision")).where("decision IS NOT NULL")


def single_decision(text) -> Column:
    """One decision from a bare number, a named key, a map with one entry or a list; from 1 on it is +1, else -1; null if there is none."""
    t = strip_fences(strip_thinking(text))
    named = [F.get_json_object(t, f"$.{k}") for k in NAMED_KEYS] + [F.get_json_object(t, "$['0']"), F.get_json_object(t, "$[0]")]
    one = F.element_at(F.map_values(F.from_json(t, "map<string,string>")), 1)
    bare = F.nullif(F.regexp_extract(t, r"^\s*([+-]?\d+(?:\.\d+)?)\s*$", 1), F.lit(""))
    v = F.coalesce(bare, *named, one)
    low = F.lower(v)
    num = F.when(low.isin("true", "intentional", "yes"), 1.0).when(low.isin("false", "unintentional", "no"), -1.0).otherwise(v.try_cast("double"))
    return F.when(num >= 1, 1).when(num.isNotNull(), -1)


def triplet_decisions(text) -> Column:
    """Decisions of a group as an array of +1, -1 or null, from a list of objects, a list of scalars or a map by place."""
    t = outermost(text)
    objects = F.from_json(t, "array<struct<decision: string, intent: string, label: string>>")
    scalars = F.from_json(t, "array<string>")
    by_key = F.map_values(F.from_json(t, "map<string,string>"))
    from_objects = F.transform(objects, lambda o: to_sign(F.coalesce(o["decision"], o["intent"], o["label"])))
    useful = F.exists(from_objects, lambda x: x.isNotNull())
    flat = lambda a: F.transform(a, to_sign)
    return F.when(useful, from_objects).when(t.startswith("["), flat(scalars)).otherwise(flat(by_key))


def nested_decisions(answers: DataFrame, raw: str, columns: list[str], keep: tuple[str, ...]) -> DataFrame:
    """``group, row, column, decision`` of group -> row -> column maps: unknown columns drop out, missing ones are -1, a malformed answer gives nothing."""
    parsed = F.from_json(outermost(raw), "map<string, map<string, map<string, string>>>", {"mode": "PERMISSIVE"})
    g = answers.select(*keep, F.explode(parsed).alias("group", "rows"))
    r = g.select(*keep, "group", F.explode("rows").alias("row", "cells"))
    cells = r.select(*keep, "group", "row", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), to_sign(F.col("cells")[c]).alias("decision")) for c in columns])).alias("x"))
    return cells.select(*keep, "group", "row", "x.column", F.coalesce("x.decision", F.lit(-1)).alias("decision"))


def with_defaults(keys: DataFrame, found: DataFrame, on: list[str], default: int = -1) -> DataFrame:
    """A decision for each key: the found one (greatest on repeats) or the default."""
    best = found.groupBy(*on).agg(F.max("decision").alias("decision"))
    return keys.join(best, on, "left").withColumn("decision", F.coalesce("decision", F.lit(default)))


def prompt_payload(changes: DataFrame, key: str = "row_idx", chunk: int = 7) -> DataFrame:
    """``chunk_no, payload``: JSON of records with their changed features; records are chunked by number."""
    record = changes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("col_name").alias("column"), "value"))).alias("changed"))
    number = F.floor(F.col(key) / chunk).alias("chunk_no")
    return record.groupBy(number).agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col(key).alias("row_id"), "changed")))).alias("payload"))


def chat_prompt(system: str, user) -> Column:
    return F.concat(F.lit(f"<|system|>\n{system}\n<|user|>\n"), _c(user), F.lit("\n<|assistant|>\n"))


def suspicion_mask(answers: DataFrame, parsed: str = "suspicion", tau: float = 0.5, fallback: float = 0.5) -> DataFrame:
    """``suspicion`` (the fallback where parsing failed) and ``y_pred``: flagged from tau on, and always where it failed."""
    v = F.col(parsed)
    return answers.withColumns({"y_pred": F.when(v.isNull() | (v >= tau), 1).otherwise(0), parsed: F.coalesce(v, F.lit(fallback))})


def status_counts(answers: DataFrame, status: str = "status") -> DataFrame:
    return answers.groupBy(status).agg(F.count("*").alias("n"))


def pending(chunks: DataFrame, done: DataFrame, key: str = "chunk_no") -> DataFrame:
    """Chunks without a usable answer in the log."""
    return chunks.join(done.where("raw IS NOT NULL AND raw <> ''").select(key), key, "left_anti")
