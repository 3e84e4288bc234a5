"""Sources and sinks: typed and untyped CSV, JSON documents, answer logs, configuration, reports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Typed CSV with a header; without a schema types are inferred (a second scan). ``columns`` prunes the scan."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.select(*columns) if columns else df


def read_csv_text(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as text; empty fields stay empty and nothing is read as null."""
    df = spark.read.option("header", True).option("inferSchema", False).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    df = df.na.fill("")
    return df.select(*columns) if columns else df


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents that span lines."""
    return spark.read.option("multiLine", True).json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files, one row each."""
    return spark.read.text(path, wholetext=True)


ANSWER = "chunk_no long, raw string, status string"


def read_log(spark: SparkSession, path: str, schema: str = ANSWER, key: str = "chunk_no") -> DataFrame:
    """The answer log without empty, broken and cut lines; one row for each key."""
    df = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.where(F.col("_corrupt").isNull() & F.col(key).isNotNull()).drop("_corrupt").dropDuplicates([key])


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Metrics as JSON lines; NaN becomes null."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*clean).write.mode("overwrite").json(path)


def markdown(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A report table of at most ``limit`` rows (a report is for reading)."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return f"# {title}\n\n{head}\n" + "".join("| " + " | ".join(map(cell, r)) + " |\n" for r in rows)


DEFAULT_CONFIG = {"contamination": 0.05, "voting_share": 0.5, "seeds": 5, "detectors": {"statistical": 1.0, "lof": 1.0, "forest": 1.0}, "sampling_rate": 0.01}


def config(text: str | None = None) -> dict:
    """Settings: the defaults under those of a JSON text or a flat ``key: value`` one."""
    given: dict = {}
    if text and text.lstrip().startswith("{"):
        given = json.loads(text)
    elif text:
        for line in text.splitlines():
            key, sep, value = line.partition(":")
            if sep and not line.lstrip().startswith("#"):
                try:
                    given[key.strip()] = json.loads(value.strip())
                except ValueError:
                    given[key.strip()] = value.strip()
    return DEFAULT_CONFIG | given


class Scorer:
    """A language model's place in the flow: ``call(prompt) -> answer``, tried a bounded number of times, then the next tier.

    The model is outside of the engine; a deterministic stub stands in for it.
    """

    def __init__(self, *tiers: Callable[[str], str], attempts: int = 3):
        self.tiers, self.attempts = tiers or (stub_answer,), attempts

    def __call__(self, prompt: str) -> str | None:
        for tier in self.tiers:
            for _ in range(self.attempts):
                try:
                    return tier(prompt)
                except Exception:  # noqa: BLE001  any failure of a remote model counts as an attempt
                    continue
        return None

    def run(self, prompts: DataFrame, prompt: str = "prompt") -> DataFrame:
        """``raw`` and ``status`` for every prompt, in Arrow batches."""
        score = self

        def go(batches):
            for pdf in batches:
                pdf["raw"] = [score(p) for p in pdf[prompt]]
                pdf["status"] = ["ok" if r else "failed" for r in pdf["raw"]]
                yield pdf

        schema = T.StructType([f for f in prompts.schema.fields if f.name not in ("raw", "status")] + [T.StructField("raw", T.StringType()), T.StructField("status", T.StringType())])
        return prompts.mapInPandas(go, schema)


def stub_answer(prompt: str) -> str:
    """+1 or -1 by the number of bytes."""
    return json.dumps({"decision": 1 if len(prompt.encode()) % 2 == 0 else -1})


class Registry:
    """Named datasets: factories of (spark, root) -> frames ``dirty``, ``clean``, ``mask``."""

    def __init__(self):
        self.loaders: dict[str, Callable] = {}
        self.settings: dict[str, dict] = {}

    def register(self, name: str, loader: Callable, target: str | None = None, pairs: tuple = (), sensitive: tuple = ()) -> None:
        self.loaders[name] = loader
        self.settings[name] = {"target": target, "pairs": pairs, "sensitive": sensitive}

    def load(self, name: str, spark: SparkSession, root: str) -> dict[str, DataFrame]:
        return self.loaders[name](spark, root)

    def load_all(self, spark: SparkSession, root: str) -> dict[str, dict[str, DataFrame]]:
        return {n: self.load(n, spark, root) for n in self.loaders}


def csv_triple(name: str) -> Callable:
    """Loader of ``dirty.csv``, ``clean.csv`` and ``mask.csv`` under ``root/name``."""
    return lambda spark, root: {k: read_csv(spark, f"{root}/{name}/{k}.csv") for k in ("dirty", "clean", "mask")}
