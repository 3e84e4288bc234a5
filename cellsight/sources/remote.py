"""Language models behind HTTP: bounded attempts with growing pauses, and a log that keeps answered chunks from being asked again."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsight.sources.io import ANSWER, Scorer, append_log

#: Answers of a server that a later attempt may mend.
PASSING = (408, 425, 429, 500, 502, 503, 504)


class Refused(Exception):
    """The server refused the request for good."""


def generate_request(prompt: str, tokens: int = 1024) -> dict:
    return {"inputs": prompt, "parameters": {"max_new_tokens": tokens, "do_sample": False, "return_full_text": False}}


def generated_text(answer) -> str:
    """The text of an answer, an object or a list of one; KeyError if it has none."""
    first = answer[0] if isinstance(answer, list) and answer else answer
    if not isinstance(first, dict):
        raise KeyError("generated_text")
    return first["generated_text"]


class HttpModel:
    """``model(prompt) -> text`` of a server that takes and gives JSON.

    A passing fault (no connection, no answer within ``timeout`` seconds, a status of ``PASSING``, a body that doesn't parse) is
    followed by a pause of ``pause`` seconds times the attempt's number, or what the server asks for if that is longer, at most
    ``longest``. After ``attempts`` the last fault is raised; other statuses are ``Refused`` at once.
    """

    def __init__(self, url: str, request: Callable[[str], dict] = generate_request, text: Callable = generated_text, headers: dict | None = None, attempts: int = 6, timeout: float = 180, pause: float = 30, longest: float = 600):
        self.url, self.request, self.text, self.headers = url, request, text, dict(headers or {})
        self.attempts, self.timeout, self.pause, self.longest = max(1, attempts), timeout, pause, longest

    def __call__(self, prompt: str) -> str:
        body = json.dumps(self.request(prompt)).encode()
        for attempt in range(1, self.attempts + 1):
            asked = 0.0
            try:
                call = urllib.request.Request(self.url, body, {"Content-Type": "application/json", **self.headers})
                with urllib.request.urlopen(call, timeout=self.timeout) as got:
                    return self.text(json.loads(got.read()))
            except urllib.error.HTTPError as e:
                if e.code not in PASSING:
                    raise Refused(f"status {e.code}") from e
                fault, after = e, e.headers.get("Retry-After", "")
                asked = float(after) if after.replace(".", "", 1).isdigit() else 0.0
            except (OSError, ValueError, KeyError) as e:  # time-outs and refused connections are OSErrors
                fault = e
            if attempt == self.attempts:
                raise fault
            time.sleep(min(self.longest, max(asked, self.pause * attempt)))
        raise AssertionError


def read_answers(spark: SparkSession, path: str, key: str = "chunk_no") -> DataFrame:
    """``key, raw, status`` of the log: a good answer before failed ones. A log that isn't there is empty."""
    try:
        log = spark.read.schema(f"{ANSWER.replace('chunk_no', key)}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ANSWER.replace("chunk_no", key))
    whole = log.where(F.col("_corrupt").isNull() & F.col(key).isNotNull())
    best = F.max(F.struct((F.col("status") == "ok").alias("good"), F.col("raw").alias("raw"), F.col("status").alias("status"))).alias("b")
    return whole.groupBy(key).agg(best).select(key, "b.raw", "b.status")


def ask(prompts: DataFrame, scorer: Scorer, key: str = "chunk_no", prompt: str = "prompt", at_once: int = 8) -> DataFrame:
    """``key, raw, status`` of every prompt, ``at_once`` of them at a time in each task; a null prompt fails unasked."""

    def go(batches):
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                raw = list(pool.map(lambda p: None if p is None else scorer(p), pdf[prompt].tolist()))
                yield pdf[[key]].assign(raw=raw, status=["failed" if r is None else "ok" for r in raw])

    fields = [prompts.schema[key], T.StructField("raw", T.StringType()), T.StructField("status", T.StringType())]
    return prompts.select(key, prompt).mapInPandas(go, T.StructType(fields))


def answers(prompts: DataFrame, scorer: Scorer, path: str, key: str = "chunk_no", prompt: str = "prompt", slices: int = 16, at_once: int = 8) -> DataFrame:
    """``key, raw, status`` of every prompt (keys unique, not null), by the log in ``path`` where it has a good answer.

    Chunks are asked in ``slices``, each a job whose answers are committed to the log as a whole: a run that is broken off, by a
    lost driver too, asks only for the slices it hasn't committed, and one after it only for what is missing or has failed.
    """
    spark = prompts.sparkSession
    done = read_answers(spark, path, key).where("status = 'ok'").select(key)
    keys = prompts.select(key).join(done, key, "left_anti")
    slice_of = F.pmod(F.xxhash64(key), F.lit(slices))
    for i in [r[0] for r in keys.select(slice_of.alias("i")).distinct().orderBy("i").collect()]:  # at most ``slices``
        append_log(ask(prompts.where(slice_of == i).join(done, key, "left_anti"), scorer, key, prompt, at_once), path)
    return prompts.select(key).join(read_answers(spark, path, key), key, "left").withColumn("status", F.coalesce("status", F.lit("failed")))
