"""Scoring of a stream of dirty rows with statistics fitted on a table: every micro-batch runs the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.functions import numbers as N
from cellsight.operators import cells as C


def score_cells(stream: DataFrame, columns: list[str], masks: dict[str, str], statistics: DataFrame) -> DataFrame:
    """Range and distribution scores of flagged numeric cells. Stateless, so it works on streams and tables alike; the statistics have a row for each column."""
    cells = C.errors(C.unpivot(stream, columns, masks=masks))
    joined = cells.join(F.broadcast(statistics.where("col_type = 'num'")), "col_name")
    x = N.number("value")
    return joined.select("row_idx", "col_name", F.coalesce(x.between(F.col("p5"), F.col("p95")), F.lit(False)).cast("int").alias("h1_plausible"), N.centrality(x, "mean", "std_pop").alias("h3_distribution_score"))


def start(stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Run ``score`` on each micro-batch and append to Parquet under ``sink``; a batch that is run again overwrites its own folder."""
    def batch(df: DataFrame, number: int) -> None:
        score(df).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
