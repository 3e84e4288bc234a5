"""Whole runs: features of a scenario, seeds, training, prediction and metrics; ablations; answers of a language model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.functions import decisions as D
from cellsight.operators import cells as C
from cellsight.operators import heuristics as H
from cellsight.operators import models as M
from cellsight.operators import reference_values as R
from cellsight.operators import rules as RU
from cellsight.operators import sampling as S
from cellsight.operators.cluster import CLUSTERINGS
from cellsight.operators.encode import Scaler
from cellsight.operators.metrics import weighted_f1
from cellsight.operators.storage import settled, stored
from cellsight.sources.io import Scorer

#: Feature groups left out one at a time.
ABLATIONS = {"all": (), **{f"without_h{i}": (f"h{i}_",) for i in (1, 2, 3, 4, 5, 8)}}
SCENARIOS = {"B": ("heuristic",), "B+": ("heuristic", "statistics"), "C": ("rules",), "BC": ("heuristic", "rules"), "B+C": ("heuristic", "statistics", "rules")}


def feature_table(wide: DataFrame, masks: dict[str, str], scenario: str = "B", clean: DataFrame | None = None, rules: list | None = None, target: str | None = None, pairs: set | None = None, bank: M.PredictorBank | None = None, sensitive: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Features of the scenario's groups, joined on the cell, with its intent. Statistics need the clean table, rules their list."""
    groups = SCENARIOS[scenario]
    C.require("statistics" not in groups or clean is not None, f"{scenario} needs the clean table")
    C.require("rules" not in groups or rules is not None, f"{scenario} needs rules")
    columns = list(masks)
    cells = stored(C.unpivot(wide, columns, masks=masks))  # read by every feature, with its filters and columns
    parts, names = [], []
    if "heuristic" in groups:
        types = settled(C.detect_types(cells).select("col_name", "col_type"))
        extra = [M.h4_coherence(bank, C.errors(cells))] if bank else []
        importance = M.h6_importance(cells, target, types)
        extra.append(C.errors(cells).select("row_idx", "col_name").join(F.broadcast(importance), "col_name", "left"))
        parts.append(H.complete(H.assemble(cells, target, pairs, sensitive, extra), list(H.FEATURES)))
        names += H.FEATURES
    if "statistics" in groups:
        s = R.change_statistics(C.paired_cells(C.unpivot(clean, columns), cells), columns)
        parts.append(s)
        names += [c for c in s.columns if c.startswith("stat_")]
    if "rules" in groups:
        s = RU.signals(wide, rules, masks, columns=[*columns])
        parts.append(s)
        names += [c for c in s.columns if c not in ("row_idx", "col_name")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, ["row_idx", "col_name"])
    return C.attach_labels(out, cells).withColumns({n: F.col(n).cast("double") for n in names}), names


def clustered_seeds(keyed: DataFrame, names: list[str], clustering: str, rate: float, rule: Callable[[dict, int], dict] = S.without_floor) -> DataFrame:
    """Seed cells by cluster: standardised features (nulls 0) are clustered and every cluster but noise gives its share.

    A clustering that finds noise only leaves uniform seeds.
    """
    filled = keyed.select("cell", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
    scaled = Scaler("standard").fit(filled, names).transform(filled)
    vectors = settled(scaled.select(F.xxhash64("cell").alias("id"), F.array(*names).alias("v")))
    found = settled(CLUSTERINGS[clustering](vectors))
    own = keyed.withColumn("__id", F.xxhash64("cell")).join(found.select(F.col("id").alias("__id"), "cluster"), "__id").drop("__id")
    seeds = S.proportional(own, rate, rule, key="cell").drop("cluster")
    return S.uniform(keyed, rate, key="cell") if seeds.isEmpty() else seeds


def run_scenario(features: DataFrame, names: list[str], rate: float = 0.01, trees: int = 50, depth: int = 8, clustering: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Predictions of the cells that are no seeds, and their metrics. Seeds are uniform, or drawn by the clusters of a name in ``CLUSTERINGS``."""
    keyed = settled(features.withColumn("cell", F.concat_ws(":", "row_idx", "col_name")))
    seeds = settled(clustered_seeds(keyed, names, clustering, rate) if clustering else S.uniform(keyed, rate, key="cell"))
    model = M.IntentClassifier(names, trees=trees, depth=depth).fit(seeds)
    rest = keyed.join(seeds.select("cell"), "cell", "left_anti")
    out = settled(model.transform(rest).select("row_idx", "col_name", F.col("intent").alias("y_true"), "y_pred", "proba"))
    return out, weighted_f1(out)


def ablation(features: DataFrame, names: list[str], rate: float = 0.01, trees: int = 20) -> DataFrame:
    """``config, accuracy, f1_weighted, f1_macro`` with a feature group left out at a time."""
    out = None
    for label, gone in ABLATIONS.items():
        kept = [n for n in names if not n.startswith(gone)] if gone else names
        m = run_scenario(features, kept, rate, trees)[1].select(F.lit(label).alias("config"), "accuracy", "f1_weighted", "f1_macro")
        out = m if out is None else out.unionByName(m)
    return out


def model_attribution(changes: DataFrame, done: DataFrame | None = None, scorer: Scorer | None = None, system: str = "Decide for each cell.", examples: str = "") -> DataFrame:
    """``row_id, column, decision`` of every changed cell by a language model: chunks without an answer are asked, failures are -1.

    ``examples`` makes it few-shot; column descriptions in ``system`` make it informed.
    """
    chunks = D.prompt_payload(changes)
    todo = D.pending(chunks, done) if done is not None else chunks
    asked = (scorer or Scorer()).run(todo.withColumn("prompt", D.chat_prompt(system + ("\n" + examples if examples else ""), "payload")))
    log = asked.select("chunk_no", "raw") if done is None else asked.select("chunk_no", "raw").unionByName(done.select("chunk_no", "raw"))
    keys = changes.select(F.col("row_idx").alias("row_id"), F.col("col_name").alias("column"))
    return D.with_defaults(keys, D.decisions(log), ["row_id", "column"])
