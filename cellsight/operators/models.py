"""Forests: intent classifier, per-column predictors (coherence, imputation) and importances."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.functions import numbers as N
from cellsight.operators import cells as C
from cellsight.operators.encode import label_codes
from cellsight.operators.metrics import weighted_f1
from cellsight.operators.information import of_numbers, with_class
from cellsight.operators.order import column_quantiles, numbered, quantiles
from cellsight.operators.sampling import folds
from cellsight.operators.storage import settled

MAX_CATEGORIES, MIN_CLEAN = 200, 50
#: Clean rows, by hash, that a bank's forests are fitted on unless told otherwise.
TRAINING_ROWS = 50_000
BINS = 32


class IntentModel(Model):
    """A fitted classifier; with one class it is a constant."""

    def __init__(self, columns, forest=None, constant=None):
        super().__init__()
        self.columns, self.forest, self.constant = columns, forest, constant

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.forest is None:
            return df.withColumns({"y_pred": F.lit(self.constant), "proba": F.lit(1.0 if self.constant == 1 else 0.0)})
        rows = VectorAssembler(inputCols=self.columns, outputCol="__v", handleInvalid="keep").transform(df)
        out = self.forest.transform(rows)
        p = vector_to_array("probability")[1]
        return out.withColumns({"proba": p, "y_pred": F.when(F.col("prediction") == 1, 1).otherwise(-1)}).drop("__v", "rawPrediction", "probability", "prediction")

    def importances(self) -> dict[str, float]:
        return dict(zip(self.columns, map(float, self.forest.featureImportances.toArray()))) if self.forest is not None else {c: 0.0 for c in self.columns}

    def explain(self, df: DataFrame) -> DataFrame:
        """Predictions with every feature's importance beside its value."""
        return self.transform(df).withColumns({f"importance_{c}": F.lit(v) for c, v in self.importances().items()})


class IntentClassifier(Estimator):
    """Random forest with balanced class weights, n / (classes * n_class)."""

    def __init__(self, columns: list[str], label: str = "intent", trees: int = 200, depth: int = 15, seed: int = 42):
        super().__init__()
        self.columns, self.label, self.trees, self.depth, self.seed = columns, label, trees, depth, seed

    def _fit(self, df: DataFrame) -> IntentModel:
        counts = {r[0]: r[1] for r in df.groupBy(self.label).count().collect()}
        if len(counts) < 2:
            return IntentModel(self.columns, constant=next(iter(counts), 1))
        n = sum(counts.values())
        weight = F.when(F.col(self.label) == 1, n / (2 * counts.get(1, 1))).otherwise(n / (2 * max(1, n - counts.get(1, 0))))
        rows = VectorAssembler(inputCols=self.columns, outputCol="__v", handleInvalid="keep").transform(df.withColumns({"__y": (F.col(self.label) == 1).cast("double"), "__w": weight}))
        forest = RandomForestClassifier(featuresCol="__v", labelCol="__y", weightCol="__w", numTrees=self.trees, maxDepth=self.depth, minInstancesPerNode=2, seed=self.seed).fit(rows)
        return IntentModel(self.columns, forest)


def cross_validate(df: DataFrame, columns: list[str], label: str = "intent", k: int = 5, trees: int = 50, depth: int = 8) -> DataFrame:
    """Figures of stratified folds: one fit for each."""
    dealt = settled(folds(df, label, k))
    parts = []
    for i in range(k):
        model = IntentClassifier(columns, label, trees, depth).fit(dealt.where(F.col("fold") != i))
        parts.append(model.transform(dealt.where(F.col("fold") == i)).select("fold", F.col(label).alias("y_true"), "y_pred"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return weighted_f1(out, by=["fold"])


def encoded(wide: DataFrame, types: dict[str, str], key: str = "row_idx") -> tuple[DataFrame, dict[str, int]]:
    """Columns as numbers: values, or codes in order of value (unknown -1), and the number of categories of text columns."""
    out, sizes = wide, {}
    for c, t in types.items():
        if t == "num":
            out = out.withColumn(f"__e_{c}", N.number(F.col(f"`{c}`").cast("string")))
        else:
            codes = label_codes(wide, f"`{c}`").select(F.col("value").alias("__val"), F.col("code").cast("double").alias(f"__e_{c}"))
            sizes[c] = codes.count()
            out = out.join(codes, F.col(f"`{c}`").cast("string") == F.col("__val"), "left").drop("__val")
    return out.na.fill(-1.0, [f"__e_{c}" for c, t in types.items() if t == "cat"]), sizes


class PredictorBank:
    """A forest for each column from all others, fitted on at most ``training_rows`` clean rows (by hash; None: all). Every row is predicted."""

    def __init__(self, types: dict[str, str], trees: int = 50, depth: int = 8, seed: int = 42, training_rows: int | None = TRAINING_ROWS):
        self.types, self.trees, self.depth, self.seed, self.training_rows = types, trees, depth, seed, training_rows

    def fit(self, wide: DataFrame, masks: dict[str, str]) -> "PredictorBank":
        coded, self.sizes = encoded(wide, self.types)
        names = [f"__e_{c}" for c in self.types]
        dirty = sum((F.abs(F.col(m)) for m in masks.values()), F.lit(0))
        self.fill = {n: float(q[0] if q[0] is not None else 0.0) for n, q in column_quantiles(coded, names, [0.5]).items()}
        self.coded = settled(coded.na.fill(self.fill).withColumn("__dirty", (dirty > 0).cast("int")))
        clean = self.coded.where("__dirty = 0")
        n = self.coded.count()
        if clean.count() < max(MIN_CLEAN, n // 20):
            clean = self.coded
        self.bins = max(BINS, *[s + 1 for s in self.sizes.values()] or [0])
        self.train = train = settled(clean.orderBy(F.xxhash64("row_idx", F.lit(self.seed))).limit(self.training_rows) if self.training_rows else clean)
        self.models, self.std = {}, {}
        for c, t in self.types.items():
            others = [f"__e_{o}" for o in self.types if o != c]
            if not others or t == "cat" and not 1 < self.sizes[c] <= MAX_CATEGORIES:
                continue
            rows = VectorAssembler(inputCols=others, outputCol="__v").transform(train.where(F.col(f"__e_{c}") >= 0) if t == "cat" else train)
            kind = RandomForestClassifier if t == "cat" else RandomForestRegressor
            self.models[c] = kind(featuresCol="__v", labelCol=f"__e_{c}", numTrees=self.trees, maxDepth=self.depth, seed=self.seed, maxBins=self.bins).fit(rows)
            self.std[c] = float(train.agg(F.stddev_pop(f"__e_{c}")).first()[0] or 0.0)
        return self

    def predict(self, column: str, rows: DataFrame | None = None) -> DataFrame:
        """``row_idx, observed, expected, probability, sigma`` for a column (``sigma``: spread of its trees)."""
        others = [f"__e_{o}" for o in self.types if o != column]
        rows = VectorAssembler(inputCols=others, outputCol="__v").transform(rows if rows is not None else self.coded)
        model = self.models[column]
        out = model.transform(rows)
        if self.types[column] == "cat":
            p = vector_to_array("probability")
            own = F.col(f"__e_{column}").cast("int")
            prob = F.when((own >= 0) & (own < F.size(p)), F.element_at(p, own + 1)).otherwise(0.0)
            return out.select("row_idx", F.col(f"__e_{column}").alias("observed"), F.col("prediction").alias("expected"), prob.alias("probability"), (1 - F.array_max(p)).alias("sigma"))
        each = [t.setPredictionCol(f"__t{i}") for i, t in enumerate(model.trees)]
        for t in each:
            out = t.transform(out)
        spread = F.array(*[F.col(f"__t{i}") for i in range(len(each))])
        mean = F.aggregate(spread, F.lit(0.0), lambda a, x: a + x) / len(each)
        sigma = F.sqrt(F.aggregate(spread, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / len(each))
        return out.select("row_idx", F.col(f"__e_{column}").alias("observed"), F.col("prediction").alias("expected"), F.lit(None).cast("double").alias("probability"), sigma.alias("sigma"))


def h4_coherence(bank: PredictorBank, flagged: DataFrame) -> DataFrame:
    """``h4_coherence_score``: probability of the value, or 1 - min(1, |residual| / (3 sd)) for numbers; 0.5 without a model, 1 for a constant column."""
    flagged = settled(flagged.select("row_idx", "col_name"))
    rows = settled(bank.coded.join(flagged.select("row_idx").distinct(), "row_idx", "left_semi"))  # only these are predicted
    parts = []
    for c, t in bank.types.items():
        own = flagged.where(F.col("col_name") == c)
        if c not in bank.models:
            parts.append(own.withColumn("h4_coherence_score", F.lit(0.5)))
            continue
        p = bank.predict(c, rows.join(own.select("row_idx"), "row_idx", "left_semi"))
        sd = bank.std[c]
        s = F.col("probability") if t == "cat" else F.lit(1.0) if sd == 0 else N.clip(1 - F.abs(F.col("observed") - F.col("expected")) / F.lit(3 * sd), 0.0, 1.0)
        parts.append(own.join(p.select("row_idx", s.alias("h4_coherence_score")), "row_idx"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def h6_importance(cells: DataFrame, target: str | None, types: DataFrame) -> DataFrame:
    """``col_name, h6_column_importance``: nearest-neighbour mutual information with the target over the greatest.

    Columns are numbers: their values (the median for what doesn't parse), or codes of the values of text in order. A target of
    text is a class, one of numbers a number. Without a target a column takes its greatest information with any other. Fewer
    than ten clean rows give 0.
    """
    kinds = {r["col_name"]: r["col_type"] for r in types.collect()}
    clean = settled(cells.join(C.clean_rows(cells), "row_idx", "left_semi").where(F.col("col_name").isin(list(kinds))).select("row_idx", "col_name", F.coalesce("value", F.lit("")).alias("value")))
    spark = cells.sparkSession
    targets = [target] if target else list(kinds)
    found: dict[str, float] = {c: 0.0 for c in kinds if c != target}
    if clean.select("row_idx").distinct().limit(10).count() >= 10:
        num = [c for c, t in kinds.items() if t == "num"]
        values = clean.where(F.col("col_name").isin(num)).withColumn("x", N.number("value"))
        middle = quantiles(values, ["col_name"], "x", [0.5]).select("col_name", F.col("q")[0].alias("middle"))
        numbers = values.join(F.broadcast(middle), "col_name", "left").select("row_idx", "col_name", F.coalesce("x", "middle", F.lit(0.0)).alias("x"))
        text = clean.where(~F.col("col_name").isin(num))
        codes = numbered(text.select("col_name", "value").distinct(), ["col_name"], ["value"], "code")
        coded = text.join(codes, ["col_name", "value"]).select("row_idx", "col_name", F.col("code").cast("double").alias("x"))
        data = settled(numbers.union(coded))
        for t in targets:
            own = data.where(F.col("col_name") == t).select("row_idx", F.col("x").alias("y"))
            peers = data.where(F.col("col_name") != t).join(own, "row_idx")
            if kinds[t] == "num":
                got = {c: of_numbers(peers.where(F.col("col_name") == c).select("x", "y")) for c in kinds if c != t}
            else:
                got = {r["pair"]: r["mi"] for r in with_class(peers.select(F.col("col_name").alias("pair"), F.col("y").alias("label"), "x")).collect()}  # a row for each column
            if target:
                found |= got
            else:
                found[t] = max(got.values(), default=0.0)
    top = max(found.values(), default=0.0)
    rows = [(c, v / top if top > 0 else 0.0) for c, v in found.items()] + ([(target, 1.0)] if target else [])
    return spark.createDataFrame(rows, "col_name string, h6_column_importance double")


def impute_cells(bank: PredictorBank, flagged: DataFrame, rounds: int = 5, tol: float = 1e-3, errors: dict[str, float | None] | None = None) -> DataFrame:
    """``row_idx, col_name, imputed, sigma, confidence, mice_rounds`` of flagged cells (codes for text), and ``sigma_oob`` from given ``errors`` of columns.

    Each round predicts every flagged cell from the row with the last round's values in place; rows end when no value moves by
    more than ``tol`` of itself. Every round is checkpointed.
    """
    k = ["row_idx", "col_name"]
    flagged = settled(flagged.where(F.col("col_name").isin(list(bank.models))).select(*k))
    rows = current = settled(bank.coded.join(flagged.select("row_idx").distinct(), "row_idx", "left_semi"))  # only these are predicted
    last = None
    for r in range(1, rounds + 1):
        parts = []
        for c in bank.models:
            own = flagged.where(F.col("col_name") == c)
            p = bank.predict(c, current.join(own.select("row_idx"), "row_idx", "left_semi"))
            parts.append(own.join(p.select("row_idx", F.col("expected").alias("imputed"), "sigma"), "row_idx"))
        now = parts[0].select(*k, "imputed", "sigma")
        for x in parts[1:]:
            now = now.unionByName(x.select(*k, "imputed", "sigma"))
        now = settled(now.withColumn("mice_rounds", F.lit(r)))
        if last is not None:
            was = last.select(*k, F.col("imputed").alias("was"), F.col("mice_rounds").alias("ended"))
            j = now.join(was, k)
            moved = F.abs(F.col("imputed") - F.col("was")) > F.lit(tol) * (F.abs("was") + 1e-9)
            now = settled(j.select(*k, "imputed", "sigma", F.when(moved, F.lit(r)).otherwise(F.col("ended")).alias("mice_rounds"), moved.alias("moved")))
            if not now.where("moved").limit(1).count():
                last = now.drop("moved")
                break
            now = now.drop("moved")
        last = now
        filled = now.groupBy("row_idx").pivot("col_name", list(bank.models)).agg(F.first("imputed"))
        base = rows.join(filled.select("row_idx", *[F.col(f"`{c}`").alias(f"__i_{c}") for c in bank.models]), "row_idx", "left")
        current = settled(base.withColumns({f"__e_{c}": F.coalesce(F.col(f"__i_{c}"), F.col(f"__e_{c}")) for c in bank.models}).drop(*[f"__i_{c}" for c in bank.models]))
    out = last.withColumn("confidence", N.confidence("sigma"))
    if errors is None:
        return out
    table = bank.coded.sparkSession.createDataFrame(list(errors.items()), "col_name string, sigma_oob double")
    return out.join(F.broadcast(table), "col_name", "left").select(*out.columns, "sigma_oob")  # a row for each column


def mean_importances(bank: PredictorBank) -> dict[str, float]:
    """Mean importance of each column over the predictors of the others."""
    total: dict[str, list[float]] = {c: [] for c in bank.types}
    for c, m in bank.models.items():
        for o, v in zip([o for o in bank.types if o != c], m.featureImportances.toArray()):
            total[o].append(float(v))
    return {c: sum(v) / len(v) if v else 0.0 for c, v in total.items()}
