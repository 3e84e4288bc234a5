"""Forests whose bags follow from a hash of row and tree, so each row is scored by the trees that lack it (out of bag)."""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsight.operators.models import PredictorBank
from cellsight.operators.storage import settled

#: Draws of one row in a bag beyond which no more are counted (a chance of one in ten thousand).
MOST = 6


def draws(key: str, tree: int, seed: int = 42) -> Column:
    """How often a row is in a tree's bag: Poisson with mean 1, from a hash; a bag of n rows drawn with replacement tends to it."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(tree), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    upto = F.array(*[F.lit(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(MOST)])
    return F.size(F.filter(upto, lambda c: u >= c))


class BaggedForest:
    """Trees fitted one by one on their own bags. ``classes`` (codes from 0) makes them classifiers, None regressors. Keys must not be null."""

    def __init__(self, features: list[str], label: str, classes: int | None = None, trees: int = 50, depth: int = 8, bins: int = 32, seed: int = 42, key: str = "row_idx"):
        self.features, self.label, self.classes, self.n, self.depth, self.bins, self.seed, self.key = features, label, classes, trees, depth, bins, seed, key
        self.trees: list = []

    def fit(self, rows: DataFrame) -> "BaggedForest":
        data = settled(VectorAssembler(inputCols=self.features, outputCol="__v").transform(rows).select(self.key, "__v", self.label))
        kind, subset = (RandomForestRegressor, "onethird") if self.classes is None else (RandomForestClassifier, "sqrt")
        for i in range(self.n):
            bag = data.withColumn("__w", draws(self.key, i, self.seed).cast("double")).where("__w > 0")
            forest = kind(featuresCol="__v", labelCol=self.label, weightCol="__w", numTrees=1, bootstrap=False, featureSubsetStrategy=subset, maxDepth=self.depth, maxBins=self.bins, seed=self.seed + i)
            self.trees.append(forest.fit(bag))
        return self

    def answers(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``__t0, __t1, ..``: each tree's value, or its array of a chance for each class."""
        out = VectorAssembler(inputCols=self.features, outputCol="__v").transform(rows)
        for i, t in enumerate(self.trees):
            out = t.transform(out)
            if self.classes is None:
                out = out.withColumnRenamed("prediction", f"__t{i}")
            else:
                p = F.concat(vector_to_array("probability"), F.array_repeat(F.lit(0.0), self.classes))  # a bag may lack the last classes
                out = out.withColumn(f"__t{i}", F.slice(p, 1, self.classes)).drop("rawPrediction", "probability", "prediction")
        return out.drop("__v")

    def _judged(self, rows: DataFrame, use: list[Column]) -> DataFrame:
        """``rows`` with ``n_trees`` that are used and their mean value, or class of the greatest total chance (ties: the least code); null without any."""
        heard = F.filter(F.array(*[F.when(u, F.col(f"__t{i}")) for i, u in enumerate(use)]), lambda a: a.isNotNull())
        if self.classes is None:
            total = F.aggregate("__heard", F.lit(0.0), lambda s, a: s + a)
            return self.answers(rows).withColumn("__heard", heard).withColumns({"n_trees": F.size("__heard"), "expected": total / F.nullif(F.size("__heard"), F.lit(0))})
        total = F.aggregate("__heard", F.array_repeat(F.lit(0.0), self.classes), lambda s, a: F.zip_with(s, a, lambda x, y: x + y))
        out = self.answers(rows).withColumn("__heard", heard).withColumns({"n_trees": F.size("__heard"), "__total": total})
        return out.withColumn("expected", F.when(F.col("n_trees") > 0, F.array_position("__total", F.array_max("__total")) - 1).cast("double"))

    def predict(self, rows: DataFrame) -> DataFrame:
        """``key, expected`` by all trees."""
        return self._judged(rows, [F.lit(True)] * len(self.trees)).select(self.key, "expected")

    def out_of_bag(self, rows: DataFrame) -> DataFrame:
        """``key, observed, expected, n_trees`` of fitted rows by the trees whose bags lack them."""
        lacking = [draws(self.key, i, self.seed) == 0 for i in range(len(self.trees))]
        return self._judged(rows, lacking).select(self.key, F.col(self.label).alias("observed"), "expected", "n_trees")

    def error(self, rows: DataFrame) -> float | None:
        """Share of wrong classes, or the squared error over the squared deviation from the mean; None if every row is in every bag."""
        p = self.out_of_bag(rows)
        if self.classes is not None:
            return p.agg(F.avg((F.col("observed") != F.col("expected")).cast("double"))).first()[0]
        left, spread = p.agg(F.avg(F.pow(F.col("observed") - F.col("expected"), 2)), F.var_pop(F.when(F.col("expected").isNotNull(), F.col("observed")))).first()
        return None if left is None else float(left / spread) if spread else float(left > 0)


def bag_of(bank: PredictorBank, column: str, trees: int | None = None, depth: int | None = None) -> tuple[BaggedForest, DataFrame]:
    """A column's predictor as a bagged forest, fitted on the rows that the bank was fitted on, and those rows."""
    label, text = f"__e_{column}", bank.types[column] == "cat"
    rows = bank.train.where(F.col(label) >= 0) if text else bank.train
    forest = BaggedForest([f"__e_{o}" for o in bank.types if o != column], label, bank.sizes[column] if text else None, trees or bank.trees, depth or bank.depth, bank.bins, bank.seed)
    return forest.fit(rows), rows


def out_of_bag_errors(bank: PredictorBank, trees: int | None = None) -> dict[str, float | None]:
    """Error of each predictor of a bank on the rows it was fitted on, each judged by the trees that lack it."""
    out = {}
    for c in bank.models:
        forest, rows = bag_of(bank, c, trees)
        out[c] = forest.error(rows)
    return out
