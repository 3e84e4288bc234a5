"""Record detectors as estimators: fitted figures that are saved, loaded and applied to other tables, and their weighted vote.

A fitted detector gives its score as an expression of a row's values, so a row is scored again with one cell replaced without
being copied, and a table, a batch of a stream or a whole ensemble takes one projection.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsight.operators.order import column_quantiles, quantile
from cellsight.operators.suspicion import WEIGHTS, combine, counterfactual_scores, deviation_scores, local_scores

Values = dict[str, Column]


def _values(columns: list[str]) -> Values:
    return {c: F.col(f"`{c}`").cast("double") for c in columns}


def _save(model: Model, path: str) -> None:
    """One line of JSON: figures of the columns, whose number the schema bounds."""
    SparkSession.active().createDataFrame([(json.dumps(model.state()),)], "value string").coalesce(1).write.mode("overwrite").text(path)


class DetectorModel(Model):
    """A fitted detector; ``flag`` is a score over ``cut``. Nulls and unfitted columns never speak against a record."""

    def __init__(self, kind: str, columns: list[str], figures: dict, cut: float | None, name: str | None = None):
        super().__init__()
        self.kind, self.columns, self.figures, self.cut, self.name = kind, columns, figures, cut, name or kind

    def state(self) -> dict:
        return {"kind": self.kind, "columns": self.columns, "figures": self.figures, "cut": self.cut, "name": self.name}

    def save(self, path: str) -> None:
        _save(self, path)

    def score(self, values: Values) -> Column:
        """The decision function: greatest |z|, number of columns outside the fences, or squared distance to the mean."""
        f, zero = self.figures, F.lit(0.0)
        if self.kind == "z":
            return F.greatest(zero, zero, *[F.coalesce(F.abs(values[c] - F.lit(m)) / F.lit(s), zero) for c, (m, s) in f.items() if s])
        if self.kind == "fences":
            return sum((F.coalesce(((values[c] < F.lit(lo)) | (values[c] > F.lit(hi))).cast("double"), zero) for c, (lo, hi) in f.items()), zero)
        d = [F.coalesce(values[c] - F.lit(m), zero) for c, m in zip(self.columns, f["mean"])]
        return sum((d[i] * d[j] * F.lit(f["inverse"][i][j]) for i in range(len(d)) for j in range(len(d))), zero)

    def flag(self, values: Values) -> Column:
        return F.coalesce((self.score(values) > F.lit(self.cut).cast("double")).cast("int"), F.lit(0))

    def _transform(self, df: DataFrame) -> DataFrame:
        v = _values(self.columns)
        return df.withColumns({f"{self.name}_score": self.score(v), f"{self.name}_flag": self.flag(v)})


class _Detector(Estimator):
    def __init__(self, columns: list[str], name: str | None = None):
        super().__init__()
        self.columns, self.name = list(columns), name


class ZDetector(_Detector):
    """Any |z| over ``z`` by the mean and population deviation of the fitted table."""

    def __init__(self, columns: list[str], z: float = 3.0, name: str | None = None):
        super().__init__(columns, name)
        self.z = z

    def _fit(self, df: DataFrame) -> DetectorModel:
        v = _values(self.columns)
        r = df.agg(*[F.avg(v[c]) for c in self.columns], *[F.stddev_pop(v[c]) for c in self.columns]).first()
        n = len(self.columns)
        return DetectorModel("z", self.columns, {c: [r[i] or 0.0, r[n + i] or 0.0] for i, c in enumerate(self.columns)}, self.z, self.name)


class FenceDetector(_Detector):
    """At least ``fences`` columns more than ``reach`` interquartile ranges outside the quartiles of the fitted table."""

    def __init__(self, columns: list[str], fences: int = 3, reach: float = 1.5, name: str | None = None):
        super().__init__(columns, name)
        self.fences, self.reach = fences, reach

    def _fit(self, df: DataFrame) -> DetectorModel:
        q = {c: v for c, v in column_quantiles(df, self.columns, [0.25, 0.75]).items() if v[0] is not None}
        return DetectorModel("fences", self.columns, {c: [a - self.reach * (b - a), b + self.reach * (b - a)] for c, (a, b) in q.items()}, self.fences - 0.5, self.name)


class MahalanobisDetector(_Detector):
    """Squared distance by the regularised covariance, over the ``percentile`` of the fitted table."""

    def __init__(self, columns: list[str], percentile: float = 99.0, ridge: float = 1e-6, name: str | None = None):
        super().__init__(columns, name)
        self.percentile, self.ridge = percentile, ridge

    def _fit(self, df: DataFrame) -> DetectorModel:
        v, n = _values(self.columns), len(self.columns)
        pairs = [(i, j) for i in range(n) for j in range(i, n)]
        r = df.agg(*[F.avg(v[c]) for c in self.columns], *[F.covar_pop(v[self.columns[i]], v[self.columns[j]]) for i, j in pairs]).first()
        cov = np.zeros((n, n))
        for at, (i, j) in enumerate(pairs):
            cov[i, j] = cov[j, i] = r[n + at] or 0.0
        model = DetectorModel("mahalanobis", self.columns, {"mean": [r[i] or 0.0 for i in range(n)], "inverse": np.linalg.inv(cov + self.ridge * np.eye(n)).tolist()}, None, self.name)
        model.cut = quantile(df.select(model.score(v).alias("score")), "score", self.percentile / 100)
        return model


class EnsembleModel(Model):
    """Fitted detectors and their weights; suspicious from ``share`` of the weight on."""

    def __init__(self, models: list[DetectorModel], weights: list[float], share: float = 0.5):
        super().__init__()
        self.models, self.weights, self.share = models, weights, share

    def state(self) -> dict:
        return {"models": [m.state() for m in self.models], "weights": self.weights, "share": self.share}

    def save(self, path: str) -> None:
        _save(self, path)

    def confidence(self, values: Values) -> Column:
        """Share of the weight of the detectors that flag these values."""
        return sum((m.flag(values) * F.lit(w) for m, w in zip(self.models, self.weights)), F.lit(0.0)) / sum(self.weights)

    def _transform(self, df: DataFrame) -> DataFrame:
        """``df`` with each detector's score and flag, ``vote_count``, ``confidence`` and ``is_suspicious``."""
        out = df
        for m in self.models:
            out = m.transform(out)
        flags = [F.col(f"{m.name}_flag") for m in self.models]
        got = sum((f * F.lit(w) for f, w in zip(flags, self.weights)), F.lit(0.0)) / sum(self.weights)
        return out.withColumns({"vote_count": sum(flags, F.lit(0)), "confidence": got, "is_suspicious": (got >= self.share).cast("int")})


class EnsembleDetector(Estimator):
    """Detectors fitted on one table, with weights (all 1 unless given). Names of detectors must differ."""

    def __init__(self, detectors: list[_Detector], weights: list[float] | None = None, share: float = 0.5):
        super().__init__()
        self.detectors, self.weights, self.share = detectors, [float(w) for w in weights or [1.0] * len(detectors)], share

    def _fit(self, df: DataFrame) -> EnsembleModel:
        models = [d.fit(df) for d in self.detectors]
        if len({m.name for m in models}) < len(models) or len(models) != len(self.weights):
            raise ValueError("detectors need names of their own and a weight each")
        return EnsembleModel(models, self.weights, self.share)


def load(spark: SparkSession, path: str) -> DetectorModel | EnsembleModel:
    """What ``save`` wrote."""
    s = json.loads(spark.read.text(path).first()[0])
    return EnsembleModel([DetectorModel(**m) for m in s["models"]], s["weights"], s["share"]) if "models" in s else DetectorModel(**s)


def attribute(model: EnsembleModel, rows: DataFrame, clean: DataFrame, cells: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """``row_idx, col_name, counterfactual, local, deviation, suspicion`` of every cell of ``rows`` (wide, numbers).

    Counterfactual: the drop of the ensemble's confidence when the cell takes its column's clean median. The detectors don't say
    which columns they judged by, so the validator's weight stays with 0. ``cells`` are those of the whole table with their masks.
    """
    typical = {c: q[0] if q[0] is not None else 0.0 for c, q in column_quantiles(clean, columns, [0.5]).items()}
    key = ["row_idx", "col_name"]
    counter, local = counterfactual_scores(rows, columns, typical, model.confidence), local_scores(rows, clean, columns, k)
    deviation = deviation_scores(cells).join(counter.select(*key), key, "left_semi")
    whole = combine({"counterfactual": counter, "local": local, "deviation": deviation}, WEIGHTS)
    return counter.join(local, key).join(deviation, key).join(whole, key)
