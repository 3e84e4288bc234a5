"""Encoders and scalers by plain expressions (population deviations) or Spark ML where it has the same rule."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.operators.order import column_quantiles, numbered


def _moments(df: DataFrame, columns: list[str]) -> dict:
    """A row of figures for each column, on the driver."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"), F.min(c).cast("double").alias(f"a_{c}"), F.max(c).cast("double").alias(f"z_{c}")]
    return df.agg(*aggs).first().asDict() | {f"q_{c}": q for c, q in column_quantiles(df, columns, [0.25, 0.5, 0.75]).items()}


class Scaler:
    """standard, minmax or robust; ``inverse`` undoes it."""

    def __init__(self, kind: str = "standard"):
        if kind not in ("standard", "minmax", "robust"):
            raise ValueError(kind)
        self.kind = kind

    def fit(self, df: DataFrame, columns: list[str]) -> "Scaler":
        m = _moments(df, columns)
        self.columns = columns
        self.shift, self.scale = {}, {}
        for c in columns:
            lo, mid, hi = m[f"q_{c}"] or (None, None, None)
            self.shift[c] = {"standard": m[f"m_{c}"], "minmax": m[f"a_{c}"], "robust": mid}[self.kind] or 0.0
            spread = {"standard": m[f"s_{c}"], "minmax": (m[f"z_{c}"] or 0) - (m[f"a_{c}"] or 0), "robust": (hi or 0) - (lo or 0)}[self.kind]
            self.scale[c] = spread or 1.0
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(self.shift[c])) / F.lit(self.scale[c]) for c in self.columns})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(self.scale[c]) + F.lit(self.shift[c]) for c in self.columns})


def one_hot(df: DataFrame, column: str, levels: list[str] | None = None, drop_first: bool = True, limit: int = 1000) -> DataFrame:
    """``column_level`` columns of trimmed values; the first level in order is dropped. More than ``limit`` levels are an error."""
    v = F.trim(F.col(column).cast("string"))
    if levels is None:
        levels = [r[0] for r in df.select(v.alias("v")).where("v IS NOT NULL").distinct().orderBy("v").limit(limit + 1).collect()]
        if len(levels) > limit:
            raise ValueError(f"{column} has more than {limit} levels")
    own = levels[1:] if drop_first else levels
    return df.select(*[c for c in df.columns if c != column], *[F.coalesce((v == x).cast("int"), F.lit(0)).alias(f"{column}_{x}") for x in own])


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """``value, code``: distinct values numbered from 0 in order."""
    values = df.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    return numbered(values, [], ["value"], "code").select("value", F.col("code").cast("int").alias("code"))


def label_encode(df: DataFrame, column: str, codes: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """Codes of a column; what the codes don't have is -1."""
    codes = codes if codes is not None else label_codes(df, column)
    joined = df.join(codes, df[column].cast("string") == codes["value"], "left")
    return joined.select(*df.columns, F.coalesce("code", F.lit(-1)).alias(name or f"{column}_code"))


def impute(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """Medians and modes (least on ties) in place of nulls."""
    modes = df.agg(F.lit(0).alias("__none"), *[F.mode(c, deterministic=True).alias(c) for c in text]).first().asDict()
    fill = {k: v for k, v in ({c: q[0] for c, q in column_quantiles(df, numeric, [0.5]).items()} | modes).items() if v is not None and k != "__none"}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(fill[c])) for c in fill})


def principal_components(df: DataFrame, columns: list[str], share: float = 0.95, at_least: int = 50) -> DataFrame:
    """Components that hold ``share`` of the variance, if there are more than ``at_least`` columns (else the table as it is)."""
    if len(columns) <= at_least:
        return df
    rows = VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="keep").transform(df)
    full = PCA(k=min(len(columns), 200), inputCol="__v", outputCol="__p").fit(rows)
    total, k = 0.0, 0
    for x in full.explainedVariance:
        total, k = total + float(x), k + 1
        if total >= share:
            break
    out = PCA(k=k, inputCol="__v", outputCol="__p").fit(rows).transform(rows)
    return out.withColumn("__a", vector_to_array("__p")).select(*[c for c in df.columns if c not in columns], *[F.col("__a")[i].alias(f"pc{i + 1}") for i in range(k)])
