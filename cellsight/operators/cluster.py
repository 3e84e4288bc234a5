"""Clusterings of cell features and the spread of labels over clusters and neighbour graphs.

Vectors are ``(id, v array<double>)``. Every clustering returns ``id, cluster``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellsight.operators import nearest
from cellsight.operators.hierarchy import density_clusters
from cellsight.operators.linkage import agglomerative
from cellsight.operators.nearest import neighbours
from cellsight.operators.order import numbered, quantile
from cellsight.operators.storage import settled, stored

ROUNDS = 60


def _ml(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", array_to_vector("v").alias("features"))


def kmeans(vectors: DataFrame, k: int = 15, starts: int = 10, seed: int = 42) -> DataFrame:
    """The cheapest of several starts."""
    data = _ml(vectors).cache()
    models = [KMeans(k=k, seed=seed + i, maxIter=50).fit(data) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(data).select("id", F.col("prediction").alias("cluster"))


def mixture(vectors: DataFrame, k: int = 15, seed: int = 42) -> tuple[DataFrame, float, float]:
    """Clusters, BIC and AIC of a Gaussian mixture."""
    data = _ml(vectors).cache()
    n, d = data.count(), len(vectors.first()["v"])
    model = GaussianMixture(k=k, seed=seed).fit(data)
    free = k - 1 + k * d + k * d * (d + 1) / 2
    ll = model.summary.logLikelihood
    return model.transform(data).select("id", F.col("prediction").alias("cluster")), free * np.log(max(n, 1)) - 2 * ll, 2 * free - 2 * ll


def diagonal_mixture(vectors: DataFrame, k: int = 15, rounds: int = 50, tol: float = 1e-4, floor: float = 1e-6, seed: int = 42) -> tuple[DataFrame, float, float]:
    """As ``mixture`` with diagonal covariances, for vectors too wide for full ones.

    A round brings ``k`` times the width sums to the driver; variances are at least ``floor`` of the column's own.
    """
    data = settled(vectors.select("id", "v"))
    n = data.count()
    dims = data.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.var_pop("x").alias("var")).orderBy("pos").collect()
    least = np.array([max(r["var"] * floor, 1e-12) for r in dims])
    means = np.array(KMeans(k=k, seed=seed, maxIter=20).fit(_ml(data)).clusterCenters())
    k, d = means.shape
    variances, weights, before = np.tile(np.array([r["var"] for r in dims]) + least, (k, 1)), np.full(k, 1 / k), None

    def log_parts(x: np.ndarray, weights, means, variances) -> np.ndarray:
        # the square is multiplied out, so a batch needs no array of rows, parts and columns
        far = (x * x) @ (1 / variances).T - 2 * x @ (means / variances).T + (means * means / variances).sum(1)
        return np.log(weights + 1e-300) - 0.5 * (far + np.log(2 * np.pi * variances).sum(1))

    def rows_of(batch) -> np.ndarray:
        return batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)

    def step(weights, means, variances):
        def sums(batches):
            s0, s1, s2, ll = np.zeros(k), np.zeros((k, d)), np.zeros((k, d)), 0.0
            for batch in batches:
                if batch.num_rows:
                    x = rows_of(batch)
                    part = log_parts(x, weights, means, variances)
                    top = part.max(1, keepdims=True)
                    share = np.exp(part - top)
                    total = share.sum(1, keepdims=True)
                    share /= total
                    ll += float((np.log(total) + top).sum())
                    s0, s1, s2 = s0 + share.sum(0), s1 + share.T @ x, s2 + share.T @ (x * x)
            j, pos = np.divmod(np.arange(k * d), d)
            yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(pos), pa.array(s0[j]), pa.array(s1.ravel()), pa.array(s2.ravel()), pa.array(np.full(k * d, ll))], names=["j", "pos", "s0", "s1", "s2", "ll"])

        found = data.mapInArrow(sums, "j long, pos long, s0 double, s1 double, s2 double, ll double")
        return found.groupBy("j", "pos").agg(*[F.sum(c).alias(c) for c in ("s0", "s1", "s2", "ll")]).orderBy("j", "pos").collect()

    for _ in range(rounds):
        found = np.array([[r["s0"], r["s1"], r["s2"], r["ll"]] for r in step(weights, means, variances)]).reshape(k, d, 4)
        held = np.maximum(found[:, :, 0], 1e-12)
        weights, means = found[:, 0, 0] / n, found[:, :, 1] / held
        variances = np.maximum(found[:, :, 2] / held - means**2, least)
        ll = found[0, 0, 3]
        if before is not None and abs(ll - before) <= tol * abs(before):
            break
        before = ll

    def label(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(log_parts(rows_of(batch), weights, means, variances).argmax(1).astype(np.int32))], names=["id", "cluster"])

    free = k - 1 + 2 * k * d
    id_type = data.schema["id"].dataType.simpleString()
    return data.mapInArrow(label, f"id {id_type}, cluster int"), free * np.log(max(n, 1)) - 2 * ll, 2 * free - 2 * ll


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, root``: least id of each node's component by hops and jumps; every round is stored."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    label = stored(nodes.select("id", F.col("id").alias("root")))
    before = None
    for _ in range(ROUNDS):
        near = both.join(label.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b").groupBy("a").agg(F.min("rb").alias("rb"))
        hop = label.join(near, label["id"] == near["a"], "left").select("id", F.least("root", "rb").alias("root"))
        jump = hop.join(hop.select(F.col("id").alias("root"), F.col("root").alias("rr")), "root", "left")
        label = stored(jump.select("id", F.least("root", "rr").alias("root")))
        total = tuple(label.agg(F.bit_xor(F.xxhash64("id", "root")), F.sum(F.hash("id", "root").cast("long"))).first())
        if total == before:
            return label
        before = total
    raise RuntimeError("components did not settle")


def distance_quantile(vectors: DataFrame, k: int = 5, q: float = 0.9, floor: float = 1e-6) -> float:
    """The q-quantile of distances to the k-th neighbour, the vector itself included."""
    d = neighbours(vectors, vectors, k).groupBy("q").agg(F.max("d").alias("d"))
    return max(floor, quantile(d, "d", q) or 0.0)


def dbscan(vectors: DataFrame, eps: float | None = None, min_samples: int = 5) -> DataFrame:
    """Density clusters numbered by their least core id; noise is -1; a border point joins the least of its clusters.

    No pair within ``eps`` leaves a task: vectors are counted, core vectors joined by forests, and border vectors given a minimum.
    """
    eps = distance_quantile(vectors, min_samples) if eps is None else eps
    cells = nearest.Cells(vectors)
    inside = settled(nearest.count_within(cells.members, cells, eps).select("id", (F.col("n") >= min_samples).alias("core")))
    core = settled(vectors.select("id", "v").join(inside.where("core").select("id"), "id"))
    if core.isEmpty():
        return vectors.select("id", F.lit(-1).alias("cluster"))
    roots = connected(nearest.links_within(nearest.Cells(core), eps), core.select("id"))
    homes = nearest.Cells(core.join(roots, "id"), extra=("root",))
    border = nearest.least_within(settled(vectors.select("id", "v").join(inside.where("NOT core").select("id"), "id")), homes, eps, "root")
    every = vectors.select("id").join(roots, "id", "left").join(border, "id", "left").select("id", F.coalesce("root", "least").alias("root"))
    numbers = numbered(roots.select("root").distinct().withColumn("whole", F.lit(0)), ["whole"], ["root"], "cluster").select("root", F.col("cluster").cast("int").alias("cluster"))
    return every.join(numbers, "root", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def density_outliers(vectors: DataFrame, min_size: int = 30, min_samples: int | None = None, contamination: float = 0.02, alpha: float = 1.0, metric: str = "euclidean", method: str = "eom") -> DataFrame:
    """``id, cluster, score, is_outlier``: outlier scores of the density hierarchy; those from the (1 - contamination) percentile on are outliers."""
    scored = stored(density_clusters(vectors, min_size, min_samples, alpha, metric, method))
    cut = F.lit(quantile(scored, "score", 1 - contamination)).cast("double")
    return scored.select("id", "cluster", "score", (F.col("score") >= cut).cast("int").alias("is_outlier"))


def silhouette(vectors: DataFrame, clusters: DataFrame, sample: int = 5000) -> float:
    """Squared-Euclidean silhouette of a bounded sample without noise (the measure has no meaning for one cluster: 0)."""
    data = _ml(vectors).join(clusters.where("cluster >= 0"), "id").orderBy(F.xxhash64("id"), "id").limit(sample)
    if data.select("cluster").distinct().limit(2).count() < 2:
        return 0.0
    return ClusteringEvaluator(predictionCol="cluster", featuresCol="features").evaluate(data)


CLUSTERINGS = {
    "kmeans": kmeans, "dbscan": dbscan, "ward": agglomerative, "average": lambda v, k=15: agglomerative(v, k, "average"), "mixture": lambda v, k=15: mixture(v, k)[0],
    "hdbscan": lambda v, min_size=50, min_samples=5: density_clusters(v, min_size, min_samples).select("id", "cluster"),
}


def cluster_majority(labelled: DataFrame, cluster: str = "cluster", label: str = "intent") -> DataFrame:
    """``cluster, majority, n, purity``: +1 on ties."""
    pos, n = F.count_if(F.col(label) == 1), F.count("*")
    return labelled.groupBy(cluster).agg(F.when(2 * pos >= n, 1).otherwise(-1).alias("majority"), n.alias("n"), (F.greatest(pos, n - pos) / n).alias("purity"))


def vote_labels(clusters: DataFrame, seeds: DataFrame) -> DataFrame:
    """``id, y_pred``: the majority of a cluster's seeds, or of all seeds where it has none."""
    by = cluster_majority(clusters.join(seeds, "id")).select("cluster", "majority")
    pos = seeds.agg(F.when(2 * F.count_if(F.col("intent") == 1) >= F.count("*"), 1).otherwise(-1).alias("whole"))
    return clusters.join(by, "cluster", "left").join(F.broadcast(pos), F.lit(True)).select("id", F.coalesce("majority", "whole").alias("y_pred"))


def knn_labels(vectors: DataFrame, seeds: DataFrame, k: int = 7) -> DataFrame:
    """``id, y_pred``: votes of the k nearest seeds weighted by inverse distance (an equal seed decides alone)."""
    base = vectors.join(seeds.select("id"), "id")
    near = neighbours(vectors, base, k).join(seeds.select(F.col("id").alias("b"), "intent"), "b")
    exact = F.max(F.when(F.col("d") == 0, F.col("intent")))
    w = F.sum(F.when(F.col("d") > 0, F.col("intent") / F.col("d")))
    return near.groupBy("q").agg(F.coalesce(exact, F.when(w >= 0, 1).otherwise(-1)).alias("y_pred")).withColumnRenamed("q", "id")


def spread_labels(vectors: DataFrame, seeds: DataFrame, k: int = 7, alpha: float | None = None, rounds: int = 1000, tol: float = 1e-3) -> DataFrame:
    """``id, y_pred, score`` over the graph of k nearest neighbours.

    With ``alpha`` None seeds keep their labels (propagation), else each node mixes alpha of its neighbours' mean with its own
    start (spreading). Scores lie between -1 and 1, 0 counts as +1. Every round is stored; it ends when no score moves by ``tol``.
    """
    near = neighbours(vectors, vectors, k + 1).where("q <> b")
    edges = stored(near.select("q", "b").union(near.select(F.col("b"), F.col("q"))).distinct())
    start = vectors.select("id").join(seeds.select("id", F.col("intent").cast("double").alias("y")), "id", "left")
    now = stored(start.select("id", "y", F.coalesce("y", F.lit(0.0)).alias("s")))
    for _ in range(rounds):
        mean = edges.join(now.select(F.col("id").alias("b"), "s"), "b").groupBy("q").agg(F.avg("s").alias("m"))
        joined = now.join(mean, now["id"] == mean["q"], "left")
        m = F.coalesce("m", F.lit(0.0))
        step = F.coalesce("y", m) if alpha is None else alpha * m + (1 - alpha) * F.coalesce("y", F.lit(0.0))
        after = stored(joined.select("id", "y", step.alias("s"), F.col("s").alias("was")))
        moved = after.agg(F.max(F.abs(F.col("s") - F.col("was")))).first()[0] or 0.0
        now = after.select("id", "y", "s")
        if moved < tol:
            break
    return now.select("id", F.when(F.col("s") >= 0, 1).otherwise(-1).alias("y_pred"), F.col("s").alias("score"))
