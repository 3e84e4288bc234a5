"""Label budgets: how many cells of each cluster are labelled, and which.

Sizes of clusters (tens of rows) come to the driver, where the allocation is worked out; the draw numbers the rows of each
cluster by a hash of the key, in ranges, so it is the same on any cluster and no task orders a whole one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsight.operators.order import numbered

NOISE = -1
#: Clusters that an allocation takes at most.
MAX_CLUSTERS = 100_000


def draw_key(key: str, seed: int = 42) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key).cast("string"))


def ranked(df: DataFrame, by: list[str], order: list[Column | str], name: str = "__r") -> DataFrame:
    """``df`` with each row's number from 0 in its group; nulls are a group of their own."""
    if not by:
        return numbered(df, [], order, name)
    return numbered(df.withColumn("__g", F.struct(*by)), ["__g"], order, name).drop("__g")


def sizes_of(df: DataFrame, cluster: str = "cluster") -> dict:
    rows = df.groupBy(cluster).count().limit(MAX_CLUSTERS + 1).collect()
    if len(rows) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    return {r[0]: r[1] for r in sorted(rows, key=lambda r: str(r[0]))}


def with_noise(sizes: dict, target: int) -> dict:
    """Proportional with a floor of 1; noise is a cluster like any other and the total may exceed the target."""
    n = sum(sizes.values())
    return {c: max(1, round(s / n * target)) for c, s in sizes.items()}


def without_floor(sizes: dict, target: int) -> dict:
    """Proportional without noise; one pass of corrections by one, the largest allocations first."""
    own = {c: s for c, s in sizes.items() if c != NOISE}
    n = sum(own.values())
    out = {c: round(s / n * target) for c, s in own.items()} if n else {}
    over = sum(out.values()) - target
    for c in sorted(out, key=lambda c: -out[c]):
        if over > 0 and out[c] > 0:
            out[c], over = out[c] - 1, over - 1
        elif over < 0:
            out[c], over = out[c] + 1, over + 1
    return out


def with_floor(sizes: dict, target: int, floor: int = 5) -> dict:
    """Proportional without noise and with a floor that corrections never go below; they walk round the clusters."""
    own = {c: s for c, s in sizes.items() if c != NOISE}
    n = sum(own.values())
    out = {c: max(floor, round(s / n * target)) for c, s in own.items()} if n else {}
    over = sum(out.values()) - target
    order = sorted(out, key=lambda c: -out[c])
    for i in range(abs(over)):
        c = order[i % len(order)]
        out[c] = max(floor, out[c] - 1) if over > 0 else out[c] + 1
    return out


def trimmed(sizes: dict, target: int) -> dict:
    """Proportional without noise, at least 1; the largest allocation shrinks, or the largest cluster's grows, until the target is met."""
    own = {c: s for c, s in sizes.items() if c != NOISE}
    n = sum(own.values())
    out = {c: max(1, round(s / n * target)) for c, s in own.items()} if n else {}
    while sum(out.values()) > target and max(out.values()) > 1:
        out[max(out, key=out.get)] -= 1
    if out and sum(out.values()) < target:
        out[max(own, key=own.get)] += target - sum(out.values())
    return out


def capped(sizes: dict, target: int, most: int = 10) -> dict:
    """Proportional, between 1 and ``most`` for each cluster, topped up or trimmed to the target where that leaves room."""
    own = {c: s for c, s in sizes.items() if c != NOISE}
    n = sum(own.values())
    out = {c: min(most, max(1, round(s / n * target))) for c, s in own.items()} if n else {}
    order = sorted(out, key=lambda c: -own[c])
    while sum(out.values()) < target and any(out[c] < min(most, own[c]) for c in order):
        for c in order:
            if sum(out.values()) < target and out[c] < min(most, own[c]):
                out[c] += 1
    while sum(out.values()) > target and max(out.values()) > 1:
        out[max(out, key=out.get)] -= 1
    return out


def draw(df: DataFrame, allocation: dict, cluster: str = "cluster", order: Column | None = None, key: str = "row_idx") -> DataFrame:
    """The first rows of every cluster in the given order (a hash of the key by default), as many as allocated."""
    if not allocation:
        return df.limit(0)
    spark = df.sparkSession
    table = spark.createDataFrame([(k, int(v)) for k, v in allocation.items()], f"{cluster} {dict(df.dtypes)[cluster]}, __n int")
    rows = df.join(F.broadcast(table), cluster)  # at most MAX_CLUSTERS rows
    return ranked(rows, [cluster], [order if order is not None else draw_key(key), key]).where("__r < __n").drop("__r", "__n")


def proportional(df: DataFrame, rate: float, rule: Callable[[dict, int], dict] = without_floor, cluster: str = "cluster", order: Column | None = None, key: str = "row_idx", least: int = 2) -> DataFrame:
    sizes = sizes_of(df, cluster)
    return draw(df, rule(sizes, max(round(sum(sizes.values()) * rate), least)), cluster, order, key)


def uniform(df: DataFrame, rate: float, order: Column | None = None, key: str = "row_idx") -> DataFrame:
    """max(round(n * rate), 2) rows."""
    n = df.count()
    return ranked(df, [], [order if order is not None else draw_key(key), key]).where(F.col("__r") < max(round(n * rate), 2)).drop("__r")


def mixed_pool(df: DataFrame, target: int, cluster: str = "cluster", label: str = "intent", key: str = "row_idx", order: Column | None = None) -> DataFrame:
    """From a pool with labels: each cluster's share split evenly between intended and other rows."""
    shares = capped(sizes_of(df, cluster), target)
    half = {k: -(-v // 2) for k, v in shares.items()}
    one = draw(df.where(F.col(label) == 1), half, cluster, order, key)
    other = draw(df.where(F.col(label) != 1), {k: shares[k] - half[k] for k in shares if shares[k] > half[k]}, cluster, order, key)
    return one.unionByName(other)


def folds(df: DataFrame, label: str, k: int = 5, order: Column | None = None, key: str = "row_idx") -> DataFrame:
    """``fold`` 0..k-1, dealt round within each class."""
    dealt = ranked(df, [label], [order if order is not None else draw_key(key), key])
    return dealt.withColumn("fold", (F.col("__r") % k).cast("int")).drop("__r")


def group_split(df: DataFrame, group: str, share: float = 0.2, seed: int = 42, order: Column | None = None) -> DataFrame:
    """``is_test``: all rows of a record on one side; no shuffle."""
    h = order if order is not None else F.pmod(draw_key(group, seed), F.lit(1_000_000))
    return df.withColumn("is_test", (h < F.lit(int(share * 1_000_000))).cast("int"))


def stratified(df: DataFrame, strata: list[str], per: int, order: Column | None = None, key: str = "row_idx") -> DataFrame:
    """The first ``per`` rows of every stratum."""
    return ranked(df, strata, [order if order is not None else draw_key(key), key]).where(F.col("__r") < per).drop("__r")


def stratified_share(df: DataFrame, strata: list[str], share: float, record: str, order: Column | None = None) -> DataFrame:
    """All rows of a ``share`` of the records: every stratum gives its share of records, at least one, which are then trimmed or
    topped up to the share of all records (rounded down). Trimmed are the last of those chosen, added the first of the others.
    Null records are none; null strata are a stratum."""
    order = order if order is not None else draw_key(record)
    own = df.where(F.col(record).isNotNull()).select(F.struct(*strata).alias("__s"), record).distinct()
    wanted = own.groupBy("__s").agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(share))).alias("__n"))
    chosen = ranked(own, ["__s"], [order, record]).join(wanted, "__s").where("__r < __n").select(record).distinct().withColumn("__chosen", F.lit(1))
    records = own.select(record).distinct().join(chosen, record, "left").withColumn("__chosen", F.coalesce("__chosen", F.lit(0)))
    target = int(records.count() * share)
    kept = ranked(records, [], [F.desc("__chosen"), order, record]).where(F.col("__r") < target).select(record)
    return df.join(kept, record, "left_semi")


def validation_sample(df: DataFrame, labelled: Column, size: int, key: str = "row_idx", order: Column | None = None) -> DataFrame:
    """All labelled rows and others up to ``size``; a row of unknown label counts as one without."""
    known = F.coalesce(labelled, F.lit(False))
    own = df.where(known)
    others = ranked(df.where(~known), [], [order if order is not None else draw_key(key), key])
    return own.unionByName(others.where(F.col("__r") < max(0, size - own.count())).drop("__r"))


def guesses(df: DataFrame, kind: str = "random", share: float = 0.5, seed: int = 42, key: str = "row_idx") -> DataFrame:
    """``y_pred`` of a guess: +1 for a share of the rows by hash, or always +1 or -1."""
    if kind in ("all_intended", "all_accident"):
        return df.withColumn("y_pred", F.lit(1 if kind == "all_intended" else -1))
    u = F.pmod(draw_key(key, seed), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("y_pred", F.when(u < share, 1).otherwise(-1))
