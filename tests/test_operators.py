"""Masks, rules, samplers, detectors, metrics, answers and files."""

import math
import random

import pytest
from pyspark.ml.clustering import GaussianMixture
from pyspark.sql import functions as F

from cellsight.functions import decisions as D
from cellsight.functions import numbers as N
from cellsight.operators import cells as C
from cellsight.operators import cluster, detect, encode, records, rules
from cellsight.operators import metrics as M
from cellsight.operators import sampling as S
from cellsight.sources import io
from cellsight.streaming import scoring


def test_row_index_is_dense_and_ordered(spark):
    df = spark.createDataFrame([((i * 37) % 101, i) for i in range(101)], "k int, v int")
    got = [(r["k"], r["row_idx"]) for r in C.with_row_index(df, ["k"]).orderBy("row_idx").collect()]
    assert got == [(i, i) for i in range(101)]


def test_numbers(spark):
    df = spark.createDataFrame([(" 7 ",), ("1e3",), ("nan",), ("4B",), (None,), ("1,5",)], "v string")
    assert [r[0] for r in df.select(N.number("v")).collect()] == [7.0, 1000.0, None, None, None, None]
    assert df.select(N.comma_number("v")).collect()[5][0] == 1.5


def test_rules(spark):
    wide = spark.createDataFrame([(0, "17.0", "x", 1, 0), (1, "bad", "y", 1, 1)], "row_idx long, age string, job string, m_a int, m_j int")
    good, bad = rules.split_rules(
        [
            {"id": "C1", "columns": ["age"], "expression": "(lambda v: int(float(v)))(row['age']) == 17", "intent_signal": 1},
            {"id": "C2", "columns": ["job", "age"], "expression": "row['job'] in ('y', 'z')", "intent_signal": -1},
            {"id": "X1", "columns": ["age"], "expression": "__import__('os').system('true')", "intent_signal": 1},
            {"id": "X2", "columns": ["none"], "expression": "row['age'] == '1'", "intent_signal": 1},
            {"id": "X3", "columns": ["age"], "expression": "row['age'] == '1'", "intent_signal": 0},
            {"id": "X4"},
        ],
        ["age", "job"],
    )
    assert [r.id for r in good] == ["C1", "C2"] and [r["id"] for r, _ in bad] == ["X1", "X2", "X3", "X4"]
    got = {(r["row_idx"], r["col_name"]): r for r in rules.signals(wide, good, {"age": "m_a", "job": "m_j"}, columns=["age", "job"]).collect()}
    assert set(got) == {(0, "age"), (1, "age"), (1, "job")}
    assert got[0, "age"]["signal_C1"] == 1 and got[1, "age"]["signal_C1"] == 0 and got[1, "age"]["signal_C2"] == -1
    assert got[1, "age"]["cell_signal_ratio"] == -0.5 and got[1, "job"]["row_signal_sum"] == -1
    assert {r["rule"]: r["n_fired"] for r in rules.coverage(rules.signals(wide, good, {"age": "m_a", "job": "m_j"}, columns=["age", "job"]), good).collect()} == {"C1": 1, "C2": 2}


@pytest.mark.parametrize("rule", [S.with_noise, S.without_floor, S.with_floor, S.trimmed, S.capped])
def test_allocations(rule):
    sizes = {0: 50, 1: 30, 2: 3, -1: 17}
    got = rule(sizes, 10)
    assert (-1 in got) == (rule is S.with_noise)
    assert all(v >= (5 if rule is S.with_floor else 0 if rule is S.without_floor else 1) for v in got.values())
    if rule in (S.without_floor, S.trimmed):
        assert sum(got.values()) == 10


def test_draws(spark):
    df = spark.range(100).select(F.col("id").alias("row_idx"), (F.col("id") % 4).cast("int").alias("cluster"))
    got = S.proportional(df, 0.2, S.without_floor)
    assert got.count() == 20 and got.select("row_idx").distinct().count() == 20
    assert sorted(r[1] for r in S.folds(df, "cluster", 5).groupBy("fold").count().collect()) == [20] * 5
    split = S.group_split(df, "cluster").groupBy("cluster").agg(F.count_distinct("is_test").alias("n")).collect()
    assert all(r["n"] == 1 for r in split)


def test_metrics_against_hand(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, -1, 0.4), (-1, -1, 0.4), (-1, 1, 0.8)], "y_true int, y_pred int, score double")
    r = M.confusion(df).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 1, 1, 1) and r["f1"] == 0.5
    assert M.roc_auc(df).first()["auc"] == pytest.approx((1 + 1 + 0.5 + 0) / 4)
    assert M.roc_auc(df.where("y_true = 1")).first()["auc"] is None
    assert M.single_class(df.where("y_true = 1")).first()["recall"] == 0.5
    assert M.normal_tail(1.959964) == pytest.approx(0.05, abs=1e-4)


def test_ecod_leave_one_out_equals_rescoring(spark):
    base = spark.createDataFrame([(i, c, float((i * k) % 17)) for i in range(40) for c, k in (("a", 3), ("b", 5))], "row_idx long, col_name string, x double")
    dirty = base.withColumn("x", F.when((F.col("row_idx") == 3) & (F.col("col_name") == "a"), 99.0).otherwise(F.col("x")))
    flagged = spark.createDataFrame([(3, "a"), (4, "b")], "row_idx long, col_name string")
    got = {(r["row_idx"], r["col_name"]): r["delta_score"] for r in detect.ecod_leave_one_out(dirty, base, flagged).collect()}
    tails = detect.ecod_tails(base)
    score = lambda d: {r["row_idx"]: r["score"] for r in detect.ecod_scores(detect.ecod_terms(d, tails)).collect()}
    assert got[3, "a"] == pytest.approx(score(dirty)[3] - score(base)[3]) and got[3, "a"] > 0
    assert got[4, "b"] == pytest.approx(0)


def vectors(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, v array<double>")


def test_neighbours_lof_and_dbscan(spark):
    points = [(x, y) for x in range(4) for y in range(4)] + [(50, 50)] + [(100 + x, y) for x in range(3) for y in range(3)]
    v = vectors(spark, points)
    near = detect.neighbours(v, v, 3, block=7).where("q = 0").orderBy("rank").collect()
    assert [r["b"] for r in near] == [0, 1, 4] and near[0]["d"] == 0
    lof = {r["id"]: r["lof"] for r in detect.local_outlier_factor(v, 5).collect()}
    assert max(lof, key=lof.get) == 16
    found = {r["id"]: r["cluster"] for r in cluster.dbscan(v, 1.5, 4).collect()}
    assert found[16] == -1 and len({found[i] for i in range(16)}) == 1 and len({found[i] for i in range(17, 26)}) == 1 and found[0] != found[17]
    labels = {r["id"]: r["cluster"] for r in cluster.agglomerative(v, 3).collect()}
    assert len({labels[i] for i in range(16)}) == 1 and labels[0] != labels[17]


def test_label_spread(spark):
    v = vectors(spark, [(i, 0) for i in range(10)] + [(100 + i, 0) for i in range(10)])
    seeds = spark.createDataFrame([(0, 1), (10, -1)], "id long, intent int")
    got = {r["id"]: r["y_pred"] for r in cluster.spread_labels(v, seeds, 3, rounds=25).collect()}
    assert all(got[i] == 1 for i in range(10)) and all(got[i] == -1 for i in range(10, 20))


def test_mixture_counts_equal_rows_first(spark):
    rows = [(float(i % 3), float(i % 2) + (5.0 if i % 3 == 2 else 0.0)) for i in range(300)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "id long, a double, b double")
    seen = []
    fit = GaussianMixture._fit
    GaussianMixture._fit = lambda self, d: seen.append(d.count()) or fit(self, d)
    try:
        got = detect.mixture_score(df, ["a", "b"], 2).groupBy("a", "b").agg(F.count_distinct("nll").alias("k"), F.count("*").alias("n")).collect()
    finally:
        GaussianMixture._fit = fit
    assert seen == [6] and all(r["k"] == 1 and r["n"] == 50 for r in got)


def test_learned_suspicion_works_out_its_features_once(spark, monkeypatch):
    cells = spark.createDataFrame([(i, c, str(i % 7), 1 if i % 5 == 0 else 0) for i in range(60) for c in ("a", "b")], "row_idx long, col_name string, value string, mask int")
    plans = []
    monkeypatch.setattr(records, "IntentClassifier", lambda *a: type("Stub", (), {"fit": lambda self, d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or self, "transform": lambda self, d: d.withColumn("proba", F.lit(0.5))})())
    assert records.learned_suspicion(cells, ["a", "b"]).count() == 120
    assert len(plans) == 2 and not any("Join" in p for p in plans)


def test_isolation_forest(spark):
    df = spark.createDataFrame([(i, float(i % 10), float(i % 7)) for i in range(200)] + [(999, 500.0, -300.0)], "id long, a double, b double")
    top = detect.isolation_forest(df, ["a", "b"], "id", 50).orderBy(F.desc("score")).first()
    assert top["id"] == 999


def test_answers(spark):
    raw = [('<think>hm {"feature_decisions": 1}</think> ```json {"feature_decisions":[{"row_id":1,"column":"a","decision":"-1"},{"row_id":2,"column":"a","decision":3}]} ```',), ("nothing",), (None,), ('{"feature_decisions":[',)]
    got = D.decisions(spark.createDataFrame(raw, "raw string")).collect()
    assert [(r["row_id"], r["decision"]) for r in got] == [(1, -1)]
    one = spark.createDataFrame([('{"label": "2"}',), ("[1]",), ('{"x": -1}',), ("-1",), ("?",)], "raw string")
    assert [r[0] for r in one.select(D.single_decision("raw")).collect()] == [1, 1, -1, -1, None]
    t = spark.createDataFrame([('[{"decision": 1}, {"decision": "x"}]',), ("[1, -1, 5]",), ('{"0": 1, "1": -1}',)], "raw string")
    assert [r[0] for r in t.select(D.triplet_decisions("raw")).collect()] == [[1, None], [1, -1, None], [1, -1]]
    nested = spark.createDataFrame([(7, '{"g": {"0": {"a": 1, "zz": 1}}}'), (8, "[]")], "k long, raw string")
    assert {(r["column"], r["decision"]) for r in D.nested_decisions(nested, "raw", ["a", "b"], ("k",)).collect()} == {("a", 1), ("b", -1)}
    frag = spark.createDataFrame([('see {"a": "}"} and more }',)], "raw string").select(D.first_fragment("raw")).first()[0]
    assert frag == '{"a": "}"}'


def test_encoders(spark):
    df = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (None, "b"), (5.0, None)], "x double, c string")
    assert encode.one_hot(df, "c").columns == ["x", "c_b"]
    assert [r["c_code"] for r in encode.label_encode(df, "c").orderBy("x").collect()] == [1, 1, 0, -1]
    full = encode.impute(df, ["x"], ["c"])
    assert full.where("x IS NULL OR c IS NULL").count() == 0
    for kind in ("standard", "minmax", "robust"):
        s = encode.Scaler(kind).fit(full, ["x"])
        back = s.inverse(s.transform(full))
        assert [round(r["x"], 9) for r in back.collect()] == [r["x"] for r in full.collect()]


def test_files(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "a.csv").write_text("id,v\n1,NA\n2,\n")
    assert [tuple(r) for r in io.read_csv_text(spark, f"{p}/a.csv").collect()] == [("1", "NA"), ("2", "")]
    assert io.read_csv(spark, f"{p}/a.csv", columns=["id"]).dtypes == [("id", "int")]
    (tmp_path / "log.jsonl").write_text('{"chunk_no": 1, "raw": "x", "status": "ok"}\n\n{"chunk_no": 2, "ra\n{"chunk_no": 1, "raw": "y", "status": "ok"}\n')
    log = io.read_log(spark, f"{p}/log.jsonl")
    assert [r["chunk_no"] for r in log.collect()] == [1]
    io.append_log(log, f"{p}/out")
    io.append_log(log, f"{p}/out")
    assert spark.read.json(f"{p}/out").count() == 2
    io.write_json(spark.createDataFrame([(math.nan,)], "x double"), f"{p}/m")
    assert "x: nan" not in str(spark.read.text(f"{p}/m").collect()).lower()
    assert io.config("sampling_rate: 0.2\n# c\nname: abc")["sampling_rate"] == 0.2
    assert "| 1 |" in io.markdown(spark.createDataFrame([(1,)], "a int"), "T")


def test_scorer_falls_back():
    def broken(prompt):
        raise OSError("away")

    assert io.Scorer(broken, lambda p: "[1]", attempts=2)("q") == "[1]"
    assert io.Scorer(broken)("q") is None


def test_stream_scores_like_a_table(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i), 1 if i % 10 == 0 else 0) for i in range(50)], "row_idx long, x double, m int")
    rows.write.parquet(f"{tmp_path}/in")
    from cellsight.operators.heuristics import column_statistics

    stats = column_statistics(C.unpivot(rows, ["x"], masks={"x": "m"}))
    score = lambda df: scoring.score_cells(df, ["x"], {"x": "m"}, stats)
    q = scoring.start(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), score, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("row_idx", "h1_plausible").collect())) == sorted(map(tuple, score(rows).select("row_idx", "h1_plausible").collect()))


def test_agglomerative_takes_part_of_every_vector(spark):
    """A small far group of its own is found, merged in rounds and in one task."""
    draw = random.Random(4)
    centres = [(0.0, 0.0)] * 300 + [(60.0, 0.0)] * 300 + [(0.0, 90.0)] * 3
    rows = [(i, [x + draw.random(), y + draw.random()]) for i, (x, y) in enumerate(centres)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    for small in (300, 4000):
        found = {r["id"]: r["cluster"] for r in cluster.agglomerative(v, 3, small=small).collect()}
        groups = [{found[i] for i in range(a, b)} for a, b in ((0, 300), (300, 600), (600, 603))]
        assert [len(g) for g in groups] == [1, 1, 1] and len(set.union(*groups)) == 3
    assert cluster.agglomerative(v.limit(0), 3).count() == 0


def test_unknown_labels_stay_in_the_validation_pool(spark):
    t = spark.createDataFrame([(1, 1), (2, None), (3, 0)], "row_idx long, y int")
    assert {r[0] for r in S.validation_sample(t, F.col("y") == 1, 3).collect()} == {1, 2, 3}


def test_clustered_seeds_leave_noise_out(spark, monkeypatch):
    from cellsight.plans import scenario

    t = spark.createDataFrame([(str(i), float(i % 2), None if i % 5 else 1.0) for i in range(100)], "cell string, a double, b double")
    kinds = lambda v: v.select("id", F.when(F.col("v")[0] > 0, 0).otherwise(-1).alias("cluster"))
    monkeypatch.setitem(scenario.CLUSTERINGS, "given", kinds)
    monkeypatch.setitem(scenario.CLUSTERINGS, "noise", lambda v: v.select("id", F.lit(-1).alias("cluster")))
    seeds = scenario.clustered_seeds(t, ["a", "b"], "given", 0.1).collect()
    assert len(seeds) == 10 and {r["a"] for r in seeds} == {1.0}
    assert scenario.clustered_seeds(t, ["a", "b"], "noise", 0.1).count() == 10
