"""Fitted detectors: saved, loaded, applied to another table, and against a slow version."""

import numpy as np
import pytest

from cellsight.operators import ensemble as E

COLUMNS = ["x", "y"]


def _table(spark, seed, n=200):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 2)) * [1, 5]
    v[:4] *= 6
    return v, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "row_idx long, x double, y double")


def _detectors():
    return E.EnsembleDetector([E.ZDetector(COLUMNS, 2.5), E.FenceDetector(COLUMNS, 1), E.MahalanobisDetector(COLUMNS, 97)], [2, 1, 1])


def _slow(train, v):
    """Flags of the three detectors for each row."""
    z = (np.abs(v - train.mean(0)) / train.std(0) > 2.5).any(1)
    q1, q3 = np.percentile(train, [25, 75], axis=0)
    fence = ((v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))).any(1)
    inv = np.linalg.inv(np.cov(train.T, bias=True) + 1e-6 * np.eye(2))
    far = lambda a: np.einsum("ni,ij,nj->n", a - train.mean(0), inv, a - train.mean(0))
    return np.stack([z, fence, far(v) > np.percentile(far(train), 97)], 1)


def test_fitted_on_one_table_scores_another_before_and_after_a_reload(spark, tmp_path):
    train, df = _table(spark, 1)
    v, other = _table(spark, 2)
    model = _detectors().fit(df)
    model.save(f"file://{tmp_path}/model")
    again = E.load(spark, f"file://{tmp_path}/model")
    flags = _slow(train, v)
    for m in (model, again):
        got = sorted(m.transform(other).collect(), key=lambda r: r["row_idx"])
        assert [[r["z_flag"], r["fences_flag"], r["mahalanobis_flag"]] for r in got] == flags.astype(int).tolist()
        assert [r["confidence"] for r in got] == pytest.approx((flags @ [2, 1, 1] / 4).tolist())
        assert [r["is_suspicious"] for r in got] == (flags @ [2, 1, 1] >= 2).astype(int).tolist()
        assert [r["vote_count"] for r in got] == flags.sum(1).tolist()


def test_counterfactual_is_the_drop_of_the_vote(spark):
    train, df = _table(spark, 1)
    model = _detectors().fit(df)
    rows = df.where("row_idx < 20")
    typical = {"x": 0.25, "y": -0.5}
    got = {(r["row_idx"], r["col_name"]): r["counterfactual"] for r in E.counterfactual_scores(rows, COLUMNS, typical, model.confidence).collect()}
    assert len(got) == 40 and any(got.values())
    sure = lambda v: _slow(train, v) @ [2, 1, 1] / 4
    for i in range(20):
        v = train[i : i + 1]
        drops = [max(0.0, float((sure(v) - sure(np.where(np.arange(2) == c, typical[COLUMNS[c]], v)))[0])) for c in range(2)]
        assert [got[i, c] for c in COLUMNS] == pytest.approx([d / max(drops) if max(drops) else 0.0 for d in drops])


def test_nulls_constants_and_an_empty_table(spark):
    df = spark.createDataFrame([(0, None, 1.0), (1, 2.0, 1.0), (2, 3.0, 1.0)], "row_idx long, x double, y double")
    assert [r["vote_count"] for r in _detectors().fit(df).transform(df.where("row_idx = 0")).collect()] == [0]
    none = df.limit(0)
    assert _detectors().fit(none).transform(none).count() == 0
    assert [r["confidence"] for r in _detectors().fit(none).transform(df.where("row_idx = 1")).collect()] == [0.0]


def test_names_must_differ(spark):
    _, df = _table(spark, 1)
    with pytest.raises(ValueError):
        E.EnsembleDetector([E.ZDetector(COLUMNS), E.ZDetector(COLUMNS)]).fit(df)
