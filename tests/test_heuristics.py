"""Small dirty tables with known answers, one for each heuristic."""

import random

import pytest
from pyspark.sql import functions as F

from cellsight.functions import text as T
from cellsight.operators import cells as C
from cellsight.operators import heuristics as H
from cellsight.operators import models as M


def cells_of(spark, columns, errors):
    n = len(next(iter(columns.values())))
    rows = [(i, c, None if v[i] is None else str(v[i]), 1 if (i, c) in errors else 0) for c, v in columns.items() for i in range(n)]
    return spark.createDataFrame(rows, "row_idx long, col_name string, value string, mask int")


def by_cell(df):
    return {(r["row_idx"], r["col_name"]): r for r in df.collect()}


def percentile(values, q):
    """Linear interpolation between the sorted values around the place (n - 1) * q."""
    v = sorted(values)
    at = (len(v) - 1) * q
    low = int(at)
    return v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low)


def random_tables(seed, rounds=3):
    rng = random.Random(seed)
    towns = ["Lyon", "Turin", "Ghent", "Basel", "Graz", "Porto"]
    for _ in range(rounds):
        n = rng.randint(12, 40)
        columns = {"height": [rng.randint(140, 210) for _ in range(n)], "town": [rng.choice(towns) for _ in range(n)]}
        errors = set()
        for i in rng.sample(range(n), n // 4):
            c = rng.choice(["height", "town"])
            errors.add((i, c))
            columns[c][i] = rng.choice([rng.randint(0, 400), columns[c][i]]) if c == "height" else rng.choice([columns[c][i], columns[c][i][::-1], columns[c][i] + "-x", "n/a", "Lyyon", "..", "Turin_obf", "Turin-obfuscated"])
        yield columns, errors


def test_plausibility(spark):
    for columns, errors in random_tables(1):
        got = by_cell(H.h1_plausibility(cells_of(spark, columns, errors)))
        assert set(got) == errors
        clean = {c: [v for i, v in enumerate(vs) if (i, c) not in errors] for c, vs in columns.items()}
        low, high = percentile(clean["height"], 0.05), percentile(clean["height"], 0.95)
        for (i, c), r in got.items():
            v = columns[c][i]
            want = int(low <= v <= high) if c == "height" else int(v in clean["town"])
            assert r["h1_plausible"] == want
            assert (r["h1_in_vocab"], r["h1_in_range"]) == ((None, want) if c == "height" else (want, None))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow_obfuscation(value, vocabulary):
    v = value.strip().lower()
    if not v:
        return 0
    suffix = any(v == w.lower() + s + x for w in vocabulary if w != value for s in T.OBFUSCATION_SEPARATORS for x in T.OBFUSCATION_SUFFIXES)
    return int(v in T.OBFUSCATION_TOKENS or suffix or len(v) == 1 or not any(ch.isalnum() for ch in v))


def test_string_anomaly(spark):
    seen = set()
    for columns, errors in random_tables(2, 4):
        got = by_cell(H.h2_string_anomaly(cells_of(spark, columns, errors)))
        assert set(got) == {e for e in errors if e[1] == "town"}
        vocabulary = {v for i, v in enumerate(columns["town"]) if (i, "town") not in errors}
        for (i, c), r in got.items():
            v = columns[c][i]
            want = (min(10, *[edits(v, w) for w in vocabulary]), slow_obfuscation(v, vocabulary))
            assert (r["h2_min_edit_distance"], r["h2_is_obfuscation"]) == want
            seen.add(want)
    assert len(seen) > 4


def test_empty_vocabulary_and_empty_value(spark):
    cells = cells_of(spark, {"a": ["x", None], "b": ["y", "y"]}, {(0, "a"), (1, "a")})
    got = by_cell(H.h2_string_anomaly(cells))
    assert got[0, "a"]["h2_min_edit_distance"] == 10
    assert got[1, "a"]["h2_is_obfuscation"] == 0


def test_distribution(spark):
    cells = cells_of(spark, {"age": [25, 30, 35, 200, 28], "education": ["HS-grad", "HS-grad", "Bachelors", "XYZ-fake", "HS-grad"]}, {(3, "age"), (3, "education")})
    got = by_cell(H.h3_distribution(cells))
    assert got[3, "age"]["h3_distribution_score"] == 0.0 and got[3, "education"]["h3_distribution_score"] == 0.0


def test_coherence(spark):
    wide = spark.createDataFrame([(i, ["HS", "BA", "MA"][i % 3], [9, 13, 14][i % 3], 0, 1 if i == 4 else 0) for i in range(60)], "row_idx long, education string, years int, m_e int, m_y int")
    wide = wide.withColumn("years", F.when(F.col("row_idx") == 4, 5).otherwise(F.col("years")))
    masks = {"education": "m_e", "years": "m_y"}
    bank = M.PredictorBank({"education": "cat", "years": "num"}, 10, 4).fit(wide, masks)
    cells = C.unpivot(wide, list(masks), masks=masks)
    got = by_cell(M.h4_coherence(bank, C.errors(cells)))
    assert 0 <= got[4, "years"]["h4_coherence_score"] <= 0.5


def test_error_pattern(spark):
    columns = {"education": ["HS-grad", "HS-grad", "Bachelors", "Masters"], "education-num": [9, 9, 13, 14], "age": [25, 30, 35, 40]}
    cells = cells_of(spark, columns, {(2, "education"), (2, "education-num")})
    got = by_cell(H.h5_error_pattern(cells, H.codependent_pairs(list(columns), [("age", "no-such")])))
    assert all(r["h5_error_count"] == 2 and r["h5_codependent_flag"] == 1 for r in got.values()) and len(got) == 2
    one = cells_of(spark, {"a": [1, 2]}, {(0, "a")})
    assert by_cell(H.h5_error_pattern(one, set()))[0, "a"]["h5_codependent_flag"] == 0


def test_importance_and_incentive(spark):
    num = [(7 * i) % 16 + 1 for i in range(200)]
    columns = {"education-num": num, "fnlwgt": [(i * 7919) % 1009 for i in range(200)], "race": ["A" if i % 3 else "B" for i in range(200)], "income": [int(x > 10) for x in num]}
    cells = cells_of(spark, columns, {(5, "education-num"), (20, "fnlwgt"), (30, "race")})
    types = C.detect_types(cells)
    imp = {r["col_name"]: r["h6_column_importance"] for r in M.h6_importance(cells, "income", types).collect()}
    assert imp["education-num"] > 0.8 and imp["fnlwgt"] < 0.3
    got = by_cell(H.h7_incentive(cells, "income", types))
    r = got[5, "education-num"]
    assert r["h7_mutability"] == 0.0 and r["h7_gain_direction"] > 0.7 and r["h7_comprehensibility"] == 0.3
    r = got[20, "fnlwgt"]
    assert r["h7_mutability"] == 0.0 and 0.3 <= r["h7_gain_direction"] <= 0.7 and r["h7_comprehensibility"] == 0.3
    r = got[30, "race"]
    assert r["h7_mutability"] == 0.5 and r["h7_comprehensibility"] == 0.8 and r["h7_gain_direction"] in (0.0, 1.0)
    assert {r["h7_gain_direction"] for r in H.h7_incentive(cells, None, types).collect()} == {0.5}


def test_sensitivity(spark):
    """Sensitive by name or by request; the majority is the most frequent clean value, the least on ties."""
    for seed, given in ((5, None), (6, ["town"]), (7, [])):
        rng = random.Random(seed)
        columns = {"religion": [rng.choice("pqr") for _ in range(21)], "town": [rng.choice(["Lyon", "Graz"]) for _ in range(21)], "height": [rng.randint(150, 160) for _ in range(21)]}
        errors = {(i, rng.choice(list(columns))) for i in range(0, 21, 2)}
        got = by_cell(H.h8_sensitivity(cells_of(spark, columns, errors), given))
        assert set(got) == errors
        for (i, c), r in got.items():
            clean = [v for k, v in enumerate(columns[c]) if (k, c) not in errors]
            top = min(clean, key=lambda v: (-clean.count(v), v))
            sensitive = c in given if given is not None else c == "religion"
            assert (r["h8_is_sensitive"], r["h8_is_majority_value"]) == (int(sensitive), int(sensitive and c != "height" and columns[c][i] == top))


def test_twelve_features_in_order(spark):
    columns = {"age": [20 + i % 30 for i in range(60)], "education": ["ab", "cd", "ef"] * 20}
    cells = cells_of(spark, columns, {(3, "age"), (7, "education")})
    out = H.complete(H.assemble(cells), list(H.FEATURES))
    assert out.columns[2:] == list(H.FEATURES) and len(H.FEATURES) == 12 and out.count() == 2


def test_names():
    assert T.clean_name("education-num") == "education"
    assert T.comprehensibility("marital-status") == 1.0 and T.comprehensibility("col1") == 0.0 and T.comprehensibility("education") == 0.8
    assert T.mutability("fnlwgt") == 0.0 and T.mutability("race") == 0.5 and T.mutability("occupation") == 1.0
    assert T.is_sensitive("Marital-status") and not T.is_sensitive("feature_b")


def test_no_errors_and_no_rows(spark):
    cells = cells_of(spark, {"a": ["x", "y"]}, set())
    assert H.h1_plausibility(cells).count() == 0 and H.h3_distribution(cells).count() == 0
    assert H.h2_string_anomaly(cells.limit(0)).count() == 0
