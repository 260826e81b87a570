"""Health score tiers, risk levels, defects and feature interactions (exact values)."""

import pytest
from pyspark.sql import functions as F

from healthspark.operators import metrics as M

BASE = dict(test_to_code_ratio=1.0, high_smells=0, duplicate_groups=0, long_functions=0,
            sensitive_unhandled=0, todos_count=0, source_loc=1000, total_classes=1)


def score(spark, **changes):
    row = dict(BASE, **changes)
    cols = list(row)
    df = spark.createDataFrame([tuple(row[c] for c in cols)],
                               ", ".join(f"{c} {'double' if c == 'test_to_code_ratio' else 'bigint'}" for c in cols))
    r = M.with_health(df).collect()[0]
    return r["health_score"], r["risk_level"]


@pytest.mark.parametrize("ratio,expected", [(0.85, 100), (0.55, 90), (0.25, 75), (0.15, 65), (0.05, 60), (0.0, 60)])
def test_ratio_tiers(spark, ratio, expected):
    assert score(spark, test_to_code_ratio=ratio)[0] == expected


@pytest.mark.parametrize("n,expected", [(1, 96), (2, 92), (5, 80), (10, 80)])
def test_smell_tiers(spark, n, expected):
    assert score(spark, high_smells=n)[0] == expected


@pytest.mark.parametrize("todos,expected", [(5, 100), (6, 99), (10, 99), (11, 97), (20, 97), (21, 95), (100, 95)])
def test_todo_tiers(spark, todos, expected):
    assert score(spark, todos_count=todos)[0] == expected


def test_class_density_and_worst(spark):
    assert score(spark, total_classes=10, source_loc=100)[0] == 95
    assert score(spark, total_classes=100)[0] == 95
    worst = score(spark, test_to_code_ratio=0.0, high_smells=8, duplicate_groups=20, long_functions=20,
                  sensitive_unhandled=20, todos_count=50, total_classes=100)
    assert worst == (0, "CRITICAL")


@pytest.mark.parametrize("s,level", [(100, "LOW"), (80, "LOW"), (79, "MODERATE"), (60, "MODERATE"),
                                     (59, "ELEVATED"), (40, "ELEVATED"), (39, "HIGH"), (20, "HIGH"), (19, "CRITICAL")])
def test_risk_levels(spark, s, level):
    assert spark.range(1).select(M.risk_level(F.lit(s))).collect()[0][0] == level


def test_feature_interactions_and_defects(spark):
    df = spark.createDataFrame([(n,) for n in [0, 1, 2, 5, 10, 100, -3]], "n bigint")
    got = [r[0] for r in df.select(M.feature_interactions(F.col("n"))).collect()]
    assert got == [0, 0, 1, 26, 1013, 1048555, 0]
    d = spark.createDataFrame([(1000,), (999,), (26,)], "loc bigint")
    density, est = M.defect_estimate(F.col("loc"))
    rows = d.select(density, est).collect()
    assert [r[1] for r in rows] == [42, 42, 1] and rows[0][0] == pytest.approx(42.5)
    _, est_h = M.defect_estimate(F.col("loc"), ai_generated=False)
    assert [r[0] for r in d.select(est_h).collect()] == [25, 24, 0]
