"""Repository metrics, defect estimate, health score and risk level.

All per-repository numbers are sums over per-file rows (partial aggregation
before the ``repo_id`` shuffle) joined on ``repo_id`` starting from the
repository dimension, so a repository without any kept file still gets a row
(all zeros, score 60, MODERATE). The seven health penalties are published as
columns next to the score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import safe_ratio


def file_counts(scanned: DataFrame) -> DataFrame:
    """Counts over every scanned file, binary ones included."""
    return scanned.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(~F.col("is_test")).alias("source_files"),
        F.count_if(F.col("is_test")).alias("test_files"))


def analysis_totals(analysis: DataFrame) -> DataFrame:
    """Line, structure and issue totals over analysed files."""
    code = F.col("code_lines")
    long_n = F.size(F.filter("functions", lambda f: f["is_long"]))
    sensitive_n = F.size(F.filter("functions", lambda f: f["is_sensitive"]))
    return analysis.groupBy("repo_id").agg(
        F.sum("total_lines").alias("total_lines"),
        F.sum(code).alias("code_lines"),
        F.sum("comment_lines").alias("comment_lines"),
        F.sum("blank_lines").alias("blank_lines"),
        F.sum(F.when(~F.col("is_test"), code).otherwise(0)).alias("source_loc"),
        F.sum(F.when(F.col("is_test"), code).otherwise(0)).alias("test_loc"),
        F.sum("function_count").alias("total_functions"),
        F.sum("class_count").alias("total_classes"),
        F.sum("import_count").alias("total_imports"),
        F.sum("todo_count").alias("todos_count"),
        F.sum(long_n).alias("long_functions"),
        F.sum(F.when(~F.col("has_error_handling"), sensitive_n).otherwise(0))
         .alias("sensitive_unhandled"),
        F.sum("feature_count").alias("feature_count"))


def language_stats(scanned: DataFrame, analysis: DataFrame) -> DataFrame:
    """(repo_id, language, files, test_files, lines): files from the scan, lines = code lines analysed."""
    files = scanned.groupBy("repo_id", "language").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("is_test")).alias("test_files"))
    lines = analysis.groupBy("repo_id", "language").agg(F.sum("code_lines").alias("lines"))
    return (files.join(lines, ["repo_id", "language"], "left")
            .select("repo_id", "language", "files", "test_files",
                    F.coalesce(F.col("lines"), F.lit(0)).cast("bigint").alias("lines")))


def defect_estimate(source_loc: Column, ai_generated: bool = True,
                    base_density: float = dims.DEFECT_DENSITY_BASE) -> tuple[Column, Column]:
    """(density per KLOC, estimated defects = floor(loc / 1000 * density))."""
    density = base_density * (dims.AI_DEFECT_MULTIPLIER if ai_generated else 1.0)
    est = F.floor(source_loc.cast("double") / F.lit(1000.0) * F.lit(density)).cast("bigint")
    return F.lit(density), est


def feature_interactions(n: Column) -> Column:
    """2^n - 1 - n with n capped at 20; 0 for n <= 0."""
    m = F.least(n, F.lit(dims.FEATURE_EXPONENT_CAP)).cast("bigint")
    return F.when(n <= 0, F.lit(0).cast("bigint")).otherwise(
        F.pow(F.lit(2.0), m).cast("bigint") - 1 - m)


def ratio_penalty(ratio: Column) -> Column:
    expr = None
    for floor, pen in dims.TEST_RATIO_TIERS:
        expr = (F.when(ratio >= floor, F.lit(pen)) if expr is None
                else expr.when(ratio >= floor, F.lit(pen)))
    return expr.otherwise(F.lit(dims.TEST_RATIO_FLOOR_PENALTY))


def risk_level(score: Column) -> Column:
    expr = None
    for floor, name in dims.RISK_LEVELS:
        expr = (F.when(score >= floor, F.lit(name)) if expr is None
                else expr.when(score >= floor, F.lit(name)))
    return expr.otherwise(F.lit(dims.RISK_FLOOR))


def with_health(df: DataFrame) -> DataFrame:
    """Add the penalty columns, health_score and risk_level.

    Needs: test_to_code_ratio, high_smells, duplicate_groups, long_functions,
    sensitive_unhandled, todos_count, source_loc, total_classes.
    """
    c = F.col
    todos = c("todos_count")
    class_density = c("total_classes").cast("double") / c("source_loc").cast("double") * F.lit(1000.0)
    df = df.select(
        "*",
        ratio_penalty(c("test_to_code_ratio")).alias("penalty_tests"),
        F.least(F.lit(20), c("high_smells") * 4).alias("penalty_smells"),
        F.least(F.lit(10), c("duplicate_groups") * 2).alias("penalty_duplicates"),
        F.least(F.lit(10), c("long_functions")).alias("penalty_long_functions"),
        F.least(F.lit(10), c("sensitive_unhandled") * 2).alias("penalty_error_handling"),
        F.when(todos > 20, 5).when(todos > 10, 3).when(todos > 5, 1).otherwise(0).alias("penalty_todos"),
        F.when((c("source_loc") > 0) & (class_density > F.lit(float(dims.CLASS_DENSITY_LIMIT))), 5)
         .otherwise(0).alias("penalty_class_density"))
    total = (c("penalty_tests") + c("penalty_smells") + c("penalty_duplicates")
             + c("penalty_long_functions") + c("penalty_error_handling") + c("penalty_todos")
             + c("penalty_class_density"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - total)).cast("bigint")
    return df.withColumn("health_score", score).withColumn("risk_level", risk_level(c("health_score")))


METRIC_COUNTS = ["total_files", "source_files", "test_files", "total_lines", "code_lines",
                 "comment_lines", "blank_lines", "source_loc", "test_loc", "total_functions",
                 "total_classes", "total_imports", "todos_count", "long_functions",
                 "sensitive_unhandled", "feature_count", "duplicate_groups", "high_smells",
                 "fix_smells"]


def repo_metrics(repos: DataFrame, scanned: DataFrame, analysis: DataFrame,
                 smells_wide: DataFrame, dup_counts: DataFrame,
                 ai_generated: bool = True, base_density: float = dims.DEFECT_DENSITY_BASE) -> DataFrame:
    """One row per repository: counters, ratio, defects, features, smells, health and risk."""
    smell_cols = [F.col(s) for s in dims.SMELL_ORDER]
    smells = smells_wide.select(
        "repo_id", *dims.SMELL_ORDER,
        sum(F.when(s >= dims.HIGH_SMELL_SCORE, 1).otherwise(0) for s in smell_cols).alias("high_smells"),
        sum(F.when(s > dims.FIX_SMELL_SCORE, 1).otherwise(0) for s in smell_cols).alias("fix_smells"))
    out = (repos.join(file_counts(scanned), "repo_id", "left")
           .join(analysis_totals(analysis), "repo_id", "left")
           .join(smells, "repo_id", "left")
           .join(dup_counts.select("repo_id", "duplicate_groups"), "repo_id", "left"))
    out = out.select(
        "repo_id",
        *[F.coalesce(F.col(k), F.lit(0)).cast("bigint").alias(k) for k in METRIC_COUNTS],
        *[F.coalesce(F.col(s), F.lit(0.0)).alias(s) for s in dims.SMELL_ORDER])
    density, est = defect_estimate(F.col("source_loc"), ai_generated, base_density)
    out = out.select(
        "*",
        safe_ratio(F.col("test_loc"), F.col("source_loc")).alias("test_to_code_ratio"),
        density.alias("defect_density"),
        est.alias("estimated_defects"),
        feature_interactions(F.col("feature_count")).alias("feature_interactions"))
    return with_health(out)
