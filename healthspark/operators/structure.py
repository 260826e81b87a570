"""Structure extraction per file: functions, classes, imports, TODOs, literals, file facts.

:func:`file_analysis` turns scanned files into one row per analysed file — the
scalar counters of the file plus its child lists as arrays of structs (the
nested form of a per-file analysis). It is a single projection, so a corpus of
any size is analysed without a shuffle. The flat tables (:func:`functions`,
:func:`classes`, ...) are ``explode``s of those arrays.

Function extent rule: a function ends on the line before the next function
start of the same file; the last one ends at the file's last line, so trailing
module code belongs to it. Classes follow the same rule among classes.
``method_count`` is always 0 (the original counter is never incremented).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import any_contains
from .lines import feature_count, with_line_records


def _extents(starts: Column, total: Column, kind: str) -> Column:
    """[(name, start)] sorted by start -> [(name, start_line, end_line, line_count, ...)]."""
    start_lines = F.transform(starts, lambda f: f["start_line"])
    ends = F.concat(
        F.transform(F.slice(start_lines, 2, F.greatest(F.size(start_lines) - 1, F.lit(0))),
                    lambda s: s - 1),
        F.array(total))

    def build(f: Column, end: Column) -> Column:
        count = end - f["start_line"] + 1
        fields = [f["name"].alias("name"), f["start_line"].alias("start_line"),
                  end.alias("end_line"), count.alias("line_count")]
        if kind == "function":
            fields += [any_contains(F.lower(f["name"]), dims.SENSITIVE_NAME_FRAGMENTS).alias("is_sensitive"),
                       (count > F.lit(dims.LONG_FUNCTION_LINES)).alias("is_long")]
        else:
            fields += [F.lit(0).alias("method_count")]
        return F.when(f.isNotNull(), F.struct(*fields))

    return F.filter(F.zip_with(starts, ends, build), lambda x: x.isNotNull())


def record_summary(f: DataFrame) -> DataFrame:
    """Counters and child lists of a row's line records; starts of functions and classes as ``_fstarts``, ``_cstarts``."""
    recs = F.col("_recs")

    def count_kind(k: str) -> Column:
        return F.size(F.filter(recs, lambda r: r["kind"] == F.lit(k)))

    return f.select(
        "*",
        F.size(recs).alias("total_lines"),
        count_kind("code").alias("code_lines"),
        count_kind("comment").alias("comment_lines"),
        count_kind("blank").alias("blank_lines"),
        F.filter(F.transform(recs, lambda r: F.when(r["func_name"].isNotNull(), F.struct(
            r["func_name"].alias("name"), r["line_no"].alias("start_line")))),
            lambda x: x.isNotNull()).alias("_fstarts"),
        F.filter(F.transform(recs, lambda r: F.when(r["class_name"].isNotNull(), F.struct(
            r["class_name"].alias("name"), r["line_no"].alias("start_line")))),
            lambda x: x.isNotNull()).alias("_cstarts"),
        F.filter(F.transform(recs, lambda r: F.when(r["is_import"], F.struct(
            r["line_no"].alias("line_no"), r["stripped"].alias("text")))),
            lambda x: x.isNotNull()).alias("imports"),
        F.filter(F.transform(recs, lambda r: F.when(r["todo"].isNotNull(), F.struct(
            r["line_no"].alias("line_no"), r["todo"].alias("content")))),
            lambda x: x.isNotNull()).alias("todos"),
        F.flatten(F.transform(recs, lambda r: F.transform(
            F.coalesce(r["literals"], F.array().cast("array<string>")),
            lambda s: F.struct(r["line_no"].alias("line_no"), s.alias("literal"))))).alias("literals"),
        F.size(F.filter(recs, lambda r: r["is_branch"])).alias("branch_lines"),
        F.exists(recs, lambda r: r["has_error"]).alias("has_error_handling"),
    )


def complexity(functions: Column, classes: Column, branch_lines: Column, code_lines: Column) -> Column:
    indicators = functions + classes + branch_lines
    return F.when(code_lines > 0, indicators.cast("double") / code_lines.cast("double") * F.lit(100.0)).otherwise(F.lit(0.0))


def file_analysis(files: DataFrame, keep_lines: bool = False) -> DataFrame:
    """One row per analysed (non-binary) file with counters and child arrays.

    Columns: repo_id, path, language, is_test, size_bytes, md5, total_lines,
    code_lines, comment_lines, blank_lines, function_count, class_count,
    import_count, todo_count, literal_count, branch_lines, feature_count,
    has_error_handling, complexity, functions, classes, imports, todos, literals
    (and ``_recs`` with ``keep_lines``).
    """
    f = files.where(~F.col("is_binary")).select(
        "repo_id", "path", "language", "is_test", "size_bytes", "md5", "text",
        feature_count(F.col("text"), F.col("language")).alias("feature_count"))
    f = record_summary(with_line_records(f).drop("text"))
    f = f.withColumn("functions", _extents(F.col("_fstarts"), F.col("total_lines"), "function"))
    f = f.withColumn("classes", _extents(F.col("_cstarts"), F.col("total_lines"), "class"))
    f = f.select(
        "*",
        F.size("functions").alias("function_count"),
        F.size("classes").alias("class_count"),
        F.size("imports").alias("import_count"),
        F.size("todos").alias("todo_count"),
        F.size("literals").alias("literal_count"),
    )
    f = f.withColumn("complexity", complexity(*[F.col(c) for c in ("function_count", "class_count", "branch_lines", "code_lines")]))
    cols = ["repo_id", "path", "language", "is_test", "size_bytes", "md5",
            "total_lines", "code_lines", "comment_lines", "blank_lines",
            "function_count", "class_count", "import_count", "todo_count", "literal_count",
            "branch_lines", "feature_count", "has_error_handling", "complexity",
            "functions", "classes", "imports", "todos", "literals"]
    if keep_lines:
        cols.append("_recs")
    return f.select(*cols)


FACT_COLUMNS = ["repo_id", "path", "language", "is_test", "size_bytes", "md5",
                "total_lines", "code_lines", "comment_lines", "blank_lines",
                "function_count", "class_count", "import_count", "todo_count", "literal_count",
                "branch_lines", "feature_count", "has_error_handling", "complexity"]


def file_facts(analysis: DataFrame) -> DataFrame:
    return analysis.select(*FACT_COLUMNS)


def _child(analysis: DataFrame, col: str, fields: list[str], extra: list[str] = ()) -> DataFrame:
    return (analysis.select("repo_id", "path", *extra, F.explode(col).alias("x"))
            .select("repo_id", "path", *extra, *[F.col(f"x.{c}").alias(c) for c in fields]))


def functions(analysis: DataFrame) -> DataFrame:
    """repo_id, path, language, is_test, name, start_line, end_line, line_count, is_sensitive, is_long."""
    return _child(analysis, "functions",
                  ["name", "start_line", "end_line", "line_count", "is_sensitive", "is_long"],
                  ["language", "is_test"])


def classes(analysis: DataFrame) -> DataFrame:
    return _child(analysis, "classes", ["name", "start_line", "end_line", "method_count"],
                  ["language", "is_test"])


def imports(analysis: DataFrame) -> DataFrame:
    return _child(analysis, "imports", ["line_no", "text"])


def todos(analysis: DataFrame) -> DataFrame:
    return _child(analysis, "todos", ["line_no", "content"])


def literals(analysis: DataFrame) -> DataFrame:
    return _child(analysis, "literals", ["line_no", "literal"])
