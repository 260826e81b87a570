"""The JSON document of a repository, in parts: no row and no task has to hold a whole one.

A document is the text of its parts in order. The first part has `meta`, `summary`, `languages` and
`smell_scores`; then every file, complex file, long function, sensitive function and TODO is a part of its own,
between the parts that open and close the lists. Parts are numbered by range partitioning (``operators.ranks``),
so a repository with a third of all files spreads over tasks. Files, functions and TODOs are in order of
path, then line; complex files by decreasing rounded score.

``sinks.packs`` writes parts as files of many documents each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from .reports import rounded

#: What opens each list (and closes the one before), by section; the last one closes the document.
OPENED = {1: ',"files":[', 2: '],"issues":{"complex_files":[', 3: '],"long_functions":[', 4: '],"sensitive_functions":[',
          5: '],"todos":[', 6: "]}}"}
ORDER = ["section", "item", "score_order", "path", "line", "text"]


def _score(x: Column) -> Column:
    return rounded(x, 1).cast("decimal(20,1)")


def _items(section: int, rows: DataFrame, doc: Column, path: str = "path", line: Column | None = None,
           score: Column | None = None) -> DataFrame:
    return rows.select("repo_id", F.lit(section).alias("section"), F.lit(1).alias("item"),
                       (score if score is not None else F.lit(0.0)).cast("double").alias("score_order"),
                       F.col(path).alias("path"), (line if line is not None else F.lit(0)).cast("bigint").alias("line"),
                       F.to_json(doc).alias("text"))


def header(metrics: DataFrame, language_stats: DataFrame, smells: DataFrame) -> DataFrame:
    """(repo_id, text): everything before the lists, one row per repository."""
    c = F.col
    langs = language_stats.groupBy("repo_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        "language", F.struct("files", "lines", "test_files"))))).alias("languages"))
    scores = smells.groupBy("repo_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        "smell", "score")))).alias("smell_scores"))
    summary = F.struct(
        "health_score", "risk_level", "total_files", "source_files", "test_files",
        (c("source_loc") + c("test_loc")).alias("total_loc"), "source_loc", "test_loc",
        F.when(c("source_loc") > 0, rounded(c("test_to_code_ratio"), 2)).otherwise(0.0).alias("test_to_code_ratio"),
        rounded(c("estimated_defects"), 1).alias("estimated_defects"))
    doc = F.struct(F.struct(F.lit("healthspark").alias("tool"), c("repo_id").alias("codebase_path")).alias("meta"),
                   summary.alias("summary"),
                   F.coalesce("languages", F.create_map().cast("map<string,struct<files:bigint,lines:bigint,test_files:bigint>>")).alias("languages"),
                   F.coalesce("smell_scores", F.create_map().cast("map<string,double>")).alias("smell_scores"))
    rows = metrics.join(langs, "repo_id", "left").join(scores, "repo_id", "left")
    text = F.to_json(doc)
    return rows.select("repo_id", F.substring(text, 1, F.length(text) - 1).alias("text"))  # the lists follow before the brace


def items(analysis: DataFrame, functions: DataFrame, todos: DataFrame) -> DataFrame:
    """Every item of every list: (repo_id, section, item, score_order, path, line, text)."""
    c = F.col
    count = lambda flag: F.size(F.filter("functions", lambda f: f[flag])).cast("bigint")
    files = _items(1, analysis, F.struct(
        "path", "language", c("total_lines").alias("lines"), "code_lines", "comment_lines",
        _score(c("complexity")).alias("complexity"),
        c("function_count").alias("functions"), c("class_count").alias("classes"),
        F.struct(c("todo_count").alias("todos"), count("is_sensitive").alias("sensitive_functions"),
                 count("is_long").alias("long_functions")).alias("issues")))
    score = _score(c("complexity"))
    complex_ = _items(2, analysis.where(c("complexity") > 10), F.struct(c("path").alias("file"), score.alias("score")), score=-score)
    long_ = _items(3, functions.where("is_long"), F.struct(c("path").alias("file"), "name", c("line_count").alias("lines")),
                   line=c("start_line"))
    sensitive = _items(4, functions.where("is_sensitive"), F.struct(c("path").alias("file"), "name", c("start_line").alias("line")),
                       line=c("start_line"))
    marks = _items(5, todos, F.struct(c("path").alias("file"), c("line_no").alias("line"), "content"), line=c("line_no"))
    return files.unionByName(complex_).unionByName(long_).unionByName(sensitive).unionByName(marks)


def document_parts(metrics: DataFrame, language_stats: DataFrame, smells: DataFrame, analysis: DataFrame,
                   functions: DataFrame, todos: DataFrame, base: str | None = None) -> DataFrame:
    """(repo_id, part, section, text): the parts of every repository's document, numbered from 1."""
    def frame(rows: DataFrame, section: Column, text: Column) -> DataFrame:
        return rows.select("repo_id", section.cast("int").alias("section"), F.lit(0).alias("item"), F.lit(0.0).alias("score_order"),
                           F.lit("").alias("path"), F.lit(0).cast("bigint").alias("line"), text.alias("text"))

    opening = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(t).alias("t")) for s, t in OPENED.items()])
    opened = metrics.select("repo_id", F.explode(opening).alias("o"))
    parts = (frame(header(metrics, language_stats, smells), F.lit(0), F.col("text"))
             .unionByName(frame(opened, F.col("o.s"), F.col("o.t"))).unionByName(items(analysis, functions, todos)))
    placed = ranked(parts, "repo_id", ORDER, "part", base)
    # an item is the first of its list if it comes right after the part that opens it
    after = placed.where("item = 0").select("repo_id", "section", (F.col("part") + 1).alias("first"))
    return placed.join(after, ["repo_id", "section"]).select("repo_id", "part", "section", F.when(
        (F.col("item") == 1) & (F.col("part") > F.col("first")), F.concat(F.lit(","), F.col("text"))).otherwise(F.col("text")).alias("text"))
