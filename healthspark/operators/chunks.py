"""Per-file analysis of files that are larger than a row or a task should be.

A file is a sequence of chunks of whole lines. A chunk is analysed on its own, as if no block comment were open
before it, together with what would be different if one were: only its first lines, up to and including the first
one that opens or closes a block, which then are comments. So a chunk's summary holds for both states, and
summaries of a file compose: the state after a chunk is its last toggle's, or the one before it. A segmented
scan over narrow rows (one per chunk) gives every chunk its state, its first line's number, and the start that
follows its last function or class; counts then add up and extents meet the next chunk's first start.

Chunks end where nothing can match across them: after a line break that follows a printable character which
is neither letter, digit nor underscore. Everything but route patterns looks at single lines, and those patterns cross
lines only by blanks after a word. For languages without such patterns any ``\\n`` will do. A chunk therefore
grows until there is such a place: text is never cut elsewhere.

A child list of a large file never becomes one row: ``ChunkedAnalysis`` has flat tables.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..session import materialize
from ..sources import corpus as C
from .lines import feature_count, with_line_records
from .structure import FACT_COLUMNS, _extents, complexity, record_summary

# task functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A place where a chunk may end: behind the break of a line that ends in a sign; or behind any such break.
AFTER_SIGN = re.compile(rb"(?<=[!-/:-@\[-^`{-~])\r?\n")
AFTER_LINE = re.compile(rb"\n")
#: Extensions whose languages have no pattern that reads over line breaks.
PLAIN = frozenset(e for e, language in dims.LANGUAGE_BY_EXTENSION.items()
                  if not any(r"\s" in p for p in dims.FEATURE_PATTERNS.get(language, [])))


def cut_rule(path: str) -> re.Pattern:
    name = path.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return AFTER_LINE if dot > 0 and name[dot:].lower() in PLAIN else AFTER_SIGN


def cuts(content: bytes, size: int, rule: re.Pattern) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks: each ends at the first possible place at or after a multiple of ``size``."""
    start = 0
    while True:
        target = (start // size + 1) * size
        # a break that ends at the target may begin two bytes before it
        ends = (m.end() for m in rule.finditer(content, max(start, target - 2))) if target < len(content) else ()
        end = next((e for e in ends if e >= target), len(content))
        yield start, end
        if end >= len(content):
            return
        start = end


def chunk_table(corpus: DataFrame, chunk_bytes: int = 4 << 20) -> DataFrame:
    """(repo_id, path, size_bytes, start, piece): a corpus of whole files cut into chunks; an empty file is one chunk,
    one without content none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo, path, content in zip(*batch.columns):
                repo, path, content = repo.as_py(), path.as_py(), content.as_py()
                for start, end in cuts(content, chunk_bytes, cut_rule(path)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in ((repo, pa.string()), (path, pa.string()), (len(content), pa.int64()),
                                                       (start, pa.int64()), (content[start:end], pa.binary()))],
                        ["repo_id", "path", "size_bytes", "start", "piece"])

    return corpus.select("repo_id", "path", F.col("content").cast("binary").alias("content")).where(
        F.col("path").isNotNull() & F.col("content").isNotNull()).mapInArrow(run, "repo_id string, path string, size_bytes long, start long, piece binary")


def digests(corpus: DataFrame) -> DataFrame:
    """(repo_id, path, md5) of a corpus of whole files."""
    return corpus.select("repo_id", "path", F.md5(F.col("content").cast("binary")).alias("md5"))


@dataclass(frozen=True)
class ChunkedAnalysis:
    """Flat tables, equal to those of ``analyze`` on whole files."""
    file_facts: DataFrame
    functions: DataFrame
    classes: DataFrame
    imports: DataFrame
    todos: DataFrame
    literals: DataFrame


FILE = ["repo_id", "path"]


def _in_head(starts: str) -> Column:
    """Starts with whether they lie in the lines that depend on the state before the chunk."""
    return F.transform(starts, lambda x: F.struct(x["name"].alias("name"), x["start_line"].alias("start_line"),
                                                  (x["start_line"] <= F.col("_head")).alias("head")))


def summaries(chunks: DataFrame, extra_ignores: Sequence[str] = ()) -> DataFrame:
    """One row per chunk of the files that the scan keeps: counters, lists, and what the state before it changes."""
    p = F.col("path")
    kept = chunks.where(~C.dir_ignored(p, extra_ignores) & ~C.file_ignored(p)).select(
        *FILE, C.language(p).alias("language"), C.is_test(p).alias("is_test"), "size_bytes", "start",
        F.make_valid_utf8(F.col("piece").cast("string")).alias("text")).where(F.col("language").isNotNull())
    rows = kept.select("*", F.contains("text", F.lit("\x00")).alias("nul"),
                       feature_count(F.col("text"), F.col("language")).alias("feature_count"))
    rows = record_summary(with_line_records(rows, keep_block=True).drop("text"))
    head_code = F.size(F.filter("_recs", lambda r: (r["line_no"] <= F.col("_head")) & (r["kind"] == F.lit("code"))))
    return rows.select(
        *FILE, "language", "is_test", "size_bytes", "start", "nul", "feature_count", "total_lines", "code_lines", "comment_lines",
        "blank_lines", head_code.alias("head_code"), F.col("_exit").alias("exit"), "branch_lines", "has_error_handling",
        _in_head("_fstarts").alias("fstarts"), _in_head("_cstarts").alias("cstarts"), "imports", "todos", "literals")


def _placed(starts: str) -> Column:
    """The starts that hold in the chunk's state, with line numbers of the file."""
    kept = F.filter(starts, lambda x: ~((F.col("entry") == 1) & x["head"]))
    return F.transform(kept, lambda x: F.struct(x["name"].alias("name"), (x["start_line"] + F.col("base")).cast("int").alias("start_line")))


def analyse_chunks(chunks: DataFrame, md5: DataFrame, extra_ignores: Sequence[str] = (), mode: str = "write",
                   base_dir: str | None = None) -> ChunkedAnalysis:
    """Analysis of chunked files; ``md5`` has (repo_id, path, md5) of the whole files."""
    held = materialize(summaries(chunks, extra_ignores), "chunks", mode, base_dir)
    line = Window.partitionBy(*FILE).orderBy("start")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    states = held.select(
        *FILE, "start", F.coalesce(F.last("exit", ignorenulls=True).over(before), F.lit(0)).alias("entry"),
        F.coalesce(F.sum("total_lines").over(before), F.lit(0)).alias("base"),
        F.sum("total_lines").over(Window.partitionBy(*FILE)).alias("lines_in_file"),
        F.max("nul").over(Window.partitionBy(*FILE)).alias("binary"))
    rows = held.join(states, [*FILE, "start"]).where(~F.col("binary"))
    rows = rows.withColumn("fstarts", _placed("fstarts")).withColumn("cstarts", _placed("cstarts"))
    rows = materialize(rows, "chunks_in_state", mode, base_dir)

    after = line.rowsBetween(1, Window.unboundedFollowing)
    nexts = rows.select(*FILE, "start", *[
        F.first(F.try_element_at(c, F.lit(1))["start_line"], ignorenulls=True).over(after).alias(n)
        for c, n in (("fstarts", "next_f"), ("cstarts", "next_c"))])
    rows_with_next = rows.join(nexts, [*FILE, "start"])

    def extents(starts: str, following: str, kind: str) -> DataFrame:
        end = F.coalesce(F.col(following) - 1, F.col("lines_in_file")).cast("int")
        fields = {"function": ["name", "start_line", "end_line", "line_count", "is_sensitive", "is_long"],
                  "class": ["name", "start_line", "end_line", "method_count"]}[kind]
        found = rows_with_next.where(F.size(starts) > 0).select(*FILE, "language", "is_test", F.explode(
            _extents(F.col(starts), end, kind)).alias("x"))
        return found.select(*FILE, "language", "is_test", *[F.col(f"x.{c}").alias(c) for c in fields])

    def children(column: str, value: str) -> DataFrame:
        return rows.select(*FILE, "base", F.explode(column).alias("x")).select(
            *FILE, (F.col("x.line_no") + F.col("base")).cast("int").alias("line_no"), F.col(f"x.{value}").alias(value))

    opened = F.when(F.col("entry") == 1, F.col("head_code")).otherwise(0)
    total = lambda c: F.sum(c).cast("int")
    facts = rows.groupBy(*FILE).agg(
        F.first("language").alias("language"), F.first("is_test").alias("is_test"), F.first("size_bytes").alias("size_bytes"),
        total("total_lines").alias("total_lines"), total(F.col("code_lines") - opened).alias("code_lines"),
        total(F.col("comment_lines") + opened).alias("comment_lines"), total("blank_lines").alias("blank_lines"),
        total(F.size("fstarts")).alias("function_count"), total(F.size("cstarts")).alias("class_count"),
        total(F.size("imports")).alias("import_count"), total(F.size("todos")).alias("todo_count"),
        total(F.size("literals")).alias("literal_count"), total("branch_lines").alias("branch_lines"),
        F.sum("feature_count").alias("feature_count"), F.max("has_error_handling").alias("has_error_handling"))
    facts = facts.withColumn("complexity", complexity(
        *[F.col(c) for c in ("function_count", "class_count", "branch_lines", "code_lines")])).join(md5, FILE)
    return ChunkedAnalysis(facts.select(*FACT_COLUMNS), extents("fstarts", "next_f", "function"), extents("cstarts", "next_c", "class"),
                           children("imports", "text"), children("todos", "content"), children("literals", "literal"))
