"""Named queries over the driver corpora (K1 code, K2 documents, K3 pages).

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame whose column names
match the DuckDB oracle of the same name in ``oracles/catalog.py``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks as H
from ..sources import driver_corpora as K
from ..sources import walk as W
from ..session import checkpoint_dir, materialize, unbounded
from ..sinks import packs as P
from ..sinks import trees as T
from .analysis import Analysis, analyze, longs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def k1(spark: SparkSession, sf: str, **kw) -> Analysis:
    kw.setdefault("materialize", "write")
    # the K1 builder is itself a SQL job: build the corpus once, every branch reads it
    corpus = materialize(K.k1_corpus(spark, sf), "k1_corpus", "write")
    return analyze(corpus, **kw)


def k2(spark: SparkSession, sf: str, **kw) -> Analysis:
    kw.setdefault("materialize", "write")
    return analyze(K.k2_corpus(spark, sf), **kw)


def k3(spark: SparkSession, sf: str, **kw) -> Analysis:
    kw.setdefault("materialize", "write")
    return analyze(K.k3_corpus(spark, sf), **kw)


# ---------------------------------------------------------------------------
# 2.1 scans / sources
# ---------------------------------------------------------------------------

@query("scan_files")
def scan_files(spark, sf):
    return longs(k1(spark, sf).scanned)


@query("path_rules")
def path_rules(spark, sf):
    return k1(spark, sf).path_rules.drop("kept")


@query("scan_user_ignore")
def scan_user_ignore(spark, sf):
    # 'core' matches the lower-cased directory name; 'Pods' (capital P) never matches.
    return longs(k1(spark, sf, extra_ignores=["core", "Pods"]).scanned)


@query("language_breakdown")
def language_breakdown(spark, sf):
    from ..sources.corpus import language_breakdown as lb
    return longs(lb(k1(spark, sf).scanned))


# ---------------------------------------------------------------------------
# 2.2 per-line classification
# ---------------------------------------------------------------------------

LINE_STATS = ["repo_id", "path", "total_lines", "code_lines", "comment_lines", "blank_lines"]


@query("line_stats")
def line_stats(spark, sf):
    return longs(k2(spark, sf).file_facts.select(*LINE_STATS))


@query("line_stats_code")
def line_stats_code(spark, sf):
    return longs(k1(spark, sf).file_facts.select(*LINE_STATS))


@query("line_stats_html")
def line_stats_html(spark, sf):
    return longs(k3(spark, sf).file_facts.select(*LINE_STATS))


@query("line_kinds")
def line_kinds(spark, sf):
    a = k1(spark, sf, keep_lines=True)
    return longs(a.lines.select("repo_id", "path", "line_no", "kind", "stripped"))


@query("todos")
def todos(spark, sf):
    return longs(k1(spark, sf).todos)


@query("imports")
def imports(spark, sf):
    return longs(k1(spark, sf).imports)


@query("string_literals")
def string_literals(spark, sf):
    return longs(k1(spark, sf).literals)


@query("string_literals_html")
def string_literals_html(spark, sf):
    return longs(k3(spark, sf).literals)


@query("error_handling")
def error_handling(spark, sf):
    return k1(spark, sf).file_facts.select("repo_id", "path", "has_error_handling")


@query("branch_lines")
def branch_lines(spark, sf):
    return longs(k1(spark, sf).file_facts.select("repo_id", "path", "branch_lines"))


# ---------------------------------------------------------------------------
# 2.3 structure
# ---------------------------------------------------------------------------

@query("functions")
def functions(spark, sf):
    return longs(k1(spark, sf).functions)


@query("classes")
def classes(spark, sf):
    return longs(k1(spark, sf).classes)


@query("sensitive_functions")
def sensitive_functions(spark, sf):
    f = k1(spark, sf).functions
    return longs(f.where("is_sensitive").select("repo_id", "path", "name", "start_line"))


@query("long_functions")
def long_functions(spark, sf):
    f = k1(spark, sf).functions
    return longs(f.where("is_long").select("repo_id", "path", "name", "start_line", "line_count"))


@query("file_facts")
def file_facts(spark, sf):
    return longs(k1(spark, sf).file_facts)


@query("file_facts_docs")
def file_facts_docs(spark, sf):
    return longs(k2(spark, sf).file_facts)


def k1_chunked(spark: SparkSession, sf: str, chunk_bytes: int = 1024) -> H.ChunkedAnalysis:
    """The code corpus analysed in chunks of about a kilobyte, so that most files have several."""
    corpus = materialize(K.k1_corpus(spark, sf), "k1_corpus", "write")
    return H.analyse_chunks(H.chunk_table(corpus, chunk_bytes), H.digests(corpus))


@query("file_facts_chunked")
def file_facts_chunked(spark, sf):
    return longs(k1_chunked(spark, sf).file_facts)


@query("functions_chunked")
def functions_chunked(spark, sf):
    return longs(k1_chunked(spark, sf, 256).functions)


@query("classes_chunked")
def classes_chunked(spark, sf):
    return longs(k1_chunked(spark, sf, 256).classes)


def k1_tree(spark: SparkSession, sf: str) -> str:
    """The code corpus as a directory tree, files of every thirteenth size with a NUL byte (no text files, then)."""
    corpus = materialize(K.k1_corpus(spark, sf), "k1_corpus", "write")
    content = F.col("content").cast("binary")
    nul = F.when(F.octet_length(content) % 13 == 0, F.concat(content, F.lit(b"\x00"))).otherwise(content)
    root = f"{checkpoint_dir(spark)}/tree-{uuid.uuid4().hex}"
    T.write_tree(corpus.select("repo_id", "path", nul.alias("content")), root)
    return root


@query("tree_file_facts")
def tree_file_facts(spark, sf):
    """Files listed and read from a tree by tasks."""
    return longs(analyze(W.walk_repo_tree(spark, k1_tree(spark, sf))).file_facts)


@query("tree_functions_chunked")
def tree_functions_chunked(spark, sf):
    """The same tree, read in ranges of half a kilobyte."""
    root = k1_tree(spark, sf)
    files = W.list_files(spark, root)
    return longs(H.analyse_chunks(W.read_chunks(files, root, chunk_bytes=512), W.file_digests(files, root)).functions)


@query("tree_scan")
def tree_scan(spark, sf):
    """The scan of a tree, from the listing alone."""
    return longs(analyze(W.walk_repo_tree(spark, k1_tree(spark, sf), content=False)).scanned)


@query("feature_counts")
def feature_counts(spark, sf):
    ff = k1(spark, sf).file_facts
    return longs(ff.groupBy("repo_id").agg(F.sum("feature_count").alias("feature_count")))


# ---------------------------------------------------------------------------
# 2.4 duplicates
# ---------------------------------------------------------------------------

@query("exact_duplicates")
def exact_duplicates(spark, sf):
    return longs(k1(spark, sf).exact_members)


@query("exact_duplicates_docs")
def exact_duplicates_docs(spark, sf):
    return longs(analyze(K.k2_single_repo(spark, sf), materialize="write").exact_members)


@query("near_duplicates")
def near_duplicates(spark, sf):
    return longs(k1(spark, sf).near_duplicates)


@query("all_duplicates")
def all_duplicates(spark, sf):
    return longs(k1(spark, sf).duplicates)


@query("duplicate_summary")
def duplicate_summary(spark, sf):
    return longs(k1(spark, sf).duplicate_counts)


@query("duplicate_summary_low")
def duplicate_summary_low(spark, sf):
    # a threshold that code lines alone can reach
    return longs(k1(spark, sf, near_threshold=0.25).duplicate_counts)


@query("duplicate_summary_all")
def duplicate_summary_all(spark, sf):
    # every pair of a language
    return longs(k1(spark, sf, near_threshold=0.0).duplicate_counts)


@query("near_links")
def near_links(spark, sf):
    return longs(k1(spark, sf).file_links)


@query("near_links_low")
def near_links_low(spark, sf):
    return longs(k1(spark, sf, near_threshold=0.25).file_links)


@query("duplicate_ranks")
def duplicate_ranks(spark, sf):
    return longs(k1(spark, sf).duplicate_ranks.select(
        "repo_id", "group_rank", "is_exact", "similarity", "file_1", "file_2", "n_files"))


@query("near_signature_pairs")
def near_signature_pairs(spark, sf):
    return longs(k1(spark, sf).signature_pairs)


@query("duplicate_members")
def duplicate_members(spark, sf):
    return k1(spark, sf).duplicate_members


@query("near_pairs_top10")
def near_pairs_top10(spark, sf):
    return longs(k1(spark, sf).first_duplicates.where("not is_exact").select(
        "repo_id", F.col("kind_rank").alias("rank"), "file_1", "file_2", "similarity"))


# ---------------------------------------------------------------------------
# 2.5 smells
# ---------------------------------------------------------------------------

@query("smell_inputs")
def smell_inputs(spark, sf):
    return longs(k1(spark, sf).smell_inputs)


@query("smell_scores")
def smell_scores(spark, sf):
    return longs(k1(spark, sf).smells)


@query("smell_results")
def smell_results(spark, sf):
    return longs(k1(spark, sf).smell_results)


@query("smell_scores_html")
def smell_scores_html(spark, sf):
    return longs(k3(spark, sf).smells)


# ---------------------------------------------------------------------------
# 2.6 metrics and health
# ---------------------------------------------------------------------------

@query("language_stats")
def language_stats(spark, sf):
    return longs(k1(spark, sf).language_stats)


@query("repo_metrics")
def repo_metrics(spark, sf):
    return longs(k1(spark, sf).repo_metrics)


@query("repo_metrics_docs")
def repo_metrics_docs(spark, sf):
    return longs(k2(spark, sf).repo_metrics)


@query("repo_metrics_user_ignore")
def repo_metrics_user_ignore(spark, sf):
    # with 'src' ignored, the repositories without a tests directory have no file left
    return longs(k1(spark, sf, extra_ignores=["src"]).repo_metrics)


PENALTIES = ["penalty_tests", "penalty_smells", "penalty_duplicates", "penalty_long_functions",
             "penalty_error_handling", "penalty_todos", "penalty_class_density"]


@query("health_score")
def health_score(spark, sf):
    m = k1(spark, sf).repo_metrics
    return longs(m.select("repo_id", *PENALTIES, "health_score", "risk_level"))


@query("defect_estimate")
def defect_estimate(spark, sf):
    m = k1(spark, sf).repo_metrics
    return longs(m.select("repo_id", "source_loc", "defect_density", "estimated_defects"))


@query("feature_interactions")
def feature_interactions(spark, sf):
    m = k1(spark, sf).repo_metrics
    return longs(m.select("repo_id", "feature_count", "feature_interactions"))


@query("sensitive_unhandled")
def sensitive_unhandled(spark, sf):
    a = k1(spark, sf)
    unhandled = a.file_facts.where(~F.col("has_error_handling")).select("repo_id", "path")
    f = a.functions.where("is_sensitive").join(unhandled, ["repo_id", "path"], "left_semi")
    return longs(f.select("repo_id", "path", "name", "start_line", "end_line"))


@query("functions_by_file")
def functions_by_file(spark, sf):
    fa = k1(spark, sf).analysis
    return longs(fa.where(F.size("functions") > 0).select(
        "repo_id", "path", F.size("functions").alias("function_count"),
        F.array_join(F.transform("functions", lambda f: f["name"]), ",").alias("names")))


SUMMARY = ["repo_id", "total_files", "source_files", "test_files", "source_loc", "test_loc",
           "test_to_code_ratio", "total_functions", "total_classes", "feature_count",
           "feature_interactions", "estimated_defects", "health_score", "risk_level",
           "duplicate_groups", "todos_count", "long_functions", "smell_scores", "languages"]


@query("repo_summary")
def repo_summary(spark, sf):
    a = k1(spark, sf)
    return longs(R.repo_summary(a.repo_metrics, a.language_stats, a.smells).select(*SUMMARY))


# ---------------------------------------------------------------------------
# 2.7 fix plan, 2.8 renderings, 2.9 report tables
# ---------------------------------------------------------------------------

from . import reports as R  # noqa: E402
from ..operators import fixes as G  # noqa: E402


def _fix_rows(fixes: DataFrame) -> DataFrame:
    return longs(fixes.select("repo_id", "fix_no", "rule", "priority", "title", "description", "prompt",
                              F.array_join("affected_files", "\n").alias("affected"), "verification"))


@query("fix_plan")
def fix_plan(spark, sf):
    return _fix_rows(k1(spark, sf).fixes)


@query("fix_plan_docs")
def fix_plan_docs(spark, sf):
    return _fix_rows(k2(spark, sf).fixes)


@query("fix_plan_one_repo")
def fix_plan_one_repo(spark, sf):
    # the whole code corpus as one repository, large enough for the size rule
    corpus = materialize(K.k1_single_repo(spark, sf), "k1_one", "write")
    return _fix_rows(analyze(corpus).fixes)


@query("fix_files")
def fix_files(spark, sf):
    return longs(k1(spark, sf).fix_files)


@query("fix_plans")
def fix_plans(spark, sf):
    return longs(k1(spark, sf).fix_plans)


@query("fix_priority_counts")
def fix_priority_counts(spark, sf):
    return longs(G.priority_counts(k1(spark, sf).fixes))


@query("render_markdown")
def render_markdown(spark, sf):
    a = k1(spark, sf)
    return R.render_markdown(a.fixes, a.repo_metrics)


@query("render_rules")
def render_rules(spark, sf):
    a = k1(spark, sf)
    return R.render_rules(a.fixes, a.repo_metrics)


@query("render_notes")
def render_notes(spark, sf):
    a = k1(spark, sf)
    return R.render_notes(a.fixes, a.repo_metrics)


@query("report_summary")
def report_summary(spark, sf):
    return longs(R.report_summary(k1(spark, sf).repo_metrics))


@query("report_files")
def report_files(spark, sf):
    return longs(R.report_files(k1(spark, sf).analysis))


@query("report_issues")
def report_issues(spark, sf):
    a = k1(spark, sf)
    return longs(R.report_issues(a.functions, a.todos))


@query("complex_files")
def complex_files(spark, sf):
    return longs(R.complex_files(k1(spark, sf).analysis))


@query("language_share")
def language_share(spark, sf):
    return longs(R.language_share(k1(spark, sf).language_stats))


@query("smell_ranking")
def smell_ranking(spark, sf):
    return longs(R.smell_ranking(k1(spark, sf).smells))


@query("coverage_label")
def coverage_label(spark, sf):
    return R.coverage_label(k1(spark, sf).repo_metrics)


@query("metric_cards")
def metric_cards(spark, sf):
    return longs(R.metric_cards(k1(spark, sf).repo_metrics))


@query("top_duplicates")
def top_duplicates(spark, sf):
    return longs(R.top_duplicates(k1(spark, sf).first_duplicates))


@query("top_fixes")
def top_fixes(spark, sf):
    a = k1(spark, sf)
    return longs(R.top_fixes(a.fixes, a.repo_metrics))


@query("report_json")
def report_json(spark, sf):
    a = k1(spark, sf)
    return R.report_json(a.repo_metrics, a.language_stats, a.smells, a.analysis)


@query("report_document")
def report_document(spark, sf):
    """Files and issues of the JSON documents, as read back from written packs."""
    parts = k1(spark, sf).document_parts
    path = f"{checkpoint_dir(spark)}/documents-{uuid.uuid4().hex}"
    P.write_documents(parts, path)
    back = unbounded(P.read_documents(spark, path))  # Spark knows the bytes of the index only
    return back.join(parts.select("repo_id", "part", "section"), ["repo_id", "part"]).where("section > 0").select(
        "repo_id", F.col("section").cast("bigint").alias("section"), "part", "text")


@query("smell_details")
def smell_details(spark, sf):
    return longs(k1(spark, sf).smell_details)


@query("smell_details_html")
def smell_details_html(spark, sf):
    return longs(k3(spark, sf).smell_details)


@query("content_hash")
def content_hash(spark, sf):
    """D1 on Unicode text: md5 of the raw UTF-8 bytes and the byte size of every analysed document."""
    return longs(k2(spark, sf).file_facts.select("repo_id", "path", "md5", "size_bytes"))
