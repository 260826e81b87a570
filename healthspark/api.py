"""Function-style entry points under the names users of the original tool know.

Each takes DataFrames and returns a DataFrame; a single code base is a corpus
with one ``repo_id``. They are thin names over the operators (no extra logic).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from .functions import dims
from .operators import chunks as H
from .operators import duplicates as D
from .operators import fixes as G
from .operators import metrics as M
from .operators import smells as E
from .operators import structure as S
from .plans import reports as R
from .plans.analysis import Analysis, analyze
from .sinks import packs as P
from .sources import corpus as C
from .sources import walk as W


def scan_codebase(spark: SparkSession, path: str, additional_ignores: Sequence[str] = (),
                  repo_id: str = "codebase") -> DataFrame:
    """Scanned source files of one directory tree (sorted order is ``orderBy('path')``)."""
    return C.source_files(C.read_repo_tree(spark, path, repo_id=repo_id), additional_ignores)


def get_language_breakdown(files: DataFrame) -> DataFrame:
    return C.language_breakdown(files)


def analyze_files(files: DataFrame) -> DataFrame:
    return S.file_analysis(files)


def find_exact_duplicates(analysis: DataFrame) -> DataFrame:
    return D.exact_members(analysis, D.exact_groups(analysis))


def find_near_duplicates(analysis: DataFrame, threshold: float = dims.NEAR_DUP_DEFAULT_THRESHOLD) -> DataFrame:
    return D.near_duplicates(analysis, threshold)


def find_all_duplicates(analysis: DataFrame,
                        near_duplicate_threshold: float = dims.NEAR_DUP_DEFAULT_THRESHOLD) -> DataFrame:
    return D.all_duplicates(analysis, near_duplicate_threshold)


def detect_all_smells(a: Analysis) -> DataFrame:
    """(repo_id, smell, ordinal, score) for the eight detectors."""
    return a.smells


def _detector(name: str):
    def detect(analysis: DataFrame) -> DataFrame:
        inputs = E.smell_inputs(analysis.select("repo_id").distinct(), analysis, S.functions(analysis), S.literals(analysis))
        return E.smell_results(E.smell_scores_wide(inputs)).where(E.F.col("smell") == name).select(
            "repo_id", "score", "description")
    detect.__name__ = f"detect_{name}"
    detect.__doc__ = f"(repo_id, score, description) of the {name} detector over a per-file analysis table."
    return detect


for _name in dims.SMELL_ORDER:
    globals()[f"detect_{_name}"] = _detector(_name)


def aggregate_metrics(a: Analysis) -> DataFrame:
    return a.repo_metrics


def calculate_defect_estimate(source_loc: Column, ai_generated: bool = True,
                              base_density: float = dims.DEFECT_DENSITY_BASE) -> tuple[Column, Column]:
    return M.defect_estimate(source_loc, ai_generated, base_density)


def calculate_health_score(metrics: DataFrame) -> DataFrame:
    return M.with_health(metrics)


def determine_risk_level(score: Column) -> Column:
    return M.risk_level(score)


def generate_fix_plan(a: Analysis) -> DataFrame:
    return a.fixes


def priority_counts(fixes: DataFrame) -> DataFrame:
    return G.priority_counts(fixes)


def render_markdown(a: Analysis) -> DataFrame:
    return R.render_markdown(a.fixes, a.repo_metrics)


def render_rules(a: Analysis) -> DataFrame:
    return R.render_rules(a.fixes, a.repo_metrics)


def render_notes(a: Analysis) -> DataFrame:
    return R.render_notes(a.fixes, a.repo_metrics)


def generate_json_report(a: Analysis) -> DataFrame:
    return R.report_json(a.repo_metrics, a.language_stats, a.smells, a.analysis)


def generate_json_documents(a: Analysis, path: str) -> None:
    """Writes the whole JSON document of every repository as packs; ``sinks.packs.read_document`` reads one."""
    P.write_documents(a.document_parts, path)


def analyze_tree_in_chunks(spark: SparkSession, root: str, repo_id: str | None = None, chunk_bytes: int = 4 << 20) -> H.ChunkedAnalysis:
    """Flat analysis tables of a tree of any store and files of any size."""
    files = W.list_files(spark, root)
    return H.analyse_chunks(W.read_chunks(files, root, repo_id, chunk_bytes), W.file_digests(files, root, repo_id))


__all__ = [n for n in dir() if n.startswith(("scan_", "get_", "analyze", "find_", "detect_", "aggregate_",
                                              "calculate_", "determine_", "generate_", "render_", "priority"))]
