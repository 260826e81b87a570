"""The analysis bundle: every derived table of a corpus, as lazy DataFrames.

``analyze(corpus)`` wires sources and operators together::

    corpus -> source_files -> file_analysis (one row per file, map-only)
           -> file_facts / functions / classes / todos / imports / literals
           -> smells, duplicates, repo metrics, fixes, reports

``file_analysis`` is read by many branches (smells, duplicates, metrics). With
``materialize="write"`` (the default) it is written once, as Parquet under ``shared_dir``
or else the session's ``spark.checkpoint.dir``, when the first branch asks for it; the
caller may delete the folder afterwards. ``"persist"`` caches with lineage instead,
``"none"`` recomputes it in each branch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..operators import duplicates as D
from ..operators import fixes as G
from ..operators import lines as L
from ..operators import metrics as M
from ..operators import near_classes as N
from ..operators import smells as E
from ..operators import structure as S
from ..session import materialize
from ..sources import corpus as C
from .documents import document_parts


SMALL_SPLITS = {"spark.sql.files.maxPartitionBytes": "8m"}


@dataclass
class Analysis:
    corpus: DataFrame
    extra_ignores: Sequence[str] = ()
    materialize: str = "write"
    near_threshold: float = dims.NEAR_DUP_DEFAULT_THRESHOLD
    keep_lines: bool = False
    ai_generated: bool = True
    base_density: float = dims.DEFECT_DENSITY_BASE
    shared_dir: str | None = None

    def _reuse(self, df: DataFrame, name: str) -> DataFrame:
        """Materialise an intermediate that several downstream tables read (same mode as the analysis)."""
        return materialize(df, name, self.materialize, self.shared_dir)

    # --- sources -----------------------------------------------------------
    @cached_property
    def repos(self) -> DataFrame:
        """Repository dimension: every repo_id of the corpus, even with no kept file."""
        return self.corpus.select("repo_id").distinct()

    @cached_property
    def path_rules(self) -> DataFrame:
        return C.path_rules(self.corpus, self.extra_ignores)

    @cached_property
    def source_files(self) -> DataFrame:
        return C.source_files(self.corpus, self.extra_ignores)

    @cached_property
    def scanned(self) -> DataFrame:
        """Scanned files without the text; reads no content if the corpus has ``size_bytes``."""
        return C.scanned_files(self.corpus, self.extra_ignores)

    # --- per-file analysis --------------------------------------------------
    @cached_property
    def analysis(self) -> DataFrame:
        fa = S.file_analysis(self.source_files, keep_lines=self.keep_lines)
        # a compressed megabyte of code is seconds of work: small splits, or a few tasks hold up the rest
        return materialize(fa, "file_analysis", self.materialize, self.shared_dir, SMALL_SPLITS)

    @cached_property
    def file_facts(self) -> DataFrame:
        return S.file_facts(self.analysis)

    @cached_property
    def functions(self) -> DataFrame:
        return S.functions(self.analysis)

    @cached_property
    def classes(self) -> DataFrame:
        return S.classes(self.analysis)

    @cached_property
    def todos(self) -> DataFrame:
        return S.todos(self.analysis)

    @cached_property
    def imports(self) -> DataFrame:
        return S.imports(self.analysis)

    @cached_property
    def literals(self) -> DataFrame:
        return S.literals(self.analysis)

    @cached_property
    def lines(self) -> DataFrame:
        if not self.keep_lines:
            raise ValueError("analyze(..., keep_lines=True) is needed for the line table")
        return L.lines(self.analysis)

    # --- smells -------------------------------------------------------------
    @cached_property
    def smell_inputs(self) -> DataFrame:
        return E.smell_inputs(self.repos, self.analysis, self.functions, self.literals)

    @cached_property
    def smells_wide(self) -> DataFrame:
        return self._reuse(E.smell_scores_wide(self.smell_inputs), "smells_wide")

    @cached_property
    def smells(self) -> DataFrame:
        return E.smell_scores_long(self.smells_wide)

    @cached_property
    def smell_results(self) -> DataFrame:
        return E.smell_results(self.smells_wide)

    @cached_property
    def smell_details(self) -> DataFrame:
        return E.smell_details(self.analysis, self.functions, self.classes, self.literals,
                               self.smells_wide)

    # --- duplicates -----------------------------------------------------------
    @cached_property
    def exact_groups(self) -> DataFrame:
        return D.exact_groups(self.analysis)

    @cached_property
    def exact_members(self) -> DataFrame:
        return D.exact_members(self.analysis, self.exact_groups)

    @cached_property
    def near_duplicates(self) -> DataFrame:
        return D.near_duplicates(self.analysis, self.near_threshold, keep=self._reuse)

    @cached_property
    def duplicates(self) -> DataFrame:
        """The full list, file pairs expanded; the tables below do without it."""
        return D.all_duplicates(self.analysis, self.near_threshold, self._reuse)

    @cached_property
    def duplicate_ranks(self) -> DataFrame:
        """The full list with ``group_rank``, every row's place in its repository's list."""
        return D.ranked_list(self.duplicates, self.shared_dir)

    @cached_property
    def signature_members(self) -> DataFrame:
        return self._reuse(N.class_members(D.signature_members(self.analysis)), "signatures")

    @cached_property
    def signature_pairs(self) -> DataFrame:
        return self._reuse(D.near_signature_pairs(D.distinct_signatures(self.signature_members), self.near_threshold,
                                                  keep=self._reuse), "signature_pairs")

    @cached_property
    def name_classes(self) -> DataFrame:
        return self._reuse(N.histograms(self.signature_members), "name_classes")

    @cached_property
    def class_pairs(self) -> DataFrame:
        return self._reuse(N.class_pairs(self.name_classes, self.near_threshold), "class_pairs")

    @cached_property
    def near_links(self) -> DataFrame:
        return self._reuse(N.near_links(self.signature_members, self.name_classes, self.near_threshold),
                           "near_links")

    @cached_property
    def file_links(self) -> DataFrame:
        return N.file_links(self.signature_members, self.near_links)

    @cached_property
    def first_near_pairs(self) -> DataFrame:
        if self.near_threshold > dims.SIMILARITY_WEIGHTS[0]:
            return N.first_near_pairs(self.signature_members, self.exact_groups, self.name_classes, 10, self.near_threshold,
                                      self._reuse)
        return D.first_listed_pairs(self.signature_pairs, self.signature_members)

    @cached_property
    def first_duplicates(self) -> DataFrame:
        return self._reuse(D.first_duplicates(self.exact_groups, self.first_near_pairs, self.signature_members),
                           "first_duplicates")

    @cached_property
    def duplicate_members(self) -> DataFrame:
        return N.duplicate_members(self.exact_members, self.signature_members, self.near_links)

    @cached_property
    def duplicate_counts(self) -> DataFrame:
        hidden = N.hidden_pairs(self.exact_groups, self.signature_members, self.near_threshold)
        return N.duplicate_counts(self.repos, self.exact_groups, self.near_links, hidden)

    # --- metrics --------------------------------------------------------------
    @cached_property
    def language_stats(self) -> DataFrame:
        return M.language_stats(self.scanned, self.analysis)

    @cached_property
    def repo_metrics(self) -> DataFrame:
        return self._reuse(M.repo_metrics(self.repos, self.scanned, self.analysis, self.smells_wide,
                                          self.duplicate_counts, self.ai_generated, self.base_density),
                           "repo_metrics")

    # --- fix plan ---------------------------------------------------------------
    @cached_property
    def fixes(self) -> DataFrame:
        rules = G.fix_rules(self.repo_metrics, self.analysis, self.functions, self.todos,
                            self.first_duplicates, self.exact_members, self.smells)
        return G.number_fixes(rules)

    @cached_property
    def fix_files(self) -> DataFrame:
        return G.fix_files(self.fixes, self.first_duplicates, self.exact_members)

    @cached_property
    def document_parts(self) -> DataFrame:
        """The JSON documents of all repositories in numbered parts; ``sinks.packs`` writes them."""
        return document_parts(self.repo_metrics, self.language_stats, self.smells, self.analysis, self.functions,
                              self.todos, self.shared_dir)

    @cached_property
    def fix_plans(self) -> DataFrame:
        return G.fix_plans(self.repo_metrics, self.fixes)


def analyze(corpus: DataFrame, extra_ignores: Sequence[str] = (), materialize: str = "write",
            near_threshold: float = dims.NEAR_DUP_DEFAULT_THRESHOLD,
            keep_lines: bool = False, ai_generated: bool = True,
            base_density: float = dims.DEFECT_DENSITY_BASE, shared_dir: str | None = None) -> Analysis:
    """Lazy bundle of every derived table of ``corpus`` (see the module docstring).

    Tunables: extra ignored directory names, the near-duplicate threshold and
    the defect-density model (``ai_generated`` multiplier, ``base_density``).
    """
    return Analysis(corpus=corpus, extra_ignores=tuple(extra_ignores), materialize=materialize,
                    near_threshold=near_threshold, keep_lines=keep_lines,
                    ai_generated=ai_generated, base_density=base_density, shared_dir=shared_dir)


def longs(df: DataFrame) -> DataFrame:
    """Cast INT columns to BIGINT (stable result schema across engines)."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c)
                       for c, t in df.dtypes])
