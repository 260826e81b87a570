"""Exact and near-duplicate files.

Exact duplicates: analysed files (any language, tests and empty files included)
grouped by ``(repo_id, md5)``; a group has at least two files. Groups are kept
in long form (one row per member) so a hash shared by millions of files never
becomes one collected list.

Near duplicates: files with at least 10 code lines, same repository and
language, similarity ``0.3*line + 0.5*func + 0.2*class >= threshold`` where
``line`` = min/max of code lines and ``func`` / ``class`` are Jaccard indexes of
the distinct function / class names (0 when either side has none).

The original compares every pair of a language. Here candidate pairs come from
equi-joins on ``(repo_id, language, name)``, and the blocking is exact (no
qualifying pair is lost). For a threshold T > 0.3 a qualifying pair must share
a name, and falls in one of three cases:

* class Jaccard ``>= c*``: found by prefix filtering on class names;
* one side has no class (class term 0): the function Jaccard must reach
  ``t0 = (T - 0.3) / 0.5`` (0.4 at the default);
* both sides have classes, class Jaccard ``< c*``: the function Jaccard must
  reach ``t_f = (T - 0.3 - 0.2 c*) / 0.5`` (only files with classes are indexed).

Prefix filtering (size-aware, as in PPJoin): names are ordered by document
frequency, so rare names come first. For Jaccard >= t the smaller set indexes
its ``k - ceil(2t/(1+t) k) + 1`` first names and the larger set its
``k - ceil(t k) + 1`` first names, with the length filter ``|A| >= t |B|``.
Common names (``main``, ``__init__``) therefore only pair up files that have
little else, which are the pairs that can actually qualify.

For T <= 0.3 a pair with no shared name can qualify on line similarity alone
(``min/max >= T/0.3``): a geometric bucketing of code-line counts joins each
bucket with itself and its neighbour, next to joins on every shared name. For
T <= 0 every pair of a language is one.

Listing pairs is for callers that want the list. Counts, links per file and the
first pairs of a repository come from ``near_classes`` and make no pair list.

Candidates are then scored exactly and filtered with ``>= T``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from .near_lists import Keep, near_list, same
from .ranks import ranked

EPS = 1e-9


# ---------------------------------------------------------------------------
# exact
# ---------------------------------------------------------------------------

def exact_groups(analysis: DataFrame) -> DataFrame:
    """(repo_id, md5, n_files, first_path, second_path, last_path) for hashes shared by >= 2 files."""
    return (analysis.groupBy("repo_id", "md5")
            .agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_path"),
                 F.max("path").alias("last_path"))
            .where(F.col("n_files") > 1))


def exact_members(analysis: DataFrame, groups: DataFrame) -> DataFrame:
    """(repo_id, md5, first_path, n_files, path): one row per member of an exact group."""
    return (analysis.select("repo_id", "md5", "path")
            .join(groups.select("repo_id", "md5", "first_path", "n_files"), ["repo_id", "md5"]))


# ---------------------------------------------------------------------------
# near
# ---------------------------------------------------------------------------

def signatures(analysis: DataFrame) -> DataFrame:
    """Eligible files with their distinct function and class names (arrays of one file)."""
    return (analysis.where(F.col("code_lines") >= dims.NEAR_DUP_MIN_CODE_LINES)
            .select("repo_id", "path", "language", "code_lines",
                    F.array_distinct(F.transform("functions", lambda f: f["name"])).alias("fnames"),
                    F.array_distinct(F.transform("classes", lambda c: c["name"])).alias("cnames")))


def _ranked_tokens(sigs: DataFrame, names_col: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """Each file's distinct names with k = set size and pos = rank by (document frequency, name).

    Any fixed global order keeps prefix filtering exact, so one ranking serves
    every threshold and every subset of files.
    """
    tokens = sigs.select("repo_id", "language", "path", (F.size("cnames") > 0).alias("has_classes"),
                         (F.size("fnames") + F.size("cnames")).alias("n_names"), *carried, F.size(names_col).alias("k"), F.explode(names_col).alias("name"))
    freq = tokens.groupBy("repo_id", "language", "name").agg(F.count(F.lit(1)).alias("dfreq"))
    w = Window.partitionBy("repo_id", "path").orderBy("dfreq", "name")
    return tokens.join(freq, ["repo_id", "language", "name"]).withColumn("pos", F.row_number().over(w))


def _prefix_len(t: float | Column, factor: float | Column) -> Column:
    """k - ceil(factor * t * k) + 1 (never shorter than the exact bound; all tokens for t <= 0)."""
    if not isinstance(t, Column) and t <= 0:
        return F.col("k") + 1
    need = F.ceil(factor * t * F.col("k") - F.lit(EPS))
    return F.col("k") - F.greatest(need, F.lit(0)) + 1


def _prefix_pairs(sigs_or_ranked: DataFrame, names_col: str, t: float | Column, most: int | None = None) -> DataFrame:
    """Candidate pairs that share a prefix token; complete for every pair with Jaccard >= t, which may be a positive
    column that is equal on both sides. With ``most``, pairs of which one side at least has more names than that.

    For a pair with J >= t, take A as the smaller set (ties: smaller path). Then
    |A| >= t|B| and the overlap is at least t/(1+t)(|A|+|B|). That is at least
    2t/(1+t)|A| on A's side and at least t|B| on B's side, so A's short prefix
    (``k - ceil(2t/(1+t) k) + 1``) meets B's long prefix (``k - ceil(t k) + 1``).
    """
    ranked = (sigs_or_ranked if "pos" in sigs_or_ranked.columns
              else _ranked_tokens(sigs_or_ranked, names_col))
    each = isinstance(t, Column)
    short = ranked.where(F.col("pos") <= _prefix_len(t, 2.0 / (1.0 + t) if each or t > 0 else 1.0))
    long_ = ranked.where(F.col("pos") <= _prefix_len(t, 1.0))
    a = short.select("repo_id", "language", "name", F.col("path").alias("pa"), F.col("k").alias("ka"), F.col("n_names").alias("na"))
    b = long_.select("repo_id", "language", "name", F.col("path").alias("pb"), F.col("k").alias("kb"), F.col("n_names").alias("nb"),
                     (t if each else F.lit(float(t))).alias("t"))
    cond = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("pa") < F.col("pb")))
    if each or t > 0:
        cond = cond & (F.col("ka").cast("double") >= F.col("t") * F.col("kb").cast("double") - F.lit(EPS))
    on = ["repo_id", "language", "name"]
    if most is None:
        met = a.join(b, on)
    else:
        met = a.where(F.col("na") > most).join(b, on).unionByName(a.where(F.col("na") <= most).join(b.where(F.col("nb") > most), on))
    return met.where(cond).select("repo_id", "language", F.least("pa", "pb").alias("path1"), F.greatest("pa", "pb").alias("path2"))


def _line_band_pairs(sigs: DataFrame, ratio: float) -> DataFrame:
    """Pairs whose code-line ratio can reach ``ratio`` (same or adjacent geometric bucket)."""
    if ratio >= 1.0:
        bucket = F.col("code_lines").cast("double")
        width = None
    else:
        width = -math.log(ratio) * (1.0 + 1e-6)
        bucket = F.floor(F.log(F.col("code_lines").cast("double")) / F.lit(width))
    base = sigs.select("repo_id", "language", "path", "code_lines", bucket.alias("b"))
    a = base.alias("a")
    shifted = base.select("repo_id", "language", "path", "code_lines", "b")
    offsets = [0] if width is None else [0, 1]
    out = None
    for off in offsets:
        bb = shifted.withColumn("b", F.col("b") - F.lit(off)).alias("b")
        j = (a.join(bb, (F.col("a.repo_id") == F.col("b.repo_id"))
                    & (F.col("a.language") == F.col("b.language"))
                    & (F.col("a.b") == F.col("b.b"))
                    & (F.col("a.path") != F.col("b.path")))
             .select(F.col("a.repo_id").alias("repo_id"), F.col("a.language").alias("language"),
                     F.least("a.path", "b.path").alias("path1"),
                     F.greatest("a.path", "b.path").alias("path2")))
        out = j if out is None else out.unionByName(j)
    return out


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b)).cast("double"))


def signature_members(analysis: DataFrame) -> DataFrame:
    """Eligible files with the signature that alone decides their similarity: language, code lines, names.

    Files of equal signature are alike in every comparison, so only distinct signatures are compared.
    """
    names = F.to_json(F.struct("code_lines", F.array_sort("fnames").alias("f"), F.array_sort("cnames").alias("c")))
    return signatures(analysis).withColumn("sig", F.md5(names))


def distinct_signatures(members: DataFrame) -> DataFrame:
    """One row per (repo_id, language, signature); ``path`` is its first file, ``n_files`` their number."""
    return members.groupBy("repo_id", "language", "sig").agg(
        F.min("path").alias("path"), F.count(F.lit(1)).alias("n_files"), F.first("code_lines").alias("code_lines"),
        F.first("fnames").alias("fnames"), F.first("cnames").alias("cnames"))


def near_signature_pairs(sigs: DataFrame, threshold: float = dims.NEAR_DUP_DEFAULT_THRESHOLD,
                         class_split: float | None = None, keep: Keep = same) -> DataFrame:
    """Pairs of signatures that reach the threshold, a signature of several files with itself included.

    (repo_id, language, path1, path2, n_files1, n_files2, n_pairs, line_sim, func_sim, class_sim, similarity);
    ``path1 <= path2`` are the signatures' first files, ``n_pairs`` the pairs of files that they stand for.
    """
    wl, wf, wc = dims.SIMILARITY_WEIGHTS
    if threshold > wl:
        one, two = F.col("one"), F.col("two")
        own = F.expr("one.n * (one.n - 1) div 2")
        return near_list(sigs.withColumnRenamed("n_files", "n"), threshold, class_split, keep).select(
            "repo_id", "language", one["path"].alias("path1"), two["path"].alias("path2"), one["n"].alias("n_files1"),
            two["n"].alias("n_files2"), F.when(one["path"] == two["path"], own).otherwise(one["n"] * two["n"]).alias("n_pairs"),
            "line_sim", "func_sim", "class_sim", "similarity")
    within = sigs.where("n_files > 1").select(
        "repo_id", "language", F.col("path").alias("path1"), F.col("path").alias("path2"),
        F.col("n_files").alias("n_files1"), F.col("n_files").alias("n_files2"),
        F.expr("n_files * (n_files - 1) div 2").alias("n_pairs"), F.lit(1.0).alias("line_sim"),
        F.when(F.size("fnames") > 0, 1.0).otherwise(0.0).alias("func_sim"),
        F.when(F.size("cnames") > 0, 1.0).otherwise(0.0).alias("class_sim"))
    side = sigs.select("repo_id", "path", "n_files")
    across = (_scored_pairs(sigs, threshold, class_split)
              .join(side.withColumnsRenamed({"path": "path1", "n_files": "n_files1"}), ["repo_id", "path1"])
              .join(side.withColumnsRenamed({"path": "path2", "n_files": "n_files2"}), ["repo_id", "path2"])
              .withColumn("n_pairs", F.col("n_files1") * F.col("n_files2")).select(*within.columns))
    sim = (F.col("line_sim") * F.lit(wl) + F.col("func_sim") * F.lit(wf) + F.col("class_sim") * F.lit(wc))
    return within.unionByName(across).withColumn("similarity", sim).where(F.col("similarity") >= F.lit(threshold))


def _expand(pairs: DataFrame, members: DataFrame, first: int | None = None) -> DataFrame:
    """File pairs of signature pairs; with ``first``, only among the first files of each signature."""
    files = members.select("repo_id", "language", "sig", F.col("path").alias("file"))
    named = files.join(distinct_signatures(members).select("repo_id", "language", "sig", "path"),
                       ["repo_id", "language", "sig"]).drop("sig")
    if first is not None:
        w = Window.partitionBy("repo_id", "language", "path").orderBy("file")
        named = named.withColumn("r", F.row_number().over(w)).where(F.col("r") <= first).drop("r")
    one = named.withColumnsRenamed({"path": "path1", "file": "a"})
    two = named.withColumnsRenamed({"path": "path2", "file": "b"})
    both = pairs.join(one, ["repo_id", "language", "path1"]).join(two, ["repo_id", "language", "path2"])
    return both.where((F.col("path1") != F.col("path2")) | (F.col("a") < F.col("b"))).select(
        "repo_id", "language", F.least("a", "b").alias("path1"), F.greatest("a", "b").alias("path2"),
        "line_sim", "func_sim", "class_sim", "similarity")


def near_duplicates(analysis: DataFrame, threshold: float = dims.NEAR_DUP_DEFAULT_THRESHOLD,
                    class_split: float | None = None, keep: Keep = same) -> DataFrame:
    """(repo_id, language, path1, path2, line_sim, func_sim, class_sim, similarity), path1 < path2.

    The full list of file pairs, which is quadratic in the files of a signature by definition; counts and
    first-k lists come from ``near_classes`` and never expand it. Above the line weight no pair is shuffled (``near_lists``).
    """
    if threshold > dims.SIMILARITY_WEIGHTS[0]:
        return near_list(signatures(analysis), threshold, class_split, keep).select(
            "repo_id", "language", F.col("one")["path"].alias("path1"), F.col("two")["path"].alias("path2"),
            "line_sim", "func_sim", "class_sim", "similarity")
    members = signature_members(analysis)
    return _expand(near_signature_pairs(distinct_signatures(members), threshold, class_split), members)


def _language_pairs(sigs: DataFrame) -> DataFrame:
    """Every pair of a language, which is what a threshold of 0 or less asks for."""
    a = sigs.select("repo_id", "language", F.col("path").alias("path1"))
    b = sigs.select("repo_id", "language", F.col("path").alias("path2"))
    return a.join(b, ["repo_id", "language"]).where("path1 < path2")


def _scored_pairs(sigs: DataFrame, threshold: float, class_split: float | None) -> DataFrame:
    """Pairs of different signatures that may reach the threshold, with their three similarities."""
    wl, wf, wc = dims.SIMILARITY_WEIGHTS
    if threshold <= 0:
        cands = _language_pairs(sigs)
    elif threshold > wl:
        # (i) class Jaccard >= c*; (ii) a side without classes: class term 0, so the function
        # Jaccard must reach t0; (iii) both sides with classes and class Jaccard < c*: t_f.
        c_star = class_split if class_split is not None else min(0.5, (threshold - wl) / (2 * wc))
        t0 = (threshold - wl) / wf
        t_f = (threshold - wl - wc * c_star) / wf
        ranked_f = _ranked_tokens(sigs, "fnames")
        cands = (_prefix_pairs(sigs, "cnames", c_star)
                 .unionByName(_prefix_pairs(ranked_f, "fnames", t0))
                 .unionByName(_prefix_pairs(ranked_f.where("has_classes"), "fnames", t_f)))
    else:
        # every shared name is a candidate, plus pairs that qualify on line counts alone
        cands = (_prefix_pairs(sigs, "fnames", 0.0)
                 .unionByName(_prefix_pairs(sigs, "cnames", 0.0))
                 .unionByName(_line_band_pairs(sigs, threshold / wl)))
    cands = cands.distinct()

    s1 = sigs.select(F.col("repo_id"), F.col("path").alias("path1"),
                     F.col("code_lines").alias("l1"), F.col("fnames").alias("f1"),
                     F.col("cnames").alias("c1"))
    s2 = sigs.select(F.col("repo_id"), F.col("path").alias("path2"),
                     F.col("code_lines").alias("l2"), F.col("fnames").alias("f2"),
                     F.col("cnames").alias("c2"))
    scored = cands.join(s1, ["repo_id", "path1"]).join(s2, ["repo_id", "path2"])
    lo, hi = F.least("l1", "l2"), F.greatest("l1", "l2")
    line_sim = (F.when((F.col("l1") == 0) & (F.col("l2") == 0), F.lit(1.0))
                .when((F.col("l1") == 0) | (F.col("l2") == 0), F.lit(0.0))
                .otherwise(lo.cast("double") / hi.cast("double")))
    return scored.select(
        "repo_id", "language", "path1", "path2",
        line_sim.alias("line_sim"), jaccard(F.col("f1"), F.col("f2")).alias("func_sim"),
        jaccard(F.col("c1"), F.col("c2")).alias("class_sim"))


# ---------------------------------------------------------------------------
# combined list
# ---------------------------------------------------------------------------

def _pairs_of_two(groups: DataFrame) -> DataFrame:
    return groups.where(F.col("n_files") == 2).select(
        "repo_id", F.col("first_path").alias("path1"), F.col("last_path").alias("path2"))


def _near_rows(near: DataFrame) -> DataFrame:
    """Near pairs as rows of the list."""
    return near.select(
        "repo_id", F.lit(False).alias("is_exact"), "similarity",
        F.col("path1").alias("file_1"), F.col("path2").alias("file_2"),
        F.lit(2).cast("bigint").alias("n_files"),
        F.to_json(F.array("path1", "path2")).alias("group_key"),
        F.lit(1).alias("kind_order"), (-F.col("similarity")).alias("sim_order"), "lang_order")


def _exact_rows(groups: DataFrame) -> DataFrame:
    """Exact groups as rows of the list."""
    return groups.select(
        "repo_id", F.lit(True).alias("is_exact"), F.lit(1.0).alias("similarity"),
        F.col("first_path").alias("file_1"),
        F.when(F.col("n_files") == 2, F.col("last_path")).alias("file_2"),
        F.col("n_files"), F.col("md5").alias("group_key"),
        F.lit(0).alias("kind_order"), F.lit(-1.0).alias("sim_order"), F.lit("").alias("lang_order"))


def _lang_first(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id", "language").agg(F.min("path").alias("lang_order"))


def _listed(groups: DataFrame, near: DataFrame, members: DataFrame) -> DataFrame:
    """Exact groups, then near pairs that are no two-file exact group, with the keys of the list order."""
    near_kept = near.join(_pairs_of_two(groups), ["repo_id", "path1", "path2"], "left_anti")
    return _exact_rows(groups).unionByName(_near_rows(near_kept.join(_lang_first(members), ["repo_id", "language"])))


def all_duplicates(analysis: DataFrame, threshold: float = dims.NEAR_DUP_DEFAULT_THRESHOLD, keep: Keep = same) -> DataFrame:
    """Exact groups then near pairs (near pairs equal to a two-file exact group removed).

    Columns: repo_id, is_exact, similarity, file_1, file_2, n_files, group_key and
    the order keys (kind_order, sim_order, lang_order) giving the list order:
    exact groups by first path, then near pairs by similarity descending, ties
    by the language's first path, then the two paths. Consumers sort by these
    keys (a range-partitioned sort splits a hot repository across tasks). The members
    of a group of three files or more are those of its ``group_key`` in ``duplicate_members``.

    Above the line weight no pair is shuffled: each file brings the first path of its language and the key of its
    exact group of two.
    """
    groups = exact_groups(analysis)
    if threshold > dims.SIMILARITY_WEIGHTS[0]:
        files = signatures(analysis)
        twins = groups.where(F.col("n_files") == 2).select(
            "repo_id", F.explode(F.array("first_path", "last_path")).alias("path"), F.col("md5").alias("twin"))
        items = files.join(_lang_first(files), ["repo_id", "language"]).join(twins, ["repo_id", "path"], "left")
        near = near_list(items, threshold, keep=keep).withColumns({"path1": F.col("one")["path"], "path2": F.col("two")["path"]})
        return _exact_rows(groups).unionByName(_near_rows(near))
    return _listed(groups, near_duplicates(analysis, threshold), signature_members(analysis))


ORDER_KEYS = ["kind_order", "sim_order", "lang_order", "file_1", "file_2"]


def ranked_list(listed: DataFrame, base: str | None = None) -> DataFrame:
    """``all_duplicates`` with ``group_rank``, every row's place in its repository's list. What follows from the other
    columns is left out of the rows that are sorted."""
    near = ~F.col("is_exact")
    narrow = listed.select("repo_id", "is_exact", "similarity", "file_1", "file_2", "lang_order",
                           F.when(~near, F.col("n_files")).alias("n_files"), F.when(~near, F.col("group_key")).alias("group_key"))
    kind, sim = F.when(near, F.lit(1)).otherwise(F.lit(0)), -F.col("similarity")
    placed = ranked(narrow, "repo_id", [kind, sim, "lang_order", "file_1", "file_2"], "group_rank", base)
    return placed.withColumns({
        "n_files": F.coalesce("n_files", F.lit(2).cast("bigint")),
        "group_key": F.coalesce("group_key", F.to_json(F.array("file_1", "file_2"))),
        "kind_order": kind, "sim_order": sim}).select(*listed.columns, "group_rank")


def first_duplicates(groups: DataFrame, near: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    """The first k exact groups and the first k near pairs of each repository; ``near`` holds at least those pairs."""
    w = Window.partitionBy("repo_id", "is_exact").orderBy(*ORDER_KEYS)
    return _listed(groups, near, members).withColumn("kind_rank", F.row_number().over(w)).where(F.col("kind_rank") <= k)


def first_listed_pairs(pairs: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    """From signature pairs, file pairs that hold the first k of each repository, without expanding all of them.

    A pair among the first k of its two signatures has both files among their first k; within one
    signature, a file can lose one partner to a two-file exact group.
    """
    return _expand(pairs, members, first=k + 2)
