"""Near duplicates counted and listed by name classes, without a list of pairs.

Files with the same function and class names form a name class; only their code lines tell them apart.
So two classes (or one class with itself) have one function term and one class term, and a pair of files
qualifies if its line ratio is high enough. For a file of one class the partners in the other are those whose
code lines lie in one interval around its own: the similarity falls on both sides of equality. A class
is a histogram of code lines, and partners are counted by two binary searches and a difference of
prefix sums. 100 000 one-function files are one class and a few hundred numbers.

Pairs of classes come from the same exact prefix filter as pairs of files, over classes. At thresholds of
at most the line weight a pair may qualify without a common name: such partners are counted once per
language, over one histogram of all its files, and pairs of classes that share a name add what they
have beyond that. At a threshold of 0 or less every pair of a language counts.

The first k pairs of a repository come from a best-first walk: each pair of classes names its best pair, the
k best of these name the pairs of classes that matter, and each of those lists its first k by decreasing
ratio, from the first files of every code-line count.

Similarities are compared in the arithmetic of the listing: ``(ratio * 0.3 + func * 0.5) + class * 0.2``.
"""

from __future__ import annotations

import heapq
import sys
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..session import unbounded
from .duplicates import _pairs_of_two, _prefix_pairs, _ranked_tokens, jaccard
from .shared_names import MOST_NAMES, shared_links

# task functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLASS = ["repo_id", "language", "cls"]
WEIGHTS = dims.SIMILARITY_WEIGHTS


def class_members(members: DataFrame) -> DataFrame:
    """``signature_members`` with ``cls``, the key of a file's name class (a class belongs to one language)."""
    names = F.to_json(F.struct("language", F.array_sort("fnames").alias("f"), F.array_sort("cnames").alias("c")))
    return members.withColumn("cls", F.md5(names))


def histograms(members: DataFrame) -> DataFrame:
    """(repo_id, language, cls, fnames, cnames, lines array, files array): one row per name class, lines ascending."""
    cells = members.groupBy(*CLASS, "code_lines").agg(
        F.count(F.lit(1)).alias("n"), F.first("fnames").alias("fnames"), F.first("cnames").alias("cnames"))
    held = cells.groupBy(*CLASS).agg(F.first("fnames").alias("fnames"), F.first("cnames").alias("cnames"), F.array_sort(
        F.collect_list(F.struct(F.col("code_lines").cast("bigint").alias("l"), "n"))).alias("h"))
    return held.select(*CLASS, "fnames", "cnames", F.col("h")["l"].alias("lines"), F.col("h")["n"].alias("files"))


def class_pairs(classes: DataFrame, threshold: float, class_split: float | None = None, most: int | None = None) -> DataFrame:
    """(repo_id, language, cls1, cls2, func_sim, class_sim): pairs of classes, a class with itself included, whose
    files can reach the threshold by their names. At thresholds of at most the line weight, all that share a name; at 0
    or less, where names change nothing, only a class with itself. With ``most``, only pairs of which one class at
    least has more names than that."""
    wl, wf, wc = WEIGHTS
    names = classes.select("repo_id", "language", F.col("cls").alias("path"), "fnames", "cnames")
    if threshold > wl:
        c_star = class_split if class_split is not None else min(0.5, (threshold - wl) / (2 * wc))
        ranked = _ranked_tokens(names, "fnames")
        met = (_prefix_pairs(names, "cnames", c_star, most)
               .unionByName(_prefix_pairs(ranked, "fnames", (threshold - wl) / wf, most))
               .unionByName(_prefix_pairs(ranked.where("has_classes"), "fnames", (threshold - wl - wc * c_star) / wf, most)))
    elif threshold > 0:
        met = _prefix_pairs(names, "fnames", 0.0, most).unionByName(_prefix_pairs(names, "cnames", 0.0, most))
    else:
        met = None
    within = _within(names if most is None else names.where(F.size("fnames") + F.size("cnames") > most))
    both = within if met is None else within.unionByName(_across(names, met))
    return both.where((_best_similarity() >= F.lit(threshold)) | F.lit(met is None))


def _best_similarity() -> Column:
    wl, wf, wc = WEIGHTS
    return F.lit(1.0) * F.lit(wl) + F.col("func_sim") * F.lit(wf) + F.col("class_sim") * F.lit(wc)


def _within(names: DataFrame) -> DataFrame:
    """Each class with itself."""
    return names.select("repo_id", "language", F.col("path").alias("cls1"), F.col("path").alias("cls2"),
                        F.when(F.size("fnames") > 0, 1.0).otherwise(0.0).alias("func_sim"),
                        F.when(F.size("cnames") > 0, 1.0).otherwise(0.0).alias("class_sim"))


def _across(names: DataFrame, met: DataFrame) -> DataFrame:
    """Candidate pairs of classes with their similarities by name."""
    side = names.select("repo_id", "language", "path", "fnames", "cnames")
    return (met.distinct()
            .join(unbounded(side.withColumnsRenamed({"path": "path1", "fnames": "f1", "cnames": "c1"})), ["repo_id", "language", "path1"])
            .join(unbounded(side.withColumnsRenamed({"path": "path2", "fnames": "f2", "cnames": "c2"})), ["repo_id", "language", "path2"])
            .select("repo_id", "language", F.col("path1").alias("cls1"), F.col("path2").alias("cls2"),
                    jaccard(F.col("f1"), F.col("f2")).alias("func_sim"), jaccard(F.col("c1"), F.col("c2")).alias("class_sim")))


def bounded_pairs(classes: DataFrame, bounds: DataFrame) -> DataFrame:
    """``class_pairs`` that can reach the threshold ``least`` of their repository (repo_id, least), each above the line
    weight. Different classes never reach 1, so a repository of that bound has only classes with themselves."""
    wl, wf, wc = WEIGHTS
    names = classes.select("repo_id", "language", F.col("cls").alias("path"), "fnames", "cnames").join(bounds, "repo_id")
    least = F.col("least")
    apart = names.where(least < 1.0)
    # from 0.75 on functions alone are selective, whatever the class names say
    high = least >= 0.75
    c_star = F.least(F.lit(0.5), (least - wl) / (2 * wc))
    ranked = _ranked_tokens(apart, "fnames", ("least",))
    by_class = _ranked_tokens(apart.where(~high), "cnames", ("least",))
    met = (_prefix_pairs(by_class, "cnames", c_star)
           .unionByName(_prefix_pairs(ranked, "fnames", (least - wl) / wf))
           .unionByName(_prefix_pairs(ranked.where("has_classes"), "fnames",
                                      (least - wl - wc * F.when(high, 1.0).otherwise(c_star)) / wf)))
    return _within(names).unionByName(_across(apart, met)).join(bounds, "repo_id").where(_best_similarity() >= least).drop("least")


# ---------------------------------------------------------------------------
# counting
# ---------------------------------------------------------------------------

def similarity(ratio, func: float, cls: float):
    wl, wf, wc = WEIGHTS
    return ratio * wl + func * wf + cls * wc


def _bound(xs: np.ndarray, lo: np.ndarray, hi: np.ndarray, holds) -> np.ndarray:
    """For each row the first index in [lo, hi) where ``holds(index)``, else hi; holds never turns false again."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        yes = holds(np.minimum(mid, len(xs) - 1)) & open_
        hi = np.where(yes, mid, hi)
        lo = np.where(open_ & ~yes, mid + 1, lo)
    return lo


def partners(lines1: np.ndarray, lines2: np.ndarray, files2: np.ndarray, func: float, cls: float, threshold: float) -> np.ndarray:
    """For each code-line count of the first histogram, the files of the second that reach the threshold."""
    sums = np.concatenate([[0], np.cumsum(files2)])
    split = np.searchsorted(lines2, lines1, "right")  # up to here the other file is no longer
    size = np.full(len(lines1), len(lines2))
    low = _bound(lines2, np.zeros_like(split), split, lambda j: similarity(lines2[j] / lines1, func, cls) >= threshold)
    high = _bound(lines2, split, size, lambda j: similarity(lines1 / lines2[j], func, cls) < threshold)
    return sums[high] - sums[low]


def _count(threshold: float, beyond_lines: bool):
    """Task function: pairs of classes with their histograms -> partners by class and code lines."""
    names = ["repo_id", "language", "cls", "code_lines", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], []]
            lines, links = [], []
            for repo, language, a, b, func, cls, l1, n1, l2, n2 in zip(*(c.to_pylist() for c in batch.columns)):
                l1, n1, l2, n2 = (np.array(x, dtype=np.int64) for x in (l1, n1, l2, n2))
                for key, x, y, m in [(a, l1, l2, n2)] + ([(b, l2, l1, n1)] if a != b else []):
                    n = partners(x, y, m, func, cls, threshold) - (1 if a == b else 0)  # a file is no partner of itself
                    if beyond_lines:
                        n = n - partners(x, y, m, 0.0, 0.0, threshold) + (1 if a == b else 0)
                    keep = n > 0
                    for col, value in zip(cols, (repo, language, key)):
                        col.extend([value] * int(keep.sum()))
                    lines.append(x[keep])
                    links.append(n[keep])
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.string()) for c in cols],
                 *[pa.array(np.concatenate(v) if v else [], pa.int64()) for v in (lines, links)]], names)

    return run


def near_links(members: DataFrame, classes: DataFrame, threshold: float = dims.NEAR_DUP_DEFAULT_THRESHOLD,
               most: int = MOST_NAMES) -> DataFrame:
    """(repo_id, language, cls, code_lines, n_files, n_links): n_links near files of each of the n_files files.

    Classes of up to ``most`` names are counted by shared names, pairs with a larger class one by one."""
    low = threshold <= WEIGHTS[0]
    pairs = class_pairs(classes, threshold, most=most)
    h = classes.select(*CLASS, "lines", "files")
    both = (pairs.join(unbounded(h.withColumnsRenamed({"cls": "cls1", "lines": "l1", "files": "n1"})), ["repo_id", "language", "cls1"])
            .join(unbounded(h.withColumnsRenamed({"cls": "cls2", "lines": "l2", "files": "n2"})), ["repo_id", "language", "cls2"])
            .select("repo_id", "language", "cls1", "cls2", "func_sim", "class_sim", "l1", "n1", "l2", "n2"))
    schema = "repo_id string, language string, cls string, code_lines long, n_links long"
    found = both.mapInArrow(_count(threshold, low), schema)
    if threshold > 0:  # at 0 or less every pair counts by lines alone
        found = found.unionByName(shared_links(classes, threshold, most))
    found = found.groupBy(*CLASS, "code_lines").agg(F.sum("n_links").alias("n_links"))
    cells = members.groupBy(*CLASS, F.col("code_lines").cast("bigint").alias("code_lines")).agg(F.count(F.lit(1)).alias("n_files"))
    out = cells.join(found, [*CLASS, "code_lines"], "left")
    zero = F.lit(0).cast("bigint")
    if not low:
        return out.select(*CLASS, "code_lines", "n_files", F.coalesce("n_links", zero).alias("n_links"))
    # by lines alone: each language with itself, as if it were one class without names
    whole = members.groupBy("repo_id", "language", F.col("code_lines").cast("bigint").alias("l")).agg(F.count(F.lit(1)).alias("n"))
    whole = whole.groupBy("repo_id", "language").agg(F.array_sort(F.collect_list(F.struct("l", "n"))).alias("h"))
    lines, files, none = F.col("h")["l"], F.col("h")["n"], F.lit("")
    alone = whole.select("repo_id", "language", none.alias("a"), none.alias("b"), F.lit(0.0).alias("f"), F.lit(0.0).alias("c"),
                         lines.alias("l1"), files.alias("n1"), lines.alias("l2"), files.alias("n2"))
    alone = alone.mapInArrow(_count(threshold, False), schema).select(
        "repo_id", "language", "code_lines", F.col("n_links").alias("by_lines"))
    return out.join(alone, ["repo_id", "language", "code_lines"], "left").select(
        *CLASS, "code_lines", "n_files", (F.coalesce("n_links", zero) + F.coalesce("by_lines", zero)).alias("n_links"))


def hidden_pairs(groups: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(repo_id, path1, path2): near pairs that are an exact group of two files, which the list leaves out."""
    wl, wf, wc = WEIGHTS
    alike = (F.lit(1.0) * F.lit(wl) + F.when(F.size("fnames") > 0, 1.0).otherwise(0.0) * F.lit(wf)
             + F.when(F.size("cnames") > 0, 1.0).otherwise(0.0) * F.lit(wc))
    own = members.where(alike >= F.lit(threshold)).select("repo_id", "language", "path")
    return (_pairs_of_two(groups).join(own.withColumnRenamed("path", "path1"), ["repo_id", "path1"])
            .join(own.withColumnRenamed("path", "path2"), ["repo_id", "path2", "language"])
            .select("repo_id", "path1", "path2"))


def duplicate_counts(repos: DataFrame, groups: DataFrame, links: DataFrame, hidden: DataFrame) -> DataFrame:
    """(repo_id, duplicate_groups, exact_groups, near_pairs) of every repository, from links by class and lines."""
    exact = groups.groupBy("repo_id").agg(F.count(F.lit(1)).alias("exact_groups"))
    near = links.groupBy("repo_id").agg(F.expr("sum(n_files * n_links) div 2").alias("n_pairs"))
    less = hidden.groupBy("repo_id").agg(F.count(F.lit(1)).alias("hidden"))
    zero = F.lit(0).cast("bigint")
    return (repos.select("repo_id").join(exact, "repo_id", "left").join(near, "repo_id", "left").join(less, "repo_id", "left")
            .select("repo_id", F.coalesce("exact_groups", zero).alias("exact_groups"),
                    (F.coalesce("n_pairs", zero) - F.coalesce("hidden", zero)).alias("near_pairs"))
            .select("repo_id", (F.col("exact_groups") + F.col("near_pairs")).alias("duplicate_groups"), "exact_groups", "near_pairs"))


def file_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """(repo_id, language, path, code_lines, n_links): every eligible file and its number of near files."""
    return members.select(*CLASS, F.col("code_lines").cast("bigint").alias("code_lines"), "path").join(
        links.select(*CLASS, "code_lines", "n_links"), [*CLASS, "code_lines"]).select(
        "repo_id", "language", "path", "code_lines", "n_links")


def duplicate_members(exact: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """(repo_id, kind, group_key, path): every member of an exact group (key: md5) and of a signature that is
    near another or holds several files (key: its first file)."""
    linked = links.where("n_links > 0").select(*CLASS, "code_lines")
    cells = members.select(*CLASS, F.col("code_lines").cast("bigint").alias("code_lines"), "path")
    first = cells.groupBy(*CLASS, "code_lines").agg(F.min("path").alias("first"))
    near = cells.join(first.join(linked, [*CLASS, "code_lines"]), [*CLASS, "code_lines"])
    return exact.select("repo_id", F.lit("exact").alias("kind"), F.col("md5").alias("group_key"), "path").unionByName(
        near.select("repo_id", F.lit("near").alias("kind"), F.col("first").alias("group_key"), "path"))


# ---------------------------------------------------------------------------
# the first k
# ---------------------------------------------------------------------------

def heads(members: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(repo_id, language, cls, heads array<struct<l, files array<struct<path, twin>>>>): the first k files of every
    code-line count, lines ascending; twin is the key of a file's exact group if that has two files."""
    twins = groups.where(F.col("n_files") == 2).select("repo_id", "md5", F.explode(F.array("first_path", "last_path")).alias("path"))
    w = Window.partitionBy(*CLASS, "code_lines").orderBy("path")
    first = members.select(*CLASS, "code_lines", "path").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    named = first.join(twins, ["repo_id", "path"], "left")
    cells = named.groupBy(*CLASS, F.col("code_lines").cast("bigint").alias("l")).agg(
        F.array_sort(F.collect_list(F.struct("path", F.col("md5").alias("twin")))).alias("files"))
    return cells.groupBy(*CLASS).agg(F.array_sort(F.collect_list(F.struct("l", "files"))).alias("heads"))


def best_pairs(one: list, two: list, same: bool, func: float, cls: float, threshold: float, k: int) -> list[tuple]:
    """The first k pairs of two classes by (similarity descending, smaller path, larger path), from their heads."""
    at = [h["l"] for h in two]
    agenda = []

    def push(i: int, j: int, step: int) -> None:
        if 0 <= j < len(two):
            a, b = one[i]["l"], two[j]["l"]
            s = similarity(min(a, b) / max(a, b), func, cls)
            if s >= threshold:
                heapq.heappush(agenda, (-s, i, j, step))

    for i, head in enumerate(one):
        j = i if same else bisect_left(at, head["l"])
        push(i, j, 1)
        if not same:
            push(i, j - 1, -1)
    found: list[tuple] = []
    while agenda and not (len(found) >= k and found[k - 1][0] < agenda[0][0]):
        s, i, j, step = heapq.heappop(agenda)
        push(i, j + step, step)
        more = []
        for x, a in enumerate(one[i]["files"]):
            for b in (two[j]["files"][x + 1:] if same and i == j else two[j]["files"]):
                if a["twin"] is None or a["twin"] != b["twin"]:
                    more.append((s, min(a["path"], b["path"]), max(a["path"], b["path"])))
        found = sorted(found + heapq.nsmallest(k, more))[:k]
    return found


def _best(k: int, threshold: float):
    names = ["repo_id", "language", "cls1", "cls2", "func_sim", "class_sim", "similarity", "path1", "path2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for repo, language, a, b, func, cls, one, two in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(repo, language, a, b, func, cls, -s, p, q)
                        for s, p, q in best_pairs(one, two, a == b, func, cls, threshold, k)]
            kinds = [pa.string()] * 4 + [pa.float64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return run


def first_near_pairs(members: DataFrame, groups: DataFrame, classes: DataFrame, k: int = 10,
                     threshold: float = dims.NEAR_DUP_DEFAULT_THRESHOLD,
                     keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """(repo_id, language, path1, path2, similarity): the first k near pairs of each repository in list order, exact
    groups of two left out. For thresholds above the line weight. ``keep`` stores a table that is read several times."""
    if threshold <= WEIGHTS[0]:
        raise ValueError("pairs without a common name have no class to start from; use the listed pairs")
    lang = members.groupBy("repo_id", "language").agg(F.min("path").alias("lang_order"))
    w = Window.partitionBy("repo_id").orderBy(-F.col("similarity"), "lang_order", "path1", "path2")
    schema = ("repo_id string, language string, cls1 string, cls2 string, func_sim double, class_sim double, "
              "similarity double, path1 string, path2 string")

    def first(of: DataFrame, files: DataFrame, n: int) -> DataFrame:
        both = (of.join(files.withColumnsRenamed({"cls": "cls1", "heads": "h1"}), ["repo_id", "language", "cls1"])
                .join(files.withColumnsRenamed({"cls": "cls2", "heads": "h2"}), ["repo_id", "language", "cls2"])
                .select("repo_id", "language", "cls1", "cls2", "func_sim", "class_sim", "h1", "h2"))
        ranked = both.mapInArrow(_best(n, threshold), schema).join(lang, ["repo_id", "language"])
        return ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r", "lang_order")

    # a file loses at most one partner to an exact group of two, so two or k + 1 more files are enough
    three = keep(heads(members, groups, 3), "heads")
    # k pairs within classes bound what the first k can be: only pairs of classes that reach it are met
    own = _within(classes.withColumnRenamed("cls", "path")).where(_best_similarity() >= F.lit(threshold))
    known = first(own, three, k).groupBy("repo_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("similarity")).otherwise(F.lit(threshold)).alias("least"))
    bounds = keep(classes.select("repo_id").distinct().join(known, "repo_id", "left").select(
        "repo_id", F.coalesce("least", F.lit(threshold)).alias("least")), "bounds")
    leading = first(bounded_pairs(classes, bounds), three, 1).select("repo_id", "language", "cls1", "cls2", "func_sim", "class_sim")
    return first(leading, heads(members, groups, k + 2), k).select("repo_id", "language", "path1", "path2", "similarity")
