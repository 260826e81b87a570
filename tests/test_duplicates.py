"""Exact groups, similarity values and lossless near-duplicate blocking."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, corpus_df
from healthspark.operators import duplicates as D
from healthspark.plans.analysis import analyze
from healthspark.sources import driver_corpora as K


def py_file(funcs, classes, code_lines):
    lines = [f"def {f}(x):" for f in funcs] + [f"class {c}:" for c in classes]
    lines += [f"v{i} = {i}" for i in range(code_lines - len(lines))]
    return "\n".join(lines) + "\n"


def near_duplicates_brute_force(analysis, threshold=0.5):
    """All pairs of a language, as the rule is stated."""
    wl, wf, wc = (0.3, 0.5, 0.2)
    sigs = D.signatures(analysis)
    a, b = sigs.alias("a"), sigs.alias("b")
    j = a.join(b, (F.col("a.repo_id") == F.col("b.repo_id")) & (F.col("a.language") == F.col("b.language"))
               & (F.col("a.path") < F.col("b.path")))
    lo = F.least("a.code_lines", "b.code_lines").cast("double")
    hi = F.greatest("a.code_lines", "b.code_lines").cast("double")
    out = j.select(F.col("a.repo_id").alias("repo_id"), F.col("a.language").alias("language"),
                   F.col("a.path").alias("path1"), F.col("b.path").alias("path2"),
                   (lo / hi).alias("line_sim"), D.jaccard(F.col("a.fnames"), F.col("b.fnames")).alias("func_sim"),
                   D.jaccard(F.col("a.cnames"), F.col("b.cnames")).alias("class_sim"))
    sim = F.col("line_sim") * F.lit(wl) + F.col("func_sim") * F.lit(wf) + F.col("class_sim") * F.lit(wc)
    return out.withColumn("similarity", sim).where(F.col("similarity") >= F.lit(threshold))


def near(spark, files, threshold=0.5):
    a = analyze(corpus_df(spark, files), materialize="write")
    return {(r.path1, r.path2): r.similarity for r in D.near_duplicates(a.analysis, threshold).collect()}


def test_similarity_values(spark):
    files = {
        "a.py": py_file(["f", "g"], ["K"], 20), "b.py": py_file(["f", "g"], ["K"], 20),     # 1.0
        "c.py": py_file(["p", "q", "r"], [], 30), "d.py": py_file(["p", "q", "s"], [], 30),  # 0.3 + 0.5*2/4
        "e.py": py_file(["h"], ["Z"], 40), "f.py": py_file(["i"], ["Z"], 40),                 # 0.5 tie kept
        "g.py": py_file(["f"], [], 9),                                                         # too small
    }
    got = near(spark, files)
    assert got[("a.py", "b.py")] == pytest.approx(1.0)
    assert got[("c.py", "d.py")] == pytest.approx(0.3 + 0.5 * (2 / 4))
    assert ("e.py", "f.py") in got and got[("e.py", "f.py")] == 0.5
    assert not any("g.py" in k for k in got)
    assert all(v >= 0.5 for v in got.values())


def test_exact_groups_and_all_duplicates(spark):
    same = py_file(["f", "g"], [], 12)
    files = {"a.py": same, "b.py": same, "c.py": same, "e1.py": "", "e2.js": "", "x.py": py_file(["z"], [], 3)}
    a = analyze(corpus_df(spark, files), materialize="write")
    groups = sorted((r.n_files, r.first_path) for r in a.exact_groups.collect())
    assert groups == [(2, "e1.py"), (3, "a.py")]            # empty files of two languages form a group
    dups = a.duplicates.collect()
    near_pairs = sorted((r.file_1, r.file_2) for r in dups if not r.is_exact)
    assert near_pairs == [("a.py", "b.py"), ("a.py", "c.py"), ("b.py", "c.py")]   # 3 copies keep their pairs


def test_two_copy_group_suppresses_its_pair(spark):
    same = py_file(["f", "g"], [], 12)
    a = analyze(corpus_df(spark, {"a.py": same, "b.py": same}), materialize="write")
    dups = a.duplicates.collect()
    assert [(r.is_exact, r.n_files) for r in dups] == [(True, 2)]


@pytest.mark.parametrize("threshold", [0.31, 0.5, 0.7, 0.9, 0.25])
def test_blocking_equals_brute_force_random(spark, threshold):
    rnd = random.Random(int(threshold * 100))
    vocab = [f"n{i}" for i in range(12)]
    cvocab = ["A", "B", "C"]
    files = {}
    for i in range(60):
        fs = rnd.sample(vocab, rnd.randint(0, 5))
        cs = rnd.sample(cvocab, rnd.randint(0, 2))
        files[f"m{i:03d}.py"] = py_file(fs, cs, rnd.choice([10, 12, 15, 20, 30]))
    a = analyze(corpus_df(spark, files), materialize="write")
    fast = {(r.path1, r.path2): r.similarity for r in D.near_duplicates(a.analysis, threshold).collect()}
    slow = {(r.path1, r.path2): r.similarity for r in near_duplicates_brute_force(a.analysis, threshold).collect()}
    assert fast == slow


def test_blocking_equals_brute_force_k1(spark):
    a = analyze(K.k1_corpus(spark, SF_SMALL), materialize="write")
    fast = sorted(tuple(r) for r in D.near_duplicates(a.analysis).collect())
    slow = sorted(tuple(r) for r in near_duplicates_brute_force(a.analysis).collect())
    assert fast == slow


def test_common_name_does_not_pair_everything(spark):
    # 40 files share 'main' plus one unique name each: Jaccard 1/3 < 0.4, so none can qualify
    files = {f"m{i:02d}.py": py_file(["main", f"only_{i}"], [], 12) for i in range(40)}
    a = analyze(corpus_df(spark, files), materialize="write")
    sigs = D.signatures(a.analysis)
    assert D._prefix_pairs(sigs, "fnames", 0.4).count() == 0
    assert D.near_duplicates(a.analysis).count() == 0
    # files with only 'main' truly are near duplicates of each other: all pairs are the result
    files = {f"s{i:02d}.py": py_file(["main"], [], 12) for i in range(8)}
    a = analyze(corpus_df(spark, files), materialize="write")
    assert D.near_duplicates(a.analysis).count() == 8 * 7 // 2


def test_signatures_of_many_identical_files(spark):
    # 20 000 equal files and one near them: counted by arithmetic, never expanded to 2e8 pairs
    same, other = py_file(["f", "g"], ["K"], 30), py_file(["f", "h"], ["K"], 30)
    rows = spark.range(20_000).select(F.lit("r").alias("repo_id"), F.format_string("d/m%05d.py", "id").alias("path"),
                                      F.lit(same).alias("content"))
    a = analyze(rows.unionAll(corpus_df(spark, {"z.py": other})))
    assert [tuple(r) for r in a.duplicate_counts.collect()] == [("r", 1 + 20_000 * 19_999 // 2 + 20_000, 1, 20_000 * 19_999 // 2 + 20_000)]
    first = a.first_duplicates.collect()
    assert len(first) == 11
    assert sorted((r.file_1, r.file_2) for r in first if not r.is_exact) == [("d/m00000.py", f"d/m{i:05d}.py") for i in range(1, 11)]
    assert a.fix_files.where("group_rank = 1").count() == 20_000
    assert a.duplicate_members.where("kind = 'exact'").count() == 20_000


def test_counts_equal_the_expanded_list(spark):
    a = analyze(K.k1_corpus(spark, SF_SMALL))
    listed = {r.repo_id: (r.n, r.e) for r in a.duplicates.groupBy("repo_id").agg(
        F.count("*").alias("n"), F.count_if("is_exact").alias("e")).collect()}
    for r in a.duplicate_counts.collect():
        assert (r.duplicate_groups, r.exact_groups) == listed.get(r.repo_id, (0, 0))
