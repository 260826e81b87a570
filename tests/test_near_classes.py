"""Near duplicates by name classes: counts, links and first pairs against the listed pairs; ranks without a window."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, corpus_df
from healthspark.operators import duplicates as D
from healthspark.operators import near_classes as N
from healthspark.operators.ranks import ranked
from healthspark.operators.shared_names import shared_links
from healthspark.plans.analysis import analyze
from healthspark.sources import driver_corpora as K
from test_duplicates import near_duplicates_brute_force, py_file


def random_files(seed, n=70):
    rnd = random.Random(seed)
    files = {}
    for i in range(n):
        fs, cs = rnd.sample([f"n{k}" for k in range(8)], rnd.randint(0, 4)), rnd.sample(["A", "B", "C"], rnd.randint(0, 2))
        text = py_file(fs, cs, rnd.choice([9, 10, 12, 15, 20, 30, 31, 33, 40, 100]))
        files[f"r{i % 2}", f"m{i:03d}.{rnd.choice(['py', 'py', 'js'])}"] = text
        if rnd.random() < 0.2:
            files[f"r{i % 2}", f"copy{rnd.randint(0, 9)}_{i}.py"] = text
    return files


@pytest.mark.parametrize("threshold", [-1.0, 0.25, 0.5])
def test_counts_and_links_equal_all_pairs(spark, threshold):
    a = analyze(corpus_df(spark, random_files(int(threshold * 100))), near_threshold=threshold)
    listed = near_duplicates_brute_force(a.analysis, threshold).collect()
    degree = {}
    for r in listed:
        for p in (r.path1, r.path2):
            degree[r.repo_id, p] = degree.get((r.repo_id, p), 0) + 1
    links = {(r.repo_id, r.path): r.n_links for r in a.file_links.collect()}
    assert {k: v for k, v in links.items() if v} == degree
    assert len(links) == D.signatures(a.analysis).count()
    exact = {(r.repo_id, r.first_path, r.last_path): r.n_files for r in a.exact_groups.collect()}
    for r in a.duplicate_counts.collect():
        near = sum(x.repo_id == r.repo_id and exact.get((r.repo_id, x.path1, x.path2)) != 2 for x in listed)
        assert (r.near_pairs, r.exact_groups) == (near, sum(k[0] == r.repo_id for k in exact))
    fast = {(r.repo_id, r.path1, r.path2): r.similarity for r in D.near_duplicates(a.analysis, threshold).collect()}
    assert fast == {(r.repo_id, r.path1, r.path2): r.similarity for r in listed}


@pytest.mark.parametrize("threshold, seed", [(0.25, 1), (0.5, 2)])
def test_first_pairs_head_the_list(spark, threshold, seed):
    a = analyze(corpus_df(spark, random_files(seed)), near_threshold=threshold)
    whole = sorted((r.repo_id, *[r[c] for c in D.ORDER_KEYS]) for r in a.duplicates.collect())
    first = [(r.repo_id, *[r[c] for c in D.ORDER_KEYS]) for r in a.first_duplicates.collect()]
    want = []
    for repo in ("r0", "r1"):
        for kind in (0, 1):
            want += [r for r in whole if r[0] == repo and r[1] == kind][:10]
    assert sorted(first) == want


def test_best_pairs_equal_sorting():
    rnd = random.Random(5)
    for _ in range(300):
        def side(name):
            return [{"l": line, "files": [{"path": f"{name}{line:03d}_{i}", "twin": rnd.choice([None, None, "t"])}
                                          for i in range(rnd.randint(1, 4))]}
                    for line in sorted(rnd.sample(range(10, 60), rnd.randint(1, 8)))]
        one, same = side("a"), rnd.random() < 0.5
        two = one if same else side("b")
        func, cls, threshold, k = rnd.choice([0.0, 0.5, 1.0]), rnd.choice([0.0, 1.0]), rnd.choice([0.3, 0.5, 0.7]), rnd.choice([1, 3, 10])
        flat = lambda s: [(h["l"], f["path"], f["twin"]) for h in s for f in h["files"]]
        pairs = []
        for la, pa, ta in flat(one):
            for lb, pb, tb in flat(two):
                # twins only matter within one code-line count: equal texts have equal lines
                if (not same or pa < pb) and not (ta is not None and ta == tb):
                    s = N.similarity(min(la, lb) / max(la, lb), func, cls)
                    if s >= threshold:
                        pairs.append((-s, min(pa, pb), max(pa, pb)))
        assert N.best_pairs(one, two, same, func, cls, threshold, k) == sorted(pairs)[:k]


def test_partners_equal_counting():
    rnd = np.random.default_rng(3)
    for _ in range(300):
        x, y = (np.unique(rnd.integers(10, 200, rnd.integers(1, 30))) for _ in range(2))
        n = rnd.integers(1, 5, len(y))
        func, cls, t = rnd.choice([0, 1 / 3, 0.5, 1]), rnd.choice([0, 0.5, 1]), rnd.choice([-1, 0, 0.2, 0.5, 0.8, 1, 2])
        want = [sum(int(m) for b, m in zip(y, n) if N.similarity(min(a, b) / max(a, b), func, cls) >= t) for a in x]
        assert N.partners(x, y, n, func, cls, t).tolist() == want


def test_many_files_of_one_class_are_linear(spark):
    # 100 000 files with one function: one class, no list of pairs
    text = F.concat(F.lit("def main(x):\n"), F.expr("repeat('v = 1\\n', cast(9 + id % 1500 as int))"))
    rows = spark.range(100_000).select(F.lit("r").alias("repo_id"), F.format_string("d/m%06d.py", "id").alias("path"), text.alias("content"))
    a = analyze(rows)
    a.analysis.count()
    started = time.time()
    (r,) = a.duplicate_counts.collect()
    assert time.time() - started < 60
    lines = np.arange(10, 1510)
    n = np.bincount(np.arange(100_000) % 1500)
    # 0.8 from the name, or less the ratio's share: every pair reaches 0.5
    assert r.near_pairs == 100_000 * 99_999 // 2 and r.exact_groups == 1500 and len(lines) == len(n)
    assert a.name_classes.count() == 1 and a.class_pairs.count() == 1
    assert len(a.first_duplicates.collect()) == 20


@pytest.mark.parametrize("threshold", [0.25, 0.5])
def test_counting_by_shared_names_equals_pairs(spark, threshold):
    rnd = random.Random(int(threshold * 100))
    rows = [(f"r{i % 2}", "py", f"f{i:03d}", rnd.choice([10, 11, 15, 20, 33, 90]), rnd.sample([f"n{k}" for k in range(9)], rnd.randint(0, 5)),
             rnd.sample(["A", "B", "n1"], rnd.randint(0, 3))) for i in range(300)]
    members = N.class_members(spark.createDataFrame(
        rows, "repo_id string, language string, path string, code_lines int, fnames array<string>, cnames array<string>"))
    classes = N.histograms(members).persist()
    # pairs with a class of more than three names one by one, the others by their names
    assert {r.path: r.n_links for r in N.file_links(members, N.near_links(members, classes, threshold, 3)).collect()} == {
        r[2]: sum(r[:2] == x[:2] and r[2] != x[2] and N.similarity(min(r[3], x[3]) / max(r[3], x[3]), *(
            len(set(r[n]) & set(x[n])) / len(set(r[n]) | set(x[n])) if r[n] and x[n] else 0.0 for n in (4, 5))) >= threshold
                  for x in rows) for r in rows}


def test_keys_and_classes_are_not_broadcast(spark):
    # a class has up to 4095 keys, but Spark sizes them by the compressed file of the classes
    classes = analyze(corpus_df(spark, random_files(5))).name_classes
    p = shared_links(classes, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in p and "BroadcastHashJoin" not in p


def many_classes(spark, copies):
    """60 000 classes of one function (of 30) and one class name (of 2 000) each."""
    return N.class_members(spark.range(60_000 * copies).select(
        F.lit("r").alias("repo_id"), F.lit("py").alias("language"), F.format_string("m%06d.py", "id").alias("path"),
        F.lit(20).alias("code_lines"), F.array(F.expr("'f' || id % 60000 % 30")).alias("fnames"),
        F.array(F.expr("'C' || id % 60000 div 30")).alias("cnames")))


@pytest.mark.parametrize("threshold, links", [(0.5, 1999 + 29), (0.25, 59_999)])
def test_many_classes_that_share_names_are_linear(spark, threshold, links):
    # 60 million pairs of classes share a name
    members = many_classes(spark, 1)
    started = time.time()
    found = N.near_links(members, N.histograms(members).persist(), threshold).groupBy("n_links").count().collect()
    assert time.time() - started < 60
    assert [tuple(r) for r in found] == [(links, 60_000)]


def test_first_pairs_of_many_classes_are_linear(spark):
    members = many_classes(spark, 2)
    groups = spark.createDataFrame([], "repo_id string, md5 string, n_files long, first_path string, last_path string")
    started = time.time()
    first = N.first_near_pairs(members, groups, N.histograms(members).persist()).collect()
    assert time.time() - started < 120
    assert sorted((r.path1, r.path2, r.similarity) for r in first) == [
        (f"m{i:06d}.py", f"m{i + 60_000:06d}.py", 1.0) for i in range(10)]


def test_ranks_need_no_window(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.random(), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, x double, i long").repartition(7)
    spread = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else tiny rows share one task
    try:
        out = ranked(df, "g", [F.col("x").desc(), "i"])
        got = {(r.g, r.i): r["rank"] for r in out.collect()}
        tasks = out.groupBy("g").count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", spread)
    want = {}
    for g in {r[0] for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[g, r[2]] = k
    assert got == want and tasks == 4
    assert ranked(df.where("false"), "g", ["x"]).count() == 0


def test_ranks_of_the_whole_list(spark):
    a = analyze(K.k1_corpus(spark, SF_SMALL))
    rows = a.duplicate_ranks.collect()
    by_repo = {}
    for r in rows:
        by_repo.setdefault(r.repo_id, []).append(r)
    for held in by_repo.values():
        held.sort(key=lambda r: [r[c] for c in D.ORDER_KEYS])
        assert [r.group_rank for r in held] == list(range(1, len(held) + 1))
    assert rows
