"""The list of near pairs: met once, never shuffled, equal to all pairs."""

import random
import re

import pytest

from conftest import corpus_df
from healthspark.operators import duplicates as D
from healthspark.operators.near_lists import near_list
from healthspark.plans.analysis import analyze
from test_duplicates import near_duplicates_brute_force, py_file


def outermost_join(df):
    return next(line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line)


def alike(spark):
    """150 files of the same names and different lengths: 11 175 pairs."""
    return analyze(corpus_df(spark, {f"m{i:03d}.py": py_file(["f", "g"], ["K"], 20 + i) for i in range(150)}), materialize="write")


@pytest.mark.parametrize("table", ["near_duplicates", "signature_pairs", "duplicates"])
def test_pairs_are_not_shuffled(spark, table):
    a = alike(spark)
    df = D.near_signature_pairs(D.distinct_signatures(D.signature_members(a.analysis))) if table == "signature_pairs" else getattr(a, table)
    assert len(df.collect()) == 150 * 149 // 2
    assert "tok#" in outermost_join(df)  # the join by names: nothing that makes or takes pairs lies above or below another


def small_corpus(spark, seed):
    rnd = random.Random(seed)
    files = {f"m{i:03d}.py": py_file(rnd.sample([f"n{j}" for j in range(7)], rnd.randint(0, 4)),
                                     rnd.sample(["A", "B", "C"], rnd.randint(0, 2)), rnd.choice([10, 11, 12, 20, 30])) for i in range(70)}
    return analyze(corpus_df(spark, files), materialize="write")


@pytest.mark.parametrize("threshold", [0.31, 0.5, 0.8])
def test_small_chunks_and_hot_names_change_nothing(spark, threshold):
    a = small_corpus(spark, 5)
    want = {(r.path1, r.path2): (r.line_sim, r.func_sim, r.class_sim, r.similarity)
            for r in near_duplicates_brute_force(a.analysis, threshold).collect()}
    for chunk, hot in ((1, 1), (3, 2), (256, 4096)):
        got = near_list(D.signatures(a.analysis), threshold, chunk=chunk, hot=hot).collect()
        assert len(got) == len(want)  # each pair once
        assert {(r.one.path, r.two.path): (r.line_sim, r.func_sim, r.class_sim, r.similarity) for r in got} == want


@pytest.mark.parametrize("table", ["near_duplicates", "duplicates"])
def test_methods_of_the_pair_stage_are_compiled(spark, table):
    """HotSpot interprets methods of more than 8 000 bytes."""
    df = getattr(small_corpus(spark, 7), table)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        stages = debug.codegenStringSeq(plan)
        sizes = [int(re.search(r"\((\d+),", stages.apply(i)._3().toString())[1]) for i in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < 8000


def test_near_signature_pairs_equal_all_pairs(spark):
    a = small_corpus(spark, 8)
    members = D.signature_members(a.analysis)
    pairs = D.near_signature_pairs(D.distinct_signatures(members), 0.5)
    rows = pairs.collect()
    assert sum(r.n_pairs for r in rows) == near_duplicates_brute_force(a.analysis).count()
    assert any(r.path1 == r.path2 and r.n_pairs == r.n_files1 * (r.n_files1 - 1) // 2 for r in rows)
    files = {(r.path1, r.path2) for r in D._expand(pairs, members).collect()}
    assert files == {(r.path1, r.path2) for r in near_duplicates_brute_force(a.analysis).collect()}


def test_all_duplicates_leave_out_pairs_of_two_copies(spark):
    same, other = py_file(["f", "g"], [], 12), py_file(["f", "h"], ["K"], 12)
    a = analyze(corpus_df(spark, {"a.py": same, "b.py": same, "c.py": py_file(["f", "g"], [], 13),
                                  "d.js": other, "e.py": other, "f.py": other, "g.py": other}), materialize="write")
    near = sorted((r.file_1, r.file_2, r.lang_order) for r in a.duplicates.collect() if not r.is_exact)
    want = {(r.path1, r.path2) for r in near_duplicates_brute_force(a.analysis).collect()} - {("a.py", "b.py")}
    assert near == [(p, q, "a.py") for p, q in sorted(want)]
    assert sorted((r.file_1, r.n_files) for r in a.duplicates.collect() if r.is_exact) == [("a.py", 2), ("d.js", 4)]


def test_ranks_do_not_shuffle_the_sorted_list_again(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a list that is larger than any threshold
    try:
        df = small_corpus(spark, 9).duplicate_ranks
        assert "BroadcastHashJoin" in outermost_join(df)
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rows.sort(key=lambda r: [r[c] for c in D.ORDER_KEYS])
    assert [r.group_rank for r in rows] == list(range(1, len(rows) + 1)) and len(rows) > 100
    assert all(r.n_files == 2 and r.group_key == f'["{r.file_1}","{r.file_2}"]' for r in rows if not r.is_exact)
