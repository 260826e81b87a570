"""JSON documents in parts, packs with an offset index, rounded scores in order."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, corpus_df
from healthspark.plans import reports as R
from healthspark.plans.analysis import analyze
from healthspark.sinks import packs as P
from healthspark.sources import driver_corpora as K
from test_duplicates import py_file


def plain_documents(a):
    """The documents as nested values, from the analysis tables."""
    out = {}
    for m in a.repo_metrics.collect():
        out[m.repo_id] = {
            "meta": {"tool": "healthspark", "codebase_path": m.repo_id},
            "summary": {"health_score": m.health_score, "risk_level": m.risk_level, "total_files": m.total_files,
                        "source_files": m.source_files, "test_files": m.test_files, "total_loc": m.source_loc + m.test_loc,
                        "source_loc": m.source_loc, "test_loc": m.test_loc,
                        "test_to_code_ratio": round(m.test_to_code_ratio, 2) if m.source_loc > 0 else 0,
                        "estimated_defects": round(m.estimated_defects, 1)},
            "languages": {}, "smell_scores": {}, "files": [],
            "issues": {"complex_files": [], "long_functions": [], "sensitive_functions": [], "todos": []}}
    for r in a.language_stats.collect():
        out[r.repo_id]["languages"][r.language] = {"files": r.files, "lines": r.lines, "test_files": r.test_files}
    for r in a.smells.collect():
        out[r.repo_id]["smell_scores"][r.smell] = r.score
    for f in sorted(a.analysis.collect(), key=lambda f: f.path):
        doc = out[f.repo_id]
        doc["files"].append({
            "path": f.path, "language": f.language, "lines": f.total_lines, "code_lines": f.code_lines,
            "comment_lines": f.comment_lines, "complexity": round(f.complexity, 1), "functions": f.function_count,
            "classes": f.class_count, "issues": {"todos": f.todo_count, "sensitive_functions": sum(x.is_sensitive for x in f.functions),
                                                 "long_functions": sum(x.is_long for x in f.functions)}})
        if f.complexity > 10:
            doc["issues"]["complex_files"].append({"file": f.path, "score": round(f.complexity, 1)})
    for r in sorted(a.functions.collect(), key=lambda f: (f.path, f.start_line)):
        if r.is_long:
            out[r.repo_id]["issues"]["long_functions"].append({"file": r.path, "name": r.name, "lines": r.line_count})
        if r.is_sensitive:
            out[r.repo_id]["issues"]["sensitive_functions"].append({"file": r.path, "name": r.name, "line": r.start_line})
    for r in sorted(a.todos.collect(), key=lambda t: (t.path, t.line_no)):
        out[r.repo_id]["issues"]["todos"].append({"file": r.path, "line": r.line_no, "content": r.content})
    for doc in out.values():
        doc["issues"]["complex_files"].sort(key=lambda f: -f["score"])
    return out


def test_parsed_documents_equal_the_tables(spark, tmp_path):
    corpus = K.k1_corpus(spark, SF_SMALL).select("repo_id", "path", F.col("content").cast("string").alias("content"))
    a = analyze(corpus.unionAll(corpus_df(spark, {
        ("empty", "x.txt"): "no source", ("odd", "a \"b\".py"): "# TODO \\ \"quoted\" é \ttab\nx = 1\n", ("odd", "é.py"): ""})))
    path = str(tmp_path / "docs")
    P.write_documents(a.document_parts, path)
    want = plain_documents(a)
    back = {}
    for r in sorted(P.read_documents(spark, path).collect(), key=lambda r: (r.repo_id, r.part)):
        back[r.repo_id] = back.get(r.repo_id, "") + r.text
    assert {k: json.loads(v) for k, v in back.items()} == want
    assert json.loads(P.read_document(spark, path, "odd")) == want["odd"]
    assert want["empty"]["files"] == [] and len(want) > 3
    # no part holds more than one item
    assert max(len(r.text) for r in a.document_parts.where("section > 0").collect()) < 1000


def test_rounding_equals_exact_rounding(spark):
    rnd = random.Random(7)
    xs = [i / c * 100 for c in (7, 8, 16, 40, 160, 320, 400, 1000, 2000) for i in range(0, 90)]
    xs += [rnd.random() * 10 ** rnd.randint(-3, 6) for _ in range(3000)] + [0.05, 0.15, 0.25, 0.35, 2.25, 2.675, 1.005, 0.125, 0.0, 12.25, 12.75]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", R.rounded(F.col("x"), 1).alias("a"), R.rounded(F.col("x"), 2).alias("b")).collect():
        assert (r.a, r.b) == (round(r.x, 1), round(r.x, 2)), r.x


def test_complex_files_are_in_order(spark):
    files = {f"m{i:02d}.py": py_file([f"f{k}" for k in range(i)], [], 60) for i in range(5, 20)}
    files["a.py"] = py_file([f"f{k}" for k in range(12)], [], 60)
    rows = analyze(corpus_df(spark, files)).analysis
    got = sorted((r["rank"], r.path, r.score) for r in R.complex_files(rows).collect())
    plain = sorted(((r.path, round(r.complexity, 1)) for r in rows.collect() if r.complexity > 10), key=lambda x: (-x[1], x[0]))
    assert got == [(i, *x) for i, x in enumerate(plain, 1)] and len(got) > 10


def test_packs_of_many_repositories(spark, tmp_path):
    path = str(tmp_path / "texts")
    texts = spark.range(20_000).select(F.format_string("r%05d", "id").alias("repo_id"),
                                       F.concat(F.lit("# one\n\nline "), F.col("id").cast("string"), F.lit("\n")).alias("markdown"))
    P.write_texts(texts, "markdown", path)
    names = json.load(open(f"{path}/{P.MANIFEST}"))
    assert 0 < len(names) <= 4 and len(os.listdir(path)) == 2 * len(names) + 1  # no folder, no file per repository
    assert P.read_document(spark, path, "r00017", "\n") == "# one\n\nline 17\n"
    assert P.read_index(spark, path).count() >= 20_000
    assert P.read_documents(spark, path).groupBy("repo_id").count().where("count = 4").count() == 20_000


def test_nothing_and_failed_packs(spark, tmp_path):
    none = spark.createDataFrame([], "repo_id string, part long, text string")
    P.write_documents(none, str(tmp_path / "none"))
    assert P.read_documents(spark, str(tmp_path / "none")).count() == 0
    path = str(tmp_path / "failed")
    bad = spark.range(100).select(F.lit("r").alias("repo_id"), F.col("id").alias("part"),
                                  F.when(F.col("id") < 90, "x").otherwise(F.raise_error(F.lit("stop"))).alias("text"))
    with pytest.raises(Exception):
        P.write_documents(bad, path)
    assert not os.path.exists(f"{path}/{P.MANIFEST}")
