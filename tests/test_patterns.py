"""Per-language patterns against Python's re, and lines long enough to end a recursive matcher."""

import random
import re

import pytest
from conftest import corpus_df
from healthspark.functions import dims
from healthspark.functions.text import any_match, first_group, u
from healthspark.plans.analysis import analyze
from pyspark.sql import functions as F

TOKENS = ["def", "async", "function", "func", "fun", "suspend", "fn", "pub", "public", "private", "static", "class", "struct",
          "type", "const", "let", "x", "foo_1", "Bär", "ñ", "int", "void", "throws", "Error", "self.", "export", "abstract",
          "import", "use", "using", "require", "from", "try", "catch", "rescue", "begin", "do", "=", "(", ")", "()", "(a, b)",
          "{", "}", ":", "<", ";", "?", "\xa0", "\x1f", " ", "  ", "\t", "new", "data", "partial", "=>"]


def random_lines(n):
    rnd = random.Random(12)
    out = []
    for _ in range(n):
        words = [rnd.choice(TOKENS) for _ in range(rnd.randint(1, 7))]
        out.append(rnd.choice(["", " ", "\t", "\xa0"]) + rnd.choice([" ", "", " "]).join(words) + rnd.choice(["", " {", "() {", "(a) {"]))
    return out


def test_patterns_match_like_python(spark):
    lines = random_lines(4000)
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string").repartition(4)
    cols, expected = [], {}
    for kind, table in (("f", dims.JVM_FUNCTION_PATTERNS), ("c", dims.CLASS_PATTERNS)):
        stated = dims.FUNCTION_PATTERNS if kind == "f" else dims.CLASS_PATTERNS
        for lang, patterns in table.items():
            cols.append(first_group(F.col("line"), patterns).alias(f"{kind}_{lang}"))
            expected[f"{kind}_{lang}"] = [next((m.group(1) for p in stated[lang] if (m := re.search(p, x))), None) for x in lines]
    for kind, table in (("i", dims.IMPORT_PATTERNS), ("e", dims.ERROR_PATTERNS)):
        for lang, patterns in table.items():
            cols.append(any_match(F.col("line"), patterns).alias(f"{kind}_{lang}"))
            expected[f"{kind}_{lang}"] = [any(re.search(p, x) for p in patterns) for x in lines]
    rows = sorted(df.select("i", *cols).collect(), key=lambda r: r["i"])
    for name, want in expected.items():
        assert [r[name] for r in rows] == want, name
    for lang in dims.FUNCTION_PATTERNS:  # the sample is not empty for any language
        assert any(expected[f"f_{lang}"]), lang


def test_task_markers_match_like_python(spark):
    rnd = random.Random(3)
    parts = ["#", "//", "/*", "*", "<!--", "TODO", "todo", "FixMe", "BUG", "xxx", ":", " ", "\xa0", "\x1f", "　", "later", "é", "İ"]
    lines = ["".join(rnd.choice(parts) for _ in range(rnd.randint(2, 9))) for _ in range(4000)] + ["#\xa0TODO fix me", "# TODO\xa0: later"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = [r[1] for r in sorted(df.select("i", F.nullif(F.regexp_extract("line", u(dims.TODO_PATTERN, "iU"), 1), F.lit("")))
                                .collect())]
    want = [(m.group(1) if (m := re.search(dims.TODO_PATTERN, x, re.IGNORECASE)) else None) for x in lines]
    assert got == want


@pytest.mark.parametrize("line", ["word " * 200_000, "public static " * 70_000 + "void f(int a) {", "x" * 1_000_000, "(" * 300_000])
def test_a_line_of_a_megabyte_in_every_language(spark, line):
    files = {f"f{i}{ext}": line + "\n" for i, ext in enumerate(sorted(dims.LANGUAGE_BY_EXTENSION)) if
             dims.LANGUAGE_BY_EXTENSION[ext] in dims.FUNCTION_PATTERNS or ext in (".c", ".cpp", ".sh", ".r")}
    a = analyze(corpus_df(spark, files))
    assert a.file_facts.where("total_lines = 1").count() == len(files)
    if "void f(" in line:
        assert a.functions.where("name = 'f' and language in ('Java', 'C#')").count() == 2


def test_smells_of_small_and_empty_repositories(spark):
    literal = 'x = "a literal that is long enough to count"\n'
    files = {("few", "a.py"): literal * 6, ("many", "a.py"): literal * 12, ("ignored", "node_modules/a.py"): literal * 12,
             ("binary", "b.py"): "x\x00y", ("names", "n.py"): "".join(f"def snake_{i}():\n" for i in range(4)) + "def camelCase():\n"}
    a = analyze(corpus_df(spark, files))
    scores = {(r.repo_id, r.smell): r.score for r in a.smells.collect()}
    assert len(scores) == 8 * 5
    assert all(s == 0.0 for (repo, _), s in scores.items() if repo in ("ignored", "binary"))
    details = a.smell_details.collect()
    assert {r.repo_id for r in details if r.smell == "copy_paste_artifacts"} == {"many"}  # fewer than 10 literals give no evidence
    assert sorted((r.subject, r.value) for r in details if r.smell == "inconsistent_patterns") == [
        ("PascalCase", 0.0), ("camelCase", 1.0), ("snake_case", 4.0)]
    said = {(r.repo_id, r.smell): r.description for r in a.smell_results.collect()}
    assert said["names", "inconsistent_patterns"] == "80.0% of names follow the main style"
    assert {r.repo_id: r.fixes for r in a.fix_plans.collect()}.keys() == {"few", "many", "ignored", "binary", "names"}


def test_text_content_is_repaired_like_bytes(spark):
    raw = b"x = 1\n# caf\xe9 \xff\n"
    binary = corpus_df(spark, {"a.py": raw})
    text = binary.withColumn("content", F.col("content").cast("string"))
    assert [r.text for r in analyze(binary).source_files.collect()] == [raw.decode("utf-8", "replace")]
    assert [r.text for r in analyze(text).source_files.collect()] == [raw.decode("utf-8", "replace")]
