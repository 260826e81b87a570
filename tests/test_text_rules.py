"""Column helpers against Python's own string semantics (the behaviour to reproduce)."""

from pathlib import PurePosixPath

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from healthspark.functions.text import split_lines, strip
from healthspark.sources import corpus as C

ALPHABET = ["a", "b", " ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f",
            "\x85", "\xa0", "\u2028", "\u2029", "\u3000", "é", "#"]


def test_split_lines_cases(spark):
    cases = ["", "\n", "a", "a\n", "a\n\n", "a\r\nb", "a\rb\r", "x\u2028y", "a\x0bb\x0cc", "\n\nz"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(split_lines(F.col("t"))).collect()]
    assert got == [c.splitlines() for c in cases]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=12), min_size=1, max_size=8))
def test_split_and_strip_match_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(split_lines(F.col("t")).alias("l"), strip(F.col("t")).alias("s")).collect()
    assert [r["l"] for r in rows] == [t.splitlines() for t in texts]
    assert [r["s"] for r in rows] == [t.strip() for t in texts]


def test_path_rules(spark):
    paths = ["src/a.py", "latest.py", "lib/contest.js", "Pods/x.swift", "x.mapping/a.py", "a.R",
             "node_modules/m/a.js", ".hidden/a.py", "a/.b.py", "pkg.egg-info/a.py", "tests/a.go",
             "src/Vendor2/a.py", "b.min.js", "noext", "x.", "dir.d/.gitignore", "Spec/a.rb", "a.tar.gz"]
    df = spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string")
    rows = {r["path"]: r for r in C.path_rules(df, ["Vendor2"]).collect()}
    for p in paths:
        assert rows[p]["extension"] == PurePosixPath(p).suffix.lower(), p
    assert rows["latest.py"]["is_test"] and rows["lib/contest.js"]["is_test"]
    assert rows["tests/a.go"]["is_test"] and rows["Spec/a.rb"]["is_test"]
    assert not rows["src/a.py"]["is_test"]
    assert rows["Pods/x.swift"]["kept"]                    # mixed-case ignore entry never matches
    assert rows["x.mapping/a.py"]["file_ignored"]          # '.map' anywhere in the path
    assert rows["a.R"]["language"] == "R" and rows["a.R"]["kept"]
    assert rows["node_modules/m/a.js"]["dir_ignored"] and rows[".hidden/a.py"]["dir_ignored"]
    assert rows["pkg.egg-info/a.py"]["dir_ignored"] and rows["a/.b.py"]["file_ignored"]
    assert rows["src/Vendor2/a.py"]["kept"]                # user entry with capitals has no effect
    assert rows["b.min.js"]["file_ignored"] and rows["noext"]["language"] is None
