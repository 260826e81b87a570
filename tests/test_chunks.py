"""Files in chunks equal whole files; trees walked by tasks equal os.walk."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, corpus_df
from healthspark.operators import chunks as H
from healthspark.plans.analysis import analyze
from healthspark.sources import driver_corpora as K
from healthspark.sources import walk as W
from healthspark.sources.corpus import read_repo_tree

TABLES = ("file_facts", "functions", "classes", "imports", "todos", "literals")
PIECES = [b"def f(x):\n", b"class K:\n", b"/* open\n", b"close */\n", b"/* both */ x;\n", b"// one\n", b"# TODO: what\n", b"\n", b"  \t\n",
          b"import a;\r\n", b"x = 'a literal of more than twenty letters'\n", b"def\n", b"  a_view(x):\n", b"export\n", b"default\n\n", b"function\n",
          b"  MyPage() {\n", b"if (x) {\r\n", b"y = 1\x0bz = 2\n", b"get\n", b"  '/a'\n", b"\xff\xfe bad;\n", "é;\u2028b;\n".encode(), b"public void run() {\n",
          b"\"\"\"\n", b"<!--\n", b"-->\n", b"app.get(\"/x\", f);\n", b"no break", b"\r", b"try {\n", b"function go(a) {\n", b"}\n"]


def odd_files(seed):
    rnd = random.Random(seed)
    files = {}
    for i, ext in enumerate([".py", ".js", ".ts", ".java", ".html", ".rb", ".md", ".css", ".go"] * 4):
        files[f"src/m{i:02d}{ext}"] = b"".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 60)))
    return files | {"empty.py": b"", "nul.py": b"a = 1;\n" * 40 + b"\x00\n", "one.js": b"x" * 5000, "node_modules/x.js": b"function f() {\n"}


def tables(a):
    return {t: sorted((tuple(sorted(r.asDict().items())) for r in getattr(a, t).collect()), key=repr) for t in TABLES}


@pytest.mark.parametrize("size", [1, 64, 1 << 20])
def test_chunks_equal_whole_files(spark, size):
    corpus = corpus_df(spark, odd_files(size))
    cut = H.chunk_table(corpus, size)
    joined = {}
    for r in sorted(cut.collect(), key=lambda r: (r.path, r.start)):
        assert r.start == len(joined.get(r.path, b""))
        joined[r.path] = joined.get(r.path, b"") + bytes(r.piece)
    assert joined == odd_files(size) and (size > 300 or len(joined) < cut.count())
    got, want = tables(H.analyse_chunks(cut, H.digests(corpus))), tables(analyze(corpus))
    for t in TABLES:
        assert got[t] == want[t], t


def test_chunks_of_the_code_corpus(spark):
    corpus = K.k1_corpus(spark, SF_SMALL)
    got, want = tables(H.analyse_chunks(H.chunk_table(corpus, 200), H.digests(corpus))), tables(analyze(corpus))
    assert got == want
    assert H.analyse_chunks(H.chunk_table(corpus.where("false"), 200), H.digests(corpus)).file_facts.count() == 0


def test_a_block_comment_over_many_chunks(spark):
    text = "int a;\n/* open;\n" + "int in_comment() {;\n" * 500 + "*/\nint b;\n"
    a = H.analyse_chunks(H.chunk_table(corpus_df(spark, {"a.c": text}), 100), H.digests(corpus_df(spark, {"a.c": text})))
    (r,) = a.file_facts.collect()
    assert (r.code_lines, r.comment_lines, r.function_count) == (2, 502, 0)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for path, content in odd_files(3).items():
        file = root / "repo_a" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(content)
    rnd = random.Random(1)
    for i in range(150):
        folder = root / "_repo" / "/".join(rnd.choice(["a", "_b", "c.d", ".hidden", "node_modules", "x.egg-info"]) for _ in range(rnd.randint(0, 6)))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / rnd.choice([f"_m{i}.py", f"m{i}.js", f"m{i}.bin", ".h.py"])).write_bytes(b"x = 1;\n" * rnd.randint(0, 50))
    (root / "top.py").write_bytes(b"pass\n")
    os.symlink(root, root / "repo_a" / "loop")
    os.symlink(root / "nowhere.py", root / "repo_a" / "dangling.py")
    return str(root)


@pytest.mark.parametrize("prefix, share", [("", 50), ("file://", 1), ("file://", 20_000)])
def test_walk_equals_os_walk(spark, tree, prefix, share):
    bad = lambda n: n.lower() in ("node_modules",) or n.startswith(".") or n.lower().endswith(".egg-info")
    want = set()
    for folder, below, names in os.walk(tree):
        below[:] = [d for d in below if not bad(d)]
        want |= {os.path.relpath(os.path.join(folder, n), tree) for n in names}
    assert {r.file for r in W.list_files(spark, prefix + tree, share=share).collect()} == want


def test_walked_corpus_equals_the_mounted_one(spark, tree):
    one = analyze(read_repo_tree(spark, tree))
    two = analyze(W.walk_repo_tree(spark, "file://" + tree))
    assert tables(one) == tables(two) and one.file_facts.count() > 60
    files = W.list_files(spark, "file://" + tree)
    chunked = H.analyse_chunks(W.read_chunks(files, "file://" + tree, chunk_bytes=64), W.file_digests(files, "file://" + tree))
    assert tables(chunked) == tables(one)


def test_ranges_cut_where_whole_files_are_cut(spark, tree):
    files = W.list_files(spark, tree)
    whole = W.walk_repo_tree(spark, tree).where(F.col("content").isNotNull())
    for size in (40,):
        pick = lambda df: sorted((r.repo_id, r.path, r.start, bytes(r.piece)) for r in df.collect())
        assert pick(W.read_chunks(files, tree, chunk_bytes=size)) == pick(H.chunk_table(whole, size))


def test_missing_root(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        W.list_files(spark, f"file://{tmp_path}/none")
