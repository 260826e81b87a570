"""Line classification and per-line extraction on small hand-made files."""

from conftest import corpus_df
from healthspark.plans.analysis import analyze


def kinds(spark, path, text):
    a = analyze(corpus_df(spark, {path: text}), keep_lines=True)
    return [r["kind"] for r in a.lines.orderBy("line_no").collect()], a


def test_python_docstring_body_is_code(spark):
    text = 'def f():\n    """Doc\n    def inner(): body\n    """\n    return 1\n'
    ks, a = kinds(spark, "m.py", text)
    assert ks == ["code", "comment", "code", "comment", "code"]
    names = [r["name"] for r in a.functions.orderBy("start_line").collect()]
    assert names == ["f", "inner"]


def test_block_comment_state_js(spark):
    text = "let a = 1;\n/* open\ninside\nclose */\nlet b = 2; /* x */\n\n  // c\nif (a) {\n"
    ks, a = kinds(spark, "m.js", text)
    assert ks == ["code", "comment", "comment", "comment", "comment", "blank", "comment", "code"]
    assert [r["name"] for r in a.functions.collect()] == ["if"]   # heuristic kept on purpose


def test_line_counts_and_extents(spark):
    text = "import os\n\ndef a():\n    pass\n# c\ndef b():\n    x = 1\n\n"
    a = analyze(corpus_df(spark, {"m.py": text}))
    f = a.file_facts.collect()[0]
    assert (f.total_lines, f.code_lines, f.comment_lines, f.blank_lines) == (8, 5, 1, 2)
    ext = [(r.name, r.start_line, r.end_line, r.line_count) for r in a.functions.orderBy("start_line").collect()]
    assert ext == [("a", 3, 5, 3), ("b", 6, 8, 3)]
    assert f.import_count == 1 and f.function_count == 2


def test_todo_markers(spark):
    text = "# TODO\n# TODO:\n# bugs x\nx = 1  // fixme  later \n<!-- HACK: y\n"
    a = analyze(corpus_df(spark, {"m.py": text}))
    got = [(r.line_no, r.content) for r in a.todos.orderBy("line_no").collect()]
    assert got == [(2, ":"), (3, "s x"), (4, "later"), (5, "y")]


def test_literals_and_branches(spark):
    text = ("msg = \"abcdefghijklmnopqrstuvwxyz\" + 'short'\nelse:\nif(x):\nelif y:\ntry:\n"
            "# if comment line\n} else {\nif x:\nfor i in y:\n")
    a = analyze(corpus_df(spark, {"m.py": text}))
    lits = [r.literal for r in a.literals.collect()]
    assert lits == ["abcdefghijklmnopqrstuvwxyz"]
    assert a.file_facts.collect()[0].branch_lines == 4   # 'else:' and '} else' do not count


def test_binary_counts_but_is_not_analysed(spark):
    a = analyze(corpus_df(spark, {"a.py": b"x = 1\n", "b.py": b"\x00\x01"}))
    assert a.scanned.count() == 2
    assert [r.path for r in a.file_facts.collect()] == ["a.py"]


def test_invalid_utf8_is_replaced(spark):
    a = analyze(corpus_df(spark, {"a.py": b"x = '\xff'\n"}), keep_lines=True)
    assert a.lines.collect()[0]["line"] == b"x = '\xff'".decode("utf-8", "replace")
