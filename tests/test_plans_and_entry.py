"""Plan shape assertions and the driver contract."""

import os
import re

import pytest
from conftest import SF_SMALL, corpus_df
from healthspark.operators import duplicates as D
from healthspark.operators import structure as S
from healthspark.plans.analysis import analyze
from healthspark.operators import metrics as M
from healthspark.plans.catalog import REGISTRY
from healthspark.sources.corpus import corpus_from_table, language_breakdown, source_files
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_file_analysis_is_map_only_and_udf_free(spark):
    c = corpus_df(spark, {"a.py": "def f():\n    pass\n", "b.js": "function g() {\n}\n"})
    p = plan(S.file_analysis(source_files(c)))
    assert "Exchange" not in p
    assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_near_duplicates_has_no_cartesian_product(spark):
    a = analyze(corpus_df(spark, {"a.py": "def f():\n" * 12, "b.py": "def f():\n" * 12}), materialize="write")
    p = plan(D.near_duplicates(a.analysis))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_documents_read_back_are_not_broadcast(spark):
    # Spark sizes the texts of all documents by the bytes of their index
    p = plan(REGISTRY["report_document"](spark, SF_SMALL))
    # the outermost join has the texts
    assert "MapInArrow" in p and re.search(r"\w+Join\b", p).group() == "SortMergeJoin"


def test_scan_prunes_content_for_metadata(spark, tmp_path):
    c = corpus_df(spark, {"a.py": "x = 1\n", "node_modules/b.js": "y\n"}).withColumn("size_bytes", F.octet_length("content"))
    c.write.parquet(str(tmp_path / "corpus"))
    a = analyze(corpus_from_table(spark.read.parquet(str(tmp_path / "corpus"))))
    assert "ReadSchema: struct<repo_id:string,path:string,size_bytes:int>" in plan(language_breakdown(a.scanned))


def test_metrics_read_no_child_arrays_and_analyse_once(spark):
    a = analyze(corpus_df(spark, {"a.py": "def f():\n    pass\n", "b.js": "function g() {\n}\n"}))
    totals = M.analysis_totals(a.analysis).select("repo_id", "code_lines", "todos_count")
    text = plan(totals)
    assert "ReadSchema" in text and "literals" not in text.split("ReadSchema", 1)[1] and "split(" not in text


def test_a_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from healthspark import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077", "spark.app.id": "x"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50


def test_read_repo_tree(spark, tmp_path):
    from healthspark.sources.corpus import read_repo_tree
    (tmp_path / "repoA" / "src").mkdir(parents=True)
    (tmp_path / "repoA" / "src" / "m.py").write_text("def f():\n    pass\n")
    (tmp_path / "repoB").mkdir()
    (tmp_path / "repoB" / "x.js").write_bytes(b"function g() {\n}\n")
    corpus = read_repo_tree(spark, str(tmp_path))
    rows = sorted((r.repo_id, r.path) for r in corpus.select("repo_id", "path").collect())
    assert rows == [("repoA", "src/m.py"), ("repoB", "x.js")]
    ff = analyze(corpus).file_facts.collect()
    assert sorted((r.path, r.function_count) for r in ff) == [("src/m.py", 1), ("x.js", 1)]


def test_api_facade_single_codebase(spark, tmp_path):
    from healthspark import api
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "pay.py").write_text("def process_payment(x):\n    return x\n")
    (tmp_path / "tests").mkdir()
    (tmp_path / "tests" / "test_pay.py").write_text("def test_pay():\n    assert True\n")
    files = api.scan_codebase(spark, str(tmp_path))
    assert sorted(r.path for r in files.collect()) == ["src/pay.py", "tests/test_pay.py"]
    a = analyze(corpus_df(spark, {"src/pay.py": "def process_payment(x):\n    return x\n"}),
                materialize="write", ai_generated=False, base_density=1000.0)
    m = api.aggregate_metrics(a).collect()[0]
    assert m.estimated_defects == 2 and m.defect_density == 1000.0
    assert api.detect_missing_error_handling(a.analysis).collect()[0].score == 1.0
    assert api.generate_json_report(a).count() == 1


def test_report_sinks(spark, tmp_path):
    from healthspark.plans import reports as R
    a = analyze(corpus_df(spark, {("r1", "a.py"): "def login(x):\n    return x\n",
                                  ("r2", "b.js"): "function f() {\n}\n"}), materialize="write")
    R.write_reports({"files": R.report_files(a.analysis), "summary": R.report_summary(a.repo_metrics)},
                    str(tmp_path / "json"))
    back = spark.read.json(str(tmp_path / "json" / "files"))
    assert sorted((r.repo_id, r.path) for r in back.select("repo_id", "path").collect()) == [("r1", "a.py"), ("r2", "b.js")]
    R.write_texts(R.render_notes(a.fixes, a.repo_metrics), "notes", str(tmp_path / "notes"))
    notes = spark.read.text(str(tmp_path / "notes" / "repo_id=r1")).collect()
    assert any("State of the code" in r.value for r in notes)


def test_read_repo_tree_equals_a_walk(spark, tmp_path, monkeypatch):
    from healthspark.functions import dims
    from healthspark.sources.corpus import read_repo_tree
    names = ["top.py", "a/__init__.py", "a/_util.py", "a/__tests__/x.js", "a/.hidden/h.py", "node_modules/p/i.js", "b/ünï ço.py",
             "b/c/d/e/deep.go", "b/c/d/e/.dot.py", "b/pkg.egg-info/m.py", "b/c/data.bin", "b/min/app.min.js", "_x/_y.rb"]
    for n in names:
        (tmp_path / "tree" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / n).write_bytes(n.encode())
    os.chmod(tmp_path / "tree" / "node_modules", 0o000)  # entering it would fail
    expected = []
    for folder, below, files in os.walk(tmp_path / "tree"):
        below[:] = [d for d in below if d.lower() not in dims.IGNORED_DIR_NAMES and not d.startswith(".")
                    and not d.lower().endswith(".egg-info")]
        expected += [os.path.relpath(os.path.join(folder, f), tmp_path / "tree") for f in files]
    for shards in (1, 3, 256):
        rows = read_repo_tree(spark, str(tmp_path / "tree"), repo_id="r", shards=shards).collect()
        assert sorted(r.path for r in rows) == sorted(expected)
        assert all(r.size_bytes == len(r.path.encode()) and r.content in (None, r.path.encode()) for r in rows)
        assert {r.path for r in rows if r.content is None} == {"b/c/d/e/.dot.py", "b/c/data.bin", "b/min/app.min.js"} & set(expected)
    monkeypatch.chdir(tmp_path)
    many = read_repo_tree(spark, "./tree", content=False)
    assert many.columns == ["repo_id", "path", "size_bytes"]
    assert {(r.repo_id, r.path) for r in many.collect()} >= {(".", "top.py"), ("a", "_util.py"), ("_x", "_y.rb"), ("b", "ünï ço.py")}
    os.chmod(tmp_path / "tree" / "node_modules", 0o755)
    with pytest.raises(Exception):
        read_repo_tree(spark, str(tmp_path / "nowhere")).collect()


def test_k1_keeps_every_lineitem_row(spark):
    from healthspark.sources import driver_corpora as K
    lines = K.k1_lines(spark, SF_SMALL)
    n = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    assert lines.where("copy = 0").count() == n
    files = K.k1_corpus(spark, SF_SMALL)
    assert files.select("repo_id", "path").distinct().count() == files.count()
    assert files.where("content = ''").count() == lines.where("copy < 0").select("src").distinct().count()


def test_a_scratch_scope_leaves_nothing_behind(spark, tmp_path):
    from healthspark.session import checkpoint_dir, scratch

    before = set(os.listdir(checkpoint_dir(spark).removeprefix("file://")))
    with scratch(spark) as folder:
        a = analyze(corpus_df(spark, {"a.py": "def f():\n    pass\n" * 20, "b.py": "x = 1\n"}))
        a.fix_plans.write.parquet(str(tmp_path / "plans"))
        assert len(os.listdir(folder.removeprefix("file://"))) > 3
        with scratch(spark) as inner:
            assert inner.startswith(folder + "/")
    assert set(os.listdir(checkpoint_dir(spark).removeprefix("file://"))) == before
    assert spark.read.parquet(str(tmp_path / "plans")).count() == 1


def test_written_tables_keep_methods_that_the_jvm_compiles(spark, tmp_path):
    from healthspark.plans.analysis import SMALL_SPLITS
    from healthspark.session import COMPILED_METHODS, materialize

    wanted = COMPILED_METHODS | SMALL_SPLITS
    before = {name: spark.conf.get(name, None) for name in wanted}
    seen = {}

    class Table:
        sparkSession, schema = spark, spark.range(3).schema

        @property
        def write(self):
            seen.update({name: spark.conf.get(name) for name in wanted})
            return spark.range(3).write

    assert materialize(Table(), "t", "write", str(tmp_path), SMALL_SPLITS).count() == 3
    assert seen == wanted
    assert {name: spark.conf.get(name, None) for name in wanted} == before


def test_the_analysis_reads_small_splits(spark, tmp_path):
    # 25 MB in six files, which one task could read: with the open cost of a file, no two fit in a split of 8 MB
    from healthspark.session import settings

    text = F.concat_ws("\n", F.transform(F.sequence(F.lit(0), F.lit(2000)), lambda i: F.concat(
        F.lit("# "), F.sha2(F.concat_ws("-", "id", i), 512))))
    spark.range(96).repartition(6).select(F.lit("r").alias("repo_id"), F.format_string("m%03d.txt.py", "id").alias("path"),
                                         text.alias("content")).write.option("compression", "none").parquet(f"{tmp_path}/c")
    a = analyze(spark.read.parquet(f"{tmp_path}/c"), materialize="write")
    with settings(spark, {"spark.sql.files.minPartitionNum": "1"}):
        assert a.analysis.select("code_lines", "comment_lines").groupBy().sum().first()[1] == 96 * 2001
    assert len(a.analysis.inputFiles()) == 6
