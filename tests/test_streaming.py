"""The streaming file-facts query agrees with the batch analysis."""

from conftest import corpus_df
from healthspark.plans.analysis import analyze
from healthspark.streaming import stream_file_facts


def test_stream_matches_batch(spark, tmp_path):
    files = {"a.py": "def f():\n    # c\n    return 1\n", "b.js": "/* x */\nfunction g() {\n}\n",
             "node_modules/c.js": "ignored\n"}
    corpus = corpus_df(spark, files)
    src = tmp_path / "in"
    corpus.limit(2).write.parquet(str(src / "part1"))
    corpus.subtract(corpus.limit(2)).write.parquet(str(src / "part2"))
    q = stream_file_facts(spark, str(src / "*"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(
        "path", "total_lines", "code_lines", "comment_lines", "function_count").collect())
    want = sorted(tuple(r) for r in analyze(corpus).file_facts.select(
        "path", "total_lines", "code_lines", "comment_lines", "function_count").collect())
    assert got == want
