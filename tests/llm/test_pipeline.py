"""The pipeline on odd documents and empty tables; operators whose rows share ids."""

import zlib

import brute
import numpy as np
import pytest

from healthspark.llm import mixing, token_binary
from healthspark.llm.queries import tokenizer_path


def _tables(spark, folder, rows):
    """A folder of tables; documents have null ids and texts, repeated rows and clashing column names."""
    brute.frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(brute.BENCHMARK, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    marks = [(d, 1, 0) for d, _, _ in rows if d is not None] + [(None, None, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("rows", [[], [r for r in brute.texts() if r[0] < 140 or r[0] >= 300] + [
    (None, "no id here at all", "src1"), (None, None, None), (None, "another without an id", "src0"), (3, "same id as another one", "src1")]],
    ids=["empty", "odd"])
def test_pipeline_of_odd_documents(spark, tmp_path, rows):
    import corpus_pipeline as P

    folder = _tables(spark, tmp_path, rows)
    docs = P.table(spark, folder, "documents")
    for name, stage in P.STAGES[:-1]:
        kept = P.store(stage(spark, docs, folder), name)
        assert kept.columns == docs.columns, name
        if name != "mixing":  # what a stage keeps are rows it was given
            assert kept.exceptAll(docs).isEmpty(), name
            assert kept.where("doc_id is null").count() == docs.where("doc_id is null").count(), name  # none of these is bad
        docs = kept
    got = P.run(spark, folder).collect()
    assert len(got) == docs.count() and bool(got) == bool(rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))  # null ids first


def test_tokens_of_rows_without_an_id(spark):
    from tokenizers import Tokenizer

    rows = [(None, f"text number {i}", "s") for i in range(40)] + [(5, "a", "s"), (5, "b", "s"), (-9, None, "s")]
    got = token_binary.token_table(brute.frame(spark, rows), tokenizer_path(), 1, shards=4, block_ids=20).collect()
    plain = Tokenizer.from_file(tokenizer_path())
    crc = lambda t: zlib.crc32(np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())
    assert sorted(((r["doc_id"], r["ids_crc32"]) for r in got), key=repr) == sorted(((d, crc(t)) for d, t, _ in rows), key=repr)


def test_mix_of_rows_without_an_id_does_not_depend_on_partitions(spark):
    docs = brute.frame(spark, [(None, f"text {i} of four", "s") for i in range(300)] + [(1, "x y z", "t")] * 3)
    copies = []
    for parts in (1, 5):
        out = mixing.mixed_documents(docs.repartition(parts), bucket_rows=50)
        copies.append(sorted(tuple(r) for r in out.groupBy("text").count().collect()))
    assert copies[0] == copies[1] and len({n for _, n in copies[0]}) > 1
