"""Mixing, sharding, token blocks, the pipeline and its SQL: against brute force, odd input, empty tables."""

import os
import zlib

import brute
import duckdb
import numpy as np
import pytest
from conftest import SF_SMALL

from healthspark.llm import mixing, sharding, token_binary
from healthspark.llm.common import connected_components, new_path
from healthspark.llm.queries import ORACLES, QUERIES, tokenizer_path


def test_mix_reaches_its_targets(spark):
    rows = [r for r in brute.texts() if r[0] != 308] + [(600 + i, "w " * (1 + i % 7), f"tiny{i % 2}") for i in range(20)] + [
        (700, "one hundred " * 3, None)] + [(1000 + i, "many equal sizes here", "hot") for i in range(600)]
    docs = brute.frame(spark, rows)
    want, sizes = brute.targets(rows)
    got = mixing.mix(docs, bucket_rows=100, carry=["source", "odd.name"]).collect()
    assert len(got) == len(rows)
    taken: dict = dict.fromkeys(want, 0)
    longest = {s: max(len(brute.WORD.findall(t or "")) for _, t, x in rows if x == s) for s in want}
    for r in got:
        s = r["row"]["source"]
        assert r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[s] += r["taken"]
    for s in want:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], longest[s])
        if want[s] == 3 * sizes[s]:
            assert taken[s] == want[s]
    again = mixing.mix(docs, bucket_rows=100)
    assert sorted((r["doc_id"], r["taken"]) for r in again.collect()) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_mixed_documents_keep_columns_and_repeat_rows(spark):
    rows = brute.texts()[:40]
    docs = brute.frame(spark, rows)
    out = mixing.mixed_documents(docs)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    assert out.columns == docs.columns and out.count() == sum(copies.values())


def test_shards_are_even_and_gapless(spark):
    rows = brute.texts() + [(2000 + i, "hot copies of one text", "s") for i in range(900)] + [(5000, "same row", "s")] * 50 + [
        (None, None, "s"), (None, "no id", "s")]
    got = sharding.shard_documents(brute.frame(spark, rows), 12).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(
        ((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows), key=repr)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for shard in range(12):
        own = [r for r in got if r["shard"] == shard]
        assert abs(sum(r["size"] for r in own) - total / 12) <= largest + 0.01 * total / 12
        assert sorted(r["slot"] for r in own) == list(range(len(own)))


def test_a_hot_text_is_cut_to_within_one_row(spark):
    docs = brute.frame(spark, [(i, "x" * 84, "s") for i in range(800)])
    got = sharding.shard_documents(docs, 8).groupBy("shard").count().collect()
    assert len(got) == 8 and all(abs(r["count"] - 100) <= 1 for r in got)


def test_only_the_cells_of_targets_reach_the_driver(spark, monkeypatch):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    rows, sent, collect = sharding.sort_keys(docs).persist(), [], type(docs).collect
    total = rows.agg({"size": "sum"}).first()[0]
    monkeypatch.setattr(type(docs), "collect", lambda df: sent.append(collect(df)) or sent[-1])
    splitters = sharding.find_splitters(rows, [total * i / 40 for i in range(1, 40)], 0.001 * total / 40)
    assert sent and max(map(len, sent)) <= 39
    below = [rows.where(~sharding._at_least(s)).agg({"size": "sum"}).first()[0] for s in splitters[::13]]
    assert all(abs(b - total * i / 40) <= 0.001 * total / 40 + 30 for b, i in zip(below, range(1, 40, 13)))


def test_all_targets_in_one_cell(spark):
    # one text holds nearly all bytes, and others share its first cell: only that cell's rows count in the next pass
    docs = spark.range(21_000).selectExpr("id AS doc_id", "if(id < 1000, repeat('x', 20000), concat('text ', id)) AS text")
    rows = sharding.sort_keys(docs).persist()
    total = rows.agg({"size": "sum"}).first()[0]
    splitters = sharding.find_splitters(rows, [total * i / 4 for i in (1, 2, 3)], 0.001 * total)
    below = [rows.where(~sharding._at_least(s)).agg({"size": "sum"}).first()[0] for s in splitters]
    assert all(abs(b - total * i / 4) <= 0.001 * total for b, i in zip(below, (1, 2, 3)))


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 20, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2 ** bits, 1001, dtype=np.uint64).astype("<u4")
    packed = token_binary.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    for start, count in ((0, 1001), (3, 0), (17, 400), (1000, 1)):
        assert token_binary.unpack(packed, bits, start, count).tolist() == ids[start:start + count].tolist()


def test_tokens_equal_whole_text_encoding(spark):
    from tokenizers import Tokenizer

    rows = brute.texts()
    plain = Tokenizer.from_file(tokenizer_path())
    path = new_path(spark, "test-tokens")
    token_binary.write_token_blocks(brute.frame(spark, rows), path, tokenizer_path(), 1, shards=3, block_ids=500)
    got = sorted(token_binary.read_token_documents(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(d for d, _, _ in rows)
    at, text = 0, {d: t or "" for d, t, _ in rows}
    for r in got:
        ids = np.array(plain.encode(text[r["doc_id"]], add_special_tokens=False).ids + [1], "<u4")
        assert r["start"] == at and r["n_tokens"] == len(ids) and r["ids"] == ids.tolist()
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes())
        at += len(ids)
    assert token_binary.read_ids(spark, path, 311).tolist() == got[[r["doc_id"] for r in got].index(311)]["ids"]
    assert token_binary.read_ids(spark, path, -1) is None


def test_empty_tables(spark):
    docs = brute.frame(spark, [])
    assert mixing.mix(docs).count() == 0 and mixing.mixed_documents(docs).count() == 0
    assert sharding.shard_documents(docs, 40).count() == 0
    assert token_binary.token_table(docs, tokenizer_path()).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 300)] + [(1000, 1001 + i) for i in range(300)] + [(7, 7)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).select("id", "component").collect())
    assert got == {i: 100 for i in range(100, 301)} | {i: 1000 for i in range(1000, 1301)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    df, want = QUERIES[name](spark, SF_SMALL), con.sql(ORACLES[name])
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == \
        sorted((tuple(dict(zip(want.columns, r))[c] for c in names) for r in want.fetchall()), key=repr)


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in docs.collect()}
    toxic = P.drop_toxic(spark, docs, SF_SMALL)
    assert toxic.columns == docs.columns and {r["doc_id"] for r in toxic.collect()} <= set(rows)
    near = P.drop_near_duplicates(spark, docs, SF_SMALL)
    triples = [(d, r["text"], r["source"]) for d, r in rows.items()]
    assert sorted(r["doc_id"] for r in near.collect()) == [d for d, _, _, k in brute.near_duplicates(triples, 5, 80) if k]
    clean = P.drop_contaminated(spark, docs, SF_SMALL)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r[0] for r in brute.contamination(triples, bench) if not r[4])
    mixed = P.mix_sources(spark, docs, SF_SMALL)
    assert mixed.columns == docs.columns
    assert P.write_tokens(spark, mixed, SF_SMALL).count() == mixed.count()
    assert P.run(spark, SF_SMALL).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [name for name, _ in P.STAGES] == ["toxicity", "minhash", "decontamination", "mixing", "tokens"]
