"""MinHash and embedding near-duplicates, suffix-array dedup: against brute force, odd input, empty tables."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from healthspark.llm import embeddings, minhash, suffix_dedup


def test_minhash_equals_brute_force(spark):
    rows = brute.texts()
    got = minhash.near_duplicates(brute.frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == brute.near_duplicates(rows)


def test_minhash_large_nodes_are_finished_exhaustively(spark):
    # with leaves of 2 every group stays large to the last level
    rows = [r for r in brute.texts() if r[0] >= 100]
    got = minhash.near_duplicates(brute.frame(spark, rows), words=5, percent=80, leaf=2).collect()
    assert sorted(tuple(r) for r in got) == brute.near_duplicates(rows, 5, 80)


def test_deduplicate_keeps_one_row_of_each_group_and_all_columns(spark):
    rows = [r for r in brute.texts() if r[0] >= 90] + [(None, "no id", "s"), (None, None, "s")]
    docs = brute.frame(spark, rows)
    kept = minhash.deduplicate(docs)
    expected = {d for d, _, _, keep in brute.near_duplicates([r for r in rows if r[0] is not None], 5, 80) if keep}
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(expected)
    assert sum(r["doc_id"] is None for r in kept.collect()) == 2


def test_suffix_array_equals_sorting():
    rnd = random.Random(2)
    for _ in range(400):
        s = [rnd.randint(1, rnd.choice([1, 2, 4, 90])) for _ in range(rnd.randint(0, 50))] + [0]
        for alphabet in (1, 1024):  # with and without recursion by induction
            got = suffix_dedup.suffix_array(np.array(s), alphabet).tolist()
            assert got == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_dedup_equals_brute_force(spark):
    rows = brute.texts()
    got = suffix_dedup.remove_repeats(brute.frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == brute.repeats(rows)


def test_suffix_dedup_of_many_texts_with_one_id(spark):
    rnd = random.Random(13)
    pieces = ["".join(rnd.choice("abcdefgh ") for _ in range(60)) for _ in range(400)]
    rows = [(doc, " ".join(rnd.choice(pieces) for _ in range(3)), "s") for doc in (None, 7) for _ in range(2500)]
    rows += [(8, " ".join(pieces[:3]), "s"), (8, " ".join(pieces[:3]), "s"), (-(2 ** 63), pieces[5], "s"), (None, None, "s")]
    frame = brute.frame(spark, rows)
    ordered = frame.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).distinct().orderBy(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()
    want = brute.repeats([(i, r["text"], "") for i, r in enumerate(ordered)], 40)  # numbers give the order
    want = {(ordered[n]["doc_id"], ordered[n]["text"]): (size, *rest) for n, size, *rest in want}
    got = suffix_dedup.remove_repeats(frame, length=40, k=16).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((d, *want[d, t or ""]) for d, t, _ in rows), key=repr)


def test_suffix_dedup_hot_anchors_and_short_strings(spark):
    rows = [r for r in brute.texts() if r[0] < 210] + [(-5, "", "s"), (400, "a" * 100, "s"), (401, "a" * 101, "s")]
    got = suffix_dedup.remove_repeats(brute.frame(spark, rows), length=40, k=16, hot=3, with_bytes=True).collect()
    assert sorted(tuple(r)[:5] for r in got) == brute.repeats(rows, 40)
    by_id = {r["doc_id"]: r for r in got}
    for d, t, _ in rows:
        raw, r = (t or "").encode(), by_id[d]
        cut = [raw[s["start"]:s["end"]] for s in r["spans"]]
        assert len(cut) == r["n_spans"] and sum(map(len, cut)) + len(bytes(r["kept"])) == len(raw)


def vectors():
    rnd = np.random.default_rng(8)
    base = rnd.standard_normal((40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[0] + 0.04 * rnd.standard_normal(16)).tolist()) for i in range(150)]  # dense group
    rows += [(300 + i, (base[1] * (i + 1) + 0.2 * (i + 1) * rnd.standard_normal(16)).tolist()) for i in range(20)]
    rows += [(400 + i, base[2].tolist()) for i in range(30)]  # exact copies
    return rows


def brute_vectors(rows, threshold=0.95):
    ids = sorted({i for i, _ in rows})
    unit = {i: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, v in rows}
    links = [(a, b) for a in ids for b in ids if a < b and unit[a] @ unit[b] >= threshold]
    reach = brute.components(ids, links)
    degree = {i: sum(i in p for p in links) for i in ids}
    return sorted((i, degree[i], reach[i], reach[i] == i) for i in ids)


@pytest.mark.parametrize("block", [256, 8])
def test_embeddings_equal_brute_force(spark, block):
    rows = vectors()
    frame = spark.createDataFrame([(i, [float(x) for x in v], 0, "k") for i, v in rows],
                                  "vec_id long, embedding array<float>, label int, key string")
    got = embeddings.near_duplicates(frame, small=min(32, block), block=block).collect()
    assert sorted(tuple(r) for r in got) == brute_vectors(rows)


def test_embeddings_odd_vectors_stand_alone(spark):
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
           (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0])]
    frame = spark.createDataFrame(odd, "vec_id long, embedding array<float>")
    got = sorted(((r[0] if r[0] is not None else -1, r[1], r[2], r[3]) for r in embeddings.near_duplicates(frame).collect()), key=repr)
    expected = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9)] + [(7, 1, 7, True)] * 2 + [(8, 1, 7, False), (-1, 0, None, True)]
    assert got == sorted(expected, key=repr)


def test_empty_tables(spark):
    docs = brute.frame(spark, [])
    assert minhash.near_duplicates(docs).count() == 0
    assert minhash.deduplicate(docs).count() == 0
    assert suffix_dedup.remove_repeats(docs).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
