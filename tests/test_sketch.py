"""The count sketch keeps every frequent key and drops most of the others."""

import random

import pytest
from pyspark.sql import functions as F

from healthspark.operators.sketch import maybe_frequent


@pytest.mark.parametrize("bits", [4, 15, 16, 22])
def test_no_frequent_key_is_lost(spark, bits):
    rnd = random.Random(bits)
    rows = [(rnd.choice(["a", "b"]), f"key {min(int(rnd.expovariate(0.003)), 3000)}") for _ in range(6000)] + [("a", None)] * 7
    df = spark.createDataFrame(rows, "repo_id string, name string")
    count = lambda d: {(r[0], r[1]): r[2] for r in d.groupBy("repo_id", "name").count().collect()}
    whole, kept = count(df), count(maybe_frequent(df, ["repo_id", "name"], 5, bits))
    assert {k: n for k, n in kept.items() if n >= 5} == {k: n for k, n in whole.items() if n >= 5}
    assert all(kept[k] == whole[k] for k in kept)
    if bits == 22:  # wide enough: hardly a rare key shares a bucket with another one
        assert sum(n < 5 for n in kept.values()) <= 5 < sum(n < 5 for n in whole.values())
    assert maybe_frequent(df.where("false"), ["repo_id", "name"], 5, bits).count() == 0


def test_rare_keys_are_not_shuffled(spark):
    df = spark.range(100_000).select(F.lit("r").alias("repo_id"), F.concat(F.lit("literal "), F.col("id").cast("string")).alias("name"))
    hot = df.unionAll(spark.range(50).select(F.lit("r"), F.lit("again")))
    kept = maybe_frequent(hot, ["repo_id", "name"], 5)
    assert kept.where("name = 'again'").count() == 50 and kept.count() < 100
