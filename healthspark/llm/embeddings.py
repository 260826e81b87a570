"""Embedding near-duplicates: sign hashing by random hyperplanes, exact cosine, connected components.

Identical vectors form one class first. Each class gets `tables` keys of `bits` signs; vectors that share
a key are candidates. bits = log2(number of classes), so unrelated vectors share a bucket about once
per table at every size, and the number of tables follows from the wanted recall of a pair exactly at
the threshold (default: one in a million is missed).

Buckets of up to `small` classes are joined with themselves on narrow rows: key, id and a 256-bit sign
sketch, whose Hamming distance drops unrelated pairs (7 standard deviations from the threshold) before any
vector is fetched; distinct survivors are verified by exact cosine in double precision.

Larger buckets, as of a group of near copies, are cut into blocks of `block` classes, and pairs of blocks are compared by
matrix products in bounded tasks that return, per vector, a number of links and a link to its local root:
the links of a dense group are counted, never listed. A pair that meets in several buckets counts once: in
the large bucket of the first table in which both share one, else among the distinct pairs of the small ones.

Input rules: vectors that are null, empty, zero, or hold nulls or non-finite numbers link with nothing and are
their own component; vectors of different lengths never link; rows that share a vec_id are one vertex;
a null vec_id has a null component and no links; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, store

SKETCH = 256


def plan_tables(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = min(40, max(6, math.ceil(math.log2(max(2, n)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def valid(vector: Column) -> Column:
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.when(finite, square > 0), F.lit(False))


def sign_keys(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """(id, keys array<long>, sketch array<long>): keys name table, signs and vector length."""
    width = max(SKETCH, bits * tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        place = (1 << np.arange(bits, dtype=np.int64))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, vectors = part.column(0).to_pylist(), part.column(1).to_pylist()
                keys, sketches = [None] * len(ids), [None] * len(ids)
                for size in {len(v) for v in vectors}:
                    if size not in planes:
                        planes[size] = np.random.default_rng([seed, size]).standard_normal((size, width))
                    rows = [i for i, v in enumerate(vectors) if len(v) == size]
                    x = np.array([vectors[i] for i in rows], dtype=np.float64)
                    signs = (x / np.abs(x).max(axis=1, keepdims=True)) @ planes[size] > 0
                    k = signs[:, :bits * tables].reshape(len(rows), tables, bits) @ place
                    k += (np.arange(tables, dtype=np.int64) + size * tables) << bits
                    s = np.packbits(signs[:, :SKETCH], axis=1).view(np.int64)
                    for n, i in enumerate(rows):
                        keys[i], sketches[i] = k[n], s[n]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                                                  pa.array(sketches, pa.list_(pa.int64()))], ["id", "keys", "sketch"])

    return classes.select("id", "vector").mapInArrow(run, "id long, keys array<long>, sketch array<long>")


def _differing(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(1, SKETCH // 64)),
               F.bit_count(F.col(f"{a}0").bitwiseXOR(F.col(f"{b}0"))))


def cosine(x: Column, y: Column) -> Column:
    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0),
                           lambda s, z: s + z)

    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def _compare_blocks(threshold: float, bits: int, tables: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        key, i, j = rows["key"].iat[0], rows["i"].iat[0], rows["j"].iat[0]
        left, right = rows[rows["x"] == i], rows[rows["x"] == j]
        ids, other = left["id"].to_numpy(), right["id"].to_numpy()

        def unit(part):
            v = np.stack(part["vector"].to_numpy()).astype(np.float64)
            return v / np.sqrt((v * v).sum(axis=1, keepdims=True))

        def large(part):  # the large bucket of each table, or -1
            held = part["large"].to_numpy()
            flat = np.concatenate(held)
            out = np.full((len(held), tables), -1, np.int64)
            out[np.repeat(np.arange(len(held)), [len(x) for x in held]), (flat >> bits) % tables] = flat
            return out

        out = {"id": [], "n": [], "root": []}
        if len(ids) and len(other):
            link = unit(left) @ unit(right).T >= threshold
            link &= ids[:, None] < other[None, :] if i == j else ids[:, None] != other[None, :]
            a, b = np.nonzero(link)
            mine, yours, shared = large(left), large(right), np.empty(len(a), bool)
            for at in range(0, len(a), 8192):  # a pair counts in the first table whose large bucket it shares
                p, q = mine[a[at:at + 8192]], yours[b[at:at + 8192]]
                shared[at:at + 8192] = ((p == q) & (p >= 0)).argmax(axis=1) == (key >> bits) % tables
            own, theirs = left["copies"].to_numpy(), right["copies"].to_numpy()
            names, at = np.unique(np.concatenate([ids[a], other[b]]), return_inverse=True)
            pa_, pb_ = at[:len(a)], at[len(a):]
            n = np.bincount(pa_[shared], theirs[b][shared], len(names)) + np.bincount(pb_[shared], own[a][shared], len(names))
            root = np.arange(len(names))
            while len(a):  # smallest label over links, until none moves
                least = root.copy()
                np.minimum.at(least, pa_, root[pb_])
                np.minimum.at(least, pb_, root[pa_])
                least = least[least]
                if (least == root).all():
                    break
                root = least
            out = {"id": names, "n": n.astype(np.int64), "root": names[root]}
        return pd.DataFrame(out).astype({"id": "int64", "n": "int64", "root": "int64"})
    return run


def near_duplicates(rows: DataFrame, threshold: float = 0.95, miss: float = 1e-6, id_col: str = "vec_id",
                    vector_col: str = "embedding", small: int = 32, block: int = 256, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row."""
    named = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    ok = valid(F.col("vector")) & F.col("vec_id").isNotNull()
    named = named.withColumn("h1", F.when(ok, F.xxhash64("vector"))).withColumn(
        "h2", F.when(ok, F.xxhash64(F.lit(1), F.col("vector"))))
    classes = store(named.where("h1 is not null").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("copies"), F.first("vector").alias("vector")), "vectors")
    members = store(named.select("vec_id", "h1", "h2"), "vector-members")
    bits, tables = plan_tables(classes.count(), threshold, miss)
    keyed = store(sign_keys(classes, bits, tables, seed), "sign-keys")
    flat = keyed.select("id", F.explode("keys").alias("key"), *[F.element_at("sketch", i + 1).alias(f"s{i}")
                                                                 for i in range(SKETCH // 64)])
    sizes = store(flat.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "bucket-sizes")
    # small buckets: narrow self-join, sketch test, distinct pairs
    side = flat.join(sizes.where(F.col("held") <= small).select("key"), "key")
    other = side.select("key", F.col("id").alias("b"), *[F.col(f"s{i}").alias(f"t{i}") for i in range(SKETCH // 64)])
    far = 1 - (1 - math.acos(threshold) / math.pi)
    most = math.ceil(SKETCH * far + 7 * math.sqrt(SKETCH * far * (1 - far)))
    pairs = side.withColumnRenamed("id", "a").join(other, "key").where((F.col("a") < F.col("b")) & (
        _differing("s", "t") <= most)).select("a", "b").distinct()
    # large buckets of each vector; at most one for each table
    large = flat.join(sizes.where(F.col("held") > small), "key").select("id", "key", "held")
    full = store(classes.join(large.groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("large")), "id", "left")
                 .select("id", "vector", "copies", F.coalesce("large", F.array().cast("array<long>")).alias("large")), "vectors")
    va = full.select(F.col("id").alias("a"), F.col("vector").alias("va"), F.col("copies").alias("ca"), F.col("large").alias("la"))
    vb = full.select(F.col("id").alias("b"), F.col("vector").alias("vb"), F.col("copies").alias("cb"), F.col("large").alias("lb"))
    links = store(pairs.join(va, "a").join(vb, "b").where(
        (F.size("va") == F.size("vb")) & (cosine(F.col("va"), F.col("vb")) >= threshold) & ~F.arrays_overlap("la", "lb"))
        .select("a", "b", "ca", "cb"), "links")
    blocks = F.ceil(F.col("held") / block).cast("int")
    spread = large.withColumn("x", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn(
        "y", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "id", "key", "x", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    dense = store(spread.join(full, "id").groupBy("key", "i", "j").applyInPandas(
        _compare_blocks(threshold, bits, tables), "id long, n long, root long"), "dense")
    counts = links.select(F.col("a").alias("id"), F.col("cb").alias("n")).unionAll(
        links.select(F.col("b").alias("id"), F.col("ca").alias("n"))).unionAll(dense.select("id", "n")) \
        .groupBy("id").agg(F.sum("n").alias("n"))
    found = connected_components(links.select("a", "b").unionAll(
        dense.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")).distinct()))
    result = classes.select("id", "h1", "h2", "copies").join(counts, "id", "left").join(found, "id", "left").select(
        "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    return members.join(result, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
