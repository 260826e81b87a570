"""MinHash near-duplicates by chosen paths: a set similarity join for Jaccard similarity.

Documents with the same shingle set form one class. A class enters every tree at the node named by its
first minwise token (the shingle with the least hash of that tree and level). A node of up to `leaf`
classes is compared exhaustively. A larger one branches: each class moves on to the child named by its
next minwise token, and, in a share 1/t - 1 of the nodes, also to the child of a second one, so a pair
at the threshold t shares one child on average at any depth. Trees are independent; with 16 of
them a pair at the threshold misses all nodes of depth 1 to 4 with a probability between 1e-13 and 1e-5.

Candidates pass a sketch of 64 4-bit minhashes (4.7 standard deviations from the threshold), and are then
confirmed on the full sets of the whole texts. The likeliest partner of every class comes first;
pairs that its links already connect need no look.

Classes in nodes that are still large at the last level are alike without being separable: groups of
thousands of near copies. They meet again in the entry nodes of 7 trees (a pair at the threshold misses
all with probability 2e-6). Each such node is compared with its least class as a pivot; where that
leaves several components, it is compared exhaustively on the full sets, block by block in bounded tasks,
which return links between documents and local roots: pairs are counted in matrices, never listed.

Input rules: null and empty texts have no shingles and link with nothing; fewer words than a shingle
are one shingle; rows that share a doc_id are one vertex; a null doc_id links with nothing and has a null
component; long texts are processed whole; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, store

MINHASHES = 64
TREES = 16
LEVELS = MINHASHES // TREES
DENSE_TREES = 7
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending. bytes.split() cuts at space and 0x09-0x0D."""
    from xxhash import xxh3_64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxh3_64_intdigest(b" ".join(found), 1 + len(found))], np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(h) - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = (out ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _mix(x: np.ndarray, odd: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(odd)
    return x ^ (x >> np.uint64(33))


def sketch(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """(doc_id, n, f1, f2, tokens array<int>, s0..s3): one row per document, map-only.

    f1 and f2 identify the set; tokens are 64 minhashes of 32 bits; s0..s3 their lowest 4 bits.
    """
    numbers = np.random.default_rng(seed).integers(0, 2 ** 63, (2, MINHASHES), dtype=np.int64).astype(np.uint64)
    add, odd = numbers[0], numbers[1] | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.arange(16, dtype=np.uint64) * np.uint64(4)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, f1, f2, tokens, s = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    own = shingle_set(text, words)
                    n.append(len(own))
                    f1.append(np.add.reduce(_mix(own, 0xBF58476D1CE4E5B9)).astype(np.int64) if len(own) else 0)
                    f2.append(np.add.reduce(_mix(own, 0x94D049BB133111EB)).astype(np.int64) if len(own) else 0)
                    least = np.full(MINHASHES, ~np.uint64(0))
                    for k in range(0, len(own), 4096):
                        least = np.minimum(least, ((own[k:k + 4096, None] ^ add) * odd).min(axis=0))
                    high = (_mix(least, 0xFF51AFD7ED558CCD) >> np.uint64(32))
                    tokens.append(high.astype(np.uint32).view(np.int32))
                    s.append(((high & np.uint64(15)).reshape(4, 16) << shift).sum(axis=1, dtype=np.uint64).view(np.int64))
                s = np.array(s).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                     pa.array(tokens, pa.list_(pa.int32())), *[pa.array(s[:, i]) for i in range(4)]],
                    ["doc_id", "n", "f1", "f2", "tokens", "s0", "s1", "s2", "s3"])

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, tokens array<int>, "
                                "s0 long, s1 long, s2 long, s3 long")


def _differing(a: str, b: str) -> Column:
    """Number of minhashes whose 4 bits differ."""
    def nibbles(i: int) -> Column:
        x = F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return nibbles(0) + nibbles(1) + nibbles(2) + nibbles(3)


S = [f"s{i}" for i in range(4)]


def _right(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.col("id").alias("b"), *[F.col(f"s{i}").alias(f"t{i}") for i in range(4)],
                       *([F.col("component").alias("cb")] if "component" in rows.columns else []))


def _branches(large: DataFrame, classes: DataFrame, level: int, threshold: float) -> DataFrame:
    """Rows of large nodes, moved to their children of the next level."""
    joined = large.join(classes.select("id", "tokens"), "id")
    own = F.xxhash64("key", F.get("tokens", F.col("tree") * LEVELS + level))
    second = F.xxhash64("key", F.lit("second"), F.get("tokens", ((F.col("tree") + TREES // 2) % TREES) * LEVELS + level))
    coin = F.pmod(F.xxhash64("key", F.lit("coin")), F.lit(1000)) < int(1000 * (1 / threshold - 1))
    return joined.select("id", "tree", *S, F.explode(F.when(coin, F.array(own, second)).otherwise(F.array(own))).alias("key"))


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach 100 * intersection >= percent * union."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = shingle_set(x.as_py(), words), shingle_set(y.as_py(), words)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text",
                    leaf: int = 16, block: int = 512, seed: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    threshold = percent / 100
    most = int(MINHASHES * (1 - threshold) + 4.7 * (MINHASHES * threshold * (1 - threshold)) ** 0.5)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = store(sketch(docs, words, seed), "sketches")
    classes = store(sketches.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(
        F.min("doc_id").alias("id"), F.first("tokens").alias("tokens"), *[F.first(s).alias(s) for s in S]), "classes")
    flat = classes.select("id", *S, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)),
                          lambda t: F.get("tokens", t * LEVELS)))).select(
        "id", F.col("pos").alias("tree"), *S, F.xxhash64("pos", "col").alias("key"))
    entry, found, dense = flat, [], None
    for level in range(LEVELS):
        sizes = store(flat.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "nodes")
        nodes = store(flat.join(sizes, "key"), "node-rows")
        small = nodes.where(F.col("held") <= leaf)
        found.append(store(small.withColumnRenamed("id", "a").join(_right(small, ["key"]), "key").where(F.col("a") < F.col("b"))
                           .select("a", "b", _differing("s", "t").alias("d")).where(F.col("d") <= most).distinct(), "near"))
        large = nodes.where(F.col("held") > leaf)
        if level + 1 < LEVELS:
            flat = _branches(large, classes, level + 1, threshold)
        else:
            dense = store(large.select("id").distinct(), "dense")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionAll(more)
    one, two = dense.withColumnRenamed("id", "a"), dense.withColumnRenamed("id", "b")
    inside = pairs.join(one, "a", "left_semi").join(two, "b", "left_semi").select("a", "b")
    homes = store(entry.where(F.col("tree") < DENSE_TREES).join(dense, "id", "left_semi").select("key", "id", *S), "homes")
    pivots = homes.groupBy("key").agg(F.min(F.struct("id", *S)).alias("p")).select(
        "key", F.col("p.id").alias("pivot"), *[F.col(f"p.s{i}").alias(f"t{i}") for i in range(4)])
    starred = homes.join(pivots, "key").where("id <> pivot").select(
        F.col("pivot").alias("a"), F.col("id").alias("b"), _differing("s", "t").alias("d")).where(F.col("d") <= most)
    candidates = store(pairs.join(inside.distinct(), ["a", "b"], "left_anti").unionAll(starred).distinct(), "candidates")

    def texts_of(ids: DataFrame) -> DataFrame:
        return store(docs.join(ids.distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text"), "texts")

    def apart(pairs: DataFrame, of: DataFrame) -> DataFrame:
        a = of.select(F.col("id").alias("a"), F.col("component").alias("ca"))
        b = of.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        return pairs.join(a, "a", "left").join(b, "b", "left").where(
            F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    texts = texts_of(candidates.select(F.col("a").alias("doc_id")).unionAll(candidates.select(F.col("b").alias("doc_id")))
                     .unionAll(dense.select(F.col("id").alias("doc_id"))))
    likeliest = candidates.groupBy("b").agg(F.min(F.struct("d", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    links = store(confirm(likeliest, texts, words, percent), "confirmed")
    components = store(connected_components(links), "components")
    rest = store(apart(candidates.select("a", "b"), components).join(likeliest, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = store(links.unionAll(confirm(rest, texts, words, percent)), "confirmed")
        components = store(connected_components(links), "components")
    if not dense.isEmpty():
        more = store(compare_dense(homes, components, texts, words, percent, block), "dense-links")
        if not more.isEmpty():
            components = store(connected_components(links.unionAll(more)), "components")
    named = classes.select("f1", "f2", "n", "id").join(components, "id", "left").select(
        "f1", "f2", "n", F.coalesce("component", "id").alias("component_id"))
    return sketches.where("n > 0 and doc_id is not null").select("doc_id", "f1", "f2", "n").join(named, ["f1", "f2", "n"]).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id").unionAll(
        sketches.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id"))) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _compare_blocks(words: int, percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].iat[0], rows["j"].iat[0]
        left, right = np.flatnonzero(rows["x"] == i), np.flatnonzero(rows["x"] == j)
        ids = rows["id"].to_numpy()
        sets = [shingle_set(t, words) for t in rows["text"]]
        sizes = np.array([len(x) for x in sets])
        if i != j and (not len(left) or not len(right)):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        # exact intersections: products of the 0/1 columns of shingles that several documents hold
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = np.bincount(column) > 1
        column, row = (np.cumsum(shared) - 1)[column[shared[column]]], row[shared[column]]
        both = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(shared.sum()), 4096):
            here = (column >= at) & (column < at + 4096)
            held = np.zeros((len(sets), 4096), np.float32)
            held[row[here], column[here] - at] = 1
            both += held[left] @ held[right].T
        union = sizes[left][:, None] + sizes[right][None, :] - both
        link = 100 * both.astype(np.int64) >= percent * union.astype(np.int64)
        link &= ids[left][:, None] != ids[right][None, :]
        a, b = np.nonzero(link)
        a, b = left[a], right[b]
        root = np.arange(len(ids))
        while len(a):  # the least row over links, until none moves: one link per document leaves the task
            least = root.copy()
            np.minimum.at(least, a, root[b])
            np.minimum.at(least, b, root[a])
            least = least[least]
            if (least == root).all():
                break
            root = least
        moved = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[root[moved]], "b": ids[moved]}).astype("int64")
    return run


def compare_dense(homes: DataFrame, components: DataFrame, texts: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """Links (a, b) that connect whatever is linked inside the nodes of `homes` that hold several components."""
    rows = homes.select("key", "id").join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_keys = rows.groupBy("key").agg(F.count("*").alias("held"), F.min("component").alias("lo"),
                                        F.max("component").alias("hi")).where("lo <> hi")
    blocks = F.ceil(F.col("held") / block).cast("int")
    spread = rows.join(open_keys, "key").withColumn("x", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn(
        "y", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "key", "id", "x", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    return spread.join(texts, "id").groupBy("key", "i", "j").applyInPandas(
        _compare_blocks(words, percent), "a long, b long").distinct()


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80, **options) -> DataFrame:
    """`docs` with one row of each component: that with the smallest doc_id (of equal ones, the least text).

    Rows with a null doc_id belong to no component and stay.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    keep = near_duplicates(docs, words, percent, **options).where("kept and doc_id is not null").select(
        F.col("doc_id").alias("_keep")).distinct()
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"),
                       F.col(id_col).cast("long").alias("_id"))
    first = F.row_number().over(Window.partitionBy("_id").orderBy("_text"))
    kept = held.where("_id is not null").join(keep, F.col("_id") == F.col("_keep"), "left_semi").withColumn("_n", first)
    return kept.where("_n = 1").select("_row.*").unionAll(held.where("_id is null").select("_row.*"))
