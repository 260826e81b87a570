"""Partners of name classes counted by the names they share, without pairs of classes.

A class with the name sets F and C stands under every key (U, V) of a subset U of F and V of C. The files under a
key hold at least its names, so by inclusion and exclusion over the keys of a class the files that share exactly i
functions and j classes with it are

    sum over (U, V) of (-1)^(|U|-i + |V|-j) * binomial(|U|, i) * binomial(|V|, j) * files under (U, V),

kept apart by the sizes of their own sets and by code lines. Both Jaccard indexes follow from i, j and
the four sizes, and with them the interval of code lines that reaches the threshold. What a key adds to a class
depends on the sizes of that class and on its code lines only, so it is computed once per key, sizes and lines, and
an equi-join brings it back to the classes. The work grows with classes times their keys, however many of
them share names.

Only keys that can still reach the threshold are made: above the line weight those with
``0.5 * |U|/|F| + 0.2 * |V|/|C| >= threshold - 0.3``. A class of more than ``MOST_NAMES`` names would have too many; it
is left to the pairs of ``near_classes``, whose prefixes are selective for large sets. At thresholds that code lines alone can reach, i = j = 0
stands for the partners by lines alone, so the sum is what pairs with a common name have beyond those.

Keys are sums of 128-bit digests of the names, repository and language included.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..session import unbounded

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEIGHTS = dims.SIMILARITY_WEIGHTS
EPS = 1e-9
MOST_NAMES = 12  # up to 4095 keys a class
ROWS = 1 << 18  # rows that a task works on at once


def key_sizes(a: int, c: int, threshold: float) -> list[tuple[int, int]]:
    """Sizes (u, v) of the keys that a class of a functions and c classes needs."""
    wl, wf, wc = WEIGHTS
    reach = lambda u, v: wf * u / max(a, 1) + wc * v / max(c, 1) >= threshold - wl - EPS
    return [(u, v) for u in range(a + 1) for v in range(c + 1) if (u or v) and (threshold <= wl or reach(u, v))]


def _subsets(a: int, c: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(masks [keys, a + c], packed sizes [keys]) of the keys of a class."""
    masks, met = [], []
    for u, v in key_sizes(a, c, threshold):
        for one in combinations(range(a), u):
            for two in combinations(range(a, a + c), v):
                row = np.zeros(a + c, dtype=np.int64)
                row[list(one + two)] = 1
                masks.append(row)
                met.append(u << 31 | v)
    return np.array(masks, dtype=np.int64).reshape(len(met), a + c), np.array(met, dtype=np.int64)


def _digest(text: str) -> np.ndarray:
    return np.frombuffer(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest(), dtype="<i8")


def _keys(threshold: float):
    """Task function: classes (id1, id2, repo_id, language, fnames, cnames, lines, files) -> one row per key and code lines."""
    names = ["id1", "id2", "own", "k1", "k2", "met", "l", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            shapes: dict[tuple[int, int], list] = {}
            seen: dict[str, np.ndarray] = {}
            for id1, id2, repo, language, fs, cs, lines, files in zip(*(col.to_pylist() for col in batch.columns)):
                words = ["f" + f for f in fs] + ["c" + c for c in cs]
                for w in words:
                    if w not in seen:
                        seen[w] = _digest(w)
                start = _digest(f"{len(repo)}:{repo}{language}")
                shapes.setdefault((len(fs), len(cs)), []).append((id1, id2, start, [seen[w] for w in words], lines, files))
            for (a, c), held in shapes.items():
                if (a, c) not in made:
                    made[a, c] = _subsets(a, c, threshold)
                masks, met = made[a, c]
                if not len(met):
                    continue
                at = 0
                while at < len(held):
                    some, rows = [], 0
                    while at < len(held) and (not some or rows + len(held[at][4]) * len(met) <= ROWS):
                        some.append(held[at])
                        rows += len(held[at][4]) * len(met)
                        at += 1
                    starts = np.array([h[2] for h in some])
                    words = np.array([h[3] for h in some]).reshape(len(some), a + c, 2)
                    keys = starts[:, None, :] + np.matmul(masks, words)  # sums wrap around
                    of = np.repeat(np.arange(len(some)), [len(h[4]) for h in some])
                    flat = keys[of].reshape(-1, 2)
                    spread = lambda x: np.repeat(np.asarray(x, dtype=np.int64), len(met))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                        spread([some[i][0] for i in of]), spread([some[i][1] for i in of]),
                        np.full(len(flat), a << 31 | c, dtype=np.int64), flat[:, 0], flat[:, 1], np.tile(met, len(of)),
                        spread([x for h in some for x in h[4]]), spread([x for h in some for x in h[5]]))], names)

    return run


def line_interval(lines: np.ndarray, func: np.ndarray, cls: np.ndarray, threshold: float, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewest and most code lines, up to ``top``, of a partner, where equal code lines reach the threshold."""
    wl, wf, wc = WEIGHTS
    need = (threshold - (func * wf + cls * wc)) / wl
    low = np.ceil(np.clip(need, 0.0, 1.0) * lines).astype(np.int64)
    high = np.minimum(np.floor(lines / np.maximum(need, 1e-12)), top).astype(np.int64)
    high = np.maximum(high, lines)
    # the estimate may be one off: the similarity itself decides, in the arithmetic of the listing
    short = lambda x: (x / lines * wl + func * wf + cls * wc) >= threshold
    long_ = lambda x: (lines / x * wl + func * wf + cls * wc) >= threshold
    low = np.where((low > 0) & short(low - 1), low - 1, np.where(short(low), low, low + 1))
    high = np.where(long_(high + 1), high + 1, np.where(long_(high), high, high - 1))
    return low, np.minimum(high, top)


def _ratio(shared: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.where((one == 0) | (two == 0), 0.0, shared / np.maximum(one + two - shared, 1))


def key_shares(key: np.ndarray, met: np.ndarray, own: np.ndarray, lines: np.ndarray, files: np.ndarray,
               threshold: float) -> np.ndarray:
    """What each row's key adds to the partners of a file of the row's sizes and code lines.

    Rows are sorted by (key, own, lines); ``key`` numbers the keys from 0.
    """
    wl, wf, wc = WEIGHTS
    added = np.zeros(len(key), dtype=np.int64)
    cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
    size = np.diff(np.r_[cut, len(key)])
    group = np.repeat(np.arange(len(cut)), size)
    top = int(lines.max())
    width = top + 2
    code = group * width + lines
    sums = np.r_[0, np.cumsum(files)]
    # pairs of groups of a key
    first = np.flatnonzero(np.r_[True, key[cut][1:] != key[cut][:-1]])
    of_key = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(cut)]))
    many = np.diff(np.r_[first, len(cut)])[of_key]
    one = np.repeat(np.arange(len(cut)), many)
    two = np.arange(len(one)) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many) + first[of_key][one]
    a, c = own[cut] >> 31, own[cut] & (1 << 31) - 1
    kind = met[cut][one]
    for uv in np.unique(kind):
        u, v = int(uv) >> 31, int(uv) & (1 << 31) - 1
        x, y = one[kind == uv], two[kind == uv]
        for i in range(u + 1):
            for j in range(v + 1):
                func, cls = _ratio(i, a[x], a[y]), _ratio(j, c[x], c[y])
                reach = np.flatnonzero(1.0 * wl + func * wf + cls * wc >= threshold)
                sign = (-1) ** (u - i + v - j) * comb(u, i) * comb(v, j)
                rows = np.cumsum(size[x[reach]])
                for part in np.split(reach, np.searchsorted(rows, np.arange(ROWS, rows[-1], ROWS)) if len(rows) else []):
                    if not len(part):
                        continue
                    n = size[x[part]]
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - cut[x[part]], n)
                    low, high = line_interval(lines[at], np.repeat(func[part], n), np.repeat(cls[part], n), threshold, top)
                    base = np.repeat(y[part], n) * width
                    found = sums[np.searchsorted(code, base + high, "right")] - sums[np.searchsorted(code, base + low, "left")]
                    np.add.at(added, at, sign * found)
    return added


def _shares(threshold: float):
    """Task function: rows (k1, k2, met, own, l, n) sorted by key, own and l -> (k1, k2, own, l, share)."""
    names = ["k1", "k2", "own", "l", "share"]

    def counted(rows: list[np.ndarray]) -> pa.RecordBatch:
        k1, k2, met, own, lines, files = rows
        key = np.cumsum(np.r_[False, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        share = key_shares(key, met, own, lines, files, threshold)
        keep = share != 0
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (k1, k2, own, lines, share)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            held.append([col.to_numpy(zero_copy_only=False) for col in batch.columns])
            n += batch.num_rows
            if n >= ROWS // 4:
                rows = [np.concatenate(x) for x in zip(*held)]
                # the last key may go on in the next batch
                end = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[-1]) + 1 if (
                    (rows[0][0], rows[1][0]) != (rows[0][-1], rows[1][-1])) else 0
                if end:
                    yield counted([x[:end] for x in rows])
                held = [[x[end:] for x in rows]]
                n -= end
        if n:
            yield counted([np.concatenate(x) for x in zip(*held)])

    return run


def is_large(most: int = MOST_NAMES) -> Column:
    return F.size("fnames") + F.size("cnames") > most


def shared_links(classes: DataFrame, threshold: float, most: int = MOST_NAMES) -> DataFrame:
    """(repo_id, language, cls, code_lines, n_links): partners among the classes that are not large; at thresholds
    that code lines alone can reach, those that a common name adds."""
    part = lambda at: F.conv(F.substring(F.col("id"), at, 16), 16, -10).cast("bigint")
    key = ["repo_id", "language", "cls"]
    named = (F.size("fnames") + F.size("cnames") > 0) & F.col("repo_id").isNotNull() & F.col("language").isNotNull()
    small = classes.where(named & ~is_large(most)).withColumn("id", F.md5(F.to_json(F.struct(*key)))).withColumns(
        {"id1": part(1), "id2": part(17)})
    rows = small.select("id1", "id2", "repo_id", "language", "fnames", "cnames", "lines", "files").mapInArrow(
        _keys(threshold), "id1 long, id2 long, own long, k1 long, k2 long, met long, l long, n long")
    cells = rows.groupBy("k1", "k2", "met", "own", "l").agg(F.sum("n").alias("n"))
    shares = cells.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "own", "l").select(
        "k1", "k2", "met", "own", "l", "n").mapInArrow(_shares(threshold), "k1 long, k2 long, own long, l long, share long")
    found = rows.select("id1", "id2", "own", "k1", "k2", "l").join(unbounded(shares), ["k1", "k2", "own", "l"]).groupBy(
        "id1", "id2", "l").agg(F.sum("share").alias("n"))
    links = found.join(unbounded(small.select(*key, "fnames", "cnames", "id1", "id2")), ["id1", "id2"])
    wl, wf, wc = WEIGHTS
    alike = (F.lit(1.0) * F.lit(wl) + F.when(F.size("fnames") > 0, 1.0).otherwise(0.0) * F.lit(wf)
             + F.when(F.size("cnames") > 0, 1.0).otherwise(0.0) * F.lit(wc))
    # a file is no partner of itself; by lines alone it is left out elsewhere
    itself = F.when(alike >= F.lit(threshold), 1).otherwise(0) if threshold > wl else F.lit(0)
    return links.select(*key, F.col("l").alias("code_lines"), (F.col("n") - itself).alias("n_links")).where("n_links != 0")
