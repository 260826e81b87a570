"""Histogram sort: documents in contiguous shards of near-equal bytes, with one exchange.

Law `bytes`. Rows are ordered by (h, doc_id, uid): h is a 62-bit hash of the text, so equal texts are
neighbours; uid tells repeated rows apart. Splitters are found without sorting: count the exact bytes
of a few thousand evenly spaced candidate cells of h in every partition, keep the cells that hold a
target, and refine only those, until a cell edge lies within the tolerance of its target or the
cell is a single text. Only the cell of each target reaches the driver: running sums are taken where the counts are. The splitter then goes to the nearer edge of that text, so its copies stay together, if they
hold at most half a shard's bytes; a larger group of copies is refined the same way by doc_id, then by uid, so it
is cut between rows and never forces one shard to hold it. What
reaches the driver is one row per pass and open splitter.

After that each row knows its shard by comparing its key with the splitters, and rows move once.
Every shard is divided into `parts` finer ranges by the same splitters, more of them the more rows there are, so
the numbering of slots is also balanced however few shards there are.

Input rules: a null text has size 16 and crc32 0 of no bytes, nulls form one group; null doc_ids sort
first; equal rows are kept apart by uid; an empty table gives an empty result; other columns of the
input never clash, as only the two named ones are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

KEY = ("h", "d", "uid")
H_BITS = 62
_TYPE = {"h": "long", "d": "decimal(20,0)", "uid": "long"}


def _typed(name: str, value: int):
    return Decimal(value) if name == "d" else value


def sort_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow key table: doc_id, size, text_crc32, h, d, uid. No text leaves its task."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.shiftrightunsigned(F.xxhash64(text), 64 - H_BITS), F.lit(0)).alias("h"),
        F.coalesce(F.col(id_col).cast("decimal(20,0)"), F.lit(str(-(2 ** 63) - 1)).cast("decimal(20,0)")).alias("d"),
        F.monotonically_increasing_id().alias("uid"))


def _histogram(rows: DataFrame, col: str, open_cells: Sequence[tuple], cells: int, aims: Sequence[list[tuple]]) -> dict:
    """From the exact bytes of `cells` sub-cells of each open cell (group, low, high), for each target the sub-cell in which
    it falls, else the last that has rows: one job.

    group is the (h, d) prefix that the rows must equal in the columns before `col`; `aims` holds (target, bytes below the
    cell, bytes wanted) for each open cell. Gives {target: (bytes below the sub-cell, its bytes, its edges, least and
    greatest value)}; targets of a cell without rows are missing.
    """
    spark = rows.sparkSession
    before = KEY[:KEY.index(col)]
    value = F.col(col).cast("decimal(20,0)")
    if before:
        # few groups, at most one for each open splitter
        schema = "cell int, " + "".join(f"{c} {_TYPE[c]}, " for c in before) + \
            "low decimal(20,0), high decimal(20,0), step decimal(20,0)"
        asked = spark.createDataFrame(
            [(i, *[_typed(c, v) for c, v in zip(KEY, group)], Decimal(low), Decimal(high),
              Decimal(max(1, -(-(high - low + 1) // cells)))) for i, (group, low, high) in enumerate(open_cells)], schema)
        picked = rows.join(F.broadcast(asked), list(before)).where(value.between(F.col("low"), F.col("high")))
        sub = F.floor((value - F.col("low")) / F.col("step")).cast("long")
        picked = picked.select("cell", sub.alias("sub"), value.alias("v"), "size")
    elif len(open_cells) == 1:
        (_, low, high), = open_cells
        step = max(1, -(-(high - low + 1) // cells))
        # all in cell 0; a literal would turn the join with the targets into a nested loop
        picked = rows.where(F.col(col).between(low, high)).select((F.col(col) < low).cast("int").alias("cell"), F.expr(f"({col} - {low}L) div {step}L").alias("sub"),
                             value.alias("v"), "size")
    else:
        # open cells are disjoint and equally wide, so the quotient names the cell
        wide = open_cells[0][2] - open_cells[0][1] + 1
        step = max(1, -(-wide // cells))
        index = spark.createDataFrame([(int(low // wide), i) for i, (_, low, _) in enumerate(open_cells)],
                                      "wide long, cell int")
        picked = rows.withColumn("wide", F.expr(f"{col} div {wide}L")).join(F.broadcast(index), "wide").select(
            "cell", F.expr(f"({col} - wide * {wide}L) div {step}L").alias("sub"), value.alias("v"), "size")
    found = picked.groupBy("cell", "sub").agg(F.sum("size").alias("bytes"), F.min("v").alias("low"),
                                              F.max("v").alias("high"))
    w = Window.partitionBy("cell").orderBy("sub")
    run = found.withColumns({"upto": F.sum("bytes").over(w), "last": F.lead("sub").over(w).isNull()})
    wanted = spark.createDataFrame([(k, i, below, float(aim)) for k, of in enumerate(aims) for i, below, aim in of],
                                   "cell int, target int, below long, aim double")
    end = F.col("below") + F.col("upto")
    hit = run.join(F.broadcast(wanted), "cell").where((end >= F.col("aim")) | F.col("last")).groupBy("target").agg(
        F.min(F.struct("sub", "cell", (end - F.col("bytes")).alias("at"), "bytes", "low", "high")).alias("hit"))
    out: dict = {}
    for target, r in hit.collect():
        group, low, high = open_cells[r["cell"]]
        step = max(1, -(-(high - low + 1) // cells))
        out[target] = (int(r["at"]), int(r["bytes"]), low + r["sub"] * step, low + (r["sub"] + 1) * step - 1,
                       int(r["low"]), int(r["high"]))
    return out


def find_splitters(rows: DataFrame, targets: Sequence[float], tolerance: float, cells: int = 4096,
                   whole: float = 0.0) -> list[tuple]:
    """One key (h, d, uid) for each target: the bytes of all rows below it are near the target. Equal texts of
    at most `whole` bytes in all are not cut.

    A splitter is (h, d or None, uid or None); None stands for the smallest value.
    """
    splitters: dict[int, tuple] = {}
    # (prefix, low, high) -> [(target index, bytes below the cell)]
    todo = {((), 0, 2 ** H_BITS - 1): [(i, 0) for i in range(len(targets))]}
    col = "h"
    later: dict = {}
    while todo:
        asked = list(todo)
        sub = max(2, cells if len(asked) == 1 else min(cells, 1 << max(4, (cells * 16 // len(asked)).bit_length() - 1)))
        found = _histogram(rows, col, asked, sub, [[(i, below, targets[i]) for i, below in todo[cell]] for cell in asked])
        following: dict = {}
        for cell in asked:
            for i, _ in todo[cell]:
                if i not in found:
                    splitters[i] = (*cell[0], cell[1])
                    continue
                at, size, low, high, least, most = found[i]
                left, right = abs(targets[i] - at), abs(at + size - targets[i])
                uncut = least == most and (col == "uid" or (col == "h" and size <= whole))
                if min(left, right) <= tolerance or uncut:
                    splitters[i] = (*cell[0], least if left <= right else most + 1)
                elif least == most:
                    later.setdefault(((*cell[0], least), None, None), []).append((i, at))
                else:
                    following.setdefault((cell[0], low, high), []).append((i, at))
        if following:
            if col == "h" and len({hi - lo for _, lo, hi in following}) > 1:
                raise AssertionError("cells of one pass are equally wide")
            todo = following
            continue
        todo = {}
        if later:
            col = KEY[KEY.index(col) + 1]
            groups = [g for g, _, _ in later]
            before = KEY[:KEY.index(col)]
            spark = rows.sparkSession
            keys = spark.createDataFrame([[_typed(c, v) for c, v in zip(KEY, g)] for g in groups],
                                         ", ".join(f"{c} {_TYPE[c]}" for c in before))
            spans = rows.join(F.broadcast(keys), list(before)).groupBy(*before).agg(
                F.min(col).alias("lo"), F.max(col).alias("hi")).collect()
            span = {tuple(int(r[c]) for c in before): (int(r["lo"]), int(r["hi"])) for r in spans}
            todo = {(g, *span[g]): later[(g, None, None)] for g in groups}
            later = {}
    return [splitters[i] + (None,) * (3 - len(splitters[i])) for i in range(len(targets))]


def _at_least(splitter: tuple) -> Column:
    """Whether a row's key is not below a splitter."""
    test = None
    for name, value in reversed(list(zip(KEY, splitter))):
        if value is None:
            continue
        bound = F.lit(str(value)).cast(_TYPE[name])
        test = F.col(name) >= bound if test is None else (F.col(name) > bound) | ((F.col(name) == bound) & test)
    return test


def range_index(splitters: Sequence[tuple]) -> Column:
    """Number of splitters not above the row's key: a balanced tree of comparisons."""
    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(_at_least(splitters[mid]), tree(mid + 1, high)).otherwise(tree(low, mid))

    return tree(0, len(splitters))


def shard_documents(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
                    tolerance: float = 0.01, parts: int | None = None, whole: float = 0.5) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row; shards hold near-equal bytes.

    A shard's bytes differ from the mean by at most `tolerance` of it, or else by half the bytes of the one
    text that lies across an edge. Texts that are equal share a shard, unless they hold more than the share `whole` of
    a shard's bytes and an edge falls among them. `parts` (default: by the rows) are the ranges of a shard that are
    numbered apart. slot counts from 0 without gaps in the order (h, doc_id).
    """
    rows = store(sort_keys(docs, id_col, text_col), "shard-keys")
    total, count = rows.agg(F.sum("size"), F.count("size")).first()
    parts = parts or max(4, min(32, -(-count // (n_shards * 500_000))))
    fine = n_shards * parts
    if total:
        targets = [total * i / fine for i in range(1, fine)]
        splitters = find_splitters(rows, targets, tolerance * total / n_shards / (2 * parts),
                                   whole=whole * total / n_shards)
        splitters.sort(key=lambda s: tuple((v is not None, v or 0) for v in s))
    else:
        splitters = [(0, None, None)] * (fine - 1)
    placed = rows.withColumn("part", range_index(splitters))
    counts = dict(placed.groupBy("part").count().collect())  # one number for each of n_shards * parts ranges
    base, at = [], 0
    for part in range(fine):
        at = 0 if part % parts == 0 else at
        base.append(at)
        at += counts.get(part, 0)
    row = F.row_number().over(Window.partitionBy("part").orderBy(*KEY))
    return placed.withColumn("row", row).select(
        "doc_id", "size", "text_crc32", (F.col("part") / parts).cast("int").alias("shard"),
        (F.element_at(F.array(*[F.lit(int(b)).cast("long") for b in base]), F.col("part") + 1) + F.col("row") - 1).alias("slot"))
