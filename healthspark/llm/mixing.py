"""Mixing sources to target weights by entropy balancing.

Every source has a token target. Document rates r minimise the Kullback-Leibler divergence from rate 1
under `sum(r * size) = target` and `r <= cap`. Its dual is convex with one multiplier per source, and
r = min(cap, exp(lambda * size / mean size)): an exponential tilt. Newton steps for all sources run as
one aggregation over (source, size, count) cells, safeguarded by a bracket; the state is one row
per source in a table, never on the driver.

Rates become whole copies size by size, from long documents to short ones: the wanted copies of a source's
documents of one size are rounded down or up, whichever brings the source's running total closer to that of the
rates, so what one size over- or undershoots the shorter ones after it repair. These copies are dealt to hash
buckets of such documents in proportion, by the cut points of a running count; inside a bucket copies differ by at
most one and the extra ones go to the smallest hashes. The hash depends on the row alone, so reruns agree.

Scale: documents are read once into a narrow table; a hot source or a hot size is pre-aggregated
before anything is exchanged by source, and split into buckets where rows are ranked. A task rounds the distinct
sizes of a source, which the longest document bounds, whatever the number of documents.

Input rules: a null text has size 0; documents without words get one copy and take nothing; null is a
source of its own, after all others; repeated rows are separate documents; an empty table gives an empty
result; only the named columns are read, further ones may be carried along with `carry`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, store


def source_targets(docs: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(source, sid, total, target): shares of all tokens by weight, no target above cap * total.

    Water filling: sources in the order of cap * total / weight; one stops at its cap exactly if the
    level left for it and all later ones is higher. Windows run over one row per source.
    """
    sources = docs.groupBy("source").agg(F.sum("size").alias("total"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    sources = sources.withColumn("sid", F.row_number().over(by_name)).withColumn("w", w)
    order = Window.orderBy(F.col("total") / F.col("w"), "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    most = F.col("total") * float(cap)
    sources = sources.withColumn("all", F.sum("total").over(everything))
    sources = sources.withColumn("level", (F.col("all") - F.coalesce(F.sum(most).over(before), F.lit(0.0)))
                                 / F.sum("w").over(after)).withColumn("capped", most <= F.col("level") * F.col("w"))
    free = F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)
    rest = F.col("all") - F.coalesce(F.sum(F.when(F.col("capped"), most)).over(everything), F.lit(0.0))
    return sources.withColumn("target", F.when(F.col("capped"), most).otherwise(rest * F.col("w") / free)).select(
        "source", "sid", "total", "target")


def tilt(cells: DataFrame, sources: DataFrame, cap: float, rounds: int = 60, exact: float = 1e-7) -> DataFrame:
    """(sid, total, target, mean, lam): the dual solution, by distributed Newton iterations.

    lam is null where the target is the cap of every document.
    """
    mean = cells.groupBy("sid").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = store(sources.join(mean, "sid").select(
        "sid", "total", "target", "mean",
        F.when(F.col("target") < cap * F.col("total"), F.lit(0.0)).alias("lam"),
        F.when(F.col("target") >= F.col("total"), F.lit(0.0)).alias("lo"),
        F.when(F.col("target") <= F.col("total"), F.lit(0.0)).alias("hi"),
        F.lit(False).alias("done")), "tilt")
    for _ in range(rounds):
        r = rate(cap)
        gain = F.col("n") * F.col("size") * r
        sums = cells.join(state.select("sid", "lam", "mean").where("lam is not null"), "sid").groupBy("sid").agg(
            F.sum(gain).alias("got"),
            F.sum(F.when(F.col("lam") * F.col("size") / F.col("mean") < math.log(cap), gain * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        g = F.col("got") - F.col("target")
        lo = F.when(g <= 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(g >= 0, F.col("lam")).otherwise(F.col("hi"))
        state = state.join(sums, "sid", "left").withColumns(
            {"g": g, "lo": lo, "hi": hi, "step": F.when(F.col("slope") > 0, F.col("lam") - g / F.col("slope"))})
        inside = F.col("step").isNotNull() & (F.col("lo").isNull() | (F.col("step") > F.col("lo"))) & (
            F.col("hi").isNull() | (F.col("step") < F.col("hi")))
        # outside the bracket: halve it, or double the end that is still open
        fallback = F.when(F.col("hi").isNull(), F.col("lo") * 2 + 1).when(F.col("lo").isNull(), F.col("hi") * 2 - 1) \
            .otherwise((F.col("lo") + F.col("hi")) / 2)
        done = F.col("lam").isNull() | (F.abs("g") <= exact * F.col("target"))
        state = store(state.withColumn("done", done).withColumn(
            "lam", F.when(F.col("done") | F.col("lam").isNull(), F.col("lam")).otherwise(
                F.when(inside, F.col("step")).otherwise(fallback))).select(
            "sid", "total", "target", "mean", "lam", "lo", "hi", "done"), "tilt")
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select("sid", "total", "target", "mean", "lam")


def rate(cap: float):
    """min(cap, exp(lambda * size / mean)); cap where lambda is null."""
    power = F.least(F.col("lam") * F.col("size") / F.col("mean"), F.log(F.lit(float(cap))))
    return F.when(F.col("lam").isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(power)))


def _whole_copies(cap: int):
    """Streams cells sorted by (sid, size desc) and gives each a whole number of copies."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sid, due, given = None, 0.0, 0
        for cells in batches:
            copies = []
            for s, size, n, want in zip(cells["sid"], cells["size"], cells["n"], cells["want"]):
                if s != sid:
                    sid, due, given = s, 0.0, 0
                due += want * size
                low = min(cap * n, int(want + 1e-9))
                k = min(cap * n, max(low, min(low + 1, round((due - given) / size)) if want > low else low))
                given += k * size
                copies.append(k)
            yield pd.DataFrame({"sid": cells["sid"], "size": cells["size"], "whole": cells["n"],
                                "dealt": pd.Series(copies, dtype="int64")})
    return run


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", carry: Sequence[str] = (), seed: int = 7,
        bucket_rows: int = 20_000) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (= copies * size), then the `carry` columns.

    `source_size` and `target` are those of the document's source. Sources take the weights in code
    point order, repeating.
    """
    text = F.col(text_col)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    keys = {"_id": F.col(id_col), "_source": F.col(source_col), "_size": size,
            "_u": F.xxhash64(F.col(id_col), F.col(source_col), text, F.lit(seed))}
    narrow = store(docs.select(*[v.alias(k[1:]) for k, v in keys.items()]), "mix-sizes")
    buckets = max(1, -(-narrow.count() // bucket_rows))
    bucket = F.pmod(F.shiftright("u", 20), F.lit(buckets)).cast("int")
    sources = store(source_targets(narrow, weights, cap), "mix-sources")
    cells = store(narrow.withColumn("b", bucket).groupBy("source", "size", "b").agg(F.count("*").alias("n"))
                  .join(sources.select("source", "sid").withColumnRenamed("source", "s2"),
                        F.col("source").eqNullSafe(F.col("s2"))).select("sid", "size", "b", "n"), "mix-cells")
    worded = cells.where("size > 0")
    coarse = store(worded.groupBy("sid", "size").agg(F.sum("n").alias("n")), "mix-coarse")
    state = tilt(coarse, sources, cap)
    whole = store(coarse.join(state, "sid").withColumn("want", F.col("n") * rate(cap))
                  .select("sid", "size", "n", "want").repartition(F.col("sid")).sortWithinPartitions("sid", F.desc("size"))
                  .mapInPandas(_whole_copies(cap), "sid int, size long, whole long, dealt long"), "mix-whole")
    # a size's copies are dealt to its buckets in proportion: cut points of one running count
    before = F.coalesce(F.sum("n").over(Window.partitionBy("sid", "size").orderBy("b").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))

    def cut(x):  # dealt * x / whole, rounded down
        product = F.col("dealt").cast("decimal(38,0)") * x
        return ((product - product % F.col("whole")) / F.col("whole")).cast("long")

    planned = store(worded.withColumn("before", before).join(whole, ["sid", "size"]).select(
        "sid", "size", "b", "n", (cut(F.col("before") + F.col("n")) - cut(F.col("before"))).alias("copies")), "mix-copies")
    rows = narrow if not carry else \
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"),
                    keys["_u"].alias("u"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"))
    rows = rows.withColumn("b", bucket).join(
        sources.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    rank = F.row_number().over(Window.partitionBy("sid", "size", "b").orderBy("u", "id"))
    ranked = rows.withColumn("rank", rank).join(planned.select("sid", "size", "b", "n", "copies").withColumnRenamed(
        "copies", "cell_copies").hint("merge"), ["sid", "size", "b"], "left")
    each = F.floor(F.col("cell_copies") / F.col("n")) + (F.col("rank") <= F.col("cell_copies") % F.col("n")).cast("long")
    ranked = ranked.withColumn("copies", F.coalesce(each, F.lit(1)).cast("long"))
    return ranked.select(F.col("id").alias("doc_id"), "size", F.col("total").alias("source_size"), "target", "copies",
                         (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if carry else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of `docs`, each row as many times as it has copies."""
    names = docs.columns
    return mix(docs, carry=names, **options).where("copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
