"""The list of near pairs: every pair of files is met once, scored where it is met, and never shuffled.

Files with the same names form a name class; a class is cut into chunks of ``CHUNK`` files in order of their code
lines. A chunk stands under the name tokens of its prefix (as in ``duplicates``) with all that a comparison
needs: name ids, the span of code lines, and the files. So the equi-join on tokens gives whole pairs of chunks, and what is
shuffled grows with files times prefix tokens, whatever the number of pairs.

* Each pair of chunks is met once. The first common name of two sets, in the global order (document frequency, name),
  lies in both prefixes: at most ``|A| - |A and B|`` names of A come before it. Only the join row of that name
  counts, so nothing has to be made distinct. Pairs with class Jaccard ``>= c*`` belong to the class names, all
  others to the function names.
* Most rows of the join share one name and no more. Each set has a word of 64 bits, one for each id modulo 64; the common
  bits bound the common names, and with the spans of code lines the similarity, before any set is read.
* A name of more than ``HOT`` chunks is dealt over several tasks: the left rows by their first path, the right rows to each.
* The pairs of files of two chunks come out in two nested loops of the stage that writes them.

For thresholds above the line weight, where a pair must share a name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..session import unbounded
from .ranks import ranked

EPS = 1e-9
CHUNK = 256
HOT = 4096
CLASS = ["repo_id", "language", "cls"]

Keep = Callable[[DataFrame, str], DataFrame]


def same(df: DataFrame, name: str) -> DataFrame:
    return df


def _chunks(items: DataFrame, chunk: int) -> DataFrame:
    """(repo_id, language, cls, id, lo, hi, fnames, cnames, items and lang_order if given): at most ``chunk`` files of a
    class, lines ascending."""
    named = items.where((F.size("fnames") > 0) | (F.size("cnames") > 0)).withColumns(
        {"cls": F.md5(F.to_json(F.struct(F.array_sort("fnames").alias("f"), F.array_sort("cnames").alias("c")))),
         "l": F.col("code_lines").cast("bigint")})
    place = F.row_number().over(Window.partitionBy(*CLASS).orderBy("l", "path"))
    own = ["l", "path", *[c for c in ("n", "twin") if c in items.columns]]
    order = [F.first("lang_order").alias("lang_order")] if "lang_order" in items.columns else []
    return named.withColumn("chunk", F.floor((place - 1) / chunk)).groupBy(*CLASS, "chunk").agg(
        F.min("path").alias("id"), F.min("l").alias("lo"), F.max("l").alias("hi"), F.first("fnames").alias("fnames"),
        F.first("cnames").alias("cnames"), F.collect_list(F.struct(*own)).alias("items"), *order).drop("chunk")


def _mask(ids: Column) -> Column:
    return F.aggregate(ids, F.lit(0).cast("bigint"),
                       lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (x % 64).cast("int"))))


def _with_ids(chunks: DataFrame, hot: int) -> DataFrame:
    """Chunks with the ids of their function and class names (f, c: ascending, in the global order), the tasks that each
    name is dealt to (fs, cs), and the bits of both sets (fm, cm)."""
    classes = chunks.groupBy(*CLASS).agg(F.first("fnames").alias("fnames"), F.first("cnames").alias("cnames"),
                                         F.count(F.lit(1)).alias("n_chunks"))
    # a lambda of two parameters would get the place as the second
    tagged = F.concat(F.transform("fnames", lambda n: F.struct(F.lit(0).alias("kind"), n.alias("name"))),
                      F.transform("cnames", lambda n: F.struct(F.lit(1).alias("kind"), n.alias("name"))))
    tokens = classes.select(*CLASS, "n_chunks", F.explode(tagged).alias("t")).select(*CLASS, "n_chunks", "t.kind", "t.name")
    key = ["repo_id", "language", "kind", "name"]
    known = ranked(tokens.groupBy(*key).agg(F.sum("n_chunks").alias("dfreq")), "repo_id", ["language", "kind", "dfreq", "name"], "id")
    salts = F.ceil(F.col("dfreq") / F.lit(hot)).cast("int")
    sets = (tokens.drop("n_chunks").join(unbounded(known.select(*key, F.col("id").alias("tok"), salts.alias("salts"))), key)
            .groupBy(*CLASS).agg(F.array_sort(F.collect_list(F.struct("kind", "tok", "salts"))).alias("t")))
    sets = sets.select(*CLASS, F.filter("t", lambda t: t["kind"] == 0).alias("ft"), F.filter("t", lambda t: t["kind"] == 1).alias("ct")).select(
        *CLASS, F.col("ft")["tok"].alias("f"), F.col("ft")["salts"].alias("fs"), F.col("ct")["tok"].alias("c"), F.col("ct")["salts"].alias("cs"))
    return chunks.drop("fnames", "cnames").join(unbounded(sets), CLASS).withColumns({"fm": _mask(F.col("f")), "cm": _mask(F.col("c"))})


def _prefix(size: Column, share: float) -> Column:
    """How many names of a set of ``size`` are indexed if ``share`` of them must be common."""
    return size - F.greatest(F.ceil(share * size - F.lit(EPS)), F.lit(0)) + F.lit(1)


def _jaccard(common: Column, a: Column, b: Column) -> Column:
    """Of sets of a and b names (doubles); 0 if one is empty. Never null, or Spark would look for nulls before all else."""
    return F.coalesce(common.cast("double") / F.greatest(a + b - common, F.lit(1.0)), F.lit(0.0))


def near_list(items: DataFrame, threshold: float, class_split: float | None = None, keep: Keep = same,
              chunk: int = CHUNK, hot: int = HOT) -> DataFrame:
    """Pairs of items that reach the threshold: (repo_id, language, one, two, line_sim, func_sim, class_sim, similarity).

    ``items`` has repo_id, language, path, code_lines, fnames, cnames and, if items stand for several files, their number
    n: such an item also pairs with itself. ``one`` and ``two`` are structs of the items with path
    ascending. Two files of the same ``twin``, if the items have one, are left out; ``lang_order``, if they have one, is
    carried along. ``keep`` stores a table that is read several times.
    """
    wl, wf, wc = dims.SIMILARITY_WEIGHTS
    if threshold <= wl:
        raise ValueError("pairs without a common name cannot be met by names")
    c_star = class_split if class_split is not None else min(0.5, (threshold - wl) / (2 * wc))
    t0, t_f = (threshold - wl) / wf, (threshold - wl - wc * c_star) / wf
    held = keep(_with_ids(keep(_chunks(items, chunk), "near_chunks"), hot), "near_sets").withColumns(
        {"kf": F.size("f").cast("double"), "kc": F.size("c").cast("double"),
         "fm_more": F.size("f") - F.bit_count("fm"), "cm_more": F.size("c") - F.bit_count("cm")})
    by_f = F.transform(F.arrays_zip("f", "fs"), lambda t, i: F.struct(
        t["f"].alias("tok"), t["fs"].alias("salts"), (i + 1).alias("pos"), F.lit(False).alias("by_class")))
    by_c = F.transform(F.arrays_zip("c", "cs"), lambda t, i: F.struct(
        t["c"].alias("tok"), t["cs"].alias("salts"), (i + 1).alias("pos"), F.lit(True).alias("by_class")))

    def side(share: Callable[[float], float], name: str, salt: Column) -> DataFrame:
        # tight: the name is also in the prefix of pairs of which one side has no classes
        put = held.select("*", F.explode(F.concat(by_f, by_c)).alias("t")).select(
            *[c for c in held.columns if c not in ("fs", "cs", "cls")], "t.*")
        tight = F.col("pos") <= _prefix(F.col("kf"), share(t0))
        put = put.withColumn("tight", tight).where(
            F.when(F.col("by_class"), F.col("pos") <= _prefix(F.col("kc"), share(c_star)))
            .otherwise(tight | ((F.col("kc") > 0) & (F.col("pos") <= _prefix(F.col("kf"), share(t_f))))))
        put = put.withColumn("salt", salt).drop("salts", "pos")
        return put.select("repo_id", "language", "tok", "salt", *[
            F.col(c).alias(f"{c}_{name}") for c in put.columns if c not in ("repo_id", "language", "tok", "salt")])

    a = side(lambda t: 2.0 * t / (1.0 + t), "a", F.pmod(F.hash("id"), F.col("salts")))
    b = side(lambda t: t, "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("language", "lang_order_b")
    col = F.col

    def bound(mask: str, size: str) -> Column:
        # names of one side that share a bit are no more common than these
        size_a, size_b, mask_a, mask_b = (col(f"{x}_{s}") for x in (size, mask) for s in "ab")
        return _jaccard(F.least(F.bit_count(mask_a.bitwiseAND(mask_b)) + col(f"{mask}_more_a"), size_a, size_b), size_a, size_b)

    def smaller(size: str, t: float) -> Column:
        one, two = col(f"{size}_a"), col(f"{size}_b")
        return (one >= t * two - F.lit(EPS)) & ((one < two) | ((one == two) & (col("id_a") <= col("id_b"))))

    line = F.when(col("hi_a") < col("lo_b"), col("hi_a") / col("lo_b")).when(
        col("hi_b") < col("lo_a"), col("hi_b") / col("lo_a")).otherwise(F.lit(1.0))
    both = (col("kc_a") > 0) & (col("kc_b") > 0)
    meets = F.when(col("by_class_a"), smaller("kc", c_star)).otherwise(
        F.when(both, smaller("kf", t_f)).otherwise(col("tight_a") & col("tight_b") & smaller("kf", t0)))
    may = F.coalesce(line, F.lit(1.0)) * F.lit(wl) + bound("fm", "kf") * F.lit(wf) + bound("cm", "kc") * F.lit(wc) >= F.lit(threshold - EPS)
    met = unbounded(a).join(unbounded(b), ["repo_id", "tok", "salt"]).where(F.when(meets, may).otherwise(False))
    # common names are found once, for what is left: Spark pushes no filter below the row that holds them
    met = met.withColumn("common", F.explode(F.array(F.struct(
        F.array_intersect("f_a", "f_b").alias("f"), F.array_intersect("c_a", "c_b").alias("c")))))
    order = [col("lang_order_a").alias("lang_order")] if "lang_order" in items.columns else []
    pairs = met.select(
        "repo_id", "language", *order, "tok", "by_class_a", "items_a", "items_b", (col("id_a") == col("id_b")).alias("own"),
        F.when(col("by_class_a"), col("common.c")).otherwise(col("common.f")).alias("shared"),
        _jaccard(F.size("common.f"), col("kf_a"), col("kf_b")).alias("func_sim"),
        _jaccard(F.size("common.c"), col("kc_a"), col("kc_b")).alias("class_sim"))
    # the first common name stands for the pair, and only the kind of names that the pair belongs to
    pairs = pairs.where((F.get("shared", F.lit(0)) == col("tok")) & ((col("class_sim") >= F.lit(c_star)) == col("by_class_a")))
    pairs = pairs.withColumn("x", F.explode("items_a")).withColumn("y", F.explode("items_b"))
    x, y = col("x"), col("y")
    itself = (x["path"] == y["path"]) & (x["n"] > 1) if "n" in items.columns else F.lit(False)
    # a chunk meets itself: each of its pairs once
    pairs = pairs.where(~col("own") | (x["path"] < y["path"]) | itself)
    if "twin" in items.columns:
        pairs = pairs.where(~F.coalesce(x["twin"] == y["twin"], F.lit(False)))
    lo, hi = F.least(x["l"], y["l"]), F.greatest(x["l"], y["l"])
    scored = pairs.withColumn("line_sim", F.coalesce(lo.cast("double") / hi.cast("double"), F.lit(0.0)))
    sim = col("line_sim") * F.lit(wl) + col("func_sim") * F.lit(wf) + col("class_sim") * F.lit(wc)
    scored = scored.withColumn("similarity", sim).where(col("similarity") >= F.lit(threshold))
    ahead = x["path"] <= y["path"]
    return scored.select("repo_id", "language", F.when(ahead, x).otherwise(y).alias("one"), F.when(ahead, y).otherwise(x).alias("two"),
                         "line_sim", "func_sim", "class_sim", "similarity", *[c for c in ("lang_order",) if order])
