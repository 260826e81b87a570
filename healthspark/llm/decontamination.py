"""Benchmark decontamination: a set of normalised test n-grams, scanned over training token windows.

A window is `n` consecutive words of a benchmark item; a shorter item is one window of all its words.
Documents are scanned in place: their words are hashed once, window hashes of every position follow by
doubling (width 1, 2, 4, 8, then the sum of powers), and each position becomes a row of one hash, which meets the
set of the benchmark's window hashes. Texts, not rows, are what matches, so hits are kept by a digest of
the text; only texts with a hit are read again, to compare the words themselves.

The set is a table of 8-byte hashes. It is broadcast while it has at most `max_broadcast` of them (the count is
taken first, and bounds its size); a larger benchmark's set meets the positions in a shuffle join that Spark can
split where skewed. Both ways give the same verified positions.

Input rules: words are runs of letters, digits and everything beyond ASCII, after lower-casing A-Z; null or empty texts have no words, neither
match nor are matched; repeated document rows are separate rows; repeated item ids are pooled; an
empty benchmark marks nothing; documents of any length are scanned whole; columns other than the named
ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, store

#: What stands between words, in lower-cased text and in any: all of ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_ANY = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Parts that the rows of one text are dealt to where texts are joined, so that no text's copies meet in one task.
SALT = 32


def words(text: Column) -> Column:
    # cutting at what is between is ten times faster than finding the words
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN_ANY, -1), "")).cast("long")


def benchmark_windows(benchmark: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, width, item_id): distinct; `window` is the words joined by blanks."""
    held = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    width = F.least(F.size("w"), F.lit(n))
    return held.select("item_id", width.alias("width"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - width + 1),
        lambda i: F.array_join(F.slice(F.col("w"), i, width), " "))).alias("window")).distinct()


def _mix(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def window_hash_columns(docs: DataFrame, widths: list[int]) -> DataFrame:
    """Adds one array column h<width> for every width: the hash of the words from each position on.

    Hash columns are built one on the other in separate projections, so each is computed once.
    Positions without enough words hold hashes of fewer words and are cut by the caller.
    """
    def shifted(name: str, by: int) -> Column:
        return F.slice(F.col(name), F.lit(by + 1), F.greatest(F.size(name), F.lit(1)))

    have = {1}
    docs = docs.withColumn("h1", F.transform("w", lambda x: F.xxhash64(x)))
    top = max(widths)
    power = 1
    while power * 2 <= top:
        docs = docs.withColumn(f"h{power * 2}", F.zip_with(F.col(f"h{power}"), shifted(f"h{power}", power), _mix))
        power *= 2
        have.add(power)
    for width in sorted(widths):
        at, name = 0, None
        for bit in sorted((p for p in have if p & (p - 1) == 0 and p & width), reverse=True):
            if name is None:
                at, name = bit, f"h{bit}"
                continue
            grown = f"h{at + bit}"
            if at + bit not in have:
                docs = docs.withColumn(grown, F.zip_with(F.col(name), shifted(f"h{bit}", at), _mix))
                have.add(at + bit)
            at, name = at + bit, grown
    return docs


def text_key(text: Column) -> Column:
    """What hits are kept by: rows of equal texts share them."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _met(rows: DataFrame, found: DataFrame, how: str, entries: Column, most: int = 500_000) -> DataFrame:
    """Rows joined to what is known of their text: `found`, a written table with one row per key.

    It is broadcast while its rows and their list `entries` are at most `most`; else copies of a text are dealt to parts.
    """
    if (found.agg(F.sum(entries + 1)).first()[0] or 0) <= most:
        return rows.join(F.broadcast(found), "key", how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALT)).cast("int"))
    every = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(every.hint("merge"), ["key", "_salt"], how).drop("_salt")


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text",
              max_broadcast: int = 10_000_000) -> DataFrame:
    """(key, hits array<struct<pos, width, window>>), pos from 0 and ascending: one row per distinct text with a hit."""
    windows = store(benchmark_windows(benchmark, n), "windows").select("width", "window").distinct()
    widths = sorted(r[0] for r in windows.select("width").distinct().collect())  # n at most
    text = F.col(f"`{text_col}`")
    if not widths:
        return docs.select(text_key(text).alias("key"), F.array().cast("array<struct<pos:int,width:int,window:string>>").alias("hits")).limit(0)
    hashed = window_hash_columns(windows.withColumn("w", F.split("window", " ")), widths)
    keys = store(hashed.select("width", F.coalesce(
        *[F.when(F.col("width") == v, F.element_at(f"h{v}", 1)) for v in widths]).alias("h")).distinct(), "window-hashes")
    if keys.count() <= max_broadcast:
        keys = F.broadcast(keys)
    base = docs.select(text_key(text).alias("key"), words(text).alias("w"))
    scan = window_hash_columns(base, widths)
    names = [f"h{v}" for v in widths]
    at = scan.select("key", F.size("w").alias("size"), F.posexplode(F.arrays_zip(*names)).alias("pos", "z"))
    each = at.select("key", "size", "pos", F.explode(F.array(*[
        F.struct(F.lit(v).alias("width"), F.col(f"z.h{v}").alias("h")) for v in widths])).alias("k"))
    met = each.where(F.col("pos") + F.col("k.width") <= F.col("size")).select("key", "pos", "k.width", "k.h").join(
        keys, ["width", "h"]).select("key", "pos", "width")
    places = store(met.distinct().groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "width"))).alias("places")), "places")
    # the second test compares the words themselves, at the few positions that the first lets through
    again = _met(docs.select(text_key(text).alias("key"), text.alias("_text")), places, "inner", F.size("places")).dropDuplicates(["key"])
    each = again.select("key", "places", words(F.col("_text")).alias("w")).select("key", F.explode(F.transform("places", lambda p: F.struct(
        p["pos"].alias("pos"), p["width"].alias("width"),
        F.array_join(F.slice(F.col("w"), p["pos"] + 1, p["width"]), " ").alias("window")))).alias("hit"))
    sure = each.select("key", "hit.*").join(windows, ["width", "window"])
    return store(sure.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "width", "window"))).alias("hits")), "hits")


def covered_words(hits: Column) -> Column:
    """Number of words inside any hit; hits are in order of position."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc, hit):
        end = F.greatest(acc["end"], hit["pos"] + hit["width"])
        return F.struct((acc["n"] + end - F.greatest(acc["end"], hit["pos"].cast("int")).cast("int")).cast("int").alias("n"),
                        end.cast("int").alias("end"))

    return F.aggregate(hits, start, lambda a, h: F.when(
        h["pos"] + h["width"] > a["end"], step(a, h)).otherwise(a), lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  **options) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings), contaminated: one row per document row."""
    hits = find_hits(docs, benchmark, n, text_col, **options)
    items = (hits.select("key", F.explode(F.array_distinct(F.transform(
        "hits", lambda h: F.struct(h["width"].alias("width"), h["window"].alias("window"))))).alias("k"))
        .select("key", "k.width", "k.window").join(benchmark_windows(benchmark, n), ["width", "window"])
        .groupBy("key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    found = store(hits.select("key", covered_words(F.col("hits")).cast("long").alias("n_hit")).join(items, "key"), "found")
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("key"),
                       word_count(text).alias("n_words"))
    return _met(rows, found, "left", F.size("items")).select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents",
                    text_col: str = "text", **options) -> DataFrame:
    """`docs` without contaminated rows, or (`remove="spans"`) without the words that were hit.

    With spans, words that stay are kept as they are, lower-casing aside is never applied to the text:
    the text is cut before the first character of each hit word and after its last.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    names = docs.columns
    hits = find_hits(docs, benchmark, n, text_col, **options)
    # rows travel as one struct, so their columns never clash with the ones added here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), text_key(F.col(f"`{text_col}`")).alias("key"))
    if remove == "documents":
        return _met(rows, hits.select("key"), "left_anti", F.lit(0)).select("_row.*")
    cut = _met(rows, hits, "left", F.size("hits"))
    text = F.coalesce(F.col(f"_row.`{text_col}`"), F.lit(""))
    cut = cut.withColumn("_w", F.regexp_extract_all(
        text, F.lit(r"[^0-9A-Za-z\x{80}-\x{10FFFF}]*" + r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"), F.lit(0)))
    cut = cut.withColumn("_kept", F.filter(F.transform("_w", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: ~F.exists(
        F.col("hits"), lambda h: (h["pos"] <= p["i"]) & (p["i"] < h["pos"] + h["width"]))))
    text = F.when(F.col("hits").isNull(), F.col(f"_row.`{text_col}`")).otherwise(
        F.concat_ws("", F.transform("_kept", lambda p: p["x"])))
    return cut.select(*[(text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in names])
