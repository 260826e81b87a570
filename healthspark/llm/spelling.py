"""Spelling variants by a variable-length gram index: words one edit apart, and the form each one stands for.

Dictionary: grams of `QMIN` letters; a gram more frequent in the vocabulary than total / `dictionary` is
extended by the next letter, up to half the least word length. So only the frequent grams need to be known
(fewer than `dictionary` of each length), and rare grams stay short: that is the pruning by frequency.
Decomposition: at each place the first gram that is not frequent (or cannot grow), unless an earlier one
covers it.

Affected grams: for each place of an edit, the grams to its left that end before it are still those of the
edited word; to its right, a gram may vanish only if one that starts at the edit can reach over it, hence if
it ends within the longest gram. What is left over is a run of first grams and a run of last grams, at least
(grams - the word's bound) in all, and as a gram spans at most half a word one of them is never empty. Instead
of merging the lists of single grams and counting, a word enters the merged list of each such pair of runs: two
words one edit apart meet in at least one list. Members of a list are verified by their edit distance.

Lists longer than `list_limit` are split, not cut: two words alike but for one edit agree in the first or in
the last half of what lies between the runs, so each enters one list per half (and per length of the shorter
word); repeated until no list is too long or nothing is left to split.

Scale: texts are read once and leave the map as counts; everything after it is over distinct words, in equi-joins
and keyed aggregations. The driver receives the frequent grams only.

Input rules: a null or empty text has no runs; a null doc_id reads as the empty text in the damage hash; repeated
rows count again; words of other scripts are no runs; a run of any length is a word; an empty table or one without
words gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

LETTERS = "A-Za-zÀ-ÿ"
QMIN = 2
#: Distinct words or grams a task holds before it passes their counts on.
FLUSH = 200_000
#: Words of this length and more travel as numbers, since they are in as many lists as they have letters.
LONG = 64


def damaged(word: str, seed: int, every: int | None) -> str:
    """The word, without one letter if `every` divides the checksum that continues from `seed`."""
    h = zlib.crc32(word.encode(), seed)
    if not every or h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2, damage: int | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): maximal runs of letters, A-Z lower-cased, of at least `min_length` letters and `min_count` uses."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, seen = re.compile(f"[{LETTERS}]{{{min_length},}}"), Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                seed = zlib.crc32(f"{batch.column(0)[i].as_py() or ''}:".encode())
                # bytes lower-case A-Z alone
                for word, n in Counter(runs.findall((text or b"").lower().decode())).items():
                    word = damaged(word, seed, damage)
                    if len(word) >= min_length:
                        seen[word] += n
                if len(seen) > FLUSH:
                    yield _counted(seen)
                    seen.clear()
        yield _counted(seen)

    counts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text")) \
        .mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                      ["word", "n"])


def frequent_grams(words: DataFrame, qmax: int, dictionary: int) -> frozenset[str]:
    """Grams of QMIN to qmax - 1 letters with more than total / dictionary uses: below `dictionary` of each length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                for q in range(QMIN, qmax):
                    seen.update(word[i:i + q] for i in range(len(word) - q + 1))
            if len(seen) > FLUSH:
                yield _counted(seen)
                seen.clear()
        yield _counted(seen)

    total = words.agg(F.sum(F.length("word") - (QMIN - 1)).alias("t")).first()["t"] or 0
    grams = words.select("word").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(r["word"] for r in grams.where(F.col("n") > max(1, total // dictionary)).select("word").collect())


def decompose(word: str, frequent: frozenset[str], qmax: int) -> list[tuple[int, int]]:
    """The word's variable grams as (start, end); starts and ends both increase."""
    out, covered = [], 0
    for start in range(len(word) - QMIN + 1):
        end = start + QMIN
        while end < len(word) and end - start < qmax and word[start:end] in frequent:
            end += 1
        if end > covered:
            out.append((start, end))
            covered = end
    return out


def surviving(word: str, frequent: frozenset[str], qmax: int) -> tuple[set[tuple[int, int]], int]:
    """What a word one edit away still shares, as (end of the first grams, start of the last ones), for every
    place of the edit; and the word's bound, the most grams that one edit can affect."""
    grams = decompose(word, frequent, qmax)
    starts, ends = [s for s, _ in grams], [e for _, e in grams]
    m, size, out, bound = len(grams), len(word), set(), 0
    # a gram cut short by the word's end grows when letters are added there
    growing = sum(e == size and e - s < qmax and word[s:e] in frequent for s, e in grams)
    for at in range(size + 1):
        places = [(bisect_left(starts, at), bisect_right(ends, at + qmax - 1))]  # a letter comes in before `at`
        if at < size:
            places.append((bisect_right(starts, at), bisect_right(ends, at + qmax)))  # letter `at` goes or changes
        for k, (right, reached) in enumerate(places):
            left = bisect_right(ends, at) - (growing if at == size and not k else 0)
            sure = max(right, reached)
            bound = max(bound, sure - left)
            for first in range(right, sure + 1):
                out.add((ends[left - 1] if left else 0, starts[first] if first < m else size))
    return out, bound


def _list_names(word: str, runs: list[tuple[int, int]], by_hash: bool) -> Iterator[str]:
    """A name for each pair of first and last letters: the letters, or for long words their rolling hashes."""
    if not by_hash:
        return (f"{word[:a]} {word[b:]}" for a, b in runs)
    prime, base = (1 << 61) - 1, 1_000_003
    first, last = [0], [0]
    for c, d in zip(word, reversed(word)):
        first.append((first[-1] * base + ord(c)) % prime)
        last.append((last[-1] * base + ord(d)) % prime)
    return (f"{a} {first[a]} {len(word) - b} {last[len(word) - b]}" for a, b in runs)


def index(words: DataFrame, frequent: frozenset[str], qmax: int, by_number: bool = False) -> DataFrame:
    """(key, word, n, lo, hi): every merged list a word is in; lo and hi bound what lies between the runs.
    With `by_number` (key, id): the word's hash instead."""
    names = ["key", "id"] if by_number else ["key", "word", "n", "lo", "hi"]
    kinds = [pa.string(), pa.int64()] if by_number else [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]

        def full() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                runs = sorted(surviving(word, frequent, qmax)[0])
                out[0].extend(_list_names(word, runs, by_number))
                if by_number:
                    out[1].extend([n] * len(runs))
                else:
                    for column, values in zip(out[1:], ([word] * len(runs), [n] * len(runs), [a for a, _ in runs], [b for _, b in runs])):
                        column.extend(values)
                if len(out[0]) >= 50_000:
                    yield full()
        yield full()

    rows = words.select("word", F.xxhash64("word") if by_number else "n").mapInArrow(
        run, "key string, id long" if by_number else "key string, word string, n long, lo int, hi int")
    return rows.withColumn("key", F.xxhash64("key"))


def split_lists(rows: DataFrame) -> DataFrame:
    """Each list by halves of what lies between the runs, for every length the shorter word may have."""
    between = F.col("hi") - F.col("lo")

    def half(shorter: Column) -> Column:
        first = F.floor(shorter / 2).cast("int")
        return F.array(
            F.struct(F.xxhash64("key", shorter, F.lit("first"), F.substr("word", F.col("lo") + 1, first)).alias("key"),
                     (F.col("lo") + first).alias("lo"), F.col("hi").alias("hi")),
            F.struct(F.xxhash64("key", shorter, F.lit("last"),
                                F.substr("word", F.col("hi") - (shorter - first) + 1, shorter - first)).alias("key"),
                     F.col("lo").alias("lo"), (F.col("hi") - (shorter - first)).alias("hi")))

    same = F.array(F.struct(F.xxhash64("key", F.lit("short")).alias("key"), F.col("lo").alias("lo"), F.col("hi").alias("hi")))
    # two words may only be split in the same way: by the length of the shorter one, and not at all below two letters
    parts = F.concat(F.when(between >= 3, half(between - 1)).otherwise(same), F.when(between >= 2, half(between)).otherwise(same))
    return rows.select("word", "n", F.explode(F.array_distinct(parts)).alias("p")).select("p.key", "word", "n", "p.lo", "p.hi")


def near_pairs(words: DataFrame, min_length: int = 7, dictionary: int = 2000, list_limit: int = 4096) -> DataFrame:
    """(a, b, na, nb), a < b: all pairs of words that differ by one inserted, deleted or replaced code point."""
    qmax = min_length // 2
    if qmax < QMIN:
        raise ValueError(f"words of at least {2 * QMIN} letters are needed: shorter ones may share no gram with a variant")
    frequent = frequent_grams(words, qmax, dictionary)
    near = _verified_in_lists(words.where(F.length("word") <= LONG), frequent, qmax, list_limit)
    long = words.where(F.length("word") >= LONG)  # words of just that length are in both
    return near if long.isEmpty() else near.unionByName(_verified_by_number(long, frequent, qmax)).distinct()


def _verified_in_lists(words: DataFrame, frequent: frozenset[str], qmax: int, list_limit: int) -> DataFrame:
    rows, settled = store(index(words, frequent, qmax), "grams"), []
    for _ in range(6):  # what lies between the runs of words below LONG letters is nothing after six halvings
        hot = store(rows.groupBy("key").count().where(F.col("count") > list_limit).select("key"), "hot")
        if hot.isEmpty():
            break
        settled.append(rows.join(hot, "key", "left_anti"))
        rows = store(split_lists(rows.join(hot, "key", "left_semi")), "grams")
    for part in settled:
        rows = rows.unionByName(part)
    a = rows.select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    b = rows.select("key", F.col("word").alias("b"), F.col("n").alias("nb"))
    return a.join(b, "key").where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)) \
        .select("a", "b", "na", "nb").distinct()


def _verified_by_number(words: DataFrame, frequent: frozenset[str], qmax: int) -> DataFrame:
    """As above for long words: all but a few letters of two words in a list agree, so lists need no splitting."""
    rows = store(index(words, frequent, qmax, by_number=True), "long")
    met = rows.withColumnRenamed("id", "x").join(rows.withColumnRenamed("id", "y"), "key").where("x < y").select("x", "y").distinct()
    left, right = (words.select(F.xxhash64("word").alias(i), F.col("word").alias(i + "w"), F.col("n").alias(i + "n")) for i in "xy")
    found = met.join(left, "x").join(right, "y").where(F.levenshtein("xw", "yw", 1) == 1)
    up = F.col("xw") < F.col("yw")
    return found.select(F.least("xw", "yw").alias("a"), F.greatest("xw", "yw").alias("b"),
                        F.when(up, F.col("xn")).otherwise(F.col("yn")).alias("na"), F.when(up, F.col("yn")).otherwise(F.col("xn")).alias("nb"))


def variants(words: DataFrame, ratio: int = 10, **options) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of `words` (word, n).

    The form is the near word of largest n (ties: the smallest in code-point order) if that is at least
    `ratio` times the word's; the root is where forms lead. n grows by `ratio` a step, so chains are short.
    """
    if ratio < 2:
        raise ValueError("a form has at least twice the word's uses")
    pairs = store(near_pairs(words, **options), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")).unionAll(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    best = best.select("word", "n_near", (-F.col("best")["col1"]).alias("best_n"), F.col("best")["near"].alias("best"))
    has = F.col("best_n") >= ratio * F.col("n")
    found = store(words.join(best, "word", "left").select(
        "word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has, F.col("best_n")).alias("form_n")), "forms")
    up = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # paths halve in each round
        step = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = store(up.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                        F.col("next").isNotNull().alias("moved")), "roots")
        if up.where("moved").isEmpty():
            break
        up = up.drop("moved")
    return found.join(up.drop("moved"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, damage: int | None = None,
                    id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The variants of all words of all texts; `damage` deletes a letter of every so many runs first (by checksum)."""
    words = store(word_counts(docs, min_length, min_count, damage, id_col, text_col), "words")
    return variants(words, ratio, min_length=min_length, **options)
