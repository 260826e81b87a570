"""Suffix-array dedup: removes every byte covered by a `length`-byte string that also starts earlier.

Earlier means a smaller doc_id, or an earlier start in the same document; strings are judged on the input.

1. Map over the texts. Each window of `length` bytes is named by its anchor, the leftmost of the least
   hashes of its k-grams; windows in a row with the same anchor form a segment. Equal windows have equal
   anchors at equal offsets, so windows can only repeat inside the group of an anchor hash. Repeats of a
   whole segment inside a chunk are settled on the spot; one row of numbers per distinct segment goes on.
2. Groups are streamed in the order of anchor and segment hash. Anchors that occur once end here (most
   do), later copies of a segment are settled, and only distinct segments of shared anchors ask for bytes.
3. Shards of such segments get a suffix array by induced sorting (`suffix_array`), and permuted common
   prefixes, capped at `length`, split it into classes of equal windows. In each class all but the earliest
   are repeats. Shards are a few hundred kilobytes; a group of more than `hot` distinct segments is
   dealt out window by window first, so no group has to fit one task.
4. Ranges of repeated windows meet their document, whose covered bytes are cut.

Segments are identified by 128 bits (anchor hash and content hash); windows of distinct segments are
compared byte by byte.

Input rules: a null text is empty; texts shorter than `length` keep all bytes; rows equal in doc_id and
text are one document and get the same result; other rows that share a doc_id are separate documents in the order of
a 128-bit hash of their text (if there are such rows, all documents are numbered in order of doc_id and hash first);
null doc_ids come first; an empty table gives an empty result; documents of any length
are processed whole, in overlapping chunks; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

CHUNK = 1 << 20
_ODD = 0x9E3779B97F4A7C15 | 1


# --- suffix arrays -------------------------------------------------------------------------------------

def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the last, the unique least symbol, is)."""
    n = len(s)
    up = np.empty(n, np.int8)
    up[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    up[-1] = 1
    at = np.where(up != 0, np.arange(n), n)
    return up[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Suffix array induced from `lms` (positions in their order): larger suffixes forward, smaller ones backward.

    Works bucket by bucket: what a bucket's suffixes induce is placed in batches, in their order; a
    batch only induces into its own bucket while the same symbol repeats.
    """
    n = len(s)
    sa = np.full(n, -1, np.int64)

    def place(found: np.ndarray, cursor: np.ndarray, step: int) -> None:
        symbols = s[found]
        order = np.argsort(symbols, kind="stable")
        found, symbols = found[order], symbols[order]
        new = np.empty(len(symbols), bool)
        new[0] = True
        np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, len(symbols)))
        rank = np.arange(len(symbols)) - np.repeat(starts, counts)
        sa[cursor[symbols] + step * rank] = found
        cursor[symbols[starts]] += step * counts

    symbols = np.flatnonzero(last > first)
    ends = np.bincount(s[lms], minlength=len(first))
    order = np.argsort(s[lms], kind="stable")
    seeds, at = lms[order], np.concatenate([[0], np.cumsum(ends)])
    head = first.copy()
    for c in symbols:
        done = first[c]
        while done < head[c]:
            batch = sa[done:head[c]]
            done = head[c]
            before = batch[batch > 0] - 1
            before = before[~small[before]]
            if len(before):
                place(before, head, 1)
        before = seeds[at[c]:at[c + 1]] - 1
        before = before[before >= 0]
        before = before[~small[before]]
        if len(before):
            place(before, head, 1)
    tail = last - 1
    for c in symbols[::-1]:
        done = last[c] - 1
        while done > tail[c]:
            batch = sa[tail[c] + 1:done + 1][::-1]
            done = tail[c]
            before = batch[batch > 0] - 1
            before = before[small[before]]
            if len(before):
                place(before, tail, -1)
        batch = sa[first[c]:head[c]][::-1]
        before = batch[batch > 0] - 1
        before = before[small[before]]
        if len(before):
            place(before, tail, -1)
    sa[0] = n - 1
    return sa


def _induce_many(s: np.ndarray, small: np.ndarray, lms: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The same for a large alphabet, whose buckets hold few suffixes each: one by one."""
    def compact(x: np.ndarray) -> array:
        return array("q", x.astype(np.int64).tobytes())

    # the symbol before which a suffix is induced in the pass at hand, else -1; place 0 looks at the last one
    forward, backward = np.where(small, -1, s), np.where(small, s, -1)
    backward[-1] = -1
    forward, backward = compact(forward), compact(backward)
    seeds = np.zeros(len(s), np.int64)
    order = np.argsort(s[lms], kind="stable")
    symbols, held = s[lms][order], np.bincount(s[lms], minlength=len(first))
    seeds[last[symbols] - held[symbols] + np.arange(len(lms)) - (np.cumsum(held) - held)[symbols]] = lms[order]
    sa = seeds.tolist()
    head = first.tolist()
    for p in sa:  # sees what it has placed further on
        c = forward[p - 1]
        if c >= 0:
            at = head[c]
            sa[at] = p - 1
            head[c] = at + 1
    tail = last.tolist()
    for p in reversed(sa):
        c = backward[p - 1]
        if c >= 0:
            tail[c] = at = tail[c] - 1
            sa[at] = p - 1
    sa[0] = len(s) - 1
    return np.array(sa, np.int64)


def suffix_array(s: np.ndarray, small_alphabet: int = 1024) -> np.ndarray:
    """Induced sorting, at every level. `s` holds small integers; its last symbol is the only 0, the least.

    A level with up to `small_alphabet` symbols induces bucket by bucket, one with more suffix by suffix.
    """
    n = len(s)
    if n < 3:
        return np.arange(n)[::-1].astype(np.int64)
    s = s.astype(np.int64)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    held = np.bincount(s)
    last = np.cumsum(held)
    first = last - held
    induce = _induce if len(held) <= small_alphabet else _induce_many
    by_substring = induce(s, small, lms, first, last)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = by_substring[by_substring >= 0]
    ordered = ordered[is_lms[ordered]]
    # name substrings from one such position to the next: equal neighbours share a name
    size = np.zeros(n, np.int64)
    size[lms[:-1]] = np.diff(lms) + 1
    size[lms[-1]] = 1
    a, b = ordered[:-1], ordered[1:]
    same = size[a] == size[b]
    open_, k = np.flatnonzero(same), 0
    while len(open_):
        equal = s[a[open_] + k] == s[b[open_] + k]
        same[open_[~equal]] = False
        k += 1
        open_ = open_[equal]
        open_ = open_[size[a[open_]] > k]
    name = np.empty(n, np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(~same)])
    reduced = name[lms]
    if reduced.max() + 1 == len(lms):
        order = np.empty(len(lms), np.int64)
        order[reduced] = np.arange(len(lms))
    else:
        order = suffix_array(reduced, small_alphabet)
    return induce(s, small, lms[order], first, last)


def repeated(sa: np.ndarray, raw: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, class): valid windows in suffix order; windows of equal bytes share a class.

    The common prefix of a position with its predecessor in suffix order, kept by position and capped at
    `length`, is compared eight bytes at a time; it starts a class where it falls short.
    """
    n = len(raw)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word[:n - k] |= raw[k:].astype(np.uint64) << np.uint64(8 * k)
    ordered = sa[valid[sa]]
    if not len(ordered):
        return ordered, ordered
    steps = [*range(0, length - 8, 8), length - 8]
    full = np.zeros(n, bool)  # by position: the prefix shared with the predecessor reaches `length`
    here, there = ordered[1:], ordered[:-1]
    for k in steps:
        equal = word[here + k] == word[there + k]
        here, there = here[equal], there[equal]
    full[here] = True
    return ordered, np.cumsum(~full[ordered]) - 1


# --- anchors and segments -----------------------------------------------------------------------------

class _Hasher:
    """Polynomial hashes of all substrings of a chunk, modulo 2**64 (substrings are short)."""

    def __init__(self, size: int):
        inverse = pow(_ODD, -1, 1 << 64)
        self.up = np.multiply.accumulate(np.full(size + 1, _ODD, np.uint64))
        self.down = np.multiply.accumulate(np.full(size + 1, inverse, np.uint64))

    @staticmethod
    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[:len(raw)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]


def segments(raw: np.ndarray, window_ok: np.ndarray, length: int, k: int, hasher: _Hasher) -> tuple:
    """(anchor hash, content hash, first window, number of windows) of the segments of a chunk."""
    prefix = hasher.prefix(raw)
    m = len(raw) - k + 1
    value = hasher.mix((prefix[k:] - prefix[:m]) * hasher.down[:m])
    # least value, then least position: the low 21 bits hold the position
    ranked = (value >> np.uint64(21) << np.uint64(21)) | np.arange(m, dtype=np.uint64)
    wanted, have = length - k + 1, 1
    while have < wanted:
        by = min(have, wanted - have)
        ranked = np.minimum(ranked[:-by], ranked[by:])
        have += by
    anchor = (ranked & np.uint64((1 << 21) - 1)).astype(np.int64)
    ok = window_ok[:len(anchor)]
    change = np.empty(len(anchor), bool)
    change[0] = True
    change[1:] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])
    starts = np.flatnonzero(change)
    counts = np.diff(np.append(starts, len(anchor)))
    starts, counts = starts[ok[starts]], counts[ok[starts]]
    content = hasher.mix(hasher.between(prefix, starts, starts + counts + length - 1) ^ hasher.mix(counts.astype(np.uint64)))
    return value[anchor[starts]], content, starts, counts


def chunks(rows: Iterator[tuple], length: int, size: int) -> Iterator[tuple]:
    """Cuts (doc, bytes) rows into chunks: (bytes, ok windows, [(doc, place of the first byte, offset, bytes)])."""
    parts, held = [], 0

    def close():
        raw = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
        ok = np.zeros(len(raw), bool)
        for _, _, at, piece in parts:
            ok[at:at + len(piece) - length + 1] = True
        return raw, ok, parts

    for doc, text in rows:
        for at in range(0, max(1, len(text) - length + 1), size):
            piece = text[at:at + size + length - 1]  # windows that start in this stretch
            if len(piece) < length:
                continue
            if held and held + len(piece) > size:
                yield close()
                parts, held = [], 0
            parts.append((doc, at, held, piece))
            held += len(piece)
    if parts:
        yield close()


def _ranges(doc: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges ranges of windows that touch."""
    order = np.lexsort((pos, doc))
    doc, pos, n = doc[order], pos[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + n[:-1])
    starts = np.flatnonzero(new)
    end = pos + n
    return doc[starts], pos[starts], np.maximum.reduceat(end, starts) - pos[starts] if len(starts) else n


NUMBERS = "settled boolean, anchor long, content long, doc long, pos long, n long"


def _rows(settled, anchor, content, doc, pos, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(doc), settled, bool)), *[pa.array(np.asarray(x).astype(np.int64)) for x in (anchor, content, doc, pos, n)]],
        ["settled", "anchor", "content", "doc", "pos", "n"])


def segment_rows(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Distinct segments of every chunk, and settled ranges of windows that repeat inside one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(CHUNK + 2 * length)

        def rows():
            for batch in batches:
                doc, text = batch.columns
                for i in range(batch.num_rows):
                    yield doc[i].as_py(), (text[i].as_py() or "").encode("utf-8", "surrogatepass")

        for raw, ok, parts in chunks(rows(), length, CHUNK):
            anchor, content, start, n = segments(raw, ok, length, k, hasher)
            at = np.array([p[2] for p in parts])
            owner = np.searchsorted(at, start, side="right") - 1
            doc = np.array([p[0] for p in parts], np.int64)[owner]
            pos = np.array([p[1] for p in parts], np.int64)[owner] + start - at[owner]
            order = np.lexsort((pos, doc, content, anchor))
            anchor, content, doc, pos, n = anchor[order], content[order], doc[order], pos[order], n[order]
            again = np.zeros(len(order), bool)
            again[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
            yield _rows(False, *(x[~again].view(np.int64) for x in (anchor, content, doc, pos, n)))
            twin = np.zeros(len(order), bool)  # a row given twice is one document
            twin[1:] = again[1:] & (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])
            real = again & ~twin
            if real.any():
                first = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
                real &= (doc != doc[first]) | (pos != pos[first])
                d, p, m = _ranges(doc[real], pos[real], n[real])
                yield _rows(True, d * np.int64(31) + p, np.zeros(len(d)), d, p, m)

    return docs.select("doc", "text").mapInArrow(run, NUMBERS)


def classify(rows: DataFrame) -> DataFrame:
    """Streams rows sorted by (anchor, content, doc, pos): settles later copies, keeps distinct segments of
    anchors that have several, drops the rest. Holds one row over from batch to batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, segment, place, several, waiting = None, None, None, False, None
        for batch in batches:
            if not batch.num_rows:
                continue
            done = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            cols = [batch.column(i + 1).to_numpy() for i in range(5)]
            if done.any():
                yield _rows(True, *(c[done] for c in cols))
            cols = [c[~done] for c in cols]
            anchor, content, doc, pos, n = cols
            if not len(anchor):
                continue
            same_group = np.empty(len(anchor), bool)
            same_group[0] = group is not None and anchor[0] == group
            same_group[1:] = anchor[1:] == anchor[:-1]
            same = same_group.copy()
            same[0] = same[0] and content[0] == segment
            same[1:] &= content[1:] == content[:-1]
            twin = same.copy()
            twin[0] = twin[0] and (doc[0], pos[0]) == place
            twin[1:] &= (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])
            later = same & ~twin
            if later.any():
                yield _rows(True, *(c[later] for c in cols))
            new = ~same  # the first row of a segment
            number = np.cumsum(~same_group)  # 0: the group that the last batch left open
            distinct = np.bincount(number, new, minlength=number[-1] + 1)
            if same_group[0]:
                distinct[0] += 1 + several
            many = distinct[number] > 1
            if waiting is not None and same_group[0] and distinct[0] > 1:
                yield _rows(False, *([x] for x in waiting))
                waiting = None
            if not same_group[0] or number[-1] > 0:
                waiting = None
            keep = new & many
            if keep.any():
                yield _rows(False, *(c[keep] for c in cols))
            group, segment, place = anchor[-1], content[-1], (doc[-1], pos[-1])
            several = bool(many[-1])
            if not several and (number[-1] > 0):
                i = np.flatnonzero(number == number[-1])[0]
                waiting = tuple(c[i] for c in cols)

    return rows.mapInArrow(run, NUMBERS)


def segment_bytes(docs: DataFrame, asked: DataFrame, length: int, hot: int) -> DataFrame:
    """(key, bytes, doc, pos): the bytes of asked segments; windows of a hot anchor one by one, keyed by content."""
    busy = asked.groupBy("anchor").count().where(F.col("count") > hot).select("anchor", F.lit(True).alias("busy"))
    lists = asked.join(busy, "anchor", "left").groupBy("doc").agg(
        F.collect_list(F.struct("anchor", "pos", "n", F.coalesce("busy", F.lit(False)).alias("busy"))).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        def out(rows):
            key, content, doc, pos = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(content, pa.binary()), pa.array(doc, pa.int64()),
                                               pa.array(pos, pa.int64())], ["key", "bytes", "doc", "pos"])

        rows = []
        for batch in batches:
            for i in range(batch.num_rows):
                text = (batch.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass")
                doc = batch.column(0)[i].as_py()
                for a in batch.column(2)[i].as_py():
                    start = a["pos"]
                    if a["busy"]:
                        for j in range(a["n"]):
                            one = text[start + j:start + j + length]
                            rows.append((xxh3_64_intdigest(one) - (1 << 63), one, doc, a["pos"] + j))
                    else:
                        rows.append((a["anchor"], text[start:start + a["n"] + length - 1], doc, a["pos"]))
                    if len(rows) >= 20_000:
                        yield out(rows)
                        rows = []
        if rows:
            yield out(rows)

    return docs.join(lists, "doc").select("doc", "text", "asked").mapInArrow(
        run, "key long, bytes binary, doc long, pos long")


def shard_repeats(content: list[bytes], doc: np.ndarray, pos: np.ndarray, length: int) -> tuple:
    """Ranges (doc, pos, n) of windows of a shard that also start earlier in it. Segments are given in any order."""
    joined = b"\0".join(content) + b"\0"
    raw = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(c) for c in content])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    s = raw.astype(np.int64) + 2
    s[starts + sizes] = 1
    s[-1] = 0
    valid = np.zeros(len(raw), bool)
    owner = np.repeat(np.arange(len(content)), sizes + 1)
    valid[np.arange(len(raw)) + length <= (starts + sizes)[owner]] = True
    at, klass = repeated(suffix_array(s), raw, valid, length)
    own_doc, own_pos = doc[owner[at]], pos[owner[at]] + at - starts[owner[at]]
    order = np.lexsort((own_pos, own_doc, klass))
    klass, own_doc, own_pos = klass[order], own_doc[order], own_pos[order]
    again = np.zeros(len(klass), bool)
    again[1:] = klass[1:] == klass[:-1]
    return _ranges(own_doc[again], own_pos[again], np.ones(int(again.sum()), np.int64))


def shard_rows(pieces: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """Streams segments sorted by (key, bytes, doc, pos) in shards of whole groups: (doc, pos, n) of repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "pos", "n"]

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in found], names)

        held, docs, places, size, key = [], [], [], 0, None
        for batch in batches:
            copies = []
            for k, content, doc, pos in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if k == key and held and content == held[-1]:
                    if (doc, pos) != (docs[-1], places[-1]):
                        copies.append((doc, pos, len(content) - length + 1))
                    continue
                if k != key and size > shard_bytes:
                    yield out(shard_repeats(held, np.array(docs), np.array(places), length))
                    held, docs, places, size = [], [], [], 0
                key = k
                held.append(content)
                docs.append(doc)
                places.append(pos)
                size += len(content) + 1
            if copies:
                yield out(zip(*copies))
        if held:
            yield out(shard_repeats(held, np.array(docs), np.array(places), length))

    return pieces.mapInArrow(run, "doc long, pos long, n long")


def repeated_ranges(docs: DataFrame, length: int = 100, k: int = 37, shard_bytes: int = 1 << 20, hot: int = 20_000) -> DataFrame:
    """(doc, start, n): ranges of windows that also start earlier, of (doc, text) rows."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = segment_rows(docs, length, k).repartition(parts, "anchor").sortWithinPartitions("anchor", "content", "doc", "pos")
    classified = store(classify(sorted_rows), "segments")
    pieces = segment_bytes(docs, classified.where("not settled"), length, hot).repartition(parts, "key") \
        .sortWithinPartitions("key", "bytes", "doc", "pos")
    ranges = classified.where("settled").select("doc", "pos", "n").unionAll(shard_rows(pieces, length, shard_bytes))
    return ranges.select("doc", F.col("pos").alias("start"), "n")


def cut_spans(size: int, starts: list[int], counts: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes."""
    out: list[tuple[int, int]] = []
    for a, n in sorted(zip(starts, counts)):
        b = min(size, a + n + length - 1)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc, text): `doc` tells documents apart and orders them.

    It is the doc_id, unless several texts share one. Then all documents are numbered: narrow rows of ids and
    hashes are sorted by range, and a row's id in the sorted table, which only grows, is its number.
    """
    text, own = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    named = docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(-(2 ** 63))).alias("doc"), text.alias("text"))
    first = F.xxhash64("text")
    if named.select("doc", first.alias("h")).groupBy("doc").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").isEmpty():
        return named
    second = F.xxhash64(F.lit(1), F.reverse("text"))
    order = ["doc_id", "h1", "h2"]
    rows = named.select("doc_id", first.alias("h1"), second.alias("h2")).distinct()
    numbered = store(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumn("doc", F.monotonically_increasing_id()), "numbers")
    hashed = named.select("doc_id", "text", first.alias("h1"), second.alias("h2"))
    key = numbered.select(F.col("doc_id").alias("id"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), "doc")
    return store(hashed.join(key, hashed["doc_id"].eqNullSafe(key["id"]) & (hashed["h1"] == key["k1"]) & (hashed["h2"] == key["k2"]))
                 .select("doc_id", "doc", "text"), "numbered")


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text",
                   with_bytes: bool = False, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on request, spans and the remaining bytes."""
    named = keyed(docs, id_col, text_col)
    found = repeated_ranges(named.select("doc", "text"), length, **options).groupBy("doc").agg(
        F.collect_list(F.struct("start", "n")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[], [], [], [], [], []]
            for text, ranges in zip(batch.column(1), batch.column(2)):
                raw, ranges = (text.as_py() or "").encode("utf-8", "surrogatepass"), ranges.as_py() or []
                spans = cut_spans(len(raw), [r["start"] for r in ranges], [r["n"] for r in ranges], length)
                kept = b"".join(raw[a:b] for a, b in zip([0] + [e for _, e in spans], [s for s, _ in spans] + [len(raw)]))
                for col, v in zip(cols, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept)):
                    col.append(v)
            out = [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                spans = [[{"start": a, "end": b} for a, b in s] for s in cols[4]]
                out += [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(cols[5], pa.binary())]
                names += ["spans", "kept"]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + \
        ", spans array<struct<start:long,end:long>>, kept binary" * with_bytes
    return named.join(found, "doc", "left").select("doc_id", "text", "ranges").mapInArrow(run, schema)
