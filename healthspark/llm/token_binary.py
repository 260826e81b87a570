"""Token ids as binary blocks: every id in the minimum number of bits of the vocabulary.

File format (`write_token_blocks`): a Parquet table with one row per block, sorted by (shard, block):

    shard int, block int    position of the block; shards are ascending, disjoint ranges of doc_id
    start long              ids of the same shard before this block
    n_ids long, bits int    ids in the block, and the width of each
    doc_ids array<long>     documents of the block, ascending
    doc_starts array<long>  first id of each document, counted from the block's start
    payload binary          id k of the block occupies bits [k*bits, (k+1)*bits), least significant
                            bit first

A block holds whole documents and is closed once it reaches `block_ids` ids, so any document can be
read from one row without touching another, and numpy unpacks a block (or a slice of one) in a few
vector operations. The container is written by Spark's own commit protocol, so a lost executor
leaves no half-written shard.

Input rules: a null text is empty (its document holds only the end id); a null doc_id sorts first;
repeated rows are all written, equal doc_ids ordered by their packed ids; an empty table gives no blocks;
other columns are ignored. Long texts are encoded whole.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path

#: Blanks that every tokenizer rule of the vocabulary treats as white space.
_BLANK = re.compile(r"[ \t\n\r]+")
_CONTROL = re.compile("[\x1c-\x1f]")


def id_bits(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width packing, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(wide[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """Ids start .. start+count of a packed block; reads only the bytes that hold them."""
    first = start * bits
    low, high = first // 8, -(-(first + count * bits) // 8)
    raw = np.frombuffer(payload, np.uint8, high - low, low)
    if bits in (8, 16, 32):
        return raw.view(f"<u{bits // 8}").astype("<u4")
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = np.unpackbits(raw, bitorder="little")[first - 8 * low:][:count * bits].reshape(count, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class _Pieces(dict):
    """Piece -> its ids as bytes; a piece that is not known is encoded by the library, once while it is kept.

    Shortcuts are used only if the tokenizer agrees with them on a few samples:
    `folds`, `cuts`: it folds case and always cuts between a word and punctuation after it, so a Latin or
    ASCII piece is its lower-case word and its tail, and `Word,` costs no further call once `word` is known;
    `direct`: a Latin word in lower case is one unit, so it goes straight to the library's model.
    Pieces that could hold a special token are never taken apart.
    """

    def __init__(self, path: str, remember: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.remember = Tokenizer.from_file(path), remember
        self.model = self.tokenizer.model
        self.folds = all(self._library(x) == self._library(x.lower()) for x in ("Ab", "QUEST", "x9Y"))
        self.cuts = all(self._library(x + y) == self._library(x) + self._library(y)
                        for x in ("ab", "quest", "x9") for y in (".", ",", "***", "?!", "$$$."))
        self.latin, self.direct = {}, False
        split = self.tokenizer.pre_tokenizer
        if self.folds and split is not None:
            # how the pre-tokenizer writes each Latin letter
            self.latin = {c: split.pre_tokenize_str(chr(c)) for c in range(0x250) if chr(c).isalpha() and chr(c).islower()}
            self.latin = {c: v[0][0] for c, v in self.latin.items() if len(v) == 1}
            self.word = re.compile(f"[{''.join(map(chr, self.latin))}]+").fullmatch
            self.direct = all(self._model(x) == self._library(x) for x in ("a", "quest", "über", "niño", "garçonñæ", "zzyzxæøå", "ÿœ"))

    def _library(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _model(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word.translate(self.latin))]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        plain = piece.lower() if self.folds else piece
        word = plain.rstrip(".,;:!?*#$%&") if self.cuts else plain
        latin = self.direct and self.word(word)
        if latin and word == piece:
            ids = self._model(piece)
        elif "<|" not in piece and (latin or (piece.isascii() and word[-1:].isalnum())) and (word != plain or plain != piece):
            ids = self[plain] if plain != piece else self[word] + self[plain[len(word):]]
        else:
            ids = self._library(piece)
        if len(piece) <= 64:
            if len(self) >= self.remember:
                self.clear()
            self[piece] = ids
        return ids


class WordEncoder:
    """Encodes whole texts with a tokenizer whose rules drop white space.

    Such a tokenizer never joins characters across a blank, so a text's ids are those of its pieces
    between blanks in order. Pieces are remembered by the Python worker across its tasks, at most
    `remember` of them and none over 64 characters; a full memory starts over.
    """

    def __init__(self, path: str, end_id: int, remember: int = 1_000_000):
        held = sys.__dict__.setdefault("_word_pieces", {})  # lives as long as the worker process
        if path not in held:
            held[path] = _Pieces(path, remember)
        self.pieces, self.end = held[path], np.array([end_id], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids = self.pieces.__getitem__
        # str.split() cuts at the same characters, and at four control characters that are no blanks here
        cut = (text.split() if not _CONTROL.search(text) else _BLANK.split(text) for text in texts)
        return [np.frombuffer(b"".join(map(ids, pieces)) + self.end, "<u4") for pieces in cut]


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int, bits: int, bounds: list) -> DataFrame:
    """(doc_id, shard, n_tokens, packed): map-only; no document leaves its input task as text."""
    edges = np.array(bounds, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path, end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys = part.column(0).to_pylist()
                ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.int64()),
                    pa.array([0 if k is None else int(np.searchsorted(edges, k)) for k in keys], pa.int32()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([pack(x, bits) for x in ids], pa.binary())], ["doc_id", "shard", "n_tokens", "packed"])

    return docs.mapInArrow(run, "doc_id long, shard int, n_tokens long, packed binary")


def write_token_blocks(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                       text_col: str = "text", shards: int | None = None, block_ids: int = 65_536) -> None:
    """Encodes `docs` and writes the block table to `path` in ascending doc_id order.

    Documents are encoded where they are read; only packed ids are exchanged, once, by shard. Shard
    edges are quantiles of the id column alone. `shards` defaults to spark.sql.shuffle.partitions.
    """
    from tokenizers import Tokenizer

    bits = id_bits(max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1))
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    probes = [i / shards for i in range(1, shards)]
    bounds = sorted(set(docs.select("doc_id").agg(F.percentile_approx("doc_id", probes, 10_000)).first()[0] or [])) \
        if probes else []
    ordered = (encode_documents(docs, tokenizer_path, end_id, bits, [int(x) for x in bounds])
               .repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "packed"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "block", "start", "n_ids", "bits", "doc_ids", "doc_starts", "payload"]
        shard, block, start, held, ids, counts, size = None, 0, 0, [], [], [], 0

        def close():
            starts = np.cumsum([0] + counts[:-1])
            payload = b"".join(ids) if bits % 8 == 0 else pack(
                np.concatenate([unpack(x, bits, 0, n) for x, n in zip(ids, counts)]), bits)
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()),
                pa.array([size], pa.int64()), pa.array([bits], pa.int32()),
                pa.array([held], pa.list_(pa.int64())), pa.array([starts.tolist()], pa.list_(pa.int64())),
                pa.array([payload], pa.binary())], names)

        for batch in batches:
            for key, s, n, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (s != shard or size >= block_ids):
                    yield close()
                    block, start, held, ids, counts, size = block + 1, start + size, [], [], [], 0
                if s != shard:
                    shard, block, start = s, 0, 0
                held.append(key)
                ids.append(packed)
                counts.append(n)
                size += n
        if held:
            yield close()

    ordered.mapInArrow(blocks, "shard int, block int, start long, n_ids long, bits int, doc_ids array<long>, "
                               "doc_starts array<long>, payload binary").write.option("compression", "zstd").parquet(path)


def read_token_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a block table: doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    (of the ids as little-endian unsigned 32-bit integers) and, on request, the ids themselves."""
    blocks = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, start, n, bits, keys, starts, payload = (batch.column(i)[row].as_py() for i in range(7))
                ids = unpack(payload, bits, 0, n)
                ends = [*starts[1:], n]
                cut = [ids[a:b] for a, b in zip(starts, ends)]
                cols = [pa.array([shard] * len(keys), pa.int32()), pa.array(keys, pa.int64()),
                        pa.array([start + a for a in starts], pa.int64()),
                        pa.array([b - a for a, b in zip(starts, ends)], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64())]
                names = ["shard", "doc_id", "in_shard", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([x.astype("<i8") for x in cut], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "shard int, doc_id long, in_shard long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    docs = blocks.select("shard", "start", "n_ids", "bits", "doc_ids", "doc_starts", "payload").mapInArrow(run, schema)
    # one row per shard: the window is as small as the number of shards
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return docs.join(base, "shard").select("doc_id", (F.col("base") + F.col("in_shard")).alias("start"), "n_tokens",
                                           "ids_crc32", *(["ids"] if with_ids else []))


def read_ids(spark: SparkSession, path: str, doc_id: int) -> np.ndarray | None:
    """Random access: the ids of one document, from the one block that holds it."""
    row = spark.read.parquet(path).where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).first()
    if row is None:
        return None
    k = row["doc_ids"].index(doc_id)
    end = [*row["doc_starts"][1:], row["n_ids"]][k]
    return unpack(bytes(row["payload"]), row["bits"], row["doc_starts"][k], end - row["doc_starts"][k])


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = 1, **options) -> DataFrame:
    """Writes the block table into the shared folder and returns its documents, read back from it."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_blocks(docs, path, tokenizer_path, end_id, **options)
    return read_token_documents(docs.sparkSession, path)
