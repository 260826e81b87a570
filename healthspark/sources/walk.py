"""Trees of any store, listed and read by tasks.

Directories are listed in rounds: a task walks below the directories it was dealt until it has seen its share of
entries, and hands back the directories it did not come to; those are dealt again. So a large subtree is split
wherever it turns out large, and the driver only starts rounds. Ignored directories are never entered.
Folders are opened by ``pyarrow.fs``: paths, ``file://`` and the stores that it is built with.

Files are read by byte ranges that end at line breaks (see ``operators.chunks``), each range in a task of its
own: a file of any size is read by many tasks and never held whole. Digests of files of several ranges are
taken in one stream.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..session import materialize

# task functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1 << 20


def open_root(root: str):
    """(file system, folder) of a path or URI."""
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root.rstrip("/"))
    return fs.LocalFileSystem(), root.rstrip("/")


def _entries(store, folder: str) -> list[tuple[str, bool, int]]:
    """(name, is a directory, size); links to directories are neither walked nor files, dangling links are files."""
    from pyarrow import fs

    if store.type_name != "local":
        return [(i.base_name, i.type == fs.FileType.Directory, i.size or 0) for i in store.get_file_info(fs.FileSelector(folder))]
    out = []
    with os.scandir(folder) as entries:
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                out.append((e.name, True, 0))
            elif not e.is_dir():
                try:
                    out.append((e.name, False, e.stat().st_size))
                except OSError:
                    out.append((e.name, False, 0))
    return out


def list_files(spark: SparkSession, root: str, extra_ignores: Sequence[str] = (), share: int = 20_000,
               base: str | None = None) -> DataFrame:
    """(file, size_bytes): every file below ``root``, by its path from there. A missing root raises."""
    ignored = frozenset([*dims.IGNORED_DIR_NAMES, *extra_ignores])
    store, folder = open_root(root)
    from pyarrow import fs

    if store.get_file_info(folder).type != fs.FileType.Directory:
        raise FileNotFoundError(root)

    def walk(first: int):
        def enters(name: str) -> bool:
            low = name.lower()
            return not (low in ignored or name.startswith(".") or low.endswith(".egg-info"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, top = open_root(root)
            for batch in batches:
                for directory in batch.column(0).to_pylist():
                    todo, seen, files, sizes = [directory], 0, [], []
                    while todo and seen < first:
                        here = todo.pop()
                        found = _entries(store, f"{top}/{here}" if here else top)
                        seen += 1 + len(found)
                        for name, is_dir, size in found:
                            path = f"{here}/{name}" if here else name
                            if not is_dir:
                                files.append(path)
                                sizes.append(size)
                            elif enters(name):
                                todo.append(path)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(files + todo, pa.string()), pa.array([False] * len(files) + [True] * len(todo)),
                         pa.array(sizes + [0] * len(todo), pa.int64())], ["file", "below", "size_bytes"])

        return run

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found, frontier, first = None, spark.createDataFrame([("",)], "file string"), 1000
    while True:
        level = materialize(frontier.mapInArrow(walk(first), "file string, below boolean, size_bytes long"), "walk", "write", base)
        here = level.where(~F.col("below")).select("file", "size_bytes")
        found = here if found is None else found.unionAll(here)
        if level.where("below").isEmpty():
            return found
        frontier, first = level.where("below").select("file").repartition(tasks), share


def _cut(rule: re.Pattern, stream, at: int, size: int) -> int:
    """The first place at or after ``at`` where a chunk may end; the file's end if there is none."""
    if at <= 0 or at >= size:
        return min(max(at, 0), size)
    low = max(0, at - 3)  # the line break before ``at`` counts, with the sign and \r in front of it
    stream.seek(low)
    window = b""
    while block := stream.read(BLOCK):
        window += block
        for m in rule.finditer(window):
            if low + m.end() >= at:
                return low + m.end()
        keep = window[-3:]
        low += len(window) - len(keep)
        window = keep
    return size


def read_chunks(files: DataFrame, root: str, repo_id: str | None = None, chunk_bytes: int = 4 << 20) -> DataFrame:
    """(repo_id, path, size_bytes, start, piece) of the files that the scan keeps, cut as ``operators.chunks`` says."""
    from ..operators.chunks import AFTER_LINE, AFTER_SIGN, PLAIN

    plain, sign, any_line = PLAIN, AFTER_SIGN, AFTER_LINE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_root(root)
        for batch in batches:
            for file, repo, path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                name = path.rsplit("/", 1)[-1]
                dot = name.rfind(".")
                rule = any_line if dot > 0 and name[dot:].lower() in plain else sign
                try:
                    with store.open_input_file(f"{top}/{file}") as stream:
                        low, high = (_cut(rule, stream, at, size) for at in (start, start + chunk_bytes))
                        stream.seek(low)
                        piece = stream.read(high - low)
                except OSError:  # unreadable or a dangling link: a file without content, which is not analysed
                    continue
                if high > low or start == 0:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in ((repo, pa.string()), (path, pa.string()), (size, pa.int64()),
                                                       (low, pa.int64()), (piece, pa.binary()))],
                        ["repo_id", "path", "size_bytes", "start", "piece"])

    last = F.greatest(F.floor((F.col("size_bytes") - 1) / chunk_bytes), F.lit(0)).cast("bigint")
    ranges = kept_files(files, repo_id).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("k")).select(
        "file", "repo_id", "path", "size_bytes", (F.col("k") * chunk_bytes).alias("start"))
    return _dealt(ranges, files, chunk_bytes, "file", "start").mapInArrow(
        run, "repo_id string, path string, size_bytes long, start long, piece binary")


def file_digests(files: DataFrame, root: str, repo_id: str | None = None) -> DataFrame:
    """(repo_id, path, md5): every kept file in one stream of bounded blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_root(root)
        for batch in batches:
            out = []
            for file in batch.column(0).to_pylist():
                state = hashlib.md5(usedforsecurity=False)
                try:
                    with store.open_input_file(f"{top}/{file}") as stream:
                        while block := stream.read(BLOCK):
                            state.update(block)
                except OSError:
                    state = None
                out.append(state and state.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.string())], ["repo_id", "path", "md5"])

    rows = kept_files(files, repo_id).select("file", "repo_id", "path")
    return _dealt(rows, files, 4 << 20, "file").mapInArrow(run, "repo_id string, path string, md5 string")


def kept_files(files: DataFrame, repo_id: str | None = None) -> DataFrame:
    """(file, repo_id, path, size_bytes) of the listed files that the scan keeps; without ``repo_id`` the first
    directory names the repository, and files directly in the root belong to repository ``.``."""
    from .corpus import dir_ignored, file_ignored, language

    if repo_id is not None:
        named = files.select("file", F.lit(repo_id).alias("repo_id"), F.col("file").alias("path"), "size_bytes")
    else:
        first = F.substring_index("file", "/", 1)
        below = F.contains("file", F.lit("/"))
        named = files.select("file", F.when(below, first).otherwise(".").alias("repo_id"),
                             F.when(below, F.substr("file", F.length(first) + 2)).otherwise(F.col("file")).alias("path"), "size_bytes")
    p = F.col("path")
    return named.where(~dir_ignored(p) & ~file_ignored(p) & language(p).isNotNull())


def _dealt(rows: DataFrame, files: DataFrame, unit: int, *keys: str) -> DataFrame:
    """Rows dealt to tasks of about 64 MB of files each, but no fewer than the session's shuffle partitions."""
    total = files.agg(F.sum(F.greatest(F.col("size_bytes"), F.lit(1))).alias("t")).first()["t"] or 0
    tasks = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // max(unit, 64 << 20)))
    return rows.repartition(tasks, *keys)


def walk_repo_tree(spark: SparkSession, root: str, repo_id: str | None = None, extra_ignores: Sequence[str] = (),
                   content: bool = True) -> DataFrame:
    """The corpus of a tree in any store, files whole: (repo_id, path, size_bytes[, content]). Files that the scan drops
    are not listed. For files too large for a row use :func:`read_chunks` and ``operators.chunks.analyse_chunks``."""
    files = list_files(spark, root, extra_ignores)
    kept = kept_files(files, repo_id)
    if not content:
        return kept.select("repo_id", "path", "size_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_root(root)
        for batch in batches:
            for file, repo, path, size in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    with store.open_input_file(f"{top}/{file}") as stream:
                        held = stream.read()
                except OSError:
                    held = None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in ((repo, pa.string()), (path, pa.string()), (size, pa.int64()), (held, pa.binary()))],
                    ["repo_id", "path", "size_bytes", "content"])

    return _dealt(kept, files, 64 << 20, "file").mapInArrow(run, "repo_id string, path string, size_bytes long, content binary")
