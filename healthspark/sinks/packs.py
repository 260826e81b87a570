"""Text sink: documents of many repositories packed into a few files, with an offset index.

A Spark data source writer. Every task appends the parts it gets to one pack file and notes where each
repository's stretch begins and ends in an index file beside it; nothing of a repository's size is held in
memory, and there is no folder or file per repository. A repository whose parts went to several tasks has
a stretch in each. The driver's commit receives file names only and publishes them in a manifest: files that
a failed or repeated task left behind are in no manifest, and an aborted job removes what it wrote.

``read_documents`` gives the parts back as a table; ``read_document`` joins those of one repository.

Folders are named by path or URI and opened by ``pyarrow.fs`` (local and shared file systems, and the object
stores that it is built with), so tasks need no mounted folder where the store has a URI.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# writers travel to the tasks by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MANIFEST = "_manifest.json"


def _open_folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class PackMessage(WriterCommitMessage):
    name: str | None


class PackSource(DataSource):
    """``df.write.format("healthspark_packs")``: rows (repo_id string, part long, text string), in order per task."""

    @classmethod
    def name(cls) -> str:
        return "healthspark_packs"

    def schema(self) -> str:
        return "repo_id string, part long, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PackWriter(self.options["path"].rstrip("/"))


class PackWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> PackMessage:
        from pyspark import TaskContext

        store, folder = _open_folder(self.path)
        name, at, open_ = f"pack-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, None
        out = index = None
        for repo, part, text in rows:
            if out is None:
                store.create_dir(folder, recursive=True)
                out, index = (store.open_output_stream(f"{folder}/{name}.{kind}") for kind in ("txt", "index"))
            if open_ is None or open_["repo_id"] != repo or open_["last"] + 1 != part:
                if open_ is not None:
                    index.write((json.dumps(open_) + "\n").encode())
                open_ = {"repo_id": repo, "first": part, "last": part, "pack": name, "start": at, "end": at}
            at += out.write((text + "\n").encode())
            open_["last"], open_["end"] = part, at
        if out is None:
            return PackMessage(None)
        index.write((json.dumps(open_) + "\n").encode())
        out.close()
        index.close()
        return PackMessage(name)

    def commit(self, messages: list) -> None:
        store, folder = _open_folder(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(sorted(m.name for m in messages if m is not None and m.name)).encode())

    def abort(self, messages: list) -> None:
        store, folder = _open_folder(self.path)
        for m in messages:
            if m is not None and m.name:
                for kind in ("txt", "index"):
                    store.delete_file(f"{folder}/{m.name}.{kind}")


def write_documents(parts: DataFrame, path: str) -> None:
    """Writes (repo_id, part, text) as packs: one pack per task, parts in order. ``text`` holds no line break."""
    parts.sparkSession.dataSource.register(PackSource)
    order = ["repo_id", "part"]
    ready = parts.select("repo_id", F.col("part").cast("bigint").alias("part"), "text").repartitionByRange(*order) \
        .sortWithinPartitions(*order)
    ready.write.format("healthspark_packs").mode("append").option("path", path).save()


def write_texts(texts: DataFrame, column: str, path: str) -> None:
    """Writes a rendering (``markdown``, ``rules`` or ``notes``) of every repository: one part per line."""
    lines = texts.select("repo_id", F.posexplode(F.split(column, "\n", -1)).alias("part", "text"))
    write_documents(lines.withColumn("part", F.col("part") + 1), path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(repo_id, first, last, pack, start, end): the stretches of all published packs."""
    store, folder = _open_folder(path)
    with store.open_input_stream(f"{folder}/{MANIFEST}") as f:
        names = json.loads(f.read())
    schema = "repo_id string, first long, last long, pack string, start long, end long"
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path.rstrip('/')}/{n}.index" for n in names])


def read_documents(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """(repo_id, part, text) of all repositories, or of the stretches that ``where`` (on repo_id) picks.

    Stretches are read line by line: a long one costs no memory.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open_folder(path.rstrip("/"))
        for batch in batches:
            for repo, part, pack, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{folder}/{pack}.txt") as f:
                    f.seek(start)
                    left, rest = end - start, b""
                    while left:
                        block = f.read(min(left, 1 << 20))
                        left -= len(block)
                        *whole, rest = (rest + block).split(b"\n")
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([repo] * len(whole), pa.string()), pa.array(range(part, part + len(whole)), pa.int64()),
                             pa.array([w.decode() for w in whole], pa.string())], ["repo_id", "part", "text"])
                        part += len(whole)

    found = read_index(spark, path)
    found = found if where is None else found.where(where)
    return found.select("repo_id", "first", "pack", "start", "end").mapInArrow(run, "repo_id string, part long, text string")


def read_document(spark: SparkSession, path: str, repo_id: str, separator: str = "") -> str:
    """One repository's document as text (``separator`` "\\n" for texts written line by line)."""
    rows = read_documents(spark, path, F.col("repo_id") == repo_id).orderBy("part").select("text")
    return separator.join(r["text"] for r in rows.toLocalIterator())
