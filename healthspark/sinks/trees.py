"""Corpus sink: a table of files as a directory tree, ``<root>/<repo_id>/<path>``.

Tasks write their own rows; a file that exists is replaced, so a repeated task does no harm. Paths that would
leave the root raise.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.walk import open_root

# task functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_tree(corpus: DataFrame, root: str) -> int:
    """Writes every row of (repo_id, path, content) with content; returns the number of files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_root(root)
        made = set()
        for batch in batches:
            for repo, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                name = f"{repo}/{path}"
                if ".." in name.split("/") or name.startswith("/"):
                    raise ValueError(f"not below the root: {name}")
                folder = f"{top}/{name}".rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{top}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = corpus.where(F.col("content").isNotNull()).select("repo_id", "path", F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
