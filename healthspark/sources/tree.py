"""A directory tree as a Spark data source: directories are dealt to tasks, which walk them.

Spark's own file sources skip names that start with ``_`` and list ignored directories before a filter
can drop them. This source returns what a walk of the tree returns: the driver only splits the upper
directories into shards; tasks walk them, never enter an ignored directory, and read a file only if the
scan keeps it and its content is asked for. The tree has to be a file system path that every
executor sees (a mounted share on a cluster).
"""

from __future__ import annotations

import os
import sys

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# readers travel to the tasks by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "repo_id string, path string, size_bytes long, content binary"


class Shard(InputPartition):
    """A directory, relative to the root; with or without what lies below it."""

    def __init__(self, directory: str, deep: bool):
        super().__init__(directory)
        self.directory, self.deep = directory, deep


class TreeReader(DataSourceReader):
    def __init__(self, root: str, repo_id: str | None, with_content: bool, shards: int, ignored: list[str],
                 fragments: list[str], extensions: list[str]):
        self.root, self.repo_id, self.with_content, self.shards = root, repo_id, with_content, shards
        self.ignored, self.fragments, self.extensions = frozenset(ignored), fragments, frozenset(extensions)

    def _enters(self, name: str) -> bool:
        low = name.lower()
        return not (low in self.ignored or name.startswith(".") or low.endswith(".egg-info"))

    def _kept(self, path: str) -> bool:
        name = path.rsplit("/", 1)[-1]
        return not (name.startswith(".") or any(f in path.lower() for f in self.fragments)) and \
            os.path.splitext(name)[1].lower() in self.extensions

    def _directories(self, directory: str) -> list[str]:
        with os.scandir(os.path.join(self.root, directory)) as entries:
            names = [e.name for e in entries if e.is_dir(follow_symlinks=False) and self._enters(e.name)]
        return [f"{directory}/{n}" if directory else n for n in sorted(names)]

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        shallow, deep = [], [""]
        while deep and len(deep) + len(shallow) < self.shards:
            level = [(d, self._directories(d)) for d in deep]
            if not any(below for _, below in level):
                break
            shallow += [d for d, below in level if below]
            deep = [d for d, below in level if not below] + [x for _, below in level for x in below]
        return [Shard(d, False) for d in shallow] + [Shard(d, True) for d in deep]

    def read(self, partition: Shard):
        top = os.path.join(self.root, partition.directory) if partition.directory else self.root
        for folder, below, names in os.walk(top):
            below[:] = [d for d in below if partition.deep and self._enters(d)]
            for name in names:
                full = os.path.join(folder, name)
                path = os.path.relpath(full, self.root).replace(os.sep, "/")
                repo, path = (self.repo_id, path) if self.repo_id is not None else \
                    (path.split("/", 1) if "/" in path else (".", path))
                try:
                    size = os.stat(full).st_size
                    content = None
                    if self.with_content and self._kept(path):
                        with open(full, "rb") as file:
                            content = file.read()
                except OSError:  # unreadable or a dangling link: listed without content
                    size, content = 0, None
                yield repo, path.encode("utf-8", "replace").decode(), size, content


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        o = self.options
        return TreeReader(o["path"], o.get("repo"), o.get("content", "true") == "true", int(o.get("shards", "256")),
                          o["ignored"].split("\n"), o["fragments"].split("\n"), o["extensions"].split("\n"))
