"""Corpus sources and the file-level scan (path rules, language, test flag).

A *corpus* is any DataFrame ``(repo_id STRING, path STRING, content BINARY|STRING)``,
optionally with ``size_bytes``,
with ``path`` relative to its repository root and '/'-separated. A single code
base is the special case of one ``repo_id``. Two ways to get one:

* :func:`read_repo_tree` walks a directory tree in the executors (raw bytes,
  one row per file), in a mounted path or another store (``walk``);
* :func:`corpus_from_table` adapts any table (Parquet, Delta, JDBC ...).

:func:`source_files` applies the scan rules as column predicates, so the
``where`` clauses that drop ignored paths only touch ``path`` and run before
``content`` is needed; a projection that does not select the text never reads it.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import any_contains, lookup_map
from .tree import TreeSource


def read_repo_tree(spark: SparkSession, root: str, repo_id: str | None = None, content: bool = True,
                   extra_ignores: Sequence[str] = (), shards: int = 256) -> DataFrame:
    """Corpus of a directory tree: repo_id, path, size_bytes and, unless ``content`` is false, content.

    With ``repo_id`` the whole tree is one repository; otherwise the first directory level below
    ``root`` names the repository, and files directly in ``root`` belong to repository ``.``. Ignored
    directories are never entered; files that the scan drops are listed but not read. ``root`` is a
    local or mounted path, relative or not, which raises when the corpus is read if it is missing; or
    the URI of a store that ``walk.walk_repo_tree`` opens, which lists only the files that the scan keeps.
    """
    if "://" in root and not root.startswith("file://"):
        from .walk import walk_repo_tree

        return walk_repo_tree(spark, root, repo_id, extra_ignores, content)
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("repo_tree").options(
        path=os.path.abspath(root.removeprefix("file://")), content=str(content).lower(), shards=str(shards),
        ignored="\n".join([*dims.IGNORED_DIR_NAMES, *extra_ignores]), fragments="\n".join(dims.IGNORED_FILE_FRAGMENTS),
        extensions="\n".join(dims.LANGUAGE_BY_EXTENSION))
    if repo_id is not None:
        reader = reader.option("repo", repo_id)
    corpus = reader.load()
    return corpus if content else corpus.drop("content")


def corpus_from_table(df: DataFrame, repo_col: str = "repo_id", path_col: str = "path",
                      content_col: str = "content") -> DataFrame:
    """Adapts any table; a ``size_bytes`` column, if there is one, spares reading texts for their length."""
    size = [F.col("size_bytes").cast("bigint")] if "size_bytes" in df.columns else []
    return df.select(F.col(repo_col).cast("string").alias("repo_id"),
                     F.col(path_col).cast("string").alias("path"),
                     F.col(content_col).alias("content"), *size)


# ---------------------------------------------------------------------------
# path predicates (pure column expressions over ``path``)
# ---------------------------------------------------------------------------

def _parts(path: Column) -> Column:
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.element_at(_parts(path), -1)


def dir_components(path: Column) -> Column:
    parts = _parts(path)
    return F.slice(parts, 1, F.size(parts) - 1)


def dir_ignored(path: Column, extra_ignores: Sequence[str] = ()) -> Column:
    """A directory component is ignored: listed (lower-cased compare), hidden, or *.egg-info.

    User entries are compared, as written, to the lower-cased component, so an
    entry with capitals never matches (kept on purpose).
    """
    listed = F.array(*[F.lit(x) for x in list(dims.IGNORED_DIR_NAMES) + list(extra_ignores)])

    def bad(d: Column) -> Column:
        low = F.lower(d)
        return (F.array_contains(listed, low) | d.startswith(".")
                | low.endswith(".egg-info"))

    return F.exists(dir_components(path), bad)


def file_ignored(path: Column) -> Column:
    """An ignored fragment occurs anywhere in the lower-cased path, or the name is hidden."""
    return any_contains(F.lower(path), dims.IGNORED_FILE_FRAGMENTS) | file_name(path).startswith(".")


def extension(path: Column) -> Column:
    """Lower-cased last suffix of the file name ('' when none; a leading dot is not a suffix)."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    return F.element_at(lookup_map(dims.LANGUAGE_BY_EXTENSION), extension(path))


def is_test(path: Column) -> Column:
    test_dirs = F.array(*[F.lit(x) for x in dims.TEST_DIR_NAMES])
    by_dir = F.exists(F.split(F.lower(path), "/"), lambda c: F.array_contains(test_dirs, c))
    return by_dir | any_contains(F.lower(file_name(path)), dims.TEST_NAME_FRAGMENTS)


def path_rules(corpus: DataFrame, extra_ignores: Sequence[str] = (), also: Sequence[Column] = ()) -> DataFrame:
    """Every corpus path with each scan predicate as a column (no content read)."""
    p = F.col("path")
    return corpus.select(
        "repo_id", "path",
        dir_ignored(p, extra_ignores).alias("dir_ignored"),
        file_ignored(p).alias("file_ignored"),
        extension(p).alias("extension"),
        language(p).alias("language"),
        is_test(p).alias("is_test"), *also,
    ).withColumn("kept", ~F.col("dir_ignored") & ~F.col("file_ignored")
                 & F.col("language").isNotNull())


def source_files(corpus: DataFrame, extra_ignores: Sequence[str] = ()) -> DataFrame:
    """Scanned files: repo_id, path, extension, language, is_test, size_bytes, md5, text, is_binary.

    ``md5`` hashes the raw bytes (before UTF-8 repair); ``text`` is the content
    decoded as UTF-8 with invalid sequences replaced; ``is_binary`` marks text
    containing NUL (such files count as files but are not analysed).
    """
    p = F.col("path")
    content = F.col("content")
    is_bin_type = dict(corpus.dtypes).get("content") == "binary"
    raw = content if is_bin_type else content.cast("binary")
    text = F.make_valid_utf8(content.cast("string"))
    kept = corpus.where(~dir_ignored(p, extra_ignores) & ~file_ignored(p))
    return (kept.select(
        "repo_id", "path",
        extension(p).alias("extension"),
        language(p).alias("language"),
        is_test(p).alias("is_test"),
        _size(corpus).alias("size_bytes"),
        F.md5(raw).alias("md5"),
        text.alias("text"),
    ).where(F.col("language").isNotNull())
     .withColumn("is_binary", F.contains(F.col("text"), F.lit("\x00"))))


def scanned_files(corpus: DataFrame, extra_ignores: Sequence[str] = ()) -> DataFrame:
    """repo_id, path, extension, language, is_test, size_bytes of the files that the scan keeps."""
    rules = path_rules(corpus, extra_ignores, also=[_size(corpus).alias("size_bytes")])
    return rules.where("kept").select("repo_id", "path", "extension", "language", "is_test", "size_bytes")


def _size(corpus: DataFrame) -> Column:
    size = F.col("size_bytes") if "size_bytes" in corpus.columns else F.octet_length("content")
    return F.coalesce(size, F.lit(0)).cast("bigint")


def language_breakdown(files: DataFrame) -> DataFrame:
    """Files, test files and bytes per (repo, language); reads no content if the corpus has ``size_bytes``."""
    return files.groupBy("repo_id", "language").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("is_test")).alias("test_files"),
        F.sum("size_bytes").alias("total_bytes"))
