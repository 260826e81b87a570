"""Session helpers: a local session for tests/bench and reliable materialisation.

Cluster jobs take their settings from the cluster; :func:`local_session` is for
tests and the local benchmark only. :func:`checkpoint_dir` reads the shared
folder the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "healthspark") -> SparkSession:
    spark = (SparkSession.builder
             .master(f"local[{cores}]")
             .appName(app)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "16g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_DIRS: dict[str, str] = {}
_SCOPES: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A scope for intermediate tables: all that is written inside it lies in one folder, which its end removes.

    Results are lazy and read those tables, so write or collect them before the scope ends::

        with scratch(spark):
            analyze(corpus).repo_metrics.write.parquet(out)
    """
    folder = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _SCOPES.append(folder)
    try:
        yield folder
    finally:
        _SCOPES.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share; inside a ``scratch`` scope, its
    folder there.

    Only a single-machine session (``local[...]``, as in tests) may do without: it gets a scratch
    folder. On a cluster such a folder would be invisible to other machines, so the call raises.
    """
    if _SCOPES:
        return _SCOPES[-1]
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.conf.get("spark.app.id")
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="healthspark-")
    return _LOCAL_DIRS[app]


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """SQL settings for what runs inside; those of before come back at the end."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


#: HotSpot compiles no method of more bytecode than this: a longer generated one would run interpreted, so Spark is
#: told to do without the fused form of such a stage (its default takes methods of up to 65 535).
COMPILED_METHODS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def unbounded(df: DataFrame) -> DataFrame:
    """``df`` for a join whose sides both grow with the corpus: a shuffle join, whatever Spark takes for their sizes.

    It takes the compressed bytes of the files below, from which arrays, repeated texts and rows that a task makes
    grow a hundredfold, so a table of a gigabyte would be broadcast by way of the driver.
    """
    return df.hint("merge")


def materialize(df: DataFrame, name: str, mode: str = "persist", base: str | None = None,
                with_settings: dict[str, str] | None = None) -> DataFrame:
    """Reuse an intermediate table across the many branches that read it.

    * ``write``: write Parquet under ``base`` (default: the session's shared folder) and read it back.
      Cuts lineage, survives lost executors, and readers scan only the columns they need. ``with_settings`` holds
      SQL settings for that write.
    * ``persist``: MEMORY_AND_DISK cache; lost blocks are recomputed from
      lineage if an executor dies.
    * ``none``: return ``df`` unchanged.
    """
    if mode == "none":
        return df
    if mode == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if mode == "write":
        path = f"{(base or checkpoint_dir(df.sparkSession)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        with settings(df.sparkSession, COMPILED_METHODS | (with_settings or {})):
            df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    raise ValueError(f"unknown materialize mode: {mode}")
