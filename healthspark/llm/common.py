"""Shared helpers: input tables, the shared scratch folder, word patterns, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: A word of the whitespace kind (everything but space, tab, newline, vertical tab, form feed, return).
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, so that byte and code-point lengths never change."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def new_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that appears in `links`.

    Each round points every vertex at its smallest neighbour or itself (a forest, as pointers only go
    down), halves the pointer paths until they are flat, and contracts the links to pairs of roots.
    A star of any degree is gone after one round; all state stays in tables of the shared folder.
    """
    links = store(links.where(F.col(a) != F.col(b))
                  .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    maps = []
    for _ in range(rounds):
        if links.isEmpty():
            break
        both = links.select(F.col("a").alias("id"), F.col("b").alias("to")).unionAll(
            links.select(F.col("b").alias("id"), F.col("a").alias("to")))
        parent = store(both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("p")), "parent")
        while True:
            up = parent.select(F.col("id").alias("p"), F.col("p").alias("pp"))
            parent = store(parent.join(up, "p").select("id", F.col("pp").alias("p"),
                                                       (F.col("pp") != F.col("p")).alias("moved")), "parent")
            moved = parent.where("moved").isEmpty()
            parent = parent.select("id", "p")
            if moved:
                break
        maps.append(parent)
        pa = parent.select(F.col("id").alias("a"), F.col("p").alias("ra"))
        pb = parent.select(F.col("id").alias("b"), F.col("p").alias("rb"))
        links = store(links.join(pa, "a").join(pb, "b").where("ra <> rb")
                      .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    if not maps:
        return links.select(F.col("a").alias("id"), F.col("a").alias("component"))
    out = maps[0].select("id", F.col("p").alias("component"))
    for later in maps[1:]:
        step = later.select(F.col("id").alias("component"), F.col("p").alias("next"))
        out = out.join(step, "component", "left").select("id", F.coalesce("next", "component").alias("component"))
    return out
