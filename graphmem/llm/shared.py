"""Bounded samples and connected components, over tables written to the shared folder; freed memory given back."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphmem.sources.scratch import discard, written

__all__ = ["connected_components", "discard", "first_bytes", "give_back", "shuffle_partitions", "written"]


def first_bytes(rows: DataFrame, text: str, order: list, most: int) -> DataFrame:
    """Of a bounded number of rows, those before ``most`` bytes of text are reached, in an order; the row that crosses the bound is the last."""
    before = F.sum(F.octet_length(text)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_before", before).where(F.coalesce("_before", F.lit(0)) < most).drop("_before")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Hands freed memory back to the system, which Arrow's and the C library's allocators else keep for later; without effect where there is no ``malloc_trim``."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component``: the smallest node that each node of an edge reaches, itself included.

    Alternates two contractions, each of which hangs neighbours under the smallest node
    known, until no edge changes; the rounds grow with the logarithm of the
    longest path.  Each round is a hash aggregate and a join, so a node with very many
    neighbours is pre-aggregated and its join side can be split.  Nodes without an edge
    are not returned; null ends are ignored.
    """
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        before, e = e, written(small.where("u <> v").distinct(), "edges")
        discard(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    out._written_path = e._written_path  # for ``discard``
    return out
