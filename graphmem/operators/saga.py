"""Sagas: chains of episodes, and what a summary of one reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphmem.schema import SAGA_EPISODES

_CHAIN = ("valid_at", "created_at", "uuid")


def next_episodes(episodes: DataFrame) -> DataFrame:
    """``saga_uuid, source_node_uuid, target_node_uuid``: each episode to the one after it; one window for all sagas."""
    w = Window.partitionBy("saga_uuid").orderBy(*_CHAIN)
    linked = episodes.select("saga_uuid", F.lag("uuid").over(w).alias("source_node_uuid"), F.col("uuid").alias("target_node_uuid"))
    return linked.where("source_node_uuid is not null")


def previous_episode(episodes: DataFrame) -> DataFrame:
    """``uuid, previous_uuid`` for each episode of a saga: the latest other one, by valid_at, created_at."""
    w = Window.partitionBy("saga_uuid").orderBy(*[F.col(c).desc() for c in _CHAIN])
    tops = episodes.withColumn("_rank", F.row_number().over(w)).where("_rank <= 2").groupBy("saga_uuid").agg(F.max(F.when(F.col("_rank") == 1, F.col("uuid"))).alias("one"), F.max(F.when(F.col("_rank") == 2, F.col("uuid"))).alias("two"))
    return episodes.join(tops, "saga_uuid").select("uuid", F.when(F.col("uuid") == F.col("one"), F.col("two")).otherwise(F.col("one")).alias("previous_uuid"))


def contents(episodes: DataFrame, since: Column | None = None, limit: int = SAGA_EPISODES) -> DataFrame:
    """``saga_uuid, rank, uuid, content, valid_at`` in order of time: those created after ``since``, or the latest without it."""
    own = episodes.where(F.col("created_at") > since) if since is not None else episodes
    order = [F.col(c) if since is not None else F.col(c).desc() for c in _CHAIN]
    w = Window.partitionBy("saga_uuid").orderBy(*order)
    kept = own.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= limit)
    return kept.select("saga_uuid", F.row_number().over(Window.partitionBy("saga_uuid").orderBy(*_CHAIN)).alias("rank"), "uuid", "content", "valid_at")


def pointers(episodes: DataFrame) -> DataFrame:
    """``saga_uuid, first_episode_uuid, last_episode_uuid, created_at, watermark, n_episodes``."""
    key = F.struct(*_CHAIN)
    return episodes.groupBy("saga_uuid").agg(F.min_by("uuid", key).alias("first_episode_uuid"), F.max_by("uuid", key).alias("last_episode_uuid"), F.min("valid_at").alias("created_at"), F.max("valid_at").alias("watermark"), F.count("*").alias("n_episodes"))


def advanced(old: Column, seen: Column) -> Column:
    """A watermark never goes back; nulls count as nothing."""
    return F.greatest(old, seen)
