"""Episodes and facts as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphmem.plans.engine import Memory


def ingest_stream(memory: Memory, episodes: DataFrame, checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes through the batch ingest; ids are functions of their content, so a batch that runs again changes nothing."""

    def one(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            memory.add_episodes(batch)

    return episodes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_changes(facts: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Facts of a source in each window of valid time, late ones up to ``late`` counted: ``window, source_node_uuid, facts, last_fact``."""
    return facts.withWatermark("valid_at", late).groupBy(F.window("valid_at", window), "source_node_uuid").agg(F.count("*").alias("facts"), F.max_by("fact", "valid_at").alias("last_fact"))
