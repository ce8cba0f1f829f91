"""Point, group and list reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_uuid(rows: DataFrame, uuid: str) -> DataFrame:
    return rows.where(F.col("uuid") == uuid)


def by_name(rows: DataFrame, name: str, group: str) -> DataFrame:
    """The rows of a name in one group; the empty group is a group like any other."""
    return rows.where((F.col("name") == name) & (F.col("group_id") == group))


def by_uuids(rows: DataFrame, uuids: list[str]) -> DataFrame:
    """With ``pos``, the place in the list; those missing are skipped.  The list is a filter that reaches the scan."""
    return rows.where(F.col("uuid").isin(uuids)).withColumn("pos", F.array_position(F.array(*map(F.lit, uuids)), F.col("uuid")) - 1) if uuids else rows.where(F.lit(False)).withColumn("pos", F.lit(0).cast("long"))


def by_groups(rows: DataFrame, groups: list[str]) -> DataFrame:
    """No groups give nothing."""
    return rows.where(F.col("group_id").isin(groups)) if groups else rows.where(F.lit(False))


def between(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Edges from one node to another, in that direction."""
    return edges.where((F.col("source_node_uuid") == source) & (F.col("target_node_uuid") == target))


def mentioned(entities: DataFrame, mentions: DataFrame, episodes: list[str]) -> DataFrame:
    """Each entity that any of the episodes mentions, once."""
    ends = mentions.where(F.col("source_node_uuid").isin(episodes) if episodes else F.lit(False)).select(F.col("target_node_uuid").alias("_end"))
    return entities.join(ends, F.col("uuid") == F.col("_end"), "left_semi")


def embeddings_of(rows: DataFrame, uuids: list[str], column: str) -> DataFrame:
    """``uuid`` and vector; rows without one are left out."""
    return by_uuids(rows, uuids).where(F.col(column).isNotNull()).select("uuid", column)


def mention_counts(mentions: DataFrame, uuids: list[str] | None = None) -> DataFrame:
    """``uuid, mentions``; entities that nothing mentions are left out."""
    own = mentions if uuids is None else mentions.where(F.col("target_node_uuid").isin(uuids) if uuids else F.lit(False))
    return own.groupBy(F.col("target_node_uuid").alias("uuid")).agg(F.count("*").alias("mentions"))


def last_episodes(episodes: DataFrame, before: str, n: int = 10, groups: list[str] | None = None, source: str | None = None) -> DataFrame:
    """The last ``n`` episodes not after ``before``, oldest first, with their ``rank``."""
    own = episodes.where(F.col("valid_at") <= F.lit(before).cast("timestamp"))
    own = own.where(F.col("group_id").isin(groups)) if groups and groups != [""] else own
    own = own.where(F.col("source") == source) if source else own
    latest = own.orderBy(F.col("valid_at").desc(), F.col("uuid").desc()).limit(n)  # n rows: what follows is one small partition
    return latest.withColumn("rank", F.row_number().over(Window.orderBy("valid_at", "uuid")))
