"""Bounded traversal, hop by hop over written frontiers, and neighbour counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmem.operators.filters import SearchFilters, filter_edges, filter_nodes, in_groups
from graphmem.sources.scratch import discard, written

DEPTH, MAX_DEPTH = 3, 5


def _hops(edges: DataFrame, mentions: DataFrame | None) -> DataFrame:
    """``uuid, s, t`` of RELATES_TO edges, and without a uuid of MENTIONS."""
    own = edges.select("uuid", F.col("source_node_uuid").alias("s"), F.col("target_node_uuid").alias("t"))
    return own if mentions is None else own.unionByName(mentions.select(F.lit(None).cast("string").alias("uuid"), F.col("source_node_uuid").alias("s"), F.col("target_node_uuid").alias("t")))


def _reached(hops: DataFrame, origins: DataFrame, depth: int, with_origins: bool) -> DataFrame:
    """``origin, node`` of all nodes some hops from an origin, each pair once.

    The links are written once and each frontier as it is found, so a hop is one join over stored tables, and no plan holds another one's.
    """
    links = written(hops.select("s", "t"), "links")
    fronts = [written(origins.select(F.col("uuid").alias("origin"), F.col("uuid").alias("node")).distinct(), "front")]
    for _ in range(min(depth, MAX_DEPTH)):
        after = fronts[-1].join(links, F.col("node") == F.col("s")).select("origin", F.col("t").alias("node")).distinct()
        fronts.append(written(after, "front"))
    kept = fronts if with_origins else fronts[1:] or [fronts[0].limit(0)]
    out = kept[0]
    for front in kept[1:]:
        out = out.unionByName(front)
    out = written(out.distinct(), "reached")
    for df in (links, *fronts):
        discard(df)
    return out


def bfs_nodes(entities: DataFrame, edges: DataFrame, origins: DataFrame, depth: int = DEPTH, mentions: DataFrame | None = None, filters: SearchFilters | None = None, groups: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Entities 1 to ``depth`` directed hops from an origin, in the origin's group; an origin on a cycle is among them.

    Origins have ``uuid, group_id``.  Pairs are distinct after each hop, so a round is no larger than origins times nodes reached.
    """
    reached = _reached(_hops(edges, mentions), origins, depth, False)
    reached = reached.join(origins.select(F.col("uuid").alias("origin"), F.col("group_id").alias("own")), "origin").select(F.col("node").alias("_node"), "own").distinct()
    found = filter_nodes(in_groups(entities, groups), filters).join(reached, (F.col("uuid") == F.col("_node")) & (F.col("group_id") == F.col("own")), "left_semi")
    return found.orderBy("uuid").limit(limit) if limit else found


def bfs_edges(edges: DataFrame, origins: DataFrame, depth: int = DEPTH, mentions: DataFrame | None = None, filters: SearchFilters | None = None, groups: list[str] | None = None, limit: int | None = None, entities: DataFrame | None = None) -> DataFrame:
    """RELATES_TO edges on such paths, each once and as it points; MENTIONS only carry on."""
    starts = _reached(_hops(edges, mentions), origins, depth - 1, True).select(F.col("node").alias("_start")).distinct()
    found = filter_edges(in_groups(edges, groups), filters, entities).join(starts, F.col("source_node_uuid") == F.col("_start"), "left_semi")
    return found.orderBy("uuid").limit(limit) if limit else found


def adjacency(entities: DataFrame, edges: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """``group_id, node_uuid, neighbor_uuid, edge_count`` in both directions inside a group; a node without neighbours has one row with null and 0."""
    own = in_groups(entities, groups).select("uuid", "group_id")
    both = edges.select(F.col("source_node_uuid").alias("a"), F.col("target_node_uuid").alias("b"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    counts = both.groupBy("a", "b").agg(F.count("*").alias("edge_count"))
    near = own.select(F.col("uuid").alias("b"), F.col("group_id").alias("near_group"))
    inside = counts.join(near, "b").join(own.select(F.col("uuid").alias("a"), "group_id"), "a").where("group_id = near_group").select("a", "b", "edge_count")
    return own.join(inside, F.col("uuid") == F.col("a"), "left").select("group_id", F.col("uuid").alias("node_uuid"), F.col("b").alias("neighbor_uuid"), F.coalesce("edge_count", F.lit(0).cast("long")).alias("edge_count"))
