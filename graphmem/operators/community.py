"""Communities: label propagation, votes, memberships."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphmem.sources.scratch import discard, written

MAX_ROUNDS = 1000


def label_propagation(adjacency: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``group_id, node_uuid, label`` from an adjacency table (a node without neighbours has a row with a null one).

    A label is the uuid of a node, at first the node's own; only the order of labels counts, so no group is sorted.  In a round all nodes at once take the neighbour label of greatest edge count,
    the larger label of equals: if its count is over 1 as it is, else the larger of it and the own label.
    Rounds go on until nothing changes, or up to a cap.  Labels can swing for ever: each table also holds the labels of an earlier round, ``mark``, moved on at growing distances.  When
    they come back, so will all later ones, and only the rounds left after whole swings are still run: the labels are those of the cap, without most of its rounds.
    A round is two joins on uniform keys with aggregates before the shuffle, and is written before the next one.
    """
    links = written(adjacency.where("neighbor_uuid is not null"), "links")
    own = F.col("node_uuid")
    labels = written(adjacency.select("group_id", "node_uuid").distinct().withColumns({"label": own, "mark": own}), "labels")
    done, marked, last = 0, 0, max_rounds
    while done < last:
        near = labels.select("group_id", F.col("node_uuid").alias("neighbor_uuid"), F.col("label").alias("theirs"))
        votes = links.join(near, ["group_id", "neighbor_uuid"]).groupBy("group_id", "node_uuid", "theirs").agg(F.sum("edge_count").alias("n"))
        best = votes.groupBy("group_id", "node_uuid").agg(F.max(F.struct("n", "theirs")).alias("best"))
        chosen = F.when(F.col("best").isNull(), F.col("label")).when(F.col("best.n") > 1, F.col("best.theirs")).otherwise(F.greatest("best.theirs", "label"))
        if done - marked >= max(2, marked // 2):
            marked, mark = done, "label"
        else:
            mark = "mark"
        after = written(labels.join(best, ["group_id", "node_uuid"], "left").select("group_id", "node_uuid", chosen.alias("label"), F.col("label").alias("was"), F.col(mark).alias("mark")), "labels")
        done += 1
        moved, differs = after.agg(F.max(F.col("label") != F.col("was")), F.max(F.col("label") != F.col("mark"))).first()
        discard(labels)
        labels = after
        if not moved:
            break
        if not differs and last == max_rounds:
            last = done + (max_rounds - done) % (done - marked)
    discard(links)
    return labels.select("group_id", "node_uuid", "label")


def clusters(labels: DataFrame) -> DataFrame:
    """``group_id, uuid, node_uuid``: members of clusters, each named by its smallest member."""
    heads = labels.groupBy("group_id", "label").agg(F.min("node_uuid").alias("uuid"))
    return labels.join(heads, ["group_id", "label"]).select("group_id", "uuid", "node_uuid")


def community_of_member(has_member: DataFrame) -> DataFrame:
    """``node_uuid, community_uuid``: the first community of each member, the smallest uuid; a member is an entity or a community."""
    return has_member.groupBy(F.col("target_node_uuid").alias("node_uuid")).agg(F.min("source_node_uuid").alias("community_uuid"))


def neighbor_communities(edges: DataFrame, has_member: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_uuid, community_uuid``, a row for each edge to a member of the community."""
    both = edges.select(F.col("source_node_uuid").alias("node_uuid"), F.col("target_node_uuid").alias("near")).unionByName(edges.select(F.col("target_node_uuid").alias("node_uuid"), F.col("source_node_uuid").alias("near")))
    own = both.join(nodes.select(F.col("uuid").alias("node_uuid")), "node_uuid", "left_semi")
    return own.join(has_member.select(F.col("target_node_uuid").alias("near"), F.col("source_node_uuid").alias("community_uuid")), "near").select("node_uuid", "community_uuid")


def vote(edges: DataFrame, has_member: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_uuid, community_uuid, is_new``: the community a node is in, else that of most of its neighbours (ties: the smallest uuid)."""
    own = nodes.select(F.col("uuid").alias("node_uuid")).join(community_of_member(has_member), "node_uuid")
    rest = nodes.join(own.select(F.col("node_uuid").alias("uuid")), "uuid", "left_anti")
    counted = neighbor_communities(edges, has_member, rest).groupBy("node_uuid", "community_uuid").agg(F.count("*").alias("n"))
    w = Window.partitionBy("node_uuid").orderBy(F.col("n").desc(), "community_uuid")
    most = counted.withColumn("_rank", F.row_number().over(w)).where("_rank = 1")
    return own.withColumn("is_new", F.lit(False)).unionByName(most.select("node_uuid", "community_uuid", F.lit(True).alias("is_new")))


def summarize(members: DataFrame, combine: Callable[[str, str], str]) -> DataFrame:
    """``uuid, summary, calls`` of ``uuid, node_uuid, summary``: summaries are combined in pairs, level by level; an odd one is carried on.

    A level is a window and an aggregate over all communities at once, so no community is held in one task.
    """
    pair = F.pandas_udf(lambda a, b: pd.Series([combine(x, y) if y is not None else x for x, y in zip(a, b, strict=True)], dtype=object), "string")
    level = members.select("uuid", "summary", F.row_number().over(Window.partitionBy("uuid").orderBy("node_uuid")).alias("pos"), F.lit(0).cast("long").alias("calls"))
    level = written(level, "level")
    while level.where("pos > 1").limit(1).count():
        half = level.groupBy("uuid", F.floor((F.col("pos") - 1) / 2).alias("half")).agg(
            F.max(F.when(F.col("pos") % 2 == 1, F.col("summary"))).alias("a"), F.max(F.when(F.col("pos") % 2 == 0, F.col("summary"))).alias("b"), F.sum("calls").alias("calls")
        )
        level = written(half.select("uuid", pair("a", "b").alias("summary"), (F.col("half") + 1).cast("int").alias("pos"), (F.col("calls") + F.col("b").isNotNull().cast("long")).alias("calls")), "level")
    return level.select("uuid", "summary", "calls")
