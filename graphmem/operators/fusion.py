"""Rank fusion and rerankers over ranked candidate lists.

A candidate list is a DataFrame of ``uuid, score`` (and more); ``ranked`` gives it ``pos`` from 0.  Lists hold at most
twice the limit of a search, so windows without a partition see a few rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphmem.functions import vector


def ranked(hits: DataFrame, list_ix: int) -> DataFrame:
    """``list_ix, pos, uuid`` of a limited list, best first."""
    w = Window.orderBy(F.col("score").desc(), "uuid")
    return hits.select(F.lit(list_ix).alias("list_ix"), (F.row_number().over(w) - 1).alias("pos"), "uuid")


def union(lists: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, lists)


def _with_rank(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rrf(lists: DataFrame, min_score: float = 0.0, constant: int = 1) -> DataFrame:
    """``uuid, score, rank``: the sum of 1 / (pos + constant) over ``list_ix, pos, uuid``; ties as first seen.

    A uuid twice in one list counts twice.  The terms are added in the order of lists and places, so the sum is always the same.
    """
    seen = F.array_sort(F.collect_list(F.struct("list_ix", "pos")))
    summed = lists.groupBy("uuid").agg(seen.alias("seen"))
    score = F.aggregate("seen", F.lit(0.0), lambda s, x: s + 1.0 / (x["pos"] + constant))
    scored = summed.select("uuid", score.alias("score"), F.col("seen")[0].alias("first")).where(F.col("score") >= min_score)
    return _with_rank(scored, F.col("score").desc(), F.col("first.list_ix"), F.col("first.pos")).select("uuid", "score", "rank")


def mmr(found: DataFrame, query: list[float], lam: float = 0.5, min_score: float = -2.0, column: str = "embedding") -> DataFrame:
    """``uuid, score, rank`` of candidates ``uuid, rank, <column>``: lam * relevance - (1 - lam) * greatest similarity to another.

    One pass, not greedy: similarities are dot products of unit vectors, never below 0; the query isn't normalized.  Ties keep the
    candidates' order.  Candidates are a bounded list, of which one side is broadcast.
    """
    unit = found.select("uuid", F.col("rank").alias("was"), vector.normalize_l2(F.col(column)).alias("v"))
    other = unit.select(F.col("uuid").alias("other"), F.col("v").alias("w"))
    pairs = unit.join(F.broadcast(other), F.col("uuid") != F.col("other"), "left")
    near = pairs.groupBy("uuid", "was", "v").agg(F.greatest(F.lit(0.0), F.coalesce(F.max(vector.dot(F.col("v"), F.col("w"))), F.lit(0.0))).alias("near"))
    scored = near.withColumn("score", lam * vector.dot(vector.literal(query), F.col("v")) + (lam - 1) * F.col("near")).where(F.col("score") >= min_score)
    return _with_rank(scored, F.col("score").desc(), "was").select("uuid", "score", "rank")


def connected(found: DataFrame, edges: DataFrame, center: str) -> DataFrame:
    """The candidates one hop from ``center``, in either direction."""
    out = edges.where(F.col("source_node_uuid") == center).select(F.col("target_node_uuid").alias("_near"))
    into = edges.where(F.col("target_node_uuid") == center).select(F.col("source_node_uuid").alias("_near"))
    return found.join(out.unionByName(into), F.col("uuid") == F.col("_near"), "left_semi")


def node_distance(found: DataFrame, edges: DataFrame, center: str, min_score: float = 0.0) -> DataFrame:
    """Neighbours of ``center`` at distance 1, others infinitely far, the center itself at 0.1 and first; the score is 1 / distance."""
    near = connected(found.select("uuid"), edges, center).select("uuid", F.lit(1.0).alias("_hop"))
    far = F.when(F.col("uuid") == center, 0.1).otherwise(F.coalesce("_hop", F.lit(float("inf"))))
    scored = found.select("uuid", F.col("rank").alias("was")).join(near, "uuid", "left").withColumn("distance", far).withColumn("score", 1.0 / F.col("distance")).where(F.col("score") >= min_score)
    return _with_rank(scored, "distance", "was").select("uuid", "score", "rank")


def episode_mentions(found: DataFrame, counts: DataFrame, min_score: float = 0.0) -> DataFrame:
    """By number of mentions, fewest first; what nothing mentions has an infinite score and comes last."""
    scored = found.select("uuid", F.col("rank").alias("was")).join(counts, "uuid", "left").withColumn("score", F.coalesce(F.col("mentions").cast("double"), F.lit(float("inf")))).where(F.col("score") >= min_score)
    return _with_rank(scored, "score", "was").select("uuid", "score", "rank")


def edge_mentions(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the most episodes first; scores stay in the order they had."""
    sized = found.join(edges.select("uuid", F.size("episodes").alias("n_episodes")), "uuid")
    placed = _with_rank(sized.withColumnRenamed("rank", "was"), F.col("n_episodes").desc(), "was").select("uuid", "n_episodes", "rank")
    return placed.join(found.select("rank", "score"), "rank").select("uuid", "score", "rank", "n_episodes")


def edge_node_distance(found: DataFrame, edges: DataFrame, graph: DataFrame, center: str) -> DataFrame:
    """Edges in the order of the distance of their sources, each source's edges together; ``node_score`` is that of the source."""
    own = found.join(edges.select("uuid", "source_node_uuid"), "uuid")
    sources = own.groupBy(F.col("source_node_uuid").alias("uuid")).agg(F.min("rank").alias("rank"))
    nodes = node_distance(sources, graph, center).select(F.col("uuid").alias("source_node_uuid"), F.col("score").alias("node_score"), F.col("rank").alias("node_rank"))
    both = own.withColumnRenamed("rank", "was").join(nodes, "source_node_uuid")
    return _with_rank(both, "node_rank", "was").select("uuid", "source_node_uuid", "node_score", "rank")


def cross_encode(found: DataFrame, texts: DataFrame, scorer, query: str, limit: int | None = None, min_score: float = 0.0) -> DataFrame:
    """Candidates scored by a model: ``scorer(query, text column)`` is a Column.  Of equal texts the first place and the last uuid stay."""
    if scorer is None:
        raise ValueError("cross-encoding needs a client")
    own = found.where(F.col("rank") <= limit) if limit else found
    both = own.join(texts.select("uuid", "text"), "uuid").groupBy("text").agg(F.min("rank").alias("was"), F.max_by("uuid", "rank").alias("uuid"))
    scored = both.withColumn("score", scorer(query, F.col("text"))).where(F.col("score") >= min_score)
    return _with_rank(scored, F.col("score").desc(), "was").select("uuid", "score", "rank")
