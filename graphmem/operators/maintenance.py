"""Removal of episodes, triplets, and rollups of model costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmem.functions.text import union_labels


def removed_with_episodes(edges: DataFrame, mentions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose first episode is one of ``gone``, and entities that no other episode mentions; ``uuid`` each.

    For one episode these are the edges it brought and the nodes mentioned exactly once, by it.
    """
    first = edges.where(F.size("episodes") > 0).select("uuid", F.get("episodes", F.lit(0)).alias("first"))
    dead_edges = first.join(gone.select(F.col("uuid").alias("first")), "first", "left_semi").select("uuid")
    touched = mentions.join(gone.select(F.col("uuid").alias("source_node_uuid")), "source_node_uuid", "left_semi").select("target_node_uuid")
    counts = mentions.join(touched.distinct(), "target_node_uuid", "left_semi").groupBy("target_node_uuid").agg(F.count("*").alias("n"))
    return dead_edges, counts.where("n = 1").select(F.col("target_node_uuid").alias("uuid"))


def nodes_and_edges_of(entities: DataFrame, edges: DataFrame, mentions: DataFrame, episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What some episodes mention, and the edges that name one of them."""
    ends = mentions.join(episodes.select(F.col("uuid").alias("source_node_uuid")), "source_node_uuid", "left_semi").select(F.col("target_node_uuid").alias("_end"))
    named = edges.select("uuid", F.explode("episodes").alias("_episode")).join(episodes.select(F.col("uuid").alias("_episode")), "_episode", "left_semi").select("uuid")
    return entities.join(ends, F.col("uuid") == F.col("_end"), "left_semi"), edges.join(named, "uuid", "left_semi")


def merged_node(resolved: dict[str, Column], given: dict[str, Column]) -> dict[str, Column]:
    """Attributes of both (the given ones win), the given summary unless it is empty, labels of both."""
    kept = F.map_filter(F.coalesce(resolved["attributes"], F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(F.coalesce(given["attributes"], F.create_map().cast("map<string,string>")), k))
    return {
        "attributes": F.map_concat(kept, F.coalesce(given["attributes"], F.create_map().cast("map<string,string>"))),
        "summary": F.when(F.coalesce(given["summary"], F.lit("")) != "", given["summary"]).otherwise(resolved["summary"]),
        "labels": union_labels(resolved["labels"], given["labels"]),
    }


#: Dollars for a million tokens, in and out, by size of model.
PRICES = {"medium": ("0.40", "1.60"), "small": ("0.10", "0.40"), "embedding": ("0.02", "0.00")}


def priced(ledger: DataFrame) -> DataFrame:
    """``ledger`` (``model, tokens_in, tokens_out``) with ``cost``, in millionths of a dollar, exact."""
    cost = F.lit("0.00").cast("decimal(24,2)")
    for model, (into, out) in PRICES.items():
        own = F.col("tokens_in") * F.lit(into).cast("decimal(4,2)") + F.col("tokens_out") * F.lit(out).cast("decimal(4,2)")
        cost = F.when(F.col("model") == model, own.cast("decimal(24,2)")).otherwise(cost)
    return ledger.withColumn("cost", cost)


def cost_rollup(ledger: DataFrame, *by: str) -> DataFrame:
    """Calls, tokens and dollars by the given columns, with subtotals and a grand total (nulls); a row is one call unless it has ``calls``."""
    calls = F.sum("calls") if "calls" in ledger.columns else F.count("*")
    totals = priced(ledger).rollup(*by).agg(calls.alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost"))
    return totals.withColumn("cost", F.col("cost").cast("double") / 1e6)


def monthly(ledger: DataFrame, per_day: int) -> DataFrame:
    """The mean cost of an ``add_episode`` operation, times episodes a day, times 30."""
    each = priced(ledger).where(F.contains("label", F.lit("add_episode"))).groupBy("operation").agg(F.sum("cost").alias("cost"))
    return each.agg((F.avg("cost").cast("double") / 1e6 * per_day * 30).alias("monthly_cost"))
