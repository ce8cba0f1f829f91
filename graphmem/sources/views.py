"""The graph that the test tables describe: each view is a lazy DataFrame over Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: When records without a time of their own were created.
EPOCH = "2020-01-01 00:00:00"


class Tables:
    """Reads of ``<sf_dir>/<name>.parquet``; only the columns a plan uses reach the scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _labels(kind: str):
    return F.array(F.lit("Entity"), F.lit(kind))


def entity(t: Tables) -> DataFrame:
    """``uuid, name, group_id, labels``: customers, suppliers, nations and regions in the group of their region, parts in ``parts``."""
    places = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))  # a nation is one of 25
    own = places.select("n_nationkey", "r_name")
    parts = [
        t.customer.join(F.broadcast(own), F.col("c_nationkey") == F.col("n_nationkey")).select(_key("c:", "c_custkey").alias("uuid"), F.col("c_name").alias("name"), F.col("r_name").alias("group_id"), _labels("Customer").alias("labels")),
        t.supplier.join(F.broadcast(own), F.col("s_nationkey") == F.col("n_nationkey")).select(_key("s:", "s_suppkey"), "s_name", "r_name", _labels("Supplier")),
        places.select(_key("n:", "n_nationkey"), "n_name", "r_name", _labels("Nation")),
        t.region.select(_key("r:", "r_regionkey"), "r_name", "r_name", _labels("Region")),
        t.part.select(_key("p:", "p_partkey"), "p_name", F.lit("parts"), _labels("Part")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def order_edges(t: Tables) -> DataFrame:
    """ORDERED_FROM, customer to supplier, one for each pair: valid from the first order, episodes are the orders."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey")  # repeated pairs change neither the first order nor the set of orders
    both = t.orders.select("o_orderkey", "o_custkey", "o_orderdate").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    grouped = both.groupBy("o_custkey", "l_suppkey").agg(F.min("o_orderdate").alias("valid_at"), F.array_sort(F.collect_set(_key("o:", "o_orderkey"))).alias("episodes"))
    source, target = _key("c:", "o_custkey"), _key("s:", "l_suppkey")
    return grouped.select(F.concat(F.lit("ord:"), source, F.lit(">"), target).alias("uuid"), source.alias("source_node_uuid"), target.alias("target_node_uuid"), F.lit("ORDERED_FROM").alias("name"), "episodes", F.col("valid_at").cast("timestamp").alias("valid_at"), F.lit(None).cast("timestamp").alias("invalid_at"))


def place_edges(t: Tables) -> DataFrame:
    """LOCATED_IN and PART_OF, without times or episodes."""
    pairs = (
        t.customer.select(_key("c:", "c_custkey").alias("a"), _key("n:", "c_nationkey").alias("b"), F.lit("LOCATED_IN").alias("name"))
        .union(t.supplier.select(_key("s:", "s_suppkey"), _key("n:", "s_nationkey"), F.lit("LOCATED_IN")))
        .union(t.nation.select(_key("n:", "n_nationkey"), _key("r:", "n_regionkey"), F.lit("PART_OF")))
    )
    nothing = F.lit(None).cast("timestamp")
    return pairs.select(F.concat(F.lit("loc:"), "a", F.lit(">"), "b").alias("uuid"), F.col("a").alias("source_node_uuid"), F.col("b").alias("target_node_uuid"), "name", F.array().cast("array<string>").alias("episodes"), nothing.alias("valid_at"), nothing.alias("invalid_at"))


def entity_edge(t: Tables) -> DataFrame:
    return place_edges(t).unionByName(order_edges(t))


def mentions(t: Tables) -> DataFrame:
    """An order mentions its customer and its suppliers."""
    pairs = t.orders.select(_key("o:", "o_orderkey").alias("episode"), _key("c:", "o_custkey").alias("entity"))
    pairs = pairs.union(t.lineitem.select(_key("o:", "l_orderkey"), _key("s:", "l_suppkey")).distinct())
    return pairs.select(F.concat(F.lit("men:"), "episode", F.lit(">"), "entity").alias("uuid"), F.col("episode").alias("source_node_uuid"), F.col("entity").alias("target_node_uuid"))


def episode(t: Tables) -> DataFrame:
    """Turns of conversations; valid from a fixed time on, a minute a turn and an hour a conversation."""
    minutes = F.col("conv_id") * 60 + F.col("turn")
    at = (F.lit(EPOCH).cast("timestamp").cast("long") + minutes * 60).cast("timestamp")
    saga = _key("conv:", "conv_id")
    return t.conversations.select(F.concat(saga, F.lit(":"), F.col("turn").cast("string")).alias("uuid"), saga.alias("saga_uuid"), F.col("role").alias("group_id"), F.lit("message").alias("source"), F.col("text").alias("content"), at.alias("valid_at"), at.alias("created_at"), "turn")


def facts(t: Tables) -> DataFrame:
    """The state of a user, an event at a time."""
    return t.events.select(F.concat(F.lit("ev:"), F.col("event_id").cast("string")).alias("uuid"), _key("u:", "user_id").alias("source_node_uuid"), F.lit("STATE").alias("name"), F.col("event_type").alias("fact"), F.col("ts").cast("timestamp").alias("valid_at"))


def passages(t: Tables) -> DataFrame:
    """Documents as facts to search: text, language as group, and the embedding of the same number where there is one."""
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("fact_embedding"), "label")
    return t.documents.join(vectors, "doc_id", "left").select(_key("d:", "doc_id").alias("uuid"), F.col("text").alias("fact"), F.col("lang").alias("group_id"), F.concat(F.lit("src:"), F.col("source")).alias("source_node_uuid"), "fact_embedding", "label")


def vectors(t: Tables) -> DataFrame:
    """Embeddings as entities of the group of their label."""
    return t.embeddings.select(_key("v:", "vec_id").alias("uuid"), F.concat(F.lit("g"), F.col("label").cast("string")).alias("group_id"), F.col("embedding").alias("name_embedding"))
