"""Duplicate entities and edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphmem.functions import hashed, text, vector
from graphmem.sources.scratch import discard, written

LEAST_JACCARD, OVERLAP_COSINE = 0.9, 0.6
#: Facts of a pool, and parts that a group's edges are dealt into to be searched.
POOL, BLOCKS = 10, 16


def first_of(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def exact_names(nodes: DataFrame) -> DataFrame:
    """``key, group_id, uuid, size``: one canonical node for each normalized name of a group, the smallest uuid."""
    return nodes.groupBy(text.normalize_exact(F.col("name")).alias("key"), "group_id").agg(F.min("uuid").alias("uuid"), F.count("*").alias("size"))


def exact_edges(edges: DataFrame, order: str = "pos") -> DataFrame:
    """Of edges alike in endpoints and normalized fact the first stays."""
    return first_of(edges, ["source_node_uuid", "target_node_uuid", text.normalize_exact(F.col("fact"))], [order])


def lsh_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left_uuid, right_uuid`` that share a band; each side has ``uuid, key`` (a fuzzy name).

    Signatures are made once for each distinct key, after the entropy gate; pairs are of distinct keys of
    the same bands and then of the nodes that carry them.
    """

    def banded(rows: DataFrame, name: str) -> DataFrame:
        keys = rows.where(text.has_high_entropy(F.col("key"))).select("key").distinct()
        return keys.select(F.col("key").alias(name), F.explode(hashed.lsh_bands(text.shingles(F.col("key")))).alias("band"))

    pairs = banded(left, "l").join(banded(right, "r"), "band").select("l", "r").distinct()
    named = pairs.join(left.select(F.col("key").alias("l"), F.col("uuid").alias("left_uuid")), "l").join(right.select(F.col("key").alias("r"), F.col("uuid").alias("right_uuid")), "r")
    return named.select("left_uuid", "right_uuid", F.col("l").alias("left_key"), F.col("r").alias("right_key"))


def resolve(extracted: DataFrame, existing: DataFrame) -> DataFrame:
    """``uuid, resolved_uuid``, null if unresolved: one exact name resolves, several don't; else the best Jaccard of at least 0.9.

    Both sides have ``uuid, name, group_id``; ties go to the smallest uuid.
    """
    own = extracted.withColumn("exact", text.normalize_exact(F.col("name"))).withColumn("key", text.normalize_fuzzy(F.col("name")))
    had = existing.withColumn("exact", text.normalize_exact(F.col("name"))).withColumn("key", text.normalize_fuzzy(F.col("name")))
    same = had.groupBy("exact", "group_id").agg(F.count("*").alias("n"), F.min("uuid").alias("same_uuid"))
    exact = own.join(same, ["exact", "group_id"], "left")
    open_ = exact.where("n is null").select("uuid", "key", "group_id")
    pairs = lsh_candidates(open_.select("uuid", "key"), had.select("uuid", "key"))
    pairs = pairs.join(open_.select(F.col("uuid").alias("left_uuid"), "group_id"), "left_uuid").join(had.select(F.col("uuid").alias("right_uuid"), F.col("group_id").alias("had_group")), "right_uuid").where("group_id = had_group")
    scored = pairs.withColumn("j", text.jaccard(text.shingles(F.col("left_key")), text.shingles(F.col("right_key")))).where(F.col("j") >= LEAST_JACCARD)
    best = first_of(scored, ["left_uuid"], [F.col("j").desc(), "right_uuid"]).select(F.col("left_uuid").alias("uuid"), F.col("right_uuid").alias("near_uuid"))
    return exact.join(best, "uuid", "left").select("uuid", F.when(F.col("n") == 1, F.col("same_uuid")).otherwise(F.col("near_uuid")).alias("resolved_uuid"))


def similar_keys(keys: DataFrame, least: float) -> DataFrame:
    """``a, b, jaccard`` of the pairs of distinct keys (``key``) whose shingles have a Jaccard coefficient of ``least`` or more, over 0.

    Two sets that alike share one of the first n - ceil(least * n) + 1 of their n shingles, in any order of all shingles.  Ordered from rare to
    frequent, the ceil(least * n) - 1 most frequent of a key are left out of the join.
    """
    sets = keys.select("key").distinct().withColumn("s", text.shingles(F.col("key")))
    each = sets.select("key", F.explode("s").alias("x"))
    ranked = each.join(each.groupBy("x").agg(F.count("*").alias("n")), "x").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("r"))
    size = F.size("r")
    first = ranked.select("key", F.explode(F.slice("r", F.lit(1), size - F.ceil(size * F.lit(least) - 1e-9).cast("int") + 1)).alias("g")).select("key", F.col("g.x").alias("x"))
    pairs = first.withColumnRenamed("key", "a").join(first.withColumnRenamed("key", "b"), "x").where("a < b").select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", text.jaccard(F.col("sa"), F.col("sb")).alias("jaccard")).where(F.col("jaccard") >= least)


def edge_candidates(edges: DataFrame, new: DataFrame | None = None, embedding: str = "fact_embedding") -> DataFrame:
    """``uuid, other``: edges of the same endpoints as one of ``new`` (all edges, without it) that share a word with it or have a cosine of 0.6 at least."""

    def sides(rows: DataFrame) -> DataFrame:
        return rows.select("uuid", "source_node_uuid", "target_node_uuid", F.split(F.lower("fact"), r"\s+").alias("w"), F.col(embedding).alias("v"))

    b = sides(edges).select(F.col("uuid").alias("other"), "source_node_uuid", "target_node_uuid", F.col("w").alias("ow"), F.col("v").alias("ov"))
    both = sides(edges if new is None else new).join(b, ["source_node_uuid", "target_node_uuid"]).where("uuid <> other")
    return both.where(F.arrays_overlap("w", "ow") | F.coalesce(vector.cosine(F.col("v"), F.col("ov")) >= OVERLAP_COSINE, F.lit(False))).select("uuid", "other")


def edge_pools(new: DataFrame, known: DataFrame, limit: int = POOL, blocks: int = BLOCKS) -> DataFrame:
    """``uuid, fact, related, existing`` of each new edge: arrays of ``uuid, fact``, best first, ``limit`` at most.

    Facts of the group are ranked by cosine over 0.6 and by shared words, and the reciprocal ranks added.  ``related``: the best
    with the same endpoints; ``existing``: the best of all, without those that are related.  New edges are few; the
    group's edges are dealt into blocks that each new edge goes to, and a block passes on twice the limit of each list.
    """
    a = new.select("uuid", "group_id", F.col("source_node_uuid").alias("s"), F.col("target_node_uuid").alias("t"), text.tokens(F.col("fact")).alias("w"), F.col("fact_embedding").alias("v"))
    b = known.select(F.col("uuid").alias("other"), "group_id", F.col("source_node_uuid").alias("os"), F.col("target_node_uuid").alias("ot"), F.col("fact").alias("other_fact"), text.tokens(F.col("fact")).alias("ow"), F.col("fact_embedding").alias("ov"))
    b = b.withColumn("block", F.pmod(F.xxhash64("other"), F.lit(blocks)).cast("int"))
    both = a.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(b, ["group_id", "block"]).where("uuid <> other")
    scored = both.select("uuid", "block", "other", "other_fact", ((F.col("s") == F.col("os")) & (F.col("t") == F.col("ot"))).alias("pair"), F.coalesce(vector.cosine(F.col("v"), F.col("ov")), F.lit(0.0)).alias("cosine"), F.size(F.array_intersect("w", "ow")).alias("words"))
    scored = scored.where((F.col("words") > 0) | (F.col("cosine") > OVERLAP_COSINE) | F.col("pair"))
    near, like = F.col("cosine") > OVERLAP_COSINE, F.col("words") > 0

    def rank(*key: str, by: str):
        return F.row_number().over(Window.partitionBy(*key).orderBy(F.col(by).desc(), "other"))

    few = scored.withColumn("rc", rank("uuid", "block", by="cosine")).withColumn("rw", rank("uuid", "block", by="words")).withColumn("rp", F.row_number().over(Window.partitionBy("uuid", "block", "pair").orderBy(F.col("cosine").desc(), F.col("words").desc(), "other")))
    few = few.where((F.col("rc") <= 2 * limit) | (F.col("rw") <= 2 * limit) | (F.col("pair") & (F.col("rp") <= 2 * limit)))
    few = few.withColumn("rc", rank("uuid", by="cosine")).withColumn("rw", rank("uuid", by="words"))
    fused = few.withColumn("score", F.when(near, 1.0 / F.col("rc")).otherwise(0.0) + F.when(like, 1.0 / F.col("rw")).otherwise(0.0))
    best = (F.col("score").desc(), F.col("other"))
    placed = fused.withColumn("place", F.row_number().over(Window.partitionBy("uuid").orderBy(*best))).withColumn("own", F.row_number().over(Window.partitionBy("uuid", "pair").orderBy(*best)))
    related = F.col("pair") & (F.col("own") <= limit)
    row = F.struct("place", F.col("other").alias("uuid"), F.col("other_fact").alias("fact"))
    lists = placed.where(related | (F.col("place") <= limit)).groupBy("uuid").agg(F.array_sort(F.collect_list(F.when(related, row))).alias("r"), F.array_sort(F.collect_list(F.when(~related & (F.col("place") <= limit), row))).alias("e"))
    bare = lambda c: F.transform(c, lambda x: F.struct(x["uuid"].alias("uuid"), x["fact"].alias("fact")))
    return lists.select("uuid", bare("r").alias("related"), bare("e").alias("existing")).join(new.select("uuid", "fact"), "uuid")


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``uuid, root``: the smallest uuid of each undirected component.

    Each round takes the least label of all neighbours and then the label's own label, so rounds grow with the
    logarithm of a path; labels are written between rounds.
    """
    both = pairs.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = written(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "pairs")
    labels = written(both.groupBy("x").agg(F.least("x", F.min("y")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), F.col("root").alias("r")), "y").groupBy("x").agg(F.min("r").alias("r"))
        least = labels.join(near, "x").select("x", F.least("root", "r").alias("root"))
        jumped = least.join(least.select(F.col("x").alias("root"), F.col("root").alias("above")), "root").select("x", F.least("root", "above").alias("root"))
        after = written(jumped, "labels")
        moved = after.join(labels.withColumnRenamed("root", "was"), "x").where("root <> was").limit(1).count()
        discard(labels)
        labels = after
        if not moved:
            return labels.select(F.col("x").alias("uuid"), "root")


def directed_closure(pairs: DataFrame, a: str = "a", b: str = "b", order: str = "seq") -> DataFrame:
    """``uuid, root``: pair by pair in order, the root of ``a`` is hung under the root of ``b``.

    What a pair does depends on those before it in its component, so each component runs in order in one
    group; a component is a set of aliases of one entity.
    """
    rows = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(order).alias("seq"))
    own = rows.join(components(rows).withColumnRenamed("uuid", "a"), "a")

    def hang(group: pd.DataFrame) -> pd.DataFrame:
        parent: dict[str, str] = {}

        def find(x: str) -> str:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for x, y in group.sort_values("seq")[["a", "b"]].itertuples(index=False):
            parent[find(x)] = find(y)
        return pd.DataFrame({"uuid": list(parent), "root": [find(x) for x in parent]})

    return own.groupBy("root").applyInPandas(hang, "uuid string, root string")


def remap(rows: DataFrame, mapping: DataFrame, *columns: str) -> DataFrame:
    """``columns`` through ``uuid, root``; what isn't in the map stays."""
    for c in columns:
        one = mapping.select(F.col("uuid").alias("_from"), F.col("root").alias("_to"))
        rows = rows.join(one, F.col(c) == F.col("_from"), "left").withColumn(c, F.coalesce("_to", c)).drop("_from", "_to")
    return rows
