"""The memory object: one store, its clients, and all operations."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmem.operators import community, maintenance, reads, saga, traverse
from graphmem.functions import text
from graphmem.operators.filters import SearchFilters, checked_group
from graphmem.plans import clients, ingest, rag, search
from graphmem.sources.scratch import written
from graphmem.sources.store import GraphStore


def memory_group(tenant: str) -> str:
    """The group of a tenant's long-term memory."""
    return checked_group(tenant)


def knowledge_group(tenant: str) -> str:
    """The group of a tenant's documents."""
    return f"knowledge:{checked_group(tenant)}"


class Memory:
    """A bi-temporal graph memory over Parquet snapshots."""

    def __init__(self, spark: SparkSession, path: str, extractor: clients.Extractor, embedder: clients.Embedder | None = None, scorer: Callable | None = None, clock: Callable[[], str] | None = None):
        self.store, self.extractor, self.embedder, self.scorer = GraphStore(spark, path), extractor, embedder or clients.HashEmbedder(), scorer
        self.clock = clock or (lambda: datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S.%f"))

    def add_episodes(self, episodes: DataFrame, types: list[str] | None = None, update_communities: bool = False) -> ingest.Ingested:
        types = getattr(self.extractor, "types", None) if types is None else types
        return ingest.add_episodes(self.store, episodes, self.extractor, self.embedder, self.clock(), types, update_communities)

    def add_episode(self, uuid: str, content: str, valid_at: str, group_id: str = "", name: str = "", source: str = "message", source_description: str = "", saga: str | None = None, update_communities: bool = False) -> ingest.Ingested:
        row = [(uuid, name, checked_group(group_id), ["Episodic"], source, source_description, content, valid_at, saga)]
        df = self.store.spark.createDataFrame(row, "uuid string, name string, group_id string, labels array<string>, source string, source_description string, content string, valid_at string, saga string")
        return self.add_episodes(df.withColumn("valid_at", F.col("valid_at").cast("timestamp")), update_communities=update_communities)

    def remove_episodes(self, uuids: list[str]) -> int:
        """An episode that isn't there is an error, and nothing is removed."""
        gone = self.store.table("episode").where(F.col("uuid").isin(uuids)).select("uuid")
        if missing := sorted(set(uuids) - {r[0] for r in gone.collect()}):
            raise KeyError(f"no such episodes: {missing}")
        return ingest.remove_episodes(self.store, gone)

    def add_triplets(self, triplets: DataFrame) -> DataFrame:
        return ingest.add_triplets(self.store, triplets, self.extractor, self.embedder, self.clock())

    def nodes_and_edges_of(self, episodes: list[str]) -> tuple[DataFrame, DataFrame]:
        """What some episodes mention, and the edges that name one of them."""
        own = self.store.table("episode").where(F.col("uuid").isin(episodes)).select("uuid")
        t = self.store.table
        return maintenance.nodes_and_edges_of(t("entity"), t("entity_edge"), t("mentions"), own)

    def search_edges(self, query: str, groups: list[str] | None = None, limit: int = search.LIMIT, center: str | None = None, config: search.Config | None = None) -> DataFrame | None:
        """Edges only: by reciprocal rank, or with a center by the distance of their sources; None for a blank query."""
        recipe = "edge_hybrid_node_distance" if center else "edge_hybrid_reciprocal_rank_fusion"
        return self.search(query, config or search.replace(search.RECIPES[recipe], limit=limit), groups, center=center).edges

    def saga_by_name(self, name: str, group_id: str = "") -> DataFrame:
        return reads.by_name(self.store.table("saga", [group_id]), name, group_id)

    def summarize_sagas(self, uuids: list[str]) -> DataFrame:
        """A saga that isn't there is an error; one without new episodes is not among the rows."""
        own = self.store.table("saga").where(F.col("uuid").isin(uuids)).select("uuid")
        if missing := sorted(set(uuids) - {r[0] for r in own.collect()}):
            raise KeyError(f"no such sagas: {missing}")
        return ingest.summarize_sagas(self.store, own, self.extractor, self.clock())

    def build_indices(self) -> None:
        """Term tables of nodes, edges, episodes and communities, for the present version, in folders of their own."""
        search.build_indices(self.store)

    def retrieve_episodes(self, before: str, n: int = 10, groups: list[str] | None = None, source: str | None = None) -> DataFrame:
        return reads.last_episodes(self.store.table("episode", groups), before, n, groups, source)

    def graph(self, groups: list[str] | None = None) -> search.Graph:
        t = self.store.table
        return search.Graph(t("entity_edge", groups), t("entity", groups), t("episode", groups), t("community", groups), t("mentions", groups))

    def search(self, query: str, config: search.Config | None = None, groups: list[str] | None = None, filters: SearchFilters | None = None, center: str | None = None, origins: list[str] | None = None) -> search.Results:
        request = search.Request(query, None, groups, filters or SearchFilters(), center, origins, self.scorer)
        return search.search(self.graph(groups), request, config or search.RECIPES["combined_hybrid_cross_encoder" if self.scorer else "combined_hybrid_reciprocal_rank_fusion"], lambda q: self.embedder.embed([q])[0])

    def build_communities(self, groups: list[str] | None = None, combine: Callable[[str, str], str] | None = None, describe: Callable[[str], str] | None = None) -> DataFrame:
        """Drops the communities of the groups and builds them anew from label propagation; a cluster of one is none.

        Summaries are combined in pairs and cut at a sentence, and a name describes each; both come from the client unless they are given.
        """
        combine, describe = combine or self.extractor.community_summary, describe or self.extractor.community_name
        entities, at = self.store.table("entity", groups), F.lit(self.clock()).cast("timestamp")
        members = written(community.clusters(community.label_propagation(traverse.adjacency(entities, self.store.table("entity_edge", groups)))), "members")
        large = members.groupBy("uuid").agg(F.count("*").alias("n")).where("n > 1").select("uuid")
        own = members.join(large, "uuid", "left_semi")
        told = community.summarize(own.join(entities.select(F.col("uuid").alias("node_uuid"), F.coalesce(F.nullif("summary", F.lit("")), "name").alias("summary")), "node_uuid"), combine)
        line = F.pandas_udf(lambda summaries: summaries.map(describe), "string")
        summary = text.truncate_at_sentence(F.col("summary"))
        named = own.select("uuid", "group_id").distinct().join(told, "uuid").select(F.concat(F.lit("community:"), "uuid").alias("uuid"), line(summary).alias("name"), "group_id", F.array(F.lit("Community")).alias("labels"), at.alias("created_at"), summary.alias("summary"))
        links = own.select(ingest.derived_uuid(F.lit("member"), "uuid", "node_uuid").alias("uuid"), F.concat(F.lit("community:"), "uuid").alias("source_node_uuid"), F.col("node_uuid").alias("target_node_uuid"), "group_id", at.alias("created_at"))
        rows = {"community": clients.embed_missing(named, "name", "name_embedding", self.embedder), "has_member": links}
        if groups:
            gone = {k: df.join(rows[k].select("uuid"), "uuid", "left_anti") for k, df in self.store.cascade(community=self.store.table("community", groups)).items()}
            self.store.commit(rows, gone)
        else:
            self.store.commit(rows, cleared=("community", "has_member"))
        return self.store.table("community", groups)

    def remove_communities(self) -> None:
        self.store.clear("community", "has_member")

    def saga_contents(self, since: str | None = None) -> DataFrame:
        """Contents of the sagas' episodes, for their summaries."""
        link = self.store.table("has_episode").select(F.col("source_node_uuid").alias("saga_uuid"), F.col("target_node_uuid").alias("uuid"))
        return saga.contents(self.store.table("episode").join(link, "uuid"), F.lit(since).cast("timestamp") if since else None)

    def ingest_chunks(self, chunks: DataFrame, tenant: str) -> DataFrame:
        return rag.ingest_chunks(self.store, chunks, knowledge_group(tenant), self.embedder, self.clock())

    def search_chunks(self, query: str, tenant: str, limit: int = 10) -> DataFrame:
        return rag.search_chunks(self.store, query, [knowledge_group(tenant)], self.embedder, limit)
