"""Document chunks: stored as entities with a label of their own, found by hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmem.functions import hashed
from graphmem.plans import clients, search
from graphmem.sources.store import GraphStore

LABEL = "DocumentChunk"
RESERVED = ("doc_id", "chunk_index")


def chunked(documents: DataFrame, max_chars: int = 800, overlap: int = 80) -> DataFrame:
    """``documents`` (``doc_id, text``) with a row for each chunk: ``doc_id, chunk_index, text``."""
    return documents.select("doc_id", F.posexplode(hashed.chunk_text(max_chars, overlap)("text")).alias("chunk_index", "text"))


def ingest_chunks(store: GraphStore, chunks: DataFrame, group: str, embedder: clients.Embedder, now: str) -> DataFrame:
    """Upserts ``doc_id, chunk_index, text`` (and ``metadata``, ``embedding``): the id is a function of group, document and index, so a changed text overwrites.

    A vector of another size than the embedder's is an error; metadata never overrides ``doc_id`` and ``chunk_index``.
    """
    rows = chunks.withColumn("doc_id", F.col("doc_id").cast("string"))
    if "embedding" in rows.columns:
        wrong = rows.where(F.size("embedding") != embedder.dim).limit(1).count()
        if wrong:
            raise ValueError(f"vectors must have {embedder.dim} dimensions")
    given = F.coalesce("metadata", F.create_map().cast("map<string,string>")) if "metadata" in rows.columns else F.create_map().cast("map<string,string>")
    own = F.map_filter(given, lambda k, _: ~k.isin(*RESERVED))
    attributes = F.map_concat(own, F.create_map(F.lit("doc_id"), F.col("doc_id"), F.lit("chunk_index"), F.col("chunk_index").cast("string")))
    nodes = rows.select(
        hashed.chunk_uuid(F.lit(group), F.col("doc_id"), F.col("chunk_index")).alias("uuid"), F.col("text").alias("name"), F.lit(group).alias("group_id"), F.array(F.lit("Entity"), F.lit(LABEL)).alias("labels"),
        F.lit(now).cast("timestamp").alias("created_at"), F.lit("").alias("summary"), attributes.alias("attributes"), (F.col("embedding") if "embedding" in rows.columns else F.lit(None).cast("array<float>")).alias("name_embedding"),
    )
    saved = clients.embed_missing(nodes, "name", "name_embedding", embedder)
    store.save(entity=saved)
    return saved


def search_chunks(store: GraphStore, query: str, groups: list[str], embedder: clients.Embedder, limit: int = 10) -> DataFrame:
    """``text, score, group_id, doc_id, chunk_index, metadata``; other entities among the best ``limit`` are dropped after the limit, so fewer may be left."""
    config = search.Config(node=search.Scope(), limit=limit)
    found = search.search(search.Graph(nodes=store.table("entity", groups)), search.Request(query, groups=groups), config, lambda q: embedder.embed([q])[0]).nodes
    hits = found.where(F.array_contains("labels", LABEL))
    return hits.select(F.col("name").alias("text"), "score", "rank", "group_id", F.try_element_at("attributes", F.lit("doc_id")).alias("doc_id"), F.try_element_at("attributes", F.lit("chunk_index")).cast("int").alias("chunk_index"), F.col("attributes").alias("metadata"))
