"""Hybrid search: four scopes, three methods, five rerankers, sixteen recipes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmem.operators import fulltext, fusion, similarity, traverse
from graphmem.operators.filters import SearchFilters, filter_edges, filter_nodes, in_groups
from graphmem.operators.reads import mention_counts

LIMIT, MIN_SCORE, LAMBDA = 10, 0.6, 0.5


class Method(Enum):
    BM25 = "bm25"
    COSINE = "cosine_similarity"
    BFS = "breadth_first_search"


class Reranker(Enum):
    RRF = "reciprocal_rank_fusion"
    NODE_DISTANCE = "node_distance"
    EPISODE_MENTIONS = "episode_mentions"
    MMR = "mmr"
    CROSS_ENCODER = "cross_encoder"


@dataclass(frozen=True)
class Scope:
    methods: tuple[Method, ...] = (Method.BM25, Method.COSINE)
    reranker: Reranker = Reranker.RRF
    sim_min_score: float = MIN_SCORE
    mmr_lambda: float = LAMBDA
    bfs_max_depth: int = traverse.DEPTH


@dataclass(frozen=True)
class Config:
    edge: Scope | None = None
    node: Scope | None = None
    episode: Scope | None = None
    community: Scope | None = None
    limit: int = LIMIT
    min_score: float = 0.0


_ALL, _TWO, _TEXT = (Method.BM25, Method.COSINE, Method.BFS), (Method.BM25, Method.COSINE), (Method.BM25,)


def _recipes() -> dict[str, Config]:
    """edge and node with each reranker, community with three, all scopes together with three."""
    out: dict[str, Config] = {}
    for scope, rerankers in (("edge", Reranker), ("node", Reranker), ("community", (Reranker.RRF, Reranker.MMR, Reranker.CROSS_ENCODER))):
        for r in rerankers:
            methods = _ALL if r is Reranker.CROSS_ENCODER and scope != "community" else _TWO
            own = Scope(methods, r, mmr_lambda=1.0 if r is Reranker.MMR else LAMBDA)
            out[f"{scope}_hybrid_{r.value}"] = Config(**{scope: own}, limit=3 if (scope, r) == ("community", Reranker.CROSS_ENCODER) else LIMIT)
    for r in (Reranker.RRF, Reranker.MMR, Reranker.CROSS_ENCODER):
        methods = _ALL if r is Reranker.CROSS_ENCODER else _TWO
        own = Scope(methods, r, mmr_lambda=1.0 if r is Reranker.MMR else LAMBDA)
        text = Scope(_TEXT, Reranker.RRF if r is Reranker.MMR else r)
        out[f"combined_hybrid_{r.value}"] = Config(edge=own, node=own, episode=text, community=replace(own, methods=_TWO))
    return out


RECIPES = _recipes()


@dataclass
class Graph:
    """The tables a search reads; None for those it doesn't need."""

    edges: DataFrame | None = None
    nodes: DataFrame | None = None
    episodes: DataFrame | None = None
    communities: DataFrame | None = None
    mentions: DataFrame | None = None


@dataclass
class Request:
    query: str
    vector: list[float] | None = None
    groups: list[str] | None = None
    filters: SearchFilters = field(default_factory=SearchFilters)
    center: str | None = None
    origins: list[str] | None = None
    #: ``scorer(query, text column)`` gives a Column.
    scorer: Callable | None = None


@dataclass
class Results:
    """For each scope the rows found with ``rank`` and ``score``, or None."""

    edges: DataFrame | None = None
    nodes: DataFrame | None = None
    episodes: DataFrame | None = None
    communities: DataFrame | None = None


def needs_vector(config: Config) -> bool:
    scopes = (config.edge, config.node, config.episode, config.community)
    return any(s and (Method.COSINE in s.methods or s.reranker is Reranker.MMR) for s in scopes)


def _lists(rows: DataFrame, text, vector: str | None, scope: Scope, r: Request, limit: int, bfs: Callable[[list[str] | DataFrame], DataFrame] | None) -> list[DataFrame]:
    """Ranked lists of twice the limit, one for each method that can give any."""
    lists = []
    if Method.BM25 in scope.methods:
        lists.append(fulltext.bm25(rows, text, r.query, 2 * limit, r.groups))
    if Method.COSINE in scope.methods and vector and r.vector:
        lists.append(similarity.top_k(rows, vector, r.vector, 2 * limit, scope.sim_min_score, r.groups))
    if Method.BFS in scope.methods and bfs:
        seeds = r.origins if r.origins else fusion.union([x.select("uuid") for x in lists]) if lists else None
        if seeds is not None:
            lists.append(bfs(seeds).orderBy("uuid").limit(2 * limit).withColumn("score", F.lit(0.0)))
    return [fusion.ranked(x, i) for i, x in enumerate(lists)]


def _reranked(lists: list[DataFrame], rows: DataFrame, text: str, vector: str | None, scope: Scope, r: Request, config: Config, few: bool) -> DataFrame:
    """``uuid, score, rank`` by the rerankers that all scopes share."""
    found = fusion.rrf(fusion.union(lists), config.min_score if scope.reranker is Reranker.RRF else 0.0)
    if scope.reranker is Reranker.MMR:
        if not r.vector or not vector:
            raise ValueError("MMR needs a query vector")
        own = found.join(rows.where(F.col(vector).isNotNull()).select("uuid", F.col(vector).alias("embedding")), "uuid")
        return fusion.mmr(own, r.vector, scope.mmr_lambda, config.min_score or -2.0)
    if scope.reranker is Reranker.CROSS_ENCODER:
        return fusion.cross_encode(found, rows.select("uuid", F.col(text).alias("text")), r.scorer, r.query, config.limit if few else None, config.min_score)
    return found


def _rows(found: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """Whole rows, joined late to what was found."""
    return rows.join(F.broadcast(found.where(F.col("rank") <= limit)), "uuid").orderBy("rank")


def search_edges(g: Graph, r: Request, config: Config) -> DataFrame:
    scope, limit = config.edge, config.limit
    rows = filter_edges(g.edges, r.filters, g.nodes)

    def bfs(seeds):
        if isinstance(seeds, DataFrame):
            origins = rows.join(seeds, "uuid", "left_semi").select(F.col("source_node_uuid").alias("uuid"), "group_id").distinct()
        else:
            origins = g.nodes.where(F.col("uuid").isin(seeds)).select("uuid", "group_id")
        return traverse.bfs_edges(g.edges, origins, scope.bfs_max_depth, g.mentions, r.filters, r.groups, entities=g.nodes)

    lists = _lists(rows, fulltext.text_of("fact", "name") if "name" in rows.columns else F.col("fact"), "fact_embedding", scope, r, limit, bfs)
    if scope.reranker is Reranker.NODE_DISTANCE:
        if r.center is None:
            raise ValueError("node distance needs a center")
        found = fusion.rrf(fusion.union(lists))
        own = fusion.edge_node_distance(found, rows, g.edges, r.center).withColumnRenamed("node_score", "score").drop("source_node_uuid")
        return _rows(own, rows, limit)
    if scope.reranker is Reranker.EPISODE_MENTIONS:
        return _rows(fusion.edge_mentions(fusion.rrf(fusion.union(lists)), rows).drop("n_episodes"), rows, limit)
    return _rows(_reranked(lists, rows, "fact", "fact_embedding", scope, r, config, few=True), rows, limit)


def search_nodes(g: Graph, r: Request, config: Config) -> DataFrame:
    scope, limit = config.node, config.limit
    rows = filter_nodes(g.nodes, r.filters)

    def bfs(seeds):
        origins = g.nodes.join(seeds, "uuid", "left_semi") if isinstance(seeds, DataFrame) else g.nodes.where(F.col("uuid").isin(seeds))
        return traverse.bfs_nodes(g.nodes, g.edges, origins.select("uuid", "group_id"), scope.bfs_max_depth, g.mentions, r.filters, r.groups)

    text = fulltext.text_of("name", "summary") if "summary" in rows.columns else F.col("name")
    lists = _lists(rows, text, "name_embedding", scope, r, limit, bfs if g.edges is not None else None)
    if scope.reranker is Reranker.NODE_DISTANCE:
        if r.center is None:
            raise ValueError("node distance needs a center")
        return _rows(fusion.node_distance(fusion.rrf(fusion.union(lists)), g.edges, r.center, config.min_score), rows, limit)
    if scope.reranker is Reranker.EPISODE_MENTIONS:
        return _rows(fusion.episode_mentions(fusion.rrf(fusion.union(lists)), mention_counts(g.mentions), config.min_score), rows, limit)
    return _rows(_reranked(lists, rows, "name", "name_embedding", scope, r, config, few=False), rows, limit)


def search_episodes(g: Graph, r: Request, config: Config) -> DataFrame:
    text = fulltext.text_of("content", *[c for c in ("name", "source_description") if c in g.episodes.columns])
    scope = replace(config.episode, methods=_TEXT)
    lists = _lists(g.episodes, text, None, scope, r, config.limit, None)
    return _rows(_reranked(lists, g.episodes, "content", None, scope, r, config, few=True), g.episodes, config.limit)


def search_communities(g: Graph, r: Request, config: Config) -> DataFrame:
    """Full text and similarity both run, whatever methods are asked for."""
    scope = replace(config.community, methods=_TWO)
    lists = _lists(g.communities, F.col("name"), "name_embedding", scope, r, config.limit, None)
    return _rows(_reranked(lists, g.communities, "name", "name_embedding", scope, r, config, few=False), g.communities, config.limit)


def search(g: Graph, r: Request, config: Config, embed: Callable[[str], list[float]] | None = None) -> Results:
    """All scopes of a recipe, each a lazy DataFrame; a blank query finds nothing, and is never embedded."""
    if not r.query.strip():
        return Results()
    if r.vector is None and embed and needs_vector(config):
        r = replace(r, vector=embed(r.query))
    scopes = (("edge", search_edges, "edges"), ("node", search_nodes, "nodes"), ("episode", search_episodes, "episodes"), ("community", search_communities, "communities"))
    return Results(**{name: run(g, r, config) for scope, run, name in scopes if getattr(config, scope) and getattr(g, name) is not None})


def all_groups(rows: DataFrame) -> DataFrame:
    return in_groups(rows, None).select("group_id").distinct()


#: Indexed tables and the columns of their texts.
INDEXED = {"entity_edge": ("fact", "name"), "entity": ("name", "summary"), "episode": ("content", "name", "source_description"), "community": ("name",)}


def build_indices(store) -> int:
    """Writes a term table and its statistics for each indexed table, under the store's present version; a version that has them is left as it is."""
    version = store.version()
    for name, columns in INDEXED.items():
        fs, done = store._place("index", f"{version:012d}", name, "stats", "_SUCCESS")
        if not fs.exists(done):
            rows = store.table(name, version=version)
            index = fulltext.term_table(rows, fulltext.text_of(*columns))
            index.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{store.path}/index/{version:012d}/{name}/terms")
            rows.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size(fulltext.tokens(fulltext.text_of(*columns)))), F.lit(1.0)).alias("avg_len")).write.mode("overwrite").parquet(f"{store.path}/index/{version:012d}/{name}/stats")
    return version


def search_index(store, name: str, query: str, limit: int = LIMIT, groups: list[str] | None = None) -> DataFrame:
    """``uuid, score`` by BM25 from the stored index of the present version; without one, from the texts."""
    version = store.version()
    folder = f"{store.path}/index/{version:012d}/{name}"
    fs, done = store._place("index", f"{version:012d}", name, "stats", "_SUCCESS")
    if not fs.exists(done):
        return fulltext.bm25(store.table(name, version=version), fulltext.text_of(*INDEXED[name]), query, limit, groups).select("uuid", "score")
    stats = store.spark.read.parquet(f"{folder}/stats").first()
    return fulltext.search_terms(store.spark.read.parquet(f"{folder}/terms"), query, stats["n"], stats["avg_len"], limit, groups)
