"""Named queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmem.functions import hashed, text, vector
from graphmem.operators import community, dedup, filters, fulltext, fusion, maintenance, reads, saga, similarity, temporal, traverse
from graphmem.operators.filters import Comparison as C
from graphmem.operators.filters import DateFilter, SearchFilters
from graphmem.plans import clients, search
from graphmem.plans.engine import Memory
from graphmem.sources import scratch, store, views
from graphmem.sources.views import Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- SQL of the views -------------------------------------------------------------------------------------------

ENTITY = """entity as (
    select 'c:' || c_custkey as uuid, c_name as name, r_name as group_id, 'Customer' as label from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    union all select 's:' || s_suppkey, s_name, r_name, 'Supplier' from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    union all select 'n:' || n_nationkey, n_name, r_name, 'Nation' from nation join region on n_regionkey = r_regionkey
    union all select 'r:' || r_regionkey, r_name, r_name, 'Region' from region
    union all select 'p:' || p_partkey, p_name, 'parts', 'Part' from part)"""
PLACES = """place as (
    select 'loc:' || a || '>' || b as uuid, a as source, b as target, name from (
        select 'c:' || c_custkey as a, 'n:' || c_nationkey as b, 'LOCATED_IN' as name from customer
        union all select 's:' || s_suppkey, 'n:' || s_nationkey, 'LOCATED_IN' from supplier
        union all select 'n:' || n_nationkey, 'r:' || n_regionkey, 'PART_OF' from nation))"""
ORDERED = """ordered as (
    select 'ord:c:' || o_custkey || '>s:' || l_suppkey as uuid, 'c:' || o_custkey as source, 's:' || l_suppkey as target, 'ORDERED_FROM' as name, min(o_orderdate) as valid_at,
        list_sort(list(distinct 'o:' || o_orderkey)) as episodes
    from orders join lineitem on o_orderkey = l_orderkey group by o_custkey, l_suppkey)"""
EDGES = f"""{PLACES}, {ORDERED}, edge as (
    select uuid, source, target, name, valid_at, episodes from ordered union all select uuid, source, target, name, null, cast([] as varchar[]) from place)"""
MENTIONS = """mention as (
    select 'o:' || o_orderkey as episode, 'c:' || o_custkey as entity from orders union all select distinct 'o:' || l_orderkey, 's:' || l_suppkey from lineitem)"""
EPISODES = """episode as (
    select 'conv:' || conv_id || ':' || turn as uuid, 'conv:' || conv_id as saga_uuid, role as group_id, text as content, turn,
        timestamp '2020-01-01 00:00:00' + to_minutes(cast(conv_id * 60 + turn as bigint)) as valid_at from conversations)"""
PASSAGES = """passage as (
    select 'd:' || doc_id as uuid, text as fact, lang as group_id, 'src:' || source as source, embedding, label from documents left join embeddings on vec_id = doc_id)"""
VECTORS = "vec as (select 'v:' || vec_id as uuid, 'g' || label as group_id, embedding from embeddings)"
TOKENS = f"regexp_extract_all(translate(lower(coalesce(%s, '')), '{text.ACCENTS[0]}', '{text.ACCENTS[1]}'), '[a-z0-9]+')"
TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _time(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _bm25_sql(name: str, rows: str, column: str, words: str, limit: int, where: str = "true") -> str:
    terms = ", ".join(f"('{t}')" for t in text.query_tokens(words))
    return f"""{name}_t as (select uuid, group_id, {TOKENS % column} as w from {rows}),
    {name}_n as (select cast(count(*) as double) as n, avg(len(w)) as a from {name}_t),
    {name}_f as (select uuid, group_id, l, term, cast(count(*) as double) as tf from (select uuid, group_id, len(w) as l, unnest(w) as term from {name}_t) where term in (select * from (values {terms}) v(x)) group by all),
    {name}_d as (select term, cast(count(*) as double) as d from {name}_f group by term),
    {name} as (select uuid, sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) as score
        from {name}_f join {name}_d using (term), {name}_n where {where} group by uuid order by score desc, uuid limit {limit})"""


def _cosine_sql(name: str, rows: str, limit: int, least: float, query_sql: str = "(select embedding from embeddings where vec_id = 0)", where: str = "true") -> str:
    return f"""{name} as (select * from (select uuid, list_cosine_similarity(cast(embedding as double[]), cast({query_sql} as double[])) as score from {rows}
        where embedding is not null and {where} order by score desc, uuid limit {limit}) where score > {least})"""


def _rrf_sql(*lists: str, least: float = 0.0) -> str:
    ranked = " union all ".join(f"select {i} as list_ix, row_number() over (order by score desc, uuid) - 1 as pos, uuid from {x}" for i, x in enumerate(lists))
    return f"""ranked as ({ranked}),
    fused as (select *, row_number() over (order by score desc, first) as rank from (
        select uuid, sum(1.0 / (pos + 1)) as score, min(list_ix * 1000000 + pos) as first from ranked group by uuid) where score >= {least})"""


def _vector(t: Tables, vec_id: int = 0) -> list[float]:
    return list(t.embeddings.where(F.col("vec_id") == vec_id).select("embedding").first()[0])


WORDS, SIM = "that thandthe this with worthless", 0.2

# --- Reads ---------------------------------------------------------------------------------------------------


@query(f"with {ENTITY} select uuid, name, group_id from entity where uuid in ('c:5', 'n:3', 'r:1')")
def node_scan_by_uuids(t: Tables) -> DataFrame:
    return views.entity(t).where(F.col("uuid").isin("c:5", "n:3", "r:1")).select("uuid", "name", "group_id")


@query(f"with {ENTITY} select uuid, name, cast(pos as bigint) as pos from entity join (values ('c:7', 0), ('s:2', 1), ('c:1', 3)) v(u, pos) on u = uuid")
def nodes_by_uuids_in_order(t: Tables) -> DataFrame:
    return reads.by_uuids(views.entity(t), ["c:7", "s:2", "c:missing", "c:1"]).select("uuid", "name", "pos")


@query(f"with {ENTITY} select uuid, name, label from entity where group_id in ('ASIA', 'EUROPE') and label in ('Nation', 'Supplier')")
def nodes_by_group(t: Tables) -> DataFrame:
    own = reads.by_groups(views.entity(t), ["ASIA", "EUROPE"])
    return filters.with_labels(own, ["Nation", "Supplier"]).select("uuid", "name", F.col("labels")[1].alias("label"))


@query(f"with {EDGES} select uuid, source, target, name from edge where uuid in ('loc:n:1>r:1', 'loc:c:1>n:8', 'loc:s:3>n:1')")
def edges_by_uuids(t: Tables) -> DataFrame:
    own = reads.by_uuids(views.entity_edge(t), ["loc:n:1>r:1", "loc:c:1>n:8", "loc:s:3>n:1"])
    return own.select("uuid", F.col("source_node_uuid").alias("source"), F.col("target_node_uuid").alias("target"), "name")


@query(f"with {EDGES} select uuid, name, array_to_string(episodes, ',') as episodes from edge where source = 'n:1' and target = 'r:1'")
def edges_between_nodes(t: Tables) -> DataFrame:
    return reads.between(views.entity_edge(t), "n:1", "r:1").select("uuid", "name", F.array_join("episodes", ",").alias("episodes"))


@query(f"with {ENTITY}, {MENTIONS} select uuid, name from entity where uuid in (select entity from mention where episode in ('o:1', 'o:2', 'o:3', 'o:32'))")
def mentioned_nodes(t: Tables) -> DataFrame:
    return reads.mentioned(views.entity(t), views.mentions(t), ["o:1", "o:2", "o:3", "o:32"]).select("uuid", "name")


@query("select 'v:' || vec_id as uuid, cast(len(embedding) as int) as dim, round(list_sum(list_transform(cast(embedding as double[]), lambda x: x * x)), 6) as square from embeddings where vec_id in (3, 1, 4)")
def embeddings_for_uuids(t: Tables) -> DataFrame:
    own = reads.embeddings_of(views.vectors(t), ["v:3", "v:1", "v:4", "v:none"], "name_embedding")
    return own.select("uuid", F.size("name_embedding").alias("dim"), F.round(vector.dot(F.col("name_embedding"), F.col("name_embedding")), 6).alias("square"))


@query(f"with {MENTIONS} select entity as uuid, count(*) as mentions from mention group by entity")
def mention_counts(t: Tables) -> DataFrame:
    return reads.mention_counts(views.mentions(t))


@query(f"with {ENTITY} select uuid, label from entity where name = 'ASIA' and group_id = 'ASIA'")
def node_by_name_in_group(t: Tables) -> DataFrame:
    return reads.by_name(views.entity(t), "ASIA", "ASIA").select("uuid", F.col("labels")[1].alias("label"))


@query(f"with {EPISODES} select uuid, cast(pos as bigint) as pos, content from episode join (values ('conv:3:1', 0), ('conv:0:0', 1), ('conv:2:0', 3)) v(u, pos) on u = uuid")
def episodes_by_uuids(t: Tables) -> DataFrame:
    return reads.by_uuids(views.episode(t), ["conv:3:1", "conv:0:0", "conv:none:0", "conv:2:0"]).select("uuid", "pos", "content")


@query(f"with {PASSAGES} select uuid, round(list_sum(list_transform(cast(embedding as double[]), lambda x: x * x)), 6) as square from passage where uuid in ('d:2', 'd:1', 'd:5') and embedding is not null")
def embeddings_for_edges(t: Tables) -> DataFrame:
    own = reads.embeddings_of(views.passages(t), ["d:2", "d:1", "d:5", "d:none"], "fact_embedding")
    return own.select("uuid", F.round(vector.dot(F.col("fact_embedding"), F.col("fact_embedding")), 6).alias("square"))


@query(f"with {ENTITY} select distinct group_id from entity")
def distinct_groups(t: Tables) -> DataFrame:
    return search.all_groups(views.entity(t))


@query(f"""with {ENTITY}, {EDGES}, {MENTIONS}, urgent as (select 'o:' || o_orderkey as e from orders where o_orderpriority = '1-URGENT')
    select 'node' as kind, uuid from entity where uuid in (select entity from mention where episode in (select e from urgent))
    union all select 'edge', uuid from edge where list_has_any(episodes, (select list(e) from urgent))""")
def nodes_and_edges_of_episodes(t: Tables) -> DataFrame:
    """What urgent orders mention, and the edges that name one of them."""
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("uuid"))
    nodes, edges = maintenance.nodes_and_edges_of(views.entity(t), views.entity_edge(t), views.mentions(t), urgent)
    return nodes.select(F.lit("node").alias("kind"), "uuid").unionByName(edges.select(F.lit("edge").alias("kind"), "uuid"))


# --- Filters -------------------------------------------------------------------------------------------------


@query(f"with {EDGES} select name, count(*) as n from edge where name in ('ORDERED_FROM', 'PART_OF') group by name")
def edge_filter_types(t: Tables) -> DataFrame:
    return filters.filter_edges(views.entity_edge(t), SearchFilters(edge_types=["ORDERED_FROM", "PART_OF"])).groupBy("name").agg(F.count("*").alias("n"))


@query(f"with {ENTITY}, {EDGES} select e.uuid, e.name from edge e join entity a on a.uuid = source join entity b on b.uuid = target where a.label in ('Supplier', 'Nation') and b.label in ('Supplier', 'Nation')")
def edge_filter_labels_both_ends(t: Tables) -> DataFrame:
    return filters.filter_edges(views.entity_edge(t), SearchFilters(node_labels=["Supplier", "Nation"]), views.entity(t)).select("uuid", "name")


@query(f"""with {EDGES} select uuid, {TIME.format('valid_at')} as valid_at from edge
    where (valid_at >= timestamp '1995-01-01' and valid_at < timestamp '1995-02-01') or (valid_at > timestamp '1997-06-01' and valid_at <= timestamp '1997-06-15')""")
def edge_filter_date_or_of_ands(t: Tables) -> DataFrame:
    groups = [[DateFilter(C.AT_LEAST, "1995-01-01"), DateFilter(C.LESS, "1995-02-01")], [DateFilter(C.GREATER, "1997-06-01"), DateFilter(C.AT_MOST, "1997-06-15")]]
    return filters.filter_edges(views.entity_edge(t), SearchFilters(valid_at=groups)).select("uuid", _time("valid_at").alias("valid_at"))


@query(f"with {EDGES} select name, count(*) as n from edge where valid_at is null or valid_at <> timestamp '1996-01-01' group by name")
def edge_filter_null_ops(t: Tables) -> DataFrame:
    groups = [[DateFilter(C.IS_NULL)], [DateFilter(C.NOT_EQUALS, "1996-01-01")]]
    return filters.filter_edges(views.entity_edge(t), SearchFilters(valid_at=groups)).groupBy("name").agg(F.count("*").alias("n"))


@query(f"with {ENTITY} select group_id, count(*) as n from entity where group_id = 'AFRICA' group by group_id")
def group_isolation(t: Tables) -> DataFrame:
    return filters.in_groups(views.entity(t), ["AFRICA"]).groupBy("group_id").agg(F.count("*").alias("n"))


# --- Similarity and full text -----------------------------------------------------------------------------------


@query(f"with {VECTORS}, {_cosine_sql('hit', 'vec', 10, SIM)} select uuid, round(score, 6) as score from hit")
def cosine_topk_nodes(t: Tables) -> DataFrame:
    return similarity.top_k(views.vectors(t), "name_embedding", _vector(t), 10, SIM).select("uuid", F.round("score", 6).alias("score"))


@query(f"with {VECTORS}, {_cosine_sql('hit', 'vec', 5, 0.1, where=chr(39).join(['group_id in (', 'g1', ', ', 'g2', ')']))} select uuid, round(score, 6) as score from hit")
def cosine_topk_filtered(t: Tables) -> DataFrame:
    return similarity.top_k(views.vectors(t), "name_embedding", _vector(t), 5, 0.1, ["g1", "g2"]).select("uuid", F.round("score", 6).alias("score"))


@query(f"with {VECTORS}, {_cosine_sql('hit', 'vec', 50, 0.99)} select uuid, round(score, 6) as score from hit")
def cosine_strict_threshold(t: Tables) -> DataFrame:
    return similarity.top_k(views.vectors(t), "name_embedding", _vector(t), 50, 0.99).select("uuid", F.round("score", 6).alias("score"))


@query(f"""with {VECTORS}, pair as (select q.uuid as query_uuid, v.uuid, list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])) as score
    from vec q join vec v using (group_id) where cast(q.uuid[3:] as bigint) % 100 = 0)
    select query_uuid, uuid, cast(rank as int) as rank, round(score, 6) as score from (select *, row_number() over (partition by query_uuid order by score desc, uuid) as rank from pair where score > 0.15) where rank <= 15""")
def node_candidates(t: Tables) -> DataFrame:
    """For every embedding whose number 100 divides, the nearest of all rows of its group, in 16 blocks."""
    v = views.vectors(t)
    asked = v.where("bigint(substring(uuid, 3)) % 100 = 0").select(F.col("uuid").alias("query_uuid"), "group_id", F.col("name_embedding").alias("vector"))
    return similarity.candidates(asked, v, "name_embedding", 15, 0.15, 16).select("query_uuid", "uuid", "rank", F.round("score", 6).alias("score"))


@query(f"with {PASSAGES}, {_bm25_sql('hit', 'passage', 'fact', WORDS, 20)} select uuid, round(score, 6) as score from hit")
def bm25_documents_topk(t: Tables) -> DataFrame:
    return fulltext.bm25(views.passages(t), F.col("fact"), WORDS, 20).select("uuid", F.round("score", 6).alias("score"))


@query(f"with {EPISODES}, {_bm25_sql('hit', 'episode', 'content', WORDS, 10, chr(39).join(['group_id in (', 'user', ')']))} select uuid, round(score, 6) as score from hit")
def bm25_episodes_topk(t: Tables) -> DataFrame:
    return fulltext.bm25(views.episode(t), F.col("content"), WORDS, 10, ["user"]).select("uuid", F.round("score", 6).alias("score"))


@query(f"with {PASSAGES}, {_bm25_sql('hit', 'passage', 'fact', WORDS, 20)} select uuid, round(score, 6) as score from hit")
def bm25_from_term_table(t: Tables) -> DataFrame:
    """Passages saved as facts of a store, found through its stored index."""
    graph = _store(t, "index")
    graph.save(entity_edge=views.passages(t).select("uuid", "fact", "group_id"))
    search.build_indices(graph)
    return search.search_index(graph, "entity_edge", WORDS, 20).select("uuid", F.round("score", 6).alias("score"))


@query(f"with {PASSAGES} select uuid from passage where contains(lower(fact), 'of the') order by uuid limit 25")
def fulltext_contains(t: Tables) -> DataFrame:
    return fulltext.contains(views.passages(t), F.col("fact"), "of THE", 25).select("uuid")


# --- Fusion and rerankers ---------------------------------------------------------------------------------------


def _fused(t: Tables, limit: int = 20) -> DataFrame:
    rows = views.passages(t)
    lists = [fulltext.bm25(rows, F.col("fact"), WORDS, limit), similarity.top_k(rows, "fact_embedding", _vector(t), limit, SIM)]
    return fusion.rrf(fusion.union([fusion.ranked(x, i) for i, x in enumerate(lists)]))


FUSED = f"{PASSAGES}, {_bm25_sql('b', 'passage', 'fact', WORDS, 20)}, {_cosine_sql('v', 'passage', 20, SIM)}, {_rrf_sql('b', 'v')}"


@query(f"with {FUSED} select uuid, round(score, 6) as score, cast(rank as int) as rank from fused")
def rrf_fuse_two_lists(t: Tables) -> DataFrame:
    return _fused(t).select("uuid", F.round("score", 6).alias("score"), "rank")


@query(f"with {FUSED} select uuid, round(score, 6) as score, cast(rank as int) as rank from fused where score >= 0.25")
def rrf_min_score(t: Tables) -> DataFrame:
    rows = views.passages(t)
    lists = [fulltext.bm25(rows, F.col("fact"), WORDS, 20), similarity.top_k(rows, "fact_embedding", _vector(t), 20, SIM)]
    return fusion.rrf(fusion.union([fusion.ranked(x, i) for i, x in enumerate(lists)]), 0.25).select("uuid", F.round("score", 6).alias("score"), "rank")


@query(f"with {FUSED} select uuid, group_id, round(score, 6) as score, cast(rank as int) as rank from fused join passage using (uuid) where rank <= 10")
def edge_hybrid_rrf(t: Tables) -> DataFrame:
    config = search.RECIPES["edge_hybrid_reciprocal_rank_fusion"]
    config = search.replace(config, edge=search.replace(config.edge, sim_min_score=SIM))
    found = search.search(search.Graph(edges=views.passages(t)), search.Request(WORDS, _vector(t)), config).edges
    return found.select("uuid", "group_id", F.round("score", 6).alias("score"), "rank")


NAMED = """named as (select 'p:' || p_partkey as uuid, p_name as name, 'parts' as group_id, embedding from part left join embeddings on vec_id = p_partkey)"""


def _named(t: Tables) -> DataFrame:
    vectors = t.embeddings.select(F.col("vec_id").alias("p_partkey"), F.col("embedding").alias("name_embedding"))
    return t.part.join(vectors, "p_partkey", "left").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("uuid"), F.col("p_name").alias("name"), F.lit("parts").alias("group_id"), "name_embedding")


@query(f"with {NAMED}, {_bm25_sql('b', 'named', 'name', 'red blue bolt', 20)}, {_cosine_sql('v', 'named', 20, SIM)}, {_rrf_sql('b', 'v')} select uuid, name, round(score, 6) as score, cast(rank as int) as rank from fused join named using (uuid) where rank <= 10")
def node_hybrid_rrf(t: Tables) -> DataFrame:
    config = search.Config(node=search.Scope(sim_min_score=SIM))
    found = search.search(search.Graph(nodes=_named(t)), search.Request("red blue bolt", _vector(t)), config).nodes
    return found.select("uuid", "name", F.round("score", 6).alias("score"), "rank")


@query(f"with {EPISODES}, {_bm25_sql('b', 'episode', 'content', WORDS, 20)}, {_rrf_sql('b')} select uuid, round(score, 6) as score, cast(rank as int) as rank from fused where rank <= 10")
def episode_bm25_rrf(t: Tables) -> DataFrame:
    found = search.search(search.Graph(episodes=views.episode(t)), search.Request(WORDS), search.Config(episode=search.Scope())).episodes
    return found.select("uuid", F.round("score", 6).alias("score"), "rank")


@query(f"with {NAMED}, {_bm25_sql('b', 'named', 'name', 'green steel', 20)}, {_cosine_sql('v', 'named', 20, SIM)}, {_rrf_sql('b', 'v')} select uuid, round(score, 6) as score, cast(rank as int) as rank from fused where rank <= 10")
def community_hybrid_rrf(t: Tables) -> DataFrame:
    config = search.Config(community=search.Scope(methods=(search.Method.BM25,), sim_min_score=SIM))
    found = search.search(search.Graph(communities=_named(t)), search.Request("green steel", _vector(t)), config).communities
    return found.select("uuid", F.round("score", 6).alias("score"), "rank")


@query(f"""with {VECTORS}, {_cosine_sql('hit', 'vec', 20, SIM)},
    unit as (select uuid, row_number() over (order by score desc, uuid) as was, list_transform(cast(embedding as double[]), lambda x: x / sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[])))) as v from hit join vec using (uuid)),
    near as (select a.uuid, a.was, a.v, greatest(0, coalesce(max(list_dot_product(a.v, b.v)), 0)) as near from unit a left join unit b on a.uuid <> b.uuid group by all),
    scored as (select uuid, was, 0.5 * list_dot_product(v, cast((select embedding from embeddings where vec_id = 0) as double[])) - 0.5 * near as score from near)
    select uuid, round(score, 6) + 0.0 as score, cast(row_number() over (order by score desc, was) as int) as rank from scored""")
def mmr_rerank(t: Tables) -> DataFrame:
    q, rows = _vector(t), views.vectors(t)
    hits = fusion.rrf(fusion.ranked(similarity.top_k(rows, "name_embedding", q, 20, SIM), 0))
    own = hits.join(rows.select("uuid", F.col("name_embedding").alias("embedding")), "uuid")
    return fusion.mmr(own, q, 0.5).select("uuid", (F.round("score", 6) + 0.0).alias("score"), "rank")


CHOSEN = "chosen as (select uuid, row_number() over (order by uuid) as was from entity where uuid in ('c:1', 'c:2', 's:1', 's:2', 's:3', 'n:1', 'n:2', 'n:8', 's:4'))"
LINKED = "linked as (select target as near from edge where source = 'c:1' union select source from edge where target = 'c:1')"


def _chosen(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    ids = ["c:1", "c:2", "s:1", "s:2", "s:3", "n:1", "n:2", "n:8", "s:4"]
    return views.entity(t).where(F.col("uuid").isin(ids)).select("uuid", F.row_number().over(Window.orderBy("uuid")).alias("rank"))


@query(f"""with {ENTITY}, {EDGES}, {CHOSEN}, {LINKED}, d as (select uuid, was, case when uuid = 'c:1' then 0.1 when uuid in (select near from linked) then 1.0 else cast('infinity' as double) end as distance from chosen)
    select uuid, round(1.0 / distance, 6) as score, cast(row_number() over (order by distance, was) as int) as rank from d""")
def node_distance_rerank(t: Tables) -> DataFrame:
    return fusion.node_distance(_chosen(t), views.entity_edge(t), "c:1").select("uuid", F.round("score", 6).alias("score"), "rank")


@query(f"with {ENTITY}, {EDGES}, {CHOSEN}, {LINKED} select uuid from chosen where uuid in (select near from linked)")
def connected_to_center(t: Tables) -> DataFrame:
    return fusion.connected(_chosen(t).select("uuid"), views.entity_edge(t), "c:1")


@query(f"""with {ENTITY}, {MENTIONS}, {CHOSEN}, n as (select uuid, was, count(entity) as n from chosen left join mention on entity = uuid group by uuid, was)
    select uuid, case when n = 0 then 'inf' else cast(n as varchar) end as score, cast(row_number() over (order by n = 0, n, was) as int) as rank from n""")
def episode_mentions_node_asc(t: Tables) -> DataFrame:
    found = fusion.episode_mentions(_chosen(t), reads.mention_counts(views.mentions(t)))
    shown = F.when(F.col("score") == float("inf"), "inf").otherwise(F.col("score").cast("long").cast("string"))
    return found.select("uuid", shown.alias("score"), "rank")


SOME = "few as (select uuid, len(episodes) as n, row_number() over (order by uuid) as was from edge where source = 'c:1' or source = 'c:2' or source = 'c:4')"


def _some(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    return views.entity_edge(t).where(F.col("source_node_uuid").isin("c:1", "c:2", "c:4")).select("uuid", F.row_number().over(Window.orderBy("uuid")).alias("rank")).withColumn("score", 1.0 / F.col("rank"))


@query(f"with {EDGES}, {SOME} select uuid, cast(n as int) as n_episodes, cast(rank as int) as rank, round(1.0 / rank, 6) as score from (select *, row_number() over (order by n desc, was) as rank from few)")
def episode_mentions_edge_desc(t: Tables) -> DataFrame:
    return fusion.edge_mentions(_some(t), views.entity_edge(t)).select("uuid", "n_episodes", "rank", F.round("score", 6).alias("score"))


@query(f"""with {EDGES}, {SOME}, own as (select few.*, source from few join edge using (uuid)), src as (select source, min(was) as was from own group by source),
    near as (select target as x from edge where source = 'n:8' union select source from edge where target = 'n:8'),
    d as (select source, was, case when source = 'n:8' then 0.1 when source in (select x from near) then 1.0 else cast('infinity' as double) end as distance from src),
    r as (select source, 1.0 / distance as node_score, row_number() over (order by distance, was) as node_rank from d)
    select uuid, source as source_node_uuid, round(node_score, 6) as node_score, cast(row_number() over (order by node_rank, own.was) as int) as rank from own join r using (source)""")
def edge_node_distance(t: Tables) -> DataFrame:
    edges = views.entity_edge(t)
    return fusion.edge_node_distance(_some(t), edges, edges, "n:8").select("uuid", "source_node_uuid", F.round("node_score", 6).alias("node_score"), "rank")


@query(f"""with {FUSED}, own as (select fact, min(rank) as was, max_by(uuid, rank) as uuid from fused join passage using (uuid) where rank <= 10 group by fact),
    scored as (select uuid, was, (len(fact) % 101) / 100.0 as score from own)
    select uuid, round(score, 6) as score, cast(row_number() over (order by score desc, was) as int) as rank from scored where score >= 0.2""")
def cross_encoder_scripted(t: Tables) -> DataFrame:
    texts = views.passages(t).select("uuid", F.col("fact").alias("text"))
    found = fusion.cross_encode(_fused(t), texts, lambda q, c: (F.length(c) % 101) / 100.0, WORDS, 10, 0.2)
    return found.select("uuid", F.round("score", 6).alias("score"), "rank")


# --- Traversal -------------------------------------------------------------------------------------------------


def _walk(depth: int, start: str) -> str:
    return f"""{ENTITY}, {EDGES}, links as (select distinct source, target from edge),
    walk as (select * from (with recursive w(node, d) as (select '{start}', 0 union select target, d + 1 from w join links on source = node where d < {depth}) select * from w))"""


def _origin(t: Tables, uuid: str) -> DataFrame:
    return views.entity(t).where(F.col("uuid") == uuid).select("uuid", "group_id")


def _bfs(t: Tables, uuid: str, depth: int) -> DataFrame:
    return traverse.bfs_nodes(views.entity(t), views.entity_edge(t), _origin(t, uuid), depth).select("uuid", "name")


@query(f"with {_walk(1, 'c:1')} select uuid, name from entity where uuid in (select node from walk where d > 0) and group_id = (select group_id from entity where uuid = 'c:1')")
def bfs_nodes_d1(t: Tables) -> DataFrame:
    return _bfs(t, "c:1", 1)


@query(f"with {_walk(3, 'c:1')} select uuid, name from entity where uuid in (select node from walk where d > 0) and group_id = (select group_id from entity where uuid = 'c:1')")
def bfs_nodes_d3(t: Tables) -> DataFrame:
    return _bfs(t, "c:1", 3)


@query(f"with {_walk(1, 'c:1')} select uuid, name from edge where source in (select node from walk)")
def bfs_edges_d2(t: Tables) -> DataFrame:
    return traverse.bfs_edges(views.entity_edge(t), _origin(t, "c:1"), 2).select("uuid", "name")


@query(f"with {_walk(2, 'c:2')} select uuid, name from entity where uuid in (select node from walk where d > 0) and group_id = (select group_id from entity where uuid = 'c:2') and group_id = 'AMERICA'")
def bfs_group_scope(t: Tables) -> DataFrame:
    return traverse.bfs_nodes(views.entity(t), views.entity_edge(t), _origin(t, "c:2"), 2, groups=["AMERICA"]).select("uuid", "name")


@query(f"""with {ENTITY}, {EDGES}, both_ as (select source as a, target as b from edge where source <> target union all select target, source from edge where source <> target),
    n as (select x.group_id, a, b, count(*) as edge_count from both_ join entity x on x.uuid = a join entity y on y.uuid = b and y.group_id = x.group_id group by all)
    select e.group_id, e.uuid as node_uuid, b as neighbor_uuid, coalesce(edge_count, 0) as edge_count from entity e left join n on a = e.uuid""")
def adjacency_projection(t: Tables) -> DataFrame:
    return traverse.adjacency(views.entity(t), views.entity_edge(t))


# --- Communities -----------------------------------------------------------------------------------------------


def _propagated(rounds: int) -> str:
    """Rounds of votes, one after the other; those after labels have settled change nothing."""
    steps = [
        f"""b{i} as (select group_id, node, max({{'n': n, 't': t}}) as b from (select a.group_id, a.node_uuid as node, l.label as t, sum(edge_count) as n from adj a join l{i} l on l.group_id = a.group_id and l.node = a.neighbor_uuid group by all) group by all),
        l{i + 1} as materialized (select group_id, node, case when b is null then label when b.n > 1 then b.t else greatest(b.t, label) end as label from l{i} left join b{i} using (group_id, node))"""
        for i in range(rounds)
    ]
    return ", ".join([f"adj as materialized ({SQL['adjacency_projection']})", "l0 as materialized (select distinct group_id, node_uuid as node, node_uuid as label from adj)", *steps])


@query(f"with {_propagated(30)} select group_id, min(node) over (partition by group_id, label) as uuid, node as node_uuid from l30")
def label_propagation_clusters(t: Tables) -> DataFrame:
    """Labels by explicit rounds, until nothing changes; the tests hold it against a loop over dictionaries as well."""
    return community.clusters(community.label_propagation(traverse.adjacency(views.entity(t), views.entity_edge(t))))


MEMBERS = "member as (select 'com:' || s_nationkey as com, 's:' || s_suppkey as node from supplier where s_suppkey % 2 = 0)"


def _members(t: Tables) -> DataFrame:
    return t.supplier.where("s_suppkey % 2 = 0").select(F.concat(F.lit("com:"), F.col("s_nationkey").cast("string")).alias("source_node_uuid"), F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("target_node_uuid"))


@query(f"with {MEMBERS} select node as node_uuid, min(com) as community_uuid from member group by node")
def community_of_member(t: Tables) -> DataFrame:
    return community.community_of_member(_members(t))


@query(f"""with {ENTITY}, {EDGES}, {MEMBERS}, who as (select uuid from entity where label in ('Customer', 'Supplier')), own as (select node as node_uuid, min(com) as community_uuid from member group by node),
    both_ as (select source as a, target as b from edge union all select target, source from edge),
    n as (select a, com, count(*) as n from both_ join member on node = b where a in (select uuid from who) and a not in (select node_uuid from own) group by a, com)
    select node_uuid, community_uuid, false as is_new from own union all select a, com, true from (select *, row_number() over (partition by a order by n desc, com) as r from n) where r = 1""")
def neighbor_vote_mode(t: Tables) -> DataFrame:
    who = filters.with_labels(views.entity(t), ["Customer", "Supplier"]).select("uuid")
    return community.vote(views.entity_edge(t), _members(t), who)


# --- Episodes and sagas ----------------------------------------------------------------------------------------


@query(f"""with {EPISODES} select uuid, cast(row_number() over (order by valid_at, uuid) as int) as rank from (
    select * from episode where valid_at <= timestamp '2020-01-03 00:00:00' and group_id = 'user' order by valid_at desc, uuid desc limit 10)""")
def retrieve_last_n(t: Tables) -> DataFrame:
    return reads.last_episodes(views.episode(t), "2020-01-03 00:00:00", 10, ["user"], "message").select("uuid", "rank")


@query(f"""with {EPISODES}, r as (select *, row_number() over (partition by saga_uuid order by valid_at desc, uuid desc) as r from episode)
    select a.uuid, b.uuid as previous_uuid from r a left join r b on a.saga_uuid = b.saga_uuid and b.r = case when a.r = 1 then 2 else 1 end""")
def previous_episode(t: Tables) -> DataFrame:
    return saga.previous_episode(views.episode(t))


@query(f"with {EPISODES} select * from (select saga_uuid, lag(uuid) over (partition by saga_uuid order by valid_at, uuid) as source_node_uuid, uuid as target_node_uuid from episode) where source_node_uuid is not null")
def next_episode_chain(t: Tables) -> DataFrame:
    return saga.next_episodes(views.episode(t))


@query(f"""with {EPISODES} select saga_uuid, cast(row_number() over (partition by saga_uuid order by valid_at, uuid) as int) as rank, uuid, content
    from episode where valid_at > timestamp '2020-01-02 00:00:00' qualify row_number() over (partition by saga_uuid order by valid_at, uuid) <= 3""")
def saga_contents_since(t: Tables) -> DataFrame:
    return saga.contents(views.episode(t), F.lit("2020-01-02 00:00:00").cast("timestamp"), 3).select("saga_uuid", "rank", "uuid", "content")


@query(f"""with {EPISODES}, last as (select * from episode qualify row_number() over (partition by saga_uuid order by valid_at desc, uuid desc) <= 2)
    select saga_uuid, cast(row_number() over (partition by saga_uuid order by valid_at, uuid) as int) as rank, uuid, content from last""")
def saga_latest_n(t: Tables) -> DataFrame:
    return saga.contents(views.episode(t), None, 2).select("saga_uuid", "rank", "uuid", "content")


@query(f"""with {EPISODES} select saga_uuid, arg_min(uuid, (valid_at, uuid)) as first_episode_uuid, arg_max(uuid, (valid_at, uuid)) as last_episode_uuid, {TIME.format('min(valid_at)')} as created_at,
    {TIME.format('max(valid_at)')} as watermark, count(*) as n_episodes from episode group by saga_uuid""")
def saga_pointers(t: Tables) -> DataFrame:
    return saga.pointers(views.episode(t)).select("saga_uuid", "first_episode_uuid", "last_episode_uuid", _time("created_at").alias("created_at"), _time("watermark").alias("watermark"), "n_episodes")


# --- Time ------------------------------------------------------------------------------------------------------

NOW = "2030-01-01 00:00:00"
HISTORY = "history as (select 'ev:' || event_id as uuid, 'u:' || user_id as source, event_type as fact, ts as valid_at, lead(ts) over (partition by user_id order by ts) as invalid_at from events)"


def _history(t: Tables) -> DataFrame:
    return temporal.timeline(views.facts(t), F.lit(NOW).cast("timestamp"), "source_node_uuid")


@query(f"with {HISTORY} select uuid, {TIME.format('invalid_at')} as invalid_at, case when invalid_at is not null then '{NOW}' end as expired_at from history")
def contradiction_timeline(t: Tables) -> DataFrame:
    return _history(t).select("uuid", _time("invalid_at").alias("invalid_at"), _time("expired_at").alias("expired_at"))


@query(f"""with pair as (select 'ev:' || a.event_id as new_uuid, 'ev:' || b.event_id as old_uuid, a.ts as new_valid, b.ts as old_valid, case when b.event_id % 3 = 0 then b.ts + to_minutes(60) end as old_invalid
    from events a join events b using (user_id) where a.event_id % 100 = 0 and a.event_id <> b.event_id)
    select new_uuid, old_uuid, case when not coalesce(old_invalid <= new_valid, false) and old_valid < new_valid then {TIME.format('new_valid')} else {TIME.format('old_invalid')} end as invalid_at,
        case when not coalesce(old_invalid <= new_valid, false) and old_valid < new_valid then '{NOW}' end as expired_at from pair""")
def contradiction_pairs(t: Tables) -> DataFrame:
    """Every event whose number 100 divides as a new fact, against all facts of its user."""
    return _contradiction_pairs(t, "event_id % 100 = 0")


def _contradiction_pairs(t: Tables, which: str) -> DataFrame:
    f = t.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    old = f.select("user_id", F.col("event_id").alias("old_id"), F.col("ts").alias("old_valid"), F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("interval 60 minutes")).alias("old_invalid"), F.lit(None).cast("timestamp").alias("old_expired"))
    new = f.where(which).select("user_id", "event_id", F.col("ts").alias("new_valid"), F.lit(None).cast("timestamp").alias("new_invalid"))
    pairs = new.join(old, "user_id").where("event_id <> old_id")
    closed = temporal.close_contradicted(pairs, F.lit(NOW).cast("timestamp"))
    return closed.select(F.concat(F.lit("ev:"), F.col("event_id").cast("string")).alias("new_uuid"), F.concat(F.lit("ev:"), F.col("old_id").cast("string")).alias("old_uuid"), _time("invalid_at").alias("invalid_at"), _time("expired_at").alias("expired_at"))


@query(f"""select 'ev:' || a.event_id as uuid, {TIME.format('min(b.ts)')} as invalid_at, case when min(b.ts) is not null then '{NOW}' end as expired_at
    from events a left join events b on a.user_id = b.user_id and b.ts > a.ts group by a.event_id""")
def expire_new_edge(t: Tables) -> DataFrame:
    """Each event as a new edge: the next distinct time of its user, in one window."""
    return _history(t).select("uuid", _time("invalid_at").alias("invalid_at"), _time("expired_at").alias("expired_at"))


@query(f"with {HISTORY}, mid as (select max(ts) - (max(ts) - min(ts)) / 2 as m, date_trunc('day', to_timestamp((epoch(max(ts)) + epoch(min(ts))) / 2)::timestamp) as d from events) select uuid, source, fact from history, mid where valid_at <= d and (invalid_at is null or invalid_at > d)")
def point_in_time_facts(t: Tables) -> DataFrame:
    span = t.events.agg(((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) + F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 2e6).alias("m")).first()
    at = F.date_trunc("day", F.lit(span["m"]).cast("timestamp"))
    return temporal.valid_at(_history(t), at).select("uuid", F.col("source_node_uuid").alias("source"), "fact")


@query(f"with {HISTORY} select uuid, source, fact from history where invalid_at is null")
def live_facts(t: Tables) -> DataFrame:
    return temporal.live(_history(t)).select("uuid", F.col("source_node_uuid").alias("source"), "fact")


# --- Duplicates ------------------------------------------------------------------------------------------------

EXACT, FUZZY = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))", r"trim(regexp_replace(regexp_replace(lower(trim(regexp_replace({}, '\s+', ' ', 'g'))), '[^a-z0-9'' ]', ' ', 'g'), '\s+', ' ', 'g'))"


def _parts(t: Tables) -> DataFrame:
    return t.part.select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("uuid"), F.col("p_name").alias("name"), F.col("p_brand").alias("group_id"))


@query(f"select {EXACT.format('p_name')} as key, p_brand as group_id, min('p:' || p_partkey) as uuid, count(*) as size from part group by 1, 2")
def exact_name_dedup(t: Tables) -> DataFrame:
    return dedup.exact_names(_parts(t))


@query(f"""select uuid from (select 'ev:' || event_id as uuid, row_number() over (partition by user_id, user_id % 5, {EXACT.format('event_type')} order by event_id) as r from events) where r = 1""")
def edge_exact_dedup(t: Tables) -> DataFrame:
    rows = t.events.select(F.concat(F.lit("ev:"), F.col("event_id").cast("string")).alias("uuid"), F.col("user_id").alias("source_node_uuid"), (F.col("user_id") % 5).alias("target_node_uuid"), F.col("event_type").alias("fact"), F.col("event_id").alias("pos"))
    return dedup.exact_edges(rows).select("uuid")


@query(r"""with n as (select distinct p_name as name, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))), '[^a-z0-9'' ]', ' ', 'g'), '\s+', ' ', 'g')) as key from part),
    c as (select name, key, unnest(string_split(replace(key, ' ', ''), '')) as ch from n), f as (select name, key, ch, count(*) as k from c group by all),
    e as (select name, key, -sum(k / total * log2(k / total)) as bits from (select *, cast(sum(k) over (partition by name) as double) as total from f) group by name, key)
    select name, round(bits, 6) as bits, case when length(key) < 6 and len(list_filter(string_split(key, ' '), lambda x: x <> '')) < 2 then false else bits >= 1.5 end as passes from e""")
def name_entropy_gate(t: Tables) -> DataFrame:
    keys = t.part.select(F.col("p_name").alias("name")).distinct().withColumn("key", text.normalize_fuzzy(F.col("name")))
    return keys.select("name", F.round(text.name_entropy(F.col("key")), 6).alias("bits"), text.has_high_entropy(F.col("key")).alias("passes"))


GRAMS = r"""n as (select distinct p_name as name, replace(trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))), '[^a-z0-9'' ]', ' ', 'g'), '\s+', ' ', 'g')), ' ', '') as bare from part),
    g as (select name, list(distinct bare[i : i + 2]) as grams from (select name, bare, unnest(range(1, length(bare) - 1)) as i from n) group by name)"""


@query(f"""with {GRAMS} select a.name as a, b.name as b, round(len(list_intersect(a.grams, b.grams)) / len(list_distinct(list_concat(a.grams, b.grams))), 6) as jaccard
    from g a join g b on a.name < b.name where len(list_intersect(a.grams, b.grams)) / len(list_distinct(list_concat(a.grams, b.grams))) >= 0.3""")
def shingle_jaccard_pairs(t: Tables) -> DataFrame:
    """Names with one fuzzy form are pairs as well: they share all shingles."""
    names = t.part.select(F.col("p_name").alias("name")).distinct().withColumn("key", text.normalize_fuzzy(F.col("name")))
    found = dedup.similar_keys(names, 0.3)
    found = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard"))
    same = names.select("key").distinct().where(F.size(text.shingles(F.col("key"))) > 0).select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("jaccard"))
    left, right = (names.select(F.col("key").alias(side), F.col("name").alias(f"name_{side}")) for side in ("a", "b"))
    pairs = found.unionByName(same).join(left, "a").join(right, "b").where("name_a < name_b")
    return pairs.select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), F.round("jaccard", 6).alias("jaccard"))


@query()
def minhash_lsh_candidates(t: Tables) -> DataFrame:
    """Keyed by BLAKE2, which SQL lacks; the tests hold it against a Python model."""
    keys = t.part.select(text.normalize_fuzzy(F.col("p_name")).alias("key")).distinct().withColumn("uuid", F.col("key"))
    return dedup.lsh_candidates(keys, keys).where("left_uuid < right_uuid").select("left_uuid", "right_uuid")


@query()
def resolve_with_similarity(t: Tables) -> DataFrame:
    own = _parts(t).withColumn("group_id", F.lit("parts"))
    known = own.groupBy("name", "group_id").agg(F.min("uuid").alias("uuid")).where(F.length("name") % 3 != 0)
    return dedup.resolve(own.select("uuid", "name", "group_id"), known)


ALIAS = "alias as (select distinct 'c:' || o_custkey as a, 'k:' || (o_orderkey % 97) || ':' || (o_custkey % 7) as b from orders)"


def _aliases(t: Tables) -> DataFrame:
    b = F.concat(F.lit("k:"), (F.col("o_orderkey") % 97).cast("string"), F.lit(":"), (F.col("o_custkey") % 7).cast("string"))
    return t.orders.select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("a"), b.alias("b")).distinct()


def _rounds(n: int) -> str:
    """The least label of all neighbours, ``n`` times over: enough for paths of that length."""
    steps = [f"l{i + 1} as materialized (select x, least(any_value(l{i}.r), min(o.r)) as r from l{i} join link using (x) join l{i} o on o.x = link.y group by l{i}.x)".replace("select x,", f"select l{i}.x,") for i in range(n)]
    return ", ".join(["l0 as materialized (select distinct x, x as r from link)", *steps])


@query(f"with {ALIAS}, link as materialized (select a as x, b as y from alias union select b, a from alias), {_rounds(16)} select x as uuid, r as root from l16")
def uuid_closure_min_root(t: Tables) -> DataFrame:
    """Of the aliases of all orders."""
    return dedup.components(_aliases(t))


@query()
def uuid_closure_directed(t: Tables) -> DataFrame:
    """Depends on the order of pairs; the tests hold it against a loop."""
    rows = _aliases(t).withColumn("seq", F.xxhash64("a", "b"))
    return dedup.directed_closure(rows)


@query(f"with {EDGES}, map as (select 'c:' || c_custkey as u, 'x:' || (c_custkey // 2) as r from customer where c_custkey % 2 = 1) select uuid, coalesce(a.r, source) as source, coalesce(b.r, target) as target from edge left join map a on a.u = source left join map b on b.u = target")
def pointer_remap(t: Tables) -> DataFrame:
    return _remapped(t, views.entity_edge(t))


def _remapped(t: Tables, edges: DataFrame) -> DataFrame:
    mapping = t.customer.where("c_custkey % 2 = 1").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("uuid"), F.concat(F.lit("x:"), F.expr("c_custkey div 2").cast("string")).alias("root"))
    moved = dedup.remap(edges, mapping, "source_node_uuid", "target_node_uuid")
    return moved.select("uuid", F.col("source_node_uuid").alias("source"), F.col("target_node_uuid").alias("target"))


@query(f"""with e as (select 'ev:' || event_id as uuid, event_id, user_id, event_type || ' ' || (event_id % 5) as fact, embedding from events left join embeddings on vec_id = event_id),
    w as (select *, string_split(lower(fact), ' ') as w from e)
    select a.uuid, b.uuid as other from w a join w b on a.user_id = b.user_id and a.uuid <> b.uuid
    where a.event_id % 100 = 0 and (len(list_intersect(a.w, b.w)) > 0 or coalesce(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) >= 0.6, false))""")
def edge_candidate_gate(t: Tables) -> DataFrame:
    """Every event whose number 100 divides, against all events of its user."""
    vectors = t.embeddings.select(F.col("vec_id").alias("event_id"), F.col("embedding").alias("fact_embedding"))
    fact = F.concat("event_type", F.lit(" "), (F.col("event_id") % 5).cast("string"))
    edges = t.events.join(vectors, "event_id", "left").select("event_id", F.concat(F.lit("ev:"), F.col("event_id").cast("string")).alias("uuid"), F.col("user_id").alias("source_node_uuid"), F.lit("state").alias("target_node_uuid"), fact.alias("fact"), "fact_embedding")
    return dedup.edge_candidates(edges, edges.where("event_id % 100 = 0"))


# --- Maintenance -----------------------------------------------------------------------------------------------


@query(f"""with {EDGES}, {MENTIONS}, gone as (select 'o:' || o_orderkey as g from orders where o_orderkey % 50 = 0), once as (select entity from mention group by entity having count(*) = 1)
    select 'edge' as kind, uuid from edge where len(episodes) > 0 and episodes[1] in (select g from gone)
    union all select 'node', entity from mention where episode in (select g from gone) and entity in (select entity from once)""")
def remove_episode_cascade(t: Tables) -> DataFrame:
    gone = t.orders.where("o_orderkey % 50 = 0").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("uuid"))
    edges, nodes = maintenance.removed_with_episodes(views.entity_edge(t), views.mentions(t), gone)
    return edges.select(F.lit("edge").alias("kind"), "uuid").unionByName(nodes.select(F.lit("node").alias("kind"), "uuid"))


@query("""with old as (select 'c:' || c_custkey as uuid, c_name as name from customer), new as (select 'c:' || o_custkey as uuid, arg_max('order ' || o_orderkey, o_orderkey) as name from orders group by o_custkey)
    select uuid, name, '' as group_id from old where uuid not in (select uuid from new) union all select uuid, name, '' from new""")
def upsert_last_wins(t: Tables) -> DataFrame:
    """Customers saved once, then a row for each order, all in the default group: the order of the greatest number gives the name."""
    graph = _store(t, "upsert")
    key = lambda c: F.concat(F.lit("c:"), F.col(c).cast("string")).alias("uuid")
    graph.save(entity=t.customer.select(key("c_custkey"), F.col("c_name").alias("name"), F.lit("").alias("group_id")))
    graph.save(entity=t.orders.select(key("o_custkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), F.lit("").alias("group_id"), F.col("o_orderkey").alias(store.ORDER)))
    return graph.table("entity").select("uuid", "name", "group_id")


def _store(t: Tables, name: str) -> store.GraphStore:
    return store.GraphStore(t.spark, scratch.place(t.spark, name))


class _Events(clients.Extractor):
    """Reads ``<user> does <type> at <time>``."""

    def nodes(self, content: str, previous: list[str]) -> list[dict]:
        return [{"name": content.split(" ")[k]} for k in (0, 2)]

    def edges(self, content: str, names: list[str]) -> list[dict]:
        user, does, kind, _, at = content.split(" ")
        return [{"source": user, "target": kind, "relation": "DOES", "fact": f"{user} {does} {kind}", "valid_at": at}]


def _ingested(t: Tables, name: str, group) -> DataFrame:
    """All events as episodes, the even ones and then the odd ones."""
    memory = Memory(t.spark, scratch.place(t.spark, name), _Events(), clients.HashEmbedder(8), clock=lambda: NOW)
    at = F.col("ts").cast("timestamp")
    content = F.concat_ws(" ", F.md5(F.col("user_id").cast("string")), F.lit("does"), "event_type", F.lit("at"), text.isoformat(at))
    rows = t.events.select(F.col("event_id"), F.concat(F.lit("ev:"), F.col("event_id").cast("string")).alias("uuid"), F.lit("").alias("name"), group.alias("group_id"), F.lit("text").alias("source"), F.lit("").alias("source_description"), content.alias("content"), at.alias("valid_at"))
    for k in (0, 1):
        memory.add_episodes(rows.where(F.col("event_id") % 2 == k).drop("event_id"))
    entities = memory.store.table("entity").select("uuid", "name")
    edges = memory.store.table("entity_edge").select("group_id", "source_node_uuid", "target_node_uuid", F.size("episodes").alias("n_episodes"), _time("valid_at").alias("valid_at"))
    for side in ("source", "target"):
        edges = edges.join(entities.select(F.col("uuid").alias(f"{side}_node_uuid"), F.col("name").alias(side)), f"{side}_node_uuid")
    return edges.select("group_id", "source", "target", "n_episodes", "valid_at")


def _ingested_sql(group: str) -> str:
    return f"""with e as (select {group} as group_id, md5(cast(user_id as varchar)) as source, event_type as target, ts, event_id % 2 as batch from events),
    n as (select group_id, source, target, cast(count(*) as int) as n_episodes, min(batch) as batch from e group by all)
    select group_id, source, target, n_episodes, {TIME.format('min(ts)')} as valid_at from n join e using (group_id, source, target, batch) group by all"""


@query(_ingested_sql("'g' || user_id % 3"))
def ingest_two_batches(t: Tables) -> DataFrame:
    """Known nodes and facts are found again: a fact gains the episodes of both batches and keeps its first time."""
    return _ingested(t, "batches", F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")))


@query(_ingested_sql("''"))
def ingest_default_group(t: Tables) -> DataFrame:
    return _ingested(t, "default", F.lit(""))


@query("""with led as (select case when event_id % 3 = 0 then 'add_episode' else 'search' end as operation, case event_id % 3 when 0 then 'medium' when 1 then 'small' else 'embedding' end as model, event_id % 400 as i, event_id % 50 as o from events),
    c as (select *, cast(case model when 'medium' then i * 0.40 + o * 1.60 when 'small' then i * 0.10 + o * 0.40 else i * 0.02 end as decimal(24, 2)) as cost from led)
    select operation, model, count(*) as calls, cast(sum(i) as bigint) as tokens_in, cast(sum(o) as bigint) as tokens_out, cast(sum(cost) as double) / 1e6 as cost from c group by rollup (operation, model)""")
def cost_rollup(t: Tables) -> DataFrame:
    model = F.when(F.col("event_id") % 3 == 0, "medium").when(F.col("event_id") % 3 == 1, "small").otherwise("embedding")
    ledger = t.events.select(F.when(F.col("event_id") % 3 == 0, "add_episode").otherwise("search").alias("operation"), model.alias("model"), (F.col("event_id") % 400).alias("tokens_in"), (F.col("event_id") % 50).alias("tokens_out"))
    return maintenance.cost_rollup(ledger, "operation", "model")


@query("""with led as (select 'u' || user_id as operation, event_type as label, case event_id % 3 when 0 then 'medium' when 1 then 'small' else 'embedding' end as model, event_id % 400 as i, event_id % 50 as o from events),
    c as (select operation, sum(cast(case model when 'medium' then i * 0.40 + o * 1.60 when 'small' then i * 0.10 + o * 0.40 else i * 0.02 end as decimal(24, 2))) as cost from led where label = 'purchase' group by operation)
    select round(cast(avg(cost) as double) / 1e6 * 100 * 30, 4) as monthly_cost from c""")
def monthly_cost(t: Tables) -> DataFrame:
    """An operation for each user; its purchases are the calls of an ``add_episode``."""
    model = F.when(F.col("event_id") % 3 == 0, "medium").when(F.col("event_id") % 3 == 1, "small").otherwise("embedding")
    label = F.when(F.col("event_type") == "purchase", "add_episode.extract").otherwise("search")
    ledger = t.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("operation"), label.alias("label"), model.alias("model"), (F.col("event_id") % 400).alias("tokens_in"), (F.col("event_id") % 50).alias("tokens_out"))
    return maintenance.monthly(ledger, 100).select(F.round("monthly_cost", 4).alias("monthly_cost"))


@query("""with given as (select o_custkey as k, max(o_orderkey) as o from orders group by o_custkey)
    select c_custkey, case when o is null then 'nation=' || c_nationkey || ',segment=' || c_mktsegment else 'nation=' || c_nationkey || ',order=' || o || ',segment=given' end as attributes,
        case when o is null then c_name else 'order ' || o end as summary, case when o is null then 'Customer,Entity' else 'Buyer,Customer,Entity' end as labels from customer left join given on k = c_custkey""")
def triplet_merged_nodes(t: Tables) -> DataFrame:
    """Each customer, merged with what its last order gives; those without orders are given nothing."""
    given = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").cast("string").alias("o"))
    rows = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", "c_name").join(given, "c_custkey", "left")
    own = {"attributes": F.create_map(F.lit("segment"), "c_mktsegment", F.lit("nation"), F.col("c_nationkey").cast("string")), "summary": F.col("c_name"), "labels": F.array(F.lit("Entity"), F.lit("Customer"))}
    has = F.col("o").isNotNull()
    brought = {
        "attributes": F.when(has, F.create_map(F.lit("segment"), F.lit("given"), F.lit("order"), "o")),
        "summary": F.when(has, F.concat(F.lit("order "), "o")).otherwise(""),
        "labels": F.when(has, F.array(F.lit("Entity"), F.lit("Buyer"))).otherwise(F.array(F.lit("Entity"))),
    }
    merged = maintenance.merged_node(own, brought)
    pairs = F.array_sort(F.transform(F.map_entries(merged["attributes"]), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rows.select("c_custkey", F.array_join(pairs, ",").alias("attributes"), merged["summary"].alias("summary"), F.array_join(merged["labels"], ",").alias("labels"))


@query(f"""with {ORDERED}, gone as (select 'c:' || c_custkey as g from customer where c_mktsegment = 'BUILDING')
    select 'node' as kind, 'c:' || c_custkey as uuid from customer where c_mktsegment <> 'BUILDING'
    union all select 'edge', uuid from ordered where source not in (select g from gone)""")
def store_delete_cascade(t: Tables) -> DataFrame:
    """Customers and their edges saved, then the customers of one segment deleted: the edges that touch them go as well."""
    graph = _store(t, "delete")
    key = F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("uuid")
    graph.save(entity=t.customer.select(key, F.col("c_name").alias("name"), F.lit("").alias("group_id")), entity_edge=views.order_edges(t))
    graph.delete("entity", t.customer.where("c_mktsegment = 'BUILDING'").select(key))
    return graph.table("entity").select(F.lit("node").alias("kind"), "uuid").unionByName(graph.table("entity_edge").select(F.lit("edge").alias("kind"), "uuid"))


# --- Scalars ---------------------------------------------------------------------------------------------------


@query(f"select doc_id, {EXACT.format('text')} as exact, {FUZZY.format('text')} as fuzzy from documents")
def normalize_names(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.normalize_exact(F.col("text")).alias("exact"), text.normalize_fuzzy(F.col("text")).alias("fuzzy"))


@query(r"""select doc_id, case when length(text) <= 1000 then text else rtrim(case when regexp_extract(text[1:1000], '(?s)^(.*[.!?])(?:\s|$)', 1) <> '' then regexp_extract(text[1:1000], '(?s)^(.*[.!?])(?:\s|$)', 1) else text[1:1000] end) end as short from documents""")
def truncate_sentence(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.truncate_at_sentence(F.col("text")).alias("short"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(ts) % 1000000 = 0 then '' else '.' || lpad(cast(epoch_us(ts) % 1000000 as varchar), 6, '0') end || '+00:00' as iso from events")
def isoformat(t: Tables) -> DataFrame:
    return t.events.select("event_id", text.isoformat(F.col("ts")).alias("iso"))


@query("""select p_partkey, array_to_string(list_sort(list_distinct(['Entity', p_brand, p_type])), ',') as united,
    case when p_size % 2 = 0 then 'Entity,' || p_brand else 'Entity,' || p_type end as promoted from part""")
def label_union_and_promotion(t: Tables) -> DataFrame:
    entity, brand, kind = F.lit("Entity"), F.col("p_brand"), F.col("p_type")
    resolved = F.when(F.col("p_size") % 2 == 0, F.array(entity, brand)).otherwise(F.array(entity))
    return t.part.select("p_partkey", F.array_join(text.union_labels(F.array(entity, brand), F.array(entity, kind)), ",").alias("united"), F.array_join(text.promote_labels(resolved, F.array(entity, kind)), ",").alias("promoted"))


@query("select doc_id, case when strlen(text) <= 300 then text else text[1:list_max(list_filter(range(0, 301), lambda n: strlen(text[1:n]) <= 300))] end as short from documents")
def truncate_bytes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.truncate_bytes(F.col("text"), 300).alias("short"))


@query("""select event_id, case when event_type = 'error' then null else strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(ts) % 1000000 = 0 then '' else '.' || lpad(cast(epoch_us(ts) % 1000000 as varchar), 6, '0') end || '+00:00' end as iso from events""")
def parse_iso(t: Tables) -> DataFrame:
    """Times written with a Z or an offset are read alike; what isn't a time is null."""
    iso = text.isoformat(F.col("ts"))
    given = F.when(F.col("event_type") == "error", "no time").when(F.col("event_id") % 2 == 0, F.replace(iso, F.lit("+00:00"), F.lit("Z"))).otherwise(iso)
    return t.events.select("event_id", text.isoformat(text.parse_iso(given)).alias("iso"))


@query("""with clip as (select vec_id, cast(embedding[1:16] as double[]) as v from embeddings), n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from clip)
    select vec_id, cast(len(v) as int) as dim, round(v[1] / n, 6) as head, round(v[16] / n, 6) as tail from n""")
def clipped_unit_vectors(t: Tables) -> DataFrame:
    own = t.embeddings.select("vec_id", vector.normalize_l2(vector.clipped(F.col("embedding"), 16)).alias("v"))
    return own.select("vec_id", F.size("v").alias("dim"), F.round(F.col("v")[0], 6).alias("head"), F.round(F.col("v")[15], 6).alias("tail"))


# --- Chunks ----------------------------------------------------------------------------------------------------


@query()
def chunk_documents(t: Tables) -> DataFrame:
    """Windows that end at white space; the tests hold them against a model."""
    each = t.documents.select("doc_id", F.posexplode(hashed.chunk_text(800, 80)("text")).alias("chunk_index", "text"))
    uuid = hashed.chunk_uuid(F.lit("docs"), F.col("doc_id").cast("string"), F.col("chunk_index"))
    return each.select("doc_id", "chunk_index", uuid.alias("uuid"), F.length("text").alias("n_chars"))


@query(f"with {FUSED} select uuid, group_id, round(score, 6) as score from fused join passage using (uuid) where rank <= 20 and group_id = 'en'")
def chunk_search(t: Tables) -> DataFrame:
    """The label filter comes after the limit, so fewer rows than the limit may be left."""
    found = _fused(t).where("rank <= 20").join(views.passages(t), "uuid").where("group_id = 'en'")
    return found.select("uuid", "group_id", F.round("score", 6).alias("score"))
