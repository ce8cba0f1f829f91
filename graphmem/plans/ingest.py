"""Ingest of episodes in batches; one episode is a batch of one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphmem.functions import text
from graphmem.operators import community, dedup, maintenance, saga, similarity, temporal
from graphmem.plans import clients
from graphmem.schema import EPISODE_WINDOW
from graphmem.sources.scratch import discard, written
from graphmem.sources.store import GraphStore

#: Groups of a batch that reads are limited to; a batch of more reads all groups.
PRUNED = 1000
NODE_CANDIDATES, LEAST_COSINE, BLOCKS = 15, 0.6, 16


def derived_uuid(*parts: Column | str) -> Column:
    """An id that is a function of what it names: the same rows get the same ids on every attempt."""
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


@dataclass
class Ingested:
    """The rows that a batch saved, read from its version of the store."""

    version: int
    episodes: DataFrame
    nodes: DataFrame
    edges: DataFrame
    mentions: DataFrame


class _Scratch(list):
    """Written tables that go when the batch is committed."""

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.append(written(df, name))
        return self[-1]

    def discard(self) -> None:
        for df in self:
            discard(df)


def with_previous(episodes: DataFrame, had: DataFrame, n: int = EPISODE_WINDOW) -> DataFrame:
    """``previous``: the contents of the last ``n`` episodes of the group before each one, oldest first.

    Of the history before a group's batch only the last ``n`` episodes are sorted with it.
    """
    span = episodes.groupBy("group_id").agg(F.min("valid_at").alias("lo"), F.max("valid_at").alias("hi"))
    old = had.select("uuid", "group_id", "content", "valid_at").join(span, "group_id").where("valid_at <= hi")
    w = Window.partitionBy("group_id").orderBy(F.col("valid_at").desc(), F.col("uuid").desc())
    before = old.where("valid_at < lo").withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
    old = before.unionByName(old.where("valid_at >= lo")).drop("lo", "hi").join(episodes.select("uuid"), "uuid", "left_anti")
    both = old.withColumn("_new", F.lit(False)).unionByName(episodes.select("uuid", "group_id", "content", "valid_at", F.lit(True).alias("_new")))
    w = Window.partitionBy("group_id").orderBy("valid_at", "uuid").rowsBetween(-n, -1)
    return both.withColumn("previous", F.collect_list("content").over(w)).where("_new").drop("_new")


def resolve_nodes(extracted: DataFrame, had: DataFrame, now: Column, types: list[str] | None = None, client: clients.Extractor | None = None, embedder: clients.Embedder | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New nodes of the batch, ``episode_uuid, name, uuid`` for all that were extracted, and ``uuid, label`` of the known ones among them.

    Names alike in the exact form are one node; then the graph's nodes are looked up by exact name or shingles; then
    the client, if it answers such questions, is asked about the nearest names of the group, if there are any.  The rest is new.
    """
    kinds = F.array(*[F.lit(t) for t in ["Entity", *(types or [])]])
    kind = F.coalesce(F.get(kinds, F.col("entity_type_id")), F.lit("Entity"))
    own = extracted.withColumn("exact", text.normalize_exact(F.col("name"))).withColumn("label", kind)
    first = dedup.first_of(own, ["group_id", "exact"], ["episode_uuid", "pos"]).select("group_id", "exact", "name", "label")
    fresh = first.withColumn("uuid", derived_uuid(F.lit("entity"), "group_id", "exact"))
    resolved = dedup.resolve(fresh.select("uuid", "name", "group_id"), had.select("uuid", "name", "group_id"))
    if client and embedder and client.asks("same_node"):
        open_ = fresh.join(resolved.where("resolved_uuid is not null"), "uuid", "left_anti")
        asked = open_.select(F.col("uuid").alias("query_uuid"), "group_id", clients.embedding(embedder)(F.col("name")).alias("vector"))
        found = similarity.candidates(asked, had, "name_embedding", NODE_CANDIDATES, LEAST_COSINE, BLOCKS)
        named = found.join(had.select("uuid", "name"), "uuid").groupBy("query_uuid").agg(F.array_sort(F.collect_list(F.struct("rank", "uuid", "name"))).alias("candidates"))
        answered = clients.resolve_nodes(named.withColumnRenamed("query_uuid", "uuid").join(open_.select("uuid", "name"), "uuid"), client).withColumnRenamed("resolved_uuid", "_answer")
        resolved = resolved.join(answered, "uuid", "left").select("uuid", F.coalesce("resolved_uuid", "_answer").alias("resolved_uuid"))
    mapped = fresh.join(resolved, "uuid", "left").withColumn("final", F.coalesce("resolved_uuid", "uuid"))
    nodes = mapped.where("resolved_uuid is null").select("uuid", "name", "group_id", F.array_distinct(F.array(F.lit("Entity"), "label")).alias("labels"), now.alias("created_at"), F.lit("").alias("summary"))
    names = own.select("episode_uuid", "group_id", "name", "exact").join(mapped.select("group_id", "exact", F.col("final").alias("uuid")), ["group_id", "exact"]).select("episode_uuid", "name", "uuid").distinct()
    labels = mapped.where("resolved_uuid is not null").groupBy(F.col("resolved_uuid").alias("uuid")).agg(F.array_sort(F.collect_set("label")).alias("found"))
    return nodes, names, labels


EDGE = ["uuid", "source_node_uuid", "target_node_uuid", "name", "fact", "group_id", "episodes", "created_at", "expired_at", "valid_at", "invalid_at", "attributes", "fact_embedding"]


def resolve_edges(extracted: DataFrame, names: DataFrame, had: DataFrame, now: Column, client: clients.Extractor, embedder: clients.Embedder, episodes: DataFrame | None = None, scratch: _Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges of the batch as they are to be saved, and those of the graph that they close.

    A fact that the graph or the batch has, between the same nodes, gains an episode.  About any other one the client, if it answers such questions, is
    given the related facts and the candidates for invalidation: a duplicate becomes the known fact, and only facts that
    the client names as contradicted are closed, by the rules of time.  Times are asked for where a new fact has none.
    """
    scratch = _Scratch() if scratch is None else scratch
    for side in ("source", "target"):
        one = names.select("episode_uuid", F.col("name").alias(side), F.col("uuid").alias(f"{side}_node_uuid"))
        extracted = extracted.join(one, ["episode_uuid", side])
    rows = extracted.where("source_node_uuid <> target_node_uuid").withColumn("exact", text.normalize_exact(F.col("fact")))
    key = ["group_id", "source_node_uuid", "target_node_uuid", "exact"]
    own = rows.groupBy(*key).agg(F.min_by(F.struct("name", "fact"), F.struct("episode_uuid", "pos")).alias("f"), F.array_sort(F.collect_set("episode_uuid")).alias("seen"), F.min(text.parse_iso(F.col("valid_at"))).alias("valid_at"), F.min(text.parse_iso(F.col("invalid_at"))).alias("invalid_at"))
    known = had.withColumn("exact", text.normalize_exact(F.col("fact"))).select(*key, F.col("uuid").alias("known_uuid"))
    same = scratch.written(own.join(dedup.first_of(known, key, ["known_uuid"]), key, "left"), "same")
    gained = same.where("known_uuid is not null").select(F.col("known_uuid").alias("uuid"), "seen")
    fresh = same.where("known_uuid is null").select(derived_uuid(F.lit("edge"), *key).alias("uuid"), "source_node_uuid", "target_node_uuid", F.col("f.name").alias("name"), F.col("f.fact").alias("fact"), "group_id", F.col("seen").alias("episodes"), now.alias("created_at"), F.lit(None).cast("timestamp").alias("expired_at"), "valid_at", "invalid_at", F.lit(None).cast("map<string,string>").alias("attributes"))
    fresh = scratch.written(clients.embed_missing(fresh, "fact", "fact_embedding", embedder).select(*EDGE), "fresh")
    named = None
    new = fresh
    if client.asks("judge"):
        verdicts = scratch.written(clients.judge_edges(dedup.edge_pools(fresh, had.select(*EDGE).unionByName(fresh)), client), "verdicts")
        root = _roots(verdicts, had, scratch)
        merged = fresh.join(root, "uuid").where("root <> uuid").select(F.col("root").alias("uuid"), F.col("episodes").alias("seen"))
        gained = gained.unionByName(merged)
        new = fresh.join(root.where("root <> uuid").select("uuid"), "uuid", "left_anti")
        told = verdicts.join(new.select("uuid"), "uuid", "left_semi").select("uuid", F.explode("contradicted").alias("other"))
        named = told.join(root.select(F.col("uuid").alias("other"), "root"), "other", "left").select("uuid", F.coalesce("root", "other").alias("other")).where("uuid <> other").distinct()
    gained = gained.groupBy("uuid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("seen"))
    if client.asks("times") and episodes is not None:
        bare = new.where("valid_at is null and invalid_at is null").withColumn("episode_uuid", F.array_min("episodes"))
        bare = bare.join(episodes.select(F.col("uuid").alias("episode_uuid"), "content", F.col("valid_at").cast("string").alias("reference")), "episode_uuid")
        told = clients.fact_times(bare, client).select("uuid", text.parse_iso(F.col("valid_at")).alias("_from"), text.parse_iso(F.col("invalid_at")).alias("_to"))
        new = new.join(told, "uuid", "left").withColumn("valid_at", F.coalesce("valid_at", "_from")).withColumn("invalid_at", F.coalesce("invalid_at", "_to")).drop("_from", "_to")
    new = scratch.written(new.select(*EDGE), "new")
    old = had.select(*EDGE).unionByName(new)
    if named is None:
        expired = temporal.expire_new(new, new.limit(0).select("uuid", F.col("valid_at").alias("candidate_valid")), now)
        ends = new.limit(0).select("uuid", F.col("invalid_at").alias("_end"), F.col("expired_at").alias("_expired"))
    else:
        rivals = old.select(F.col("uuid").alias("old_uuid"), F.col("valid_at").alias("old_valid"), F.col("invalid_at").alias("old_invalid"), F.col("expired_at").alias("old_expired"))
        pairs = scratch.written(new.select("uuid", F.col("valid_at").alias("new_valid"), F.col("invalid_at").alias("new_invalid")).join(named.withColumnRenamed("other", "old_uuid"), "uuid").join(rivals, "old_uuid"), "pairs")
        expired = temporal.expire_new(new, pairs.select("uuid", F.col("old_valid").alias("candidate_valid")), now)
        closed = temporal.close_contradicted(pairs, now).where(temporal.contradicted(F.col("new_valid"), F.col("new_invalid"), F.col("old_valid"), F.col("old_invalid")))
        ends = scratch.written(closed.groupBy(F.col("old_uuid").alias("uuid")).agg(F.min("invalid_at").alias("_end"), F.min("expired_at").alias("_expired")), "ends")

    def ended(rows: DataFrame) -> DataFrame:
        out = rows.join(ends, "uuid", "left").withColumn("invalid_at", F.coalesce("_end", "invalid_at")).withColumn("expired_at", F.coalesce("_expired", "expired_at"))
        return out.join(gained, "uuid", "left").withColumn("episodes", F.array_union(F.coalesce("episodes", F.array().cast("array<string>")), F.coalesce("seen", F.array().cast("array<string>")))).select(*EDGE)

    touched = had.select(*EDGE).join(gained.select("uuid").unionByName(ends.select("uuid")).distinct(), "uuid", "left_semi")
    changed = ended(touched).join(ends.select("uuid", F.lit(True).alias("_closed")), "uuid", "left")
    kept = ended(expired).unionByName(changed.where("_closed is null").drop("_closed"))
    return kept, changed.where("_closed").drop("_closed")


def _roots(verdicts: DataFrame, had: DataFrame, scratch: _Scratch) -> DataFrame:
    """``uuid, root`` of edges that are duplicates: the known edge of each set of duplicates, the smallest uuid of several, or of those of the batch if none is known."""
    pairs = verdicts.select("uuid", F.get("duplicates", F.lit(0)).alias("other")).where("other is not null")
    ids = pairs.select("uuid").unionByName(pairs.select(F.col("other").alias("uuid"))).distinct()
    marked = ids.join(had.select("uuid", F.lit("0").alias("mark")), "uuid", "left").select("uuid", F.concat(F.coalesce("mark", F.lit("1")), "uuid").alias("key"))
    keyed = pairs.join(marked.withColumnRenamed("key", "a"), "uuid").join(marked.select(F.col("uuid").alias("other"), F.col("key").alias("b")), "other")
    out = dedup.components(keyed.select("a", "b"))
    return scratch.written(out.select(F.substring("uuid", 2, 1 << 20).alias("uuid"), F.substring("root", 2, 1 << 20).alias("root")), "roots")


def hydrated(nodes: DataFrame, touched: DataFrame, names: DataFrame, episodes: DataFrame, client: clients.Extractor) -> DataFrame:
    """New nodes and known ones that the batch mentions (``touched``) with the client's summaries, from the last episode that mentions each."""
    every = nodes.unionByName(touched, allowMissingColumns=True)
    last = names.join(episodes.select(F.col("uuid").alias("episode_uuid"), "content", "previous", "valid_at"), "episode_uuid").groupBy("uuid").agg(F.max_by(F.struct("content", "previous"), F.struct("valid_at", "episode_uuid")).alias("last"))
    asked = every.join(last, "uuid").select("uuid", "name", "summary", "last.content", "last.previous")
    told = clients.node_summaries(asked, client).select("uuid", text.truncate_at_sentence(F.col("summary")).alias("_summary"))
    return every.join(told, "uuid", "left").withColumn("summary", F.coalesce("_summary", "summary")).drop("_summary")


def add_episodes(store: GraphStore, episodes: DataFrame, extractor: clients.Extractor, embedder: clients.Embedder, now: str, types: list[str] | None = None, update_communities: bool = False) -> Ingested:
    """Reads a batch of episodes (``uuid, name, group_id, source, source_description, content, valid_at``) into the graph, as one version.

    With a column ``saga`` episodes are also threaded into the saga of that name.  ``update_communities``: nodes join the community
    of most of their neighbours, whose summary and name then take them in.  If another batch is committed meanwhile there is a ``Conflict``, and nothing is saved.
    """
    at, scratch, since = F.lit(now).cast("timestamp"), _Scratch(), store.version()
    episodes = scratch.written(episodes.withColumn("group_id", F.coalesce("group_id", F.lit(""))), "episodes")
    groups = [r[0] for r in episodes.select("group_id").distinct().limit(PRUNED + 1).collect()]
    groups = groups if len(groups) <= PRUNED and groups != [""] else None
    had_nodes, had_edges = store.table("entity", groups, since), store.table("entity_edge", groups, since)
    own = scratch.written(with_previous(episodes, store.table("episode", groups, since)), "previous")
    nodes_found = scratch.written(clients.extract_nodes(own, extractor), "nodes")
    nodes, names, labels = resolve_nodes(nodes_found, had_nodes, at, types, extractor, embedder)
    names, nodes, labels = scratch.written(names, "names"), scratch.written(nodes, "nodes"), scratch.written(labels, "labels")
    edges_found = scratch.written(clients.extract_edges(own, nodes_found, extractor), "edges")
    edges, invalidated = resolve_edges(edges_found, names, had_edges, at, extractor, embedder, episodes, scratch)
    edges = scratch.written(edges, "edges")
    promoted = had_nodes.join(labels, "uuid").withColumn("_labels", text.promote_labels(F.col("labels"), F.col("found"))).where(F.lit(extractor.asks("summary")) | (F.col("_labels") != F.col("labels")))
    touched = promoted.withColumn("labels", F.col("_labels")).drop("_labels", "found")
    saved_nodes = hydrated(nodes, touched, names, own, extractor) if extractor.asks("summary") else nodes.unionByName(touched, allowMissingColumns=True)
    saved_nodes = scratch.written(clients.embed_missing(saved_nodes, "name", "name_embedding", embedder), "nodes")
    ids = names.select("episode_uuid", "uuid").distinct()
    mentions = ids.join(episodes.select(F.col("uuid").alias("episode_uuid"), "group_id"), "episode_uuid").select(derived_uuid(F.lit("mentions"), "episode_uuid", "uuid").alias("uuid"), F.col("episode_uuid").alias("source_node_uuid"), F.col("uuid").alias("target_node_uuid"), "group_id", at.alias("created_at"))
    stamped = edges.select("uuid", F.explode("episodes").alias("episode_uuid")).groupBy("episode_uuid").agg(F.array_sort(F.collect_set("uuid")).alias("entity_edges"))
    saved = episodes.join(stamped.withColumnRenamed("episode_uuid", "uuid"), "uuid", "left").withColumn("created_at", at)
    changed = {"episode": saved, "entity": saved_nodes, "mentions": mentions, "entity_edge": edges.unionByName(invalidated)}
    if "saga" in episodes.columns:
        changed |= threaded(episodes, store, at)
    if update_communities:
        changed |= joined_communities(store, ids.select("uuid").distinct(), saved_nodes, edges, extractor, embedder, at, groups)
    version = store.save(since=since, **changed)
    scratch.discard()
    return Ingested(version, *[store.batch(name, version) for name in ("episode", "entity", "entity_edge", "mentions")])


def joined_communities(store: GraphStore, nodes: DataFrame, changed: DataFrame, edges: DataFrame, client: clients.Extractor, embedder: clients.Embedder, at: Column, groups: list[str] | None) -> dict[str, DataFrame]:
    """Rows of community and has_member for ``nodes``: each stays in its community or joins that of most of its neighbours.

    A community's summary takes in those of the nodes one after the other, by uuid.
    """
    entities = dedup.first_of(changed.select("uuid", "name", "summary", F.lit(0).alias("_age")).unionByName(store.table("entity", groups).select("uuid", "name", "summary", F.lit(1).alias("_age"))), ["uuid"], ["_age"])
    every = edges.select("uuid", "source_node_uuid", "target_node_uuid")
    every = every.unionByName(store.table("entity_edge", groups).select(*every.columns).join(every.select("uuid"), "uuid", "left_anti"))
    votes = community.vote(every, store.table("has_member", groups), nodes)
    told = votes.join(entities.select(F.col("uuid").alias("node_uuid"), F.coalesce(F.nullif("summary", F.lit("")), "name").alias("own")), "node_uuid")
    parts = told.groupBy("community_uuid").agg(F.array_sort(F.collect_list(F.struct("node_uuid", "own"))).alias("parts"))

    @F.pandas_udf("summary string, name string")
    def taken_in(old, parts):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for text_, own in zip(old, parts, strict=True):
            for x in own:
                text_ = client.community_summary(x["own"], text_ or "")
            out.append((text_, client.community_name(text_)))
        return pd.DataFrame(out, columns=["summary", "name"])

    rows = store.table("community", groups).join(parts.withColumnRenamed("community_uuid", "uuid"), "uuid").withColumn("_new", taken_in("summary", "parts"))
    rows = rows.withColumn("summary", F.col("_new.summary")).withColumn("name", F.col("_new.name")).drop("_new", "parts", "name_embedding")
    links = votes.where("is_new").join(store.table("community", groups).select(F.col("uuid").alias("community_uuid"), "group_id"), "community_uuid")
    links = links.select(derived_uuid(F.lit("member"), "community_uuid", "node_uuid").alias("uuid"), F.col("community_uuid").alias("source_node_uuid"), F.col("node_uuid").alias("target_node_uuid"), "group_id", at.alias("created_at"))
    return {"community": clients.embed_missing(rows, "name", "name_embedding", embedder), "has_member": links}


def threaded(episodes: DataFrame, store: GraphStore, at: Column) -> dict[str, DataFrame]:
    """Rows of saga, has_episode and next_episode for episodes with a ``saga``; a known saga keeps its summary and watermarks."""
    own = episodes.where("saga is not null").withColumn("saga_uuid", derived_uuid(F.lit("saga"), "saga", "group_id")).withColumn("created_at", at)
    has = own.select(derived_uuid(F.lit("has"), "saga_uuid", "uuid").alias("uuid"), F.col("saga_uuid").alias("source_node_uuid"), F.col("uuid").alias("target_node_uuid"), "group_id", "created_at")
    had = store.table("has_episode").select(F.col("source_node_uuid").alias("saga_uuid"), F.col("target_node_uuid").alias("uuid")).join(store.table("episode").select("uuid", "group_id", "valid_at", "created_at"), "uuid")
    chain = own.select("saga_uuid", "uuid", "group_id", "valid_at", "created_at").unionByName(had.join(own.select("saga_uuid").distinct(), "saga_uuid", "left_semi").join(own.select("uuid"), "uuid", "left_anti"))
    links = saga.next_episodes(chain).join(chain.select("saga_uuid", "group_id").distinct(), "saga_uuid").select(derived_uuid(F.lit("next"), "source_node_uuid", "target_node_uuid").alias("uuid"), "source_node_uuid", "target_node_uuid", "group_id", at.alias("created_at"))
    ends = saga.pointers(chain).drop("created_at")
    known = store.table("saga").select(F.col("uuid").alias("saga_uuid"), F.col("created_at").alias("_since"), "summary", "last_summarized_at", "last_summarized_episode_valid_at")
    sagas = own.select("saga_uuid", F.col("saga").alias("name"), "group_id", "created_at").distinct().join(ends, "saga_uuid").join(known, "saga_uuid", "left")
    sagas = sagas.select(F.col("saga_uuid").alias("uuid"), "name", "group_id", F.array(F.lit("Saga")).alias("labels"), F.coalesce("_since", "created_at").alias("created_at"), F.coalesce("summary", F.lit("")).alias("summary"), "first_episode_uuid", "last_episode_uuid", "last_summarized_at", "last_summarized_episode_valid_at")
    return {"saga": sagas, "has_episode": has, "next_episode": links}


def summarize_sagas(store: GraphStore, sagas: DataFrame, client: clients.Extractor, now: str) -> DataFrame:
    """The given sagas (``uuid``) that have episodes created since their last summary, with a new one; the rest stays as it is.

    Episodes are chosen by when they were created, 200 at most, so late ones are read; the second watermark, of valid time, never goes back.
    """
    link = store.table("has_episode").select(F.col("source_node_uuid").alias("saga_uuid"), F.col("target_node_uuid").alias("uuid"))
    own = store.table("saga").join(sagas.select("uuid"), "uuid", "left_semi")
    rows = store.table("episode").join(link, "uuid").join(own.select(F.col("uuid").alias("saga_uuid"), "last_summarized_at"), "saga_uuid")
    first, later = rows.where("last_summarized_at is null"), rows.where("created_at > last_summarized_at")
    read = saga.contents(first).unionByName(saga.contents(later, F.lit("0001-01-01").cast("timestamp")))
    read = read.groupBy(F.col("saga_uuid").alias("uuid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("contents"), F.max("valid_at").alias("_seen"))
    asked = own.join(read, "uuid")
    told = clients.saga_summaries(asked, client).select("uuid", text.truncate_bytes(F.col("summary"), 1000).alias("_summary"))
    out = asked.join(told, "uuid").withColumn("summary", F.col("_summary")).withColumn("last_summarized_at", F.lit(now).cast("timestamp"))
    out = written(out.withColumn("last_summarized_episode_valid_at", saga.advanced(F.col("last_summarized_episode_valid_at"), F.col("_seen"))).drop("_summary", "_seen", "contents"), "sagas")
    if out.limit(1).count():
        store.save(saga=out)
    return out


def remove_episodes(store: GraphStore, gone: DataFrame) -> int:
    """Episodes with what only they brought, as one version: edges that they came first for, nodes that nothing else mentions."""
    since = store.version()
    edges, nodes = maintenance.removed_with_episodes(store.table("entity_edge"), store.table("mentions"), gone)
    return store.commit({}, store.cascade(entity_edge=edges, entity=nodes, episode=gone), since=since)


def add_triplets(store: GraphStore, triplets: DataFrame, extractor: clients.Extractor, embedder: clients.Embedder, now: str) -> DataFrame:
    """Facts given as ``source, name, target, fact, group_id``: names resolve to known nodes, an equal fact to the known edge, and the client judges the rest.

    With ``source_attributes, source_summary, source_labels`` (and ``target_``) a node gains attributes and labels and takes the summary, if one is
    given.  With ``uuid`` an edge keeps that id, unless a known edge of other endpoints has it.
    """
    at, scratch, since = F.lit(now).cast("timestamp"), _Scratch(), store.version()
    nothing = F.lit(None)
    rows = triplets.withColumn("episode_uuid", F.lit("")).withColumn("pos", F.lit(0))
    for c in ("valid_at", "invalid_at"):
        rows = rows.withColumn(c, F.col(c).cast("string") if c in triplets.columns else nothing.cast("string"))
    rows = scratch.written(rows, "triplets")
    ends = rows.select("episode_uuid", "group_id", "pos", F.explode(F.array("source", "target")).alias("name"), F.lit(0).alias("entity_type_id"))
    had_nodes, had_edges = store.table("entity", version=since), store.table("entity_edge", version=since)
    nodes, names, _ = resolve_nodes(ends, had_nodes, at, None, extractor, embedder)
    nodes, names = scratch.written(nodes, "nodes"), scratch.written(names, "names")
    edges, invalidated = resolve_edges(rows.select(*[c for c in rows.columns if c != "uuid"]), names, had_edges, at, extractor, embedder, None, scratch)
    edges = edges.withColumn("episodes", F.array_remove("episodes", ""))
    if "uuid" in triplets.columns:
        by_name = names.select("name", F.col("uuid").alias("_end"))
        given = rows.where("uuid is not null").select(F.col("uuid").alias("_given"), "source", "target", "fact").join(by_name.withColumnsRenamed({"name": "source", "_end": "source_node_uuid"}), "source").join(by_name.withColumnsRenamed({"name": "target", "_end": "target_node_uuid"}), "target")
        taken = had_edges.select(F.col("uuid").alias("_given"), F.col("source_node_uuid").alias("_s"), F.col("target_node_uuid").alias("_t"))
        free = given.join(taken, "_given", "left").where("_s is null or (_s = source_node_uuid and _t = target_node_uuid)").select("_given", "source_node_uuid", "target_node_uuid", "fact")
        known = had_edges.select("uuid", F.lit(True).alias("_known"))
        edges = edges.join(known, "uuid", "left").join(dedup.first_of(free, ["source_node_uuid", "target_node_uuid", "fact"], ["_given"]), ["source_node_uuid", "target_node_uuid", "fact"], "left")
        edges = edges.withColumn("uuid", F.when(F.col("_known").isNull(), F.coalesce("_given", "uuid")).otherwise(F.col("uuid"))).select(*EDGE)
    edges = scratch.written(edges, "edges")
    sides = []
    for side in ("source", "target"):
        given = {k: F.col(f"{side}_{k}") if f"{side}_{k}" in triplets.columns else nothing.cast(t) for k, t in (("attributes", "map<string,string>"), ("summary", "string"), ("labels", "array<string>"))}
        sides.append(rows.select(F.col(side).alias("name"), *[c.alias(k) for k, c in given.items()]))
    told = sides[0].unionByName(sides[1]).join(names.select("name", "uuid").distinct(), "name").where("attributes is not null or summary is not null or labels is not null")
    told = dedup.first_of(told, ["uuid"], ["name", "summary"]).select("uuid", F.struct("attributes", "summary", F.coalesce("labels", F.array().cast("array<string>")).alias("labels")).alias("given"))
    every = nodes.unionByName(had_nodes.join(told.select("uuid"), "uuid", "left_semi"), allowMissingColumns=True).join(told, "uuid", "left")
    merged = maintenance.merged_node({k: F.col(k) for k in ("attributes", "summary", "labels")}, {k: F.col(f"given.{k}") for k in ("attributes", "summary", "labels")})
    every = every.select(*[(F.when(F.col("given").isNotNull(), merged[c]).otherwise(F.col(c)) if c in merged else F.col(c)).alias(c) for c in every.columns if c != "given"])
    version = store.save(since=since, entity=scratch.written(clients.embed_missing(every, "name", "name_embedding", embedder), "nodes"), entity_edge=edges.unionByName(invalidated))
    scratch.discard()
    return store.batch("entity_edge", version)
