"""Ingest, removal, chunks, communities, search and streams end to end, with scripted clients."""

import pytest
from pyspark.sql import functions as F

from graphmem.plans import search
from graphmem.plans.clients import HashEmbedder, ScriptedExtractor, scripted_scores, with_retry
from graphmem.plans.engine import Memory, knowledge_group
from graphmem.streaming.ingest import ingest_stream, state_changes

ACME, GLOBEX = "Alice works at Acme.", "Alice now works at Globex."


def node(*names):
    return [{"name": n} for n in names]


def fact(source, target, text, valid_at=None):
    return [{"source": source, "target": target, "relation": "WORKS_AT", "fact": text, "valid_at": valid_at}]


SCRIPT = ScriptedExtractor(
    {ACME: node("Alice", "Acme"), GLOBEX: node("alice", "Globex", " "), "Bob.": node("Bob", "Alice")},
    {ACME: fact("Alice", "Acme", ACME, "2025-01-01T00:00:00Z"), GLOBEX: fact("alice", "Globex", GLOBEX, "2025-06-01T00:00:00Z") + fact("alice", "Nobody", "x"), "Bob.": []},
    contradicts={GLOBEX: [ACME]},
)


@pytest.fixture
def memory(spark, tmp_path):
    return Memory(spark, str(tmp_path / "graph"), SCRIPT, HashEmbedder(16), clock=lambda: "2025-07-01 00:00:00")


def test_two_episodes(memory):
    memory.add_episode("e1", ACME, "2025-01-01 00:00:00", "g1", saga="s")
    memory.add_episode("e2", GLOBEX, "2025-06-01 00:00:00", "g1", saga="s")
    edges = {r["fact"]: r for r in memory.store.table("entity_edge").collect()}
    assert str(edges[ACME]["invalid_at"]) == "2025-06-01 00:00:00" and edges[ACME]["expired_at"] is not None
    assert edges[GLOBEX]["invalid_at"] is None and edges[GLOBEX]["expired_at"] is None
    names = sorted(r["name"] for r in memory.store.table("entity").collect())
    assert names == ["Acme", "Alice", "Globex"]
    assert memory.store.table("mentions").count() == 4
    chain = memory.store.table("next_episode").collect()
    assert [(r["source_node_uuid"], r["target_node_uuid"]) for r in chain] == [("e1", "e2")]
    assert memory.store.table("saga").first()["last_episode_uuid"] == "e2"
    memory.add_episode("e1", ACME, "2025-01-01 00:00:00", "g1", saga="s")
    assert memory.store.table("entity_edge").count() == 2 and memory.store.table("entity").count() == 3
    found = memory.search("works at Globex", search.RECIPES["edge_hybrid_reciprocal_rank_fusion"]).edges.collect()
    assert found[0]["fact"] == GLOBEX
    assert memory.search("  ").edges is None
    memory.remove_episodes(["e2"])
    assert [r["fact"] for r in memory.store.table("entity_edge").collect()] == [ACME]
    assert sorted(r["name"] for r in memory.store.table("entity").collect()) == ["Acme", "Alice"]


def test_bulk_merges_and_triplets(spark, memory):
    rows = [("e2", "", "g1", [], "message", "", GLOBEX, "2025-06-01 00:00:00"), ("e1", "", "g1", [], "message", "", ACME, "2025-01-01 00:00:00"), ("e3", "", "g2", [], "message", "", "Bob.", "2025-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "uuid string, name string, group_id string, labels array<string>, source string, source_description string, content string, valid_at string")
    memory.add_episodes(df.withColumn("valid_at", F.col("valid_at").cast("timestamp")))
    assert sorted((r["group_id"], r["name"].lower()) for r in memory.store.table("entity").collect()) == [("g1", "acme"), ("g1", "alice"), ("g1", "globex"), ("g2", "alice"), ("g2", "bob")]
    edges = {r["fact"]: r for r in memory.store.table("entity_edge").collect()}
    assert str(edges[ACME]["invalid_at"]) == "2025-06-01 00:00:00" and edges[GLOBEX]["invalid_at"] is None
    triplet = spark.createDataFrame([("ALICE", "WORKS_AT", "Acme", ACME, "g1"), ("Alice", "KNOWS", "Carol", "Alice knows Carol", "g1")], "source string, name string, target string, fact string, group_id string")
    memory.add_triplets(triplet)
    assert memory.store.table("entity_edge").count() == 3 and memory.store.table("entity", ["g1"]).count() == 4
    communities = memory.build_communities(["g1"]).collect()
    assert len(communities) >= 1 and memory.store.table("has_member").count() >= 2
    memory.remove_communities()
    assert memory.store.table("community").count() == 0
    assert memory.retrieve_episodes("2025-02-01", 1, ["g1"]).collect()[0]["uuid"] == "e1"


def test_chunks_and_tenants(spark, memory):
    chunks = spark.createDataFrame([("d", 0, "alpha beta"), ("d", 1, "gamma delta")], "doc_id string, chunk_index int, text string")
    first = {r["uuid"] for r in memory.ingest_chunks(chunks, "t1").collect()}
    assert first == {r["uuid"] for r in memory.ingest_chunks(chunks, "t1").collect()} and memory.store.table("entity").count() == 2
    hits = memory.search_chunks("alpha", "t1").collect()
    assert hits[0]["text"] == "alpha beta" and hits[0]["doc_id"] == "d" and hits[0]["chunk_index"] == 0
    assert memory.search_chunks("alpha", "t2").count() == 0
    with pytest.raises(ValueError, match="dimensions"):
        memory.ingest_chunks(chunks.withColumn("embedding", F.array(F.lit(1.0).cast("float"))), "t1")
    with pytest.raises(ValueError, match="group"):
        knowledge_group("a b")


def test_recipes():
    assert len(search.RECIPES) == 16
    assert search.RECIPES["community_hybrid_cross_encoder"].limit == 3
    assert search.RECIPES["combined_hybrid_mmr"].episode.reranker is search.Reranker.RRF


def test_scripted_cross_encoder(spark):
    rows = spark.createDataFrame([("e1", "alpha one", "R", "g"), ("e2", "alpha two", "R", "g"), ("e3", "alpha three", "R", "g")], "uuid string, fact string, name string, group_id string")
    config = search.Config(edge=search.Scope((search.Method.BM25,), search.Reranker.CROSS_ENCODER), min_score=0.2)
    request = search.Request("alpha", scorer=scripted_scores({"alpha one": 0.9, "alpha two": 0.5, "alpha three": 0.1}))
    assert [r["uuid"] for r in search.search(search.Graph(edges=rows), request, config).edges.collect()] == ["e1", "e2"]
    with pytest.raises(ValueError, match="client"):
        search.search(search.Graph(edges=rows), search.Request("alpha"), config)


def test_retry():
    calls = []

    def fails_twice():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert with_retry(fails_twice, wait=lambda s: None)() == "done" and len(calls) == 3


def test_streams(spark, memory, tmp_path):
    rows = [("e1", "", "g1", "message", "", ACME, "2025-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "uuid string, name string, group_id string, source string, source_description string, content string, valid_at string")
    df.withColumn("valid_at", F.col("valid_at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    ingest_stream(memory, stream, str(tmp_path / "cp")).awaitTermination()
    assert memory.store.table("entity_edge").count() == 1
    facts = stream.select(F.col("group_id").alias("source_node_uuid"), F.col("content").alias("fact"), "valid_at")
    q = state_changes(facts).writeStream.format("memory").queryName("changes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("changes").first()["facts"] == 1


BOB, CAROL = "Alice knows Bob.", "Alice knows Carol."


def knows(target, text, valid_at):
    return [{"source": "Alice", "target": target, "relation": "KNOWS", "fact": text, "valid_at": valid_at}]


def test_default_group_and_facts_that_nothing_contradicts(spark, tmp_path):
    """In the empty group known nodes and facts are found again, a judged fact is closed, and another target is no contradiction."""
    script = ScriptedExtractor(
        {ACME: node("Alice", "Acme"), GLOBEX: node("alice", "Globex"), BOB: node("Alice", "Bob"), CAROL: node("Alice", "Carol")},
        {ACME: fact("Alice", "Acme", ACME, "2025-01-01T00:00:00Z"), GLOBEX: fact("alice", "Globex", GLOBEX, "2025-06-01T00:00:00Z"), BOB: knows("Bob", BOB, "2020-01-01"), CAROL: knows("Carol", CAROL, "2021-01-01")},
        contradicts={GLOBEX: [ACME]},
    )
    memory = Memory(spark, str(tmp_path / "graph"), script, HashEmbedder(16), clock=lambda: "2025-07-01 00:00:00")
    memory.add_episode("e1", ACME, "2025-01-01 00:00:00")
    rows = [(f"e{k}", "", "", "text", "", c, "2025-06-01 00:00:00") for k, c in enumerate((GLOBEX, BOB, CAROL), 2)]
    df = spark.createDataFrame(rows, "uuid string, name string, group_id string, source string, source_description string, content string, valid_at string")
    memory.add_episodes(df.withColumn("valid_at", F.col("valid_at").cast("timestamp")))
    edges = {r["fact"]: r for r in memory.store.table("entity_edge").collect()}
    assert str(edges[ACME]["invalid_at"]) == "2025-06-01 00:00:00"
    assert all(edges[x]["invalid_at"] is None and edges[x]["expired_at"] is None for x in (GLOBEX, BOB, CAROL))
    assert sorted(r["name"] for r in memory.store.table("entity").collect()) == ["Acme", "Alice", "Bob", "Carol", "Globex"]
    found, named = memory.nodes_and_edges_of(["e1"])
    assert {r["name"] for r in found.collect()} == {"Alice", "Acme"} and [r["fact"] for r in named.collect()] == [ACME]
    assert memory.search_edges("knows Carol").first()["fact"] == CAROL and memory.search_edges(" ") is None
    alice = memory.store.table("entity").where("name = 'Alice'").first()["uuid"]
    assert memory.search_edges("knows", center=alice, limit=2).count() == 2
    with pytest.raises(KeyError, match="nope"):
        memory.remove_episodes(["e1", "nope"])
    before = memory.store.version()
    memory.remove_episodes(["e1"])
    assert memory.store.version() == before + 1 and "Acme" not in {r["name"] for r in memory.store.table("entity").collect()}
    assert ACME not in {r["fact"] for r in memory.store.table("entity_edge").collect()}


def test_questions_to_the_model(spark, tmp_path):
    """Same nodes, duplicates, times and summaries come from the client; answers out of range are dropped; communities and sagas follow."""
    one, two = "Robert Smith runs Acme Corporation", "Bob Smith leads Acme Corporation"
    edge = {"target": "Acme Corporation", "relation": "RUNS"}
    script = ScriptedExtractor(
        {one: node("Robert Smith", "Acme Corporation"), two: node("Robert Smyth II", "Acme Corporation", "Zed Quux")},
        {one: [{**edge, "source": "Robert Smith", "fact": one}], two: [{**edge, "source": "Robert Smyth II", "fact": two}]},
        duplicates={two: [one]}, same={"Robert Smyth II": "Robert Smith", "Zed Quux": "99"}, when={one: {"valid_at": "2024-02-03T00:00:00Z"}}, summaries={"Robert Smith": "A manager. " * 200, "Acme Corporation": "A firm."},
    )
    memory = Memory(spark, str(tmp_path / "graph"), script, HashEmbedder(16), clock=lambda: "2025-07-01 00:00:00")
    memory.add_episode("e1", one, "2025-01-01 00:00:00", "g", saga="s")
    memory.store.save(community=spark.createDataFrame([("k", "firms", "g", "Firms.")], "uuid string, name string, group_id string, summary string"))
    acme = memory.store.table("entity").where("name = 'Acme Corporation'").first()
    memory.store.save(has_member=spark.createDataFrame([("h", "k", acme["uuid"], "g")], "uuid string, source_node_uuid string, target_node_uuid string, group_id string"))
    memory.add_episode("e2", two, "2025-02-01 00:00:00", "g", saga="s", update_communities=True)
    edges = memory.store.table("entity_edge").collect()
    assert len(edges) == 1 and edges[0]["episodes"] == ["e1", "e2"] and str(edges[0]["valid_at"]) == "2024-02-03 00:00:00"
    entities = {r["name"]: r for r in memory.store.table("entity").collect()}
    assert set(entities) == {"Robert Smith", "Acme Corporation", "Zed Quux"}
    assert len(entities["Robert Smith"]["summary"]) <= 1000 and entities["Robert Smith"]["summary"].endswith(".") and entities["Acme Corporation"]["summary"] == "A firm."
    firms = memory.store.table("community").where("uuid = 'k'").first()
    assert "A firm." in firms["summary"] and firms["name"] == firms["summary"] and firms["name_embedding"] is not None
    members = {r["target_node_uuid"] for r in memory.store.table("has_member").where("source_node_uuid = 'k'").collect()}
    assert members == {acme["uuid"], entities["Robert Smith"]["uuid"]}

    calls = []
    script.saga_summary = lambda name, old, contents: f"{old}|{len(contents)}"
    saga = memory.saga_by_name("s", "g").first()
    done = memory.summarize_sagas([saga["uuid"]]).first()
    assert done["summary"] == "|2" and str(done["last_summarized_at"]) == "2025-07-01 00:00:00" and str(done["last_summarized_episode_valid_at"]) == "2025-02-01 00:00:00"
    assert memory.summarize_sagas([saga["uuid"]]).count() == 0 and not calls
    with pytest.raises(KeyError):
        memory.summarize_sagas(["nope"])
    built = memory.build_communities(["g"], combine=lambda a, b: f"{a}+{b}", describe=lambda x: x[:3]).collect()
    assert len(built) == 1 and len(built[0]["name"]) == 3 and built[0]["uuid"] != "k" and memory.store.table("has_member").count() == 2


def test_triplets_merge_into_known_nodes(spark, tmp_path):
    memory = Memory(spark, str(tmp_path / "graph"), ScriptedExtractor({}, {}), HashEmbedder(16), clock=lambda: "2025-07-01 00:00:00")
    schema = "uuid string, source string, name string, target string, fact string, group_id string, source_attributes map<string,string>, source_summary string, source_labels array<string>"
    memory.add_triplets(spark.createDataFrame([("x1", "Ann", "KNOWS", "Ben", "Ann knows Ben", "g", {"a": "1", "b": "1"}, "first", ["Person"])], schema))
    memory.add_triplets(spark.createDataFrame([("x1", "ann", "KNOWS", "Cid", "Ann knows Cid", "g", {"b": "2"}, "", ["Boss"])], schema))
    ann = memory.store.table("entity").where("name = 'Ann'").first()
    assert ann["attributes"] == {"a": "1", "b": "2"} and ann["summary"] == "first" and ann["labels"] == ["Boss", "Entity", "Person"]
    edges = {r["fact"]: r["uuid"] for r in memory.store.table("entity_edge").collect()}
    assert edges["Ann knows Ben"] == "x1" and len(edges) == 2 and edges["Ann knows Cid"] != "x1"


def test_text_of_each_scope(spark):
    """Facts are found by their relation, entities by their summaries, episodes by name and description, communities by name."""
    table = lambda columns, *rows: spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in columns.split()))
    graph = search.Graph(
        edges=table("uuid fact name group_id", ("e1", "Ann met Ben", "KNOWS", "g"), ("e2", "Ann met Cid", "HIRED", "g")),
        nodes=table("uuid name summary group_id", ("n1", "Ann", "runs a bakery", "g"), ("n2", "Ben", "", "g")),
        episodes=table("uuid content name source_description group_id", ("p1", "hello", "morning", "chat", "g"), ("p2", "hello", "evening", "mail", "g")),
        communities=table("uuid name group_id", ("c1", "bakers", "g"), ("c2", "others", "g")).withColumn("name_embedding", F.lit(None).cast("array<float>")),
    )
    plain = search.Scope(methods=(search.Method.BM25,))
    config = search.Config(edge=plain, node=plain, episode=plain, community=plain)

    def ids(scope, query):
        return [r["uuid"] for r in getattr(search.search(graph, search.Request(query, vector=[1.0]), config), scope).collect()]

    assert ids("edges", "hired") == ["e2"] and ids("nodes", "bakery") == ["n1"] and ids("communities", "bakers") == ["c1"]
    assert ids("episodes", "evening") == ["p2"] and ids("episodes", "chat") == ["p1"]
