"""Rank fusion, rerankers, time rules, closures and communities against explicit models."""

import itertools

import pytest
from pyspark.sql import functions as F

from graphmem.operators import community, dedup, filters, fulltext, fusion, temporal, traverse
from graphmem.operators.filters import Comparison, DateFilter, SearchFilters


def lists(spark, *given):
    rows = [(i, p, u) for i, x in enumerate(given) for p, u in enumerate(x)]
    return spark.createDataFrame(rows, "list_ix int, pos int, uuid string")


def in_rank(df):
    return [(r["uuid"], r["score"]) for r in df.orderBy("rank").collect()]


def test_rrf(spark):
    assert [u for u, _ in in_rank(fusion.rrf(lists(spark, ["a", "b", "c"], ["b", "a"])))] == ["a", "b", "c"]
    assert in_rank(fusion.rrf(lists(spark, ["a", "b"]), 0.6)) == [("a", 1.0)]
    assert in_rank(fusion.rrf(lists(spark, ["x"], ["y"]))) == [("x", 1.0), ("y", 1.0)]


def vectors(spark, **given):
    return spark.createDataFrame([(k, i + 1, v) for i, (k, v) in enumerate(given.items())], "uuid string, rank int, embedding array<float>")


def test_mmr(spark):
    found = vectors(spark, far=[0.0, 1.0], near=[1.0, 0.0], mid=[1.0, 1.0])
    assert [u for u, _ in in_rank(fusion.mmr(found, [1.0, 0.0], 1.0))] == ["near", "mid", "far"]
    found = vectors(spark, dup_a=[1.0, 0.0], dup_b=[1.0, 0.0], other=[0.0, 1.0])
    assert in_rank(fusion.mmr(found, [1.0, 1.0], 0.5))[0][0] == "other"
    assert in_rank(fusion.mmr(vectors(spark, only=[1.0, 0.0]), [1.0, 0.0], 0.5)) == [("only", 0.5)]
    assert [u for u, _ in in_rank(fusion.mmr(vectors(spark, aligned=[1.0, 0.0], zero=[0.0, 0.0]), [1.0, 0.0], 1.0))] == ["aligned", "zero"]


EDGE = "uuid string, source_node_uuid string, target_node_uuid string, name string, group_id string"


def test_node_distance(spark):
    edges = spark.createDataFrame([("e", "center", "adj", "R", "g")], EDGE)
    found = spark.createDataFrame([("adj", 2), ("far", 1)], "uuid string, rank int")
    assert in_rank(fusion.node_distance(found, edges, "center")) == [("adj", 1.0), ("far", 0.0)]
    assert in_rank(fusion.node_distance(found, edges, "center", 0.5)) == [("adj", 1.0)]
    found = spark.createDataFrame([("adj", 1), ("center", 2)], "uuid string, rank int")
    assert in_rank(fusion.node_distance(found, edges, "center")) == [("center", 10.0), ("adj", 1.0)]


def test_mentions(spark):
    counts = spark.createDataFrame([("low", 1), ("high", 5)], "uuid string, mentions long")
    found = spark.createDataFrame([("high", 1), ("low", 2), ("ghost", 3)], "uuid string, rank int")
    assert in_rank(fusion.episode_mentions(found, counts)) == [("low", 1.0), ("high", 5.0), ("ghost", float("inf"))]


def test_missing_cross_encoder(spark):
    with pytest.raises(ValueError, match="client"):
        fusion.cross_encode(None, None, None, "q")


T = [None] + [f"2025-01-01 {h:02d}:00:00" for h in range(1, 13)]
PAIRS = [  # new valid, invalid; old valid, invalid, expired; expected invalid, expired (hours)
    ((3, 0), (1, 2, 0), (2, 0)),
    ((1, 2), (3, 0, 0), (0, 0)),
    ((5, 0), (1, 0, 0), (5, 12)),
    ((5, 0), (1, 0, 2), (5, 2)),
    ((0, 0), (1, 0, 0), (0, 0)),
    ((5, 0), (5, 0, 0), (0, 0)),
    ((5, 0), (7, 0, 0), (0, 0)),
    ((3, 0), (1, 3, 0), (3, 0)),
    ((1, 3), (3, 0, 0), (0, 0)),
    ((5, 0), (1, 10, 0), (5, 12)),
]


def hour(x):
    return x.hour if x else 0


def test_contradictions(spark):
    rows = [(i, *(T[h] for h in new + old)) for i, (new, old, _) in enumerate(PAIRS)]
    names = ["new_valid", "new_invalid", "old_valid", "old_invalid", "old_expired"]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} string" for n in names))
    df = df.select("i", *[F.col(n).cast("timestamp").alias(n) for n in names])
    got = temporal.close_contradicted(df, F.lit(T[12]).cast("timestamp")).orderBy("i").collect()
    assert [(hour(r["invalid_at"]), hour(r["expired_at"])) for r in got] == [e for _, _, e in PAIRS]


NEW = [((3, 0, 0), [7], (7, 12)), ((3, 0, 0), [9, 5], (5, 12)), ((3, 0, 0), [3], (0, 0)), ((3, 4, 0), [7], (4, 12)), ((3, 0, 2), [7], (0, 2)), ((3, 0, 0), [], (0, 0)), ((0, 0, 0), [7], (0, 0)), ((3, 0, 0), [0, 9, 5], (5, 12))]


def test_new_edges(spark):
    edges = spark.createDataFrame([(str(i), *(T[h] for h in e)) for i, (e, _, _) in enumerate(NEW)], "uuid string, valid_at string, invalid_at string, expired_at string")
    edges = edges.select("uuid", *[F.col(n).cast("timestamp").alias(n) for n in ("valid_at", "invalid_at", "expired_at")])
    later = spark.createDataFrame([(str(i), T[h]) for i, (_, c, _) in enumerate(NEW) for h in c], "uuid string, at string").select("uuid", F.col("at").cast("timestamp").alias("candidate_valid"))
    got = temporal.expire_new(edges, later, F.lit(T[12]).cast("timestamp")).orderBy("uuid").collect()
    assert [(hour(r["invalid_at"]), hour(r["expired_at"])) for r in got] == [e for _, _, e in NEW]


def test_components_and_closure(spark):
    pairs = [("a", "b"), ("b", "c"), ("x", "y"), ("d", "c"), ("p", "p")] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "a string, b string, seq int")
    got = {r["uuid"]: r["root"] for r in dedup.components(df).collect()}
    assert got["d"] == "a" and got["y"] == "x" and got["n060"] == "n000"
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[ra] = rb
    assert {r["uuid"]: r["root"] for r in dedup.directed_closure(df).collect()} == {x: find(x) for x in parent}


def adjacency(spark, *edges, alone=()):
    rows = [("g", a, b, n) for x, y, n in edges for a, b in ((x, y), (y, x))] + [("g", x, None, 0) for x in alone]
    return spark.createDataFrame(rows, "group_id string, node_uuid string, neighbor_uuid string, edge_count long")


def groups(labels):
    found = {}
    for r in labels.collect():
        found.setdefault(r["label"], set()).add(r["node_uuid"])
    return sorted(map(sorted, found.values()))


def test_label_propagation(spark):
    triangle = list(itertools.combinations("abc", 2))
    assert groups(community.label_propagation(adjacency(spark, *[(a, b, 2) for a, b in triangle]))) == [["a", "b", "c"]]
    assert groups(community.label_propagation(adjacency(spark, alone=["solo"]))) == [["solo"]]
    two = [(a, b, 3) for a, b in triangle] + [(a, b, 3) for a, b in itertools.combinations("xyz", 2)]
    assert groups(community.label_propagation(adjacency(spark, *two))) == [["a", "b", "c"], ["x", "y", "z"]]
    swing = community.label_propagation(adjacency(spark, ("a", "b", 1)), 5)
    assert {r["node_uuid"] for r in swing.collect()} == {"a", "b"}


def test_votes(spark):
    member = spark.createDataFrame([("c1", "n1"), ("c1", "n2"), ("c2", "n3")], "source_node_uuid string, target_node_uuid string")
    edges = spark.createDataFrame([(f"e{i}", "t", f"n{i}", "R", "g") for i in (1, 2, 3)], EDGE)
    nodes = spark.createDataFrame([("t",), ("n3",), ("lone",)], "uuid string")
    assert {tuple(r) for r in community.vote(edges, member, nodes).collect()} == {("t", "c1", True), ("n3", "c2", False)}


def test_tree_of_summaries(spark):
    rows = [("u4", f"m{i}", f"s{i}") for i in range(4)] + [("u3", f"m{i}", f"s{i}") for i in range(3)] + [("u1", "m0", "s0")]
    df = spark.createDataFrame(rows, "uuid string, node_uuid string, summary string")
    got = {r["uuid"]: (r["summary"], r["calls"]) for r in community.summarize(df, lambda a, b: f"({a}{b})").collect()}
    assert got == {"u4": ("((s0s1)(s2s3))", 3), "u3": ("((s0s1)s2)", 2), "u1": ("s0", 0)}


def test_bfs(spark):
    nodes = spark.createDataFrame([(x, x, "g" if x != "z" else "h", ["Entity"]) for x in "abcz"], "uuid string, name string, group_id string, labels array<string>")
    edges = spark.createDataFrame([("ab", "a", "b", "R", "g"), ("bc", "b", "c", "R", "g"), ("ca", "c", "a", "R", "g"), ("bz", "b", "z", "R", "g")], EDGE)
    origin = nodes.where("uuid = 'a'").select("uuid", "group_id")
    reached = [{r["uuid"] for r in traverse.bfs_nodes(nodes, edges, origin, d).collect()} for d in (1, 2, 3)]
    assert reached == [{"b"}, {"b", "c"}, {"a", "b", "c"}]
    assert {r["uuid"] for r in traverse.bfs_edges(edges, origin, 2).collect()} == {"ab", "bc", "bz"}


def test_filters(spark):
    nodes = spark.createDataFrame([("a", ["Entity", "P"]), ("b", ["Entity", "P"]), ("c", ["Entity"])], "uuid string, labels array<string>")
    rows = [("e1", "a", "b", "WORKS_AT", "g", "2025-01-01"), ("e2", "a", "b", "KNOWS", "g", "2024-01-01"), ("e3", "a", "c", "WORKS_AT", "g", None)]
    edges = spark.createDataFrame(rows, EDGE + ", at string").withColumn("valid_at", F.col("at").cast("timestamp"))

    def ids(f):
        return [r["uuid"] for r in filters.filter_edges(edges, f, nodes).orderBy("uuid").collect()]

    assert ids(SearchFilters()) == ["e1", "e2", "e3"]
    assert ids(SearchFilters(edge_uuids=[])) == []
    assert ids(SearchFilters(node_labels=[])) == ["e1", "e2", "e3"]
    assert ids(SearchFilters(node_labels=["P"])) == ["e1", "e2"]
    since = [[DateFilter(Comparison.GREATER, "2024-06-01")], [DateFilter(Comparison.IS_NULL)]]
    assert ids(SearchFilters(edge_types=["WORKS_AT"], valid_at=since)) == ["e1", "e3"]
    assert ids(SearchFilters(valid_at=[[DateFilter(Comparison.NOT_EQUALS, "2024-01-01")]])) == ["e1"]
    assert ids(SearchFilters(valid_at=[[]])) == ["e1", "e2", "e3"]
    with pytest.raises(ValueError, match="label"):
        filters.filter_edges(edges, SearchFilters(node_labels=["a-b"]), nodes)


def test_resolve(spark):
    own = spark.createDataFrame([("n1", "ACME  corp", "g"), ("n2", "Jonathan Appleseed Smith", "g"), ("n3", "twin", "g"), ("n4", "Bob", "g")], "uuid string, name string, group_id string")
    had = spark.createDataFrame([("o1", "Acme Corp", "g"), ("o2", "jonathan appleseed smith!", "g"), ("o3", "Twin", "g"), ("o4", "TWIN", "g")], "uuid string, name string, group_id string")
    assert {r["uuid"]: r["resolved_uuid"] for r in dedup.resolve(own, had).collect()} == {"n1": "o1", "n2": "o2", "n3": None, "n4": None}




def test_bm25_splits_a_text_once_for_statistics_and_once_for_scores(spark):
    rows = spark.createDataFrame([("a", "g", "one two"), ("b", "g", "two three two")], "uuid string, group_id string, fact string")
    found = fulltext.bm25(rows, F.col("fact"), "one two three four five", 5, ["g"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2
    assert [r["uuid"] for r in found.collect()] == ["a", "b"]


@pytest.mark.parametrize("least", [0.3, 0.5, 1.0])
def test_similar_keys_lose_no_pair(spark, least):
    words = ["red", "green", "blue", "iron", "steel", "", "a", "ab"]
    keys = sorted({" ".join(x) for n in (1, 2, 3) for x in itertools.combinations(words, n)})

    def grams(key):
        bare = key.replace(" ", "")
        return {bare[i : i + 3] for i in range(max(1, len(bare) - 2))} if len(bare) != 2 and bare else set()

    model = {}
    for a, b in itertools.combinations(keys, 2):
        both = grams(a) | grams(b)
        if both and len(grams(a) & grams(b)) / len(both) >= least:
            model[a, b] = len(grams(a) & grams(b)) / len(both)
    got = dedup.similar_keys(spark.createDataFrame([(k,) for k in keys + keys[:5]], "key string"), least).collect()
    assert len(got) == len(model) and {(r["a"], r["b"]): r["jaccard"] for r in got} == pytest.approx(model)
