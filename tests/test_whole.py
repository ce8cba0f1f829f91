"""Queries that read whole tables and whole texts, against brute force."""

import re
from datetime import datetime, timedelta

from graphmem import catalog
from graphmem.operators import community


def lower_words(s):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", s).strip(" ").lower()


def test_normalize_names(spark, tmp_path):
    texts = ["Short  NAME", "x" * 199 + "  Caf\u00e9 \n\n Tail's END! " + "Word, " * 500, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["exact"], r["fuzzy"]) for r in catalog.QUERIES["normalize_names"](spark, str(tmp_path)).collect()}
    for k, s in enumerate(texts):
        exact = None if s is None else lower_words(s)
        assert got[k] == (exact, None if s is None else lower_words(re.sub(r"[^a-z0-9' ]", " ", exact)))


def events(spark, path):
    """40 events of two users with ids beyond all bounds; one in four has an embedding."""
    start, kinds = datetime(2024, 1, 1), ["view", "buy", "add to cart"]
    rows = [(i, i // 150 % 2, start + timedelta(minutes=i * 7 % 400), kinds[i // 50 % 3]) for i in range(200, 200 + 50 * 40, 50)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string").write.parquet(f"{path}/events.parquet")
    vectors = {i: [float(i % 5 - 2), float(i % 7 - 3), 1.0] for i, *_ in rows[::4]}
    spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return rows, vectors


def iso(x):
    return x and str(x)


def test_events_whole(spark, tmp_path):
    rows, vectors = events(spark, tmp_path)
    run = lambda name: sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
    pairs = [(a, b) for a in rows for b in rows if a[1] == b[1] and a[0] != b[0]]
    want = []
    for a, b in (x for x in pairs if x[0][0] % 100 == 0):
        end = b[2] + timedelta(minutes=60) if b[0] % 3 == 0 else None
        closes = not (end and end <= a[2]) and b[2] < a[2]
        want.append((f"ev:{a[0]}", f"ev:{b[0]}", iso(a[2] if closes else end), catalog.NOW if closes else None))
    assert run("contradiction_pairs") == sorted(want, key=repr)
    later = {a[0]: min((b[2] for b in rows if b[1] == a[1] and b[2] > a[2]), default=None) for a in rows}
    assert run("expire_new_edge") == sorted(((f"ev:{i}", iso(x), catalog.NOW if x else None) for i, x in later.items()), key=repr)

    def near(a, b):
        v, w = vectors.get(a[0]), vectors.get(b[0])
        words = [set(f"{x[3]} {x[0] % 5}".split()) for x in (a, b)]
        dot = v and w and sum(p * q for p, q in zip(v, w, strict=True)) / (sum(p * p for p in v) * sum(q * q for q in w)) ** 0.5
        return bool(words[0] & words[1]) or bool(dot and dot >= 0.6)

    assert run("edge_candidate_gate") == sorted(((f"ev:{a[0]}", f"ev:{b[0]}") for a, b in pairs if a[0] % 100 == 0 and near(a, b)), key=repr)


def test_closures_whole(spark, tmp_path):
    orders = [(k, k * k % 31) for k in range(1, 60) if k % 5]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for k, c in orders:
        a, b = find(f"c:{c}"), find(f"k:{k % 97}:{c % 7}")
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(root)}
    assert {r["uuid"]: r["root"] for r in catalog.QUERIES["uuid_closure_min_root"](spark, str(tmp_path)).collect()} == want
    # The directed form has other roots and the same components.
    got = {r["uuid"]: r["root"] for r in catalog.QUERIES["uuid_closure_directed"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and len(set(got.values())) == len(set(zip(got.values(), (want[x] for x in got)))) == len(set(want.values()))


def test_pointer_remap_whole(spark, small):
    got = catalog.QUERIES["pointer_remap"](spark, small).collect()
    assert any(r["uuid"].startswith("ord:") and r["source"].startswith("x:") for r in got)


def test_node_candidates(spark, tmp_path):
    """Queries grow with the table, and blocks change nothing."""
    rows = [(i, [float(i * 7 % 11 - 5), float(i * 3 % 13 - 6), 1.0], i // 50 % 2) for i in range(1000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["query_uuid"], r["rank"]): (r["uuid"], r["score"]) for r in catalog.QUERIES["node_candidates"](spark, str(tmp_path)).collect()}
    cosine = lambda v, w: sum(p * q for p, q in zip(v, w, strict=True)) / (sum(p * p for p in v) * sum(q * q for q in w)) ** 0.5
    want = {}
    for i, v, label in rows[::100]:
        near = sorted((-round(cosine(v, w), 9), f"v:{k}") for k, w, own in rows if own == label and cosine(v, w) > 0.15)[:15]
        want |= {(f"v:{i}", k + 1): (u, round(-c, 6)) for k, (c, u) in enumerate(near)}
    assert {q for q, _ in got} == {f"v:{i}" for i in range(0, 1000, 100)}
    assert {k: c for k, (_, c) in got.items()} == {k: c for k, (_, c) in want.items()}


def propagated(rows):
    """``(group, smallest member, member)`` of the clusters of ``(group, node, neighbor, edge count)``, by a loop."""
    label, links = {}, {}
    for g in {r[0] for r in rows}:
        label |= {(g, u): k for k, u in enumerate(sorted({r[1] for r in rows if r[0] == g}))}
    for g, a, b, n in rows:
        if b is not None:
            links.setdefault((g, a), []).append(((g, b), n))
    while True:
        after = {}
        for node, own in label.items():
            votes = {}
            for other, n in links.get(node, []):
                votes[label[other]] = votes.get(label[other], 0) + n
            n, theirs = max(((n, x) for x, n in votes.items()), default=(2, own))
            after[node] = theirs if n > 1 else max(theirs, own)
        if after == label:
            break
        label = after
    least = {}
    for (g, u), x in label.items():
        least[g, x] = min(least.get((g, x), u), u)
    return {(g, least[g, x], u) for (g, u), x in label.items()}


def test_label_propagation_settles(spark, small, monkeypatch):
    """The test tables, and a path that takes 25 rounds."""
    own = [tuple(r) for r in catalog.QUERIES["adjacency_projection"](spark, small).select("group_id", "node_uuid", "neighbor_uuid", "edge_count").collect()]
    got = catalog.QUERIES["label_propagation_clusters"](spark, small).collect()
    assert {tuple(r) for r in got} == propagated(own)
    path = [("g", f"n{a:02}", f"n{b:02}", 1) for a in range(26) for b in (a - 1, a + 1) if 0 <= b < 26]
    monkeypatch.setattr(catalog.traverse, "adjacency", lambda *_: spark.createDataFrame(path, "group_id string, node_uuid string, neighbor_uuid string, edge_count long"))
    got = catalog.QUERIES["label_propagation_clusters"](spark, small).collect()
    assert {tuple(r) for r in got} == propagated(path)
    assert len({r["uuid"] for r in got}) == 1


def test_label_propagation_swings(spark, monkeypatch):
    """Labels that swing for ever are those of the cap, after few rounds: a pair by 2, a ring by 3, both by 6, from the second round on."""
    links = [("g", a, b, 2) for a, b in ("ab", "ba", "xy", "yz", "zx")] + [("h", a, b, 1) for a, b in ("pq", "qp", "qr", "rq")]
    graph = spark.createDataFrame(links, "group_id string, node_uuid string, neighbor_uuid string, edge_count long").coalesce(1)
    rounds, written = [], community.written

    def counted(df, name):
        rounds.append(name)
        assert len(rounds) <= 40
        return written(df, name)

    monkeypatch.setattr(community, "written", counted)
    for cap in (4, 20, 1000, 1001):
        rounds.clear()
        got = {r["node_uuid"]: r["label"] for r in community.label_propagation(graph, cap).collect()}
        want = {x: x for x in "abxyzpqr"}
        for _ in range(cap):
            after = dict(want)
            for x in want:
                votes = {t: sum(n for _, a, b, n in links if a == x and want[b] == t) for t in {want[b] for _, a, b, _ in links if a == x}}
                n, theirs = max((n, t) for t, n in votes.items())
                after[x] = theirs if n > 1 else max(theirs, want[x])
            want = after
        assert got == want
