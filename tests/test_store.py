"""The store: last writes, the empty group, deltas, conflicts, merges and clean-up."""

import os

import pytest
from pyspark.sql import functions as F

from graphmem.plans import search
from graphmem.sources import store as module
from graphmem.sources.store import Conflict, GraphStore

ROW = "uuid string, name string, group_id string"


def rows(spark, *given, pos=False):
    return spark.createDataFrame(list(given), ROW + ", _pos long" * pos)


def names(store, groups=None):
    return {r["uuid"]: r["name"] for r in store.table("entity", groups).collect()}


def test_last_write_wins(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    store.save(entity=rows(spark, ("a", "first", ""), ("a", "second", ""), ("a", "third", ""), ("b", "b", None)))
    assert names(store) == {"a": "third", "b": "b"}
    store.save(entity=rows(spark, ("a", "late", "", 9), ("a", "early", "", 1), pos=True))
    assert names(store) == {"a": "late", "b": "b"}
    assert {r["group_id"] for r in store.table("entity").collect()} == {""}
    assert names(store, [""]) == {"a": "late", "b": "b"}  # the list with the empty group means all groups


def test_deltas_deletes_and_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "MERGED", 3)
    path = str(tmp_path / "g")
    store = GraphStore(spark, path)
    store.save(entity=rows(spark, *[(f"n{k}", "x" * 50, f"g{k % 5}") for k in range(2000)]))

    def size(version):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{path}/entity/v={version}") for f in files)

    store.save(entity=rows(spark, ("n1", "new", "g1")))
    assert size(2) < size(1) / 5
    edge = spark.createDataFrame([("e", "n1", "n2", "g1")], "uuid string, source_node_uuid string, target_node_uuid string, group_id string")
    store.save(entity_edge=edge)
    store.delete("entity", rows(spark, ("n2", "", "g2")))
    got = names(store)
    assert len(got) == 1999 and got["n1"] == "new" and "n2" not in got and store.table("entity_edge").count() == 0
    assert [f[2] for f in store.manifest()["entity"]] == [1]  # three folders became one
    assert len(names(store, ["g1"])) == 400
    assert any("bucket" in x and "group_id" in x for x in [store.table("entity", ["g1"])._jdf.queryExecution().optimizedPlan().toString()])
    assert store.batch("entity", 2).count() == 1
    old = store.table("entity", version=1).count()
    assert old == 2000
    store.vacuum(1)
    assert names(store) == got and not os.listdir(f"{path}/entity/v=1")
    store.clear("entity")
    assert store.table("entity").count() == 0


def test_two_writers(spark, tmp_path, monkeypatch):
    store = GraphStore(spark, str(tmp_path / "g"))
    since = store.version()
    store.save(entity=rows(spark, ("a", "one", "")))
    with pytest.raises(Conflict):
        store.save(since=since, entity=rows(spark, ("a", "two", "")))
    other = GraphStore(spark, store.path)
    monkeypatch.setattr(other, "version", lambda: 0)  # looked before the first commit, publishes after it
    with pytest.raises(Conflict):
        other.save(entity=rows(spark, ("a", "three", "")))
    assert names(store) == {"a": "one"} and store.version() == 1


def test_stored_index(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    store.save(entity=spark.createDataFrame([(f"n{k}", f"name {k}", "alpha beta" if k % 3 else "gamma", "g") for k in range(30)], "uuid string, name string, summary string, group_id string"))
    plain = [tuple(r) for r in search.search_index(store, "entity", "gamma 7", 5).select("uuid", F.round("score", 9)).collect()]
    search.build_indices(store)
    assert [tuple(r) for r in search.search_index(store, "entity", "gamma 7", 5).select("uuid", F.round("score", 9)).collect()] == plain and plain[0][0] == "n7"
