"""Prompts, checked answers, token counts and the ledger."""

import pytest

from graphmem.operators import maintenance
from graphmem.plans.clients import HashEmbedder
from graphmem.plans.engine import Memory
from graphmem.plans.model import SCHEMAS, Ledger, ModelExtractor, checked, message_tokens


def model():
    """A function of its own, so that it travels to the workers by value."""
    import json

    from graphmem.plans.model import SCHEMAS

    def answers(messages, schema, size):
        """A model that knows one sentence."""
        asked = json.loads(messages[1]["content"])
        if schema == SCHEMAS["nodes"]:
            assert size == "medium" and asked["entity_types"][1] == {"entity_type_id": 1, "name": "Person"}
            return {"extracted_entities": [{"name": "Ann", "entity_type_id": 1}, {"name": "Bolt Ltd", "entity_type_id": 7}]}
        if schema == SCHEMAS["edges"]:
            return json.dumps({"edges": [{"source_entity_name": "Ann", "target_entity_name": "Bolt Ltd", "relation_type": "OWNS", "fact": asked["current_episode"], "valid_at": None}]})
        if schema == SCHEMAS["times"]:
            return {"valid_at": "2024-05-06T00:00:00Z"}
        if schema == SCHEMAS["summary"]:
            return {"summary": f"{asked.get('entity', '')} is known."}
        if schema == SCHEMAS["judged"]:
            return {"duplicate_facts": [], "contradicted_facts": [99]}
        return {"entity_resolutions": [{"id": 0, "duplicate_candidate_id": -1}]}

    return answers


def test_answers_are_checked():
    assert checked('{"summary": "x", "more": 1}', SCHEMAS["summary"]) == {"summary": "x"}
    assert checked({"valid_at": None}, SCHEMAS["times"]) == {}
    for bad in ({}, {"summary": 3}, "[]", "{"):
        with pytest.raises(ValueError):
            checked(bad, SCHEMAS["summary"])
    with pytest.raises(ValueError):
        checked({"duplicate_facts": [True], "contradicted_facts": []}, SCHEMAS["judged"])
    assert message_tokens([{"content": "abcd"}, {"content": "abcde"}]) == 4 + 1 + 4 + 2 + 3


def test_an_episode_through_a_model_is_metered(spark, tmp_path):
    ledger = Ledger(spark)
    ledger.operation = "add_episode 1"
    memory = Memory(spark, str(tmp_path / "graph"), ModelExtractor(model(), ["Person"], ledger), HashEmbedder(16), clock=lambda: "2025-07-01 00:00:00")
    memory.add_episode("e1", "Ann owns Bolt Ltd.", "2025-01-01 00:00:00")
    nodes = {r["name"]: r for r in memory.store.table("entity").collect()}
    assert nodes["Ann"]["labels"] == ["Entity", "Person"] and nodes["Bolt Ltd"]["labels"] == ["Entity"] and nodes["Ann"]["summary"] == "Ann is known."
    edge = memory.store.table("entity_edge").first()
    assert edge["name"] == "OWNS" and str(edge["valid_at"]) == "2024-05-06 00:00:00" and edge["invalid_at"] is None
    rows = ledger.rows(spark)
    labels = {r["label"]: r for r in rows.collect()}
    assert {"extract_nodes.extract_message", "extract_edges.edge", "extract_edges.extract_timestamps", "summarize_nodes.summarize_context"} <= set(labels)
    assert labels["summarize_nodes.summarize_context"]["model"] == "small" and all(r["tokens_in"] > 0 and r["tokens_out"] > 0 for r in labels.values())
    total = maintenance.cost_rollup(rows, "label").where("label is null").first()
    assert total["calls"] == sum(r["calls"] for r in labels.values()) and total["cost"] > 0
    monthly = maintenance.monthly(rows.withColumn("label", rows["operation"]), 100).first()["monthly_cost"]
    assert monthly == pytest.approx(total["cost"] * 100 * 30)
