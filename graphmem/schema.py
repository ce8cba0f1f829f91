"""Row layouts of the memory graph: one table for each kind of node and edge, ``group_id`` on all of them."""

from __future__ import annotations

from pyspark.sql import types as T

S, TS, STR = T.StructType, T.TimestampType(), T.StringType()
STRINGS, VECTOR, ATTRIBUTES = T.ArrayType(STR), T.ArrayType(T.FloatType()), T.MapType(STR, STR)


def _table(**columns: T.DataType) -> T.StructType:
    return S([T.StructField(k, v, k != "uuid") for k, v in columns.items()])


ENTITY = _table(uuid=STR, name=STR, group_id=STR, labels=STRINGS, created_at=TS, summary=STR, attributes=ATTRIBUTES, name_embedding=VECTOR)
ENTITY_EDGE = _table(uuid=STR, source_node_uuid=STR, target_node_uuid=STR, name=STR, fact=STR, group_id=STR, episodes=STRINGS, created_at=TS, expired_at=TS, valid_at=TS, invalid_at=TS, attributes=ATTRIBUTES, fact_embedding=VECTOR)
EPISODE = _table(uuid=STR, name=STR, group_id=STR, labels=STRINGS, source=STR, source_description=STR, content=STR, entity_edges=STRINGS, created_at=TS, valid_at=TS)
LINK = _table(uuid=STR, source_node_uuid=STR, target_node_uuid=STR, group_id=STR, created_at=TS)
COMMUNITY = _table(uuid=STR, name=STR, group_id=STR, labels=STRINGS, created_at=TS, summary=STR, name_embedding=VECTOR)
SAGA = _table(uuid=STR, name=STR, group_id=STR, labels=STRINGS, created_at=TS, summary=STR, first_episode_uuid=STR, last_episode_uuid=STR, last_summarized_at=TS, last_summarized_episode_valid_at=TS)

#: Table name to layout; MENTIONS, HAS_MEMBER, HAS_EPISODE and NEXT_EPISODE share one.
TABLES = {"entity": ENTITY, "entity_edge": ENTITY_EDGE, "episode": EPISODE, "mentions": LINK, "community": COMMUNITY, "has_member": LINK, "saga": SAGA, "has_episode": LINK, "next_episode": LINK}
EPISODE_SOURCES = ("message", "text", "json")
EPISODE_WINDOW, SAGA_EPISODES, MAX_SUMMARY_CHARS = 10, 200, 1000
