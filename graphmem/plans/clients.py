"""Model clients: what is called outside of Spark, and deterministic stand-ins.

A client is a picklable object.  Text in, rows out: calls run in Arrow batches on the executors, never row by row on the driver.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmem.functions.hashed import embed_of

ATTEMPTS, LEAST_WAIT, MOST_WAIT = 4, 5.0, 120.0


class Extractor:
    """What a language model is asked for.  Only ``nodes`` and ``edges`` must be given; a step whose method is not overridden is left out."""

    def nodes(self, content: str, previous: list[str]) -> list[dict]:
        """``name`` and ``entity_type_id`` of each entity."""
        raise NotImplementedError

    def edges(self, content: str, names: list[str]) -> list[dict]:
        """``source``, ``target``, ``relation``, ``fact``, ``valid_at``, ``invalid_at`` of each fact."""
        raise NotImplementedError

    def same_node(self, name: str, candidates: list[str]) -> int:
        """The number of the candidate that is the same entity, or -1."""
        return -1

    def judge(self, fact: str, related: list[str], existing: list[str]) -> dict:
        """``duplicate_facts``: numbers into ``related``; ``contradicted_facts``: numbers into ``related`` followed by ``existing``."""
        return {}

    def times(self, fact: str, content: str, reference: str) -> dict:
        """``valid_at`` and ``invalid_at`` of a fact that came without times."""
        return {}

    def summary(self, name: str, old: str, content: str, previous: list[str]) -> str:
        """What is known of an entity after an episode."""
        return old

    def saga_summary(self, name: str, old: str, contents: list[str]) -> str:
        """What has happened in a saga."""
        return old

    def community_summary(self, one: str, other: str) -> str:
        """Two summaries in one."""
        return f"{one} {other}".strip()

    def community_name(self, summary: str) -> str:
        """A line about a summary."""
        return summary

    def asks(self, method: str) -> bool:
        return getattr(type(self), method) is not getattr(Extractor, method)


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """The stand-in embedder."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [embed_of(t, self.dim) for t in texts]


class ScriptedExtractor(Extractor):
    """Answers by content, name or fact, for tests and replays.

    ``contradicts`` and ``duplicates``: facts by fact; ``same``: names by name; ``when``: times by fact; ``summaries``: by name.
    """

    def __init__(self, nodes: dict[str, list[dict]], edges: dict[str, list[dict]], contradicts: dict[str, list[str]] | None = None, duplicates: dict[str, list[str]] | None = None, same: dict[str, str] | None = None, when: dict[str, dict] | None = None, summaries: dict[str, str] | None = None):
        self._nodes, self._edges = nodes, edges
        self._script = {"judge": (contradicts or {}, duplicates or {}) if contradicts or duplicates else None, "same_node": same, "times": when, "summary": summaries}

    def asks(self, method: str) -> bool:
        return bool(self._script.get(method))

    def nodes(self, content: str, previous: list[str]) -> list[dict]:
        return self._nodes.get(content, [])

    def edges(self, content: str, names: list[str]) -> list[dict]:
        return self._edges.get(content, [])

    def same_node(self, name: str, candidates: list[str]) -> int:
        wanted = self._script["same_node"].get(name)
        return candidates.index(wanted) if wanted in candidates else int(wanted) if (wanted or "").lstrip("-").isdecimal() else -1

    def judge(self, fact: str, related: list[str], existing: list[str]) -> dict:
        contradicts, duplicates = self._script["judge"]
        return {
            "duplicate_facts": [i for i, x in enumerate(related) if x in duplicates.get(fact, [])],
            "contradicted_facts": [i for i, x in enumerate([*related, *existing]) if x in contradicts.get(fact, [])] + [10_000] * (fact in contradicts),
        }

    def times(self, fact: str, content: str, reference: str) -> dict:
        return self._script["times"].get(fact, {})

    def summary(self, name: str, old: str, content: str, previous: list[str]) -> str:
        return self._script["summary"].get(name, old)


def with_retry(call: Callable, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep):
    """``call``, tried again with growing, jittered waits."""

    def run(*args):
        for attempt in range(attempts):
            try:
                return call(*args)
            except Exception:
                if attempt == attempts - 1:
                    raise
                wait(min(MOST_WAIT, LEAST_WAIT * 2**attempt * (1 + random.random())))
        raise AssertionError

    return run


def embedding(embedder: Embedder) -> Callable[[Column], Column]:
    """A Column function that embeds a batch at a time."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(with_retry(embedder.embed)([t or "" for t in texts]), dtype=object)

    return run


def embed_missing(rows: DataFrame, text: str, column: str, embedder: Embedder) -> DataFrame:
    """Embeds only the rows without a vector: those that have one never reach Python."""
    if column not in rows.columns:
        rows = rows.withColumn(column, F.lit(None).cast("array<float>"))
    missing = rows.where(F.col(column).isNull()).withColumn(column, embedding(embedder)(F.col(text)))
    return rows.where(F.col(column).isNotNull()).unionByName(missing)


def scripted_scores(scores: dict[str, float], default: float = 0.0) -> Callable[[str, Column], Column]:
    """A cross-encoder that reads its scores from a table."""

    def run(query: str, passage: Column) -> Column:
        out = F.lit(default)
        for text, score in scores.items():
            out = F.when(passage == text, score).otherwise(out)
        return out

    return run


def log_probability(word: Column, logprob: Column) -> Column:
    """The score of a yes-or-no model: the probability of its first word if that is "true", else of the other."""
    return F.when(F.lower(F.trim(word)) == "true", F.exp(logprob)).otherwise(1 - F.exp(logprob))


NODES = "episode_uuid string, group_id string, pos int, name string, entity_type_id int"
EDGES = "episode_uuid string, group_id string, pos int, source string, target string, name string, fact string, valid_at string, invalid_at string"


def extract_nodes(episodes: DataFrame, client: Extractor) -> DataFrame:
    """Rows of ``NODES``; blank names go. ``episodes``: ``uuid, group_id, content, previous``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retry(client.nodes)
        for batch in batches:
            out = []
            for uuid, group, content, previous in batch[["uuid", "group_id", "content", "previous"]].itertuples(index=False):
                found = call(content or "", list(previous) if previous is not None else [])
                out += [(uuid, group, k, x["name"], x.get("entity_type_id", 0)) for k, x in enumerate(found)]
            yield pd.DataFrame(out, columns=["episode_uuid", "group_id", "pos", "name", "entity_type_id"])

    return episodes.select("uuid", "group_id", "content", "previous").mapInPandas(run, NODES).where(F.trim("name") != "")


def extract_edges(episodes: DataFrame, nodes: DataFrame, client: Extractor) -> DataFrame:
    """Rows of ``EDGES``: facts between two different entities of the episode; a blank fact or an unknown name drops it."""
    named = episodes.join(nodes.groupBy(F.col("episode_uuid").alias("uuid")).agg(F.array_sort(F.collect_set("name")).alias("names")), "uuid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retry(client.edges)
        for batch in batches:
            out = []
            for uuid, group, content, names in batch[["uuid", "group_id", "content", "names"]].itertuples(index=False):
                for k, x in enumerate(call(content or "", list(names))):
                    if x["source"] in names and x["target"] in names and x["source"] != x["target"] and (x.get("fact") or "").strip():
                        out.append((uuid, group, k, x["source"], x["target"], x["relation"], x["fact"], x.get("valid_at"), x.get("invalid_at")))
            yield pd.DataFrame(out, columns=["episode_uuid", "group_id", "pos", "source", "target", "name", "fact", "valid_at", "invalid_at"])

    return named.select("uuid", "group_id", "content", "names").mapInPandas(run, EDGES)


def resolve_nodes(open_: DataFrame, client: Extractor) -> DataFrame:
    """``uuid, resolved_uuid`` of nodes (``uuid, name, candidates`` of ``uuid, name``) that the client finds among their candidates; a number out of range keeps the node new."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retry(client.same_node)
        for batch in batches:
            out = []
            for uuid, name, candidates in batch.itertuples(index=False):
                at = call(name, [c["name"] for c in candidates])
                if 0 <= at < len(candidates):
                    out.append((uuid, candidates[at]["uuid"]))
            yield pd.DataFrame(out, columns=["uuid", "resolved_uuid"])

    return open_.select("uuid", "name", "candidates").mapInPandas(run, "uuid string, resolved_uuid string")


def judge_edges(pools: DataFrame, client: Extractor) -> DataFrame:
    """``uuid, duplicates, contradicted`` (arrays of uuids) of edges (``uuid, fact, related, existing``); numbers out of range are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retry(client.judge)
        for batch in batches:
            out = []
            for uuid, fact, related, existing in batch.itertuples(index=False):
                related, existing = list(related), list(existing)
                found = call(fact, [x["fact"] for x in related], [x["fact"] for x in existing])
                every = [x["uuid"] for x in [*related, *existing]]
                out.append((uuid, [every[i] for i in found.get("duplicate_facts", []) if 0 <= i < len(related)], [every[i] for i in found.get("contradicted_facts", []) if 0 <= i < len(every)]))
            yield pd.DataFrame(out, columns=["uuid", "duplicates", "contradicted"])

    return pools.select("uuid", "fact", "related", "existing").mapInPandas(run, "uuid string, duplicates array<string>, contradicted array<string>")


def fact_times(edges: DataFrame, client: Extractor) -> DataFrame:
    """``uuid, valid_at, invalid_at`` (strings) of edges (``uuid, fact, content, reference``); a client that fails leaves a fact without times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for uuid, fact, content, reference in batch.itertuples(index=False):
                try:
                    found = client.times(fact, content or "", reference or "") or {}
                except Exception:  # times are an extra: the fact stays
                    found = {}
                out.append((uuid, found.get("valid_at"), found.get("invalid_at")))
            yield pd.DataFrame(out, columns=["uuid", "valid_at", "invalid_at"])

    return edges.select("uuid", "fact", "content", "reference").mapInPandas(run, "uuid string, valid_at string, invalid_at string")


def node_summaries(nodes: DataFrame, client: Extractor) -> DataFrame:
    """``uuid, summary`` of nodes (``uuid, name, summary, content, previous``), a call for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retry(client.summary)
        for batch in batches:
            out = [(uuid, call(name, old or "", content or "", list(previous) if previous is not None else [])) for uuid, name, old, content, previous in batch.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["uuid", "summary"])

    return nodes.select("uuid", "name", "summary", "content", "previous").mapInPandas(run, "uuid string, summary string")


def saga_summaries(sagas: DataFrame, client: Extractor) -> DataFrame:
    """``uuid, summary`` of sagas (``uuid, name, summary, contents``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retry(client.saga_summary)
        for batch in batches:
            yield pd.DataFrame([(uuid, call(name or "", old or "", list(contents))) for uuid, name, old, contents in batch.itertuples(index=False)], columns=["uuid", "summary"])

    return sagas.select("uuid", "name", "summary", "contents").mapInPandas(run, "uuid string, summary string")
