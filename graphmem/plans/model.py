"""An extractor over a language model: prompts, checked answers, and a ledger of what was asked.

``complete(messages, schema, size)`` is all that is asked of a model: a JSON object, as a dict or as text, for messages of ``role`` and ``content``.
``size`` is "medium" or "small".  An answer that doesn't fit its schema is an error, and is asked for again as any other error is.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame, SparkSession

from graphmem.plans.clients import Extractor

#: Tokens around a message, and at the end of all.
PER_MESSAGE, PER_CALL = 4, 3
#: The fields of each answer and their types; ``?`` marks one that may be missing or null.  Fixed names: recorded answers use them.
SCHEMAS = {
    "nodes": {"extracted_entities": [{"name": str, "entity_type_id": int}]},
    "edges": {"edges": [{"source_entity_name": str, "target_entity_name": str, "relation_type": str, "fact": str, "valid_at?": str, "invalid_at?": str}]},
    "times": {"valid_at?": str, "invalid_at?": str},
    "same": {"entity_resolutions": [{"id": int, "duplicate_candidate_id": int}]},
    "judged": {"duplicate_facts": [int], "contradicted_facts": [int]},
    "summary": {"summary": str},
    "line": {"description": str},
}
RULES = {
    "extract_nodes.extract_message": "List the people, places, organisations and things that the current episode is about, each once, by the fullest name it uses. Earlier episodes only help to read it. Give each the number of its type.",
    "extract_edges.edge": "List the facts that the episode states about two different entities of the list. Write each fact as one sentence of its own, with a relation in capitals, and when it began or ended to hold if the episode says so, in ISO 8601.",
    "extract_edges.extract_timestamps": "Say when the fact began to hold and when it ended, in ISO 8601, as far as the episode tells; count from the reference time.",
    "dedupe_nodes.nodes": "Say which candidate is the very same entity as the new one, by its number, or -1 if none is.",
    "dedupe_edges.resolve_edge": "Give the numbers of the existing facts that say the same as the new one, and of all listed facts that can't hold any more now that it does.",
    "summarize_nodes.summarize_context": "Write in a few sentences what is known of the entity, from its summary so far and the episode. Leave out what neither says.",
    "summarize_nodes.summarize_pair": "Write both summaries as one, in a few sentences.",
    "summarize_nodes.summary_description": "Say in one line what the summary is about.",
    "summarize_sagas.summarize_saga": "Carry the summary of the saga on with its new episodes, in the order in which they happened.",
}
SMALL = {"extract_edges.extract_timestamps", "dedupe_edges.resolve_edge", "summarize_nodes.summarize_context"}


def checked(answer: dict | str, schema: dict) -> dict:
    """An answer whose fields are those of the schema; others are left out."""

    def fit(value, kind):
        if isinstance(kind, list):
            if not isinstance(value, list):
                raise ValueError(f"not a list: {value!r}")
            return [fit(x, kind[0]) for x in value]
        if isinstance(kind, dict):
            if not isinstance(value, dict):
                raise ValueError(f"not an object: {value!r}")
            return {k.rstrip("?"): fit(value.get(k.rstrip("?")), t) for k, t in kind.items() if not (k.endswith("?") and value.get(k.rstrip("?")) is None)}
        if not isinstance(value, kind) or isinstance(value, bool):
            raise ValueError(f"not a {kind.__name__}: {value!r}")
        return value

    return fit(json.loads(answer) if isinstance(answer, str) else answer, schema)


def estimated_tokens(text: str) -> int:
    """A token for each four bytes begun; a real tokenizer's count can be given in its place."""
    return math.ceil(len(text.encode()) / 4)


def message_tokens(messages: list[dict], count: Callable[[str], int] = estimated_tokens) -> int:
    return sum(PER_MESSAGE + count(m["content"]) for m in messages) + PER_CALL


class _Sums(AccumulatorParam):
    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:  # noqa: N802
        for key, counts in b.items():
            a[key] = tuple(x + y for x, y in zip(a.get(key, (0, 0, 0)), counts, strict=True))
        return a


class Ledger:
    """Calls and tokens by operation, label and size of model, added up on the driver; a task that runs again counts again, as its calls were made again."""

    def __init__(self, spark: SparkSession):
        self._sums = spark.sparkContext.accumulator({}, _Sums())
        self.operation = ""

    def add(self, label: str, model: str, tokens_in: int, tokens_out: int) -> None:
        self._sums.add({(self.operation, label, model): (1, tokens_in, tokens_out)})

    def rows(self, spark: SparkSession) -> DataFrame:
        """``operation, label, model, calls, tokens_in, tokens_out``, as ``maintenance.cost_rollup`` reads them."""
        found = [(*key, *counts) for key, counts in sorted(self._sums.value.items())]
        return spark.createDataFrame(found, "operation string, label string, model string, calls long, tokens_in long, tokens_out long")


class ModelExtractor(Extractor):
    """Asks a model for everything; ``types``: names of entity types, numbered from 1."""

    def __init__(self, complete: Callable[[list[dict], dict, str], dict | str], types: list[str] | None = None, ledger: Ledger | None = None, count: Callable[[str], int] = estimated_tokens):
        self.complete, self.types, self.ledger, self.count = complete, types or [], ledger, count

    def _ask(self, label: str, schema: str, **context) -> dict:
        size = "small" if label in SMALL else "medium"
        messages = [{"role": "system", "content": f"{RULES[label]} Answer with JSON only."}, {"role": "user", "content": json.dumps(context, ensure_ascii=False)}]
        answer = self.complete(messages, SCHEMAS[schema], size)
        if self.ledger:
            text = answer if isinstance(answer, str) else json.dumps(answer, ensure_ascii=False)
            self.ledger.add(label, size, message_tokens(messages, self.count), self.count(text))
        return checked(answer, SCHEMAS[schema])

    def nodes(self, content: str, previous: list[str]) -> list[dict]:
        types = [{"entity_type_id": k, "name": x} for k, x in enumerate(["Entity", *self.types])]
        return self._ask("extract_nodes.extract_message", "nodes", entity_types=types, previous_episodes=previous, current_episode=content)["extracted_entities"]

    def edges(self, content: str, names: list[str]) -> list[dict]:
        found = self._ask("extract_edges.edge", "edges", entities=names, current_episode=content)["edges"]
        return [{"source": x["source_entity_name"], "target": x["target_entity_name"], "relation": x["relation_type"], **{k: x.get(k) for k in ("fact", "valid_at", "invalid_at")}} for x in found]

    def same_node(self, name: str, candidates: list[str]) -> int:
        """The first answer about the entity counts."""
        found = self._ask("dedupe_nodes.nodes", "same", entity={"id": 0, "name": name}, candidates=[{"candidate_id": k, "name": x} for k, x in enumerate(candidates)])["entity_resolutions"]
        return next((x["duplicate_candidate_id"] for x in found if x["id"] == 0), -1)

    def judge(self, fact: str, related: list[str], existing: list[str]) -> dict:
        listed = [{"idx": k, "fact": x} for k, x in enumerate([*related, *existing])]
        return self._ask("dedupe_edges.resolve_edge", "judged", new_fact=fact, existing_facts=listed[: len(related)], invalidation_candidates=listed[len(related) :])

    def times(self, fact: str, content: str, reference: str) -> dict:
        return self._ask("extract_edges.extract_timestamps", "times", fact=fact, episode=content, reference_time=reference)

    def summary(self, name: str, old: str, content: str, previous: list[str]) -> str:
        return self._ask("summarize_nodes.summarize_context", "summary", entity=name, summary=old, episode=content, previous_episodes=previous)["summary"]

    def saga_summary(self, name: str, old: str, contents: list[str]) -> str:
        return self._ask("summarize_sagas.summarize_saga", "summary", saga=name, summary=old, episodes=contents)["summary"]

    def community_summary(self, one: str, other: str) -> str:
        return self._ask("summarize_nodes.summarize_pair", "summary", summaries=[one, other])["summary"]

    def community_name(self, summary: str) -> str:
        return self._ask("summarize_nodes.summary_description", "line", summary=summary)["description"]
