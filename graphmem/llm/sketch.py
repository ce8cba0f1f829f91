"""Merged count-min sketches of keys that documents hold, as exchanged tables.

Documents are dealt into groups by a hash of their id and text.  A group adds each distinct key
of each of its documents to a sketch of its own and sends the cells in use, sorted
and cut into blocks.  The tasks that own the blocks add up the sketches of all groups and
answer each group with the total of every cell it sent.  The least total over the
rows of the sketch is never below the number of documents that hold a key, so no repeated key
is lost.  No sketch is broadcast or held whole: cells grow with the corpus, and a block or a
group stays the size that the number of shuffle partitions gives it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmem.llm.shared import shuffle_partitions
from graphmem.llm.textarrays import U64, mix, pack, unpack

#: Rows of the sketch, and cells a row has for each expected key.
DEPTH, CELLS_PER_KEY = 2, 16
#: Bytes of text in a group, about: at least so many, and a share of an executor's memory, as a group is held with its hashes.
GROUP_BYTES, GROUP_SHARE, MOST_GROUP_BYTES = 1_500_000, 2000, 64_000_000
#: Keys that a block gets at least, if there are so many: a group's message to a block shouldn't be a few keys.
BLOCK_KEYS = 100_000
SENT = "grp long, block int, cells array<binary>, counts array<binary>"
ANSWERED = "grp long, block int, totals array<binary>"
_SALTS = (U64(0), U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9))


class Layout:
    """Numbers of groups, blocks and cells for a corpus of so many bytes."""

    def __init__(self, df: DataFrame, text: str, key_bytes: float):
        n = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
        parts = shuffle_partitions(df.sparkSession)
        memory = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(df.sparkSession.sparkContext.getConf().get("spark.executor.memory", "1g"))
        size = min(MOST_GROUP_BYTES, max(GROUP_BYTES, memory // GROUP_SHARE))
        self.groups = max(2 * parts, -(-n // size))
        self.blocks = max(1, min(2 * parts, int(n / key_bytes / BLOCK_KEYS)))
        self.bits = max(32, int(CELLS_PER_KEY * n / key_bytes).bit_length())

    def group(self, key: Column) -> Column:
        return F.pmod(key, F.lit(self.groups).cast("long"))

    def dealt(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """With columns ``row_key``, a hash of id and text, and ``grp``, each group whole in one partition.

        Rows of one id are dealt by their texts; rows without an id, which take part in nothing, anywhere.
        """
        key = F.xxhash64(id_col, F.xxhash64(text_col))
        spread = F.when(F.col(id_col).isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(key)
        return df.withColumn("row_key", key).withColumn("grp", self.group(spread)).repartition("grp")

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        return (keys if row == 0 else mix(keys ^ _SALTS[row])) >> U64(64 - self.bits)

    def block_edges(self, bits: int) -> np.ndarray:
        """The first value of each block but the first, among values of so many bits."""
        return np.array([(i << bits) // self.blocks for i in range(1, self.blocks)], U64)


def code(totals: np.ndarray) -> np.ndarray:
    """Totals in a byte, never falling as totals grow: exact up to 63, then eight steps for each doubling."""
    big = 64 + (8 * np.log2(np.maximum(totals, 64) / 64)).astype(np.int64)
    return np.where(totals < 64, totals, np.minimum(big, 255)).astype(np.uint8)


def send(layout: Layout, group: int, keys: np.ndarray) -> pa.Table:
    """The sketch of one group, all rows of a block in one message; ``keys``: the distinct keys of each document, one after another."""
    parts: list[list[tuple[bytes, bytes]]] = [[] for _ in range(layout.blocks)]
    for row in range(DEPTH):
        cells, counts = np.unique(layout.cells(keys, row), return_counts=True)
        cut = [0, *np.searchsorted(cells, layout.block_edges(layout.bits)), len(cells)]
        small = np.minimum(counts, 255).astype(np.uint8)
        for part, lo, hi in zip(parts, cut, cut[1:], strict=False):
            part.append((pack(cells[lo:hi]), small[lo:hi].tobytes()))
    full = [(b, p) for b, p in enumerate(parts) if any(cells for cells, _ in p)]
    rows = {"grp": [group] * len(full), "block": [b for b, _ in full], "cells": [[x for x, _ in p] for _, p in full], "counts": [[x for _, x in p] for _, p in full]}
    return pa.table(rows, schema=pa.schema([("grp", pa.int64()), ("block", pa.int32()), ("cells", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary()))]))


def _totals(packed: list[bytes], counted: list[bytes]) -> list[bytes]:
    """For each sender of one row of a block, the codes of the totals of its cells."""
    parts = [unpack(x) for x in packed]
    cells = np.concatenate(parts)
    if not len(cells):
        return [b""] * len(parts)
    counts = np.frombuffer(b"".join(counted), np.uint8)
    order = np.argsort(cells, kind="stable")
    first = np.flatnonzero(np.diff(cells[order], prepend=cells[order[0]] + U64(1)) != 0)
    totals = np.add.reduceat(counts[order].astype(np.int64), first)
    answer = np.empty(len(cells), np.uint8)
    answer[order] = np.repeat(code(totals), np.diff(np.append(first, len(cells))))
    ends = np.cumsum([len(x) for x in parts])
    return [answer[e - len(x) : e].tobytes() for x, e in zip(parts, ends, strict=True)]


def _add_up(sent: pa.Table) -> pa.Table:
    cells, counts = sent.column("cells").to_pylist(), sent.column("counts").to_pylist()
    rows = [_totals([x[r] for x in cells], [x[r] for x in counts]) for r in range(DEPTH)]
    return pa.table({"grp": sent.column("grp"), "block": sent.column("block"), "totals": pa.array([list(x) for x in zip(*rows, strict=True)], pa.list_(pa.binary()))})


def merged(sent: DataFrame) -> DataFrame:
    """The answers to all groups."""
    return sent.groupBy("block").applyInArrow(_add_up, ANSWERED)


def estimates(layout: Layout, keys: np.ndarray, answers: pa.Table) -> np.ndarray:
    """For each key, the ``code`` of an upper bound of the number of documents that hold it (of a group, 255 are counted at most)."""
    totals = [t for _, t in sorted(zip(answers.column("block").to_pylist(), answers.column("totals").to_pylist(), strict=True))]
    least = np.full(len(keys), 255, np.uint8)
    for r in range(DEPTH):
        cells, back = np.unique(layout.cells(keys, r), return_inverse=True)
        found = np.frombuffer(b"".join(t[r] for t in totals), np.uint8)
        if len(found) != len(cells):
            raise ValueError("the answers are not those to this group's sketch")
        np.minimum(least, found[back], out=least)
    return least
