"""Removal of word sequences that an earlier document already holds.

Count-min prefilter, then exact grouping.  Each group of documents sketches its windows
(``sketch.py``); only windows whose estimate says that two documents may hold them take part in the second
pass, which groups them exactly by a 96-bit hash.  The estimate is an upper
bound, so the prefilter loses no repeated window.  All exchanges carry packed
arrays cut into blocks by hash, one entry for each window and group at most, so a window that a third of all
documents hold weighs no more than any other.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmem.llm import sketch
from graphmem.llm import textarrays as ta

ASKED = "grp long, block int, high binary, low binary, doc binary"
TOLD = "grp long, block int, earlier binary"
#: A word has about so many bytes at least, on the whole; only the number of cells depends on it.
BYTES_PER_WORD = 4
_LEAST = np.iinfo(np.int64).min


class _Windows:
    """The windows of a group's documents; those of documents without an id are left out."""

    def __init__(self, table: pa.Table, size: int):
        data, offs = ta.utf8(table.column("text"))
        self.starts, self.ends, self.bounds = ta.words(data, offs)
        first, text = ta.window_starts(self.bounds, size)
        ids = table.column("doc_id")
        known = ids.is_valid().to_numpy()[text] if ids.null_count else np.ones(len(text), bool)
        self.first, self.text = first[known], text[known]
        self.doc = ids.fill_null(0).to_numpy().astype(np.int64)[self.text]
        hashes = ta.span_hashes(data, self.starts, self.ends)
        self.high = ta.window_hashes(hashes, size, ta.WINDOW_BASES[0])[self.first] if len(self.first) else np.zeros(0, np.uint64)
        self.low = (ta.window_hashes(hashes, size, ta.WINDOW_BASES[1])[self.first] >> np.uint64(32)).astype(np.uint32) if len(self.first) else np.zeros(0, np.uint32)
        self.data, self.offs = data, offs

    def keys(self) -> np.ndarray:
        """Each document's distinct windows."""
        return ta.per_text_distinct(self.high, self.text)[0]

    def asked(self, layout: sketch.Layout, answers: pa.Table) -> None:
        """Keeps the windows estimated repeated, grouped exactly: ``order`` sorts them, ``group`` numbers them."""
        keys, back = np.unique(self.high, return_inverse=True)
        distinct, _ = ta.per_text_distinct(self.high, self.text)
        least = sketch.estimates(layout, keys, answers) if len(distinct) else np.zeros(0, np.uint8)
        kept = np.flatnonzero(least[back] >= 2)
        order = kept[np.lexsort((self.doc[kept], self.low[kept], self.high[kept]))]
        self.order, high, low = order, self.high[order], self.low[order]
        new = np.ones(len(order), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        self.lead = order[new]
        self.group = np.cumsum(new) - 1


def _planes(values: np.ndarray, kind: str) -> bytes:
    raw = np.ascontiguousarray(values.astype(kind))
    return raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _ask(layout: sketch.Layout, group: int, w: _Windows) -> pa.Table:
    lead = w.lead
    cut = [0, *np.searchsorted(w.high[lead], layout.block_edges(64)), len(lead)]
    rows: dict[str, list] = {"grp": [], "block": [], "high": [], "low": [], "doc": []}
    for block, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)):
        if hi > lo:
            part = lead[lo:hi]
            for name, value in zip(rows, (group, block, ta.pack(w.high[part]), _planes(w.low[part], "<u4"), _planes(w.doc[part], "<i8")), strict=True):
                rows[name].append(value)
    return pa.table(rows, schema=pa.schema([("grp", pa.int64()), ("block", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("doc", pa.binary())]))


def _tell(asked: pa.Table) -> pa.Table:
    """For each window of each group: whether a document of another group with a smaller id has it."""
    parts = [ta.unpack(x) for x in asked.column("high").to_pylist()]
    high = np.concatenate(parts)
    low = np.concatenate([_unplanes(x, "<u4") for x in asked.column("low").to_pylist()])
    doc = np.concatenate([_unplanes(x, "<i8") for x in asked.column("doc").to_pylist()])
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    first = np.flatnonzero(new)
    smallest = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(order))))
    earlier = np.empty(len(order), bool)
    earlier[order] = smallest < doc[order]
    ends = np.cumsum([len(x) for x in parts])
    return pa.table({"grp": asked.column("grp"), "block": asked.column("block"), "earlier": pa.array([np.packbits(earlier[e - len(x) : e]).tobytes() for x, e in zip(parts, ends, strict=True)], pa.binary())})


def _covered(layout: sketch.Layout, w: _Windows, told: pa.Table, size: int) -> np.ndarray:
    """Which words of the group are removed."""
    cut = np.diff([0, *np.searchsorted(w.high[w.lead], layout.block_edges(64)), len(w.lead)])
    bits = dict(zip(told.column("block").to_pylist(), told.column("earlier").to_pylist(), strict=True))
    parts = [np.unpackbits(np.frombuffer(bits[b][0], np.uint8), count=n).astype(bool) for b, n in enumerate(cut) if n]
    earlier = np.concatenate(parts) if parts else np.zeros(0, bool)
    gone = w.order[earlier[w.group] | (w.doc[w.order] > w.doc[w.lead][w.group])]
    steps = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(steps, w.first[gone], 1)
    np.add.at(steps, w.first[gone] + size, -1)
    return np.cumsum(steps[:-1]) > 0


def _texts(w: _Windows, covered: np.ndarray, joined: bool) -> list[str | None]:
    raw, out = w.data.tobytes(), []
    for i in range(len(w.offs) - 1):
        lo, hi = w.bounds[i], w.bounds[i + 1]
        text, off = covered[lo:hi], w.offs[i]
        if joined:
            own = raw[off : w.offs[i + 1]].split()
            if text.any():
                own = [x for x, c in zip(own, text.tolist(), strict=True) if not c]
            out.append(b" ".join(own).decode("utf-8", "replace"))
        elif text.any():
            turn = np.flatnonzero(np.diff(np.concatenate(([1], text, [1]))))
            at = np.append(w.starts[lo:hi], w.offs[i + 1])
            kept = [raw[at[a] : at[b]] for a, b in zip(turn[::2], turn[1::2], strict=True)]
            out.append(b"".join(kept).rstrip().decode("utf-8", "replace"))
        else:
            out.append(raw[off : w.offs[i + 1]].decode("utf-8", "replace"))
    return out


def _table(table: pa.Table, w: _Windows, covered: np.ndarray, joined: bool) -> pa.Table:
    before = np.concatenate(([0], np.cumsum(covered)))
    gone = before[w.bounds[1:]] - before[w.bounds[:-1]]
    return pa.table({"doc_id": table.column("doc_id"), "rest": table.column("rest"), "n_words": pa.array(np.diff(w.bounds), pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(_texts(w, covered, joined), pa.string())})


def substring_dedup(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", joined: bool = False) -> DataFrame:
    """Removes each word covered by a window that also starts in a document with a smaller id.

    Returns ``doc_id, n_words, n_removed, kept, rest``: ``kept`` is the text that is left, with its own
    white space (where words go, the white space up to the next kept word goes too), or
    with ``joined`` its words joined by one space; ``rest`` is a struct of all columns of the input,
    so clashing names do no harm.  One row for each input row.

    A null or empty text has no words and ``kept`` is empty.  Texts of fewer than ``size`` words
    lose nothing.  Rows of equal id are copies of one document: neither loses words to the
    other.  A row without an id keeps its whole text and takes nothing from others.
    Windows are judged on the input, not on what is left.  Ids must be whole numbers, or text that reads as one; an empty table gives no rows.
    """
    doc = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (text_col,)] or [F.lit(1).alias("none")]).alias("rest"))
    layout = sketch.Layout(doc, "text", BYTES_PER_WORD)
    doc = layout.dealt(doc, "doc_id", "text").drop("row_key")

    def sketched(table: pa.Table) -> pa.Table:
        return sketch.send(layout, table.column("grp")[0].as_py(), _Windows(table, size).keys())

    def asking(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _ask_nothing()
        w = _Windows(table, size)
        w.asked(layout, answers)
        return _ask(layout, table.column("grp")[0].as_py(), w)

    def removing(table: pa.Table, replies: pa.Table) -> pa.Table:
        w = _Windows(table, size)
        kind = np.asarray(replies.column("kind").to_pylist(), np.int64)
        answers = replies.filter(pa.array(kind == 0)).select(["block", "bits"]).rename_columns(["block", "totals"])
        told = replies.filter(pa.array(kind == 1)).select(["block", "bits"]).rename_columns(["block", "earlier"])
        w.asked(layout, answers)
        return _table(table, w, _covered(layout, w, told, size), joined)

    answers = sketch.merged(doc.groupBy("grp").applyInArrow(sketched, sketch.SENT))
    asked = doc.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(asking, ASKED)
    told = asked.groupBy("block").applyInArrow(_tell, TOLD)
    replies = answers.select("grp", F.lit(0).alias("kind"), "block", F.col("totals").alias("bits")).unionByName(told.select("grp", F.lit(1).alias("kind"), "block", F.array("earlier").alias("bits")))
    rest = doc.schema["rest"].dataType
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("rest", rest), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return doc.groupBy("grp").cogroup(replies.groupBy("grp")).applyInArrow(removing, schema)


def _ask_nothing() -> pa.Table:
    return pa.table({"grp": pa.array([], pa.int64()), "block": pa.array([], pa.int32()), "high": pa.array([], pa.binary()), "low": pa.array([], pa.binary()), "doc": pa.array([], pa.binary())})


def remove_repeats(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same table with repeated word sequences cut out of the texts; all rows stay, ``length_col`` follows the new text.

    Texts that lose nothing are unchanged; a null text stays null.
    """
    out = substring_dedup(docs, size, id_col, text_col)
    columns: dict[str, F.Column] = {c: F.col(f"rest.`{c}`") for c in docs.columns if c != text_col}
    columns[text_col] = F.col("kept")
    if length_col in docs.columns:
        columns[length_col] = F.length("kept").cast(docs.schema[length_col].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])
