"""Cuts texts where no piece of a SentencePiece vocabulary can cross.

The model sees a text with a space mark before it and a mark for each space.  Where no
piece of the vocabulary has a mark after another character, nothing crosses into a run of marks; where none
holds a line feed, nothing crosses a line feed.  So each run of spaces with what follows it,
and each line feed with what follows it, is encoded on its own, whatever stands around it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from graphmem.llm import textarrays as ta

MARK = "▁"
BATCH_BYTES = 2 << 20
#: Distinct marked words that a worker remembers; at more it forgets all and starts anew.
REMEMBERED = 700_000


def check_vocabulary(pieces: list[str]) -> None:
    for p in pieces:
        if MARK in p.lstrip(MARK) or "\n" in p:
            raise ValueError(f"piece {p!r} crosses a boundary at which texts are cut")


class MarkedWords:
    """The marked words of some texts: ``distinct`` strings (a space for each mark), ``index`` of each one in the texts, ``bounds`` of each text."""

    def __init__(self, column: pa.Array):
        if pc.any(pc.match_substring(column, MARK)).as_py():
            column = pc.replace_substring(column, MARK, " ")  # the model doesn't tell the two apart
        data, offs = ta.utf8(column)
        full = np.diff(offs) > 0
        marked = np.insert(data, offs[:-1][full], 32)
        offs = offs + np.concatenate(([0], np.cumsum(full)))
        first = marked == 32
        first[1:] &= marked[:-1] != 32
        first |= marked == 10
        first[offs[:-1][full]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(marked))
        self.bounds = np.searchsorted(starts, offs)
        self.hashes, at, self.index = np.unique(ta.span_hashes(marked, starts, ends), return_index=True, return_inverse=True)
        self._raw, self._lo, self._hi = marked.tobytes(), starts[at].tolist(), ends[at].tolist()

    def word(self, i: int) -> str:
        return self._raw[self._lo[i] : self._hi[i]].decode("utf-8", "replace")


def known_pieces(column: pa.Array | pa.ChunkedArray):
    """Consecutive parts of a text column, balanced by bytes."""
    _, offs = ta.utf8(column)
    for lo, hi in ta.pieces(offs, BATCH_BYTES):
        yield lo, hi, column.slice(lo, hi - lo)
