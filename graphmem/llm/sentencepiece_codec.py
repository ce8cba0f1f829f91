"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

The distinct marked words of a batch (``marked_words.py``) are sorted, which lays them out as the
depth-first walk of a trie: from one word to the next only the characters after the common
prefix are new, and the forward states of the prefix are those already on the stack.

A forward state is the greatest total score of a segmentation of the prefix, whatever the model was trained for.  With
``search='merges'``, for models trained for merges, it is the last piece of the prefix's encoding instead: a piece can follow another one
only if merging the two texts together leaves both as they are, and of the pieces that end a prefix exactly one
can follow the state where it begins, so one forward pass finds the ids that the merges give.  A character
without a piece becomes its UTF-8 bytes.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphmem.llm import marked_words as mw
from graphmem.llm import textarrays as ta
from graphmem.llm.shared import give_back

#: What a character without a piece costs below the least piece score.
UNKNOWN_PENALTY = 10.0
#: Pairs of pieces that a worker remembers.
PAIRS = 1_000_000
_loaded: dict[tuple[str, str], Codec] = {}


class Codec:
    """Pieces, scores and byte tokens of a .model file."""

    def __init__(self, path: str, search: str = "score"):
        import sentencepiece

        if search not in ("score", "merges"):
            raise ValueError("search is 'score' or 'merges'")

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        mw.check_vocabulary([model.id_to_piece(i) for i in plain])
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.merges = search == "merges"
        self.unknown, least = model.unk_id(), min(model.get_score(i) for i in plain)
        self.unknown_score = least - UNKNOWN_PENALTY
        #: Each ending of a piece, with the piece's score and id where it is a whole piece.
        self.endings: dict[str, tuple[float, int] | None] = {}
        for i in plain:
            piece = model.id_to_piece(i).replace(mw.MARK, " ")
            for k in range(1, len(piece)):
                self.endings.setdefault(piece[k:], None)
        for i in plain:
            self.endings[model.id_to_piece(i).replace(mw.MARK, " ")] = (model.get_score(i), i)
        spelled = [b""] * size
        for i in plain:
            spelled[i] = model.id_to_piece(i).replace(mw.MARK, " ").encode()
        for b, i in self.bytes.items():
            spelled[i] = bytes([b])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.concatenate(([0], np.cumsum([len(x) for x in spelled])))
        #: For merge models: whether a piece encodes as itself, and whether the second of two pieces can follow the first.
        self.alone: dict[int, bool] = {}
        self.follows: dict[int, bool] = {}
        #: By the hash of a marked word, its ids as 32-bit integers.
        self.known: dict[int, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: the best pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                if (hit := self.endings.get(parts[k] + parts[k + 1])) and (best is None or hit[0] > best):
                    best, at = hit[0], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _can_follow(self, before: str, piece: str, ids: int, own: int) -> bool:
        """``ids``: the numbers of both pieces in one; ``own``: that of the second."""
        if (ok := self.alone.get(own)) is None:
            ok = self.alone[own] = self.merged(piece) == [piece]
        if not ok or not before:
            return ok
        if (ok := self.follows.get(ids)) is None:
            if len(self.follows) >= PAIRS:
                self.follows.clear()
            ok = self.follows[ids] = self.merged(before + piece) == [before, piece]
        return ok

    def encode_sorted(self, texts: list[str]) -> list[list[int]]:
        """The ids of each of the sorted marked words."""
        return self._by_merges(texts) if self.merges else self._by_score(texts)

    def _by_merges(self, texts: list[str]) -> list[list[int]]:
        back, last, out = [(0, -1)], "", []
        find, missing, follows = self.endings.get, (), self.follows
        for text in texts:
            n = len(os.path.commonprefix((last, text)))
            del back[n + 1 :]
            for j in range(n + 1, len(text) + 1):
                how = None
                for i in range(j - 1, -1, -1):
                    hit = find(text[i:j], missing)
                    if hit is missing:
                        break
                    if hit is not None:
                        start, before = back[i]
                        if before < 0:  # nothing, or a character without a piece, which nothing merges with
                            ok = self._can_follow("", text[i:j], -1, hit[1])
                        elif (ok := follows.get(ids := before << 24 | hit[1])) is None:
                            ok = self._can_follow(text[start:i], text[i:j], ids, hit[1])
                        if ok:
                            how = (i, hit[1])
                            break
                back.append(how or (j - 1, -1))
            out.append(self._ids(text, back))
            last = text
        return out

    def _ids(self, text: str, back: list[tuple[int, int]]) -> list[int]:
        ids, j = [], len(text)
        while j:
            i, piece = back[j]
            ids.extend((piece,) if piece >= 0 else [self.bytes.get(b, self.unknown) for b in reversed(text[i:j].encode())])
            j = i
        return ids[::-1]

    def _by_score(self, texts: list[str]) -> list[list[int]]:
        score, back, last = [0.0], [(0, 0)], ""
        find, missing, out = self.endings.get, (), []
        for text in texts:
            n = len(os.path.commonprefix((last, text)))
            del score[n + 1 :], back[n + 1 :]
            for j in range(n + 1, len(text) + 1):
                best, how, single = float("-inf"), None, False
                for i in range(j - 1, -1, -1):
                    hit = find(text[i:j], missing)
                    if hit is missing:
                        break
                    if hit is not None:
                        single |= i == j - 1
                        if (s := score[i] + hit[0]) >= best:
                            best, how = s, (i, hit[1])
                if not single and (s := score[j - 1] + self.unknown_score) > best:
                    best, how = s, (j - 1, -1)
                score.append(best)
                back.append(how)
            out.append(self._ids(text, back))
            last = text
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the offsets of each text."""
        words = mw.MarkedWords(column)
        keys = words.hashes.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if len(self.known) + len(new) > mw.REMEMBERED:
            self.known.clear()
            new = list(range(len(keys)))
        order = sorted((words.word(i), i) for i in new)
        for (_, i), ids in zip(order, self.encode_sorted([x for x, _ in order]), strict=True):
            self.known[keys[i]] = array("i", ids).tobytes()
        own = [self.known[k] for k in keys]
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat = np.frombuffer(b"".join(own), np.int32)
        ids = _gathered(flat, np.concatenate(([0], np.cumsum(sizes))), words.index)
        before = np.concatenate(([0], np.cumsum(sizes[words.index])))
        return ids, before[words.bounds]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        """The texts; a text's first character is the mark that encoding put there."""
        raw = _gathered(self.spelled, self.spelled_at, ids).tobytes()
        at = np.concatenate(([0], np.cumsum(np.diff(self.spelled_at)[ids])))[offs]
        return [raw[a + (b > a and raw[a] == 32) : b].decode("utf-8", "replace") for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]


def _gathered(flat: np.ndarray, at: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The slices ``flat[at[i]:at[i + 1]]`` for each i of ``index``, one after another."""
    size = np.diff(at)[index]
    shift = at[index] - np.concatenate(([0], np.cumsum(size)))[:-1]
    return flat[np.repeat(shift, size) + np.arange(int(size.sum()))]


def codec(path: str, search: str = "score") -> Codec:
    if (path, search) not in _loaded:
        _loaded[path, search] = Codec(path, search)
    return _loaded[path, search]


def encode(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "piece_ids", verify_col: str | None = None, search: str = "score") -> DataFrame:
    """``docs`` with column ``ids_col``, array<int>: the pieces of the whole text; with ``verify_col`` also whether decoding them gives the text back, up to U+2581.

    ``search``: 'score' takes the segmentation of greatest total score, 'merges' the one that a merge model's own library gives.
    A null or empty text has no pieces, and an empty table gives no rows.  All other columns pass through; one of the same name as a new
    column is replaced.  U+2581 in a text is encoded as a space, as the model has it.  One narrow stage, no shuffle.
    """
    kept = docs.drop(*[c for c in (ids_col, verify_col) if c in docs.columns])
    schema = T.StructType([*kept.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), True))] + ([T.StructField(verify_col, T.BooleanType())] if verify_col else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model, search)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for lo, hi, part in mw.known_pieces(batch.column(at).fill_null("")):
                ids, offs = own.encode(part)
                rows = batch.slice(lo, hi - lo)
                arrays, names = [*rows.columns, pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))], [*rows.schema.names, ids_col]
                if verify_col:
                    same = [a == (b or "").replace(mw.MARK, " ") for a, b in zip(own.decode(ids, offs), part.to_pylist(), strict=True)]
                    arrays, names = [*arrays, pa.array(same, pa.bool_())], [*names, verify_col]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            give_back()  # a worker serves later stages too

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` without ``ids_col``, with the text of its pieces in ``text_col``; null ids give an empty text."""
    kept = [c for c in encoded.columns if c not in (ids_col, text_col)]
    schema = T.StructType([*[encoded.schema[c] for c in kept], T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col)).fill_null([])
            offs = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths()))))
            cut = [(lo, hi) for lo, hi in ta.pieces(offs, mw.BATCH_BYTES // 4)]
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            for lo, hi in cut:
                texts = own.decode(flat[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[rows.column(rows.schema.get_field_index(c)) for c in kept], pa.array(texts, pa.string())], names=[*kept, text_col])

    return encoded.select(*kept, ids_col).mapInArrow(run, schema)
