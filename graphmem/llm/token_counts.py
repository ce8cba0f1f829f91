"""Token counts of whole texts, as a tokenizer's own library gives them.

An Arrow function encodes batches balanced by bytes and returns lengths only.  For a
SentencePiece model texts are cut at safe boundaries (``marked_words.py``), so a long
text costs no more a byte than a short one, and each distinct marked word of a
batch is encoded once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmem.llm import marked_words as mw
from graphmem.llm import textarrays as ta

_loaded: dict[str, object] = {}


class PieceCounter:
    """Counts by a SentencePiece model; the lengths of marked words seen are remembered."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        mw.check_vocabulary([self.model.id_to_piece(i) for i in range(self.model.get_piece_size())])
        self.known: dict[int, int] = {}

    def counts(self, column: pa.Array) -> np.ndarray:
        words = mw.MarkedWords(column)
        keys = words.hashes.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if len(self.known) + len(new) > mw.REMEMBERED:
            self.known.clear()
            new = range(len(keys))
        texts = [words.word(i) for i in new]
        # The library puts a mark before each text: it stands for the first space, or for one token before a line feed.
        lengths = self.model.encode([x[1:] if x[0] == " " else x for x in texts], num_threads=1)
        self.known.update((keys[i], 1 if x == " " else len(n) - (x[0] != " ")) for i, x, n in zip(new, texts, lengths, strict=True))
        each = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[words.index]
        before = np.concatenate(([0], np.cumsum(each)))
        return before[words.bounds[1:]] - before[words.bounds[:-1]]


class JsonCounter:
    """Counts by a file of the ``tokenizers`` library, special strings in texts handled as its default."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def counts(self, column: pa.Array) -> np.ndarray:
        return np.array([len(x.ids) for x in self.model.encode_batch([x or "" for x in column.to_pylist()], add_special_tokens=False)], np.int64)


def counter(path: str):
    if path not in _loaded:
        _loaded[path] = (JsonCounter if path.endswith(".json") else PieceCounter)(path)
    return _loaded[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row; ``tokenizer`` is the path of a .model or .json file.

    No begin, end or added special tokens, no truncation or padding.  A null text counts as
    an empty one, of no tokens.  A null id stays null, repeated rows are counted each, and other columns
    are not read.  One narrow stage: no shuffle, and memory bounded by a batch.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(tokenizer)
        for batch in batches:
            column = batch.column("text").fill_null("")
            for lo, hi, part in mw.known_pieces(column):
                n_bytes = np.diff(ta.utf8(part)[1])
                n = model.counts(part)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
