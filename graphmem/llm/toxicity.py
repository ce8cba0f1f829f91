"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A word enters as its own hashed embedding and as characters: the pooled embeddings of all its byte trigrams,
and one for its beginning.  A word of many bytes, such as a text in a script without spaces, is split into overlapping pieces that each
take a place of their own, so every byte is an input.  Two recurrent passes run over windows of words that overlap and cover the whole text; attention
pools each window, and a document is as toxic as its most toxic window.  Training and scoring
are numpy only.  Labels mark documents, not windows: after a first round on all windows, training
takes from each toxic document only the windows that score highest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmem.llm import textarrays as ta
from graphmem.llm.shared import first_bytes, give_back

#: Words of a window, and from one window's start to the next one's.
WINDOW, STRIDE = 32, 24
WORD_ROWS, WORD_DIM = 4096, 12
#: Bytes of a piece of a long word, and from one piece's start to the next one's; a multiple of 1, 2, 3 and 4, the bytes of a character.
PIECE, STEP = 24, 12
CHAR_ROWS, CHAR_DIM = 4096, 8
HEAD_BYTES, HEAD_ROWS, HEAD_DIM = 4, 2048, 8
HIDDEN = 10
#: The most labelled documents of each label that training reads, in the order of a hash of their ids.
MAX_PER_LABEL = 1800
#: Bytes of text that training reads, the text that crosses the bound included.
MAX_TRAINING_BYTES = 48 << 20
#: Windows of a clean document in an epoch, and of a toxic one once it can score.
CLEAN_WINDOWS, TOXIC_WINDOWS = 3, 2
EPOCHS, BATCH, RATE = 9, 192, 0.02
BATCH_BYTES = 1 << 20

#: Letters, digits and all bytes of longer characters make words.
APART = np.array([not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90 or b >= 128) for b in range(256)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Words:
    """The words of some texts as inputs of the network; row 0 of ``inputs`` stands for no word."""

    def __init__(self, column: pa.Array):
        data, offs = ta.utf8(column)
        data = ta.ASCII_LOWER[data]
        starts, ends, bounds = ta.words(data, offs, APART)
        each = 1 + np.maximum(0, -(-(ends - starts - PIECE) // STEP))
        before = np.concatenate(([0], np.cumsum(each)))
        self.bounds = before[bounds]
        shift = (np.arange(before[-1]) - np.repeat(before[:-1], each)) * STEP
        starts, ends = np.repeat(starts, each) + shift, np.repeat(ends, each)
        ends = np.minimum(ends, starts + PIECE)
        hashes, at, index = np.unique(ta.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        self.index = index + 1
        size, first = (ends - starts)[at], starts[at]
        self.word = np.concatenate(([0], (hashes % np.uint64(WORD_ROWS)).astype(np.int64)))
        #: Trigrams of each word, one around each byte; 1 and 2 stand for its ends.
        self.grams_at = np.concatenate(([0, 0], np.cumsum(size)))
        place = np.arange(int(size.sum())) - np.repeat(self.grams_at[1:-1], size)
        middle = np.repeat(first, size) + place
        padded = np.concatenate((data, np.zeros(HEAD_BYTES, np.uint8)))
        left = np.where(place > 0, padded[middle - 1], 1).astype(np.uint64)
        right = np.where(place < np.repeat(size, size) - 1, padded[middle + 1], 2).astype(np.uint64)
        self.grams = (ta.mix(left * np.uint64(65536) + padded[middle].astype(np.uint64) * np.uint64(256) + right) % np.uint64(CHAR_ROWS)).astype(np.int64)
        head = np.zeros(len(at), np.uint64)
        for k in range(HEAD_BYTES):
            head = head * np.uint64(257) + np.where(k < size, padded[first + k], 0).astype(np.uint64)
        self.head = np.concatenate(([0], (ta.mix(head) % np.uint64(HEAD_ROWS)).astype(np.int64)))

    def grams_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The trigrams of some words, one word after the other, and the number of each word's."""
        size = self.grams_at[rows + 1] - self.grams_at[rows]
        before = np.cumsum(size) - size
        return self.grams[np.repeat(self.grams_at[rows] - before, size) + np.arange(int(size.sum()))], size

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of each window (0: none), and the window's text; every text has one at least."""
        count = np.diff(self.bounds)
        each = 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE))
        text = np.repeat(np.arange(len(count)), each)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
        at = (self.bounds[:-1][text] + turn * STRIDE)[:, None] + np.arange(WINDOW)
        inside = at < self.bounds[1:][text][:, None]
        index = np.append(self.index, 0)
        return np.where(inside, index[np.where(inside, at, len(index) - 1)], 0), text


class Network:
    """Parameters, scoring and gradients."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        inputs = WORD_DIM + CHAR_DIM + HEAD_DIM

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"word": normal(WORD_ROWS, WORD_DIM, scale=0.3), "char": normal(CHAR_ROWS, CHAR_DIM, scale=0.3), "head": normal(HEAD_ROWS, HEAD_DIM, scale=0.3), "look": normal(2 * HIDDEN, scale=0.3), "out": normal(2 * HIDDEN, scale=0.5), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"in_{d}": normal(inputs, 3 * HIDDEN, scale=inputs**-0.5), f"gate_{d}": normal(HIDDEN, 2 * HIDDEN, scale=HIDDEN**-0.5), f"new_{d}": normal(HIDDEN, HIDDEN, scale=HIDDEN**-0.5), f"shift_{d}": np.zeros(3 * HIDDEN, np.float32)}
        #: From the greatest logit of a document's windows to its own.
        self.slope, self.offset = 1.0, 0.0

    def inputs(self, w: Words, rows: np.ndarray) -> np.ndarray:
        grams, size = w.grams_of(rows)
        chars = np.zeros((len(rows), CHAR_DIM), self.p["char"].dtype)
        full = np.flatnonzero(size)
        if len(full):
            chars[full] = np.add.reduceat(self.p["char"][grams], (np.cumsum(size) - size)[full]) / np.sqrt(size[full], dtype=chars.dtype)[:, None]
        return np.concatenate((self.p["word"][w.word[rows]], chars, self.p["head"][w.head[rows]]), 1)

    def _pass(self, d: str, table: np.ndarray, numbers: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States after each word in one direction; words are rows of ``table``."""
        n, h = HIDDEN, np.zeros((len(numbers), HIDDEN), np.float32)
        states, steps = np.zeros((WINDOW, len(numbers), n), np.float32), []
        gate, new = self.p[f"gate_{d}"], self.p[f"new_{d}"]
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            x, there = table[numbers[:, t]], (numbers[:, t] > 0)[:, None]
            zr = _sigmoid(x[:, : 2 * n] + h @ gate)
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(x[:, 2 * n :] + (r * h) @ new)
            after = np.where(there, c + z * (h - c), h)
            if keep:
                steps.append((t, h, zr, c, there))
            h = states[t] = after
        return states, steps

    def _forward(self, tables: dict[str, np.ndarray], numbers: np.ndarray, keep: bool = False):
        passed = {d: self._pass(d, tables[d], numbers, keep) for d in "fb"}
        states = np.concatenate([passed[d][0] for d in "fb"], 2)
        looks = np.where((numbers > 0).T, states @ self.p["look"], np.float32(-30))
        share = np.exp(looks - looks.max(0))
        share /= share.sum(0)
        pooled = (share[:, :, None] * states).sum(0)
        return pooled @ self.p["out"] + self.p["bias"], (passed, states, share, pooled)

    def logits(self, w: Words, numbers: np.ndarray) -> np.ndarray:
        """Of each window; inputs are made for the words of some thousand windows at a time."""
        out = []
        for part in np.array_split(numbers, max(1, len(numbers) // 4096)):
            rows, local = np.unique(np.append(0, part), return_inverse=True)
            x = self.inputs(w, rows)
            tables = {d: x @ self.p[f"in_{d}"] + self.p[f"shift_{d}"] for d in "fb"}
            out.append(self._forward(tables, local[1:].reshape(part.shape))[0])
        return np.concatenate(out)

    def gradients(self, w: Words, numbers: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        rows, local = np.unique(np.append(0, numbers), return_inverse=True)
        local = local[1:].reshape(numbers.shape)
        x = self.inputs(w, rows)
        tables = {d: x @ self.p[f"in_{d}"] + self.p[f"shift_{d}"] for d in "fb"}
        logit, (passed, states, share, pooled) = self._forward(tables, local, keep=True)
        pull = ((_sigmoid(logit) - label) * weight / len(label)).astype(np.float32)
        g = {"out": pooled.T @ pull, "bias": pull.sum(keepdims=True)}
        d_pooled = pull[:, None] * self.p["out"]
        d_share = (states * d_pooled).sum(2)
        d_look = share * (d_share - (share * d_share).sum(0))
        g["look"] = np.einsum("tb,tbh->h", d_look, states)
        d_states = share[:, :, None] * d_pooled + d_look[:, :, None] * self.p["look"]
        d_x, n = np.zeros_like(x), HIDDEN
        for k, d in enumerate("fb"):
            gate, new = self.p[f"gate_{d}"], self.p[f"new_{d}"]
            d_gate, d_new, d_table = np.zeros_like(gate), np.zeros_like(new), np.zeros_like(tables[d])
            d_h = np.zeros((len(local), n), np.float32)
            for t, h, zr, c, there in reversed(passed[d][1]):
                d_h = d_h + d_states[t][:, k * n : (k + 1) * n]
                own = np.where(there, d_h, 0)
                z, r = zr[:, :n], zr[:, n:]
                d_c = own * (1 - z) * (1 - c * c)
                d_rh = d_c @ new.T
                d_zr = np.concatenate((own * (h - c), d_rh * h), 1) * zr * (1 - zr)
                d_gate += h.T @ d_zr
                d_new += (r * h).T @ d_c
                np.add.at(d_table, local[:, t], np.concatenate((d_zr, d_c), 1))
                d_h = np.where(there, own * z, d_h) + d_rh * r + d_zr @ gate.T
            g |= {f"gate_{d}": d_gate, f"new_{d}": d_new, f"in_{d}": x.T @ d_table, f"shift_{d}": d_table.sum(0)}
            d_x += d_table @ self.p[f"in_{d}"].T
        for name, index, part in (("word", w.word[rows], d_x[:, :WORD_DIM]), ("head", w.head[rows], d_x[:, WORD_DIM + CHAR_DIM :])):
            g[name] = np.zeros_like(self.p[name])
            np.add.at(g[name], index, part)
        grams, size = w.grams_of(rows)
        g["char"] = np.zeros_like(self.p["char"])
        np.add.at(g["char"], grams, np.repeat(d_x[:, WORD_DIM : WORD_DIM + CHAR_DIM] / np.sqrt(np.maximum(1, size))[:, None], size, axis=0).astype(g["char"].dtype))
        return g

    def scores(self, column: pa.Array) -> np.ndarray:
        """The score of each whole text."""
        w = Words(column)
        numbers, text = w.windows()
        logits = self.logits(w, numbers)
        first = np.flatnonzero(np.diff(text, prepend=-1))
        return _sigmoid(np.clip(self.slope * np.maximum.reduceat(logits, first) + self.offset, -30, 30).astype(np.float64))


def _picked(rng: np.random.Generator, text: np.ndarray, toxic: np.ndarray, logits: np.ndarray | None) -> np.ndarray:
    """The windows of an epoch."""
    order = rng.permutation(len(text))
    key = -logits[order] if logits is not None else np.zeros(len(order))
    order = order[np.lexsort((np.where(toxic[text[order]] == 1, key, 0), text[order]))]
    own = text[order]
    turn = np.arange(len(own)) - np.repeat(np.flatnonzero(np.diff(own, prepend=-1)), np.bincount(own)[np.unique(own)])
    most = np.where(toxic[own] == 1, TOXIC_WINDOWS if logits is not None else WINDOW, CLEAN_WINDOWS)
    return rng.permutation(order[turn < most])


def train(texts: pa.Array, toxic: np.ndarray, seed: int = 7) -> Network:
    """A network for labelled texts; what making it took is given back, as the process that trains lives on."""
    net = _trained(texts, toxic, seed)
    give_back()
    return net


def _trained(texts: pa.Array, toxic: np.ndarray, seed: int) -> Network:
    net, rng = Network(seed), np.random.default_rng(seed)
    w = Words(texts)
    numbers, text = w.windows()
    give_back()
    m, v, step, logits = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0, None
    for epoch in range(EPOCHS):
        rows = _picked(rng, text, toxic, logits)
        label = toxic[text[rows]].astype(np.float32)
        share = max(1e-3, float(label.mean()))
        weight = np.where(label == 1, 0.5 / share, 0.5 / max(1e-3, 1 - share)).astype(np.float32)
        rate = RATE * (1 - 0.8 * epoch / EPOCHS)
        for lo in range(0, len(rows), BATCH):
            part = slice(lo, lo + BATCH)
            step += 1
            for k, g in net.gradients(w, numbers[rows[part]], label[part], weight[part]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        logits = net.logits(w, numbers)
    top = np.maximum.reduceat(logits, np.flatnonzero(np.diff(text, prepend=-1))).astype(np.float64)
    _calibrate(net, top, toxic)
    return net


def _calibrate(net: Network, top: np.ndarray, toxic: np.ndarray) -> None:
    """A logistic fit of the labels to the documents' greatest logits, both labels weighted alike."""
    middle, spread = top.mean(), top.std() + 1e-6
    x, a, b = (top - middle) / spread, 1.0, 0.0
    weight = np.where(toxic == 1, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (toxic == 0).sum()))
    for _ in range(500):
        e = (_sigmoid(np.clip(a * x + b, -30, 30)) - toxic) * weight
        a, b = a - 2.0 * ((e * x).sum() + 1e-4 * a), b - 2.0 * e.sum()
    net.slope, net.offset = float(a / spread), float(b - a * middle / spread)


def fit(docs: DataFrame, labels: DataFrame, max_per_label: int = MAX_PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | None:
    """Trains on at most ``max_per_label`` labelled documents of each label, and on ``MAX_TRAINING_BYTES`` of their text; None if a label has none.

    ``labels`` may name a document more than once (toxic if any row says so); documents that aren't there don't count.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("marked_id")).agg(F.max(F.col(label_col).cast("int")).alias("marked"))
    there = docs.select(F.col(id_col).alias("there_id")).join(marked, F.col("there_id") == F.col("marked_id")).groupBy("marked_id").agg(F.max("marked").alias("marked"))
    order = [F.xxhash64("marked_id"), F.col("marked_id")]
    chosen = there.where("marked = 1").orderBy(*order).limit(max_per_label).unionByName(there.where("marked = 0").orderBy(*order).limit(max_per_label))
    got = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("marked_id")).select("doc_id", "text", "marked").orderBy("doc_id", "text").limit(2 * max_per_label)
    got = first_bytes(got, "text", [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text")], MAX_TRAINING_BYTES).orderBy("doc_id", "text").toArrow()
    toxic = got.column("marked").to_numpy() if got.num_rows else np.zeros(0, np.int64)
    if not (toxic == 1).any() or not (toxic == 0).any():
        return None
    net = train(got.column("text").combine_chunks(), toxic)
    del got, toxic
    give_back()
    return net


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of each row: 0 to 1, the higher the likelier toxic, from all windows of the whole text.

    A null or empty text has the score of a window without words.  Without a network all scores are 0; an empty table gives no rows.
    Ids may be null or repeat; other columns are not read.  One narrow stage, memory bounded by a batch or one text.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").fill_null("")
            for lo, hi in ta.pieces(ta.utf8(column)[1], BATCH_BYTES):
                part = column.slice(lo, hi - lo)
                found = net.scores(part) if net else np.zeros(len(part))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, score double")


def without_toxic(docs: DataFrame, net: Network | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns as they were."""
    if net is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col)).fill_null("")
            clean = [net.scores(column.slice(lo, hi - lo)) < threshold for lo, hi in ta.pieces(ta.utf8(column)[1], BATCH_BYTES)]
            yield batch.filter(pa.array(np.concatenate(clean) if clean else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
