"""Language identification by error-correcting output codes.

Each language has a codeword of bits.  A linear classifier over hashed byte n-grams predicts
each bit; decoding takes the codeword of least loss, each bit weighted by how well its
classifier does on rows that it wasn't fitted to, and flags a text as ambiguous where two codewords are close.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmem.llm import textarrays as ta
from graphmem.llm.shared import first_bytes

UNDETERMINED = "und"
BUCKETS, BITS = 1 << 13, 15
ORDERS = (1, 2, 3)
#: Rows of a batch: its counts take ROWS * BUCKETS floats.
ROWS, BATCH_BYTES = 256, 1 << 20
#: The most labelled rows that training reads, taken in the order of a hash of their ids.
MAX_TRAINING_ROWS = 3000
#: Bytes of text that training reads, the text that crosses the bound included.
MAX_TRAINING_BYTES = 32 << 20
#: Parts of the learned rows; the trust in a bit comes from classifiers fitted to the other parts.
FOLDS = 3
EPOCHS, RATE, PENALTY = 60, 0.05, 1e-4
#: A text is ambiguous if the probability of its language is below this.
AMBIGUOUS = 0.6

#: Lower-case letters and all bytes of longer characters stay; the rest is a space.
LETTERS = np.where(((ta.ASCII_LOWER >= 97) & (ta.ASCII_LOWER <= 122)) | (np.arange(256) >= 128), ta.ASCII_LOWER, 32).astype(np.uint8)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """``n`` codewords far from each other: the best of many drawn by a fixed rule; no bit is alike for all."""
    if n < 2:
        return np.ones((n, bits))
    best, apart = None, -1
    for seed in range(300):
        code = np.where(np.random.default_rng(seed).random((n, bits)) < 0.5, -1.0, 1.0)
        gaps = ((bits - code @ code.T) / 2)[np.triu_indices(n, 1)]
        if (least := int(gaps.min()) * 2 + int((np.abs(code.sum(0)) < n).all())) > apart:
            best, apart = code, least
    return best


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The share of each bucket among the n-grams of each text."""
    n = len(offs) - 1
    letters = LETTERS[data].astype(np.int64)
    text = np.repeat(np.arange(n), np.diff(offs))
    counts = np.zeros(n * BUCKETS, np.int64)
    gram = np.zeros(len(letters), np.int64)
    for k in range(1, max(ORDERS) + 1):
        size = max(0, len(letters) - k + 1)
        gram = gram[:size] * 257 + letters[k - 1 : k - 1 + size]
        if k in ORDERS and size:
            inside = text[:size] == text[k - 1 : k - 1 + size]
            bucket = ((gram + k) * 0x9E3779B1 >> 15) & (BUCKETS - 1)
            counts += np.bincount((text[:size] * BUCKETS + bucket)[inside], minlength=n * BUCKETS)
    shares = counts.reshape(n, BUCKETS).astype(np.float32)
    return shares / np.maximum(1, shares.sum(1, keepdims=True))


def train(texts: pa.Array, languages: list[str]) -> Model:
    """Logistic regressions of all bits at once, languages weighted alike."""
    names = sorted(set(languages))
    codes = codewords(len(names))
    label = np.array([names.index(x) for x in languages])
    data, offs = ta.utf8(texts)
    x = np.concatenate([features(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for lo, hi in _batches(offs)])
    scale = np.float32(1) / (x.std(0) + np.float32(1e-4))
    x *= scale
    x -= (middle := x.mean(0))
    y = codes[label].astype(np.float32)
    share = (1 / np.bincount(label, minlength=len(names)))[label].astype(np.float32)[:, None]
    w, b = _bits(x, y, share)
    return Model(names, codes, w * scale[:, None], b - middle @ w, _trust(x, y, share))


def _bits(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of the classifiers."""
    share = share / share.sum()
    w, b = np.zeros((BUCKETS, BITS), np.float32), np.zeros(BITS, np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, EPOCHS + 1):
        pull = -y * share / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        grad = x.T @ pull + PENALTY * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= RATE * 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        b -= RATE * pull.sum(0)
    return w, b


def _trust(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The weight of each bit: the log-odds of its mean probability on held-out rows, 1 on average; alike if there are too few rows."""
    if len(x) < 2 * FOLDS:
        return np.ones(BITS)
    loss, fold = np.zeros(BITS), np.arange(len(x)) % FOLDS
    for k in range(FOLDS):
        w, b = _bits(x[fold != k], y[fold != k], share[fold != k])
        own = fold == k
        loss += (share[own] * np.logaddexp(0, -y[own] * (x[own] @ w + b))).sum(0)
    right = np.clip(np.exp(-loss / share.sum()), 0.51, 1 - 1e-6)
    trust = np.log(right / (1 - right))
    return trust / trust.mean()


def _batches(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    for lo, hi in ta.pieces(offs, BATCH_BYTES):
        for at in range(lo, hi, ROWS):
            yield at, min(hi, at + ROWS)


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, probability and second language's probability of each text."""
    data, offs = ta.utf8(column)
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)
    before = np.concatenate(([0], np.cumsum(ascii_letter)))
    letter = before[offs[1:]] > before[offs[:-1]]
    for i in np.flatnonzero(~letter):
        letter[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    if not model.languages:
        return [UNDETERMINED] * len(letter), np.zeros(len(letter)), np.zeros(len(letter))
    margins = features(data, offs) @ model.weights + model.bias
    loss = np.stack([(model.trust * np.logaddexp(0, -margins * code)).sum(1) for code in model.codes], 1)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    top = np.sort(p, 1)
    second = top[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
    return [model.languages[i] if has else UNDETERMINED for i, has in zip(best, letter, strict=True)], np.where(letter, top[:, -1], 0.0), np.where(letter, second, 0.0)


def fit(labelled: DataFrame, max_rows: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trains on at most ``max_rows`` rows with a text and a language, in the order of a hash of the id, and on ``MAX_TRAINING_BYTES`` of their text."""
    rows = labelled.where(F.col(lang_col).isNotNull())
    chosen = rows.select(F.col(id_col).alias("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    got = rows.join(F.broadcast(chosen), rows[id_col] == chosen["doc_id"], "left_semi").where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).orderBy(F.xxhash64("text"), "lang").limit(max_rows)
    got = first_bytes(got, "text", [F.xxhash64("text"), F.col("lang")], MAX_TRAINING_BYTES).toArrow()
    if not got.num_rows:
        return Model([], np.zeros((0, BITS)), np.zeros((BUCKETS, BITS), np.float32), np.zeros(BITS), np.ones(BITS))
    return train(got.column("text").combine_chunks(), got.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` of each row, from the whole text.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text if
    there was nothing to learn from.  Of languages with equal scores the first by name is taken, and the text is ambiguous.  Ids may be null or repeat; other columns are not read.  One narrow stage.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").fill_null("")
            for lo, hi in _batches(ta.utf8(column)[1]):
                names, score, second = predict(model, column.slice(lo, hi - lo))
                unsure = (score < AMBIGUOUS) | (score - second < 0.2)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(unsure)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")
