"""Line-first quality rules.

Every line is judged on its own: punctuation (a line of prose, whatever its length, ends in a sentence mark or has enough of them
inside; items of lists need none), navigation (cells between bars), symbols in place of prose, and
boilerplate phrases.  Lines that fail go; a document that
loses too much of its text that way is rejected.  All rules read byte buffers in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmem.llm import textarrays as ta

BATCH_BYTES = 2 << 20
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
#: What may end a line of prose; those beyond ASCII take two or three bytes.
ENDINGS = ".!?:;\"')]\u00bb\u060c\u061f\u0964\u2019\u201d\u2026\u3002\uff01\uff1f"
_ENDS = np.isin(np.arange(256), list(ENDINGS.encode("ascii", "ignore")))
_LONG_ENDS = {n: [int.from_bytes(c.encode(), "big") for c in ENDINGS if len(c.encode()) == n] for n in (2, 3)}
STOPS = np.isin(np.arange(256), list(b".!?"))
DIGITS = np.isin(np.arange(256), list(b"0123456789"))
#: What may stand before an item of a list, besides a number with a full stop or a bracket behind it.
BULLETS = ("-", "*", "+", "\u2022", "\u2013")
#: Phrases of page furniture; a line of few words that has one is boilerplate.
BOILERPLATE = re.compile(
    rb"cookie (?:policy|settings|preferences)|accept (?:all )?cookies|privacy policy|terms (?:of (?:use|service)|and conditions)"
    rb"|all rights reserved|sign (?:in|up) (?:to|for|now)|log ?in to|subscribe to|click here|read more|share (?:this|on)"
    rb"|skip to (?:main )?content|enable javascript|javascript is (?:disabled|required)|powered by|back to top|add to cart|lorem ipsum",
    re.IGNORECASE,
)


@dataclass(frozen=True)
class Rules:
    """Thresholds; a line is as long as its bytes that are not white space."""

    min_words: int = 20
    #: In percent: words in windows of ``repeat_size`` words that occur twice.
    max_repeated: int = 30
    repeat_size: int = 8
    #: A navigation line has so many bars, and one for so many words at most.
    nav_bars: int = 3
    nav_words_per_bar: int = 6
    #: A line of symbols has one for each so many words.
    words_per_symbol: int = 2
    boilerplate_words: int = 12
    #: A line that no sentence mark ends has a full stop, exclamation or question mark for each so many words.
    words_per_stop: int = 40
    #: A document goes if its failed lines hold more than this share.
    max_lost: float = 0.5


def _sums(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    before = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=before[1:])
    return before[hi] - before[lo]


def _lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line without its line feed, and its text; every text has a line at least."""
    feed = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offs[:-1], feed + 1)), kind="stable")
    owner = np.concatenate((np.arange(len(offs) - 1), np.searchsorted(offs, feed, "right") - 1))
    owner = owner[np.argsort(np.concatenate((offs[:-1], feed + 1)), kind="stable")]
    # A feed at the very end of a text starts an empty line that belongs to that text.
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = np.append(starts[1:] - 1, 0)
    last = np.append(owner[1:] != owner[:-1], True)
    ends[last] = offs[1:][owner[last]]
    return starts, ends, owner


def _ended(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether words, from ``lo`` to before ``hi``, end in one of ``ENDINGS``."""
    out, value = _ENDS[data[hi - 1]], data[hi - 1].astype(np.int64)
    for n in (2, 3):
        value = value + (np.where(hi - lo >= n, data[np.maximum(hi - n, 0)], 0).astype(np.int64) << 8 * (n - 1))
        out = out | ((hi - lo >= n) & np.isin(value, _LONG_ENDS[n]))
    return out


def _bulleted(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether words are one of ``BULLETS`` or a number with a full stop or a bracket."""
    size = hi - lo
    out = (size > 1) & np.isin(data[hi - 1], list(b".)")) & (_sums(DIGITS[data], lo, hi - 1) == size - 1)
    for mark in BULLETS:
        raw = mark.encode()
        same = size == len(raw)
        for k, b in enumerate(raw):
            same = same & (data[np.minimum(lo + k, len(data) - 1)] == b)
        out = out | same
    return out


def judged(column: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    """Figures of each text, and ``start, end, text, failed`` of each line."""
    data, offs = ta.utf8(column)
    starts, ends, bounds = ta.words(data, offs)
    solid = ~ta.SPACE[data]
    n_words = np.diff(bounds)
    symbols = SYMBOLS[data]
    out = {"n_words": n_words, "word_chars": _sums(solid & ((data & 0xC0) != 0x80), offs[:-1], offs[1:]), "n_symbols": _sums(symbols, offs[:-1], offs[1:])}

    lo, hi, owner = _lines(data, offs)
    words = np.searchsorted(starts, hi) - np.searchsorted(starts, lo)
    full = words > 0
    keys = ta.span_hashes(data, lo, hi)[full]
    distinct = ta.per_text_distinct(keys, owner[full])[1]
    texts = len(n_words)
    out["n_dup_lines"] = np.bincount(owner[full], minlength=texts) - np.bincount(distinct, minlength=texts)

    first, text = ta.window_starts(bounds, rules.repeat_size)
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(first):
        windows = ta.window_hashes(ta.span_hashes(data, starts, ends), rules.repeat_size, ta.WINDOW_BASES[0])[first]
        order = np.lexsort((windows, text))
        same = (windows[order][1:] == windows[order][:-1]) & (text[order][1:] == text[order][:-1])
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        hit = first[order[again]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + rules.repeat_size, -1)
    out["n_repeat_words"] = _sums(np.cumsum(covered[:-1]) > 0, bounds[:-1], bounds[1:])

    size = _sums(solid, lo, hi)
    bars, marks = _sums(data == 124, lo, hi), _sums(symbols & (data != 124), lo, hi)
    # The last word of a line ends where the line's text ends.
    final, item = np.zeros(len(lo), bool), np.zeros(len(lo), bool)
    final[full] = _ended(data, starts[np.searchsorted(starts, hi)[full] - 1], ends[np.searchsorted(starts, hi)[full] - 1])
    item[full] = _bulleted(data, starts[np.searchsorted(starts, lo)[full]], ends[np.searchsorted(starts, lo)[full]])
    stops = _sums(STOPS[data], lo, hi)
    failed = full & ((bars >= rules.nav_bars) & (bars * rules.nav_words_per_bar >= words))
    failed |= full & (marks * rules.words_per_symbol > words) & (marks > 2)
    failed |= full & ~final & ~item & (stops * rules.words_per_stop < words)
    raw = data.tobytes()
    few = np.flatnonzero(full & (words <= rules.boilerplate_words) & ~failed)
    for m in BOILERPLATE.finditer(raw) if len(few) else ():
        i = int(np.searchsorted(lo, m.start(), "right")) - 1
        if m.end() <= hi[i] and full[i] and words[i] <= rules.boilerplate_words:
            failed[i] = True
    lost = np.bincount(owner, weights=size * failed, minlength=texts)
    total = np.maximum(1, np.bincount(owner, weights=size, minlength=texts))
    out["base_failed"] = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeated * n_words)
    out["lost"] = lost / total
    out["kept"] = ~out["base_failed"] & (out["lost"] <= rules.max_lost)
    return out | {"line_start": lo, "line_end": hi, "line_text": owner, "line_failed": failed, "data": data}


def _cleaned(found: dict[str, np.ndarray]) -> list[str]:
    raw, texts = found["data"].tobytes(), [[] for _ in found["n_words"]]
    for a, b, i, bad in zip(found["line_start"].tolist(), found["line_end"].tolist(), found["line_text"].tolist(), found["line_failed"].tolist(), strict=True):
        if not bad:
            texts[i].append(raw[a:b])
    return [b"\n".join(x).decode("utf-8", "replace") for x in texts]


def quality_rules(docs: DataFrame, rules: Rules = Rules(), cleaned: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost`` of each row.

    ``lost``: the share of its non-space bytes in lines that fail; with ``cleaned`` also the text
    without them.  A null or empty text has no words: all counts are 0 and it fails the
    base; an empty table gives no rows.  Ids may be null or repeat, other columns are not read.  One narrow stage, no shuffle; memory
    is bounded by a batch or one text.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").fill_null("")
            for lo, hi in ta.pieces(ta.utf8(column)[1], BATCH_BYTES):
                found = judged(column.slice(lo, hi - lo), rules)
                arrays = [batch.column("doc_id").slice(lo, hi - lo), *(pa.array(found[c], pa.int64()) for c in counts), pa.array(found["base_failed"]), pa.array(found["kept"]), pa.array(found["lost"], pa.float64())]
                names = ["doc_id", *counts, "base_failed", "kept", "lost"]
                if cleaned:
                    arrays, names = [*arrays, pa.array(_cleaned(found), pa.string())], [*names, "cleaned"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(judge, f"doc_id {kind}, {', '.join(f'{c} long' for c in counts)}, base_failed boolean, kept boolean, lost double" + ", cleaned string" * cleaned)
