"""Words, word hashes and window hashes of whole Arrow text columns, in numpy.

Texts are handled as one UTF-8 byte buffer with offsets, so no Python object is
made per word.  All hashes are fixed functions of the bytes: every task, on any
machine, gets the same value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64

#: ASCII white space: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Maps A-Z to a-z and leaves all other bytes.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE = U64(0xD1342543DE82EF95)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
#: Multipliers of the two halves of a window's 128-bit hash.
WINDOW_BASES = (U64(0xF1357AEA2E62A9C5), U64(0xAF251AF3B0F025B5))

#: Bytes whose prefix sums are held at a time.
SPAN_BYTES = 1 << 20

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=U64)
    return _powers["up"], _powers["down"]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def pieces(offs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row where it alone is longer."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the range of its words (``bounds[i]`` to ``bounds[i + 1]``)."""
    solid = ~separator[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = solid[cut]
    last[cut - 1] = solid[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and don't overlap.

    Taken a part at a time: a hash doesn't depend on where its span stands, and the sums of a part take a few times 8 bytes for each byte.
    """
    if len(data) <= SPAN_BYTES:
        return _span_hashes(data, starts, ends)
    out, i = np.empty(len(starts), U64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SPAN_BYTES)))
        out[i:j] = _span_hashes(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i])
        i = j
    return out


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """From prefix sums of a polynomial."""
    up, down = _power(len(data) + 1)
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], dtype=U64, out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64))


def window_hashes(hashes: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """A hash of each ``size`` consecutive word hashes, wherever texts begin or end."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n].copy()
    for j in range(1, size):
        out *= base
        out += hashes[j : j + n]
    return mix(out)


def window_starts(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``size`` words inside one text: its first word, and its text."""
    count = np.maximum(0, np.diff(bounds) - size + 1)
    text = np.repeat(np.arange(len(count)), count)
    before = np.concatenate(([0], np.cumsum(count)))[:-1]
    return np.arange(int(count.sum())) - np.repeat(before, count) + np.repeat(bounds[:-1], count), text


def per_text_distinct(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of each text, sorted by text and key."""
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    return keys[new], text[new]


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit integers as the byte planes of their differences, which compress well."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=U64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, U64)
    width = packed[0]
    n = (len(packed) - 1) // width
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :width] = np.frombuffer(packed, np.uint8, offset=1).reshape(width, n).T
    return np.cumsum(planes.view("<u8").ravel(), dtype=U64)
