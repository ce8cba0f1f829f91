"""What needs BLAKE2 or a loop over characters: Arrow-batched pandas functions."""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERMUTATIONS, BAND = 32, 4


def hash_shingle(shingle: str, seed: int) -> int:
    """64 bits of BLAKE2b over "seed:shingle", big-endian."""
    return int.from_bytes(hashlib.blake2b(f"{seed}:{shingle}".encode(), digest_size=8).digest(), "big")


def minhash_of(shingles: list[str]) -> list[int]:
    return [min(hash_shingle(s, seed) for s in shingles) for seed in range(PERMUTATIONS)] if len(shingles) else []


def bands_of(signature: list[int]) -> list[str]:
    """Whole bands only, each as text with its place."""
    return [f"{i // BAND}:" + "-".join(f"{x:016x}" for x in signature[i : i + BAND]) for i in range(0, len(signature) - BAND + 1, BAND)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def lsh_bands(shingles: pd.Series) -> pd.Series:
    """The bands of each set of shingles; equal sets in a batch are hashed once."""
    known: dict[tuple, list[str]] = {}
    return pd.Series([known.setdefault(k, None) or known.__setitem__(k, bands_of(minhash_of(k))) or known[k] for k in (tuple(x if x is not None else ()) for x in shingles)], dtype=object)


def chunk_text_of(text: str, max_chars: int, overlap: int) -> list[str]:
    """Windows of at most ``max_chars`` characters that end at white space where there is any; blank pieces go."""
    text, max_chars = text or "", max(1, max_chars)
    if len(text) <= max_chars:
        return [text.strip()] if text.strip() else []
    overlap, start, out = min(overlap, max_chars - 1), 0, []
    while start < len(text):
        end = min(start + max_chars, len(text))
        if end < len(text):
            end = next((i for i in range(end - 1, start, -1) if text[i].isspace()), end)
        if piece := text[start:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def chunk_text(max_chars: int, overlap: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def chunked(text: pd.Series) -> pd.Series:
        return pd.Series([chunk_text_of(t, max_chars, overlap) for t in text], dtype=object)

    return chunked


def chunk_uuid_of(group: str, doc: str, index: int) -> str:
    """A fixed id for (group, document, index)."""
    raw = b"\x1f".join((group.encode(), doc.encode(), int(index).to_bytes(8, "little")))
    return str(uuid.UUID(bytes=hashlib.blake2b(raw).digest()[:16]))


@F.pandas_udf(T.StringType())
def chunk_uuid(group: pd.Series, doc: pd.Series, index: pd.Series) -> pd.Series:
    return pd.Series([chunk_uuid_of(*x) for x in zip(group, doc, index, strict=True)], dtype=object)


def embed_of(text: str, dim: int) -> list[float]:
    """The deterministic stand-in embedder: byte i adds b / 255 to slot i mod dim; unit length."""
    v = [0.0] * dim
    for i, b in enumerate((text or "").encode()):
        v[i % dim] += b / 255
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else v


def hash_embed(dim: int):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embedded(text: pd.Series) -> pd.Series:
        return pd.Series([embed_of(t, dim) for t in text], dtype=object)

    return embedded
