"""Text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphmem.schema import MAX_SUMMARY_CHARS

#: Letters with marks and their plain forms, for full-text tokens.
ACCENTS = ("áàâäãåéèêëíìîïóòôöõúùûüñçýÿß", "aaaaaaeeeeiiiiooooouuuuncyys")
#: A query of so many tokens or more (groups count) finds nothing.
MAX_QUERY_TOKENS = 128
ENTROPY_LEAST, SHORT_NAME, FEW_TOKENS = 1.5, 6, 2


def normalize_exact(s: Column) -> Column:
    """Runs of white space as one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def normalize_fuzzy(s: Column) -> Column:
    """The exact form with all but a-z, 0-9, apostrophe and space as spaces, collapsed again."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalize_exact(s), r"[^a-z0-9' ]", " "), r"\s+", " "))


def tokens(s: Column) -> Column:
    """Lower-case tokens of a-z and 0-9, accents folded."""
    return F.array_remove(F.split(F.translate(F.lower(F.coalesce(s, F.lit(""))), *ACCENTS), "[^a-z0-9]+"), "")


def query_tokens(query: str, groups: list[str] | None = None) -> list[str]:
    """Distinct tokens of a query, in order; empty if the query is too long."""
    folded = query.lower().translate(str.maketrans(*ACCENTS))
    found = [t for t in re.split("[^a-z0-9]+", folded) if t]
    return [] if len(found) + len(groups or []) >= MAX_QUERY_TOKENS else list(dict.fromkeys(found))


def characters(s: Column) -> Column:
    return F.array_remove(F.split(s, ""), "")


def name_entropy(s: Column) -> Column:
    """Shannon entropy, in bits, of the characters but spaces; 0 for none."""
    chars = F.filter(characters(s), lambda c: c != " ")
    n = F.size(chars).cast("double")
    bits = F.aggregate(
        F.transform(F.array_sort(F.array_distinct(chars)), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n),
        F.lit(0.0),
        lambda total, p: total - p * F.log2(p),
    )
    return F.when(n > 0, bits).otherwise(0.0)


def has_high_entropy(s: Column) -> Column:
    """Whether a normalized name says enough to match it fuzzily."""
    few = (F.length(s) < SHORT_NAME) & (F.size(F.filter(F.split(s, " "), lambda t: t != "")) < FEW_TOKENS)
    return F.when(few, False).otherwise(name_entropy(s) >= ENTROPY_LEAST)


def shingles(s: Column) -> Column:
    """Distinct 3-grams without spaces; one character is itself, two give none."""
    bare = F.replace(s, F.lit(" "), F.lit(""))
    n = F.length(bare)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(bare, i, F.lit(3)))
    return F.when(n >= 3, F.array_distinct(grams)).when(n == 1, F.array(bare)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def truncate_at_sentence(s: Column, limit: int = MAX_SUMMARY_CHARS) -> Column:
    """Texts over ``limit`` code points, cut after the last sentence end in that range, else at the limit; trailing space stripped."""
    head = F.substring(s, 1, limit)
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.length(s) <= limit, s).otherwise(F.rtrim(F.when(whole != "", whole).otherwise(head)))


def truncate_bytes(s: Column, limit: int) -> Column:
    """At most ``limit`` UTF-8 bytes, never inside a character."""
    start = F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n"))
    room = F.aggregate(
        characters(F.substring(s, 1, limit)),
        start,
        lambda a, c: F.struct((a["bytes"] + F.octet_length(c)).alias("bytes"), (a["n"] + (a["bytes"] + F.octet_length(c) <= limit).cast("int")).alias("n")),
    )
    return F.when(F.octet_length(s) <= limit, s).otherwise(F.substring(s, F.lit(1), room["n"]))


def isoformat(ts: Column) -> Column:
    """UTC, with six digits of fraction unless it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000))
    return F.concat(whole, F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))), F.lit("+00:00"))


def parse_iso(s: Column) -> Column:
    """A timestamp, or null if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(s, "[Zz]$", "+00:00"))


def union_labels(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def promote_labels(resolved: Column, extracted: Column) -> Column:
    """The resolved labels if one says more than Entity, else Entity, the resolved and the extracted specific ones."""
    specific = F.exists(resolved, lambda x: x != "Entity")
    merged = F.array_distinct(F.concat(F.array(F.lit("Entity")), resolved, F.filter(extracted, lambda x: x != "Entity")))
    return F.when(specific, resolved).otherwise(merged)
