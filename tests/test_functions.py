"""Exact values of scalar, vector and hash functions."""

import math

import pytest
from pyspark.sql import functions as F

from graphmem.functions import hashed, text, vector


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "expected"), [("O'Brien, Inc.", "o'brien inc"), ("  Alice   Smith! ", "alice smith"), ("a@#b", "a b"), ("café", "caf")])
def test_fuzzy_names(spark, given, expected):
    assert one(spark, text.normalize_fuzzy(F.lit(given))) == expected


@pytest.mark.parametrize(("given", "bits"), [("", 0.0), ("ab", 1.0), ("aaaaaa", 0.0), ("a a", 0.0)])
def test_entropy(spark, given, bits):
    assert one(spark, text.name_entropy(F.lit(given))) == pytest.approx(bits)


@pytest.mark.parametrize(("given", "high"), [("aaa", False), ("abc", False), ("a b", False), ("aaaaaaa", False), ("alice smith", True), ("abcdef", True)])
def test_entropy_gate(spark, given, high):
    assert one(spark, text.has_high_entropy(F.lit(given))) is high


@pytest.mark.parametrize(("given", "grams"), [("abc", ["abc"]), ("ab", []), ("a", ["a"]), ("", []), ("ab cd", ["abc", "bcd"])])
def test_shingles(spark, given, grams):
    assert sorted(one(spark, text.shingles(F.lit(given)))) == grams


def test_jaccard(spark):
    empty, some = F.array().cast("array<string>"), F.array(F.lit("a"), F.lit("b"))
    assert one(spark, text.jaccard(empty, empty)) == 1.0
    assert one(spark, text.jaccard(empty, some)) == 0.0
    assert one(spark, text.jaccard(some, F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)


def test_hash_values():
    assert hashed.hash_shingle("abc", 0) == 7705568351334315143
    assert hashed.hash_shingle("abc", 1) == 17109218681013626300
    assert len(hashed.bands_of(hashed.minhash_of(["abc"]))) == 8
    assert hashed.bands_of(hashed.minhash_of([])) == []


def test_chunks(spark):
    assert hashed.chunk_text_of("alpha beta gamma", 8, 0)[0] == "alpha"
    assert hashed.chunk_text_of("  ", 8, 0) == []
    assert hashed.chunk_text_of(" short ", 80, 5) == ["short"]
    assert "".join(hashed.chunk_text_of("abcdefghij", 3, 0)) == "abcdefghij"
    assert all(len(x) <= 5 for x in hashed.chunk_text_of("one two three four five six", 5, 4))
    assert hashed.chunk_uuid_of("g", "d", 1) == hashed.chunk_uuid_of("g", "d", 1) != hashed.chunk_uuid_of("g", "d", 2)
    rows = spark.createDataFrame([("alpha beta gamma",), (None,)], "t string").select(hashed.chunk_text(8, 0)("t").alias("c")).collect()
    assert rows[0]["c"][0] == "alpha" and rows[1]["c"] == []


def test_truncation(spark):
    long = "One. " + "x" * 2000
    assert one(spark, text.truncate_at_sentence(F.lit(long))) == "One."
    assert one(spark, text.truncate_at_sentence(F.lit("y" * 1200))) == "y" * 1000
    assert one(spark, text.truncate_bytes(F.lit("éé"), 3)) == "é"


def test_times(spark):
    assert one(spark, text.isoformat(F.lit("2025-01-02 03:04:05").cast("timestamp"))) == "2025-01-02T03:04:05+00:00"
    assert one(spark, text.isoformat(F.lit("2025-01-02 03:04:05.000120").cast("timestamp"))) == "2025-01-02T03:04:05.000120+00:00"
    assert one(spark, text.parse_iso(F.lit("2025-01-02T03:04:05Z"))).year == 2025
    assert one(spark, text.parse_iso(F.lit("junk"))) is None


def test_labels(spark):
    def of(*x):
        return F.array(*map(F.lit, x))

    assert one(spark, text.promote_labels(of("Entity"), of("Entity", "Person"))) == ["Entity", "Person"]
    assert one(spark, text.promote_labels(of("Entity", "Place"), of("Entity", "Person"))) == ["Entity", "Place"]
    assert one(spark, text.union_labels(of("b"), of("a", "b"))) == ["a", "b"]


def test_vectors(spark):
    a, b, zero = (vector.literal(x) for x in ([3.0, 4.0], [4.0, 3.0], [0.0, 0.0]))
    assert one(spark, vector.cosine(a, b)) == pytest.approx(0.96)
    assert one(spark, vector.cosine(a, zero)) == 0.0
    assert one(spark, vector.cosine(a, vector.literal([1.0]))) == 0.0
    assert one(spark, vector.normalize_l2(a)) == pytest.approx([0.6, 0.8])
    assert one(spark, vector.normalize_l2(zero)) == [0.0, 0.0]
    assert math.isclose(sum(x * x for x in hashed.embed_of("some text", 8)), 1.0)


def test_query_tokens():
    assert text.query_tokens("The CAFÉ, the bar") == ["the", "cafe", "bar"]
    assert text.query_tokens(" ".join(f"w{i}" for i in range(128))) == []


def test_reranker_score_and_clipped_vectors(spark):
    from graphmem.functions import vector
    from graphmem.plans.clients import log_probability

    rows = spark.createDataFrame([(" True ", -0.1, [1.0, 2.0, 3.0]), ("false", -0.1, [1.0])], "word string, p double, v array<double>")
    got = rows.select(log_probability(F.col("word"), F.col("p")).alias("s"), vector.clipped(F.col("v"), 2).alias("v")).collect()
    assert [round(r["s"], 6) for r in got] == [0.904837, 0.095163] and [r["v"] for r in got] == [[1.0, 2.0], [1.0]]


def test_names_of_labels_and_groups_are_checked():
    from graphmem.operators.filters import checked_group, checked_labels

    assert checked_group("") == "" and checked_group("a-b_1") == "a-b_1" and checked_labels(["A_1"]) == ["A_1"]
    for bad in ("a b", "a;b", "ä"):
        with pytest.raises(ValueError):
            checked_group(bad)
        with pytest.raises(ValueError):
            checked_labels([bad])
