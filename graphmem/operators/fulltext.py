"""Full-text search by BM25, or by containment."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmem.functions.text import query_tokens, tokens

K1, B = 1.2, 0.75


def text_of(*columns: str) -> Column:
    return F.concat_ws(" ", *columns)


def bm25(rows: DataFrame, text: Column, query: str, limit: int, groups: list[str] | None = None) -> DataFrame:
    """``rows`` with ``score``, the best ``limit`` first in order of score, then uuid.

    Statistics are those of all ``rows``; groups restrict the result.  A text is split once for the statistics and once for the scores, and its terms are
    counted inside the row, so nothing is exploded: one aggregate of one row, and a top-k.  A query without tokens, or with too many, finds nothing.
    """
    terms = query_tokens(query, groups)
    if not terms:
        return rows.limit(0).withColumn("score", F.lit(0.0))
    counted = rows.withColumn("_h", _hits(text, terms))
    found = [F.size(F.filter("_h.hits", _equals(term))).cast("double") for term in terms]
    stats = counted.select("_h").agg(F.count("*").cast("double").alias("_n"), F.avg("_h.len").alias("_avg"), *[F.sum((f > 0).cast("double")).alias(f"_d{i}") for i, f in enumerate(found)])
    own = counted.where(F.col("group_id").isin(groups)) if groups and groups != [""] else counted
    parts = [_part(f, F.col(f"_d{i}"), F.col("_h.len")) for i, f in enumerate(found)]
    scored = own.crossJoin(F.broadcast(stats)).withColumn("score", functools.reduce(operator.add, parts))  # stats is one row
    # A text without a term scores 0; a filter before the top-k would split every text once more.
    return scored.select(*rows.columns, "score").orderBy(F.col("score").desc(), "uuid").limit(limit).where("score > 0").orderBy(F.col("score").desc(), "uuid")


def _equals(term: str):
    return lambda x: x == term


def _hits(text: Column, terms: list[str]) -> Column:
    """The number of a text's tokens, and those that are terms; the tokens are bound once, as the only item of an array, and read once."""

    def counts(t: Column) -> Column:
        return F.struct(F.size(t).cast("double").alias("len"), F.filter(t, lambda x: x.isin(terms)).alias("hits"))

    return F.element_at(F.transform(F.array(tokens(text)), counts), 1)


def _part(tf: Column, df: Column, length: Column) -> Column:
    idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("_avg")))


def contains(rows: DataFrame, text: Column, query: str, limit: int, groups: list[str] | None = None) -> DataFrame:
    """Rows whose text has the whole query, without regard to case, by uuid."""
    own = rows.where(F.col("group_id").isin(groups)) if groups and groups != [""] else rows
    return own.where(F.contains(F.lower(text), F.lit(query.lower()))).withColumn("score", F.lit(1.0)).orderBy("uuid").limit(limit)


def term_table(rows: DataFrame, text: Column) -> DataFrame:
    """The inverted index to store: ``term, group_id, uuid, tf, len``."""
    own = rows.select("uuid", "group_id", tokens(text).alias("t"))
    each = own.select("uuid", "group_id", F.size("t").alias("len"), F.explode("t").alias("term"))
    return each.groupBy("term", "group_id", "uuid", "len").agg(F.count("*").alias("tf"))


def search_terms(index: DataFrame, query: str, n_rows: int, avg_len: float, limit: int, groups: list[str] | None = None) -> DataFrame:
    """``uuid, score`` from a stored ``term_table``; terms are a filter that reaches its scan."""
    terms = query_tokens(query, groups)
    hit = index.where(F.col("term").isin(terms) if terms else F.lit(False))
    df = hit.groupBy("term").agg(F.count("*").cast("double").alias("_d"))
    own = hit.where(F.col("group_id").isin(groups)) if groups and groups != [""] else hit
    scored = own.join(F.broadcast(df), "term").withColumn("_n", F.lit(float(n_rows))).withColumn("_avg", F.lit(float(avg_len))).withColumn("_len", F.col("len").cast("double"))
    return scored.groupBy("uuid").agg(F.sum(_part(F.col("tf").cast("double"), F.col("_d"), F.col("_len"))).alias("score")).orderBy(F.col("score").desc(), "uuid").limit(limit)
