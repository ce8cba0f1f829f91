"""Bi-temporal rules: facts are closed, never deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contradicted(new_valid: Column, new_invalid: Column, old_valid: Column, old_invalid: Column) -> Column:
    """Whether a new fact closes an old one: they overlap, and the old one began strictly before."""
    apart = F.coalesce(old_invalid <= new_valid, F.lit(False)) | F.coalesce(new_invalid <= old_valid, F.lit(False))
    return ~apart & F.coalesce(old_valid < new_valid, F.lit(False))


def close_contradicted(pairs: DataFrame, now: Column) -> DataFrame:
    """``pairs`` of ``new_valid, new_invalid, old_valid, old_invalid, old_expired`` with the old fact's ``invalid_at, expired_at``."""
    closes = contradicted(F.col("new_valid"), F.col("new_invalid"), F.col("old_valid"), F.col("old_invalid"))
    return pairs.withColumn("invalid_at", F.when(closes, F.col("new_valid")).otherwise(F.col("old_invalid"))).withColumn("expired_at", F.when(closes, F.coalesce("old_expired", now)).otherwise(F.col("old_expired")))


def expire_new(edges: DataFrame, candidates: DataFrame, now: Column) -> DataFrame:
    """New edges (``uuid, valid_at, invalid_at, expired_at``) with what later candidates (``uuid, candidate_valid``) make of them.

    An edge that already ends is expired now; else the earliest candidate that begins strictly later ends it.  One that is expired stays as it is.
    """
    later = edges.select("uuid", "valid_at").join(candidates, "uuid").where(F.col("candidate_valid") > F.col("valid_at")).groupBy("uuid").agg(F.min("candidate_valid").alias("_next"))
    open_ = F.col("expired_at").isNull()
    invalid = F.when(open_ & F.col("invalid_at").isNull(), F.col("_next")).otherwise(F.col("invalid_at"))
    expired = F.when(open_ & (F.col("invalid_at").isNotNull() | F.col("_next").isNotNull()), now).otherwise(F.col("expired_at"))
    return edges.join(later, "uuid", "left").select(*[c for c in edges.columns if c not in ("invalid_at", "expired_at")], invalid.alias("invalid_at"), expired.alias("expired_at"))


def timeline(facts: DataFrame, now: Column, *key: str) -> DataFrame:
    """The whole history at once: each fact of a key ends where the next one begins strictly later.

    Facts of equal time end together: the next distinct time is taken from a range frame, in one window over one shuffle.
    """
    w = Window.partitionBy(*key).orderBy(F.unix_micros("valid_at")).rangeBetween(1, Window.unboundedFollowing)
    ends = facts.withColumn("invalid_at", F.min("valid_at").over(w))
    return ends.withColumn("expired_at", F.when(F.col("invalid_at").isNotNull(), now))


def valid_at(facts: DataFrame, at: Column) -> DataFrame:
    """Facts that hold at a time."""
    return facts.where((F.col("valid_at") <= at) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at)))


def live(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("expired_at").isNull())
