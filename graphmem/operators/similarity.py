"""Exact vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmem.functions import vector


def top_k(rows: DataFrame, column: str, query: list[float], limit: int, min_score: float = 0.6, groups: list[str] | None = None) -> DataFrame:
    """The ``limit`` rows of highest cosine, strictly above ``min_score``, with ``score``; ties by uuid.

    The query is a literal; the threshold comes after the top-k, so the score is computed once and the plan is
    a TakeOrderedAndProject.
    """
    own = rows.where(F.col(column).isNotNull())
    own = own.where(F.col("group_id").isin(groups)) if groups and groups != [""] else own
    best = own.withColumn("score", vector.cosine(F.col(column), vector.literal(query))).orderBy(F.col("score").desc(), "uuid").limit(limit)
    return best.where(F.col("score") > min_score)


def candidates(queries: DataFrame, rows: DataFrame, column: str, limit: int = 15, min_score: float = 0.6, blocks: int = 1) -> DataFrame:
    """For each query (``query_uuid, group_id, vector``) the best rows of its group: ``query_uuid, uuid, score, rank``.

    With ``blocks``, the rows of a group are dealt into that many, each query goes to all of them, and the best of the blocks are ranked again.
    """
    from pyspark.sql.window import Window

    own = rows.where(F.col(column).isNotNull()).select("uuid", "group_id", column, F.pmod(F.xxhash64("uuid"), F.lit(blocks)).cast("int").alias("_block"))
    asked = queries.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    scored = asked.join(own, ["group_id", "_block"]).withColumn("score", vector.cosine(F.col("vector"), F.col(column))).where(F.col("score") > min_score)
    best = (F.col("score").desc(), "uuid")
    if blocks > 1:
        scored = scored.withColumn("_rank", F.row_number().over(Window.partitionBy("query_uuid", "_block").orderBy(*best))).where(F.col("_rank") <= limit)
    w = Window.partitionBy("query_uuid").orderBy(*best)
    return scored.select("query_uuid", "uuid", "score", F.row_number().over(w).alias("rank")).where(F.col("rank") <= limit)
