"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, then encoding.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet in the shared folder
and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmem.llm import decontaminate, jaccard_join, sentencepiece_codec, substring_dedup, toxicity
from graphmem.llm.shared import discard, written

TOXIC, SHINGLE, SIMILAR, LEAK = 0.5, 5, 80, 10
#: Words of a passage: at the operator's default of 13, one clean document in ten of the check tables loses words that recur by chance; at 30, one in fifty.
PASSAGE = 30
#: Labels of documents whose hash leaves this remainder are held out, so what the stage catches can be measured on them.
HELD_OUT = (5, 0)
TOKENIZER = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the network learns from the labels of ``documents``, but for the held-out fifth."""
    of, left = HELD_OUT
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % of != left)
    net = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    return toxicity.without_toxic(docs, net, TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group linked by 5-word shingles at a similarity of 0.8."""
    return jaccard_join.one_of_each(docs, SHINGLE, SIMILAR)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 30 words that an earlier document has."""
    return substring_dedup.remove_repeats(docs, PASSAGE)


def cut_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 10-word windows of the benchmark."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), LEAK, "spans")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, text, n_pieces, piece_ids`` and whether decoding gives the text back."""
    import public_tokenizers

    found = sentencepiece_codec.encode(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER), verify_col="round_trip")
    return found.select("doc_id", "text", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", cut_leaks),
    ("sentencepiece", encode),
]

#: A trained network, components of any size and a Viterbi search are not for SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs
