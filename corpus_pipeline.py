"""Corpus pipeline: toxicity, line dedup, near-dedup, mixing and BPE encoding of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's input. All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from channelspark.llm import bpe, line_dedup, mixing, simhash, toxicity
from channelspark.llm.common import table, unpacked
from channelspark.session import stored

REPEAT_LIMIT = 1.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (learnt from all labels) scores below 0.5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return unpacked(toxicity.score_documents(docs, model).where("score < 0.5"), docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; ``n_chars`` follows the text, no document goes."""
    changed = {"text": F.when(F.col("row.text").isNotNull() | (F.col("n_dropped") > 0), F.col("kept"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("kept").cast("bigint")).otherwise(F.col("row.n_chars"))
    return unpacked(line_dedup.drop_repeated_lines(docs), docs.columns, **changed)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near copies (five-word shingles, similarity 0.8)."""
    return simhash.one_of_each(docs, copies=simhash.near_copies)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; small sources are repeated up to ``REPEAT_LIMIT`` epochs."""
    return unpacked(mixing.mix_sources(docs, repeat_limit=REPEAT_LIMIT), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mixture, with digests of ids and decoded text."""
    return bpe.encode_documents(docs).select(
        "row.doc_id", "row.source", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids",
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("mixing", mix),
    ("BPE encoding", encode),
]

#: The trained classifier, the fingerprints and the encoder have no SQL form; tests hold brute force against them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
