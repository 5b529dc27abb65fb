"""Small helpers shared by the operators."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from channelspark.session import stored, work_path

TOKENIZERS = os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame) -> Column:
    """The whole row as one struct, so that helper columns cannot clash with the caller's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(df: DataFrame, columns: Sequence[str], row: str = "row", **changed: Column) -> DataFrame:
    """Back to the caller's columns; ``changed`` replaces some of them."""
    return df.select(*[
        changed[c].alias(c) if c in changed else F.col(f"{row}.`{c}`").alias(c) for c in columns
    ])


def text_of(column: str = "text") -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the text ``null``."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("null"))), F.lit(modulus)).cast("int")


def written(df: DataFrame, name: str) -> DataFrame:
    """Like ``stored``, compressed harder: for columns as large as the text."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_slices(rows: DataFrame, by: Column, limit: int) -> DataFrame:
    """Rows (``key``, ...) with a flag ``tree``, where keys with more than ``limit`` rows are cut up.

    A large key's rows are dealt to slices by a hash of ``by``, and every two slices get a key of their own,
    under which the first slice is flagged and meets the second. Small keys stay as they are.
    """
    large = stored(rows.groupBy("key").count().where(F.col("count") > limit), "large-keys")
    if large.isEmpty():
        return rows.withColumn("tree", F.lit(True))
    slices = F.coalesce(F.ceil(F.col("count") / limit), F.lit(1)).cast("int")
    key = F.when(F.col("count").isNull(), F.col("key")).otherwise(
        F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
    rest = [c for c in rows.columns if c != "key"]
    return (
        rows.join(large, "key", "left").withColumn("mine", F.pmod(F.xxhash64(by), slices).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), slices - 1)))
        .select(key.alias("key"), *rest, (F.col("mine") <= F.col("other")).alias("tree"))
    )


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table per run of equal ``key`` in batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        starts = np.append(0, np.flatnonzero(np.diff(keys)) + 1) if len(keys) else []
        for start, end in zip(starts, [*starts[1:], len(keys)]):
            if held and held[0].column("key")[0].as_py() != keys[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(int(start), int(end - start)))
    if held:
        yield pa.Table.from_batches(held)
