"""Line dedup with built-in functions only.

Normalised lines are exploded with their position and hashed, distinct documents are counted per
hash, and the positions to drop return to their document, which is reassembled in order. Two
independent 64-bit hashes stand for a line, so only 16 bytes and an id are shuffled per line; text
moves once, in the final join. A hot line is combined map-side when counted, and the join that
hands its positions back is an equi-join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelspark.llm.common import packed, text_of
from channelspark.session import stored

STRIP = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(STRIP)), UPPER, LOWER)


def drop_repeated_lines(
    docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Drop lines found in at least ``min_docs`` documents except in the largest id holding them.

    Returns the columns ``row`` (the input row), ``n_lines``, ``n_dropped`` and ``kept`` (the other
    lines joined by newline). Null text is one empty line. Rows that share an id are one document
    when documents are counted, and each of them is returned. A row without an id is not counted as
    a document and keeps no repeated line. Repeats of a line inside its keeper stay.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be at least 2")
    rows = docs.select(
        packed(docs).alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("text")
    )
    keyed = (
        rows.select("id", "text", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("id", F.xxhash64("text").alias("part"), "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "part", "pos", F.xxhash64("key").alias("h1"),
                F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    )
    # written, so that the join below is one of two plain tables: small enough to broadcast, or split when skewed
    repeated = stored(
        keyed.where(F.col("id").isNotNull())
        .groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs),
        "repeated-lines",
    )
    drops = (
        keyed.join(repeated, ["h1", "h2"])
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "part").agg(F.collect_set("pos").alias("drop"))
        .select(F.col("id").alias("drop_id"), F.col("part").alias("drop_part"), "drop")
    )
    lines = F.col("lines")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce("drop", F.array().cast("array<int>")))
    return (
        rows.join(drops, F.col("id").eqNullSafe(F.col("drop_id")) & (F.xxhash64("text") == F.col("drop_part")), "left")
        .select("row", F.split("text", "\n").alias("lines"), "drop")
        .select("row", "lines", kept.alias("at"))
        .select(
            "row",
            F.size("lines").cast("bigint").alias("n_lines"),
            (F.size("lines") - F.size("at")).cast("bigint").alias("n_dropped"),
            F.array_join(F.transform("at", lambda i: F.get("lines", i)), "\n").alias("kept"),
        )
    )
