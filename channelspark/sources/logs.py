"""Line logs: scene index, scene catalog, performance events, hardware samples, link chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from channelspark import schemas

SCENE_ENTRY = T.StructType([
    T.StructField("index", T.LongType()), T.StructField("scene_key", T.StringType()),
    T.StructField("scene_class", T.StringType()),
])
SPLIT_ENTRY = T.StructType([
    T.StructField("scene_dir", T.StringType()), T.StructField("split_class", T.StringType()),
    T.StructField("class", T.StringType()), T.StructField("scene_index", T.LongType()),
])
LINK_CHUNKS = T.StructType([
    T.StructField("chunk", T.LongType()), T.StructField("links", T.LongType()),
    T.StructField("duration_s", T.DoubleType()),
])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_id"),
    )


def read_scene_index(spark: SparkSession, path: str, schema: T.StructType = SCENE_ENTRY
                     ) -> DataFrame:
    """Entries of a JSON-lines index; blank lines are skipped, bad ones listed by the next one."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    good = F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")
    return lines.where(good).select(F.from_json("value", schema).alias("e")).select("e.*")


def scene_index_errors(spark: SparkSession, path: str) -> DataFrame:
    """Malformed lines and non-objects with file and line number.

    Splits are counted once; only the bad lines join their split's first line number, so good
    lines never move.
    """
    lines = _lines(spark, path)
    starts = lines.groupBy("file", "block").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    malformed = F.try_parse_json("value").isNull()
    other = ~F.trim("value").startswith("{")
    bad = lines.where((F.trim("value") != "") & (malformed | other))
    return bad.join(starts, ["file", "block"]).select(
        "file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"),
        F.when(malformed, "malformed").otherwise("not an object").alias("problem"), "value",
    )


def load_scene_catalog(spark: SparkSession, path: str, classes: Sequence[str] | None,
                       counts: DataFrame) -> DataFrame:
    """Split-manifest entries of the wanted classes with point counts; links = bs * ue.

    ``counts`` has scene_key, bs_count, ue_count. A scene without counts is an error.
    """
    entries = spark.read.schema(SPLIT_ENTRY).json(path).select(
        F.col("scene_dir").alias("scene_key"),
        F.coalesce("split_class", "class", F.lit("")).alias("scene_class"),
        F.coalesce("scene_index", F.expr(
            "try_cast(regexp_extract(scene_dir, '(\\\\d+)$', 1) AS BIGINT)"), F.lit(0))
        .alias("source_scene_index"),
    )
    if classes is not None:
        entries = entries.where(F.col("scene_class").isin(list(classes)))
    missing = F.raise_error(F.concat(F.lit("no label counts for "), F.col("scene_key")))
    # a filter, so that the check runs whichever columns a query asks for
    known = F.when(F.col("bs_count").isNull(), missing.cast("boolean")).otherwise(F.lit(True))
    return entries.join(counts, "scene_key", "left").where(known).select(
        "scene_key", "scene_class", "source_scene_index", "bs_count", "ue_count", (F.col("bs_count") * F.col("ue_count")).alias("link_count"),
    )


def read_perf_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PERF_EVENTS).json(path)


def read_hardware_samples(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_link_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINK_CHUNKS).option("header", True).csv(path)
