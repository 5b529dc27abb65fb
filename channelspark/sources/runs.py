"""Run artefacts: manifests, result files, long tables, compaction and output products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from channelspark import schemas
from channelspark.functions.text import natural_key

_RESULT = T.StructType([
    T.StructField("shard_id", T.StringType()), T.StructField("shard_index", T.LongType()),
    T.StructField("path", T.StringType()), T.StructField("bundle", T.StringType()),
    T.StructField("append_offset", T.LongType()),
    T.StructField("global_ue_indices", T.ArrayType(T.LongType())),
    T.StructField("global_bs_indices", T.ArrayType(T.LongType())),
])
MANIFEST_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()), T.StructField("results", T.ArrayType(_RESULT)),
    T.StructField("result", T.StringType()),
])


def read_manifest(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One row per shard fragment; a bundle takes the place of the shard's own file.

    A manifest without results is a single-file run and gives one fragment.
    """
    raw = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", multi_line).json(path)
    many = raw.select("run_id", F.posexplode("results").alias("entry", "r")).select(
        "run_id", F.col("entry").cast("bigint").alias("entry"), "r.shard_id", "r.shard_index",
        F.coalesce("r.bundle", "r.path").alias("source"),
        F.coalesce("r.append_offset", F.lit(0)).alias("append_offset"),
        "r.global_ue_indices", "r.global_bs_indices",
    )
    alone = raw.where(
        (F.coalesce(F.size("results"), F.lit(0)) <= 0) & F.col("result").isNotNull()
    ).select(
        "run_id", F.lit(0).cast("bigint").alias("entry"), F.lit("000").alias("shard_id"),
        F.lit(0).cast("bigint").alias("shard_index"), F.col("result").alias("source"),
        F.lit(0).cast("bigint").alias("append_offset"),
        F.array().cast("array<bigint>").alias("global_ue_indices"),
        F.array().cast("array<bigint>").alias("global_bs_indices"),
    )
    return many.unionByName(alone)


def resolve_result_paths(spark: SparkSession, path: str, pattern: str = "result_*") -> DataFrame:
    """Files of a run folder or glob in natural numeric order (listing only, nothing is read)."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True).load(path).select("path")
    )
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", name.alias("name"), natural_key(name).alias("sort_key")).orderBy(
        "sort_key", "name"
    )


def scan_dataset(spark: SparkSession, path: str, schema: T.StructType,
                 columns: Sequence[str] | None = None) -> DataFrame:
    """A logical dataset over all its files with the source file of every row."""
    rows = spark.read.schema(schema).option("mergeSchema", False).parquet(path)
    return rows.select(*(columns or rows.columns), F.col("_metadata.file_path").alias("source_file"))


def write_long_table(rows: DataFrame, path: str, partition_by: Sequence[str], order: str,
                     files: int | None = None) -> None:
    """Columnar write with one folder per partition key.

    Rows are range-partitioned by (keys, order): a hot partition key is split over several tasks
    and files, and each file keeps a narrow ``order`` range for scan pruning.
    """
    by = [*partition_by, order]
    spread = rows.repartitionByRange(files, *by) if files else rows.repartitionByRange(*by)
    spread.sortWithinPartitions(*by).write.partitionBy(*partition_by).parquet(path)


def compact_shards(
    spark: SparkSession, source: str, target: str, schema: T.StructType,
    fragment: Sequence[str], order: Sequence[str], file_bytes: int = 256 << 20,
) -> None:
    """Pack small files into ones of about ``file_bytes``; every row keeps fragment id and offset.

    ``order`` must identify a row inside its fragment. A fragment is one small source file.
    """
    rows = spark.read.schema(schema).parquet(source)
    sizes = rows.select("_metadata.file_path", "_metadata.file_size").distinct()
    files = max(1, -(-int(sizes.agg(F.sum("file_size")).first()[0] or 0) // file_bytes))
    offset = F.row_number().over(W.partitionBy(*fragment).orderBy(*order)) - 1
    packed = rows.withColumn("fragment_offset", offset.cast("bigint"))
    packed.repartitionByRange(files, *fragment, *order).sortWithinPartitions(
        *fragment, *order
    ).write.parquet(target)


def resolve_products(products: Sequence[str]) -> list[str]:
    """Canonical product names in request order; aliases and "all" expand, unknown is an error."""
    chosen: list[str] = []
    for name in products:
        canonical = schemas.PRODUCT_ALIASES.get(name, name)
        expanded = schemas.PRODUCTS if canonical == "all" else (canonical,)
        for product in expanded:
            if product not in schemas.PRODUCTS:
                raise ValueError(f"unknown output product {product!r}")
            if product not in chosen:
                chosen.append(product)
    if not chosen:
        raise ValueError("at least one product is needed")
    return chosen


def select_products(wide: DataFrame, products: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Keys plus the columns of the chosen products; the optimizer prunes everything else."""
    columns: list[str] = list(keys)
    for product in resolve_products(products):
        for column in schemas.PRODUCT_COLUMNS[product]:
            if column in wide.columns and column not in columns:
                columns.append(column)
    return wide.select(*columns)
