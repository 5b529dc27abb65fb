"""Report sinks and the similarity tables read back from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIMILARITY = T.StructType([
    T.StructField("ue", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in ("magnitude", "phase", "i", "q")],
])


def write_csv_report(rows: DataFrame, path: str) -> None:
    """CSV with a header in every part file; missing values stay empty."""
    rows.write.option("header", True).option("emptyValue", "").csv(path)


def write_json_summary(per_file: DataFrame, totals: DataFrame, path: str) -> None:
    """Summary documents as JSON lines: one per file, then one aggregate per run."""
    files = per_file.select(
        F.lit("file").alias("kind"), F.to_json(F.struct(*per_file.columns)).alias("body")
    )
    whole = totals.select(
        F.lit("aggregate").alias("kind"), F.to_json(F.struct(*totals.columns)).alias("body")
    )
    files.unionByName(whole).write.json(path)


def read_similarity_csv(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Per-user similarity tables of several comparisons; an empty one is an error."""
    if not paths:
        raise ValueError("at least one comparison is needed")
    tables = []
    for comparison, path in paths.items():
        rows = spark.read.schema(SIMILARITY).option("header", True).csv(path)
        if rows.isEmpty():
            raise ValueError(f"similarity table {comparison} is empty")
        tables.append(rows.withColumn("comparison", F.lit(comparison)))
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table)
    return merged
