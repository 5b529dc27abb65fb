"""Joins and ranks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hot_keys(many: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Keys that hold more than an even partition's share of the rows, with the number of parts (``_salts``) to cut them into.

    There are fewer of them than shuffle partitions, whatever the input.
    """
    if partitions is None:
        partitions = max(2, int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    share = F.col("_rows") * partitions / counts.select(F.sum("_rows")).scalar()
    return counts.where(share > 1).select(*keys, F.ceil(share).cast("int").alias("_salts"))


def salted_join(
    many: DataFrame, few: DataFrame, keys: Sequence[str], spread: str, salts: int | None = None
) -> DataFrame:
    """Inner equi-join that splits hot keys, and only those.

    The rows of a key are counted first. ``many`` rows of a hot key get a salt from a hash of ``spread`` and its
    ``few`` rows are repeated once per salt; all other rows are joined as they are. ``salts`` sets the number of
    partitions that a key's share is measured against.
    """
    hot = F.broadcast(hot_keys(many, keys, salts))  # fewer rows than shuffle partitions

    def marked(side: DataFrame) -> DataFrame:
        return side.join(hot, list(keys), "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))

    left = marked(many).withColumn("_salt", F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int")).drop("_salts")
    right = marked(few).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def with_rank(
    df: DataFrame, group: Sequence[str], index: str, name: str = "rank", width: int = 1 << 20
) -> DataFrame:
    """Zero-based rank of a unique integer ``index`` inside ``group`` without one task per group.

    Rows are numbered inside index ranges of ``width``; range sizes are summed over the small
    (group, range) table to give each range its starting rank.
    """
    ranged = df.withColumn("_range", F.floor(F.col(index) / F.lit(width)))
    keys = [*group, "_range"]
    order = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, F.coalesce(F.sum("_rows").over(order), F.lit(0)).alias("_start"))
    )
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(index)) - 1
    return (
        ranged.withColumn("_inside", inside)
        .join(starts, keys)
        .withColumn(name, (F.col("_start") + F.col("_inside")).cast("bigint"))
        .drop("_range", "_inside", "_start")
    )
