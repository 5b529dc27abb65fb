"""Point labels: one JSON document per scene with bs_points and ue_points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from channelspark.operators.skew import salted_join

_POINT = T.StructType([
    T.StructField("position", T.ArrayType(T.DoubleType())),
    *[T.StructField(c, T.DoubleType()) for c in "xyz"],
    T.StructField("label", T.StringType()),
])
LABEL_SCHEMA = T.StructType([
    T.StructField("scene_id", T.LongType()),
    T.StructField("bs_points", T.ArrayType(_POINT)),
    T.StructField("ue_points", T.ArrayType(_POINT)),
])


def read_labels(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Label documents with an explicit schema: one per line, or one per file (``multi_line``)."""
    return spark.read.schema(LABEL_SCHEMA).option("multiLine", multi_line).json(path)


def _points(labels: DataFrame, role: str) -> DataFrame:
    points = F.col(f"{role}_points")
    message = F.lit(f"label document without the top-level list {role}_points")
    checked = F.when(points.isNull(), F.raise_error(message).cast(LABEL_SCHEMA[f"{role}_points"].dataType)
                     ).otherwise(points)
    exploded = labels.select("scene_id", F.posexplode(checked).alias("idx", "p"))

    def coordinate(i: int, name: str) -> Column:
        return F.coalesce(F.get("p.position", F.lit(i)), F.col(f"p.{name}"))

    x, y, z = (coordinate(i, c) for i, c in enumerate("xyz"))
    wrong = (F.col("p.position").isNotNull() & (F.size("p.position") != 3)) \
        | x.isNull() | y.isNull() | z.isNull()
    error = F.raise_error(F.lit("a point needs exactly three coordinates")).cast("boolean")
    # a filter, so that the check runs whichever columns a query asks for
    return exploded.where(F.when(wrong, error).otherwise(F.lit(True))).select(
        "scene_id", F.lit(role).alias("role"), F.col("idx").cast("bigint").alias("idx"),
        x.alias("x"), y.alias("y"), z.alias("z"),
        F.col("p.label").alias("label"),
    )


def read_points(labels: DataFrame) -> DataFrame:
    """Label documents to the points table; ``idx`` is the position in its list."""
    return _points(labels, "bs").unionByName(_points(labels, "ue"))


def count_points(labels: DataFrame) -> DataFrame:
    """Stations and users per document without unnesting; an absent list counts as empty."""
    return labels.select("scene_id", *[
        F.coalesce(F.size(f"{role}_points"), F.lit(0)).cast("bigint").alias(f"{role}_count")
        for role in ("bs", "ue")
    ])


def select_points(
    points: DataFrame, role: str, *, max_count: int, start: int = 0, count: int | None = None,
    indices: Sequence[int] | None = None,
) -> DataFrame:
    """Points of one role by explicit indices or by a start + count window, per scene.

    Explicit indices and counts beyond the list are errors raised by the result; without a count
    the window is clipped.
    """
    if max_count < 1 or start < 0 or (count is not None and count < 1):
        raise ValueError("counts must be positive and start non-negative")
    if indices is not None and not indices:
        raise ValueError("indices must not be empty")
    rows = points.where(F.col("role") == role)
    sizes = rows.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n"))
    sized = salted_join(rows, sizes, ["scene_id"], "idx")
    needed = max(indices) + 1 if indices is not None else start + (count if count else 1)
    if indices is not None:
        if min(indices) < 0:
            raise ValueError("indices must be non-negative")
        wanted = F.col("idx").isin(list(indices))
    else:
        wanted = F.col("idx").between(start, start + (count or max_count) - 1)
    message = F.concat(F.lit("selection exceeds the points of scene "), F.col("scene_id"))
    checked = F.when(F.col("_n") < needed, F.raise_error(message).cast("boolean")).otherwise(wanted)
    return sized.where(checked).drop("_n")
