"""Scene and file name fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_tag(label_name: Column) -> Column:
    """File stem without the ``label_`` prefix and without underscores."""
    stem = F.regexp_replace(F.regexp_extract(label_name, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(stem, r"^label_", ""), "_", "")


def trailing_index(scene_key: Column) -> Column:
    """Trailing integer of a scene key, 0 if there is none."""
    digits = F.regexp_extract(scene_key, r"(\d+)$", 1)
    return F.when(digits == "", F.lit(0)).otherwise(digits.cast("bigint")).cast("bigint")


def safe_name(value: Column) -> Column:
    replaced = F.regexp_replace(value, r"[^A-Za-z0-9_.-]+", "_")
    return F.regexp_replace(replaced, r"^_+|_+$", "")


def natural_key(name: Column) -> Column:
    """Sort key of file names: every run of digits as a number; [0] if there is none."""
    numbers = F.transform(
        F.regexp_extract_all(name, F.lit(r"(\d+)"), F.lit(1)), lambda d: d.cast("bigint")
    )
    return F.when(F.size(numbers) == 0, F.array(F.lit(0).cast("bigint"))).otherwise(numbers)


def index_id(index: Column) -> Column:
    """Six-digit zero-padded id; longer numbers keep all their digits."""
    text = index.cast("string")
    return F.when(F.length(text) >= 6, text).otherwise(F.lpad(text, 6, "0"))


def csv_list(text: Column) -> Column:
    """Comma-separated text to a trimmed list without empty items."""
    parts = F.transform(F.split(text, ","), F.trim)
    return F.filter(parts, lambda p: p != "")
