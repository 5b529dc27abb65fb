"""Expressions over one propagation path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Interaction code -> path type.
INTERACTION_TYPES = {1: "reflection", 2: "diffuse", 4: "refraction", 8: "diffraction"}


def path_depth(interactions: Column) -> Column:
    return F.size(F.filter(interactions, lambda code: code != 0))


def is_los(interactions: Column) -> Column:
    """No interaction at all; cheaper than comparing :func:`path_type`."""
    return ~F.exists(interactions, lambda code: code != 0)


def path_type(interactions: Column) -> Column:
    """los without interactions, mixed for several kinds, else the one kind's name."""
    kinds = F.array_distinct(F.filter(interactions, lambda code: code != 0))
    only = F.get(kinds, F.lit(0))
    named = F.when(F.size(kinds) == 0, "los").when(F.size(kinds) > 1, "mixed")
    for code, name in INTERACTION_TYPES.items():
        named = named.when(only == code, name)
    return named.otherwise("unknown")


def path_polyline(tx: Column, vertices: Column, rx: Column, depth: Column) -> Column:
    """Transmitter, the first ``depth`` vertices, receiver."""
    return F.concat(F.array(tx), F.slice(vertices, F.lit(1), depth), F.array(rx))
