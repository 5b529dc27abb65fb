"""Link construction and link-level joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelspark.functions import geometry as G
from channelspark.operators.skew import salted_join, with_rank

LINK = ["tx", "rx"]


def build_links(points: DataFrame, direction: str = "uplink") -> DataFrame:
    """One row per (transmitter, receiver) of a scene, with a flat row-major index.

    The row set is the operator's result, n_tx * n_rx per scene; scenes meet on an equi-join
    salted over the users, so a scene with most of the users is still spread.
    """
    ranked = with_rank(points, ["scene_id", "role"], "idx", "local")
    tx_role, rx_role = link_roles(direction)

    def side(role: str, prefix: str) -> DataFrame:
        return ranked.where(F.col("role") == role).select(
            "scene_id", F.col("idx").alias(prefix), F.col("local").alias(f"{prefix}_local"),
            *[F.col(c).alias(f"{prefix}_{c}") for c in "xyz"],
        )

    rx = side(rx_role, "rx")
    sizes = rx.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_rx"))
    rx = rx.join(sizes, "scene_id")
    tx = side(tx_role, "tx")
    many, few = (tx, rx) if tx_role == "ue" else (rx, tx)
    links = salted_join(many, few, ["scene_id"], "tx" if tx_role == "ue" else "rx")
    return links.withColumn(
        "link_index", F.col("tx_local") * F.col("n_rx") + F.col("rx_local")
    ).drop("n_rx")


def link_roles(direction: str) -> tuple[str, str]:
    """(transmitting role, receiving role)."""
    if direction not in ("uplink", "downlink"):
        raise ValueError("direction must be uplink or downlink")
    return ("ue", "bs") if direction == "uplink" else ("bs", "ue")


def resolve_roles(df: DataFrame, direction: str, inverse: bool = False) -> DataFrame:
    """Rename bs/ue columns to tx/rx for a direction, or back with ``inverse``."""
    tx_role, rx_role = link_roles(direction)
    names = {tx_role: "tx", rx_role: "rx"}
    if inverse:
        names = {v: k for k, v in names.items()}
    return df.withColumnsRenamed(names)


def link_geometry(links: DataFrame) -> DataFrame:
    """3-D and plan distance, midpoint and bearing from transmitter to receiver."""
    c = {n: F.col(n) for n in ("tx_x", "tx_y", "tx_z", "rx_x", "rx_y", "rx_z")}
    return links.withColumns({
        "distance_m": G.distance_3d(c["tx_x"], c["tx_y"], c["tx_z"],
                                    c["rx_x"], c["rx_y"], c["rx_z"]),
        "distance_2d_m": G.distance_2d(c["tx_x"], c["tx_y"], c["rx_x"], c["rx_y"]),
        "x_mid_m": (c["tx_x"] + c["rx_x"]) / 2,
        "y_mid_m": (c["tx_y"] + c["rx_y"]) / 2,
        "bearing_rad": G.bearing(c["tx_x"], c["tx_y"], c["rx_x"], c["rx_y"]),
    })


def apply_reciprocity(channel: DataFrame) -> DataFrame:
    """Swap the two ends of a channel table by renaming, without moving data."""
    swap = {"tx": "rx", "rx": "tx", "rx_ant": "tx_ant", "tx_ant": "rx_ant"}
    return channel.select(*[F.col(c).alias(swap.get(c, c)) for c in channel.columns])


def attach_global_indices(local_rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Local user position in a shard to its global index; unknown positions give NULL.

    ``shards`` holds one row per shard with ``ue_indices``; positions become rows so that the
    join is on (shard_index, ue_local).
    """
    lookup = shards.select(
        "shard_index", F.posexplode("ue_indices").alias("ue_local", "global_ue")
    )
    return local_rows.join(lookup, ["shard_index", "ue_local"], "left")


def link_valid_mask(derived: Column, observed: Column) -> Column:
    """Both masks, each true where absent."""
    return F.coalesce(derived, F.lit(True)) & F.coalesce(observed, F.lit(True))


def match_by_position(
    left: DataFrame, right: DataFrame, scope: Sequence[str] = (), decimals: int = 3
) -> DataFrame:
    """Pair rows of two runs by rounded position; of equal right positions the first idx wins."""
    keys = [*scope, "kx", "ky", "kz"]

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {f"k{c}": G.position_key(F.col(c), decimals) for c in "xyz"}
        )

    first = keyed(right).groupBy(*keys).agg(F.min("idx").alias("right_idx"))
    return keyed(left).join(first, keys).withColumnRenamed("idx", "left_idx")


def position_tolerance(
    left: DataFrame, right: DataFrame, keys: Sequence[str], atol: float
) -> DataFrame:
    """Largest coordinate difference over paired rows and whether it stays within ``atol``."""
    joined = left.alias("l").join(right.alias("r"), list(keys))
    delta = F.greatest(*[F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")) for c in "xyz"])
    return joined.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.max(delta).alias("max_delta_m"),
        F.count_if(delta > atol).alias("violations"),
    )


def align_stations(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: number of stations on each side, shared ones, and whether the sets are equal."""
    tagged = left.select(*keys, "bs", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, "bs", F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_station = tagged.groupBy(*keys, "bs").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per_station.groupBy(*keys).agg(
        F.sum("l").alias("n_left"), F.sum("r").alias("n_right"),
        F.sum(F.col("l") * F.col("r")).alias("n_common"),
        F.bool_and(F.col("l") == F.col("r")).alias("same_set"),
    )


def common_links(rows: DataFrame, link: Sequence[str], variant: str = "variant") -> DataFrame:
    """Links that occur in every variant."""
    pairs = rows.select(*link, variant).distinct()
    total = rows.select(F.count_distinct(variant)).scalar()
    return (
        pairs.groupBy(*link).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == total)
        .drop("_n")
    )


def pairwise_variants(
    rows: DataFrame, sample: Sequence[str], values: Sequence[str], variant: str = "variant"
) -> DataFrame:
    """All ordered pairs of different variants of the same sample.

    The pairs are the result: n*(n-1) per sample for the n variants under comparison.
    """
    left = rows.select(*sample, F.col(variant).alias("reference"),
                       *[F.col(v).alias(f"ref_{v}") for v in values])
    right = rows.select(*sample, F.col(variant).alias("candidate"),
                        *[F.col(v).alias(f"cand_{v}") for v in values])
    return left.join(right, list(sample)).where(F.col("reference") != F.col("candidate"))


def missing_indices(requested: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requested rows that do not exist."""
    return requested.join(existing, list(keys), "left_anti")


def duplicate_indices(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
