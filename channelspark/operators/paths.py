"""Operators over propagation-path tables (one row per valid path)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from channelspark.functions import complex as C
from channelspark.functions import paths as P
from channelspark.functions import power as PW
from channelspark.session import stored

PAIR = ["tx", "rx", "rx_ant", "tx_ant"]


def angle_source(reciprocity_applied: bool, direction: str) -> str:
    """Receiver-side labels use departure angles when an uplink was built by reciprocity."""
    return "aod" if reciprocity_applied and direction.lower() == "uplink" else "aoa"


def receiver_angles(source: str) -> tuple[Column, Column]:
    """(azimuth, zenith) columns of the chosen side."""
    side = "t" if source == "aod" else "r"
    return F.col(f"phi_{side}"), F.col(f"theta_{side}")


def link_path_labels(paths: DataFrame, source: str = "aoa") -> DataFrame:
    """First, strongest and line-of-sight path per link over all antenna pairs.

    One map-side combined aggregate; ties take the lowest (rx_ant, tx_ant, path).
    """
    azimuth, zenith = receiver_angles(source)
    value = [F.col("tau_s"), azimuth.alias("az"), zenith.alias("ze")]
    place = [F.col(c) for c in ("rx_ant", "tx_ant", "path")]
    power = -C.abs2(F.col("a_re"), F.col("a_im"))
    by_delay = F.struct(F.col("tau_s").alias("key"), *place, *value)
    by_power = F.struct(power.alias("key"), *place, *value)
    picks = paths.groupBy("tx", "rx").agg(
        F.min(by_delay).alias("first"),
        F.min(by_power).alias("strongest"),
        F.min(F.when(P.is_los(F.col("interactions")), by_delay)).alias("los"),
    )
    return picks.select(
        "tx", "rx",
        F.col("first.tau_s").alias("first_delay_s"),
        F.col("first.az").alias("first_azimuth_rad"),
        F.col("first.ze").alias("first_zenith_rad"),
        F.col("strongest.tau_s").alias("strongest_delay_s"),
        F.col("strongest.az").alias("strongest_azimuth_rad"),
        F.col("strongest.ze").alias("strongest_zenith_rad"),
        (F.col("los.tau_s") * PW.SPEED_OF_LIGHT_MPS).alias("los_distance_m"),
        F.col("los.az").alias("los_azimuth_rad"),
        F.col("los.ze").alias("los_zenith_rad"),
    )


def delay_labels_from_cir(cir: DataFrame) -> DataFrame:
    """First and strongest delay from snapshot 0; a path counts if valid in any snapshot."""
    p2 = C.abs2(F.col("a_re"), F.col("a_im"))
    at_zero = F.when(F.col("snapshot") == 0, F.struct("tau_s", p2.alias("p2")))
    taps = (
        cir.groupBy(*PAIR, "path")
        .agg(F.bool_or("valid").alias("valid"), F.max(at_zero).alias("s"))
        .where(F.col("valid") & F.col("s").isNotNull())
    )
    order = [F.col(c) for c in ("rx_ant", "tx_ant", "path")]
    return taps.groupBy("tx", "rx").agg(
        F.min_by(F.col("s.tau_s"), F.struct(F.col("s.tau_s"), *order)).alias("first_delay_s"),
        F.min_by(F.col("s.tau_s"), F.struct((-F.col("s.p2")).alias("p"), *order))
        .alias("strongest_delay_s"),
    )


def link_summary(paths: DataFrame, n_rx_ant: int, n_tx_ant: int) -> DataFrame:
    """Distinct paths, path kinds and power averaged over all antenna pairs, empty ones too."""
    los = P.is_los(F.col("interactions"))
    power = F.sum(C.abs2(F.col("a_re"), F.col("a_im"))) / (n_rx_ant * n_tx_ant)
    return paths.groupBy("tx", "rx").agg(
        F.count_distinct("path").alias("path_count"),
        F.bool_or(los).alias("los_exists"),
        F.bool_or(~los).alias("nlos_exists"),
        PW.db(power).alias("power_db"),
    )


def serving_rx(links: DataFrame, policy: str = "strongest_path") -> DataFrame:
    """Serving receiver per transmitter with its path power; the lowest rx wins a tie.

    Powers are compared at 1e-9 dB: sums that differ only by the order of addition are ties, so a
    retried task cannot change the choice.
    """
    if policy not in ("strongest_path", "first_rx"):
        raise ValueError("policy must be strongest_path or first_rx")
    strongest = policy == "strongest_path"
    level = F.round("power_db", 9)
    order = F.struct((-level).alias("p"), F.col("rx")) if strongest else F.col("rx")
    pick = F.min_by(F.struct("rx", "power_db"), order)
    return links.groupBy("tx").agg(pick.alias("s")).select(
        "tx", F.col("s.rx").alias("serving_rx"), F.col("s.power_db").alias("serving_power_db")
    )


def uplink_power_control(
    links: DataFrame,
    *,
    fixed_tx_power_dbm: float = 23.0,
    enabled: bool = True,
    open_loop: bool = True,
    closed_loop: bool = False,
    p0_dbm: float = 0.0,
    alpha: float = 0.8,
    tpc_offset_db: float = 0.0,
    accumulation_db: float = 0.0,
    min_dbm: float = -40.0,
    max_dbm: float = 23.0,
    reference_dbm: float = 0.0,
    policy: str = "strongest_path",
) -> DataFrame:
    """Requested, clipped and amplitude-scaled transmit power per transmitter."""
    served = serving_rx(links, policy)
    loss = -F.col("serving_power_db")
    if not enabled:
        requested = clipped = F.lit(fixed_tx_power_dbm)
        loss = F.lit(0.0)
    else:
        requested = p0_dbm + alpha * loss if open_loop else F.lit(fixed_tx_power_dbm)
        if closed_loop:
            requested = requested + (tpc_offset_db + accumulation_db)
        clipped = F.least(F.greatest(requested, F.lit(min_dbm)), F.lit(max_dbm))
    return served.select(
        "tx", "serving_rx", loss.alias("path_loss_db"), clipped.alias("tx_power_dbm"),
        (clipped != requested).alias("clipped"),
        PW.amplitude_scale_from_dbm(clipped, reference_dbm).alias("amplitude_scale"),
    )


def nlos_paths(paths: DataFrame) -> DataFrame:
    """Valid paths that are not line of sight, with power in dB."""
    return (
        paths.where(~P.is_los(F.col("interactions")))
        .withColumn("power_db", PW.db(C.abs2(F.col("a_re"), F.col("a_im"))))
    )


def first_paths(paths: DataFrame, n: int) -> DataFrame:
    """First n paths of each antenna pair, at most 1000; the rank limit runs before the shuffle too."""
    if n > 1000:
        raise ValueError("n is a report size of at most 1000 paths")
    order = W.partitionBy(*PAIR).orderBy("path")
    return (
        paths.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n)
        .drop("_rank")
    )


def cir_to_cfr(paths: DataFrame, grid_hz: Column, part_paths: int = 65_536) -> DataFrame:
    """H(f) = sum of a*exp(-j*2*pi*f*tau) per antenna pair.

    ``grid_hz`` is an array expression such as :func:`functions.grid.frequency_grid`, so every
    path row carries its own grid and nothing is joined. A pair usually has far fewer paths than
    subcarriers, so the compact path rows are shuffled by pair once, unnested and summed where they are.
    Pairs of more than ``part_paths`` paths, counted first, are dealt to parts by a hash of the path,
    and their parts are added up.
    """
    parts = F.ceil(F.col("count") / part_paths).cast("int")
    counts = paths.groupBy(*PAIR).count().where(F.col("count") > part_paths)
    many = F.broadcast(stored(counts.select(*PAIR, parts.alias("_parts")), "large-pairs"))  # at most a row per part_paths rows
    part = F.pmod(F.xxhash64("path"), F.col("_parts")).cast("int")
    small = paths.join(many, PAIR, "left_anti")
    large = paths.join(many, PAIR).withColumn("_part", part)
    summed = _sum_paths(large, [*PAIR, "_part"], grid_hz).groupBy(*PAIR, "k").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return _sum_paths(small, PAIR, grid_hz).unionByName(summed)


def _sum_paths(paths: DataFrame, keys: Sequence[str], grid_hz: Column) -> DataFrame:
    phase = -2 * F.pi() * F.col("f_hz") * F.col("tau_s")
    re, im = C.rotate(F.col("a_re"), F.col("a_im"), phase)
    placed = paths.select(*keys, "a_re", "a_im", "tau_s").repartition(*keys)
    unnested = placed.select(*keys, "a_re", "a_im", "tau_s", F.posexplode(grid_hz).alias("k", "f_hz"))
    return unnested.groupBy(*keys, "k").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def path_scatter(paths: DataFrame, links: DataFrame) -> DataFrame:
    """Delay, Doppler and gain of the paths of chosen links."""
    chosen = paths.join(links.select("tx", "rx").distinct(), ["tx", "rx"], "left_semi")
    return chosen.select(
        *PAIR, "path", "tau_s", "doppler_hz",
        PW.path_gain_db(F.col("a_re"), F.col("a_im")).alias("gain_db"),
    )


def link_overview(summary: DataFrame, links: DataFrame) -> DataFrame:
    """Valid, line-of-sight, other-paths and path-count cells of every requested link.

    ``links`` lists tx and rx; a link without paths is invalid with count 0.
    """
    def there(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    count = F.coalesce("path_count", F.lit(0))
    return links.select("tx", "rx").distinct().join(summary, ["tx", "rx"], "left").select(
        "tx", "rx", (count > 0).alias("valid"), there("los_exists").alias("los"),
        there("nlos_exists").alias("nlos"), count.cast("bigint").alias("path_count"),
    )
