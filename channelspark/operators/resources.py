"""Sounding resources, multi-user frames and estimates on resource elements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelspark.functions import complex as C
from channelspark.functions import grid
from channelspark.operators.skew import with_rank


def srs_re_grid(config: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Resource elements of every (keys, symbol) allocation.

    ``config`` has symbol, start_prb, prb_count, comb_size, comb_offset, total.
    """
    subcarriers = grid.resource_subcarriers(
        F.col("start_prb"), F.col("prb_count"), F.col("comb_size"), F.col("comb_offset"),
        F.col("total"),
    )
    return config.select(*keys, "symbol", F.explode(subcarriers).alias("k"))


def frame_slots(users: DataFrame, active: int, group: Sequence[str] = ()) -> DataFrame:
    """Users in index order, ``active`` per frame; missing slots of the last frame get tx -1."""
    ranked = with_rank(users.select(*group, "tx"), group, "tx", "_rank")
    placed = ranked.select(
        *group, F.floor(F.col("_rank") / active).alias("frame"),
        (F.col("_rank") % active).alias("slot"), "tx",
    )
    partial = placed.groupBy(*group, "frame").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") < active
    )
    missing = partial.select(
        *group, "frame", F.explode(F.sequence(F.col("n"), F.lit(active - 1).cast("bigint")))
        .alias("slot"), F.lit(-1).cast("bigint").alias("tx"),
    )
    return placed.unionByName(missing)


def frame_positions(slots: DataFrame, points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Position of the transmitter in every slot; inactive slots keep NULLs."""
    where = points.select(*keys, F.col("idx").alias("tx"), "x", "y", "z")
    return slots.join(where, [*keys, "tx"], "left")


def resource_occupancy(elements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Users per (frame, symbol, subcarrier) and whether they collide."""
    return elements.groupBy(*keys, "frame", "symbol", "k").agg(
        F.count(F.lit(1)).alias("users")
    ).withColumn("collision", F.col("users") > 1)


def resource_truth(cfr: DataFrame, link: Sequence[str], ports: Column) -> DataFrame:
    """Truth at every (port, symbol, subcarrier) through the port -> antenna map; -1 gives 0.

    ``ports`` is an array of structs (port, symbol, tx_ant, start_prb, prb_count, comb_size,
    comb_offset): at most ports * symbols entries. Each channel row emits the elements its antenna
    serves, so the resource grid is never joined.
    """
    def elements(rows: DataFrame, chosen: Column, *kept: str) -> DataFrame:
        port = rows.select(*link, *kept, F.explode(chosen).alias("p"))
        subcarriers = grid.resource_subcarriers(
            F.col("p.start_prb"), F.col("p.prb_count"), F.col("p.comb_size"),
            F.col("p.comb_offset"), F.col("p.total"),
        )
        return port.select(*link, *kept, "p.port", "p.symbol", F.explode(subcarriers).alias("k"))

    served = elements(
        cfr, F.filter(ports, lambda p: p["tx_ant"] == F.col("tx_ant")), "h"
    )
    sample = F.get("h", F.col("k"))
    served = served.select(*link, "port", "symbol", "k", sample["re"].alias("re"),
                           sample["im"].alias("im"))
    silent = elements(cfr.select(*link).distinct(), F.filter(ports, lambda p: p["tx_ant"] < 0))
    return served.unionByName(silent.withColumns({"re": F.lit(0.0), "im": F.lit(0.0)}))


def resource_ls_estimate(received: DataFrame, pilots: DataFrame, link: Sequence[str]) -> DataFrame:
    """h = sum(y * conj(p)) / sum(|p|^2) per link, port and subcarrier.

    ``received`` has symbol, k, re, im; ``pilots`` has port, symbol, k, p_re, p_im.
    """
    joined = received.join(pilots, ["symbol", "k"])
    re, im = C.conj_product(F.col("re"), F.col("im"), F.col("p_re"), F.col("p_im"))
    power = F.greatest(F.sum(C.abs2(F.col("p_re"), F.col("p_im"))), F.lit(1e-30))
    return joined.groupBy(*link, "port", "k").agg(
        (F.sum(re) / power).alias("re"), (F.sum(im) / power).alias("im")
    )


def multiuser_error_table(
    slots: DataFrame, elements: DataFrame, allocated: DataFrame, samples: DataFrame
) -> DataFrame:
    """Per (frame, slot, rx): element and collision counts, NMSE on elements and on the band.

    ``elements``: frame, slot, tx, symbol, k. ``allocated``: frame, slot, tx, k.
    ``samples``: tx, rx, k and l_* (truth), r_* (estimate).
    """
    slot = ["frame", "slot"]
    active = slots.where("tx >= 0")
    counts = (
        elements.groupBy(*slot).agg(F.count(F.lit(1)).alias("resource_re"))
        .join(allocated.groupBy(*slot).agg(F.count(F.lit(1)).alias("allocated_subcarriers")),
              slot, "full_outer")
    )
    collisions = resource_occupancy(elements, []).groupBy("frame").agg(
        F.count_if("collision").alias("frame_collision_count")
    )
    error = C.abs2(F.col("r_re") - F.col("l_re"), F.col("r_im") - F.col("l_im"))
    signal = C.abs2(F.col("l_re"), F.col("l_im"))
    per_sc = samples.groupBy("tx", "rx", "k").agg(
        F.sum(error).alias("e"), F.sum(signal).alias("s")
    )

    def nmse(where: DataFrame, name: str) -> DataFrame:
        ratio = F.sum("e") / F.sum("s")
        value = F.when(F.sum("s") > 0, 10 * F.log10(F.greatest(ratio, F.lit(1e-30))))
        return where.join(per_sc, ["tx", "k"]).groupBy(*slot, "rx").agg(value.alias(name))

    table = nmse(elements, "resource_nmse_db").join(
        nmse(allocated, "allocated_nmse_db"), [*slot, "rx"], "full_outer"
    )
    return (
        active.join(table, slot).join(counts, slot, "left").join(collisions, "frame", "left")
    )
