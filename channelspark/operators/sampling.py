"""Stratified scene sampling, interleaving and link sampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from channelspark.operators.radiomap import any_valid
from channelspark.session import stored


def seeded_order(keys: Sequence[str], seed: int) -> Column:
    """Reproducible shuffle key of a row."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def largest_remainder_allocation(scenes: DataFrame, stratum: str, total: int) -> DataFrame:
    """Proportional quotas; leftovers go by fraction, then by name, both descending.

    The table holds one row per stratum, so its window is small. Asking for more than a stratum
    has is an error.
    """
    counts = scenes.groupBy(stratum).agg(F.count(F.lit(1)).alias("available"))
    everything = W.partitionBy(F.lit(0))
    exact = F.lit(total) * F.col("available") / F.sum("available").over(everything)
    shares = counts.withColumn("exact", exact).withColumn("base", F.floor("exact"))
    leftover = F.lit(total) - F.sum("base").over(everything)
    order = everything.orderBy((F.col("exact") - F.col("base")).desc(), F.col(stratum).desc())
    quota = F.col("base") + F.when(F.row_number().over(order) <= F.col("_left"), 1).otherwise(0)
    short = F.raise_error(F.concat(F.lit("allocation exceeds the scenes of "), F.col(stratum)))
    return shares.withColumn("_left", leftover).withColumn("quota", quota.cast("bigint")).select(
        stratum, "available",
        F.when(F.col("quota") > F.col("available"), short.cast("bigint"))
        .otherwise(F.col("quota")).alias("quota"),
    )


def ranked_within(
    rows: DataFrame, group: Sequence[str], ranges: dict[str, Column], order: Sequence[Column],
    limits: DataFrame,
) -> DataFrame:
    """The first ``quota`` rows (``limits``: group, quota) of each group with their rank from 1.

    ``ranges`` are leading parts of the order. Rows are counted per range; ranges beyond the quota are
    dropped by those counts, and only the rows of one range are ever sorted together.
    """
    keys = [*group, *ranges]
    ranged = rows.withColumns(ranges)
    before = W.partitionBy(*group).orderBy(*[F.col(c).asc_nulls_last() for c in ranges]).rowsBetween(
        W.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(limits.select(*group, "quota"), list(group)).where(F.col("_start") < F.col("quota"))
        .select(*keys, "_start", "quota")
    )
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return (
        ranged.join(starts, keys).withColumn("rank", (F.col("_start") + inside).cast("bigint"))
        .where(F.col("rank") <= F.col("quota")).drop(*ranges, "_start", "quota")
    )


def stratified_sample(
    rows: DataFrame, stratum: str, keys: Sequence[str], quotas: DataFrame, seed: int
) -> DataFrame:
    """Quota rows per stratum in seeded order, with their rank in the stratum.

    The seeded hash splits each stratum into 4096 even ranges.
    """
    order = seeded_order(keys, seed)
    return ranked_within(rows, [stratum], {"_range": F.substring(order, 1, 3)}, [order], quotas)


def interleave_positions(quotas: DataFrame, stratum: str) -> DataFrame:
    """Position of the j-th row of every stratum in the interleaved order.

    At each position the stratum furthest behind its share n*(i+1)/N is next; the larger name wins
    a tie. The rule is sequential, so it runs once over the quota list (one entry per stratum) and
    emits the positions in batches.
    """
    packed = quotas.where("quota > 0").agg(
        F.sort_array(F.collect_list(F.struct(F.col(stratum).alias("name"), "quota"))).alias("q")
    ).select(F.col("q.name").alias("names"), F.col("q.quota").alias("quotas"))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for names, counts in zip(batch["names"], batch["quotas"]):
                total = int(sum(counts))
                sent = [0] * len(names)
                out: list[tuple[str, int, int]] = []
                for position in range(total):
                    behind = [
                        (counts[c] * (position + 1) / total - sent[c], c)
                        for c in range(len(names)) if sent[c] < counts[c]
                    ]
                    chosen = max(behind)[1]
                    sent[chosen] += 1
                    out.append((names[chosen], sent[chosen], position))
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=["s", "rank", "position"])
                        out = []
                yield pd.DataFrame(out, columns=["s", "rank", "position"])

    placed = packed.mapInPandas(emit, "s string, rank bigint, position bigint")
    return placed.withColumnRenamed("s", stratum)


def interleave_strata(sample: DataFrame, quotas: DataFrame, stratum: str) -> DataFrame:
    """Attach the interleaved position to sampled rows ranked inside their stratum."""
    return sample.join(interleave_positions(quotas, stratum), [stratum, "rank"])


#: Candidates that one cell row holds on average at most, and cells per side of a scene.
CELL_ROWS, CELLS = 1024, 32


def _cells(candidates: DataFrame, scene: str, item: str) -> DataFrame:
    """Candidates packed by place: ``points`` with their squared distance ``d`` to the nearest chosen one so far."""
    box = candidates.groupBy(scene).agg(
        F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_side"),
        F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("_n"))
    at = [F.coalesce(F.floor(F.try_divide(F.col(a) - F.col(f"_{a}0"), F.col("_side")) * CELLS), F.lit(0)) for a in "xy"]
    deal = F.pmod(F.xxhash64(item), F.greatest(F.ceil(F.col("_n") / CELL_ROWS), F.lit(1)))  # crowded cells hold several rows
    placed = candidates.select(scene, item, "x", "y").join(box, scene).withColumns({"_i": at[0], "_j": at[1]})
    sizes = placed.groupBy(scene, "_i", "_j").agg(F.count(F.lit(1)).alias("_in"))
    placed = placed.drop("_n").join(sizes.withColumnRenamed("_in", "_n"), [scene, "_i", "_j"])
    point = F.struct(F.col(item).alias("item"), "x", "y", _squared(F.col("x"), F.col("y"), F.col("cx"), F.col("cy")).alias("d"))
    return placed.groupBy(scene, "_i", "_j", deal.alias("_deal")).agg(
        F.collect_list(point).alias("points"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
    ).drop("_i", "_j", "_deal").withColumn("top", _top())


def _squared(ax, ay, bx, by) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def _top() -> Column:
    """A cell's farthest candidate, the lowest item of equally far ones; chosen ones have a negative distance."""
    return F.array_max(F.transform("points", lambda p: F.struct(
        p["d"].alias("d"), (-p["item"]).alias("neg"), p["item"].alias("item"), p["x"].alias("x"), p["y"].alias("y"))))


def _after(cells: DataFrame, chosen: DataFrame, scene: str, first: bool) -> DataFrame:
    """Cells after one more choice. A cell whose box is no nearer to it than its farthest candidate's distance stays as it is."""
    met = cells.join(chosen.select(scene, F.col("best").alias("c")), scene)
    gap = [F.greatest(F.col(f"{a}0") - F.col(f"c.{a}"), F.col(f"c.{a}") - F.col(f"{a}1"), F.lit(0.0)) for a in "xy"]
    reached = F.lit(True) if first else gap[0] * gap[0] + gap[1] * gap[1] <= F.col("top.d")

    def nearer(p: Column) -> Column:
        d = _squared(p["x"], p["y"], F.col("c.x"), F.col("c.y"))
        known = d if first else F.least(p["d"], d)
        return p.withField("d", F.when(p["item"] == F.col("c.item"), F.lit(-1.0)).otherwise(known))

    changed = met.withColumn("_reached", reached)
    changed = changed.withColumn("points", F.when(F.col("_reached"), F.transform("points", nearer)).otherwise(F.col("points")))
    return changed.withColumn("top", F.when(F.col("_reached"), _top()).otherwise(F.col("top"))).drop("c", "_reached")


def farthest_point_sample(
    candidates: DataFrame, scene: str, item: str, count: int
) -> DataFrame:
    """Spread ``count`` items per scene: farthest from the centroid, then farthest from all chosen; the lowest item wins a tie.

    Candidates are packed into cells once. Every candidate keeps its distance to the nearest chosen item, so a round
    computes one distance for each, and none in cells that the new choice cannot change (their box is farther away than
    any of their distances). A round is one aggregate over the cells' farthest candidates and one rewrite of the cells.
    """
    cells = stored(_cells(candidates, scene, item), "spread-cells")
    picks: list[DataFrame] = []
    for pick in range(count):
        best = cells.where("top.d >= 0").groupBy(scene).agg(F.max("top").alias("best"))
        best = stored(best, "spread-pick")
        picks.append(best.select(scene, F.lit(pick).alias("pick"), F.col("best.item").alias(item)))
        if pick + 1 < count:
            cells = stored(_after(cells, best, scene, pick == 0), "spread-cells")
    result = picks[0]
    for more in picks[1:]:
        result = result.unionByName(more)
    return result


def sample_links(
    users: DataFrame, rss: DataFrame, scene: str, count: int, policy: str, seed: int
) -> DataFrame:
    """``count`` users per scene under a policy, back-filled from the remaining users.

    ``users`` has scene, ue, x, y. Policies: first, random, valid_links_first,
    spatially_spread_valid_links.
    """
    shuffled = seeded_order(["ue"], seed)
    ranges = {"_range": F.substring(shuffled, 1, 3)}
    order, rows = [shuffled], users
    if policy == "first":
        ranges, order = {"_range": F.floor(F.col("ue") / (1 << 20))}, [F.col("ue")]
    elif policy in ("valid_links_first", "spatially_spread_valid_links"):
        rows = users.join(any_valid(rss), "ue", "left").withColumn(
            "any_valid", F.coalesce("any_valid", F.lit(False))
        )
        first = (~F.col("any_valid")).cast("int")
        if policy == "spatially_spread_valid_links":
            spread = farthest_point_sample(rows.where("any_valid"), scene, "ue", count)
            rows = rows.join(spread, [scene, "ue"], "left")
            first = F.coalesce("pick", F.lit(count))
        ranges = {"_first": first, **ranges}
    elif policy != "random":
        raise ValueError(f"unknown sampling policy {policy}")
    limits = users.select(scene).distinct().withColumn("quota", F.lit(count))
    return ranked_within(rows, [scene], ranges, order, limits).select(scene, "ue", F.col("rank").cast("int").alias("rank"))


def slice_index(entries: DataFrame, start: int, limit: int | None) -> DataFrame:
    """Entries from ``start`` on in index order, at most ``limit`` of them."""
    chosen = entries.where(F.col("index") >= start).orderBy("index")
    return chosen if limit is None else chosen.limit(limit)
