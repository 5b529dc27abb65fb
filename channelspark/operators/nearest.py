"""Exact nearest neighbours on a pyramid of tile counts.

A scene's square is halved again and again; the pyramid holds, per level, the number of samples of every tile that has
any. Levels go a little deeper than the average density asks for, and all the way down below tiles that stay crowded. Counts
alone then tell where a target's k nearest samples must lie: the finest level at which the 3 x 3 tiles around the
target hold k samples bounds their distance, and of the tiles within that bound only those are kept that the counts of
nearer tiles do not rule out. Crowded tiles that are left are replaced by their own parts until each holds few
samples, so a target far from a dense spot meets the edge of that spot only. Samples are read by the tiles that are left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from channelspark.functions import complex as C
from channelspark.session import stored

#: Halvings of a scene's side.
DEPTH = 32
#: Levels that a crowded tile is taken apart at once.
APART = 4
#: Levels beyond the one where tiles hold k samples on average.
BEYOND = 3
EXACT_HIT_M = 1e-9
#: Relative slack of comparisons between distances and tile borders.
SLACK = 1e-9
TILE = ["_level", "_tx", "_ty"]


def crowded(k: int) -> int:
    """Samples above which a tile is replaced by its parts."""
    return 16 * k + 64


def boxes(samples: DataFrame, scene: str, k: int) -> DataFrame:
    """Corner, side and the pyramid's usual depth of every scene."""
    side = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    depth = F.ceil(F.log2(F.count(F.lit(1)) / k) / 2) + BEYOND
    return samples.groupBy(scene).agg(
        F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.when(side > 0, side).otherwise(1.0).alias("_side"),
        F.least(F.greatest(depth, F.lit(0)), F.lit(DEPTH)).cast("int").alias("_top"),
    )


def _cell(axis: str) -> Column:
    """Tile index at the deepest level, inside the square."""
    at = F.floor((F.col(axis) - F.col(f"_{axis}0")) / F.col("_side") * (1 << DEPTH))
    return F.least(F.greatest(at, F.lit(0)), F.lit((1 << DEPTH) - 1)).cast("bigint")


def _tile(level: str) -> list[Column]:
    return [F.expr(f"shiftright({c}, {DEPTH} - {level})").alias(name) for c, name in (("_ix", "_tx"), ("_iy", "_ty"))]


def pyramid(located: DataFrame, scene: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Samples per tile (``scene, _level, _tx, _ty, _n``), and the crowded tiles of the usual depth.

    Levels below ``_top`` are there for crowded tiles and three tiles around them.
    """
    top = located.withColumn("_level", F.col("_top")).select(scene, "_level", *_tile("_top"), "_ix", "_iy")
    many = stored(
        top.groupBy(scene, *TILE).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > crowded(k)) & (F.col("_level") < DEPTH)).drop("_n"),
        "nearest-crowded")
    tiles = located.select(scene, F.explode(F.sequence(F.lit(0), F.col("_top"))).alias("_level"), "_ix", "_iy")
    if not many.isEmpty():
        tiles = tiles.unionByName(top.join(_dilated(many, scene, 3), [scene, *TILE], "left_semi").select(
            scene, F.explode(F.sequence(F.col("_level") + 1, F.lit(DEPTH))).alias("_level"), "_ix", "_iy"))
    return tiles.select(scene, "_level", *_tile("_level")).groupBy(scene, *TILE).agg(F.count(F.lit(1)).alias("_n")), many


def _dilated(tiles: DataFrame, scene: str, by: int) -> DataFrame:
    """All tiles up to ``by`` steps away from the given ones."""
    step = F.explode(F.sequence(F.lit(-by), F.lit(by)))
    around = tiles.select("*", step.alias("_dx")).select("*", step.alias("_dy"))
    return around.select(scene, "_level", (F.col("_tx") + F.col("_dx")).alias("_tx"), (F.col("_ty") + F.col("_dy")).alias("_ty")).distinct()


def _with_level(targets: DataFrame, tiles: DataFrame, many: DataFrame, scene: str, k: int) -> DataFrame:
    """The finest level (``_level``) whose 3 x 3 tiles around the target hold k samples; 0 always counts.

    Blocks of finer levels lie inside those of coarser ones, so every fourth level is looked up first, then three more.
    Levels below the usual depth count next to crowded tiles, where all samples within reach are on them.
    """
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    around = tiles.where("_level > 0").select("*", step.alias("_dx")).select("*", step.alias("_dy"))
    blocks = around.groupBy(
        scene, "_level", (F.col("_tx") + F.col("_dx")).alias("_tx"), (F.col("_ty") + F.col("_dy")).alias("_ty")
    ).agg(F.sum("_n").alias("_held")).where(F.col("_held") >= k)
    near = _dilated(many, scene, 1).select(scene, F.col("_level").alias("_over"), F.col("_tx").alias("_ux"), F.col("_ty").alias("_uy"))
    depth = targets.select(scene, F.col("_top").alias("_over")).distinct()
    blocks = blocks.join(depth, scene)
    lift = "shiftright({}, _level - _over)"
    deep = blocks.where("_level > _over").withColumns({"_ux": F.expr(lift.format("_tx")), "_uy": F.expr(lift.format("_ty"))})
    blocks = stored(blocks.where("_level <= _over").drop("_over").unionByName(
        deep.join(near, [scene, "_over", "_ux", "_uy"], "left_semi").drop("_over", "_ux", "_uy")), "nearest-blocks")
    for levels in (F.sequence(F.lit(0), F.lit(DEPTH), F.lit(4)), F.sequence(F.col("_found"), F.least(F.col("_found") + 3, F.lit(DEPTH)))):
        own = [c for c in targets.columns if c != "_found"]
        tried = targets.select(*own, F.explode(levels).alias("_level")).where("_level <= _cap")
        tried = tried.select(*own, "_level", *_tile("_level")).join(blocks, [scene, *TILE], "left")
        targets = tried.groupBy(*own).agg(
            F.max(F.when(F.col("_held").isNotNull() | (F.col("_level") == 0), F.col("_level"))).alias("_found"))
    return targets.withColumnRenamed("_found", "_level")


def _edges(axis: str) -> tuple[Column, Column]:
    width = F.col("_side") / F.pow(F.lit(2.0), F.col("_level"))
    low = F.col(f"_{axis}0") + F.col(f"_t{axis}") * width
    return low, low + width


def _distances() -> dict[str, Column]:
    """Least and greatest distance from the target to its tile."""
    near, far = [], []
    for axis in "xy":
        low, high = _edges(axis)
        at = F.col(axis)
        near.append(F.greatest(low - at, at - high, F.lit(0.0)))
        far.append(F.greatest(F.abs(at - low), F.abs(at - high)))
    slack = F.col("_side") * SLACK
    return {"_near": F.hypot(*near) * (1 - SLACK) - slack, "_far": F.hypot(*far) * (1 + SLACK) + slack}


def _needed(tiles: DataFrame, ids: Sequence[str], k: int) -> DataFrame:
    """Tiles that may hold one of the k nearest: not farther than tiles that hold k samples reach."""
    whole = W.partitionBy(*ids)
    upto = whole.orderBy("_far", *TILE).rowsBetween(W.unboundedPreceding, W.currentRow)
    held = tiles.withColumns(_distances()).withColumn("_upto", F.sum("_n").over(upto))
    bound = F.min(F.when(F.col("_upto") >= k, F.col("_far"))).over(whole)
    return held.withColumn("_bound", bound).where("_bound IS NULL OR _near <= _bound").drop("_upto", "_bound", "_near", "_far")


def candidate_tiles(targets: DataFrame, tiles: DataFrame, many: DataFrame, scene: str, ids: Sequence[str], k: int) -> DataFrame:
    """For every target the few tiles, of any level, that may hold its k nearest samples."""
    at = _with_level(targets, tiles, many, scene, k).select("*", *_tile("_level"))
    width = F.col("_side") / F.pow(F.lit(2.0), F.col("_level"))
    reach = [F.greatest(F.abs(F.col(a) - _edges(a)[0] + width), F.abs(F.col(a) - _edges(a)[1] - width)) for a in "xy"]
    at = at.withColumn("_reach", F.hypot(*reach) * (1 + SLACK))
    last = F.pow(F.lit(2.0), F.col("_level")) - 1

    def span(axis: str) -> Column:
        ends = [F.least(F.greatest(F.floor((F.col(axis) + sign * F.col("_reach") - F.col(f"_{axis}0")) / width), F.lit(0)), last).cast("bigint")
                for sign in (-1, 1)]
        return F.explode(F.sequence(*ends))

    asked = at.drop("_tx").withColumn("_tx", span("x")).drop("_ty").withColumn("_ty", span("y"))
    asked = asked.where(_distances()["_near"] <= F.col("_reach")).drop("_reach", "_cap", "_ix", "_iy", "_top")
    found = stored(_needed(asked.join(tiles, [scene, *TILE]), ids, k), "nearest-tiles")
    is_crowded = (F.col("_n") > crowded(k)) & (F.col("_level") + APART <= DEPTH)
    parts = tiles.select(scene, F.col("_level").alias("_into"), F.col("_tx").alias("_px"), F.col("_ty").alias("_py"), F.col("_n").alias("_pn"),
                         (F.col("_level") - APART).alias("_level"), *[F.shiftright(c, APART).alias(c) for c in ("_tx", "_ty")])
    renamed = {"_level": F.col("_into"), "_tx": F.col("_px"), "_ty": F.col("_py"), "_n": F.col("_pn")}
    while not (many := found.where(is_crowded)).isEmpty():
        smaller = many.join(parts, [scene, *TILE]).withColumns(renamed).select(*found.columns)
        found = stored(_needed(found.where(~is_crowded).unionByName(smaller), ids, k), "nearest-tiles")
    return found


def nearest(targets: DataFrame, samples: DataFrame, *, scene: str, target: Sequence[str], k: int) -> DataFrame:
    """The k nearest samples (``id, value, d, rank``) of every target of the same scene; the lowest id wins a tie.

    ``samples`` has scene, id, x, y and value; samples without a finite position or value do not count. Of samples at one
    position only the k lowest ids can matter. Targets of scenes without samples are left out.
    """
    finite = C.is_finite(F.col("value")) & C.is_finite(F.col("x")) & C.is_finite(F.col("y"))
    same_spot = W.partitionBy(scene, "x", "y").orderBy("id")
    kept = stored(
        samples.where(finite).select(scene, "id", "x", "y", "value")
        .withColumn("_n", F.row_number().over(same_spot)).where(F.col("_n") <= k).drop("_n"), "nearest-samples")
    box = boxes(kept, scene, k)
    located = kept.join(box, scene).withColumns({"_ix": _cell("x"), "_iy": _cell("y")})
    tiles, many = pyramid(located, scene, k)
    tiles = stored(tiles, "nearest-pyramid")
    ids = [scene, *target]
    outside = F.hypot(*[F.greatest(F.col(f"_{a}0") - F.col(a), F.col(a) - F.col(f"_{a}0") - F.col("_side"), F.lit(0.0)) for a in "xy"])
    deepest = F.col("_top") if many.isEmpty() else F.lit(DEPTH)
    cap = F.when(outside > 0, F.least(F.greatest(F.floor(F.log2(F.col("_side") / outside)), F.lit(0)), deepest)).otherwise(deepest)
    placed = targets.select(*ids, "x", "y").join(box, scene).withColumns({"_ix": _cell("x"), "_iy": _cell("y"), "_cap": cap.cast("int")})
    asked = candidate_tiles(placed, tiles, many, scene, ids, k)
    levels = asked.select(scene, "_level").distinct()
    keyed = located.join(levels, scene).select(
        scene, "_level", *_tile("_level"), "id", "value", F.col("x").alias("_sx"), F.col("y").alias("_sy"))
    dx, dy = F.col("_sx") - F.col("x"), F.col("_sy") - F.col("y")
    pairs = asked.join(keyed, [scene, *TILE]).select(*ids, "x", "y", "id", "value", F.sqrt(dx * dx + dy * dy).alias("d"))
    order = W.partitionBy(*ids).orderBy("d", "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_idw(targets: DataFrame, samples: DataFrame, *, scene: str, target: Sequence[str], k: int, power: float) -> DataFrame:
    """Inverse-distance mean of the k nearest samples of the same scene, exact; an exact hit returns its sample."""
    weight = 1 / F.pow(F.greatest(F.col("d"), F.lit(EXACT_HIT_M)), F.lit(power))
    found = nearest(targets, samples, scene=scene, target=target, k=k).groupBy(scene, *target, "x", "y").agg(
        F.min("d").alias("_near"), F.min_by("value", "rank").alias("_hit"),
        (F.sum(weight * F.col("value")) / F.sum(weight)).alias("_mean"),
    )
    return found.select(scene, *target, "x", "y", F.when(F.col("_near") <= EXACT_HIT_M, F.col("_hit")).otherwise(F.col("_mean")).alias("value"))
