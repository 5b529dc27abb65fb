"""Shard assignment, shard tables, batching and coverage."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from channelspark.operators.skew import with_rank
from channelspark.session import stored

#: Ranks whose jumps are followed in one task.
BLOCK = 1 << 16


def assign_by_index(users: DataFrame, size: int) -> DataFrame:
    """Contiguous shards when user indices already run 0..n-1: plain arithmetic, no shuffle."""
    return users.withColumn("shard_index", F.floor(F.col("ue") / F.lit(size)))


def assign_by_rank(users: DataFrame, size: int, group: Sequence[str] = ()) -> DataFrame:
    """Contiguous shards of ``size`` users in index order when indices have gaps."""
    return with_rank(users, group, "ue", "ue_rank").withColumn(
        "shard_index", F.floor(F.col("ue_rank") / F.lit(size))
    )


def shard_table(assigned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per shard with its ordered user list (at most the shard size long)."""
    return assigned.groupBy(*keys, "shard_index").agg(
        F.sort_array(F.collect_list("ue")).alias("ue_indices"),
        F.count(F.lit(1)).alias("ue_count"),
        F.min("ue").alias("first_ue"),
    )


def with_offsets(shards: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append offset of each shard: users in the shards before it (one row per shard file)."""
    before = W.partitionBy(*keys).orderBy("shard_index").rowsBetween(W.unboundedPreceding, -1)
    return shards.withColumn("offset", F.coalesce(F.sum("ue_count").over(before), F.lit(0)))


def contiguity_violations(fragments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fragments that do not start where the previous index ended (the first one at 0).

    Neighbours meet in an equi-join on the index, so a run with very many fragments stays spread.
    """
    previous = fragments.select(
        *keys, (F.col("shard_index") + 1).alias("shard_index"),
        (F.col("offset") + F.col("ue_count")).alias("expected"),
    )
    joined = fragments.join(previous, [*keys, "shard_index"], "left").withColumn(
        "expected", F.coalesce("expected", F.when(F.col("shard_index") == 0, F.lit(0)))
    )
    bad = F.col("expected").isNull() | (F.col("offset") != F.col("expected"))
    return joined.where(bad).select(*keys, "shard_index", "offset", "expected")


def coverage_gaps(expected: DataFrame, observed: DataFrame, keys: Sequence[str],
                  chunk: int = 65_536) -> DataFrame:
    """Expected users (per key ``first`` .. ``last``) that were never observed.

    A range is unnested in two steps with a shuffle of its chunks in between, so even one key
    with most of the users is produced by many tasks.
    """
    chunks = expected.select(
        *keys, F.explode(F.sequence(F.col("first"), F.col("last"), F.lit(chunk).cast("bigint")))
        .alias("_from"), "last",
    ).repartition(*keys, "_from")
    upto = F.least(F.col("_from") + (chunk - 1), F.col("last"))
    wanted = chunks.select(*keys, F.explode(F.sequence(F.col("_from"), upto)).alias("ue"))
    return wanted.join(observed, [*keys, "ue"], "left_anti")


def training_batches(fragments: DataFrame, run: str, max_fragments: int | None, max_ue: int | None,
                     block_ranks: int = BLOCK) -> DataFrame:
    """Greedy consecutive batches; a new one starts when either cap would be exceeded.

    With the fragment cap alone this is arithmetic on the fragment rank. With a user cap, each fragment gets the one that
    would start the next batch after it. Those jumps are followed to the end of each block of ranks, all blocks
    at once; only the few places where blocks can be entered are then chained from the start of the run, and each
    block numbers its own batches from its true entry.
    """
    if max_fragments is not None and max_fragments < 1:
        max_fragments = None
    if max_ue is not None and max_ue < 1:
        max_ue = None
    if max_ue is None:
        ranked = with_rank(fragments, [run], "fragment", "_rank")
        size = F.lit(max_fragments or 2**62)
        return ranked.withColumn("batch", F.floor(F.col("_rank") / size)).drop("_rank")
    kind = fragments.schema[run].dataType.simpleString()
    block = F.floor(F.col("at") / block_ranks).alias("block")
    jumps = _next_starts(fragments.select(run, "fragment", "ue_count"), run, max_fragments, max_ue)
    paths = stored(jumps.select(F.col(run).alias("run"), "at", "next", block).groupBy("run", "block").applyInPandas(
        _to_block_end, f"run {kind}, block bigint, at bigint, next bigint, leave bigint, batches bigint"), "batch-paths")
    doors = paths.select("run", F.col("leave").alias("at")).union(paths.where("at = 0").select("run", "at")).distinct()
    entered = paths.join(doors, ["run", "at"]).select("run", "block", "at", "leave", "batches").groupBy("run").applyInPandas(
        lambda doors: _chain(doors, block_ranks), f"run {kind}, block bigint, entry bigint, before bigint")
    placed = paths.select("run", "block", "at", "next").join(entered, ["run", "block"]).groupBy("run", "block").applyInPandas(
        _number, f"run {kind}, at bigint, batch bigint")
    ranked = with_rank(fragments, [run], "fragment", "at")
    return ranked.join(placed.withColumnRenamed("run", run), [run, "at"]).drop("at")


def _to_block_end(rows: pd.DataFrame) -> pd.DataFrame:
    """Where the batches that begin at each rank leave the block, and how many there are until then."""
    rows = rows.sort_values("at", ignore_index=True)
    first, n = int(rows["at"].iloc[0]), len(rows)
    following = (rows["next"] - first).tolist()
    leave, batches = [0] * n, [1] * n
    for i in range(n - 1, -1, -1):
        to = following[i]
        leave[i] = first + to if to >= n else leave[to]
        batches[i] = 1 if to >= n else batches[to] + 1
    return rows.assign(leave=leave, batches=batches)[["run", "block", "at", "next", "leave", "batches"]]


def _chain(doors: pd.DataFrame, size: int) -> pd.DataFrame:
    """The doors that the run's batches pass: one row per block, also for blocks within one long batch (no entry)."""
    known = {at: (leave, count) for at, leave, count in zip(doors["at"], doors["leave"], doors["batches"])}
    out, at, before = [], 0, 0
    while at in known:
        leave, count = known[at]
        out.append((at // size, at, before))
        before += count
        out += [(skipped, None, before) for skipped in range(at // size + 1, leave // size + (leave not in known))]
        at = leave
    found = pd.DataFrame(out, columns=["block", "entry", "before"]).astype({"entry": "Int64"})
    found.insert(0, "run", doors["run"].iloc[0])
    return found


def _number(rows: pd.DataFrame) -> pd.DataFrame:
    """Batch numbers inside a block; ranks before its entry belong to the batch before."""
    rows = rows.sort_values("at", ignore_index=True)
    first, n, before = int(rows["at"].iloc[0]), len(rows), int(rows["before"].iloc[0])
    batch = np.full(n, before - 1)
    entry = rows["entry"].iloc[0]
    at = n if pd.isna(entry) else int(entry) - first
    following = rows["next"].to_numpy() - first
    while at < n:
        batch[at : following[at]] = before
        at, before = int(following[at]), before + 1
    return pd.DataFrame({"run": rows["run"], "at": rows["at"], "batch": batch})


def _next_starts(rows: DataFrame, run: str, max_fragments: int | None, max_ue: int, span: int = 1024) -> DataFrame:
    """(run, at, next): a batch that starts at rank ``at`` ends before ``next``.

    Users before each fragment come from counts per range of ranks. Fragments meet the one that ends
    their batch in stretches of ``span`` caps of users, each with the beginning of the next stretch.
    """
    ranked = with_rank(rows, [run], "fragment", "at").withColumn("_range", F.floor(F.col("at") / (1 << 16)))
    whole = W.partitionBy(run).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = ranked.groupBy(run, "_range").agg(F.sum("ue_count").alias("_n")).select(
        run, "_range", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_before"))
    inside = W.partitionBy(run, "_range").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = ranked.join(before, [run, "_range"]).select(
        run, "at", "ue_count", (F.col("_before") + F.sum("ue_count").over(inside)).alias("upto"))
    start = F.col("upto") - F.col("ue_count")
    stretch = F.floor(start / (span * max_ue))
    both = summed.select(
        run, "at", start.alias("start"), "upto",
        F.explode(F.array_distinct(F.array(stretch, F.greatest(F.floor((start - max_ue) / (span * max_ue)), F.lit(0))))).alias("in"),
        stretch.alias("own"))
    # the last fragment whose users, with those since the start, stay within the cap
    ahead = W.partitionBy(run, "in").orderBy("mark").rangeBetween(0, max_ue)
    marks = both.select(run, "in", F.col("upto").alias("mark"), F.lit(None).cast("bigint").alias("of"), F.col("at").alias("last")).union(
        both.where(F.col("in") == F.col("own")).select(run, "in", F.col("start").alias("mark"), F.col("at").alias("of"), F.lit(None).cast("bigint")))
    reach = marks.withColumn("reach", F.max("last").over(ahead)).where("of IS NOT NULL")
    most = F.greatest(F.col("reach"), F.col("of")) + 1
    if max_fragments is not None:
        most = F.least(most, F.col("of") + max_fragments)
    return reach.select(run, F.col("of").alias("at"), most.alias("next"))


def concat_batches(rows: DataFrame, keys: Sequence[str], shared: Sequence[str]) -> DataFrame:
    """Totals per batch and whether the shared values are identical over its fragments."""
    same = [(F.min(s).eqNullSafe(F.max(s))).alias(f"{s}_same") for s in shared]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fragments"), F.sum("ue_count").alias("ue_count"), *same
    )


def concat_rows(
    data: DataFrame, batches: DataFrame, run: str, shared: Sequence[str], row: str = "row"
) -> DataFrame:
    """Data rows of a batch's fragments one after another: ``batch`` and ``position`` are added.

    ``batches`` has run, fragment, batch, ue_count and the ``shared`` columns (axis roles, grids,
    stations); a batch whose fragments differ in one of them is an error. ``row`` numbers the data
    rows of a fragment from 0. Windows run over one row per fragment, and a batch is capped. The join is
    shuffled: Spark takes unnested ``data`` for as small as what it was unnested from, and would broadcast it.
    """
    whole = W.partitionBy(run, "batch")
    before = whole.orderBy("fragment").rowsBetween(W.unboundedPreceding, -1)
    ok = F.lit(True)
    for name in shared:
        ok = ok & F.min(name).over(whole).eqNullSafe(F.max(name).over(whole)) & (
            F.count(name).over(whole).isin(0) | (F.count(name).over(whole) == F.count(F.lit(1)).over(whole)))
    error = F.raise_error(F.concat(F.lit("fragments differ in a shared value in batch "), F.col("batch").cast("string")))
    placed = batches.select(
        run, "fragment", "batch", F.coalesce(F.sum("ue_count").over(before), F.lit(0)).alias("_offset"),
        ok.alias("_same"),
    ).where(F.when(F.col("_same"), F.lit(True)).otherwise(error.cast("boolean"))).drop("_same")
    return data.join(placed.hint("shuffle_hash"), [run, "fragment"]).withColumn(
        "position", (F.col("_offset") + F.col(row)).cast("bigint")
    ).drop("_offset")


def batch_indices(batches: DataFrame, run: str, lists: Sequence[str]) -> DataFrame:
    """Per batch its fragments in order and each index list concatenated in that order."""
    parts = F.sort_array(F.collect_list(F.struct("fragment", *lists)))
    grouped = batches.groupBy(run, "batch").agg(parts.alias("_p"))
    return grouped.select(run, "batch", F.col("_p.fragment").alias("fragments"),
                          *[F.flatten(F.col(f"_p.{name}")).alias(name) for name in lists])


def union_shards(parts: Sequence[DataFrame], key: str, station: str) -> DataFrame:
    """Concatenate shard tables; differing station lists are an error raised by the result."""
    merged = parts[0].withColumn("shard", F.lit(0))
    for number, part in enumerate(parts[1:], start=1):
        merged = merged.unionByName(part.withColumn("shard", F.lit(number)))
    per_station = merged.groupBy(station).agg(F.count_distinct("shard").alias("n"))
    odd = per_station.where(F.col("n") != len(parts)).agg(F.count(F.lit(1))).scalar()
    check = F.when(odd > 0, F.raise_error(F.lit("shards have different station lists"))
                   .cast("boolean")).otherwise(F.lit(True))
    return merged.where(check)


def unique_in_order(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Distinct keys with the position of their first occurrence."""
    return rows.groupBy(*keys).agg(F.min(position).alias(position))
