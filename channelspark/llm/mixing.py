"""Mixing sources to target weights by temperature.

Weights are the sources' token shares raised to an exponent on a grid of 1/4096 and normalised; the
exponent is bisected. A source's budget is realised as whole epochs and one partial epoch: a
permutation of 4096 hash blocks, and of the documents inside a block, of which the longest prefix
within the budget is taken. Only block sums and the one block where a budget ends are ever ordered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from channelspark.llm.common import WORD, packed, text_of
from channelspark.session import stored

GRID = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def _block(key: Column, seed: int) -> Column:
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:b:"), key)), 1, 3)


def _order(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), key))


def _measures(sums: DataFrame, exponents: list[float], budget: float | None) -> list[tuple[float, float]]:
    """Entropy in nats and the largest number of epochs of a source under each exponent.

    Without a budget, the budget is the least that gives every source one epoch.
    """
    t = F.col("tokens").cast("double")
    powers = sums.select(t.alias("t"), F.explode(F.array(*[F.lit(float(a)) for a in exponents])).alias("a")) \
        .withColumn("p", F.pow("t", "a"))
    rows = {r.a: r for r in powers.groupBy("a").agg(
        F.sum("p").alias("total"), F.sum(F.col("p") * F.log("p")).alias("plogp"),
        F.max(F.col("p") / F.col("t")).alias("most"), F.max(F.col("t") / F.col("p")).alias("least")).collect()}
    out = []
    for a in exponents:
        r = rows[a]
        spend = budget if budget is not None else r.least * r.total
        out.append((math.log(r.total) - r.plogp / r.total, spend * r.most / r.total))
    return out


def exponent(sums: DataFrame, budget: float | None, entropy: float | None, repeat_limit: float | None) -> float:
    """The exponent on the grid that meets the target, by 16-way sections of the grid.

    ``entropy``: the largest exponent whose weights have at least this entropy (nats), else 0.
    ``repeat_limit``: the smallest exponent under which no source is read more often, else 1.
    """
    low, high, step = 0, GRID, GRID // 16
    while True:
        at = list(range(low, high, step)) + [high]
        got = _measures(sums, [k / GRID for k in at], budget)
        if entropy is not None:
            fit = [k for k, (h, _) in zip(at, got) if h >= entropy]
            best = max(fit, default=0)
            low, high = best, min(GRID, best + step)
        else:
            fit = [k for k, (_, e) in zip(at, got) if e <= repeat_limit]
            best = min(fit, default=GRID)
            low, high = max(0, best - step), best
        if step == 1:
            return best / GRID
        step = max(1, step // 16)


def mix_sources(
    docs: DataFrame, budget: int | str | None = None, entropy: float | None = None, repeat_limit: float | None = None,
    seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Rows in the mixture: ``row`` (the input row), ``tokens``, ``epoch`` (from 1), ``block`` and ``place``.

    ``budget`` counts words, ``"corpus"`` stands for as many as there are, and None takes the least
    budget under which every source gets a whole epoch, so that no document is lost. Exactly one of ``entropy`` and ``repeat_limit`` is the target.
    ``place`` orders a source's rows inside an epoch by permuted block, then permuted document.
    A null source is a source of its own. Null texts have no words; sources without words have
    weight 0 and pass once. Rows that share id and text are taken or left together in a partial epoch.
    """
    if (entropy is None) == (repeat_limit is None):
        raise ValueError("give either entropy or repeat_limit")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(
        packed(docs).alias("row"), key.alias("key"), F.xxhash64(text_of(text_col)).alias("part"),
        F.col(source_col).alias("source"), word_count(text_of(text_col)).alias("tokens"), _block(key, seed).alias("block"),
    )
    small = stored(rows.select("source", "block", "key", "part", "tokens"), "mix-rows")
    blocks = stored(small.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    sums = stored(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    some = sums.where("tokens > 0")
    if some.isEmpty():
        plan = sums.select("source", F.lit(1).cast("bigint").alias("whole"), F.lit("").alias("cut_block"),
                           F.lit(None).cast("struct<order:string,key:string,part:bigint>").alias("cut"))
    else:
        if budget == "corpus":
            budget = some.agg(F.sum("tokens")).first()[0]
        plan = _plan(small, blocks, sums, some, exponent(some, budget, entropy, repeat_limit), budget, seed)
    last = F.col("whole") + 1
    place = F.struct(_order(seed, last, F.col("key")).alias("order"), "key", "part")
    in_last = F.coalesce(
        (_order(seed, last, F.col("block")) < F.col("cut_block"))
        | ((_order(seed, last, F.col("block")) == F.col("cut_block")) & (place <= F.col("cut"))), F.lit(False))
    copies = F.col("whole") + in_last.cast("bigint")
    # written, so that Spark knows its size (one row per source) when it decides whether texts must be shuffled
    plan = stored(plan, "mix-plan")
    joined = rows.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return (
        joined.select("row", "tokens", "block", "key", F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("bigint"), copies))).alias("epoch"))
        .select("row", "tokens", "epoch", "block",
                F.concat(_order(seed, F.col("epoch"), F.col("block")), F.lit(":"), _order(seed, F.col("epoch"), F.col("key"))).alias("place"))
    )


def _plan(small: DataFrame, blocks: DataFrame, sums: DataFrame, some: DataFrame, alpha: float, budget: int | None, seed: int) -> DataFrame:
    """Per source its whole epochs, and the block and the document at which its partial epoch ends."""
    t, power = F.col("tokens").cast("double"), F.pow(F.col("tokens").cast("double"), F.lit(alpha))
    total = some.agg(F.sum(power).alias("total"), F.max(t / power).alias("least")).first()
    spend = float(budget) if budget is not None else total.least * total.total
    # a budget that is meant to be whole epochs must not fall a word short by rounding
    want = F.floor(power * spend / total.total + 1e-6).cast("bigint")
    plan = stored(sums.select(
        "source", F.when(F.col("tokens") > 0, F.floor(want / F.col("tokens"))).otherwise(1).cast("bigint").alias("whole"),
        F.when(F.col("tokens") > 0, F.pmod(want, F.col("tokens"))).otherwise(0).cast("bigint").alias("rest")), "mix-plan")
    before = W.partitionBy("source").orderBy("order").rowsBetween(W.unboundedPreceding, -1)
    ends = stored(
        blocks.withColumnRenamed("source", "of").join(plan, F.col("of").eqNullSafe(F.col("source")))
        .where("rest > 0").select("source", "block", "tokens", "whole", "rest", _order(seed, F.col("whole") + 1, F.col("block")).alias("order"))
        .withColumn("sum", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .where("sum <= rest AND sum + tokens > rest")
        .select("source", "block", F.col("order").alias("cut_block"), (F.col("rest") - F.col("sum")).alias("left"), "whole"), "mix-ends")
    within = W.partitionBy("source").orderBy("place")
    cuts = (
        small.withColumnRenamed("source", "of").withColumnRenamed("block", "in")
        .join(ends, F.col("of").eqNullSafe(F.col("source")) & (F.col("in") == F.col("block")))
        .select("source", "left", F.struct(_order(seed, F.col("whole") + 1, F.col("key")).alias("order"), "key", "part").alias("place"), "tokens")
        .withColumn("sum", F.sum("tokens").over(within)).where(F.col("sum") <= F.col("left"))
        .groupBy("source").agg(F.max("place").alias("cut"))
    )
    return (
        plan.join(ends.select(F.col("source").alias("s1"), "cut_block"), F.col("source").eqNullSafe(F.col("s1")), "left")
        .join(cuts.select(F.col("source").alias("s2"), "cut"), F.col("source").eqNullSafe(F.col("s2")), "left")
        .select("source", "whole", "cut_block", "cut")
    )
