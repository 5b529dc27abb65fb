"""Data-quality contract: rules that turn tables into violation rows.

Every check returns (rule_id, table, key, detail); a table passes when no row comes back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelspark import schemas
from channelspark.functions import complex as C
from channelspark.operators.shards import contiguity_violations
from channelspark.sources.runs import resolve_products


@dataclass(frozen=True)
class Rule:
    """A row-level rule: ``broken`` marks violations, ``detail`` explains them."""

    rule_id: str
    table: str
    keys: tuple[str, ...]
    broken: Column
    detail: Column


def _row(rule_id: str, table: str, key: Column, detail: Column) -> list[Column]:
    return [F.lit(rule_id).alias("rule_id"), F.lit(table).alias("table"),
            key.cast("string").alias("key"), detail.cast("string").alias("detail")]


def _key(*names: str) -> Column:
    return F.concat_ws("-", *[F.col(n).cast("string") for n in names])


def check(df: DataFrame, rule: Rule) -> DataFrame:
    """Violations of one row-level rule; a NULL condition counts as a violation."""
    broken = F.coalesce(rule.broken, F.lit(True))
    return df.where(broken).select(*_row(rule.rule_id, rule.table, _key(*rule.keys), rule.detail))


def columns(df: DataFrame, table: str, required: Sequence[str], forbidden: Sequence[str] = ()
            ) -> DataFrame:
    """Q1: required columns exist and hold values; forbidden columns are absent."""
    present = [c for c in required if c in df.columns]
    notes = [(c, "missing") for c in required if c not in df.columns]
    notes += [(c, "forbidden") for c in forbidden if c in df.columns]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present])
    entries = F.array(
        *[F.struct(F.lit(c).alias("key"), F.lit(note).alias("detail")) for c, note in notes],
        *[F.struct(F.lit(c).alias("key"), F.when(
            F.col(c) > 0, F.concat(F.lit("null rows: "), F.col(c).cast("string"))).alias("detail"))
          for c in present],
    )
    return counts.select(F.inline(entries)).where("detail IS NOT NULL").select(
        *_row("Q1", table, F.col("key"), F.col("detail"))
    )


def product_columns(df: DataFrame, table: str, products: Sequence[str]) -> DataFrame:
    """Q1 by product: the chosen products' columns are there, and no column of another product is."""
    chosen = resolve_products(products)
    required = {c for p in chosen for c in schemas.PRODUCT_COLUMNS.get(p, ())}
    foreign = {c for p, names in schemas.PRODUCT_COLUMNS.items() if p not in chosen for c in names} - required
    return columns(df, table, sorted(required), sorted(foreign))


def increasing_rule(table: str, keys: Sequence[str], grid: str) -> Rule:
    """Q2 as a row rule."""
    later, earlier = F.slice(grid, 2, F.size(grid)), F.slice(grid, 1, F.size(grid) - 1)
    rises = F.zip_with(later, earlier, lambda b, a: b > a)
    falls = F.filter(rises, lambda up: ~F.coalesce(up, F.lit(False)))
    odd = F.filter(grid, lambda f: ~C.is_finite(f))
    bad = F.size(falls) + F.size(odd)
    return Rule("Q2", table, tuple(keys), bad > 0, bad)


def increasing(df: DataFrame, table: str, keys: Sequence[str], grid: str) -> DataFrame:
    """Q2: an array column is finite and strictly increasing; checked inside the row."""
    return check(df, increasing_rule(table, keys, grid))


def some_finite(df: DataFrame, table: str, keys: Sequence[str], value: str) -> DataFrame:
    """Q3: every key has at least one finite value."""
    found = df.groupBy(*keys).agg(F.count_if(C.is_finite(F.col(value))).alias("n"))
    return check(found, Rule("Q3", table, tuple(keys), F.col("n") == 0, F.lit("no finite value")))


def all_finite(df: DataFrame, table: str, names: Sequence[str], rule_id: str = "Q4") -> DataFrame:
    """Q4: columns hold finite values only; one row per offending column."""
    counts = df.agg(*[F.count_if(~C.is_finite(F.col(n))).alias(n) for n in names])
    return check(counts.unpivot([], list(names), "column", "n"),
                 Rule(rule_id, table, ("column",), F.col("n") > 0, F.col("n")))


def label_rule(keys: Sequence[str], always: Sequence[str], when_valid: Sequence[str],
               valid: str = "valid") -> Rule:
    """Q5 as a row rule."""
    def broken(names: Sequence[str]) -> Column:
        return F.lit(False) if not names else ~_all([C.is_finite(F.col(n)) for n in names])

    return Rule("Q5", "links", tuple(keys), broken(always) | (F.col(valid) & broken(when_valid)),
                F.lit("label not finite"))


def label_values(labels: DataFrame, keys: Sequence[str], always: Sequence[str],
                 when_valid: Sequence[str], valid: str = "valid") -> DataFrame:
    """Q5: some labels are always finite, delays are finite on valid links."""
    return check(labels, label_rule(keys, always, when_valid, valid))


def _all(parts: Sequence[Column]) -> Column:
    result = parts[0]
    for part in parts[1:]:
        result = result & part
    return result


def ranging_rule(keys: Sequence[str]) -> Rule:
    """Q6 as a row rule: finite iff success, bin >= 0 iff success (-1 otherwise)."""
    finite = C.is_finite(F.col("range_m"))
    ok = (finite == F.col("success")) & F.when(
        F.col("success"), F.col("delay_bin") >= 0).otherwise(F.col("delay_bin") == -1)
    return Rule("Q6", "ranging", tuple(keys), ~ok, F.lit("success flag disagrees"))


def ranging_consistency(ranging: DataFrame, keys: Sequence[str], default: str) -> DataFrame:
    """Q6: finite iff success, bin >= 0 iff success (-1 otherwise), default estimator present."""
    rows = check(ranging, ranging_rule(keys))
    absent = ranging.agg(F.count_if(F.col("estimator") == default).alias("n")).where("n = 0")
    return rows.unionByName(absent.select(
        *_row("Q6", "ranging", F.lit(default), F.lit("default estimator missing"))
    ))


def path_rule(keys: Sequence[str], numbers: Sequence[str]) -> Rule:
    """Q7 as a row rule."""
    finite = _all([C.is_finite(F.col(n)) for n in numbers])
    enough = F.col("vertex_count") >= F.col("depth") + 2
    return Rule("Q7", "paths", tuple(keys), ~(finite & enough),
                F.when(~finite, "not finite").otherwise("too few vertices"))


def path_samples(paths: DataFrame, keys: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Q7: finite samples and at least interactions + 2 vertices."""
    return check(paths, path_rule(keys, numbers))


def shard_indices(shards: DataFrame, keys: Sequence[str], planned: DataFrame, users: DataFrame
                  ) -> DataFrame:
    """Q8: shard index in range, user lists as long as declared, indices inside the topology.

    ``planned`` has keys and shard_count; ``users`` has keys, first and last user index. A shard of
    a run without a plan or without users breaks the rule, and so does a planned run without shards.
    """
    rows = shards.join(planned, list(keys), "full").join(users, list(keys), "left")
    in_range = F.col("shard_index").between(F.lit(0), F.col("shard_count") - 1)
    inside = F.forall("ue_indices", lambda u: u.between(F.col("first"), F.col("last")))
    length = F.size("ue_indices") == F.col("ue_count")
    detail = (
        F.when(F.col("shard_index").isNull(), "no shard").when(F.col("shard_count").isNull(), "no plan")
        .when(F.col("first").isNull(), "no users").when(~in_range, "shard index")
        .when(~inside, "user index").otherwise("length")
    )
    return check(rows, Rule("Q8", "shards", (*keys, "shard_index"),
                            ~(in_range & inside & length), detail))


def bundle_offsets(fragments: DataFrame, keys: Sequence[str], totals: DataFrame) -> DataFrame:
    """Q9: offsets are contiguous, counts are positive and end at the declared total.

    ``totals`` has keys and total; totals without fragments and fragments without a total break the rule.
    """
    gaps = contiguity_violations(fragments, keys).select(
        *_row("Q9", "bundle", _key(*keys, "shard_index"), F.lit("offset gap"))
    )
    empty = check(fragments, Rule("Q9", "bundle", (*keys, "shard_index"), F.col("ue_count") < 1,
                                  F.lit("count below 1")))
    sums = fragments.groupBy(*keys).agg(F.sum("ue_count").alias("n")).join(totals, list(keys), "full")
    detail = F.when(F.col("n").isNull(), "no fragment").when(F.col("total").isNull(), "no total").otherwise(
        "total differs")
    return gaps.unionByName(empty).unionByName(
        check(sums, Rule("Q9", "bundle", tuple(keys), F.col("n") != F.col("total"), detail)))


def multiuser_slots(slots: DataFrame, keys: Sequence[str], tx_count: Column) -> DataFrame:
    """Q10: active transmitters in range, inactive slots exactly -1."""
    ok = F.when(F.col("active"), F.col("tx").between(F.lit(0), tx_count - 1)).otherwise(
        F.col("tx") == -1)
    return check(slots, Rule("Q10", "frames", (*keys, "frame", "slot"), ~ok, F.lit("slot index")))


def collision_mask(occupancy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q10: collision flag equals occupancy above one."""
    return check(occupancy, Rule("Q10", "occupancy", (*keys, "frame", "symbol", "k"),
                                 F.col("collision") != (F.col("users") > 1),
                                 F.lit("collision flag")))


def iq_layout(captures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q11: fft >= 2, prefix >= 0, symbols >= 1, sample count = symbols * (fft + prefix).

    If there is a column ``samples`` (array of re, im), every sample must be finite too.
    """
    sizes = (F.col("fft") >= 2) & (F.col("cp") >= 0) & (F.col("symbols") >= 1)
    length = F.col("sample_count") == F.col("symbols") * (F.col("fft") + F.col("cp"))
    finite = F.lit(True)
    if "samples" in captures.columns:
        finite = F.forall("samples", lambda s: C.is_finite(s["re"]) & C.is_finite(s["im"]))
    return check(captures, Rule("Q11", "iq", tuple(keys), ~(sizes & length & finite),
                                F.when(~sizes, "sizes").when(~length, "sample count").otherwise("not finite")))


def block_rule(keys: Sequence[str]) -> Rule:
    """Q12 as a row rule."""
    ratio = F.try_divide(F.col("errors"), F.col("blocks"))
    near = F.abs(F.col("rate") - ratio) <= 1e-6 + 1e-4 * F.abs(ratio)
    counts = (F.col("errors") >= 0) & (F.col("errors") <= F.col("blocks")) & (F.col("blocks") > 0)
    return Rule("Q12", "evaluation", tuple(keys), ~(counts & near),
                F.when(~counts, "counts").otherwise("rate"))


def block_errors(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q12: 0 <= errors <= blocks and rate = errors/blocks within 1e-4 relative, 1e-6 absolute."""
    return check(rows, block_rule(keys))


def rows_per_key(df: DataFrame, table: str, keys: Sequence[str], expected: int | Column,
                 rule_id: str = "Q15", axis: DataFrame | None = None) -> DataFrame:
    """Q13, Q14, Q15: a key owns exactly the product of its axis sizes.

    ``axis`` lists the keys that must be there; those without a row are reported with count 0,
    and so are keys that it does not list.
    """
    wanted = expected if isinstance(expected, Column) else F.lit(expected)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(wanted).alias("wanted"))
    if axis is not None:
        listed = axis.select(*keys).distinct().withColumn("_listed", F.lit(True))
        counts = counts.join(listed, list(keys), "full").withColumns({
            "n": F.coalesce("n", F.lit(0)), "wanted": F.when(F.col("_listed"), F.col("wanted")),
        })
    return check(counts, Rule(rule_id, table, tuple(keys), F.col("n") != F.col("wanted"),
                              F.col("n")))


def link_table(links: DataFrame, points: DataFrame, units: Sequence[str]) -> DataFrame:
    """Q14: n_tx * n_rx links per scene, and a unit on every listed column."""
    sizes = points.groupBy("scene_id").agg(
        (F.count_if(F.col("role") == "ue") * F.count_if(F.col("role") == "bs")).alias("wanted")
    )
    counts = links.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    rows = check(
        sizes.join(counts, "scene_id", "full").withColumns({
            "n": F.coalesce("n", F.lit(0)), "wanted": F.coalesce("wanted", F.lit(0))}),
        Rule("Q14", "links", ("scene_id",), F.col("n") != F.col("wanted"), F.col("n")),
    )
    unitless = [c for c in units if not links.schema[c].metadata.get("unit")]
    if unitless:
        marks = links.agg(F.count(F.lit(1))).select(  # one row, also for an empty table
            F.explode(F.array(*[F.lit(c) for c in unitless])).alias("c"))
        rows = rows.unionByName(marks.select(
            *_row("Q14", "links", F.col("c"), F.lit("unit missing"))
        ))
    return rows
