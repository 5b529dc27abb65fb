"""Whole-table contracts: all rules of a table compiled into one scan and one aggregate.

Every row emits facts, (rule, key, ...), for the rules it breaks or counts towards. Facts of row rules
carry the row's number, so they stay apart; facts of column and key rules are counted, in every map
task first. Facts that hold without any row (a column that must be absent, a value or a key that must
be there) join the same aggregate as constants or from the table that lists them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelspark.functions import complex as C
from channelspark.operators.quality import Rule, _key

#: One fact. ``row`` keeps row violations apart, ``n`` counts, ``wanted`` and ``listed`` belong to sizes.
FACT = {"kind": "string", "rule_id": "string", "key": "string", "detail": "string", "row": "bigint",
        "n": "bigint", "wanted": "bigint", "listed": "boolean"}


@dataclass(frozen=True)
class Size:
    """A key owns ``expected`` rows (Q13, Q15); ``axis`` lists the keys that must be there."""

    rule_id: str
    keys: tuple[str, ...]
    expected: int | Column
    axis: DataFrame | None = None


@dataclass(frozen=True)
class Contract:
    """What one table promises.

    ``required`` and ``forbidden`` columns (Q1), ``units``: columns whose metadata name a unit (Q14),
    ``finite`` columns (Q4), ``some_finite``: (keys, column) with a finite value for each key (Q3),
    ``values``: (rule, column, value, detail) that must occur, ``rows``: row rules, ``sizes``: rows per key.
    """

    table: str
    required: Sequence[str] = ()
    forbidden: Sequence[str] = ()
    units: Sequence[str] = ()
    finite: Sequence[str] = ()
    some_finite: Sequence[tuple[Sequence[str], str]] = ()
    values: Sequence[tuple[str, str, str, str]] = ()
    rows: Sequence[Rule] = ()
    sizes: Sequence[Size] = field(default=())


def _fact(kind: str, rule_id: str, **parts: Column) -> Column:
    parts = {"kind": F.lit(kind), "rule_id": F.lit(rule_id), **parts}
    return F.struct(*[parts.get(name, F.lit(None)).cast(of).alias(name) for name, of in FACT.items()])


def _row_facts(df: DataFrame, contract: Contract) -> list[Column]:
    """One array entry per rule that a row can break or count towards; NULL where it does neither."""
    number, one, zero = F.col("_row"), F.lit(1), F.lit(0)
    facts = [
        F.when(F.coalesce(rule.broken, F.lit(True)), _fact(
            "row", rule.rule_id, key=_key(*rule.keys), detail=rule.detail, row=number, n=one))
        for rule in contract.rows
    ]
    facts += [F.when(F.col(c).isNull(), _fact("null", "Q1", key=F.lit(c), n=one))
              for c in contract.required if c in df.columns]
    facts += [F.when(~F.coalesce(C.is_finite(F.col(c)), F.lit(False)), _fact("count", "Q4", key=F.lit(c), n=one))
              for c in contract.finite]
    facts += [_fact("none", "Q3", key=_key(*keys), n=F.when(C.is_finite(F.col(c)), one).otherwise(zero))
              for keys, c in contract.some_finite]
    facts += [F.when(F.col(c) == value, _fact("value", rule_id, key=F.lit(value), detail=F.lit(detail), n=one))
              for rule_id, c, value, detail in contract.values]
    for size in contract.sizes:
        wanted = size.expected if isinstance(size.expected, Column) else F.lit(size.expected)
        facts.append(_fact("size", size.rule_id, key=_key(*size.keys), n=one, wanted=wanted,
                           listed=F.lit(True) if size.axis is None else F.lit(None)))
    return facts


def _constant_facts(df: DataFrame, contract: Contract) -> list[tuple]:
    notes = [("Q1", c, "missing") for c in contract.required if c not in df.columns]
    notes += [("Q1", c, "forbidden") for c in contract.forbidden if c in df.columns]
    notes += [("Q14", c, "unit missing") for c in contract.units
              if c not in df.columns or not df.schema[c].metadata.get("unit")]
    facts = [("row", rule, key, detail, n, 1, None, None) for n, (rule, key, detail) in enumerate(notes, 1)]
    return facts + [("value", rule, value, detail, None, 0, None, None) for rule, _, value, detail in contract.values]


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """Rows (rule_id, table, key, detail) for every broken promise; none if the table keeps all.

    The rows are those of the single checks. Keys are compared as they are printed, so key columns
    must print unambiguously; a NULL in a key column is left out of the printed key.
    """
    schema = ", ".join(f"{name} {of}" for name, of in FACT.items())
    facts = df.sparkSession.createDataFrame(_constant_facts(df, contract), schema)
    if found := _row_facts(df, contract):
        numbered = df.withColumn("_row", F.monotonically_increasing_id())
        facts = facts.unionByName(
            numbered.select(F.explode(F.array(*found)).alias("f")).where("f IS NOT NULL").select("f.*"))
    for size in contract.sizes:
        if size.axis is not None:
            facts = facts.unionByName(size.axis.select(_fact(
                "size", size.rule_id, key=_key(*size.keys), n=F.lit(0), listed=F.lit(True)).alias("f")).select("f.*"))
    kind, n = F.col("kind"), F.col("n")
    totals = facts.groupBy("kind", "rule_id", "key", "row", "detail").agg(
        F.sum("n").alias("n"), F.max("wanted").alias("wanted"), F.bool_or("listed").alias("listed"))
    wanted = F.when(F.col("listed"), F.col("wanted"))
    broken = F.when(kind.isin("none", "value"), n == 0).when(
        kind == "size", F.coalesce(n != wanted, F.lit(True))).otherwise(n > 0)
    detail = (
        F.when(kind.isin("row", "value"), F.col("detail")).when(kind == "null", F.concat(F.lit("null rows: "), n.cast("string")))
        .when(kind == "none", "no finite value")
        .otherwise(n.cast("string"))
    )
    return totals.where(broken).select(
        "rule_id", F.lit(contract.table).alias("table"), "key", detail.alias("detail"))
