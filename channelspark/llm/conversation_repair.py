"""Conversation structure repair by iterative-deepening A*.

A conversation should read ``(s?(ua)+)?`` by the first letters of its roles. Edits bring it there: Keep (0), Rerole
to user or assistant (1), Delete (2; required for blank and duplicate rows), Insert an empty user or assistant row (5);
a truncated row that stays costs 5 more. Depth-first search tries the edits in ASCII order (D, I, K, R) below a cost
bound that grows by one; what is left to pay is never less than the cheapest edit of every remaining row, and a table
remembers with which budget a state has failed. The first accepted path is the cheapest and, among those, the least.

Rows are sorted by conversation and turn into ranges, so a conversation with most of all rows spreads over
tasks. Each run of ``ROWS`` rows is searched from every state in which it may start to every state in which it
may end, and the runs are chained. No run's path is a prefix of another's, as both end in the edit of the last row, so the least
path of the whole is made of least paths of the runs.

Defined cases: null role or text counts as one space; a null conversation id is a conversation of its own; null turns come
first; rows of one turn are ordered by role, then text, and repeated rows are duplicates; an empty table gives empty results;
texts of any length only pass through; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelspark.session import stored

#: Rows searched at once.
ROWS = 128
DELETE, INSERT, KEEP, REROLE = 2, 5, 0, 1
TRUNCATED = 5
#: States: nothing yet, after a system, a user, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPT = frozenset([START, ASSISTANT])
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
BLANK = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
#: One row's code: roles inserted before it (u, a), its edit (D, K, U or A for the new role), roles after the last row.
CODE = re.compile(r"[ua]*[DKUA](?:[ua]+$)?")
AUDIT = str.maketrans("uaUA", "IIRR")


def needed(state: int) -> str:
    """The role that Insert and Rerole give after ``state``."""
    return "a" if state == USER else "u"


def keeps(state: int, initial: str) -> bool:
    return initial == needed(state) or initial == "s" and state == START


def cheapest(rows: Sequence[tuple[str, str]], enter: int, leave: frozenset[int], tail: bool) -> tuple[int, int, str] | None:
    """Cost, last state and codes of the least cheapest path over (initial, fault) rows, None if there is none.

    ``tail`` allows rows to be inserted after the last one.
    """
    n = len(rows)
    if not tail and not any(_reachable(rows, enter, end) for end in leave):
        return None
    least = [0] * (n + 1)
    for i in reversed(range(n)):
        initial, fault = rows[i]
        least[i] = least[i + 1] + (DELETE if fault else KEEP if initial in AFTER else REROLE)
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def found(i: int, state: int, budget: int) -> int | None:
        if i == n and state in leave:
            return state
        if budget < least[i] or failed.get((i, state), -1) >= budget:
            return None
        for code, to, step, cost in _edits(rows, i, state, tail):
            if cost <= budget:
                path.append(code)
                end = found(i + step, to, budget - cost)
                if end is not None:
                    return end
                path.pop()
        failed[i, state] = budget
        return None

    bound = least[0]
    while (end := found(0, enter, bound)) is None:
        bound += 1
    return bound, end, "".join(path)


def _edits(rows: Sequence[tuple[str, str]], i: int, state: int, tail: bool) -> Iterator[tuple[str, int, int, int]]:
    """(code, next state, rows consumed, cost) in ASCII order of the edits' names."""
    role = needed(state)
    if i < len(rows):
        initial, fault = rows[i]
        yield "D", state, 1, DELETE
        yield role, AFTER[role], 0, INSERT
        if fault in ("", "truncated"):
            more = TRUNCATED if fault else 0
            if keeps(state, initial):
                yield "K", AFTER[initial], 1, KEEP + more
            yield role.upper(), AFTER[role], 1, REROLE + more
    elif tail:
        yield role, AFTER[role], 0, INSERT


def _reachable(rows: Sequence[tuple[str, str]], enter: int, end: int) -> bool:
    if end in (USER, ASSISTANT) or enter == end:
        return True
    return enter == START and end == SYSTEM and any(i == "s" and f in ("", "truncated") for i, f in rows)


def damaged(rows: DataFrame) -> DataFrame:
    """The planted faults of the benchmark query, by crc32 of ``conv_id:turn`` modulo 20."""
    kind = F.pmod(F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])), F.lit(20))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Columns ``conv_id, turn, role, text, initial, fault, digest``; repeats within one turn are found in ``searched``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), F.md5(text).alias("digest"))
    key = ["conv_id", "role", "digest"]
    repeated = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("turn").isNull()).alias("null_first"), F.min("turn").alias("first")
    ).where("n > 1")
    r, g = rows.alias("r"), repeated.alias("g")
    joined = r.join(g, [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in key], "left").select("r.*", "null_first", "first")
    later = F.col("turn").isNotNull() & (F.col("null_first") | (F.col("turn") > F.col("first")))
    stripped = F.rtrim(F.col("text"), F.lit(BLANK))
    return joined.select(
        "conv_id", "turn", "role", "text", "digest", F.substring("role", 1, 1).alias("initial"),
        F.when(stripped == "", "blank").when(later, "duplicate")
        .when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("").alias("fault"),
    )


WAYS = pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("codes", pa.string())]))
SUMMARY = pa.struct([
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("distinct", pa.int64()),
    ("low", pa.int64()), ("high", pa.int64()), ("last", pa.int64()), ("head", pa.string()), ("foot", pa.string()), ("ways", WAYS),
])


class _Run:
    """Up to ``ROWS`` consecutive rows of one conversation."""

    def __init__(self, conv, number: int, opens: bool):
        self.conv, self.number, self.opens = conv, number, opens
        self.rows: list[tuple[str, str]] = []
        self.turns: list[int] = []

    def summary(self, closes: bool) -> dict:
        rows = self.rows
        faults = [f for _, f in rows]
        if self.opens and closes:
            tries = [(START, ACCEPT, True)]
        else:
            tries = [(a, frozenset([b]), False) for a in ([START] if self.opens else range(4)) for b in range(4)]
        ways = [{"enter": a, "leave": w[1], "cost": w[0], "codes": w[2]} for a, b, tail in tries if (w := cheapest(rows, a, b, tail))]
        return {
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a[0] + b[0] not in LEGAL for a, b in zip(rows, rows[1:])),
            "distinct": len(set(self.turns)), "low": min(self.turns, default=None), "high": max(self.turns, default=None),
            "last": self.turns[-1] if self.turns else None, "head": rows[0][0], "foot": rows[-1][0], "ways": ways,
        }


def searched(rows: DataFrame) -> DataFrame:
    """Rows in order with their run and place in it, and one row per run with its ``summary``."""
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        current, before, number = None, None, part << 33
        for batch in batches:
            convs, turns, roles, digests, initials, faults = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "initial", "fault"))
            places, numbers, done = [], [], []
            for i, conv in enumerate(convs):
                row = (conv, turns[i], roles[i], digests[i])
                if row == before and faults[i] != "blank":
                    faults[i] = "duplicate"
                before = row
                if current is None or current.conv != conv or len(current.rows) == ROWS:
                    opens = part == 0 if current is None else current.conv != conv
                    if current is not None:
                        done.append((current, opens))
                    current, number = _Run(conv, number, opens), number + 1
                places.append(len(current.rows))
                numbers.append(current.number)
                current.rows.append((initials[i], faults[i]))
                if turns[i] is not None:
                    current.turns.append(turns[i])
            n = len(convs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(numbers, pa.int64()), pa.array(places, pa.int32()), batch.column("turn"), batch.column("role"),
                 batch.column("text"), pa.array(faults, pa.string()), pa.nulls(n, SUMMARY)], names=names)
            if done:
                yield summaries(done, batch.schema)
            schema = batch.schema
        if current is not None:
            yield summaries([(current, False)], schema)

    names = ["conv_id", "run", "place", "turn", "role", "text", "fault", "summary"]

    def summaries(runs: list[tuple[_Run, bool]], schema: pa.Schema) -> pa.RecordBatch:
        n = len(runs)
        return pa.RecordBatch.from_arrays(
            [pa.array([r.conv for r, _ in runs], schema.field("conv_id").type), pa.array([r.number for r, _ in runs], pa.int64()), pa.nulls(n, pa.int32()),
             pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()),
             pa.array([r.summary(closes) for r, closes in runs], SUMMARY)], names=names)

    ordered = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(
        run, f"conv_id {id_type}, run bigint, place int, turn bigint, role string, text string, fault string, summary struct<blank: bigint, "
        "duplicate: bigint, truncated: bigint, illegal: bigint, distinct: bigint, low: bigint, high: bigint, last: bigint, head: string, foot: string, "
        "ways: array<struct<enter: int, leave: int, cost: bigint, codes: string>>>")


def chained(runs: DataFrame) -> DataFrame:
    """Codes of every run, and on the last run of a conversation its measures."""
    id_type = runs.schema["conv_id"].dataType.simpleString()
    measures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    names = ["conv_id", "run", "codes", *measures, "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and held[0]["conv_id"] != row["conv_id"]:
                    out += chain(held)
                    held = []
                held.append(row)
            schema = batch.schema
            yield packed_rows(out, schema)
        if held:
            yield packed_rows(chain(held), schema)

    def packed_rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        types = [schema.field("conv_id").type, pa.int64(), pa.list_(pa.string()), *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(names, types)], names=names)

    return runs.repartition("conv_id").sortWithinPartitions("conv_id", "run").mapInArrow(
        run, f"conv_id {id_type}, run bigint, codes array<string>, {', '.join(f'{m} bigint' for m in measures)}, audit string")


def chain(runs: list[dict]) -> list[dict]:
    """The least cheapest path through all runs of a conversation; a run holds a few paths of ``ROWS`` edits, never texts."""
    best: dict[int, tuple[int, str, tuple | None]] = {START: (0, "", None)}
    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "distinct"), 0)
    last = foot = None
    for row in runs:
        s = row["summary"]
        for name in total:
            total[name] += s[name]
        total["illegal"] += foot is not None and foot + s["head"] not in LEGAL
        total["distinct"] -= last is not None and last == s["low"]
        last, foot = (last if s["last"] is None else s["last"]), s["foot"]
        after: dict[int, tuple[int, str, tuple | None]] = {}
        for way in s["ways"]:
            if way["enter"] in best:
                cost, audit, codes = best[way["enter"]]
                option = (cost + way["cost"], audit + way["codes"].translate(AUDIT), (codes, way["codes"]))
                if way["leave"] not in after or option[:2] < after[way["leave"]][:2]:
                    after[way["leave"]] = option
        best = after
    ends = []
    for state, (cost, audit, codes) in best.items():
        more, _, extra = cheapest([], state, ACCEPT, True)
        ends.append((cost + more, audit + extra.translate(AUDIT), (codes[0], codes[1] + extra)))
    cost, audit, codes = min(ends, key=lambda e: e[:2])
    turns = [row["summary"][k] for row in runs for k in ("low", "high") if row["summary"][k] is not None]
    gaps = max(turns) - min(turns) + 1 - total.pop("distinct") if turns else 0
    out = []
    for row in reversed(runs):
        out.append({"conv_id": row["conv_id"], "run": row["run"], "codes": CODE.findall(codes[1])})
        codes = codes[0] or (None, "")
    total.pop("distinct", None)
    out[0] |= {"gaps": gaps, "cost": cost, "audit": audit, **total}
    return out


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired rows (``conv_id, run, place, step, role, text``, in that order) and measures of every conversation.

    Measures: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``.
    """
    steps = stored(searched(with_faults(rows)), "conversation-rows")
    plan = stored(chained(steps.where("summary IS NOT NULL").select("conv_id", "run", "summary")), "conversation-edits")
    code = F.get(F.col("codes"), F.col("place"))
    done = steps.where("summary IS NULL").drop("summary", "fault").join(plan.select("run", "codes"), "run").select(
        "conv_id", "run", "place", "role", "text", F.posexplode(F.split(code, "")).alias("step", "edit")
    ).where("edit NOT IN ('D', '')")
    user, own = F.lower("edit") == "u", F.lower("edit") != F.col("edit")
    fixed = done.select(
        "conv_id", "run", "place", "step",
        F.when(F.col("edit") == "K", F.col("role")).when(user, "user").otherwise("assistant").alias("role"),
        F.when(own, F.col("text")).otherwise("").alias("text"),
    )
    return fixed, plan.where("audit IS NOT NULL").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def digests(fixed: DataFrame, name: str = "repaired_sha256") -> DataFrame:
    """SHA-256 of every conversation's ``role:text`` lines; rows stream through the hash, so none is held."""
    id_type = fixed.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, schema = None, None, None
        for batch in batches:
            schema, out = batch.schema, []
            for own, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
                if digest is None or own != conv:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = own, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            yield lines(out, schema)
        if digest is not None:
            yield lines([(conv, digest.hexdigest())], schema)

    def lines(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], schema.field("conv_id").type), pa.array([r[1] for r in rows], pa.string())], names=["conv_id", name])

    ordered = fixed.select("conv_id", "run", "place", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    return ordered.repartition("conv_id").sortWithinPartitions("conv_id", "run", "place", "step").select("conv_id", "line").mapInArrow(
        run, f"conv_id {id_type}, {name} string")


def same_conversation() -> Column:
    return F.col("l.conv_id").eqNullSafe(F.col("r.conv_id"))


def report(original: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conversation of ``original``: measures of ``rows`` (its damaged form), audit and digest of the repair."""
    fixed, measures = repair(rows)
    every = original.select("conv_id").distinct().alias("l")
    full = every.join(measures.alias("r"), same_conversation(), "left").select("l.conv_id", *[
        F.coalesce(F.col(f"r.{c}"), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    ], F.coalesce("audit", F.lit("")).alias("audit")).alias("l")
    return full.join(digests(fixed).alias("r"), same_conversation(), "left").select(
        "l.*", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
