"""Conversation repair against uniform-cost search over all edits, rows in plain Python."""

import hashlib
import heapq
import random
import zlib

import pytest

from channelspark.llm import conversation_repair as cr

BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(kind, text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute(rows):
    """conv_id -> the contract's columns; rows are those after damage."""
    convs = {}
    for row in rows:
        convs.setdefault(row[0], []).append(row[1:])
    return {conv: brute_one(own) for conv, own in convs.items()}


def brute_one(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        t = text.rstrip(BLANK)
        faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            break
        want = "assistant" if state == "u" else "user"
        heapq.heappush(heap, (cost + 5, audit + "I", i, want[0], (*kept, want + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, kept))
            if faults[i] in ("", "truncated"):
                more = 5 * (faults[i] != "")
                if role[:1] == want[0] or role[:1] == "s" and state == "":
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*kept, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, want[0], (*kept, f"{want}:{text}")))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(kept).encode()).hexdigest())


def result(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


SCHEMA = "conv_id bigint, turn bigint, role string, text string, run int, place int, fault string, summary string, audit string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "x", "y", "z") for r in rows], SCHEMA).repartition(parts)


def made(n, seed, roles=("user", "assistant", "system", "tool", "", None)):
    rng = random.Random(seed)
    texts = ["Fine.", "Yes!", "cut off", "", " \n", None, "Wo?  ", "same text.", "ä　", "x" * 3000 + "."]
    return [(c, rng.choice([t, t, t, None, t // 2]), rng.choice(roles), rng.choice(texts)) for c in range(n) for t in range(rng.randint(1, 9))]


def test_against_brute_force(spark):
    rows = made(150, 3) + [(None, 1, "user", "No id."), (None, 2, "assistant", "None."), (7, 0, "user", "Fine.")] * 2
    want = brute(damaged(rows))
    every = frame(spark, rows)
    got = result(cr.report(every, cr.damaged(every)))
    assert set(got) == {r[0] for r in rows}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: want.get(c, empty) for c in got}
    assert any("R" in v[6] for v in got.values()) and any(v[0] for v in got.values())


def test_long_conversation_spans_runs_and_tasks(spark):
    rng = random.Random(5)
    long = [(1, t, rng.choice(["user", "assistant"]) if t % 9 == 0 else ("user", "assistant")[t % 2], f"Turn {t}{rng.choice(['.', '.', ''])}") for t in range(900)]
    rows = long + [(2, t, ("user", "assistant")[t % 2], "Hi." if t else "Hi!") for t in range(4)] + [(3, None, "user", "Null turn.")] * 300
    got = result(cr.report(frame(spark, rows), frame(spark, rows)))
    assert got == brute([(c, t, r, x) for c, t, r, x in rows])


@pytest.mark.parametrize("enter", range(4))
def test_every_way_through_a_run(enter):
    """Chained runs give what one run gives, whatever the state between them."""
    rng = random.Random(enter)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.choice(["", "", "blank", "truncated"])) for _ in range(rng.randint(2, 7))]
        whole = cr.cheapest(rows, enter, cr.ACCEPT, True)
        cut = rng.randint(1, len(rows) - 1)
        options = []
        for middle in range(4):
            first = cr.cheapest(rows[:cut], enter, frozenset([middle]), False)
            second = first and cr.cheapest(rows[cut:], middle, cr.ACCEPT, True)
            if second:
                options.append((first[0] + second[0], (first[2] + second[2]).translate(cr.AUDIT)))
        assert min(options) == (whole[0], whole[2].translate(cr.AUDIT))


def test_empty_table_and_repaired_rows(spark):
    none = frame(spark, [])
    assert cr.report(none, cr.damaged(none)).count() == 0
    rows = frame(spark, [(1, 0, "assistant", "First."), (1, 1, "assistant", "Second."), (1, 2, "", " "), (1, 3, "tool", "Third.")])
    fixed, measures = cr.repair(rows)
    assert [(r.role, r.text) for r in fixed.orderBy("run", "place", "step").collect()] == [("user", "First."), ("assistant", "Second.")]
    assert measures.collect()[0].audit == "RKDD"
