"""Repair of conversations against all edits tried, slow replays and awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tapeline.llm import conversation as cv

FOLDER = "/root/testdata/sf0.01"
ROWS = "conv_id long, turn long, role string, text string"


def every_edit(initials, faults, start=cv.EMPTY, goals=cv.DONE, inserts=2):
    """The best of all edits with at most so many insertions."""
    found = []

    def go(i, state, cost, audit, left):
        if i == len(initials) and state in goals:
            found.append((cost, audit))
        if left:
            go(i, cv._NEXT[state], cost + 5, audit + "I", left - 1)
        if i < len(initials):
            go(i + 1, state, cost + 2, audit + "D", left)
            if faults[i] not in (1, 2):
                extra = 5 if faults[i] == 3 else 0
                go(i + 1, cv._NEXT[state], cost + 1 + extra, audit + "R", left)
                if (state, initials[i]) in cv._KEEP:
                    go(i + 1, cv._KEEP[state, initials[i]], cost + extra, audit + "K", left)

    go(0, start, 0, "", inserts)
    return min(found, default=None)


def test_search_equals_all_edits():
    rng = random.Random(1)
    for _ in range(600):
        n = rng.randrange(6)
        initials, faults = "".join(rng.choice("suat-") for _ in range(n)), bytes(rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
        start, goals = rng.randrange(4), rng.choice([cv.DONE, (0,), (1,), (2,), (3,)])
        assert cv.search(initials, faults, start, goals) == every_edit(initials, faults, start, goals)


def test_blocks_joined_equal_one_search_and_the_time_is_linear():
    rng = random.Random(2)
    initials, faults = "".join(rng.choice("uuaas") for _ in range(20_000)), bytes(rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(20_000))
    short = 300
    blocks = [{(s, g): cv.search(initials[i : i + 50], faults[i : i + 50], s, (g,)) for s in range(4) for g in range(4)} for i in range(0, short, 50)]
    assert cv.joined([{k: v for k, v in b.items() if v} for b in blocks]) == cv.search(initials[:short], faults[:short])
    cost, audit = cv.search(initials, faults)
    assert len(audit) == 20_000 and cost > 0


def slow(rows):
    """What the contract says, read row by row, for (conv_id, turn, role, text)."""
    out, by = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        by[conv]
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            by[conv] += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    for conv, group in by.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in group:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append(1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[1][:1] for r in group]
        turns = [r[0] for r in group if r[0] is not None]
        cost, audit = every_edit([x or "-" for x in initials], faults, inserts=1) if group else (0, "")
        state, lines, i = 0, [], 0
        for edit in audit:
            if edit == "K":
                state = cv._KEEP[state, initials[i]]
                lines.append(f"{group[i][1]}:{group[i][2]}")
            elif edit in "RI":
                state = cv._NEXT[state]
                lines.append(f"{'user' if state == cv.USER else 'assistant'}:{group[i][2] if edit == 'R' else ''}")
            i += edit != "I"
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


AWKWARD = [
    (1, 0, "user", "Hello?"), (1, 1, "assistant", "Yes."), (1, None, "user", "First."), (1, 5, None, "What."), (1, 6, "", "No role."),
    (2, None, None, None), (2, None, None, None), (3, 7, "system", "Only."), (4, 3, "user", "x" * 200_000 + "."), (4, 4, "assistant", " \t\n"),
    (5, 1, "user", "Tie b."), (5, 1, "user", "Tie a."), (5, 1, "assistant", "Tie."), (6, 2, "user", "Same."), (6, 2, "user", "Same."), (6, 3, "assistant", "Same."),
    (None, 1, "user", "No id."), (None, 2, "assistant", "Answer"), (7, 1, "tool", "Odd."), (7, 2, "usher", "A word that begins with u."), (7, 3, "assistant", "ends in quote. "), *[(8, i, ["user", "assistant"][i % 2], f"Turn {i}.") for i in range(12)],
]


def test_repair_of_awkward_rows(spark):
    df = spark.createDataFrame(AWKWARD, ROWS)
    from pyspark.sql import functions as F

    df = df.withColumns({"name": F.lit(1), "fault": F.lit("x"), "uid": F.lit(None).cast("string")}).repartition(3)
    assert found(cv.repair(df, cv.damaged(df))) == slow(AWKWARD)


@pytest.mark.parametrize("block", [2, 3])
def test_a_conversation_over_many_partitions(spark, block):
    rng = random.Random(3)
    rows = [(i % 7 % 2, i, rng.choice(["user", "assistant", "system"]), rng.choice(["", "a", "b.", f"{i}!", f"{i}"])) for i in range(26)]
    df = spark.createDataFrame(rows, ROWS)
    assert found(cv.repair(df, cv.damaged(df), block)) == slow(rows)


def test_whole_table_and_empty_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(cv.op11_repair(spark, FOLDER)) == slow(rows)
    empty = spark.createDataFrame([], ROWS)
    assert cv.repair(empty, cv.damaged(empty)).count() == 0
