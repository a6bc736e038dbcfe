"""Operator 11: the cheapest repair of each conversation's turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepared, stored, table

SPACE = " \t\n\x0b\x0c\r"
#: Costs of edits; an undeleted truncated row costs TRUNCATED more.
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows that one search takes. Longer conversations are cut into blocks, solved for each way of entering and leaving them.
BLOCK = 4096
#: Where a conversation can stand: nothing kept, after the system's row, after a user's, after an assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
DONE = (EMPTY, ASSISTANT)
_KEEP = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_NEXT = (USER, USER, ASSISTANT, USER)
_NEVER = 1 << 60
_BLOCKS = "name string, part int, block int, whole boolean, n long, illegal long, first string, last string, start array<int>, goal array<int>, cost array<long>, audit array<string>"


# ---- the search


def suffix_bounds(initials: str, faults: bytes, goals: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """For each place, what the rest costs at least: where a user's row is due, an assistant's, and where nothing is kept yet.

    Relaxed: after a system's row a conversation may end, and only whose turn it is at the end counts.
    """
    user, assistant = (min((0 if (g == USER) == due else INSERT) for g in goals) for due in (0, 1))
    bounds = [(user, assistant, user)]
    for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
        extra = TRUNCATED if fault == 3 else 0
        u, a, none = DELETE + user, DELETE + assistant, DELETE + bounds[-1][2]
        if fault not in (1, 2):
            start = extra + (0 if initial == "u" else RELABEL) + assistant
            u, a, none = min(u, start), min(a, extra + (0 if initial == "a" else RELABEL) + user), min(none, start, extra + user if initial == "s" else start)
        user, assistant = min(u, INSERT + a), min(a, INSERT + u)
        bounds.append((user, assistant, min(none, INSERT + assistant)))
    return bounds[::-1]


def search(initials: str, faults: bytes, start: int = EMPTY, goals: tuple[int, ...] = DONE) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from `start` to one of `goals`, ASCII-least among equals; None if there are none.

    Depth-first branch and bound on a stack of its own. Edits are tried in ASCII order, so prefixes come in the order of their
    audits: one that reaches a node (place, state) no cheaper than an earlier one is dominated by it, and an incumbent gives
    way to a cheaper one only. A prefix whose cost and suffix bound do not beat the incumbent is left. Before there is an
    incumbent, the cost of edits found by following the bounds takes its place; edits of that cost are still looked for.
    """
    n = len(initials)
    bounds = suffix_bounds(initials, faults, goals)

    def least(i: int, state: int) -> int:
        if state > max(goals, key=lambda g: g in (USER, ASSISTANT)) and all(g < USER for g in goals):
            return _NEVER  # nothing leads back
        return bounds[i][2 if state == EMPTY else state == USER]

    def moves(i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        if i < n:
            yield "D", i + 1, state, DELETE
        yield "I", i, _NEXT[state], INSERT
        if i < n and faults[i] not in (1, 2):
            extra = TRUNCATED if faults[i] == 3 else 0
            if (state, initials[i]) in _KEEP:
                yield "K", i + 1, _KEEP[state, initials[i]], extra
            yield "R", i + 1, _NEXT[state], RELABEL + extra

    i, state, limit = 0, start, 0
    while not (i == n and state in goals):
        _, i, state, cost = min(moves(i, state), key=lambda m: (m[3] + least(m[1], m[2]), -m[1]))
        limit += cost
        if limit >= _NEVER or least(i, state) >= _NEVER or limit > (n + 4) * (INSERT + TRUNCATED + RELABEL):
            limit = _NEVER  # the bounds led nowhere: no limit but the incumbent's
            break
    best, table_ = None, {}
    trail: list[tuple[int, str]] = [(-1, "")]
    stack = [(0, start, 0, 0)]
    while stack:
        i, state, cost, at = stack.pop()
        bound = cost + least(i, state)
        if bound >= _NEVER or (bound >= best[0] if best else bound > limit) or cost >= table_.get((i, state), _NEVER):
            continue
        table_[i, state] = cost
        if i == n and state in goals:
            best = (cost, at)
            continue
        for letter, j, then, price in reversed(list(moves(i, state))):
            if cost + price < table_.get((j, then), _NEVER):
                trail.append((at, letter))
                stack.append((j, then, cost + price, len(trail) - 1))
    if best is None:
        return None
    letters, at = [], best[1]
    while at:
        at, letter = trail[at]
        letters.append(letter)
    return best[0], "".join(reversed(letters))


def joined(blocks: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, str]:
    """(cost, audit) of a conversation from those of its blocks by (start, goal): of prefixes that end alike the better stays."""
    prefixes = {EMPTY: (0, "")}
    for block in blocks:
        found: dict[int, tuple[int, str]] = {}
        for (start, goal), (cost, audit) in block.items():
            if start in prefixes:
                new = (prefixes[start][0] + cost, prefixes[start][1] + audit)
                found[goal] = min(found.get(goal, new), new)
        prefixes = found
    return min(prefixes[g] for g in DONE if g in prefixes)


# ---- rows and faults


def _name(conv_id: Column) -> Column:
    return F.when(conv_id.isNull(), "-").otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32 of `conv_id:turn` modulo 20. Nulls of role and text, and in the key, are one space."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    hit = F.crc32(F.concat(text[0], F.lit(":"), text[1])) % 20
    rows = conversations.select("conv_id", "turn", text[2].alias("role"), text[3].alias("text"), hit.alias("_hit")).filter("_hit != 0")
    rows = rows.withColumns({"text": F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")), "role": F.when(F.col("_hit") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("_", F.explode(F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_", "_hit")


ORDER = ["turn", "role", "head", "digest", "uid"]


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with what orders and compares them: by turn (nulls first), then role, first 64 characters, digest; equal rows in any order."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    return rows.select(_name(F.col("conv_id")).alias("name"), "turn", "role", "text", F.substring("text", 1, 64).alias("head"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"), F.monotonically_increasing_id().alias("uid"), (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"))


def faulty(rows: DataFrame) -> DataFrame:
    """name, turn, role, head, digest, uid, fault of rows of `numbered`: 1 blank, 2 duplicate, 3 truncated, else 0; no texts.

    The first row of each role and text is found by partial minima; only groups of two and more are joined back, so a text
    that is repeated without end is a join's hot key, which Spark splits, and no window's.
    """
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "uid")
    first = rows.filter("NOT blank").groupBy("name", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("name", "digest", "first")
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNotNull() & (place != F.col("first")), 2).when(F.col("cut"), 3).otherwise(0)
    slim = rows.select("name", "turn", "role", "head", "digest", "uid", "blank", "cut").join(first, ["name", "digest"], "left")
    return slim.select("name", "turn", "role", "head", "digest", "uid", fault.alias("fault"))


# ---- blocks of ordered rows


def _solved(name: str, part: int, block: int, whole: bool, initials: list[str], faults: bytes) -> dict:
    text = "".join(x or "-" for x in initials)
    pairs = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
    if whole:
        found = {(EMPTY, ASSISTANT): search(text, faults)}
    else:
        found = {(s, g): search(text, faults, s, (g,)) for s in range(4) for g in range(4)}
        found = {k: v for k, v in found.items() if v}
    return {"name": name, "part": part, "block": block, "whole": whole, "n": len(text), "illegal": pairs, "first": initials[0], "last": initials[-1], "start": [k[0] for k in found], "goal": [k[1] for k in found], "cost": [v[0] for v in found.values()], "audit": [v[1] for v in found.values()]}


def blocks_of(slim: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of `faulty` in order over all partitions, cut into blocks of one conversation and at most `block` rows, each solved.

    Partitions are ranges of (conversation, order), so a conversation of any size lies in as many as it needs. Blocks of
    conversations that can go on in another partition are solved for all entries and exits.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("name", pa.string()), ("part", pa.int32()), ("block", pa.int32()), ("whole", pa.bool_()), ("n", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("start", pa.list_(pa.int32())), ("goal", pa.list_(pa.int32())), ("cost", pa.list_(pa.int64())), ("audit", pa.list_(pa.string()))])
        part, name, initials, faults, n, edge = TaskContext.get().partitionId(), None, [], bytearray(), 0, True
        rows: list[dict] = []

        def closed(whole: bool) -> None:
            nonlocal n
            if initials:
                rows.append(_solved(name, part, n, whole, initials, bytes(faults)))
                n += 1
                initials.clear()
                faults.clear()

        for batch in batches:
            names, firsts, codes = (batch.column(i).to_pylist() for i in range(3))
            for key, initial, code in zip(names, firsts, codes, strict=True):
                if key != name:
                    closed(not edge and n == 0)
                    edge = name is None
                    name, n = key, 0
                elif len(initials) == block:
                    closed(False)
                initials.append(initial)
                faults.append(code)
            if len(rows) >= 256:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        closed(False)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    ordered = slim.repartitionByRange("name", *ORDER).sortWithinPartitions("name", *ORDER)
    return ordered.select("name", F.substring("role", 1, 1), "fault").mapInArrow(work, _BLOCKS)


def _chained(key: tuple, group: pa.Table) -> pa.Table:
    """One conversation from its blocks: few rows, as a block has thousands of a conversation's."""
    rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["block"]))
    cost, audit = joined([dict(zip(zip(r["start"], r["goal"], strict=True), zip(r["cost"], r["audit"], strict=True), strict=True)) for r in rows])
    illegal = sum(r["illegal"] for r in rows) + sum(x["last"] + y["first"] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:], strict=False))
    return pa.Table.from_pylist([{"name": key[0].as_py(), "illegal": illegal, "cost": cost, "audit": audit}], pa.schema([("name", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]))


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(name, repaired_sha256) of the rows of `numbered` after the edits of plans (name, audit).

    A digest goes over a conversation from its first row to its last, so one task reads it, a batch at a time; it holds no more
    of it than the audit.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, audit, at, state, digest, begun = None, "", 0, EMPTY, hashlib.sha256(), False
        out: list[tuple[str, str]] = []

        def add(role: str, text: str) -> None:
            nonlocal begun
            digest.update((("\n" if begun else "") + f"{role}:{text}").encode())
            begun = True

        def inserted() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = _NEXT[state]
                add("user" if state == USER else "assistant", "")
                at += 1

        for batch in batches:
            for key, plan, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if plan is not None:
                    if name is not None:
                        inserted()
                        out.append((name, digest.hexdigest()))
                    name, audit, at, state, digest, begun = key, plan, 0, EMPTY, hashlib.sha256(), False
                    continue
                inserted()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = _KEEP[state, role[:1]]
                    add(role, text)
                elif edit == "R":
                    state = _NEXT[state]
                    add("user" if state == USER else "assistant", text)
            if len(out) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], ["name", "repaired_sha256"])
                out = []
        if name is not None:
            inserted()
            out.append((name, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], ["name", "repaired_sha256"])

    both = rows.select("name", "turn", "role", "text", "head", "digest", "uid").unionByName(plans.select("name", "audit"), allowMissingColumns=True)
    ordered = both.repartition("name").sortWithinPartitions("name", F.col("audit").isNull(), *ORDER)
    return ordered.select("name", "audit", "role", "text").mapInArrow(work, "name string, repaired_sha256 string")


def repair(conversations: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each conv_id of `conversations`, as the contract of op11 names them, for rows (conv_id, turn, role, text) to be repaired.

    Rows go by turn (nulls first), then role, text's first 64 characters and digest; a null conv_id is a conversation. A row
    whose role is empty has no initial, so it is illegal beside any other and can't be kept as it is. A conversation
    without rows has zeros, an empty audit and the digest of nothing. Other columns are ignored; an empty table gives no rows.
    """
    prepared(conversations.sparkSession)
    rows = stored(numbered(rows))
    slim = stored(faulty(rows))
    per_turn = slim.groupBy("name", "turn").agg(*[F.count_if(F.col("fault") == i).alias(c) for i, c in ((1, "blank"), (2, "duplicate"), (3, "truncated"))])
    counts = per_turn.groupBy("name").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    blocks = stored(blocks_of(slim, block))
    ends = blocks.filter("whole").select("name", "illegal", F.get("cost", F.lit(0)).alias("cost"), F.get("audit", F.lit(0)).alias("audit"))
    plans = stored(ends.unionByName(blocks.filter("NOT whole").groupBy("name").applyInArrow(_chained, "name string, illegal long, cost long, audit string")))
    names = conversations.groupBy("conv_id").agg(F.lit(1)).select("conv_id", _name(F.col("conv_id")).alias("name"))
    out = names.join(counts, "name", "left").join(plans.join(repaired(rows, plans), "name"), "name", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair(conversations, damaged(conversations))


QUERIES = {"op11_repair": op11_repair}
ORACLES = {
    "op11_repair": """
WITH RECURSIVE
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT o.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS hit FROM o),
r AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM h, (SELECT unnest([0, 1]) AS c) WHERE hit <> 0 AND (c = 0 OR hit = 3)),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, substr(role, 1, 1) AS i FROM r),
f AS MATERIALIZED (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS p, CASE WHEN t = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2 WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM q),
step(state, i, e, then_state, price) AS (VALUES (0, 's', 'K', 1, 0), (0, 'u', 'K', 2, 0), (1, 'u', 'K', 2, 0), (3, 'u', 'K', 2, 0), (2, 'a', 'K', 3, 0), (0, NULL, 'R', 2, 1), (1, NULL, 'R', 2, 1), (3, NULL, 'R', 2, 1), (2, NULL, 'R', 3, 1), (0, NULL, 'D', 0, 2), (1, NULL, 'D', 1, 2), (2, NULL, 'D', 2, 2), (3, NULL, 'D', 3, 2)),
-- Inserting never pays: leaving the insertion out and deleting a row beside it costs less, so it isn't tried.
d(conv_id, n, state, best) AS (
    SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0, 'audit': '', 'end': ''} FROM f
    UNION ALL
    SELECT d.conv_id, d.n + 1, s.then_state, min({'cost': d.best.cost + s.price + CASE WHEN f.fault = 3 AND s.e <> 'D' THEN 5 ELSE 0 END, 'audit': d.best.audit || s.e,
        'end': CASE s.e WHEN 'D' THEN d.best."end" ELSE d.best."end" || CASE WHEN d.best."end" = '' THEN '' ELSE chr(10) END || CASE WHEN s.e = 'K' THEN f.role WHEN s.then_state = 2 THEN 'user' ELSE 'assistant' END || ':' || f.text END})
    FROM d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.n = d.n + 1 JOIN step s ON s.state = d.state AND (s.i IS NULL OR s.i = f.i) AND (s.e = 'D' OR f.fault NOT IN (1, 2))
    GROUP BY d.conv_id, d.n + 1, s.then_state),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (n > 1 AND p || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
z AS (SELECT d.conv_id, min(d.best) AS best FROM d JOIN c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.n = d.n WHERE d.state IN (0, 3) GROUP BY d.conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
    coalesce(best.audit, '') AS audit, sha256(coalesce(best."end", '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id"""
}
