"""Conversation structure repair by signatures.

A conversation's rows are encoded as one character each: the role's initial and what is wrong with
the row. Conversations with the same signature need the same edits, so each distinct signature is
solved once; the audits are joined back and replayed over the rows.

Signature characters: s, u, a for a sound row of that role, o for another role, e for an empty role
(it has no initial, so keeping it changes nothing); the capital where the text is truncated; x for a
blank or repeated row, which must go.

An audit has a letter for each edit: K(eep), R(erole), D(elete), I(nsert). What came before (nothing,
s, u, a: four states) decides which role an insertion or a new role has, so an audit says all.
Insertions stand before the row that they precede, so all audits of the same rows between two states
end with an edit of the last row, and none is the beginning of another. Hence the cheapest audit,
ASCII-least among equals, of two parts is put together from those of the parts: `solved` is a
recursion over halves of a signature, memoised by content.

Long conversations have a signature for each BLOCK rows, and only costs and orders of the blocks
meet in one place. The repaired text is hashed as a stream, in the order of its rows: SHA-256 of a
conversation can't be split, so a conversation is one task's work there, in bounded memory.

Nulls: role and text count as one space. A null turn comes first and a null conv_id is a conversation
of its own. Rows of one turn go by role and text; repeated rows are duplicates. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, arrow_map, prepare

BLOCK = 4096
#: Signatures that the recursion remembers, and their greatest length: longer ones are solved once anyway.
MEMO, REMEMBERED = 1 << 14, 64
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an added or new user and assistant row may come: the state before it -> the state after it.
TURNS = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Insertions that end a conversation well, by its last state.
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: Edits with their roles: i and j insert user and assistant, u and a give those roles, k keeps, d deletes.
EDIT = r"[ij]*[kuad](?:[ij]+$)?"

Best = tuple[int, str] | None


def _kept(kind: str, state: int) -> int | None:
    """The state after a kept row, or None where it can't be kept."""
    if kind == "e":
        return state
    if kind == "s":
        return SYSTEM if state == START else None
    return TURNS[state] if "..ua"[TURNS[state]] == kind else None


def _row(mark: str) -> tuple[Best, ...]:
    """The cheapest audits of one row, at 4 * state before + state after."""
    found: list[Best] = [None] * 16

    def offer(before: int, after: int, cost: int, audit: str) -> None:
        at = 4 * before + after
        if found[at] is None or (cost, audit) < found[at]:
            found[at] = cost, audit

    kind, more = mark.lower(), TRUNCATED * mark.isupper()
    for before in range(4):
        state = before
        for n in range(3):  # more insertions in one place only go round
            offer(before, state, INSERT * n + DELETE, "I" * n + "D")
            if mark != "x":
                offer(before, TURNS[state], INSERT * n + REROLE + more, "I" * n + "R")
                kept = _kept(kind, state)
                if kept is not None:
                    offer(before, kept, INSERT * n + more, "I" * n + "K")
            state = TURNS[state]
    return tuple(found)


def solved(signature: str) -> tuple[Best, ...]:
    """The cheapest audits of a signature, at 4 * state before + state after; None where there is none."""
    return _remembered(signature) if len(signature) <= REMEMBERED else _solved(signature)


def _solved(signature: str) -> tuple[Best, ...]:
    if len(signature) == 1:
        return _row(signature)
    half = len(signature) // 2
    a, b = solved(signature[:half]), solved(signature[half:])
    found = []
    for before in range(4):
        for after in range(4):
            ways = [(x[0] + y[0], x[1] + y[1]) for mid in range(4) if (x := a[4 * before + mid]) and (y := b[4 * mid + after])]
            found.append(min(ways, default=None))
    return tuple(found)


_remembered = lru_cache(MEMO)(_solved)


def whole(signature: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    ends = solved(signature)[:4]
    return min((x[0] + INSERT * len(CLOSING[s]), x[1] + CLOSING[s]) for s, x in enumerate(ends) if x)


def spell(audit: str, marks: str, state: int = START) -> str:
    """The edits of an audit with their roles, one run for each row of the signature `marks`."""
    out, rows = [], iter(marks)
    for edit in audit:
        if edit == "I":
            state = TURNS[state]
            out.append("ij"[state == ASSISTANT])
            continue
        mark = next(rows)
        if edit == "D":
            out.append("d")
        elif edit == "R":
            state = TURNS[state]
            out.append("ua"[state == ASSISTANT])
        else:
            state = _kept(mark.lower(), state)
            out.append("k")
    return "".join(out)


def damaged(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text and others. (c, turn, role, text) after damage by crc32 of `conv_id:turn`; c is the conversation as text, '' for a null one."""
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(name, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    own = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fate.alias("fate"),
    ).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return own.select("c", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def marked(rows: DataFrame) -> DataFrame:
    """rows: (c, turn, role, text). Adds at (from 0 in each c), fault (blank, duplicate, truncated or null), illegal and mark."""
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    same = W.partitionBy("c", "role", "text").orderBy(F.asc_nulls_first("turn"))
    order = W.partitionBy("c").orderBy(F.asc_nulls_first("turn"), "role", "text", "again")
    rows = rows.withColumns({"again": F.row_number().over(same), "initial": F.substring("role", 1, 1)})
    rows = rows.withColumns({
        "fault": F.when(last == "", "blank").when(F.col("again") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated"),
        "before": F.lag("initial").over(order), "at": (F.row_number().over(order) - 1).cast("long"),
    })
    kind = F.when(F.col("initial") == "", "e").when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    return rows.select(
        "c", "turn", "role", "text", "at", "fault",
        (F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")).alias("illegal"),
        F.when(F.col("fault").isNull(), kind).when(F.col("fault") == "truncated", F.upper(kind)).otherwise("x").alias("mark"),
    )


def _solve(signatures: DataFrame) -> DataFrame:
    """signatures: distinct (signature). Adds cost and edits of a whole conversation; costs and orders between states, for blocks of long ones."""

    def kernel(batch: pa.RecordBatch) -> dict:
        names = batch.column("signature").to_pylist()
        ends = [whole(x) for x in names]
        grids = [solved(x) for x in names]
        orders = []
        for g in grids:
            audits = sorted(x[1] for x in g if x)
            orders.append([audits.index(x[1]) if x else -1 for x in g])
        return {
            "signature": names, "cost": [c for c, _ in ends], "audit": [a for _, a in ends], "edits": [spell(a, x) for x, (_, a) in zip(names, ends, strict=True)],
            "costs": [[x[0] if x else -1 for x in g] for g in grids], "orders": orders,
        }

    return arrow_map(signatures, kernel, "signature string, cost long, audit string, edits string, costs array<long>, orders array<long>")


def _path(costs: np.ndarray, orders: np.ndarray) -> tuple[int, list[int]]:
    """The cheapest way through blocks, (n, 16) costs and orders: its cost and 4 * state before + state after for each block."""
    far = np.iinfo(np.int64).max // 4
    costs = np.where(costs < 0, far, costs).reshape(-1, 4, 4)
    orders = orders.reshape(-1, 4, 4)
    ahead = np.array([INSERT * len(CLOSING[s]) for s in range(4)])
    step = np.empty((len(costs), 4), np.int64)
    for i in range(len(costs) - 1, -1, -1):
        total = costs[i] + ahead
        least = total.min(axis=1, keepdims=True)
        step[i] = np.where(total == least, orders[i], far).argmin(axis=1)
        ahead = np.minimum(least[:, 0], far)
    state, way = START, []
    for row in step:
        way.append(int(4 * state + row[state]))
        state = int(row[state])
    return int(ahead[START]), way


def _long(blocks: DataFrame) -> DataFrame:
    """blocks: (c, block, signature, costs, orders) of conversations with several. (c, block, cost, audit, edits); cost is the conversation's."""

    def walk(own):
        own = own.sort_values("block")
        cost, way = _path(np.array(own.costs.tolist(), np.int64), np.array(own.orders.tolist(), np.int64))
        return own[["c", "block", "signature"]].assign(cost=cost, way=way, last=own.block == own.block.max())

    def kernel(batch: pa.RecordBatch) -> dict:
        audits, edits = [], []
        for mark, way, last in zip(*(batch.column(x).to_pylist() for x in ("signature", "way", "last")), strict=True):
            audits.append(solved(mark)[way][1] + (CLOSING[way % 4] if last else ""))
            edits.append(spell(audits[-1], mark, way // 4))
        return {x: batch.column(x) for x in ("c", "block", "cost")} | {"audit": audits, "edits": edits}

    # A group holds 400 bytes for each BLOCK rows of one conversation.
    ways = blocks.groupBy("c").applyInPandas(walk, "c string, block long, signature string, cost long, way int, last boolean")
    return arrow_map(ways, kernel, "c string, block long, cost long, audit string, edits string")


def _digests(lines: DataFrame) -> DataFrame:
    """lines: (c, at, line). (c, repaired_sha256) of each conversation's lines in order, null ones left out, joined by line feeds; a stream in bounded memory."""
    prepare(lines.sparkSession)

    def run(batches):
        own, digest, empty = None, None, True
        for batch in batches:
            names, done = [], []
            for c, line in zip(batch.column("c").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if c != own:
                    if own is not None:
                        names.append(own)
                        done.append(digest.hexdigest())
                    own, digest, empty = c, hashlib.sha256(), True
                if line is not None:
                    digest.update(line.encode() if empty else b"\n" + line.encode())
                    empty = False
            yield pa.record_batch({"c": pa.array(names, pa.string()), "repaired_sha256": pa.array(done, pa.string())})
        if own is not None:
            yield pa.record_batch({"c": pa.array([own], pa.string()), "repaired_sha256": pa.array([digest.hexdigest()], pa.string())})

    ordered = lines.select("c", "at", "line").repartition(F.col("c")).sortWithinPartitions("c", "at")
    return ordered.select("c", "line").mapInArrow(run, "c string, repaired_sha256 string")


def repair(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """rows: (c, turn, role, text), as damaged() gives them; text and role without nulls.

    The lines (c, at, edits, line): each row's edits with their roles, and what the row becomes
    with the rows inserted around it, null where it goes. And the audits, one row for each c:
    (c, gaps, blank, duplicate, truncated, illegal, cost, audit).
    """
    scratch = Scratch(rows.sparkSession, "repair")
    rows = scratch.save(marked(rows), "rows").withColumn("block", F.floor(F.col("at") / block))
    n = lambda what: F.count(F.when(what, 1))
    facts = rows.groupBy("c").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(n(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")), n(F.col("illegal")).alias("illegal"),
    )
    marks = F.array_sort(F.collect_list(F.struct("at", "mark")))
    size = F.count("*").over(W.partitionBy("c"))
    blocks = rows.groupBy("c", "block").agg(F.concat_ws("", F.transform(marks, lambda x: x["mark"])).alias("signature")).withColumn("n_blocks", size)
    blocks = scratch.save(blocks, "blocks")
    known = scratch.save(_solve(blocks.select("signature").distinct()), "solved")
    joined = blocks.join(known, "signature")
    short = joined.where("n_blocks = 1").select("c", "block", "cost", "audit", "edits")
    long = _long(joined.where("n_blocks > 1").select("c", "block", "signature", "costs", "orders"))
    audits = scratch.save(short.unionByName(long), "audits")
    edits = audits.select("c", F.posexplode(F.regexp_extract_all("edits", F.lit(EDIT), F.lit(0))).alias("i", "edits"), "block").select("c", (F.col("block") * block + F.col("i")).alias("at"), "edits")
    new = lambda x: F.when(x == "i", "user:").when(x == "j", "assistant:").when(x == "k", F.concat("role", F.lit(":"), "text")).when(x == "u", F.concat(F.lit("user:"), "text")).when(x == "a", F.concat(F.lit("assistant:"), "text"))
    made = F.filter(F.transform(F.split("edits", ""), new), lambda x: x.isNotNull())
    lines = rows.join(edits, ["c", "at"]).select("c", "at", "edits", F.when(F.size(made) > 0, F.array_join(made, "\n")).alias("line"))
    parts = F.array_sort(F.collect_list(F.struct("block", "audit")))
    total = audits.groupBy("c").agg(F.max("cost").alias("cost"), F.concat_ws("", F.transform(parts, lambda x: x["audit"])).alias("audit"))
    return lines, facts.join(total, "c")


def repair_damaged(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conversations: conv_id, turn, role, text and others. One row for each conv_id, null included: what is wrong with its damaged rows, the cheapest repair and the hash of its result."""
    lines, audits = repair(damaged(conversations), block)
    every = conversations.select("conv_id").distinct().withColumn("c", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    found = every.join(audits, "c", "left").join(_digests(lines), "c", "left")
    zero = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
