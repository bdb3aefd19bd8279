"""Conversation repair against a plain search over edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from hitlake.llm import repair

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "a": "u", "u": "a"}
FULL = {"u": "user", "a": "assistant"}


def searched(rows):
    """rows: (role, must go, truncated). Cheapest (cost, audit) by a uniform-cost search over edit strings."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit
        if (i, last, audit) in seen or audit.endswith("III"):
            continue
        seen.add((i, last, audit))
        heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[last]))
        if i < len(rows):
            role, gone, short = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last))
            if not gone:
                heapq.heappush(heap, (cost + 2 + short, audit + "R", i + 1, NEXT[last]))
                first = role[:1]
                if first == "" or (first == "s" and last == "") or first == NEXT[last]:
                    heapq.heappush(heap, (cost + short, audit + "K", i + 1, first or last))
    raise AssertionError


def replayed(rows, audit):
    out, i, last = [], 0, ""
    for e in audit:
        if e == "I":
            last = NEXT[last]
            out.append(FULL[last] + ":")
            continue
        role, text = rows[i]
        i += 1
        if e == "R":
            last = NEXT[last]
            out.append(f"{FULL[last]}:{text}")
        elif e == "K":
            last = role[:1] or last
            out.append(f"{role}:{text}")
    return "\n".join(out)


def plain(table):
    """table: (conv_id, turn, role, text). conv_id -> the contract's columns."""
    found = {}
    for own in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in table:
            if c != own:
                continue
            name = ":".join(" " if x is None else str(x) for x in (c, turn))
            role, text = (" " if x is None else x for x in (role, text))
            fate = zlib.crc32(name.encode()) % 20
            if fate == 0:
                continue
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            rows += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in rows if r[0] is not None]
        seen, faults, marks = set(), [], []
        for _, role, text in rows:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            marks.append((role, fault in ("blank", "duplicate"), fault == "truncated"))
        initials = [r[1][:1] for r in rows]
        cost, audit = searched(marks)
        fixed = replayed([r[1:] for r in rows], audit)
        found[own] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256(fixed.encode()).hexdigest(),
        )
    return found


def given(spark, table):
    rows = [(*r, "x", "y", 1) for r in table]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, c string, mark string, at int")


def found(frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


def invented(seed, n, longest):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None], ["Yes.", "No", "so it is!", " \n", "", "Why? \t", None, "é", "a.b"]
    table = []
    for c in range(n):
        for t in range(rng.randrange(longest)):
            table.append((c, rng.choice([t, t, t, t + 1, None]), rng.choice(roles), rng.choice([*texts, f"text {t}."])))
    return table


@pytest.mark.parametrize("mark", ["".join(x) for n in (1, 2, 3) for x in itertools.product("suaeUAox", repeat=n)][::7])
def test_signatures(mark):
    role = {"o": "tool", "e": "", "x": "user"}
    rows = [(role.get(m.lower(), m.lower()), m == "x", m.isupper()) for m in mark]
    assert repair.whole(mark) == searched(rows)


@pytest.mark.parametrize("block", [3, 4096])
def test_against_search(spark, block):
    table = invented(5, 60, 9)
    assert found(repair.repair_damaged(given(spark, table), block)) == plain(table)


def test_halves_and_memo_agree():
    rng = random.Random(1)
    mark = "".join(rng.choice("suaUAxo") for _ in range(200))
    forward = {0: (0, "")}
    for m in mark:  # row by row instead of by halves
        grid = repair.solved(m)
        forward = {t: min((c + g[0], a + g[1]) for s, (c, a) in forward.items() if (g := grid[4 * s + t])) for t in range(4) if any(grid[4 * s + t] for s in forward)}
    assert repair.whole(mark) == min((c + 2 * len(repair.CLOSING[s]), a + repair.CLOSING[s]) for s, (c, a) in forward.items())


def test_long_conversation_in_blocks(spark):
    rng = random.Random(3)
    table = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"{t}."])) for t in range(700)]
    one, many = (found(repair.repair_damaged(given(spark, table), b)) for b in (4096, 16))
    assert one == many and one[1][5] > 0


def test_edges(spark):
    table = [(None, None, None, None), (None, 3, "user", "Hi."), (7, 1, "user", "same."), (7, 1, "user", "same."), (8, 5, "", "kept."), (9, 1, "user", "long " * 50_000 + ".")]
    assert found(repair.repair_damaged(given(spark, table))) == plain(table)
    assert repair.repair_damaged(given(spark, [])).count() == 0


def test_dropped_conversation(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    row = repair.repair_damaged(given(spark, [(gone, 1, "user", "Hi.")])).first()
    assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
