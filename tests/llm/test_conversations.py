"""Conversation repair against plain Python, whole and in blocks."""

from __future__ import annotations

import random
import re
import zlib
from hashlib import sha256
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import conversations, queries

FOLDER = Path("/root/testdata/sf0.001")
SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\f\r"


def damaged(rows):
    """By conversation the rows after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        names = [" " if x is None else str(x) for x in (conv, turn)]
        draw = zlib.crc32(":".join(names).encode()) % 20
        own = out.setdefault(conv, [])
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        own += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {conv: sorted(own, key=order) for conv, own in out.items()}


def best(rows, faults):
    """(cost, audit, repaired lines), by trying every edit at every place; the least string of each state."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    now = {"": (0, "", ())}

    def moves(held, i):
        _, role, text = rows[i]
        for state, (cost, audit, lines) in held:
            yield state, (cost + 4, audit + "D", lines)
            if faults[i] in ("blank", "duplicate"):
                continue
            cost += 3 * (faults[i] == "truncated")
            if role[:1] and role[:1] in legal[state]:
                yield role[:1], (cost, audit + "K", (*lines, f"{role}:{text}"))
            name = "assistant" if state == "u" else "user"
            yield name[0], (cost + 3, audit + "R", (*lines, f"{name}:{text}"))

    def every_insertion(states):
        for state, held in states.items():
            yield state, held
            for n in range(1, 4):
                cost, audit, lines = held
                at = state
                for _ in range(n):
                    name = "assistant" if at == "u" else "user"
                    cost, audit, lines, at = cost + 3, audit + "I", (*lines, f"{name}:"), name[0]
                yield at, (cost, audit, lines)

    for i in range(len(rows)):
        after = {}
        for state, found in moves(list(every_insertion(now)), i):
            if state not in after or found < after[state]:
                after[state] = found
        now = after
    return min(found for state, found in every_insertion(now) if state in ("", "a"))


def facts(rows):
    seen, counts = set(), [0, 0, 0]
    faults = []
    for _, role, text in rows:
        bare = text.strip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, lines = best(rows, faults)
    return (gaps, *counts, illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())


def got(frame):
    rows = frame.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def invented(seed, n, longest):
    draw, rows = random.Random(seed), []
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "u", None]
    texts = ["Yes.", "no", " ", "", "What?", "Well \n", "é!", None, "a.b", "x" * 5000 + "."]
    for conv in range(n):
        for i in range(draw.randint(1, longest)):
            turn = draw.choice([i, i, i, i + 1, None])
            text = draw.choice(texts) if draw.random() < 0.4 else f"t{draw.randrange(30)}."
            rows.append((conv if conv else None, turn, draw.choice(roles), text))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("spill", [conversations.SPILL, 3])
def test_repair_against_all_edits(spark, spill):
    rows = invented(3, 150, 12)
    frame = conversations.damaged(spark.createDataFrame(rows, SCHEMA))
    want = {conv: facts(own) for conv, own in damaged(rows).items()}
    assert got(conversations.repaired(frame, spill)) == want
    assert any("I" in w[6] for w in want.values()) and any("R" in w[6] for w in want.values())
    assert any(w[6] == "" for w in want.values())


def test_many_turns_in_batches(spark):
    """A conversation over many Arrow batches and blocks, with a third of all rows beside small ones."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i % 9_000}.") for i in range(25_000)]
    rows += [(2 + i // 3, i % 3, "user", "a.") for i in range(3_000)]
    frame = conversations.damaged(spark.createDataFrame(rows, SCHEMA))
    want = {conv: facts(own) for conv, own in damaged(rows).items() if conv > 1}
    found = got(conversations.repaired(frame, 1_000))
    whole = got(conversations.repaired(frame))
    assert found == whole
    assert {conv: x for conv, x in found.items() if conv > 1} == want
    assert len(found[1][6]) > 20_000


def test_digests_seen_before(monkeypatch):
    monkeypatch.setattr(conversations, "RECENT", 10)
    draw, seen, known = random.Random(1), conversations.Seen(), set()
    for _ in range(2_000):
        digest = draw.randrange(400).to_bytes(16, "little")
        assert seen.add(digest) == (digest in known)
        known.add(digest)


def test_defined_cases(spark):
    empty = conversations.repaired(conversations.damaged(spark.createDataFrame([], SCHEMA)))
    assert empty.count() == 0
    rows = [(1, 1, "user", "Hi.", "x"), (1, 2, "assistant", "Ho.", "x")]
    frame = spark.createDataFrame(rows, f"{SCHEMA}, conv string")
    gone = frame.withColumn("gone", F.lit(True))
    assert got(conversations.repaired(gone)) == {1: (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())}
    extremes = [(1, -(2**63), "user", "Hi."), (1, 2**63 - 1, "assistant", "Ho.")]
    wide = spark.createDataFrame(extremes, SCHEMA).withColumn("gone", F.lit(False))
    assert got(conversations.repaired(wide))[1][0] == 2**63 - 1
    clashing = frame.withColumns({c: F.lit("clash") for c in ("gone", "turns", "draw", "times", "block", "audit", "_at")})
    assert got(conversations.repaired(conversations.damaged(clashing))) == got(conversations.repaired(conversations.damaged(frame)))


@pytest.mark.skipif(not FOLDER.exists(), reason="generated tables not present")
def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {conv: facts(own) for conv, own in damaged(rows).items()}
    assert got(queries.op13_conversation_repair(spark, str(FOLDER))) == want
