"""Repair the structure of conversations at the least cost.

Conversations are dealt to partitions whole and sorted by turn, and stream through
mapInPandas. What is carried from row to row, and from one Arrow batch to the next, is
the state of a shortest-path search over the repaired roles, which read (s?(ua)+)? by
their initials: nothing yet, a system turn, a user turn, an assistant turn. For each of
the four it holds the least cost, a rank that orders the audits so far as strings, and
the running hash of the repaired text. Audits that have passed the same rows and end in
no insertion are never beginnings of each other, so ranks alone settle ties. Steps
depend on few cases and are compiled when first met.

How each state was reached goes into three bytes a row. A conversation of over SPILL
rows hands these out in blocks, as rows of their own, which Spark shuffles back to it in
reverse; a second stream walks them from the end. So a giant conversation costs one task
a stream through it, 16 bytes for each different row (to know repeated ones), and last
its audit.

Rows with the same turn are ordered by role and text, a null turn comes first, and
null fields read as one space. Null is a conversation id like any other. A conversation
that loses all rows keeps its id, with zeros, an empty audit and the hash of nothing. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlens.llm.text import SPACES, partitions
from fleetlens.session import ensure_checkpoint_dir

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
CUT_SHORT = 3
SPILL = 65_536
RECENT = 100_000
FAULTS = 20
LARGEST = 2**63 - 1

# What the repaired roles end in.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
FOLLOWS = {
    NOTHING: {"s": SYSTEM, "u": USER},
    SYSTEM: {"u": USER},
    USER: {"a": ASSISTANT},
    ASSISTANT: {"u": USER},
}
LEGAL = {"su", "ua", "au"}
# What up to two insertions lead to; more come back to a state at a higher cost.
INSERTED = {
    NOTHING: (NOTHING, USER, ASSISTANT),
    SYSTEM: (SYSTEM, USER, ASSISTANT),
    USER: (USER, ASSISTANT),
    ASSISTANT: (ASSISTANT, USER),
}
# Insertions that are still due at the end.
DUE = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
LETTERS = "DKR"
NONE = 0x3F

Case = tuple[str, bool, bool]
Vector = tuple[tuple[int, int] | None, ...]


class Steps(dict):
    """From (costs and ranks by state, case) to the next ones, the cost taken out of
    them, the way to each state as (state before, insertions, letter), and its bytes."""

    def __missing__(self, key: tuple[Vector, Case]) -> tuple:
        vector, (initial, delete, cut_short) = key
        best: dict[int, tuple] = {}
        for before, held in enumerate(vector):
            if held is None:
                continue
            cost, rank = held
            for inserted, at in enumerate(INSERTED[before]):
                price = cost + INSERT * inserted
                ways = [(at, price + DELETE, "D")]
                if not delete:
                    price += CUT_SHORT * cut_short
                    if initial in FOLLOWS[at]:
                        ways.append((FOLLOWS[at][initial], price + KEEP, "K"))
                    ways.append((ASSISTANT if at == USER else USER, price + REROLE, "R"))
                for after, total, letter in ways:
                    way = (total, rank, "I" * inserted + letter, before)
                    if after not in best or way < best[after]:
                        best[after] = way
        least = min(way[0] for way in best.values())
        order = sorted(best, key=lambda state: best[state][1:])
        after: list = [None] * 4
        ways: list = [None] * 4
        code = 0
        for state in range(4):
            six = NONE
            if state in best:
                total, _, letters, before = best[state]
                after[state] = (total - least, order.index(state))
                ways[state] = (before, len(letters) - 1, letters[-1])
                six = before << 4 | (len(letters) - 1) << 2 | LETTERS.index(letters[-1])
            code |= six << 6 * state
        found = self[key] = (tuple(after), least, tuple(ways), code.to_bytes(3, "little"))
        return found


class Seen:
    """Digests met before: the latest in a set, all others in sorted arrays."""

    def __init__(self):
        self.recent: set[bytes] = set()
        self.first = self.second = np.zeros(0, np.uint64)

    def add(self, digest: bytes) -> bool:
        """Whether it was there already."""
        if digest in self.recent or self._stored(digest):
            return True
        self.recent.add(digest)
        if len(self.recent) >= RECENT:
            pairs = np.frombuffer(b"".join(self.recent), np.uint64).reshape(-1, 2)
            first, second = np.concatenate([self.first, pairs[:, 0]]), np.concatenate([self.second, pairs[:, 1]])
            order = np.argsort(first, kind="stable")
            self.first, self.second = first[order], second[order]
            self.recent = set()
        return False

    def _stored(self, digest: bytes) -> bool:
        if not len(self.first):
            return False
        first, second = np.frombuffer(digest, np.uint64)
        a, b = np.searchsorted(self.first, first, "left"), np.searchsorted(self.first, first, "right")
        return bool((self.second[a:b] == second).any())


def walked_back(state: int, ways: bytes) -> tuple[int, list[str]]:
    """The state before some rows, and the letters of the way from it, the last first."""
    out = []
    for i in range(len(ways) - 3, -1, -3):
        six = int.from_bytes(ways[i : i + 3], "little") >> 6 * state & 0x3F
        out.append("I" * (six >> 2 & 3) + LETTERS[six & 3])
        state = six >> 4
    return state, out


class Conversation:
    """One conversation, row after row."""

    def __init__(self, steps: Steps):
        self.steps = steps
        self.vector: Vector = ((0, 0), None, None, None)
        self.cost = 0
        self.hashes = [hashlib.sha256(), None, None, None]
        self.ways = bytearray()
        self.rows = self.blocks = 0
        self.seen = Seen()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None
        self.turns: list[int] = []  # the first, the last and the number of different ones

    def add(self, turn: str | None, role: str, text: str) -> None:
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        if turn is not None:
            now = int(turn)
            if not self.turns:
                self.turns = [now, now, 1]
            elif now != self.turns[1]:
                self.turns[1:] = [now, self.turns[2] + 1]
        line = f"{role}:{text}".encode("utf-8", "surrogatepass")
        own = hashlib.blake2b(f"{len(role)}:".encode() + line, digest_size=16).digest()
        repeated = self.seen.add(own)
        inside = text.strip(SPACES)
        blank = not inside
        repeated = repeated and not blank
        cut_short = not blank and not repeated and inside[-1] not in ".!?"
        self.blank += blank
        self.duplicate += repeated
        self.truncated += cut_short
        case = (initial if initial in ("s", "u", "a") else "", blank or repeated, cut_short)
        vector, least, ways, code = self.steps[self.vector, case]
        hashes: list = [None] * 4
        for state, way in enumerate(ways):
            if way is not None:
                before, inserted, letter = way
                made = self.hashes[before].copy()
                at = before
                for _ in range(inserted):
                    at = self._insert(made, at)
                if letter == "K":
                    made.update(line if at == NOTHING else b"\n" + line)
                elif letter == "R":
                    other = f"{ROLES[state]}:{text}".encode("utf-8", "surrogatepass")
                    made.update(other if at == NOTHING else b"\n" + other)
                hashes[state] = made
        self.vector, self.hashes = vector, hashes
        self.cost += least
        self.ways += code
        self.rows += 1

    @staticmethod
    def _insert(made, at: int) -> int:
        after = ASSISTANT if at == USER else USER
        made.update(f"{'' if at == NOTHING else chr(10)}{ROLES[after]}:".encode())
        return after

    def block(self, least: int) -> bytes | None:
        """The ways of the latest rows, if there are so many; they are forgotten here."""
        if len(self.ways) < 3 * least:
            return None
        out, self.ways = bytes(self.ways), bytearray()
        self.blocks += 1
        return out

    def ended(self) -> tuple[dict, int, str]:
        """The facts of the whole conversation, the last state, and the letters after it."""
        held = [(h[0] + INSERT * DUE[s], h[1], s) for s, h in enumerate(self.vector) if h is not None]
        cost, _, state = min(held)
        made = self.hashes[state].copy()
        at = state
        for _ in range(DUE[state]):
            at = self._insert(made, at)
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        facts = {
            "gaps": min(gaps, LARGEST),
            "blank": self.blank,
            "duplicate": self.duplicate,
            "truncated": self.truncated,
            "illegal": self.illegal,
            "cost": self.cost + cost,
            "repaired_sha256": made.hexdigest(),
        }
        return facts, state, "I" * DUE[state]


FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, repaired_sha256 string"
# block is the number of blocks on the row that ends a conversation.
STREAMED = f"conv string, block long, ways binary, state int, {FACTS}, audit string"
STREAMED_NAMES = [field.split()[0] for field in STREAMED.split(", ")]


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([[row.get(c) for c in STREAMED_NAMES] for row in rows], columns=STREAMED_NAMES, dtype=object)


def streamed(rows: DataFrame, spill: int = SPILL) -> DataFrame:
    """Blocks of ways and, for each conversation, a row with its facts.

    rows are (conv, turn, role, text, gone), those of a conversation together and in
    order; turn is written out, and gone rows only keep the conversation's id.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, held, known = Steps(), None, False
        name = None

        def finished() -> dict:
            facts, state, letters = held.ended()
            row = {"conv": name, "block": held.blocks, "ways": bytes(held.ways), "state": state} | facts
            if not held.blocks:
                _, way = walked_back(state, bytes(held.ways))
                row |= {"ways": None, "audit": "".join(reversed(way)) + letters}
            return row

        for batch in batches:
            out = []
            for conv, turn, role, text, gone in batch[["conv", "turn", "role", "text", "gone"]].itertuples(index=False, name=None):
                conv, turn = (None if pd.isna(x) else x for x in (conv, turn))
                if not known or conv != name:
                    if known:
                        out.append(finished())
                    held, known, name = Conversation(steps), True, conv
                if not gone:
                    held.add(turn, role, text)
                    ways = held.block(spill)
                    if ways is not None:
                        out.append({"conv": name, "block": held.blocks - 1, "ways": ways})
            yield _frame(out)
        if known:
            yield _frame([finished()])

    return rows.mapInPandas(run, STREAMED)


def walked(blocks: DataFrame) -> DataFrame:
    """The facts and audits of conversations in several blocks, streamed from the end."""
    n = partitions(blocks)
    schema = to_arrow_schema(blocks.schema)
    ordered = blocks.repartition(n, "conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.desc("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, state, letters = None, 0, []

        def finished() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([row | {"ways": None, "audit": "".join(reversed(letters))}], schema)

        for batch in batches:
            for found in batch.to_pylist():
                if found["repaired_sha256"] is not None:
                    if row is not None:
                        yield finished()
                    row, state = found, found["state"]
                    letters = ["I" * DUE[state]]
                state, way = walked_back(state, found["ways"])
                letters += way
        if row is not None:
            yield finished()

    return ordered.mapInArrow(run, STREAMED)


def repaired(conversations: DataFrame, spill: int = SPILL) -> DataFrame:
    """(conv_id, the facts, audit), one row for each conv_id.

    conversations are (conv_id, turn, role, text), and gone, which marks rows that are
    not there but for their conversation's id.
    """
    ensure_checkpoint_dir(conversations.sparkSession)
    n = partitions(conversations)
    kind = conversations.schema["conv_id"].dataType
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    rows = conversations.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").alias("_at"),
                                F.col("turn").cast("string").alias("turn"), text("role"), text("text"), "gone")
    first = lambda name: F.col(name).asc_nulls_first()
    ordered = rows.repartition(n, "conv").sortWithinPartitions(first("conv"), first("_at"), "role", "text").drop("_at")
    found = streamed(ordered, spill).checkpoint()
    whole = found.filter(F.col("audit").isNotNull())
    every = whole.unionByName(walked(found.filter(F.col("audit").isNull())))
    return every.select(F.col("conv").cast(kind).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _draw() -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    return F.crc32(F.concat(parts[0], F.lit(":"), parts[1]).cast("binary")) % FAULTS


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) with faults drawn by conversation and turn.

    Of twenty rows one is dropped (gone), one emptied, one loses its sentence ends, one
    is repeated, and one is given to the user.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    drawn = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), _draw().alias("draw"))
    draw = F.col("draw")
    changed = drawn.select(
        "conv_id",
        "turn",
        F.when(draw == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(draw.isin(0, 1), F.lit("")).when(draw == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (draw == 0).alias("gone"),
        F.when(draw == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("times"),
    )
    return changed.select("conv_id", "turn", "role", "text", "gone", F.explode("times")).drop("col")
