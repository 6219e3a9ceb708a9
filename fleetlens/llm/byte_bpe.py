"""Byte-level BPE: encode texts to ids, keep where each token starts, and decode.

Pre-tokenisation uses no regular expression. Code points are mapped to classes, and a
small automaton over the classes marks where a token starts. A character acts on the
automaton as a function from state to state; such functions compose associatively. So
a batch of texts is cut into blocks, the functions of all blocks are composed at once
character by character, a doubling scan over the blocks gives the state at the start of
each, and a second pass marks the boundaries. The slices between them go through pair
merging once and then come from a cache.

Null and empty texts have no ids and decode to no bytes. Every row is encoded by
itself, so repeated rows have equal results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from fleetlens.llm.batches import Columns, with_columns

CACHED_PIECES = 150_000
LONGEST_CACHED = 64
SHORT_PIECE = 48
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"

# Code points that count as white space in the pre-tokenisation pattern.
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# What may follow an apostrophe as a token of its own.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

LETTER, NUMBER, OTHER, BLANK, WHITE = range(5)
# What the automaton reads. A last blank or white is followed by a character that is none.
S_LETTER, S_NUMBER, S_OTHER, S_LAST_BLANK, S_LAST_WHITE, S_WHITE, S_ENDS_IN_1, S_ENDS_IN_2, S_NOTHING = range(9)
SYMBOLS = 9
# Its states: a new token starts; a blank waits for its token; inside a token of some
# class; inside white space; one or two letters of an ending are to come.
NEW, WAITS, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, ONE_MORE, TWO_MORE = range(8)
STATES = 8
# The symbol of a class, if followed by white space or the end, or by something else.
READ = np.array(
    [[S_LETTER, S_NUMBER, S_OTHER, S_WHITE, S_WHITE], [S_LETTER, S_NUMBER, S_OTHER, S_LAST_BLANK, S_LAST_WHITE]], np.uint8
)
GROUP = 3
BLOCK = 64
# Characters of a text that are looked at together, and how far a symbol looks ahead.
WINDOW = 400_000
AHEAD = 3
# Tokens decoded at once.
DECODED = 100_000


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for point in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = NUMBER
    table[list(WHITE_SPACE)] = WHITE
    table[32] = BLANK
    return table


def _step(symbol: int, state: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at the character."""
    if symbol == S_NOTHING:
        return state, False
    if symbol == S_LETTER:
        if state in (ONE_MORE, TWO_MORE):
            return (ONE_MORE if state == TWO_MORE else NEW), False
        return IN_LETTERS, state not in (WAITS, IN_LETTERS)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (WAITS, IN_NUMBERS)
    if symbol == S_LAST_BLANK:
        return WAITS, True
    if symbol == S_LAST_WHITE:
        return NEW, True
    if symbol == S_WHITE:
        return IN_WHITE, state != IN_WHITE
    if symbol in (S_ENDS_IN_1, S_ENDS_IN_2) and state not in (WAITS, IN_OTHERS):
        return (ONE_MORE if symbol == S_ENDS_IN_1 else TWO_MORE), True
    return IN_OTHERS, state not in (WAITS, IN_OTHERS)


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and start marks for GROUP symbols at a time.

    Both are flat, at group * STATES + state, where a group is its symbols as digits.
    Symbols of a text's first character, which ignore the state, come after the others.
    """
    after = np.zeros((2 * SYMBOLS, STATES), np.uint8)
    starts = np.zeros((2 * SYMBOLS, STATES), np.uint8)
    for symbol in range(SYMBOLS):
        for state in range(STATES):
            after[symbol, state], starts[symbol, state] = _step(symbol, state)
            after[SYMBOLS + symbol, state], starts[SYMBOLS + symbol, state] = _step(symbol, NEW)
    states, marks = after, starts
    for _ in range(GROUP - 1):
        marks = marks[:, None, :] * 2 + starts[:, states].transpose(1, 0, 2)
        states = after[:, states].transpose(1, 0, 2)
        states, marks = states.reshape(-1, STATES), marks.reshape(-1, STATES)
    return np.ascontiguousarray(states).ravel(), np.ascontiguousarray(marks).ravel()


def symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """What the automaton reads for each code point of texts that start at `firsts`."""
    kinds = class_table()[points]
    last = np.zeros(len(points), bool)
    last[firsts[1:] - 1] = True
    last[-1:] = True
    space = kinds >= BLANK
    before_other = np.zeros(len(points), bool)
    before_other[:-1] = ~space[1:]
    before_other &= ~last
    out = READ[before_other.view(np.uint8), kinds]
    marks = np.flatnonzero(points == ord("'"))
    if len(marks):
        padded = np.append(points, [0, 0])
        ends = np.append(np.flatnonzero(last), len(points))
        room = ends[np.searchsorted(ends, marks)] - marks
        for ending in ENDINGS:
            fits = room >= len(ending)
            for place, letter in enumerate(ending, 1):
                fits &= padded[marks + place] == ord(letter)
            out[marks[fits]] = S_ENDS_IN_1 if len(ending) == 1 else S_ENDS_IN_2
    out[firsts] += SYMBOLS
    return out


def token_starts(read: np.ndarray, before: int = NEW) -> tuple[np.ndarray, int]:
    """Positions at which tokens start, by scans of transition functions; and the state after.

    before is the state that the first symbol meets.
    """
    after, marked = automaton()
    n, span = len(read), BLOCK * GROUP
    blocks = -(-n // span)
    padded = np.full(blocks * span, S_NOTHING, np.intp)
    padded[:n] = read
    groups = np.zeros(blocks * BLOCK, np.intp)
    for i in range(GROUP):
        groups = groups * (2 * SYMBOLS) + padded[i::GROUP]
    # Row j of the grid holds the j-th group of every block, as an offset into the tables.
    grid = np.ascontiguousarray(groups.reshape(blocks, BLOCK).T) * STATES
    functions = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
    for row in grid:
        functions = after.take(row[:, None] + functions)
    reach = 1
    while reach < blocks:
        composed = np.take_along_axis(functions[reach:], functions[:-reach].astype(np.intp), axis=1)
        functions = np.concatenate([functions[:reach], composed])
        reach *= 2
    state = np.concatenate([[before], functions[:-1, before]]).astype(np.uint8)
    marks = np.empty((blocks, BLOCK), np.uint8)
    for j, row in enumerate(grid):
        at = row + state
        marks[:, j] = marked.take(at)
        state = after.take(at)
    bits = np.unpackbits(marks.ravel()[:, None], axis=1)[:, 8 - GROUP :]
    return np.flatnonzero(bits.ravel()[:n]), int(functions[-1, before])


def pieces(texts: list[str]) -> list[list[str]]:
    """The pre-tokens of each text."""
    filled = [t for t in texts if t]
    if not filled:
        return [[] for _ in texts]
    joined = "".join(filled)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, filled), np.int64, len(filled))
    ends = np.cumsum(lengths)
    starts, _ = token_starts(symbols(points, ends - lengths))
    cut = np.searchsorted(starts, ends).tolist()
    bounds = [*starts.tolist(), len(joined)]
    found = [joined[a:b] for a, b in zip(bounds, bounds[1:])]
    out, start, n = [], 0, 0
    for t in texts:
        if not t:
            out.append([])
            continue
        out.append(found[start : cut[n]])
        start, n = cut[n], n + 1
    return out


def pieces_in_windows(text: str, window: int = WINDOW) -> Iterator[list[str]]:
    """The pre-tokens of one long text, those of some characters at a time.

    The automaton goes on from window to window in the state it was left in; a symbol
    depends on the characters after it, AHEAD at most.
    """
    state, begun = NEW, 0
    for at in range(0, len(text), window):
        points = np.frombuffer(text[at : at + window + AHEAD].encode("utf-32-le", "surrogatepass"), np.uint32)
        firsts = np.zeros(0 if at else 1, np.int64)
        starts, state = token_starts(symbols(points, firsts)[:window], state)
        bounds = [begun, *(starts[starts + at > begun] + at).tolist()]
        yield [text[a:b] for a, b in zip(bounds, bounds[1:])]
        begun = bounds[-1]
    yield [text[begun:]] if begun < len(text) else []


class Vocabulary:
    """The ranks of a file, pair merging, and a cache of merged pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        by_id = sorted((rank, token) for token, rank in self.ranks.items())
        self.lengths = np.zeros(by_id[-1][0] + 1, np.int64)
        for rank, token in by_id:
            self.lengths[rank] = len(token)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(token for _, token in by_id), np.uint8)
        self.merged: dict[str, bytes] = {}

    def _merge_short(self, piece: bytes) -> list[bytes]:
        """Merge the pair of lowest rank, the leftmost of equal ones, until none is left."""
        ranks, none = self.ranks, len(self.lengths)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        order = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while order:
            best = min(order)
            if best == none:
                break
            i = order.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del order[i]
            if i:
                order[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(order):
                order[i] = ranks.get(parts[i] + parts[i + 1], none)
        return parts

    def _merge_long(self, piece: bytes) -> list[bytes]:
        """The same with a heap of pairs, for pieces of any length."""
        ranks = self.ranks
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(ranks[a + b], i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j == len(parts) or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else len(parts)
                if right < len(parts) and (pair := parts[left] + parts[right]) in ranks:
                    heapq.heappush(heap, (ranks[pair], left, pair))
        return [p for p in parts if p is not None]

    def merge(self, piece: str) -> bytes:
        """The ids of a pre-token, as little-endian unsigned 32-bit integers."""
        raw = piece.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            return whole.to_bytes(4, "little")
        parts = self._merge_short(raw) if len(raw) <= SHORT_PIECE else self._merge_long(raw)
        return np.array([self.ranks[p] for p in parts], "<u4").tobytes()

    def ids(self, found: list[str]) -> bytes:
        cache, out = self.merged, []
        for piece in found:
            packed = cache.get(piece)
            if packed is None:
                packed = self.merge(piece)
                if len(piece) <= LONGEST_CACHED:
                    if len(cache) >= CACHED_PIECES:
                        cache.clear()
                    cache[piece] = packed
            out.append(packed)
        return b"".join(out)

    def starts(self, packed: bytes) -> np.ndarray:
        """The byte at which each token starts, and last the number of bytes."""
        return np.concatenate([[0], np.cumsum(self.lengths[np.frombuffer(packed, "<u4")])])

    def decoded(self, packed: bytes) -> Iterator[bytes]:
        """The bytes of the ids, some tokens at a time."""
        for at in range(0, len(packed), 4 * DECODED):
            part = packed[at : at + 4 * DECODED]
            ids, starts = np.frombuffer(part, "<u4"), self.starts(part)
            yield self.bytes[np.arange(starts[-1]) + np.repeat(self.offsets[ids] - starts[:-1], self.lengths[ids])].tobytes()

    def decode(self, packed: bytes) -> bytes:
        return b"".join(self.decoded(packed))

    def encoded(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        if len(texts) == 1 and len(texts[0]) > WINDOW:
            return [b"".join(self.ids(found) for found in pieces_in_windows(texts[0]))]
        return [self.ids(found) for found in pieces(texts)]


def _decoded_sha256(known: Vocabulary, packed: bytes) -> str:
    made = hashlib.sha256()
    for part in known.decoded(packed):
        made.update(part)
    return made.hexdigest()


def _digests(known: Vocabulary, packed: list[bytes]) -> Columns:
    return [
        [len(p) // 4 for p in packed],
        [hashlib.sha256(p).hexdigest() for p in packed],
        [_decoded_sha256(known, p) for p in packed],
    ]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(docs: DataFrame, path: str, *carried: str) -> DataFrame:
    """The carried columns, ids and starts: the first byte of each token in the UTF-8 text."""

    def make(texts: list[str]) -> Columns:
        known = vocabulary(path)
        packed = known.encoded(texts)
        return [[np.frombuffer(p, "<u4") for p in packed], [known.starts(p)[:-1] for p in packed]]

    return with_columns(docs, "ids array<int>, starts array<long>", make, *carried)


def decoded(rows: DataFrame, path: str, *carried: str) -> DataFrame:
    """The carried columns and the text of the ids, which may start or end inside a character."""

    def run(batches):
        import pyarrow as pa

        known = vocabulary(path)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            texts = [known.decode(np.array(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in lists]
            kept = [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], [*carried, "text"])

    chosen = rows.select(*carried, "ids")
    schema = chosen.drop("ids").schema.add("text", "string")
    return chosen.mapInArrow(run, schema)


def encoded_with_digests(docs: DataFrame, path: str, *carried: str) -> DataFrame:
    """The carried columns, ids, and the columns of `digests`."""

    def make(texts: list[str]) -> Columns:
        known = vocabulary(path)
        packed = known.encoded(texts)
        return [[np.frombuffer(p, "<u4") for p in packed], *_digests(known, packed)]

    return with_columns(docs, f"ids array<int>, {DIGESTS}", make, *carried)


def digests(docs: DataFrame, path: str, *carried: str) -> DataFrame:
    """The carried columns, n_tokens, and the SHA-256 of the ids and of what they decode to."""

    def make(texts: list[str]) -> Columns:
        known = vocabulary(path)
        return _digests(known, known.encoded(texts))

    return with_columns(docs, DIGESTS, make, *carried)
