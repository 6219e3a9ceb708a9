"""Count the tokens of a piece vocabulary without making them.

The vocabulary is compiled, as far as texts need it, into a deterministic transducer
whose transitions say how many tokens they emit. Its state holds every place at which
a token may still be open: the letters read since, the token before, and how many
tokens that is ahead of those emitted. A token may follow another if merging the two
together gives back just these two; with that, the last token of every prefix is
determined, and a token counts as emitted once no open place is before it.

No piece goes across the start of a run of spaces, so there the transducer is back in
its first state. The map of a chunk of text (what the state before it still reads, the
count of what lies between its first and last such start, what is left open) therefore
composes associatively with the next one's. What is open stays in parts until a start
closes it, so the transducer reads each character once, also where a text has no spaces.
The maps of a text's chunks are combined in pairs; a doubling scan of them tells the
tokens before each chunk. Short words met before come from a cache.

Null and empty texts have no tokens. Every row is counted by itself, so repeated rows
have equal results.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.batches import Columns, with_columns
from fleetlens.llm.text import whole

LIMIT = 4096
CHUNK = 16_384
CACHED_WORDS = 200_000
CACHED_STATES = 30_000
CACHED_PAIRS = 300_000
# After so many steps that found no room to be compiled, compiling begins anew.
PASSED_STEPS = 20_000_000
# Longer words are counted anew each time.
LONGEST_CACHED = 48
MARK = "▁"

Open = tuple[str, str | None, int]


def read_pieces(path: str) -> dict[str, float]:
    """The pieces that merging may give, from a model file with byte fallback."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    scores = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            scores[model.id_to_piece(i)] = model.get_score(i)
    return scores


def merged(symbols: list[str], scores: dict[str, float], leave: int = 1) -> list[str]:
    """Merge the pair of highest score, the leftmost of equal ones, down to `leave` parts."""
    parts = list(symbols)
    while len(parts) > leave:
        best, at = None, -1
        for i in range(len(parts) - 1):
            score = scores.get(parts[i] + parts[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class State:
    """The places at which a token may be open, and the moves compiled so far."""

    __slots__ = ("moves", "opens")

    def __init__(self, opens: tuple[Open, ...]):
        self.opens = opens
        self.moves: dict[str, tuple[State, int]] = {}


class Transducer:
    """Compiled lazily, as long as there is room: states that many texts pass come early.
    What is not compiled is worked out on the way; forgetting changes no result."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        ordered = sorted((p for p in scores if len(p) > 1), key=scores.get, reverse=True)
        self.ranks = {piece: n for n, piece in enumerate(ordered)}
        self.opens = {piece[:n] for piece in scores for n in range(1, len(piece))}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.start = State((("", None, 0),))
        self.states: dict[tuple[Open, ...], State] = {}
        self.passed = 0
        # Of each letters that a piece may begin with: the next letters, with the piece
        # they complete and the letters after them.
        self.nexts: dict[str, dict[str, tuple]] = {"": {}}
        for read in sorted(self.opens | set(scores), key=len, reverse=True):
            after = self.nexts.setdefault(read, {}) if read in self.opens else None
            own = (read if read in scores else None, after)
            self.nexts.setdefault(read[:-1], {})[read[-1]] = own

    def split(self, token: str) -> tuple[str, str] | None:
        """The two parts a token is merged from last; none if merging never makes it."""
        if token not in self.halves:
            parts = merged([*token], self.scores, 2)
            self.halves[token] = tuple(parts) if len(parts) == 2 else None
        return self.halves[token]

    def stays(self, left: str, right: str) -> bool:
        """Whether two tokens stay as they are when merged together.

        Takes their merges back, the latest first. A merge across the two spoils them if
        it ranks before the merge taken back; of equal ones the left goes first.
        """
        limit = len(self.ranks)
        while True:
            if self.ranks.get(left + right, limit) < limit:
                return False
            a, b = self.ranks.get(left, -1), self.ranks.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, self.split(left)[1]
            else:
                limit, right = b + 1, self.split(right)[0]

    def follows(self, last: str | None, token: str) -> bool:
        """Whether the token may come after the last one, or first."""
        if len(token) > 1 and self.split(token) is None:
            return False
        if last is None:
            return True
        known = self.pairs.get((last, token))
        if known is None:
            known = self.stays(last, token)
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            self.pairs[last, token] = known
        return known

    def step(self, state: State, char: str) -> tuple[State, int]:
        """The state after a character, and the tokens it emits."""
        alive, found, count = [], None, 0
        for read, last, ahead in state.opens:
            grown = read + char
            if (grown in self.scores or not read) and self.follows(last, grown):
                found, count = grown, ahead + (1 if grown in self.scores else len(char.encode()))
            if grown in self.opens:
                alive.append((grown, last, ahead))
        alive.append(("", found, count))
        emitted = min(ahead for _, _, ahead in alive)
        opens = tuple((read, last, ahead - emitted) for read, last, ahead in alive)
        if not self.room():
            return State(opens), emitted
        move = self.states.setdefault(opens, State(opens)), emitted
        state.moves[char] = move
        return move

    def room(self) -> bool:
        """Whether a state more may be compiled."""
        if len(self.states) < CACHED_STATES:
            return True
        if self.passed >= PASSED_STEPS:
            self.states.clear()
            self.start, self.passed = State(self.start.opens), 0
            return True
        return False

    def ahead(self, state: State, chars: str) -> int:
        """Tokens ahead of those emitted after more characters, without compiling states."""
        self.passed += len(chars)
        nexts, pairs, root = self.nexts, self.pairs, self.nexts[""]
        opens = [(nexts[read], last, ahead) for read, last, ahead in state.opens]
        for char in chars:
            alive, found = [], None
            # The place that opened last has read nothing yet; a letter is a token there.
            _, last, count = opens.pop()
            for after, before, ahead in opens:
                step = after.get(char)
                if step is not None:
                    token, after = step
                    if token is not None and found is None:
                        fits = pairs.get((before, token))
                        if self.follows(before, token) if fits is None else fits:
                            found, total = token, ahead + 1
                    if after is not None:
                        alive.append((after, before, ahead))
            step = root.get(char)
            if found is None and self.follows(last, char):
                known = step is not None and step[0] is not None
                found, total = char, count + (1 if known else len(char.encode()))
            elif found is None:
                total = 0
            if step is not None and step[1] is not None:
                alive.append((step[1], last, count))
            alive.append((root, found, total))
            opens = alive
        return opens[-1][2]

    def count(self, word: str) -> int:
        """Tokens of a word, from the first state."""
        state, total = self.start, 0
        for i, char in enumerate(word):
            move = state.moves.get(char)
            if move is None:
                if not self.room():
                    return total + self.ahead(state, word[i:])
                move = self.step(state, char)
            state = move[0]
            total += move[1]
        return total + state.opens[-1][2]

    def first_token(self, word: str) -> str:
        """The first token of a word, found from its last one backwards."""
        state, lasts = self.start, []
        self.passed += len(word)
        for char in word:
            move = state.moves.get(char)
            state, _ = move if move is not None else self.step(state, char)
            lasts.append(state.opens[-1][1])
        end = len(word)
        while end > len(lasts[end - 1]):
            end -= len(lasts[end - 1])
        return lasts[end - 1]


class ChunkMap(NamedTuple):
    """What a chunk does to the state before it: open is what that state still reads, in
    parts, closed the tokens from the first start of a run of spaces to the last, and rest
    what follows the last, in parts; without such a start rest is None."""

    open: tuple[str, ...]
    closed: int
    rest: tuple[str, ...] | None


class Words(dict):
    """Tokens of a word after one space, worked out when first asked for."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.bare: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        first, *more = word.split("\n")
        if more:  # no piece has a line end: it is a token by itself, and nothing goes across
            return self[first] + len(more) + sum(map(self.after_line_end, more))
        found = self.transducer.count(MARK + word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = found
        return found

    def after_line_end(self, word: str) -> int:
        found = self.bare.get(word)
        if found is None:
            found = self.transducer.count(word)
            if len(word) <= LONGEST_CACHED:
                if len(self.bare) >= CACHED_WORDS // 4:
                    self.bare.clear()
                self.bare[word] = found
        return found


class Counter:
    def __init__(self, scores: dict[str, float]):
        if any("\n" in p or MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("a piece goes across a line end or the start of a run of spaces")
        self.scores = scores
        # Runs of spaces merge last; they are counted by a rule of their own.
        self.transducer = Transducer({p: s for p, s in scores.items() if not (p.strip(MARK) == "" and len(p) > 1)})
        self.words = Words(self.transducer)
        self.longest_run = max((len(p) for p in scores if p.strip(MARK) == ""), default=1)

    def spaces(self, n: int) -> int:
        """Tokens of a run of spaces by itself: the longest pieces, then what is left."""
        left = n % self.longest_run
        return n // self.longest_run + len(merged([MARK] * left, self.scores))

    def after_spaces(self, n: int, word: str) -> int:
        """Tokens of a word and the two or more spaces before it.

        The last space goes with the word if its first token has more than the space.
        """
        if not word:
            return self.spaces(n)
        alone = self.words[word]
        if self.transducer.first_token(MARK + word.split("\n")[0]) == MARK:
            return alone - 1 + self.spaces(n)
        return alone + self.spaces(n - 1)

    def runs(self, text: str) -> int:
        """Tokens of a text that is empty or starts with a space, from the first state."""
        if not text:
            return 0
        parts = text.split(" ")
        del parts[0]
        if "" not in parts:
            return sum(map(self.words.__getitem__, parts))
        total, spaces = 0, 1
        for word in parts:
            if not word:
                spaces += 1
            else:
                total += self.words[word] if spaces == 1 else self.after_spaces(spaces, word)
                spaces = 1
        return total + (self.spaces(spaces - 1) if spaces > 1 else 0)

    def chunk_map(self, text: str) -> ChunkMap:
        """The map of a chunk that does not begin inside a run of spaces."""
        lead = len(text) - len(text.lstrip(" "))
        first = text.find(" ", lead) if lead < len(text) else -1
        if first < 0:
            return ChunkMap((text,), 0, None)
        bare = text.rstrip(" ")
        last = len(bare) if len(bare) < len(text) else len(bare[: bare.rfind(" ")].rstrip(" "))
        return ChunkMap((text[:first],), self.runs(text[first:last]), (text[last:],))

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of a chunk and the one after it."""
        if a.rest is None:
            return ChunkMap(a.open + b.open, b.closed, b.rest)
        if b.rest is None:
            return ChunkMap(a.open, a.closed, a.rest + b.open)
        return ChunkMap(a.open, a.closed + self.runs("".join(a.rest + b.open)) + b.closed, b.rest)

    def chunks(self, text: str, chunk: int) -> list[ChunkMap]:
        """Maps of the chunks of a text, cut where no run of spaces goes on."""
        marked = " " + text.replace(MARK, " ")
        out, start = [], 0
        while start < len(marked):
            end = start + chunk
            while end < len(marked) and marked[end] == " ":
                end += 1
            out.append(self.chunk_map(marked[start:end]))
            start = end
        return out

    def tokens(self, m: ChunkMap) -> int:
        """Tokens of all that a map from the first chunk on has read."""
        return self.runs("".join(m.open)) + m.closed + self.runs("".join(m.rest or ()))

    def scan(self, text: str, chunk: int = CHUNK) -> list[int]:
        """Tokens of the text up to the end of each chunk, by a doubling scan of the maps."""
        maps = self.chunks(text, chunk) if text else []
        reach = 1
        while reach < len(maps):
            maps = maps[:reach] + [self.compose(a, b) for a, b in zip(maps, maps[reach:])]
            reach *= 2
        return [self.tokens(m) for m in maps]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of the text, its maps composed in pairs."""
        if not text:
            return 0
        if len(text) < chunk:
            return self.runs(" " + text.replace(MARK, " "))
        maps = self.chunks(text, chunk)
        while len(maps) > 1:
            pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])]
            maps = pairs + maps[len(maps) - len(maps) % 2 :]
        return self.tokens(maps[0])


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(read_pieces(path))


def counted(docs: DataFrame, path: str, *carried: str, limit: int = LIMIT) -> DataFrame:
    """The carried columns, n_bytes, n_tokens and over_limit."""

    def make(texts: list[str]) -> Columns:
        known = counter(path)
        return [[known.count(t) for t in texts]]

    sized = docs.withColumn("n_bytes", F.octet_length(whole("text")).cast("long"))
    found = with_columns(sized, "n_tokens long", make, *carried, "n_bytes")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
