"""One very long text, without a space or on one line: bounded time, and where texts are
worked on in pieces, memory of a few times the text."""

from __future__ import annotations

import random
import time
import tracemalloc

import public_tokenizers
import pytest

from fleetlens.llm import byte_bpe, near_dups, pii, quality_net, scoring, token_counts, toxicity

SIZE = 300_000
SECONDS = 30
TIMES = 60  # bytes of memory for each byte of text, at most
IN_PIECES = ("shingles", "network")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    draw = random.Random(2)
    syllables = ["".join(draw.choices("abcdefghij", k=4)) for _ in range(50)]
    return {
        "no spaces": "".join(draw.choices(syllables, k=SIZE // 4)),
        "one line": " ".join(draw.choices(syllables, k=SIZE // 5)),
        "digits": "".join(draw.choices("0123456789", k=SIZE)),
        "dots": "1." * (SIZE // 2),
        "spaces": " " * SIZE,
    }


def toxic(text):
    weights = toxicity.Weights(toxicity.Grammar({"abcd": 1.0}, {}))
    return toxicity.features(text, weights)


def network(text):
    return quality_net.scores(quality_net.untrained(), [text])


OPERATORS = {
    "tokens": lambda t: token_counts.counter(PIECES).count(t),
    "encoded": lambda t: byte_bpe.vocabulary(RANKS).encoded([t]),
    "decoded": lambda t: byte_bpe.vocabulary(RANKS).decode(byte_bpe.vocabulary(RANKS).encoded([t])[0]) == t.encode(),
    "shingles": lambda t: near_dups.shingle_sets([t]),
    "personal": lambda t: pii.candidates(t, pii.base_spans(t)),
    "toxic": toxic,
    "network": network,
    "words": lambda t: scoring.laid_out([t], scoring.Vocabulary(["abcd"])),
}


@pytest.mark.parametrize("kind", sorted(texts()))
@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_long_text(name, kind):
    text = texts()[kind]
    OPERATORS[name]("abcd efgh.")  # vocabularies and tables are not counted
    if name in IN_PIECES:
        tracemalloc.start()
    try:
        start = time.time()
        OPERATORS[name](text)
        took = time.time() - start
        peak = tracemalloc.get_traced_memory()[1] if name in IN_PIECES else 0
    finally:
        tracemalloc.stop()
    assert took < SECONDS
    assert peak < 48_000_000 + TIMES * len(text)
