"""Byte-level BPE and token counts against the public libraries."""

from __future__ import annotations

import base64
import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest

from fleetlens.llm import byte_bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def texts(letters: str, n: int, seed: int = 5) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choices(letters, k=draw.randrange(50))) for _ in range(n)]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_library(reference):
    known = byte_bpe.vocabulary(RANKS)
    samples = texts("ab'strevmld  \n\t\r　é9½٣!?\"#中😀\x1c\x85ﬁ", 5000) + ["", "a" * 3000, " " * 700, "ab" * 2000, "x'll's"]
    for text, found in zip(samples, byte_bpe.pieces(samples), strict=True):
        packed = known.ids(found)
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text)
        assert known.decode(packed).decode() == text


def test_windows_of_long_texts(reference, monkeypatch):
    known = byte_bpe.vocabulary(RANKS)
    for text in texts("ab'strevmld  \n\t\r　é9½٣!?\"#中😀\x1c\x85ﬁ", 400) + ["", "x'll's", "a" * 50, " " * 41 + "b"]:
        for window in (1, 2, 3, 7):
            found = [p for some in byte_bpe.pieces_in_windows(text, window) for p in some]
            assert found == byte_bpe.pieces([text])[0]
    monkeypatch.setattr(byte_bpe, "WINDOW", 1000)
    monkeypatch.setattr(byte_bpe, "DECODED", 7)
    text = "It's 'll   we've\n\n中 " * 300
    (packed,) = known.encoded([text])
    assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text)
    assert known.decode(packed).decode() == text


def test_classes_equal_the_pattern(reference):
    points = [p for p in range(0, 0x110000, 13) if not 0xD800 <= p < 0xE000]
    samples = [f"a{chr(p)} {chr(p)}1{chr(p)}!" for p in points]
    known = byte_bpe.vocabulary(RANKS)
    for text, found in zip(samples, byte_bpe.pieces(samples), strict=True):
        assert np.frombuffer(known.ids(found), "<u4").tolist() == reference.encode_ordinary(text)


def test_round_trip_and_starts(odd):
    rows = byte_bpe.encoded(odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), RANKS, "doc_id")
    back = {r["doc_id"]: r["text"] for r in byte_bpe.decoded(rows, RANKS, "doc_id").collect()}
    starts = {r["doc_id"]: (r["ids"], r["starts"]) for r in rows.collect()}
    known = byte_bpe.vocabulary(RANKS)
    for r in odd.filter("doc_id IS NOT NULL").collect():
        assert back[r["doc_id"]] == (r["text"] or "")
        ids, places = starts[r["doc_id"]]
        raw = (r["text"] or "").encode()
        for token, a, b in zip(ids, places, [*places[1:], len(raw)]):
            assert known.decode(np.array([token], "<u4").tobytes()) == raw[a:b]


def test_digests(odd, reference):
    for r in byte_bpe.digests(odd, RANKS, "doc_id", "text").collect():
        ids = reference.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == sha256((r["text"] or "").encode()).hexdigest()


@pytest.fixture(scope="module")
def pieces():
    library = pytest.importorskip("sentencepiece")
    return library.SentencePieceProcessor(model_file=PIECES)


def test_counts_equal_library(pieces):
    samples = texts("abthe in the   ing\n\t▁é中😀<s>1!==", 5000) + ["", "=" * 333, "a" * 500, "a\x00b"]
    samples += [" " * n + tail for n in range(1, 60) for tail in ("", "the", "1x", "\nthe", "中")]
    known = token_counts.counter(PIECES)
    for text in samples:
        n = len(pieces.encode(text))
        assert known.count(text) == n
        assert known.count(text, chunk=3) == n
        assert (known.scan(text, 5) or [0])[-1] == n


def test_counts_without_caches(pieces, monkeypatch):
    for name in ("CACHED_WORDS", "CACHED_STATES", "CACHED_PAIRS"):
        monkeypatch.setattr(token_counts, name, 3)
    known = token_counts.Counter(token_counts.read_pieces(PIECES))
    for text in texts("the in ing of and 9 .", 200):
        assert known.count(text) == len(pieces.encode(text))


def test_count_rows(odd, pieces):
    for r in token_counts.counted(odd, PIECES, "doc_id", "text", limit=100).collect():
        text = r["text"] or ""
        n = len(pieces.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 100)


def test_states_are_compiled_while_there_is_room(monkeypatch):
    """Counts hold whatever is compiled, and no state is compiled twice to be forgotten again."""
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    samples = texts("thea  nrsio.,\né中😀▁#1", 1500) + ["", "the" * 700, "中" * 90, "  a   b  "]
    want = [len(model.encode(t)) for t in samples]
    scores = token_counts.read_pieces(PIECES)
    for room, passed in ((40, 10**9), (1, 10**9), (40, 500)):
        monkeypatch.setattr(token_counts, "CACHED_STATES", room)
        monkeypatch.setattr(token_counts, "PASSED_STEPS", passed)
        known = token_counts.Counter(scores)
        assert [known.count(t) for t in samples] == want
        assert len(known.transducer.states) <= room
    known = token_counts.Counter(scores)
    monkeypatch.setattr(token_counts, "CACHED_STATES", 40)
    monkeypatch.setattr(token_counts, "PASSED_STEPS", 10**9)
    made, step = [], known.transducer.step
    monkeypatch.setattr(known.transducer, "step", lambda *a: made.append(a) or step(*a))
    for word in texts("thenrsio", 3000):
        known.transducer.count(word)
    assert len(made) < 40 * 10
