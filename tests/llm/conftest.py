from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "the of and re in er an ti on es th ed nt is en ha ou st".split()


def prose(seed: int, n: int, lines: bool = True) -> str:
    """Invented words, some of them common."""
    draw = random.Random(seed)
    out = []
    for i in range(n):
        common = draw.random() < 0.3
        out.append(draw.choice(SYLLABLES[:4]) if common else "".join(draw.choices(SYLLABLES, k=draw.randint(2, 4))))
        if draw.random() < 0.08:
            out[-1] += "."
            out.append("\n" if lines and draw.random() < 0.4 else "")
    return " ".join(w for w in out if w).replace(" \n ", "\n").strip()


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from (doc_id, text) or longer rows."""

    def make(rows, schema=SCHEMA):
        filled = []
        for row in rows:
            doc_id, text, *more = row
            lang, source = (*more, "en", "s")[:2] if len(more) < 2 else more[:2]
            filled.append((doc_id, text, lang, source, len(text or "")))
        return spark.createDataFrame(filled, schema)

    return make


ODD_TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "One two",
    "x" * 30_000,
    "a b " * 6_000,
    "tab\tand\x0bvertical\x0cfeed\rreturn\nline",
    "é ü 中 😀 ٣ ½ ﬁ",
    "\n\n\n",
    "it's 'll we'VE  don't x",
    prose(1, 300),
    prose(1, 300),
    "▁ ▁▁ <s> </s> <|endoftext|>",
    "\x00 nul",
]


@pytest.fixture(scope="session")
def odd(frame):
    """Null, empty, very long, repeated and unusual texts; null ids, languages and sources."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None) for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, "one", "en", "s1"), (None, "no id here", None, None), (None, None, "de", "s1")]
    return frame(rows)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with columns named like those the operators make or use."""
    from pyspark.sql import functions as F

    names = ("row", "id", "text_version", "version", "pos", "line", "key", "h1", "size", "draw", "copies", "_row", "_text",
             "_s", "bucket", "guest", "words", "short", "classes", "kept", "score", "spans", "n_tokens", "component_id",
             "kept_text", "n_lines", "share", "u", "v", "_id", "kept_id", "_lang", "base_failed")
    return odd.select("*", *[F.lit("clash").alias(n) for n in names])


@pytest.fixture(scope="session")
def nothing(frame):
    return frame([])
