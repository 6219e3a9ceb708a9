"""The registered queries: SQL twins, and what has none against plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter
from hashlib import sha256
from pathlib import Path

import duckdb
import pytest

from fleetlens.llm import near_dups, queries, twins

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="generated tables not present")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture(scope="module")
def documents(tables):
    return dict(tables.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def words(text: str) -> list[str]:
    return WORD.findall(text)


def sets_of(texts: dict) -> dict:
    out = {}
    for doc_id, text in texts.items():
        own = words(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        out[doc_id] = {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()
    return out


def groups(sets: dict) -> dict:
    """The smallest id each id is linked to, by comparing every pair that shares a shingle."""
    where, pairs = {}, Counter()
    for doc_id, own in sets.items():
        for shingle in own:
            where.setdefault(shingle, []).append(doc_id)
    for ids in where.values():
        pairs.update((a, b) for a in ids for b in ids if a < b)
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), both in pairs.items():
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    return {i: top(i) for i in sets}


@pytest.mark.parametrize("name", sorted(twins.TWINS))
def test_same_rows(spark, tables, name):
    got = queries.QUERIES[name](spark, str(FOLDER))
    columns = sorted(got.columns)
    cursor = tables.execute(twins.TWINS[name])
    theirs = [c[0] for c in cursor.description]
    assert sorted(theirs) == columns
    order = [theirs.index(c) for c in columns]
    want = [tuple(row[i] for i in order) for row in cursor.fetchall()]
    rows = [tuple(row[c] for c in columns) for row in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_mixing_contract(spark):
    rows = queries.op2_mixing(spark, str(FOLDER)).collect()
    total = sum(r["size"] for r in rows)
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    assert math.isclose(sum(own[0]["target"] for own in by_source.values()), 1.5 * total)
    for own in by_source.values():
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert own[0]["target"] <= 2 * own[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1
        assert all(r["taken"] <= 2 * r["size"] for r in own)


def test_near_dups(spark, documents):
    sets = sets_of(documents)
    want = groups(sets)
    got = {r["doc_id"]: r for r in queries.op4_near_dups(spark, str(FOLDER)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_quality_counts(spark, documents):
    rows = queries.op6_quality(spark, str(FOLDER)).collect()
    assert len(rows) == len(documents)
    for r in rows:
        text = documents[r["doc_id"]]
        own = words(text)
        times = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
        held = {j for i in range(len(own) - 2) if times[tuple(own[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [line for line in text.split("\n") if words(line)]
        failed = len(own) < 50 or 100 * len(held) > 50 * len(own)
        assert r["n_words"] == len(own)
        assert r["word_chars"] == sum(map(len, own))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(held)
        assert r["base_failed"] == failed
        assert not (failed and r["kept"])


def test_quality_keeps_clean_documents(spark, tables):
    good = {i for (i,) in tables.execute("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
    rows = [r for r in queries.op6_quality(spark, str(FOLDER)).collect() if r["doc_id"] in good and not r["base_failed"]]
    assert sum(r["kept"] for r in rows) >= 0.99 * len(rows)


def test_fingerprints(spark, documents):
    rows = {r["doc_id"]: r for r in queries.op5_fingerprints(spark, str(FOLDER)).collect()}
    order = sorted(documents, reverse=True)
    following = dict(zip(order, order[1:] + order[:1]))
    plain = {i: {tuple(words(t)[j : j + 5]) for j in range(max(1, len(words(t)) - 4))} for i, t in documents.items()}
    by_text = {}
    for i, text in documents.items():
        r, half = rows[i], len(text) // 2
        edited = text[: len(text) - half] + documents[following[i]][:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == sha256(edited.encode()).hexdigest()
        changed = {tuple(words(edited)[j : j + 5]) for j in range(max(1, len(words(edited)) - 4))}
        exact = len(plain[i] & changed) / len(plain[i] | changed)
        assert abs(r["near_edited"] - exact) < 0.2
        after = plain[following[i]]
        assert abs(r["near_next"] - len(plain[i] & after) / len(plain[i] | after)) < 0.2
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert len({r["fingerprint"] for r in rows.values()}) == len(set(map(frozenset, plain.values())))


def test_personal_data(spark, documents):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def fits(kind: str, match: str) -> bool:
        digits = [int(c) for c in match if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    for r in queries.op9_pii(spark, str(FOLDER)).collect():
        text = documents[r["doc_id"]]
        base = []
        for kind, pattern in patterns.items():
            own = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if fits(kind, m[0])]
            assert r[f"n_{kind}"] == len(own)
            base += own
        assert r["base_sha256"] == sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(","))


def test_pipeline(spark, documents, tables):
    """Each stage against plain Python on what the stage before left."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept, deduped, near, mixed, tokens = (
        lambda d, f=f: f(spark, d, str(FOLDER)).checkpoint() for _, f in corpus_pipeline.STAGES
    )
    near_dups.ensure_checkpoint_dir(spark)
    one = kept(docs)
    verdicts = {r["doc_id"]: r["kept"] for r in queries.op6_quality(spark, str(FOLDER)).collect()}
    assert {r["doc_id"] for r in one.collect()} == {i for i, good in verdicts.items() if good}
    two = deduped(one)
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = {i: [line.strip(" \t\n\x0b\f\r").translate(lower) for line in t.split("\n")] for i, t in texts.items()}
    found = Counter(k for own in keys.values() for k in set(own) if k)
    for r in two.collect():
        lines = zip(texts[r["doc_id"]].split("\n"), keys[r["doc_id"]])
        assert r["text"] == "\n".join(line for line, key in lines if found[key] < 10)
        assert r["n_chars"] == len(r["text"])
    three = near(two)
    cleaned = {r["doc_id"]: r["text"] for r in two.collect()}
    want = groups(sets_of(cleaned))
    assert {r["doc_id"] for r in three.collect()} == {i for i, top in want.items() if i == top}
    four = mixed(three)
    copies = Counter(r["doc_id"] for r in four.collect())
    assert max(copies.values()) <= 2
    last = tokens(four).collect()
    assert Counter(r["doc_id"] for r in last) == copies
    assert all(r["decoded_sha256"] == sha256(cleaned[r["doc_id"]].encode()).hexdigest() for r in last)
    assert all(len(r["ids"]) == r["n_tokens"] for r in last)
