"""Every operator and stage on null, empty, long, repeated and clashing input, and on none."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm import (
    byte_bpe,
    filter_audit,
    fingerprints,
    lines,
    mixing,
    near_dups,
    pii,
    quality,
    quality_net,
    scoring,
    token_counts,
    toxicity,
)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def toxic(docs):
    labels = docs.sparkSession.createDataFrame([(1, 0), (3, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    return toxicity.judged(docs, labels)


def good(docs):
    labels = docs.sparkSession.createDataFrame([(1, 0), (3, 1), (None, 1), (7, None)], "doc_id long, quality int")
    return quality_net.judged(docs, labels)


OPERATORS = {
    "scoring": lambda d: scoring.judged(d, "doc_id"),
    "mixing": mixing.mix,
    "token_counts": lambda d: token_counts.counted(d, PIECES, "doc_id"),
    "near_dups": near_dups.grouped,
    "fingerprints": fingerprints.fingerprinted,
    "quality": lambda d: quality.judged(d, "doc_id"),
    "byte_bpe": lambda d: byte_bpe.digests(d, RANKS, "doc_id"),
    "toxicity": toxic,
    "pii": lambda d: pii.found(d, "doc_id"),
    "lines": lines.deduped,
    "quality_net": good,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_every_row(odd, clashing, nothing, name):
    plain = OPERATORS[name](odd).drop("text", "lang", "source", "n_chars")
    rows = sorted(map(repr, plain.collect()))
    assert len(rows) == odd.count()
    if name != "fingerprints":  # ties of equal ids and texts apart, results repeat
        made = [c for c in plain.columns if c not in ("doc_id",)]
        again = OPERATORS[name](clashing).select("doc_id", *made)
        assert sorted(map(repr, again.select(plain.columns).collect())) == rows
    empty = OPERATORS[name](nothing)
    assert empty.count() == 0
    assert set(plain.columns) <= set(empty.columns)


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, odd, clashing, nothing, stage):
    _, function = corpus_pipeline.STAGES[stage]
    for docs in (odd, clashing, nothing):
        got = function(spark, docs, "")
        if stage < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == docs.columns
        got.collect()
    assert function(spark, nothing, "").count() == 0


def test_defined_results(odd):
    by_text = {r["doc_id"]: r for r in near_dups.grouped(odd).filter("doc_id IS NOT NULL").collect()}
    assert by_text[11]["component_id"] == by_text[12]["component_id"] == 11
    assert by_text[0]["n_shingles"] == by_text[1]["n_shingles"] == by_text[2]["n_shingles"] == 0
    assert all(by_text[i]["kept"] for i in (0, 1, 2, 3, 11)) and not by_text[12]["kept"]
    none = near_dups.grouped(odd).filter("doc_id IS NULL").collect()
    assert all(r["component_id"] is None and r["kept"] for r in none)
    sized = {r["doc_id"]: r for r in mixing.mix(odd).collect()}
    assert sized[0]["size"] == sized[2]["size"] == 0 and sized[6]["size"] == 12_000
    scores = {r["doc_id"]: r for r in scoring.judged(odd, "doc_id").collect()}
    assert scores[1]["log_likelihood"] == 0 and scores[1]["mean_log_likelihood"] is None


def test_audit_of_odd_inputs(spark, odd, clashing, nothing):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.audited(odd, labels).collect()}
    assert {p for p, _, _ in rows} == {"", "s0", "s1"} and len(rows) == 3 * 600
    # Of the two copies of one text the second goes, repeated ids and null ids are no copies.
    assert sum(rows[p, "EABCD", 1]["removed"] for p in ("", "s0", "s1")) == 2
    # Id 3 is there twice, in the same part, and labelled both ways.
    assert rows["s1", "ABCDE", 1]["good_lost"] == rows["s1", "ABCDE", 1]["toxic_lost"] == 2
    again = filter_audit.audited(clashing, labels.withColumn("n", F.lit("clash")))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, rows.values()))
    assert filter_audit.audited(nothing, labels).count() == 0
    assert filter_audit.audited(odd, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
