"""The convolutional network: slopes, whole texts, held-out rows."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest

from fleetlens.llm import quality_net as net

FOLDER = Path("/root/testdata/sf0.01")


def plain_score(n, text):
    """One filter at one place at a time."""
    made = net.padded(text.encode())
    steps = len(made) // net.STEP
    room = [*made.tolist(), *[net.NOTHING] * net.WIDTH]
    best = np.full((steps, net.FILTERS), -np.inf)
    for at in range(0, len(made), net.STRIDE):
        window = np.concatenate([n.table[s] for s in room[at : at + net.WIDTH]])
        response = window @ n.filters if at + net.WIDTH <= len(made) else np.zeros(net.FILTERS)
        best[at // net.STEP] = np.maximum(best[at // net.STEP], response)
    chunks = [np.maximum(best[i], best[min(i + 1, steps - 1)]) for i in range(max(1, steps - 1))]
    active = np.maximum(np.array(chunks) + n.filter_bias, 0)
    z = np.concatenate([active.mean(axis=0), active.max(axis=0), active.min(axis=0)]) @ n.weights + n.bias[0]
    return 1 / (1 + np.exp(-z))


def test_scores_of_whole_texts(monkeypatch):
    monkeypatch.setattr(net, "PIECE", 3)
    n = net.untrained()._replace(filter_bias=np.linspace(-1, 1, net.FILTERS).astype(np.float32), bias=np.array([0.3], np.float32))
    draw = random.Random(2)
    texts = ["", "a", "é" * 251, "x" * 504, "x" * 505, *["".join(draw.choices("abc .\n", k=k)) for k in (503, 1020, 4000)]]
    together = net.scores(n, texts)
    assert together == pytest.approx([plain_score(n, t) for t in texts], abs=2e-5)
    assert together == pytest.approx([net.scores(n, [t])[0] for t in texts], abs=2e-6)
    changed = texts[-1][:-40] + "#$%&" * 10
    assert net.scores(n, [changed]) != net.scores(n, [texts[-1]])


def test_gradients():
    draw = random.Random(4)
    start = net.untrained()
    n = net.Network(*(np.asarray(x, np.float64) for x in start))._replace(filter_bias=np.full(net.FILTERS, 0.05))
    made = [net.padded("".join(draw.choices("abcdefg .", k=k)).encode()) for k in (30, 700, 1500)]
    sizes, labels, weights = np.array([len(m) // net.STEP for m in made]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    symbols = np.concatenate(made)

    def loss(m):
        ends = np.cumsum(sizes)
        strongest = np.concatenate([o.max(axis=1) for o in net.step_maxima(m, symbols, ends - 1)])
        features = np.array([net.pooled(m, strongest[b - s : b]) for s, b in zip(sizes, ends)])
        p = net.probability(features @ m.weights + m.bias[0])
        return -(weights * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / weights.sum()

    slopes = net.gradients(n, symbols, sizes, labels, weights)
    for name in net.Network._fields:
        x, slope = getattr(n, name), getattr(slopes, name)
        places = [np.unravel_index(i, x.shape) for i in np.argsort(-np.abs(slope), axis=None)[:4]]
        for place in places:
            up, down = x.copy(), x.copy()
            up[place] += 1e-6
            down[place] -= 1e-6
            measured = (loss(n._replace(**{name: up})) - loss(n._replace(**{name: down}))) / 2e-6
            assert slope[place] == pytest.approx(measured, rel=1e-3, abs=1e-6), name


@pytest.mark.skipif(not FOLDER.exists(), reason="generated tables not present")
def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in net.judged(docs, labels).collect() if r["held_out"] and r["doc_id"] in known]
    scores = {v: [r["score"] for r in rows if known[r["doc_id"]] == v] for v in (0, 1)}
    pairs = [(a > b) + 0.5 * (a == b) for a in scores[1] for b in scores[0]]
    assert sum(pairs) / len(pairs) > 0.9
    assert sum(r["predicted"] == known[r["doc_id"]] for r in rows) / len(rows) > 0.85
