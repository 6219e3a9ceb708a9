"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network sees the two words on either side of a hidden one, embeds them, and
predicts the hidden word in two steps: its class, then the word in its class. A
document's score is the sum over all its words of the log-probability given both sides.

Words are the commonest of the whole corpus; all others share hash buckets. Training
goes over every word of every document: each task trains its own copy on the documents it
reads, and the copies are averaged by the words they saw, once per round. A round hides
every ROUNDS-th word of a text, so over the rounds each word is hidden and learnt once. Parameters have a fixed size; what is summed for them, and the word counts,
grow with the corpus, and both are shuffled by key with no task holding more than its
share of the keys.

Null and empty texts have no words and a score of 0; their mean is null. Rows are
scored by themselves, so repeated rows have equal scores. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.batches import BYTES, Columns, slices, with_columns
from fleetlens.llm.text import words
from fleetlens.session import ensure_checkpoint_dir

CLASSES = 32
SIZE = CLASSES * CLASSES
COMMON = 768
SIDE = 2
DIMENSIONS = 8
HIDDEN = 24
ROUNDS = 2
BATCH = 16_384
# Words a training step learns from.
STEP = 4096
RATE = 0.15
SEED = 11
# The id that stands for what is outside the text.
OUTSIDE = SIZE

SHAPES = {
    "embedding": (SIZE + 1, DIMENSIONS),
    "context": (2 * SIDE * DIMENSIONS, HIDDEN),
    "hidden_bias": (HIDDEN,),
    "classes": (HIDDEN, CLASSES),
    "class_bias": (CLASSES,),
    "members": (CLASSES, HIDDEN, CLASSES),
    "member_bias": (CLASSES, CLASSES),
}
LENGTH = sum(int(np.prod(s)) for s in SHAPES.values())

Network = dict[str, np.ndarray]


class Vocabulary(dict):
    """Ids of words; those that are not common get a bucket."""

    def __init__(self, common: list[str]):
        super().__init__()
        self.common = {w: i for i, w in enumerate(common)}

    def __missing__(self, word: str) -> int:
        found = self.common.get(word)
        if found is None:
            found = COMMON + zlib.crc32(word.encode()) % (SIZE - COMMON)
        if len(self) >= 400_000:
            self.clear()
        self[word] = found
        return found


@lru_cache(maxsize=2)
def vocabulary(common: tuple[str, ...]) -> Vocabulary:
    return Vocabulary(list(common))


def common_words(docs: DataFrame) -> tuple[str, ...]:
    """The commonest words of all documents, the most frequent first; COMMON at most."""
    every = docs.select(F.explode(words(F.lower("text"))).alias("word"))
    top = every.groupBy("word").count().orderBy(F.desc("count"), "word").limit(COMMON).collect()
    return tuple(r["word"] for r in top)


def packed(network: Network) -> np.ndarray:
    return np.concatenate([network[name].ravel() for name in SHAPES])


def unpacked(flat: np.ndarray) -> Network:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def untrained() -> np.ndarray:
    source = np.random.Generator(np.random.PCG64(SEED))
    flat = [source.normal(0, 0.0 if name.endswith("bias") else 0.15, shape).ravel() for name, shape in SHAPES.items()]
    return np.concatenate(flat).astype(np.float32)


def numbers(text: str, known: Vocabulary) -> bytes:
    """The ids of the words of a text, two bytes each."""
    return np.array([*map(known.__getitem__, text.lower().split())], "<i2").tobytes()


def laid(numbered: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts with SIDE outside ids around each; where words are; whose they are."""
    outside = np.full(SIDE, OUTSIDE, "<i2").tobytes()
    flat = np.frombuffer(outside.join([b"", *numbered, b""]), "<i2").astype(np.int32)
    inside = np.flatnonzero(flat != OUTSIDE)
    return flat, inside, np.repeat(np.arange(len(numbered)), [len(n) // 2 for n in numbered])


def laid_out(texts: list[str], known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return laid([numbers(t, known) for t in texts])


def places(owners: np.ndarray) -> np.ndarray:
    """The place of each word in its text, of words that come text by text."""
    return np.arange(len(owners)) - np.searchsorted(owners, owners)


def _softmax(x: np.ndarray) -> np.ndarray:
    """By column, in place."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def _around(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([flat[at + d] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)


def _hidden(net: Network, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The embedded neighbours, a row for each word, and the hidden layer, a column for each."""
    around = net["embedding"][near].reshape(len(near), -1)
    hidden = net["context"].T @ around.T
    hidden += net["hidden_bias"][:, None]
    return around, np.tanh(hidden, out=hidden)


def _by_class(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the words at `at` by class, and where in it each class begins and ends."""
    classes = (flat[at] // CLASSES).astype(np.int16)
    order = np.argsort(classes, kind="stable")
    return order, np.searchsorted(classes[order], np.arange(CLASSES + 1))


def log_probabilities(net: Network, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability of each word at `at` given those around it."""
    order, bounds = _by_class(flat, at)
    at = at[order]
    _, hidden = _hidden(net, _around(flat, at))
    members = flat[at] % CLASSES
    chances = _softmax(net["classes"].T @ hidden + net["class_bias"][:, None])
    found = np.empty(len(at), np.float32)
    for c in range(CLASSES):
        start, end = bounds[c], bounds[c + 1]
        if start < end:
            inner = _softmax(net["members"][c].T @ hidden[:, start:end] + net["member_bias"][c][:, None])
            picked = inner[members[start:end], np.arange(end - start)]
            found[start:end] = np.log(chances[c, start:end] + 1e-12) + np.log(picked + 1e-12)
    out = np.empty_like(found)
    out[order] = found
    return out


def gradients(net: Network, flat: np.ndarray, at: np.ndarray) -> Network:
    """Of the mean negative log-probability of the words at `at`."""
    order, bounds = _by_class(flat, at)
    at = at[order]
    near = _around(flat, at)
    around, hidden = _hidden(net, near)
    members = flat[at] % CLASSES
    n = np.float32(len(at))
    wrong = _softmax(net["classes"].T @ hidden + net["class_bias"][:, None])
    for c in range(CLASSES):
        wrong[c, bounds[c] : bounds[c + 1]] -= 1
    out = {"classes": hidden @ wrong.T / n, "class_bias": wrong.sum(axis=1) / n}
    out["members"], out["member_bias"] = np.zeros(SHAPES["members"], np.float32), np.zeros(SHAPES["member_bias"], np.float32)
    back = net["classes"] @ wrong
    for c in range(CLASSES):
        start, end = bounds[c], bounds[c + 1]
        if start < end:
            own = hidden[:, start:end]
            off = _softmax(net["members"][c].T @ own + net["member_bias"][c][:, None])
            off[members[start:end], np.arange(end - start)] -= 1
            out["members"][c] = own @ off.T / n
            out["member_bias"][c] = off.sum(axis=1) / n
            back[:, start:end] += net["members"][c] @ off
    back *= 1 - hidden * hidden
    out["context"], out["hidden_bias"] = (back @ around).T / n, back.sum(axis=1) / n
    inner = (back.T @ (net["context"].T / n)).reshape(-1, DIMENSIONS)
    ids = near.ravel().astype(np.int16)
    by_id = np.argsort(ids, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], np.diff(ids[by_id]) > 0]))
    out["embedding"] = np.zeros(SHAPES["embedding"], np.float32)
    out["embedding"][ids[by_id][heads]] = np.add.reduceat(inner[by_id], heads, axis=0)
    return out


class Trainer:
    """Adaptive gradient steps on one copy of the network."""

    def __init__(self, flat: np.ndarray):
        self.net = unpacked(flat)
        self.squares = {name: np.full(shape, 1e-6, np.float32) for name, shape in SHAPES.items()}
        self.seen = 0

    def train(self, flat: np.ndarray, at: np.ndarray) -> None:
        for i in range(0, len(at), STEP):
            part = at[i : i + STEP]
            for name, slope in gradients(self.net, flat, part).items():
                self.squares[name] += slope * slope
                self.net[name] -= RATE * slope / np.sqrt(self.squares[name])
            self.seen += len(part)


def numbered(docs: DataFrame, common: tuple[str, ...], *carried: str) -> DataFrame:
    """The carried columns and the ids of each text's words."""

    def make(texts: list[str]) -> Columns:
        known = vocabulary(common)
        return [[numbers(t, known) for t in texts]]

    return with_columns(docs, "ids binary", make, *carried)


def one_round(ids: DataFrame, flat: np.ndarray, number: int) -> np.ndarray:
    """Train a copy in every task on this round's words of its documents; the average.

    The average weighs copies by words. Parameters are summed by position in Spark, so
    that what the driver gets is as large as the network.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(flat)
        source = np.random.Generator(np.random.PCG64(SEED + number))
        for batch in batches:
            for part in slices(batch, "ids", BYTES // 3):
                known, inside, owners = laid(part.column("ids").to_pylist())
                trainer.train(known, source.permutation(inside[places(owners) % ROUNDS == number]))
        if trainer.seen:
            own = packed(trainer.net).astype(np.float64) * trainer.seen
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(LENGTH, dtype=np.int32)), pa.array(own), pa.array(np.full(LENGTH, trainer.seen, np.int64))],
                ["place", "weighed", "seen"],
            )

    copies = ids.select("ids").mapInArrow(run, "place int, weighed double, seen long")
    sums = copies.groupBy("place").agg((F.sum("weighed") / F.sum("seen")).alias("value")).collect()
    out = flat.copy()
    for row in sums:
        out[row["place"]] = row["value"]
    return out


def trained(ids: DataFrame) -> np.ndarray:
    flat = untrained()
    for number in range(ROUNDS):
        flat = one_round(ids, flat, number)
    return flat


def learn(docs: DataFrame) -> tuple[tuple[str, ...], np.ndarray]:
    """The common words and the trained parameters."""
    ensure_checkpoint_dir(docs.sparkSession)
    common = common_words(docs)
    return common, trained(numbered(docs, common).checkpoint())


def scored_numbered(ids: DataFrame, flat: np.ndarray, *carried: str) -> DataFrame:
    """The carried columns, n_words, log_likelihood (summed) and mean_log_likelihood."""

    def make(some: list[bytes]) -> Columns:
        net = unpacked(flat)
        known, inside, owners = laid(some)
        each = [log_probabilities(net, known, inside[i : i + BATCH]) for i in range(0, len(inside), BATCH)]
        every = np.concatenate([*each, np.zeros(0, np.float32)]).astype(np.float64)
        sums = np.bincount(owners, every, len(some))
        counts = np.bincount(owners, minlength=len(some))
        means = [s / n if n else None for s, n in zip(sums.tolist(), counts.tolist())]
        return [counts.tolist(), sums.tolist(), means]

    return with_columns(ids, "n_words long, log_likelihood double, mean_log_likelihood double", make, *carried, text="ids")


def scored(docs: DataFrame, common: tuple[str, ...], flat: np.ndarray, *carried: str) -> DataFrame:
    return scored_numbered(numbered(docs, common, *carried), flat, *carried)


def judged(docs: DataFrame, *carried: str) -> DataFrame:
    """Learn from all documents and score them; their words are looked up once."""
    ensure_checkpoint_dir(docs.sparkSession)
    common = common_words(docs)
    ids = numbered(docs, common, *carried).checkpoint()
    return scored_numbered(ids, trained(ids), *carried)
