"""Document quality from a convolutional network over bytes, in numpy.

Every byte is embedded, and learned filters of WIDTH bytes run over the whole document
in strides. Chunks overlap by half; of each, a filter's strongest response counts. What
the chunks of a document have on average, at most and at least goes through one linear
layer into one probability. A document is worked through a piece at a time, so that
memory does not grow with a text but for one row of responses per STEP bytes.

The network learns by gradient steps on a sample of about SAMPLE labelled texts outside
the held-out fold, of each at most LEARNED evenly spread steps of bytes; the rarer label
weighs as much as the other. Scores read the text alone, all of it.

Null texts are empty; an empty text has a score of its own, that of no responses. Rows
are scored by themselves, so repeated rows have equal scores. Labels that are null or
without an id are no labels; an id labelled twice counts by its average. Without labels
of both kinds every score is the share of good ones, or a half. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.batches import Columns, with_columns

SAMPLE = 6_000
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

STRIDE = 4
WIDTH = 12
EMBEDDED = 6
FILTERS = 40
# A chunk is two steps; the next one starts a step later.
STEP = 512
CELLS = STEP // STRIDE
PIECE = 256
LEARNED = 32
EPOCHS = 8
LEAST_UPDATES = 500
BATCH = 48
RATE = 0.004
SEED = 5
POOLS = 3
NOTHING = 256


class Network(NamedTuple):
    """table: a row for each byte and one for none; filters: (WIDTH * EMBEDDED, FILTERS)."""

    table: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def untrained() -> Network:
    source = np.random.Generator(np.random.PCG64(SEED))
    table = source.normal(0, 0.5, (NOTHING + 1, EMBEDDED)).astype(np.float32)
    table[NOTHING] = 0
    scale = np.sqrt(2 / (WIDTH * EMBEDDED))
    return Network(
        table,
        source.normal(0, scale, (WIDTH * EMBEDDED, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        source.normal(0, 0.1, POOLS * FILTERS).astype(np.float32),
        np.zeros(1, np.float32),
    )


def padded(raw: bytes) -> np.ndarray:
    """Symbols of a text up to a whole number of steps, of which one at least, with room
    for the last filter to end in."""
    steps = max(1, -(-(len(raw) + WIDTH - STRIDE) // STEP))
    out = np.full(steps * STEP, NOTHING, np.int16)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out


def step_maxima(net: Network, symbols: np.ndarray, lasts: np.ndarray) -> Iterator[np.ndarray]:
    """For pieces of consecutive steps, the strongest response of each filter in each step.

    symbols are padded texts one after the other, lasts the steps that end one. A filter
    that starts before a step's end reads on into the next; at a text's end into nothing.
    """
    embedded, blocks = STRIDE * EMBEDDED, WIDTH // STRIDE
    joint = np.concatenate([net.filters[i * embedded : (i + 1) * embedded] for i in range(blocks)], axis=1)
    steps = len(symbols) // STEP
    ends = np.zeros(steps, bool)
    ends[lasts] = True
    for at in range(0, steps, PIECE):
        n = min(PIECE, steps - at)
        here = symbols[at * STEP : (at + n) * STEP + WIDTH - STRIDE]
        if len(here) < n * STEP + WIDTH - STRIDE:
            here = np.concatenate([here, np.full(WIDTH - STRIDE, NOTHING, np.int16)])
        rows = net.table[here].reshape(-1, embedded)
        parts = rows @ joint
        out = parts[: n * CELLS, :FILTERS].copy()
        for i in range(1, blocks):
            out += parts[i : n * CELLS + i, i * FILTERS : (i + 1) * FILTERS]
        out = out.reshape(n, CELLS, FILTERS)
        out[ends[at : at + n], CELLS - blocks + 1 :] = 0
        yield out


def chunk_responses(strongest: np.ndarray) -> np.ndarray:
    """Of each chunk of one text, from its steps."""
    return strongest if len(strongest) == 1 else np.maximum(strongest[:-1], strongest[1:])


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pooled(net: Network, strongest: np.ndarray) -> np.ndarray:
    chunks = np.maximum(chunk_responses(strongest) + net.filter_bias, 0)
    return np.concatenate([chunks.mean(axis=0, dtype=np.float64), chunks.max(axis=0), chunks.min(axis=0)])


def scores(net: Network, texts: list[str]) -> list[float]:
    """The probability of each text, to six places, the same with whatever it is scored."""
    made = [padded(t.encode("utf-8", "surrogatepass")) for t in texts]
    if not made:
        return []
    sizes = np.array([len(m) // STEP for m in made])
    ends = np.cumsum(sizes)
    found = [out.max(axis=1) for out in step_maxima(net, np.concatenate(made), ends - 1)]
    strongest = np.concatenate(found)
    features = np.array([pooled(net, strongest[a:b]) for a, b in zip(ends - sizes, ends)])
    return np.round(probability(features @ net.weights + float(net.bias[0])), 6).tolist()


def gradients(net: Network, symbols: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Network:
    """Of the weighted mean of the texts' negative log-probabilities."""
    ends = np.cumsum(sizes)
    firsts = ends - sizes
    strongest, places = [], []
    for out in step_maxima(net, symbols, ends - 1):
        places.append(out.argmax(axis=1))
        strongest.append(np.take_along_axis(out, places[-1][:, None], axis=1)[:, 0])
    strongest, places = np.concatenate(strongest), np.concatenate(places)
    back = np.zeros_like(strongest)
    pools = [pooled(net, strongest[a:b]) for a, b in zip(firsts, ends)]
    off = (probability(np.array(pools) @ net.weights + net.bias[0]) - labels) * weights / weights.sum()
    mean, most, least = net.weights.reshape(POOLS, FILTERS)
    columns = np.arange(FILTERS)
    bias = np.zeros(FILTERS)
    for a, b, o in zip(firsts, ends, off):
        own = strongest[a:b]
        chunks = chunk_responses(own)
        slope = np.tile(mean * (o / len(chunks)), (len(chunks), 1))
        slope[chunks.argmax(axis=0), columns] += most * o
        slope[chunks.argmin(axis=0), columns] += least * o
        slope *= chunks + net.filter_bias > 0
        bias += slope.sum(axis=0)
        if b - a == 1:
            back[a] += slope[0]
        else:
            left = own[:-1] >= own[1:]
            back[a : b - 1] += slope * left
            back[a + 1 : b] += slope * ~left
    # Responses cut to zero at a text's end don't depend on the filters.
    last = np.zeros(len(strongest), bool)
    last[ends - 1] = True
    back[last[:, None] & (places > CELLS - WIDTH // STRIDE)] = 0
    room = np.concatenate([symbols, np.full(WIDTH, NOTHING, np.int16)])
    starts = (np.arange(len(strongest))[:, None] * CELLS + places) * STRIDE
    filters, table = np.zeros_like(net.filters), np.zeros((NOTHING + 1, EMBEDDED))
    for f in range(FILTERS):
        some = np.flatnonzero(back[:, f])
        read = room[starts[some, f][:, None] + np.arange(WIDTH)]
        slope = back[some, f].astype(np.float32)
        filters[:, f] = slope @ net.table[read].reshape(-1, WIDTH * EMBEDDED)
        # By place in the filter and symbol, how much of the slope comes from there.
        keys = read + (NOTHING + 1) * np.arange(WIDTH)
        mass = np.bincount(keys.ravel(), np.repeat(slope, WIDTH), WIDTH * (NOTHING + 1)).reshape(WIDTH, -1)
        table += mass.T @ net.filters[:, f].reshape(WIDTH, EMBEDDED)
    table[NOTHING] = 0
    return Network(table.astype(np.float32), filters, bias.astype(np.float32), off @ np.array(pools), np.array([off.sum()]))


def trained(texts: list[np.ndarray], labels: np.ndarray) -> Network:
    """Adaptive updates on batches of padded texts, few texts more often."""
    epochs = max(EPOCHS, LEAST_UPDATES * BATCH // len(texts))
    net = untrained()
    first = [np.zeros_like(x) for x in net]
    second = [np.zeros_like(x) for x in net]
    share = float(labels.mean())
    weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    source = np.random.Generator(np.random.PCG64(SEED + 1))
    t, total = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = source.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            sizes = np.array([len(texts[j]) // STEP for j in part])
            slopes = gradients(net, np.concatenate([texts[j] for j in part]), sizes, labels[part], weights[part])
            t += 1
            rate = RATE * (1 - 0.9 * t / total)
            new = []
            for x, slope, m, v in zip(net, slopes, first, second):
                m += 0.1 * (slope - m)
                v += 0.01 * (slope * slope - v)
                new.append((x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)).astype(np.float32))
            net = Network(*new)
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(steps, quality) of about `most` labelled rows outside the held-out fold.

    steps are at most LEARNED steps of a text, evenly spread. The ids are about `most`
    and broadcast, so no text is shuffled before it is picked.
    """
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("quality"))
    share = min(1.0, most / max(1, usable.count()))
    picked = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def spread(texts: list[str]) -> Columns:
        out = []
        for t in texts:
            made = padded(t.encode("utf-8", "surrogatepass")).reshape(-1, STEP)
            if len(made) > LEARNED:
                made = made[np.linspace(0, len(made) - 1, LEARNED).astype(int)]
            out.append(made.astype("<i2").tobytes())
        return [out]

    return with_columns(rows, "steps binary", spread, "doc_id", "quality")


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Network | None, float]:
    """The network, or none without labels of both kinds; and the share of good ones."""
    rows = sorted(training_rows(docs, labels).collect(), key=lambda r: r["doc_id"])
    known = np.array([r["quality"] for r in rows], np.float64)
    if not len(known) or known.min() == known.max():
        return None, float(known.mean()) if len(known) else 0.5
    return trained([np.frombuffer(r["steps"], "<i2") for r in rows], known), float(known.mean())


def scored(docs: DataFrame, net: Network | None, share: float, *carried: str) -> DataFrame:
    """The carried columns and score, 0 to 1."""
    if net is None:
        return docs.select(*carried, F.lit(share).alias("score"))
    return with_columns(docs, "score double", lambda texts: [scores(net, texts)], *carried)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`."""
    return scored(docs, *learn(docs, labels), "doc_id").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
