"""Toxicity by a finite-state grammar over clauses, with a lexicon learned from labels.

Words are mapped to classes: insults (learned words and word beginnings, each with a
weight), threats, targets, negations and reports of speech. A clause goes through the
product of small transducers: one is open for a few words after a negation, one from a
report or an opening quote to the end of the clause, one once a target has been seen,
and one waits for the target of a threat. What they emit for an insult tells whether it
was negated, reported or aimed at somebody; a document's features are sums over its
matched clauses, and how much each kind counts is fitted to the labels.

Learning uses labelled rows outside the held-out fold only, at most about SAMPLE of
them, picked by a hash of the id; texts met twice count once. Scores take nothing but
the text. Null and empty texts get the score of a text without matches. Rows are scored
by themselves, so repeated rows have equal scores. Without usable labels there is no
lexicon, and only threats count.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.batches import Columns, with_columns
from fleetlens.session import ensure_checkpoint_dir

FOLDS = 4
HELD_OUT = 2
THRESHOLD = 0.3
SAMPLE = 8_000
CANDIDATES = 1_200
LEAST_TEXTS = 2
BEGINNINGS = (4, 5, 6)
LEAST_WEIGHT = 0.25
PENALTY = 0.002
SCOPE = 3

# Common words of four languages.
TARGETS = frozenset(
    "you your yours you're u ya he she they them him her this that these those "
    "du dich dir dein deine ihr euch sie er tu toi te vous ton ta tes votre il elle ils "
    "tú ti usted ustedes tus vosotros él ella ellos".split()
)
NEGATIONS = frozenset(
    "not no never isn't aren't wasn't don't nobody hardly nicht kein keine keinen nie niemals "
    "pas jamais aucun aucune non nunca jamás ningún ninguna tampoco".split()
)
REPORTS = frozenset(
    "said says told claims claimed called quoted wrote reported according sagte sagt schrieb "
    "behauptet nannte dit disait écrit selon dijo dice escribió según llamó".split()
)
THREATS = frozenset(
    "kill hurt destroy beat stab shoot murder töten umbringen schlagen vernichten erschießen "
    "tuer frapper détruire égorger matar golpear destruir".split()
)
ENDS = frozenset(".!?;:\n")
QUOTES = "\"“„«"
BARE = ".,;:!?\"'“”„«»()[]{}*_#$%&|<>-"

BLANKS = {c: " " for c in (9, 11, 12, 13)}

KINDS = 8
FEATURES = KINDS + 3
# Kinds that are neither negated nor reported: insults, aimed ones, threats.
PLAIN = frozenset((0, 4, KINDS))


class Grammar(NamedTuple):
    """The learned lexicon: weights of whole words, and of words by how they begin."""

    words: dict[str, float]
    beginnings: dict[str, float]


class Model(NamedTuple):
    grammar: Grammar
    factors: list[float]
    constant: float


def tokens(text: str) -> list[str]:
    """Words between ASCII white space; a line end is a token of its own."""
    return text.lower().translate(BLANKS).replace("\n", " \n ").split(" ")


def bare(token: str) -> str:
    return token.strip(BARE)


class Weights(dict):
    """The insult weight of a token, worked out when it is first met."""

    def __init__(self, grammar: Grammar):
        super().__init__()
        self.grammar = grammar

    def __missing__(self, token: str) -> float:
        word = bare(token)
        found = self.grammar.words.get(word, 0.0)
        for n in BEGINNINGS:
            if len(word) > n:
                found = max(found, self.grammar.beginnings.get(word[:n], 0.0))
        if not found and word in THREATS:
            found = -1.0  # met, but only of weight with a target
        if len(self) >= 400_000:
            self.clear()
        self[token] = found
        return found


def clause_of(found: list[str], at: int) -> tuple[int, int]:
    """The clause a token is in, from its first token to its end mark."""
    start = at
    while start > 0 and found[start - 1][-1:] not in ENDS:
        start -= 1
    end = at
    while end + 1 < len(found) and found[end][-1:] not in ENDS:
        end += 1
    return start, end + 1


def run_clause(clause: list[str], weights: Weights) -> list[tuple[int, float]]:
    """What the product of the transducers emits over a clause: kinds and weights.

    Kind is negated + 2 reported + 4 aimed; KINDS stands for a threat with a target.
    """
    negated, reported, aimed, threat = 0, False, False, False
    emitted, insults = [], []
    for token in clause:
        word = bare(token)
        if token[:1] in QUOTES and token:
            reported = True
        if word in NEGATIONS:
            negated = SCOPE + 1
        elif word in REPORTS:
            reported = True
        elif word in TARGETS:
            aimed = True
            if threat:
                emitted.append((KINDS, 1.0))
                threat = False
        weight = weights[token]
        if weight > 0:
            insults.append((bool(negated) + 2 * reported, weight))
        elif weight < 0 and not negated:
            threat = True
        negated = max(0, negated - 1)
    return emitted + [(kind + 4 * aimed, weight) for kind, weight in insults]


def features(text: str, weights: Weights) -> list[float]:
    """Per kind the weights of its insults, then threats, the best clause and the share of words.

    A clause is run once, from its start to its end. The best clause and the share take
    only what is neither negated nor reported.
    """
    out = [0.0] * FEATURES
    found = tokens(text)
    hits = [i for i, token in enumerate(found) if weights[token]]
    done, matched = -1, 0
    for at in hits:
        if at < done:
            continue
        start, end = clause_of(found, at)
        done = end
        total = 0.0
        for kind, weight in run_clause(found[start:end], weights):
            out[kind] += weight
            if kind in PLAIN:
                matched += 1
                total += weight
        out[KINDS + 1] = max(out[KINDS + 1], total)
    out[KINDS + 2] = 100.0 * matched / max(1, len(found))
    return out


def transformed(raw: np.ndarray) -> np.ndarray:
    return np.log1p(np.asarray(raw, float).reshape(-1, FEATURES))


def fit_logistic(x: np.ndarray, y: np.ndarray, l1: float = 0.0, l2: float = 0.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression, by accelerated proximal gradient steps.

    The weights are kept at 0 or above: each feature speaks for the label only.
    """
    n, d = x.shape
    x, y = x.astype(np.float32, copy=False), y.astype(np.float32)
    w, b = np.zeros(d, np.float32), math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    v, vb, t = w.copy(), b, 1.0
    rate = np.float32(4.0 / (float(np.einsum("ij,ij->i", x, x).max()) + 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v + np.float32(vb), -30, 30)))
        gradient = (p - y) @ x / np.float32(n) + np.float32(l2) * v
        new = np.maximum(np.float32(0), v - rate * (gradient + np.float32(l1)))
        nb = vb - rate * float((p - y).mean())
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + np.float32((t - 1) / nt) * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return w, b


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, toxic) of about `most` labelled rows outside the held-out fold, texts once.

    Their ids are few and broadcast, so no text is shuffled before it is picked.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = usable.count()
    share = min(1.0, most / max(1, total))
    picked = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").filter(F.col("text").isNotNull())
    return texts.groupBy("text").agg((F.avg("toxic") > 0.5).cast("int").alias("toxic"))


def learn_grammar(rows: DataFrame) -> Grammar:
    """Words and beginnings of words that speak for the label.

    Candidates are counted in Spark by the texts that have them; the CANDIDATES best by
    log odds go into a sparse regression over the sample.
    """

    def found(texts: list[str]) -> Columns:
        out = []
        for text in texts:
            seen = {w for w in map(bare, set(tokens(text))) if len(w) > 2}
            starts = {f"{w[:n]}-" for w in seen for n in BEGINNINGS if len(w) > n}
            out.append(sorted(seen | starts))
        return [out]

    marked = with_columns(rows, "marks array<string>", found, "toxic").checkpoint()
    n_all, n_toxic = marked.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic or n_toxic == n_all:
        return Grammar({}, {})
    counts = marked.select("toxic", F.explode("marks").alias("mark")).groupBy("mark").agg(
        F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")
    )
    odds = F.log((F.col("pos") + 0.1) / (n_toxic + 0.2)) - F.log((F.col("neg") + 0.1) / (n_all - n_toxic + 0.2))
    strong = counts.filter(F.col("pos") >= LEAST_TEXTS).withColumn("gain", F.col("pos") * odds).filter(odds > 1)
    chosen = strong.orderBy(F.desc("gain"), "mark").limit(CANDIDATES).select("mark").collect()
    at = {r["mark"]: i for i, r in enumerate(chosen)}
    if not at:
        return Grammar({}, {})
    wanted = rows.sparkSession.createDataFrame([(m, i) for m, i in at.items()], "mark string, at int")
    held = (
        marked.withColumn("row", F.monotonically_increasing_id())
        .select("row", "toxic", F.explode("marks").alias("mark"))
        .join(F.broadcast(wanted), "mark")
        .groupBy("row", "toxic")
        .agg(F.collect_list("at").alias("at"))
        .select("toxic", "at")
        .collect()
    )
    with_marks = Counter(r["toxic"] for r in held)
    empty = [0] * (n_all - n_toxic - with_marks[0]) + [1] * (n_toxic - with_marks[1])
    # Rows without any candidate have no mark set.
    x = np.zeros((len(held) + len(empty), len(at)), np.float32)
    for i, r in enumerate(held):
        x[i, r["at"]] = 1
    y = np.array([r["toxic"] for r in held] + empty, float)
    w, _ = fit_logistic(x, y, l1=PENALTY)
    learned = {m: float(w[i]) for m, i in at.items() if w[i] >= LEAST_WEIGHT}
    words = {m: v for m, v in learned.items() if not m.endswith("-")}
    return Grammar(words, {m[:-1]: v for m, v in learned.items() if m.endswith("-")})


@lru_cache(maxsize=2)
def _weights(words: tuple, beginnings: tuple) -> Weights:
    return Weights(Grammar(dict(words), dict(beginnings)))


def _shared_weights(grammar: Grammar) -> Weights:
    return _weights(tuple(sorted(grammar.words.items())), tuple(sorted(grammar.beginnings.items())))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and factors from the labelled rows outside the held-out fold."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = training_rows(docs, labels).checkpoint()
    grammar = learn_grammar(rows)

    def measure(texts: list[str]) -> Columns:
        weights = _shared_weights(grammar)
        return [[features(t, weights) for t in texts]]

    held = with_columns(rows, "found array<double>", measure, "toxic").collect()
    if not held:
        return Model(grammar, [1.0] * FEATURES, -3.0)
    x, y = transformed(np.array([r["found"] for r in held])), np.array([r["toxic"] for r in held], float)
    w, b = fit_logistic(x, y, l2=1e-4, steps=1500)
    return Model(grammar, [float(v) for v in w], float(b))


def scored(docs: DataFrame, model: Model, *carried: str) -> DataFrame:
    """The carried columns and score, 0 to 1."""
    grammar, factors, constant = model

    def make(texts: list[str]) -> Columns:
        weights = _shared_weights(grammar)
        x = transformed(np.array([features(t, weights) for t in texts]))
        return [(1 / (1 + np.exp(-np.clip(x @ np.array(factors) + constant, -30, 30)))).tolist()]

    return with_columns(docs, "score double", make, *carried)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`."""
    model = learn(docs, labels)
    return scored(docs, model, "doc_id").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
