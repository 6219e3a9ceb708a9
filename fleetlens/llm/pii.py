"""Personal data: fixed patterns, and spans that weak labelers agree on.

The base kinds (email, ip, card, phone) are found by their patterns alone and always
stay. Further candidates are looked for broadly: groups of digits (phone numbers without
a country code, identity and tax numbers), base patterns whose test fails, account
numbers, keys, passwords, key blocks, names after a form of address, and street
addresses in four languages. They get votes from labelers of three sorts: patterns of
shape and check digits, gazetteers of known beginnings and cue words, and context. Votes
are counted over the whole corpus by pattern of votes, which is bounded by the number of
labelers; base matches that a labeler can judge are counted with them. Expectation
maximisation over those counts estimates how reliable each labeler is and how likely
each pattern is personal data. With these as soft labels a logistic span classifier over
votes and shape is fitted for each kind, and it decides about every candidate.

Null and empty texts have no spans. Rows are judged by themselves, so repeated rows
have equal spans. With no candidates in the corpus there is nothing to fit, and only
base spans are returned. Names without a form of address are not looked for.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.batches import Columns, with_columns
from fleetlens.session import ensure_checkpoint_dir

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "id", "name", "address")
SURE = 0.5
ROUNDS = 50
# Before any span is seen, how often a labeler votes so on a right one (on a wrong one the
# other way round), and how many spans this belief counts for.
EXPECTED = {1: 0.4, 0: 0.55, -1: 0.05}
BELIEF = 10

# The base patterns. Runs of digits are entered at their start only, and
# the local part of an address is looked for around its sign, so that long runs of
# letters or digits are passed once.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

LOOSE_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-]*[0-9])")
# Groups of digits by themselves; what they are is told by their sizes.
GROUPS = re.compile(r"(?<![\w+.,-])\(?[0-9]++\)?(?:[ ./-]\(?[0-9]++\)?)*+(?![\w]|[.,][0-9])")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
KEY = re.compile(
    r"(?<![A-Za-z0-9/+_-])(?:[A-Z]{4}[A-Z0-9]{16}|[A-Za-z]{2,5}_[A-Za-z0-9]{20,}+|[0-9a-f]{32,}+|sk-[A-Za-z0-9_-]{16,}+"
    r"|(?=[A-Za-z+/]*+[0-9])[A-Za-z0-9/+]{40})(?![A-Za-z0-9/+_-])"
)
BLOCK_START = re.compile(r"-----BEGIN ([A-Z ]{0,30})PRIVATE KEY-----")
ASSIGNED = re.compile(r"(?i)(?<![a-z0-9])(password|passwd|pwd|secret|token|api_?key|access_?key)(\s{0,3}[=:]\s{0,3})([\"']?)([^\s\"'#*$%&|<>]{6,}+)")
# Forms of address and words of streets in the languages of the corpus.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra")
NAMED = re.compile(r"(?<!\w)(?:" + "|".join(TITLES) + r")\.? ((?:[^\W\d_a-zà-ÿ][^\W\d_]+(?:[ -](?=[^\W\d_a-zà-ÿ]))?){1,3})")
STREET = re.compile(
    r"(?<!\w)(?:[0-9]{1,5},? (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard)(?!\w)"
    r"|[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|weg|platz|gasse) [0-9]{1,4}[a-z]?(?!\w)"
    r"|[0-9]{1,4},? (?:rue|avenue|boulevard|place) (?:de |du |des |de la |la )?[A-ZÀ-Ý][\w-]+"
    r"|(?:Calle|calle|Avenida|avenida|Plaza|plaza) (?:de |del |de la )?[A-ZÀ-Ý][\w-]+,? (?:n\.?º? ?)?[0-9]{1,4}(?!\w))"
)
STREETS = ("treet", " St", "ve", "oad", "Rd", "ane", "rive", "oulevard", "tra", "weg", "latz", "gasse", "rue", "place", "alle", "venida", "laza")
DIGIT = re.compile(r"[0-9]")
NAMES = ("passw", "pwd", "secret", "token", "key")

# Beginnings of well-known keys, and words that announce personal data.
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "sk_", "sk-", "pk_", "xoxb_", "glpat_", "-----BEGIN")
# Spans longer than this are as varied as can be asked of so many characters.
VARIED = 64
# Votes look at so much of a span.
LONGEST_JUDGED = 4096
CUES = {
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono", "+1"),
    "secret": ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key"),
    "id": ("ssn", "social", "iban", "account", "konto", "compte", "cuenta", "tax", "steuer", "fiscal", "card", "karte", "carte", "tarjeta", "id", "nif"),
    "name": ("dear", "name", "signed", "contact", "liebe", "cher", "estimad", "nombre", "nom"),
    "address": ("address", "lives", "adresse", "wohn", "dirección", "vive", "habite"),
}
VOTES = 6
SHAPES = 6


class Candidate(NamedTuple):
    kind: str
    start: int
    end: int
    votes: tuple[int, ...]
    shape: tuple[int, ...]


class Model(NamedTuple):
    """Weights per kind over votes and shape, the constant last; none if nothing was seen."""

    weights: dict[str, list[float]]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((start, match.end()))
            done = match.end()
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches that do not overlap, per kind; those that fail its test are left out."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def account_checks(span: str) -> bool:
    """The check digits of an international account number (remainder 1 by 97)."""
    compact = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def tax_checks(digits: str) -> bool:
    """The check digit of eleven-digit tax numbers, by tens and elevens in turn."""
    rest = 10
    for c in digits[:10]:
        rest = ((rest + int(c)) % 10 or 10) * 2 % 11
    return digits[0] != "0" and (11 - rest) % 10 == int(digits[10])


def _grouped(span: str) -> str | None:
    """The kind of a group of digits, none if its sizes are those of no number looked for."""
    sizes = [len(g) for g in re.findall("[0-9]+", span)]
    n, spread = sum(sizes), len(sizes) > 1
    if sizes == [3, 2, 4] and "-" in span:
        return "id"
    if sizes == [3, 3, 4]:
        return "phone"
    if span.lstrip("(").startswith("0") and spread and 9 <= n <= 13 and "." not in span.strip("."):
        return "phone"
    if sizes == [11] or sizes == [2, 3, 3, 3] or (13 <= n <= 19 and all(s >= 4 for s in sizes[:-1])):
        return "id"
    return None


def _checked(kind: str, span: str, digits: str) -> int:
    """What check digits and fixed shapes say."""
    if kind == "phone":
        return 1 if "(" in span or span.count("-") == 2 or (digits[:1] == "0" and " " in span) else 0
    if kind == "id":
        if span[:1].isalpha():
            return 1 if account_checks(span) else -1
        if len(digits) == 9:
            return 1 if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" else -1
        if len(digits) == 11:
            return 1 if tax_checks(digits) else -1
        return 1 if luhn(digits) else -1
    if kind == "secret":
        mixed = any(c.isdigit() for c in span) and any(c.isalpha() for c in span)
        return 1 if mixed or span.startswith("-----BEGIN") else -1
    return 1


def _known(kind: str, span: str, digits: str) -> int:
    """What gazetteers of beginnings say."""
    if kind == "phone":
        return 1 if digits[:1] == "0" or (digits[:1] != "1" and digits[3:4] != "0") else -1
    if kind == "secret":
        return 1 if span.startswith(KEY_STARTS) else 0
    return 0


def _votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """What each labeler says of a span: 1 for, 0 nothing, -1 against."""
    span = text[start : min(end, start + LONGEST_JUDGED)]
    before, after = text[max(0, start - 24) : start], text[end : end + 2]
    digits = "".join(c for c in span if c in "0123456789")
    cue = any(c in before.lower() for c in CUES[kind])
    spread = len(set(span.lower())) / max(1, min(VARIED, len(span)))
    single = -1 if (spread < 0.2 if kind == "secret" else len(set(digits)) <= 2 if digits and kind != "address" else False) else 0
    joined = -1 if before[-1:].isalnum() or after[:1].isalnum() else 0
    assigned = 1 if before.rstrip("\"' ")[-1:] in ("=", ":") and before else 0
    return (_checked(kind, span, digits), _known(kind, span, digits), 1 if cue else 0, assigned, joined, single)


def _shape(text: str, start: int, end: int) -> tuple[int, ...]:
    """Coarse facts about a span, each 0 or 1."""
    span = text[start : min(end, start + LONGEST_JUDGED)]
    digits = sum(c.isdigit() for c in span)
    return (
        int(digits >= 7),
        int(digits * 2 >= len(span)),
        int(len(span) >= 16),
        int(any(c.isupper() for c in span)),
        int(any(c.islower() for c in span)),
        int(any(not c.isalnum() for c in span)),
    )


def key_blocks(text: str) -> list[tuple[str, int, int]]:
    """Private keys between their first and last line, or up to the end."""
    out, at = [], 0
    while m := BLOCK_START.search(text, at):
        last = f"-----END {m[1]}PRIVATE KEY-----"
        end = text.find(last, m.end())
        at = len(text) if end < 0 else end + len(last)
        out.append(("secret", m.start(), at))
    return out


def _digit_groups(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in GROUPS.finditer(text):
        if m.end() - m.start() >= 9:
            kind = _grouped(m[0]) if m.end() - m.start() <= 40 else None
            if kind:
                out.append((kind, *m.span()))
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[Candidate]:
    """Spans that may be personal data besides the base ones, apart from each other."""
    found = []
    if DIGIT.search(text):
        found += [("phone", *m.span()) for m in LOOSE_PHONE.finditer(text)]
        found += _digit_groups(text)
        found += [("id", *m.span()) for m in ACCOUNT.finditer(text)]
        found += [("secret", *m.span()) for m in KEY.finditer(text)]
        if any(s in text for s in STREETS):
            found += [("address", *m.span()) for m in STREET.finditer(text)]
    if "-----BEGIN" in text:
        found += key_blocks(text)
    lower = text.lower()
    if any(name in lower for name in NAMES):
        found += [("secret", *m.span(4)) for m in ASSIGNED.finditer(text)]
    found += [("name", *m.span(1)) for m in NAMED.finditer(text)]
    if not found:
        return []
    taken = sorted((a, b) for _, a, b in base)
    out, i, done = [], 0, -1
    for kind, a, b in sorted(set(found), key=lambda s: (s[1], -s[2])):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a < done or (i < len(taken) and taken[i][0] < b):
            continue
        done = b
        out.append(Candidate(kind, a, b, _votes(kind, text, a, b), _shape(text, a, b)))
    return out


def evidence(text: str) -> list[Candidate]:
    """Candidates, and base matches of the kinds that labelers judge."""
    base = base_spans(text)
    kinds = {"phone": "phone", "card": "id"}
    sure = [
        Candidate(kinds[kind], a, b, _votes(kinds[kind], text, a, b), _shape(text, a, b)) for kind, a, b in base if kind in kinds
    ]
    return candidates(text, base) + sure


def estimate(votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How likely each pattern of votes is right, by expectation maximisation.

    Each labeler has, for right and for wrong spans, a chance of each vote. It starts
    from labelers being right more often than not, which few spans don't overturn.
    """
    likely = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1) + 0.5 * (votes.sum(axis=1) <= 0) - 0.25))
    for _ in range(ROUNDS):
        share = ((likely * counts).sum() + 2) / (counts.sum() + 4)
        right = np.full(len(votes), np.log(share))
        wrong = np.full(len(votes), np.log(1 - share))
        for j in range(votes.shape[1]):
            for value in (-1, 0, 1):
                at = votes[:, j] == value
                yes = ((likely * counts)[at].sum() + BELIEF * EXPECTED[value]) / ((likely * counts).sum() + BELIEF)
                no = (((1 - likely) * counts)[at].sum() + BELIEF * EXPECTED[-value]) / (((1 - likely) * counts).sum() + BELIEF)
                right[at] += np.log(yes)
                wrong[at] += np.log(no)
        new = 1 / (1 + np.exp(np.clip(wrong - right, -50, 50)))
        if np.abs(new - likely).max() < 1e-6:
            break
        likely = new
    return likely


def _fit(x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> list[float]:
    """Logistic regression on soft labels; the constant comes last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, share = np.zeros(x.shape[1]), counts / counts.sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + 1e-3 * w
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def learn(docs: DataFrame) -> Model:
    """Fit the span classifier to the votes on all candidates of `docs`."""
    ensure_checkpoint_dir(docs.sparkSession)

    def patterns(texts: list[str]) -> Columns:
        rows = []
        for text in texts:
            rows.append([f"{c.kind} {' '.join(map(str, c.votes + c.shape))}" for c in evidence(text)])
        return [rows]

    counted = with_columns(docs, "patterns array<string>", patterns).select(F.explode("patterns").alias("pattern"))
    seen = counted.groupBy("pattern").count().collect()
    weights = {}
    for kind in KINDS:
        own = [(list(map(int, r["pattern"].split()[1:])), r["count"]) for r in seen if r["pattern"].startswith(kind + " ")]
        if own:
            own.sort()
            x, counts = np.array([f for f, _ in own], float), np.array([n for _, n in own], float)
            weights[kind] = _fit(x, estimate(x[:, :VOTES], counts), counts)
    return Model(weights)


def chance(model: Model, candidate: Candidate) -> float:
    own = model.weights.get(candidate.kind)
    if not own:
        return 0.0
    total = own[-1] + sum(w * v for w, v in zip(own, candidate.votes + candidate.shape))
    return float(1 / (1 + np.exp(-total)))


def written(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


def found(docs: DataFrame, *carried: str) -> DataFrame:
    """The carried columns, the number of base spans by kind, their digest, and all spans."""
    model = learn(docs)

    def make(texts: list[str]) -> Columns:
        columns: Columns = [[] for _ in range(len(BASE) + 2)]
        for text in texts:
            base = base_spans(text)
            more = [(c.kind, c.start, c.end) for c in candidates(text, base) if chance(model, c) >= SURE]
            for column, kind in zip(columns, BASE):
                column.append(sum(s[0] == kind for s in base))
            columns[-2].append(hashlib.sha256(written(base).encode()).hexdigest())
            columns[-1].append(written(base + more))
        return columns

    made = ", ".join(f"n_{kind} long" for kind in BASE) + ", base_sha256 string, spans string"
    return with_columns(docs, made, make, *carried)


def masked(docs: DataFrame, *carried: str) -> DataFrame:
    """The carried columns and the text with every span replaced by its kind in brackets."""
    model = learn(docs)

    def make(texts: list[str]) -> Columns:
        out = []
        for text in texts:
            base = base_spans(text)
            spans = base + [(c.kind, c.start, c.end) for c in candidates(text, base) if chance(model, c) >= SURE]
            done, parts = 0, []
            for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
                if start >= done:
                    parts += [text[done:start], f"[{kind}]"]
                    done = end
            out.append("".join([*parts, text[done:]]))
        return [out]

    return with_columns(docs, "masked string", make, *carried)
