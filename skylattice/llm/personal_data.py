"""Personal data: base patterns, and a linear-chain conditional random field that adds what they miss.

The base patterns find e-mail addresses, IP addresses, card and telephone numbers as
they are usually written.  The field learns from a small labelled table, (text, spans),
how they look otherwise: "jane (at) mail (dot) org", "(415) 555-0132", "10[.]0[.]0[.]7",
cards in groups that dots part.  It labels tokens as outside, first or further token of
a kind, from the shapes of the tokens around (class of characters, length, gap before,
words the examples have, digits and groups of the run a number stands in), from pairs of
classes, and from the label before; it is fitted by its exact likelihood
(forward-backward sums) and decoded by Viterbi over batches of chains in NumPy.

A chain is what stands within ``REACH`` characters of a digit, an ``@``, or an ``at``
with a ``dot`` after it; such stretches that meet are one chain, however long.  Nothing
of the kinds looked for is without one of these, so other text is read for base patterns only.

What the field finds is added if it can be what it says (digits that are a telephone
number's, four parts of at most 255, a card's check digit, an address with a host) and
does not overlap a span of the base patterns, which all stay.

Defined cases: a null or empty text has no spans.  Each row stands for itself, so
repeated and missing ids need no care, and ties do not occur: of equal paths the one
with the earlier label wins.  Without examples the field adds nothing.  An empty table
gives an empty result.  Other columns are not read.  Time is linear in a text's length.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table

KINDS = ("email", "ip", "card", "phone")
#: Labels: outside, then first and further token of each kind.
LABELS = 1 + 2 * len(KINDS)
#: Rows of the labelled table that are learnt from at most; the first by text.
MOST_EXAMPLES = 2000
REACH = 64
AROUND = (-3, -2, -1, 0, 1, 2, 3)
STEPS = 70
RATE = 0.15
PENALTY = 1e-3
CELLS = 60_000  # tokens of a batch of chains, padding included
BLOCK = 2048  # tokens of a chain whose scores are held at a time

# --- base patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Whatever matches starts with a whole run of digits, for the match before took whole runs.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_OTHER = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (twice + sum(map(int, digits[::-2]))) % 10 == 0


def is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_ip(parts: Iterable[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches: each starts where the run before its @ starts, or the match before ended."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            last = host.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    found = [("email", *x) for x in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if is_ip(m[0].split("."))]
        found += [("card", *m.span()) for m in _CARD.finditer(text) if is_card(_OTHER.sub("", m[0]))]
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_OTHER.sub("", m[0])) <= 15]
    return found


# --- tokens and their features

_TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|[^\w\s]|_")
_MARK = re.compile(r"[0-9@]+")
_AT_WORD = re.compile(r"(?<![^\W_])[aA][tT](?![^\W_])")
_DOT_WORD = re.compile(r"[dD][oO][tT](?<![^\W_]...)(?![^\W_])")
FAR = 80  # characters from the start of an ``at`` to its ``dot`` at most
_JOINS = frozenset(" ().-/_[]+,:")
CLASSES = ("edge", "digits", "lower", "upper", "title", "mixed", "letters", "dot", "at", "dash", "open", "close", "plus", "slash", "other")
_CLASS = {name: i for i, name in enumerate(CLASSES)}
_SIGNS = {".": "dot", "@": "at", "-": "dash", "(": "open", "[": "open", "{": "open", "<": "open", ")": "close", "]": "close", "}": "close", ">": "close", "+": "plus", "/": "slash"}


def chains(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches that the field reads."""
    marks = [m.span() for m in _MARK.finditer(text)]
    worded = {at.span() for dot in _DOT_WORD.finditer(text) for at in _AT_WORD.finditer(text, max(0, dot.start() - FAR), dot.start())}
    start = end = -1
    for first, last in sorted([*marks, *worded]) if worded else marks:
        if first - REACH > end:
            if end >= 0:
                yield start, end
            start = max(0, first - REACH)
        end = min(len(text), last + REACH)
    if end >= 0:
        yield start, end


def class_of(token: str) -> str:
    if "0" <= token[0] <= "9":
        return "digits"
    if not (token[0].isalnum()):
        return _SIGNS.get(token, "other")
    if token.islower():
        return "lower"
    if token.isupper():
        return "upper"
    return "title" if token[:1].isupper() and token[1:].islower() else "mixed" if token.upper() != token.lower() else "letters"


def keys(text: str, start: int, end: int, words: frozenset[str]) -> tuple[list[tuple[int, int]], list[tuple]]:
    """Places of a chain's tokens, and what the field sees of each."""
    places = [m.span() for m in _TOKEN.finditer(text, start, end)]
    out: list[tuple] = []
    run: list[int] = []  # tokens of digits that few signs part
    last = start

    def numbered() -> None:
        digits = "".join(text[places[i][0] : places[i][1]] for i in run) if sum(places[i][1] - places[i][0] for i in run) <= 19 else ""
        how = (min(20, len(digits)), min(5, len(run)), bool(digits) and is_card(digits))
        for i in run:
            out[i] = (*out[i], *how)

    for i, (a, b) in enumerate(places):
        token = text[a:b]
        kind = class_of(token)
        gap = min(2, a - last) if "\n" not in text[last:a] else 3
        last = b
        if kind == "digits":
            before = places[run[-1]][1] if run else -9
            if run and not (a - before <= 3 and all(c in _JOINS for c in text[before:a])):
                numbered()
                run = []
            run.append(i)
            small = len(token) <= 3 and int(token) <= 255
            out.append((kind, min(6, b - a), gap, token[0] == "0", small))
        else:
            low = token.lower() if b - a <= 12 else ""
            out.append((kind, min(4, b - a), gap, low if low in words else ""))
    numbered()
    return places, out


def features(key: tuple) -> list[tuple]:
    if len(key) == 1:
        return [key]
    found = [("class", key[0]), ("shape", key[0], key[1]), ("gap", key[2]), ("class and gap", key[0], key[2])]
    if key[0] != "digits":
        return [*found, ("word", key[3])] if key[3] else found
    return [*found, ("zero", key[3]), ("byte", key[4], key[1]), ("run", key[5], key[6]), ("run digits", key[5]), ("groups", key[6], key[1]), ("checked", key[7]), ("checked run", key[7], key[6])]


EDGE = ("edge",)


@dataclass
class Field:
    """Weights of features by place, of pairs of classes and of pairs of labels; what tokens are worth is remembered by key."""

    words: frozenset[str] = frozenset()
    names: dict[tuple, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, len(AROUND), LABELS)))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((len(CLASSES), len(CLASSES), LABELS)))
    steps: np.ndarray = field(default_factory=lambda: np.zeros((LABELS, LABELS)))
    known: dict[tuple, int] = field(default_factory=dict)
    worth: list[np.ndarray] = field(default_factory=list)

    def number(self, key: tuple) -> int:
        """Which row of ``worth`` is the key's.  There are no more keys than shapes times the examples' words."""
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.worth)
            at = [self.names[f] for f in features(key) if f in self.names]
            self.worth.append(self.weights[at].sum(axis=0))
        return found


ALLOWED = np.zeros((LABELS, LABELS))
for _k in range(len(KINDS)):
    ALLOWED[[x for x in range(LABELS) if x not in (1 + 2 * _k, 2 + 2 * _k)], 2 + 2 * _k] = -np.inf
FIRST = np.where(np.arange(LABELS) % 2 == 0, -np.inf, 0.0)
FIRST[0] = 0.0


def emissions(ids: np.ndarray, classes: np.ndarray, worth: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Scores of the labels of each token but the padding of three on either side; ``worth`` by key, place and label."""
    n = ids.shape[1] - 6
    out = sum(worth[ids[:, 3 + o : 3 + o + n], at] for at, o in enumerate(AROUND))
    return out + pairs[classes[:, 2 : 2 + n], classes[:, 3 : 3 + n]]


# --- learning


def expected(scores: np.ndarray, sizes: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the labels of each token, and of pairs of labels, how often each is expected: forward and backward sums.

    Sums are scaled to 1 at each token; what lies behind a chain's end counts as 1 in the backward sums.
    """
    m, n, _ = scores.shape
    go = np.exp(steps + ALLOWED)
    likely = np.exp(scores - scores.max(axis=2, keepdims=True))
    ahead, back, scale = np.zeros_like(scores), np.ones_like(scores), np.ones((m, n, 1))
    ahead[:, 0] = likely[:, 0] * np.exp(FIRST)
    for t in range(n):
        if t:
            ahead[:, t] = (ahead[:, t - 1] @ go) * likely[:, t]
        scale[:, t] = ahead[:, t].sum(axis=1, keepdims=True)
        ahead[:, t] /= scale[:, t]
    both = np.zeros((LABELS, LABELS))
    for t in range(n - 2, -1, -1):
        inside = (t + 1 < sizes)[:, None]
        after = np.where(inside, likely[:, t + 1] * back[:, t + 1] / scale[:, t + 1], 0.0)
        back[:, t] = np.where(inside, after @ go.T, 1.0)
        both += go * (ahead[:, t].T @ after)
    one = ahead * back
    one[np.arange(n)[None, :] >= sizes[:, None]] = 0.0
    return one, both


def labels_of(places: list[tuple[int, int]], spans: Iterable[tuple[str, int, int]]) -> list[int]:
    out = [0] * len(places)
    for kind, start, end in spans:
        mine = [i for i, (a, b) in enumerate(places) if a >= start and b <= end]
        for nth, i in enumerate(mine):
            out[i] = 1 + 2 * KINDS.index(kind) + (nth > 0)
    return out


def learn(examples: list[tuple[str, list[tuple[str, int, int]]]], steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Field | None:
    """The field of the greatest penalised likelihood, near enough, of (text, spans); None without examples."""
    seen: dict[str, int] = {}
    for text, _ in examples:
        for w in set(re.findall(r"[^\W0-9_]+", text.lower())):
            seen[w] = seen.get(w, 0) + 1
    words = frozenset(w for w, n in seen.items() if n >= 3 and len(w) <= 12)
    read = [(*keys(text, a, b, words), spans) for text, spans in examples for a, b in chains(text)]
    read = [r for r in read if r[0]]
    if not read:
        return None
    model = Field(words)
    known: dict[tuple, int] = {EDGE: 0}
    for _, found, _ in read:
        for key in found:
            known.setdefault(key, len(known))
    for key in known:
        for f in features(key):
            model.names.setdefault(f, len(model.names))
    has = np.zeros((len(known), len(model.names)))
    for key, i in known.items():
        has[i, [model.names[f] for f in features(key)]] = 1.0
    sizes = np.array([len(r[0]) for r in read])
    n = sizes.max()
    ids = np.zeros((len(read), n + 6), np.int64)
    classes = np.zeros((len(read), n + 6), np.int64)
    gold = np.zeros((len(read), n, LABELS))
    follows = np.zeros((LABELS, LABELS))
    for i, (places, found, spans) in enumerate(read):
        ids[i, 3 : 3 + len(found)] = [known[k] for k in found]
        classes[i, 3 : 3 + len(found)] = [_CLASS[k[0]] for k in found]
        mine = labels_of(places, spans)
        gold[i, np.arange(len(mine)), mine] = 1.0
        np.add.at(follows, (mine[:-1], mine[1:]), 1.0)
    weights = [np.zeros((len(model.names), len(AROUND), LABELS)), np.zeros_like(model.pairs), np.zeros_like(model.steps)]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        worth = np.tensordot(has, weights[0], 1)
        one, both = expected(emissions(ids, classes, worth, weights[1]), sizes, weights[2])
        miss = one - gold
        of_key, of_pair = np.zeros_like(worth), np.zeros_like(weights[1])
        for at, o in enumerate(AROUND):
            np.add.at(of_key[:, at], ids[:, 3 + o : 3 + o + n], miss)
        np.add.at(of_pair, (classes[:, 2 : 2 + n], classes[:, 3 : 3 + n]), miss)
        slopes = [np.tensordot(has.T, of_key, 1), of_pair, both - follows]
        for w, g, m1, m2 in zip(weights, slopes, mean, square, strict=True):
            g = g / len(read) + penalty * w
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.99
            m2 += 0.01 * g * g
            w -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    model.weights, model.pairs, model.steps = weights
    return model


# --- finding


def viterbi(model: Field, found: list[list[tuple]]) -> list[np.ndarray]:
    """The best labels of each of some chains of keys; scores are held for ``BLOCK`` tokens of each at a time."""
    n = max(map(len, found))
    m = len(found)
    edge = model.number(EDGE)
    ids = np.full((m, n + 6), edge, np.int32)
    classes = np.zeros((m, n + 6), np.int8)
    for i, chain in enumerate(found):
        ids[i, 3 : 3 + len(chain)] = [model.number(k) for k in chain]
        classes[i, 3 : 3 + len(chain)] = [_CLASS[k[0]] for k in chain]
    worth = np.stack(model.worth)
    sizes = np.array([len(c) for c in found])
    go = model.steps + ALLOWED
    came = np.zeros((n, m, LABELS), np.int8)
    score = np.zeros((m, LABELS))
    every = np.arange(m)[:, None], np.arange(LABELS)[None, :]
    for low in range(0, n, BLOCK):
        part = emissions(ids[:, low : low + BLOCK + 6], classes[:, low : low + BLOCK + 6], worth, model.pairs)
        for t in range(part.shape[1]):
            if low + t == 0:
                score = part[:, 0] + FIRST
                continue
            ways = score[:, :, None] + go
            best = ways.argmax(axis=1)
            inside = (low + t < sizes)[:, None]
            came[low + t] = np.where(inside, best, np.arange(LABELS))
            score = np.where(inside, ways[every[0], best, every[1]] + part[:, t], score)
    path = np.zeros((n, m), np.int8)
    path[-1] = score.argmax(axis=1)
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, np.arange(m), path[t]]
    return [path[: sizes[i], i] for i in range(m)]


def spans_of(path: np.ndarray, places: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    at = 0
    inside = np.flatnonzero(path)
    while at < len(inside):
        first = last = inside[at]
        while at + 1 < len(inside) and inside[at + 1] == last + 1 and path[last + 1] % 2 == 0:
            at += 1
            last = inside[at]
        at += 1
        yield KINDS[(path[first] - 1) // 2], places[first][0], places[last][1]


_AT = re.compile(r"(?<![^\W_])at(?![^\W_])|@", re.I)
_DOT = re.compile(r"(?<![^\W_])dot(?![^\W_])|\.", re.I)


def can_be(kind: str, text: str) -> bool:
    """Whether a span that the field found can be what it says."""
    digits = _OTHER.sub("", text)
    if kind == "email":
        at = _AT.search(text)
        return at is not None and at.start() > 0 and _DOT.search(text, at.end()) is not None and len(text) <= 254
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and is_ip(parts)
    if kind == "card":
        return is_card(digits)
    return 7 <= len(digits) <= 15 and digits != text and text.count(".") != 1


class Finder:
    """Spans of texts: those of the base patterns, and what the field adds."""

    def __init__(self, model: Field | None):
        self.model = model

    def __call__(self, texts: list[str]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
        base = [base_spans(t) for t in texts]
        added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        if self.model is not None:
            read = [(i, *keys(t, a, b, self.model.words)) for i, t in enumerate(texts) for a, b in chains(t)]
            read = sorted((r for r in read if r[1]), key=lambda r: len(r[1]))
            while read:
                wide = max(1, min(len(read), CELLS // len(read[-1][1])))
                now, read = read[-wide:], read[:-wide]
                for (i, places, _), path in zip(now, viterbi(self.model, [r[2] for r in now]), strict=True):
                    added[i] += spans_of(path, places)
        return [(known, clear_of(known, [s for s in more if can_be(s[0], t[s[1] : s[2]])])) for t, known, more in zip(texts, base, added, strict=True)]


def clear_of(known: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Those of ``more``, which do not overlap each other, that overlap none of ``known``."""
    out, taken, at = [], sorted((a, b) for _, a, b in known), 0
    far = -1  # how far the spans go that start before
    for kind, start, end in sorted(more, key=lambda s: s[1]):
        while at < len(taken) and taken[at][0] < end:
            far = max(far, taken[at][1])
            at += 1
        if far <= start:
            out.append((kind, start, end))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def train(examples: DataFrame, most: int = MOST_EXAMPLES) -> Field | None:
    """The field of a small labelled table (text, spans: array of kind, start, end); of the first ``most`` rows by text."""
    rows = examples.where(F.col("text").isNotNull()).select("text", "spans").orderBy("text").limit(most).collect()
    return learn([(r["text"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] or []]) for r in rows])


def find(docs: DataFrame, model: Field | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of ``docs`` (doc_id, text).

    The numbers and the digest are of the base spans; ``spans`` has all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            found = finder([t or "" for t in batch.column("text").to_pylist()])
            counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
            sums = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(sums, pa.string()), pa.array([joined(base + more) for base, more in found], pa.string()), pa.array([len(more) for _, more in found], pa.int64())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(kernel, f"doc_id {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


# --- the labelled table


def _examples(seed: int = 12, each: int = 12) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences by rule: ``each`` of every form, in changing company."""
    rnd = random.Random(seed)
    number = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rnd.choice(["an", "er", "to", "la", "mi", "str", "on", "de", "que", "ung", "th", "é", "ñ"]) for _ in range(rnd.randint(1, 4)))
    name = lambda: rnd.choice(["", "j.", "info.", "mr-"]) + word() + rnd.choice(["", "", number(2)])
    some = lambda n: " ".join(word() for _ in range(rnd.randint(1, n))) + rnd.choice(["", ",", ".", ":"])
    byte = lambda: str(rnd.randint(0, 255))

    def card() -> str:
        body = rnd.choice("3456") + number(14)
        return next(body + d for d in "0123456789" if luhn(body + d))

    def no_card() -> str:
        good = card()
        return good[:-1] + str((int(good[-1]) + rnd.randint(1, 9)) % 10)

    def groups(digits: str, by: str) -> str:
        return by.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    forms = {
        "email": [
            lambda: f"{name()}@{word()}.{rnd.choice(['com', 'org', 'example.net'])}",
            lambda: f"{name()} (at) {word()} (dot) {rnd.choice(['com', 'org'])}",
            lambda: f"{name()}[at]{word()}[dot]{rnd.choice(['com', 'net'])}",
            lambda: f"{name()} at {word()} dot {rnd.choice(['com', 'de', 'org'])}",
            lambda: f"{name()} @ {word()} . {rnd.choice(['com', 'org'])}",
            lambda: f"{name()} AT {word()} DOT com",
        ],
        "ip": [lambda: ".".join(byte() for _ in range(4)), lambda: "[.]".join(byte() for _ in range(4)), lambda: " . ".join(byte() for _ in range(4)), lambda: "(.)".join(byte() for _ in range(4))],
        "card": [card, lambda: groups(card(), "-"), lambda: groups(card(), "."), lambda: groups(card(), " "), lambda: groups(card(), "/"), lambda: groups(card(), "_")],
        "phone": [
            lambda: f"+{rnd.randint(1, 99)} ({number(3)}) {number(3)}-{number(4)}",
            lambda: f"({number(3)}) {number(3)}-{number(4)}",
            lambda: f"({number(3)}) {number(3)} {number(4)}",
            lambda: f"{number(3)}-{number(3)}-{number(4)}",
            lambda: f"0{number(3)}/{number(6)}",
            lambda: f"00{rnd.randint(1, 99)} {number(2)} {number(4)} {number(4)}",
        ],
        "": [
            lambda: f"{rnd.randint(1900, 2030)}-{number(1)}{number(1)}-{number(2)}",
            lambda: f"{rnd.randint(1, 28)}.{rnd.randint(1, 12)}.{rnd.randint(1900, 2030)}",
            lambda: f"{number(2)}.{number(2)}",
            lambda: f"{number(1)},{number(3)},{number(3)}.{number(2)}",
            lambda: f"v{number(1)}.{number(1)}.{number(2)}",
            lambda: f"{number(2)}:{number(2)}:{number(2)}",
            lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.randint(8, 40))),
            lambda: f'token = "{"".join(rnd.choice("0123456789abcdef") for _ in range(40))}"',
            no_card,
            lambda: groups(no_card(), " "),
            lambda: number(rnd.randint(1, 12)),
            lambda: f"{word()}{number(3)}",
            lambda: f"at {word()} {number(2)} dot {word()}",
            lambda: f"{word()} at the {word()} . {word()} dot",
            lambda: f"{number(3)}%",
            lambda: f"{number(2)}-{number(2)}",
            lambda: f"{number(2)}.{number(4)}, -{number(2)}.{number(4)}",
            lambda: ".".join(str(rnd.randint(256, 999)) for _ in range(4)),
            lambda: f"{byte()}.{byte()}.{byte()}",
            lambda: f"{number(4)} {number(4)}",
            lambda: f"{number(3)} {number(2)} {number(1)} {number(3)} {number(2)} {number(3)} {number(4)} {number(2)} {number(3)}",
        ],
    }
    before = {"email": ["mail", "write to", "e-mail:", "contact"], "ip": ["host", "from", "server", "ip"], "card": ["card", "visa", "paid with", "no."], "phone": ["call", "tel", "phone:", "fax"], "": ["order", "on", "in", "page", "from", "no.", "at", "call"]}
    for kind, makers in forms.items():
        for make in makers:
            for _ in range(each):
                lead = some(5) + " " + rnd.choice([*before[kind], "", "", ""]) + " "
                body = make()
                yield lead + body + rnd.choice([" ", ". ", ", ", "; ", ") "]) + some(5), [(kind, len(lead), len(lead) + len(body))] if kind else []


def labelled(spark: SparkSession) -> DataFrame:
    """The small labelled table (text, spans) that the query learns from, made by rule."""
    return spark.createDataFrame(list(_examples()), "text string, spans array<struct<kind string, start int, end int>>")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(labelled(spark))
    with small_batches(spark):
        return stored(find(table(spark, sf_dir, "documents").select("doc_id", "text"), model), "personal-data")
