"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card and phone numbers; what they find stays as
it is. The field labels what else could be personal data, in every text that has such
candidates, whether or not a pattern found something there: runs of neighbouring digit groups,
tokens with "@", five digits or a mix of letters and digits, and what follows a word such as
"password". Its labels are the patterns' kinds and ADDED ones: secrets, and numbers of
persons and accounts. Its graph joins neighbouring candidates (the chain) and, however far
apart, candidates that are the same or similar: equal letters and digits, equal last seven
digits, equal local part of an address (the skips). Found spans are clamped to their kind;
loopy message passing spreads labels over chain and skips, and a candidate whose marginal
probability for one kind reaches ACCEPT becomes a further span (of several kinds that are as
probable, the first in order).

Potentials are learned in numpy by pseudo-likelihood, from texts into which examples of known
labels were put: made-up data of every kind, with and without words that announce them, some
repeated later in the text in another form, and decoys (years, versions, amounts, numbers
whose check digit fails). What the patterns find there counts with its kind; what else the
texts hold has no label and is not learned from. The texts are at most MAX_TRAIN_TEXTS, the
first by a hash of their ids; only candidates reach the driver. Without texts the examples
stand alone.

Skips of one form are joined through one hub node, so a form that stands n times has n edges,
not all pairs; a text's graph grows with its length. Offsets are code points. Null and empty
texts have no spans; a very long text is searched whole, in time linear in its length. Rows
never meet, and equal rows get equal results.
"""

from __future__ import annotations

import json
import random
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the field finds.
ADDED = ("secret", "account")
ALL_KINDS = KINDS + ADDED
MAX_TRAIN_TEXTS = 2000
ACCEPT = 0.9
ITERATIONS = 10
#: Code points between neighbours of the chain.
NEAR = 80

#: Words that announce a kind, in lower case (fixed values).
CUES = {
    "email": "e-mail email mail",
    "ip": "ip host server address",
    "card": "card visa mastercard amex credit",
    "phone": "phone tel telephone call mobile cell fax",
    "secret": "token password passwd pwd secret api_key apikey api-key access_key private_key key credential auth bearer",
    "account": "ssn iban passport account social security tax licence license id",
}

Span = tuple[int, int, int]  # kind, start, end

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_MARKED = re.compile(r"[0-9@]")
_GROUPS = re.compile(r"[0-9][0-9() .-]*[0-9]")
_VALUE = re.compile(r"(?:token|passw(?:or)?d|pwd|secret|(?:api|access|private)[_-]?key|credential)s?[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"']+)", re.IGNORECASE)


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def addresses(text: str) -> Iterator[Span]:
    """[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ in time linear in the text: the part
    before an "@" can only begin where its characters do, after the last "@" or match."""
    least, at = 0, text.find("@")
    while at >= 0:
        start = least + len(text[least:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield 0, start, m.end()
        least = m.end() if m else at + 1
        at = text.find("@", least)


def ip_addresses(text: str) -> Iterator[Span]:
    """[0-9]+(\\.[0-9]+){3} with parts up to 255, in linear time over runs of digits and dots."""
    for run in _DOTTED.finditer(text):
        parts = run[0].split(".")
        starts = [run.start()]
        for p in parts:
            starts.append(starts[-1] + len(p) + 1)
        i = 0
        while i + 4 <= len(parts):
            if all(parts[i : i + 4]):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                    yield 1, starts[i], starts[i + 4] - 1
                i += 4
            else:
                i += 1


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by kind and start: leftmost, not overlapping; failing matches go."""
    out = list(addresses(text)) if "@" in text else []
    if not _DIGITS.search(text):
        return out
    out += ip_addresses(text)
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and passes_luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


@dataclass
class Graph:
    """Candidates of one text with their labels (0 none, 1.. kinds, -1 open), looks and forms."""

    spans: list[tuple[int, int]] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    looks: list[list[float]] = field(default_factory=list)
    forms: list[tuple[str, ...]] = field(default_factory=list)


def forms_of(text: str) -> tuple[str, ...]:
    """What two mentions of one datum share: letters and digits, the last seven digits, an address's local part."""
    plain = "".join(c for c in text.lower() if c.isalnum())
    digits = "".join(c for c in text if c in "0123456789")
    found = {plain} if len(plain) >= 5 and not plain.isalpha() else set()
    if len(digits) >= 7 and len(digits) >= 0.8 * len(plain):
        found.add("#" + digits[-7:])
    if "@" in text:
        local = "".join(c for c in text.split("@")[0].lower() if c.isalnum())
        if len(local) >= 5 and not local.isalpha():
            found.add(local)
    return tuple(sorted(found))


_CUE_WORDS = {w: k for k, words in CUES.items() for w in words.split()}
_WORD = re.compile(r"[A-Za-z][A-Za-z_-]*")


def look(text: str, start: int, end: int) -> list[float]:
    """Features of a candidate: how it looks, and which announcing words stand in the 32 code points before it."""
    own = text[start:end]
    n = len(own)
    digits = sum(c in "0123456789" for c in own)
    letters = sum(c.isalpha() for c in own)
    plain = "".join(c for c in own if c in "0123456789")
    before = text[max(0, start - 32) : start]
    cues = {_CUE_WORDS[w] for w in _WORD.findall(before.lower()) if w in _CUE_WORDS}
    switches = sum((a in "0123456789") != (b in "0123456789") for a, b in zip(own, own[1:])) if letters else 0
    return [
        1.0,
        float("@" in own),
        float(own[0] == "+"),
        float(own.count(".") == 3 and digits + 3 == n),
        min(own.count("-") + own.count(" ") + own.count("("), 6) / 6,
        min(own.count("."), 4) / 4,
        digits / n,
        float(13 <= digits <= 19 and not letters and passes_luhn(plain)),
        float(13 <= digits <= 19 and not letters),
        float(9 <= digits <= 12),
        float(7 <= digits <= 8),
        float(digits < 7),
        float(letters > 0 and digits > 0),
        float(letters > 0 and digits == 0),
        min(n, 40) / 40,
        min(switches, 8) / 8,
        float(n >= 20 and letters > 0 and "@" not in own),
        float(own[:2].isalpha() and own[:2].isupper() and own[2:4].isdigit()),
        float(before.rstrip(" \"'").endswith(("=", ":"))),
        *[float(k in cues) for k in CUES],
    ]


N_LOOK = 19 + len(CUES)
N_LABELS = len(ALL_KINDS) + 1


def candidates(text: str, found: list[Span]) -> Graph:
    """Found spans, and stretches that could be personal data and do not overlap them or one another."""
    rows = [(s, e, k + 1) for k, s, e in found]
    taken = sorted((s, e) for s, e, _ in rows)
    more: list[tuple[int, int]] = []
    for m in _VALUE.finditer(text):
        more.append(_trimmed(text, *m.span(1)))
    if _DIGITS.search(text):
        for m in _GROUPS.finditer(text):
            s, e = m.span()
            if sum(c in "0123456789" for c in m[0]) >= 7:
                s -= s > 0 and text[s - 1] in "+(" and not (s > 1 and text[s - 2].isalnum())
                if not (s and text[s - 1].isalnum()) and not (e < len(text) and (text[e].isalnum() or text[e] == "@")):
                    more.append((s, e))
    known = {f for s, e, _ in rows for f in forms_of(text[s:e])}
    at = 0
    for m in _MARKED.finditer(text):
        if m.start() < at:
            continue
        s = m.start()
        while s > at and not text[s - 1].isspace():
            s -= 1
        e = m.end()
        while e < len(text) and not text[e].isspace():
            e += 1
        at = e
        s, e = _trimmed(text, s, e)
        token = text[s:e]
        digits = sum(c in "0123456789" for c in token)
        mixed = len(token) >= 12 and any(c.isalpha() for c in token)
        if digits >= 5 or "@" in token or digits and mixed or digits and known and known & set(forms_of(token)):
            more.append((s, e))
    # earlier and longer ones first; what overlaps is left out
    end, i = 0, 0
    for s, e in sorted(set(more), key=lambda x: (x[0], -x[1])):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s < e and s >= end and not (i < len(taken) and taken[i][0] < e):
            rows.append((s, e, -1))
            end = e
    graph = Graph()
    for s, e, label in sorted(rows):
        graph.spans.append((s, e))
        graph.labels.append(label)
        graph.looks.append(look(text, s, e))
        graph.forms.append(forms_of(text[s:e]))
    return graph


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    """The stretch without marks at its ends."""
    while s < e and not (text[s].isalnum() or text[s] in "+("):
        s += 1
    while s < e and not text[e - 1].isalnum():
        e -= 1
    return s, e


@dataclass(frozen=True)
class Potentials:
    """Log-potentials: looks by label, chain by label of the left and the right one, skip (symmetric) by hub and member."""

    looks: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def neutral() -> Potentials:
    return Potentials(np.zeros((N_LOOK, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), np.eye(N_LABELS) * 6.0)


def edges(graph: Graph) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Chain edges between near neighbours, and groups of candidates that share a form."""
    chain = [(i, i + 1) for i in range(len(graph.spans) - 1) if graph.spans[i + 1][0] - graph.spans[i][1] <= NEAR]
    groups: dict[str, list[int]] = defaultdict(list)
    for i, forms in enumerate(graph.forms):
        for f in forms:
            groups[f].append(i)
    return chain, [list(g) for g in sorted({tuple(g) for g in groups.values() if len(g) > 1})]


def node_scores(graph: Graph, potentials: Potentials) -> np.ndarray:
    out = np.array(graph.looks).reshape(-1, N_LOOK) @ potentials.looks
    for i, label in enumerate(graph.labels):
        if label >= 0:
            out[i] = -40.0
            out[i, label] = 0.0
    return out


def marginals(graph: Graph, potentials: Potentials, iterations: int = ITERATIONS) -> np.ndarray:
    """Label probabilities of each candidate by loopy sum-product; hubs stand behind the candidates."""
    n = len(graph.spans)
    chain, groups = edges(graph)
    unary = np.zeros((n + len(groups), N_LABELS))
    unary[:n] = node_scores(graph, potentials)
    pairs = [(a, b, potentials.chain) for a, b in chain] + [(i, n + g, potentials.skip) for g, members in enumerate(groups) for i in members]
    scores = unary
    if pairs:
        src = np.array([p[0] for p in pairs] + [p[1] for p in pairs])
        dst = np.array([p[1] for p in pairs] + [p[0] for p in pairs])
        table = np.array([p[2] for p in pairs] + [p[2].T for p in pairs])
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        messages = np.zeros((len(src), N_LABELS))
        for _ in range(iterations):
            scores = unary.copy()
            np.add.at(scores, dst, messages)
            into = scores[src] - messages[back]
            new = np.logaddexp.reduce(into[:, :, None] + table, axis=1)
            new -= new.max(axis=1, keepdims=True)
            messages = 0.5 * messages + 0.5 * new
        scores = unary.copy()
        np.add.at(scores, dst, messages)
    scores = scores[:n] - scores[:n].max(axis=1, keepdims=True)
    p = np.exp(scores)
    return p / p.sum(axis=1, keepdims=True)


# --- examples -------------------------------------------------------------------------------


def _number(rng: random.Random, n: int) -> str:
    return str(rng.randrange(1, 10)) + "".join(rng.choice("0123456789") for _ in range(n - 1))


def _checked(rng: random.Random, n: int, good: bool) -> str:
    head = _number(rng, n - 1)
    return next(head + c for c in (rng.sample("0123456789", 10)) if passes_luhn(head + c) == good)


def example(rng: random.Random, kind: str) -> tuple[str, str]:
    """A made-up datum, and another form of the same."""
    n = lambda k: _number(rng, k)
    if kind == "email":
        local = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) + rng.choice([".", "_", ""]) + n(rng.randrange(1, 4))
        whole = f"{local}@{rng.choice(['mail', 'post', 'web'])}{n(1)}.example.{rng.choice(['com', 'org', 'net'])}"
        return whole, local
    if kind == "ip":
        made = ".".join(str(rng.randrange(256)) for _ in range(4))
        return made, made
    if kind == "card":
        made = _checked(rng, rng.choice([13, 14, 15, 16, 16, 16]), True)
        split = rng.choice(["", " ", "-"]).join(made[i : i + 4] for i in range(0, len(made), 4))
        return split, made
    if kind == "phone":
        area, a, b = n(3), n(3), n(4)
        return rng.choice([f"+1 ({area}) {a}-{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"+{n(2)} {area} {a}{b}", f"0{area[:2]} {a} {b}"]), rng.choice([f"{area}{a}{b}", f"({area}) {a}-{b}", f"{area} {a} {b}"])
    if kind == "secret":
        size = rng.choice([20, 24, 32, 40, 40, 64])
        letters = rng.choice(["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"])
        made = "".join(rng.choice(letters) for _ in range(size)) if rng.random() < 0.8 else rng.choice(["sk-", "ghp_", "AKIA"]) + "".join(rng.choice(letters) for _ in range(20))
        return made, made
    if rng.random() < 0.5:
        made = f"{n(3)}-{n(2)}-{n(4)}"
        return made, made.replace("-", rng.choice(["", " "]))
    made = rng.choice(["DE", "FR", "GB", "ES"]) + n(2) + n(rng.choice([16, 18]))
    return made, " ".join(made[i : i + 4] for i in range(0, len(made), 4)) if rng.random() < 0.3 else made


def decoy(rng: random.Random) -> str:
    """What looks a little like personal data and is not."""
    n = lambda k: _number(rng, k)
    return rng.choice(
        [
            f"{n(1)}.{n(1)}.{n(2)}", n(rng.randrange(5, 13)), _checked(rng, rng.randrange(13, 20), False), f"{n(2)},{n(3)},{n(3)}", f"19{n(2)}-20{n(2)}", f"20{n(2)}-0{n(1)}-1{n(1)}",
            f"ISBN {n(9)}", f"page{n(5)}", f"v{n(1)}.{n(1)}.{n(4)}", f"{n(3)} {n(3)} {n(3)}", f"{n(5)}km", f"{n(6)}.{n(2)}", f"item{n(6)}x", "@here", "@name", f"{n(4)}/{n(4)}",
        ]
    )


def planted(text: str, rng: random.Random) -> Graph:
    """The candidates of a text into which examples were put, with their labels (-1: what else stands there)."""
    words = text.split(" ")
    put: list[tuple[int, str, int]] = []  # place, text, label
    for _ in range(rng.randrange(1, 5)):
        place = rng.randrange(len(words) + 1)
        if rng.random() < 0.4:
            put.append((place, decoy(rng), 0))
            continue
        kind = rng.choice(ALL_KINDS)
        made, again = example(rng, kind)
        if rng.random() < (0.75 if kind in ("secret", "account") else 0.3):
            word = rng.choice(CUES[kind].split())
            made_with = rng.choice([f"{word}: {made}", f'{word} = "{made}"', f"{word} {made}", f"{word.upper()}={made}"])
        else:
            made_with = made
        put.append((place, made_with, 1 + ALL_KINDS.index(kind)))
        if rng.random() < 0.4:
            put.append((rng.randrange(place, len(words) + 1), again, 1 + ALL_KINDS.index(kind)))
    out, spans, size = [], [], 0
    put.sort(key=lambda p: p[0])
    for i in range(len(words) + 1):
        for _, made, label in (p for p in put if p[0] == i):
            out.append(made)
            spans.append((size, size + len(made), label))
            size += len(made) + 1
        if i < len(words):
            out.append(words[i])
            size += len(words[i]) + 1
    whole = " ".join(out)
    graph = candidates(whole, base_spans(whole))
    for i, (s, e) in enumerate(graph.spans):
        label = next((k for a, b, k in spans if a <= s and e <= b), None)
        if label is not None:
            graph.labels[i] = label
    return graph


def fit(graphs: list[Graph], steps: int = 800, least: int = 1500) -> Potentials:
    """Potentials of the pseudo-likelihood: each labelled candidate given the labels of those joined to it.
    Fewer than `least` graphs are made up by examples that stand alone."""
    rng = random.Random(5)
    graphs = graphs + [planted("", rng) for _ in range(least - len(graphs))]
    looks, left, right, hub, labels = [], [], [], [], []
    one = np.eye(N_LABELS)
    for g in graphs:
        chain, groups = edges(g)
        sides = np.zeros((3, len(g.spans), N_LABELS))
        for a, b in chain:
            if g.labels[a] >= 0 and g.labels[b] >= 0:
                sides[0, b] += one[g.labels[a]]
                sides[1, a] += one[g.labels[b]]
        for members in groups:
            known = [i for i in members if g.labels[i] >= 0]
            for i in known:
                others = [g.labels[j] for j in known if j != i]
                if others:
                    sides[2, i] += one[max(set(others), key=lambda k: (others.count(k), -k))]
        for i, label in enumerate(g.labels):
            if label >= 0:
                looks.append(g.looks[i])
                labels.append(label)
                for store, side in zip((left, right, hub), sides):
                    store.append(side[i])
    x, l, r, h, y = (np.array(v, float) for v in (looks, left, right, hub, labels))
    y = y.astype(int)
    w, c, s = np.zeros((N_LOOK, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), np.zeros((N_LABELS, N_LABELS))
    speed = [np.zeros_like(v) for v in (w, c, s)]
    for _ in range(steps):
        z = x @ w + l @ c + r @ c.T + h @ s
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        both = h.T @ p
        grads = (x.T @ p + 2e-4 * w, l.T @ p + (r.T @ p).T + 2e-3 * c, (both + both.T) / 2 + 2e-4 * s)
        for v, old, grad in zip((w, c, s), speed, grads):
            old *= 0.9
            old += grad
            v -= 1.0 * old
    return Potentials(w, c, s)


def all_spans(text: str, potentials: Potentials) -> tuple[list[Span], list[Span]]:
    """Found spans, and those with what the field adds, both by kind and start."""
    found = base_spans(text)
    graph = candidates(text, found)
    if len(graph.spans) == len(found):
        return found, found
    p = marginals(graph, potentials)
    added = [(int(np.argmax(p[i, 1:])), *graph.spans[i]) for i, label in enumerate(graph.labels) if label < 0 and p[i, 1:].max() >= ACCEPT]
    return found, sorted(found + added)


def learn_potentials(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = MAX_TRAIN_TEXTS) -> Potentials:
    """Fits on the first `most` texts by a hash of their ids; an id counts once, with its least text."""
    some = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    ids = some.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    rows = some.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text")).select(F.xxhash64("id", "text").alias("h"), "text")

    def make() -> Callable[[list[bytes]], list]:
        def kernel(texts: list[bytes]) -> list:
            made = []
            for raw in texts:
                whole = raw.decode("utf-8", "replace")
                made.append(json.dumps(asdict(planted(whole, random.Random(len(whole))))))
            return [made]

        return kernel

    # only candidates reach the driver
    got = map_texts(rows, "text", [T.StructField("graph", T.StringType())], make, keep=["h"]).orderBy("h", "graph").select("graph").toArrow()
    return fit([Graph(**json.loads(g)) for g in got.column("graph").to_pylist()])


FIELDS = [
    *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
    T.StructField("base", T.StringType()),
    T.StructField("spans", T.StringType()),
    T.StructField("n_spans", T.LongType()),
]


def shown(spans: list[Span]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_personal_data(docs: DataFrame, potentials: Potentials, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds counts of what the patterns find, base and spans as kind:start:end, comma-joined, and n_spans, how many there are in all."""

    def make() -> Callable[[list[bytes]], list]:
        def kernel(texts: list[bytes]) -> list:
            out: list[list] = [[] for _ in FIELDS]
            for raw in texts:
                found, every = all_spans(raw.decode("utf-8", "replace"), potentials)
                counts = [sum(k == i for k, _, _ in found) for i in range(len(KINDS))]
                for column, value in zip(out, [*counts, shown(found), shown(every), len(every)], strict=True):
                    column.append(value)
            return out

        return kernel

    return map_texts(docs, text, FIELDS, make, keep)
