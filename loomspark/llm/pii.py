"""Personal data: overlapping candidate spans, scored by boosted trees with calibrated thresholds.

Base spans follow fixed patterns with checks and always stay. Beside them high-recall generators
propose looser spans (national phone numbers, spelled-out addresses, shorter cards, long internet
addresses). Gradient-boosted trees score each by its format and its surroundings; Platt scaling turns
the score into a probability, and a threshold for each kind, chosen on examples held back, selects.
Selected spans never overlap a base span or a better selected one.

The trees learn from examples that ``examples`` writes from a seed: it renders each kind in many
formats, and look-alikes (versions, dates, amounts, order numbers, hashes, measures), between words.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomspark.llm.common import mapped, table

KINDS = ("email", "ip", "card", "phone")

# The base patterns. A digit run is entered only at its start, which changes no match.
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Candidates. An address is a name, a sign for "at", a host and one to three dotted parts; every number of parts is a
# candidate of its own, and so is every way to read digits: candidates of a kind overlap.
_AT = r"(?:\s?(?:\(at\)|\[at\]|\{at\}|<at>|\(@\)|\[@\]|@)\s?|\s(?:at|AT|At)\s)"
_DOT = r"(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\(\.\)|\[\.\])\s?|\s(?:dot|DOT|Dot)\s|\.)"
_SIGN = re.compile(rf"{_AT}(?=[A-Za-z0-9-])", re.I)
_HOST = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?=((?:{_DOT}[A-Za-z]{{2,24}}){{1,3}})(?![A-Za-z0-9-]))", re.I)
_PART = re.compile(rf"{_DOT}[A-Za-z]{{2,24}}", re.I)
#: Characters of which cards and phone numbers consist; none has fewer than seven of them.
_NUMBER = re.compile(r"[0-9+(][0-9+\x20./()-]{6,}")
_HEX = "[0-9A-Fa-f]{1,4}"
_LOOSE = {
    "ip": [
        re.compile(rf"(?<![0-9A-Za-z:.])(?:{_HEX}:){{7}}{_HEX}(?![0-9A-Za-z:])"),
        re.compile(rf"(?<![0-9A-Za-z:.])(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?(?![0-9A-Za-z:])"),
    ],
    "card": [re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20./-]?[0-9]{2,6}){2,4}(?![0-9])")],
    "phone": [
        re.compile(r"(?<![0-9+])(?:\+?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20]?|[0-9]{2,4}[\x20./-])[0-9]{3,4}[\x20.-]?[0-9]{3,5}(?![0-9])"),
        re.compile(r"(?<![0-9+])0[1-9](?:[\x20.-]?[0-9]{2}){4}(?![0-9])"),
        re.compile(r"(?<![0-9+])0[0-9]{2,5}[\x20/-][0-9]{4,9}(?![0-9])"),
        re.compile(r"(?<![0-9+])[6-9][0-9]{2}(?:[\x20.-][0-9]{3}){2}(?![0-9])"),
        re.compile(r"(?<![0-9+])00[1-9][0-9]{0,2}(?:[\x20.-][0-9]{2,5}){2,5}(?![0-9])"),
    ],
}
# Common last parts of host names.
_TOP = frozenset("com org net edu gov mil int info biz io co de fr es it nl uk ch at be eu us ca au jp se no pl pt dk fi ie app dev example test".split())

_CUES = {
    "email": re.compile(r"mail|contact|write|reach|correo|schreib|écri|kontakt|escrib", re.I),
    "ip": re.compile(r"\bip\b|host|address|server|login|from|client", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|pay|karte|tarjeta|carte", re.I),
    "phone": re.compile(r"phone|tel|call|fax|mobile|cell|text|anruf|llam|appel", re.I),
}
_AGAINST = re.compile(r"version|order|invoice|isbn|issn|ref|no\.|nr\.|item|sku|page|total|price|sum|build|release|date|lot|serial|hash|commit|time|port", re.I)


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        tail = _EMAIL_TAIL.match(text, at) if start < at else None
        if tail:
            yield start, tail.end()
            done = tail.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; offsets are code points."""
    found = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Looser spans of each kind; they may overlap."""
    out = []
    for sign in _SIGN.finditer(text):
        start = sign.start()
        while start > max(0, sign.start() - 64) and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, sign.end()) if start < sign.start() else None
        if host:
            at = host.end()
            while at < host.end(1):
                at = _PART.match(text, at, host.end(1)).end()
                out.append(("email", start, at))
    # an address has two colons side by side, or seven of them
    found = [("ip", m) for i, p in enumerate(_LOOSE["ip"]) if (text.count(":") >= 7 if i == 0 else "::" in text) for m in p.finditer(text)]
    for run in _NUMBER.finditer(text):
        found += [(kind, m) for kind in ("card", "phone") for p in _LOOSE[kind] for m in p.finditer(text, run.start(), run.end())]
    return out + list(dict.fromkeys((kind, m.start(), m.end()) for kind, m in found))


def _address(span: str) -> bool:
    """Whether the span is an internet address of the sixth version."""
    try:
        return ipaddress.ip_address(span).version == 6
    except ValueError:
        return False


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    span, before, after = text[start:end], text[max(0, start - 28) : start], text[end : end + 12]
    digits = [c for c in span if c.isdigit()]
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    seps = {c for c in span if not c.isalnum()}
    word = re.search(r"\w+\W*\Z", before)
    year = any(len(g) == 4 and g[:2] in ("19", "20") for g in re.findall(r"[0-9]+", span))
    plain = "".join(digits)
    low = span.lower()
    last = re.search(r"[a-z]*\Z", low)[0]
    return [
        *(float(kind == k) for k in KINDS),
        len(span),
        len(digits),
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        float(groups[-3:] == [3, 3, 4]),
        float(groups[-1:] == [4]),
        float("(" in span and ")" in span),
        float("+" in span),
        float(len(seps)),
        float(luhn(plain) and 13 <= len(plain) <= 19),
        float(plain[:1] in ("3", "4", "5", "6")),
        float(len(set(plain))) if plain else 0.0,
        float(span.count(":")),
        float("::" in span),
        float(any(c in "abcdefABCDEF" for c in span)),
        float(kind == "email" and bool(re.search(r"\sat\s", low))),
        float(kind == "email" and bool(re.search(r"\sdot\s", low))),
        float(bool(re.search(r"[(\[{<](?:at|@)[)\]}>]|@", low))),
        float(bool(re.search(r"[(\[{<](?:dot|\.)[)\]}>]", low))),
        float(kind == "email") * len(re.findall(r"dot|\.", re.split(r"\bat\b|@", low)[-1])),
        float(kind == "email" and last in _TOP),
        float(kind == "email") * len(last),
        float(kind == "email" and bool(_PART.match(text, end))),
        float(kind == "email" and bool(re.match(r"[A-Za-z0-9]+\s?[._+-]|[A-Za-z]+[0-9]", span))),
        float(kind == "ip" and _address(span)),
        float(span[:1] == "0"),
        float(groups[:1] == [2] and set(groups) == {2}),
        float(groups == [3, 3, 3]),
        float(bool(re.search(r"[a-z]", low)) if kind == "ip" else 0.0),
        float(year),
        float(bool(_CUES[kind].search(before))),
        float(bool(_AGAINST.search(before))),
        float(before[-1:] in "$€£#%=/\\_" if before else 0.0),
        float(before[-1:].isalnum() if before else 0.0),
        float(after[:1].isalnum() if after else 0.0),
        float(after[:1] in "%°$€/\\_=" if after else 0.0),
        float(len(word[0]) if word else 0),
    ]


def examples(n: int, seed: int = 7) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label) made from rules: personal data in many formats and look-alikes."""
    r = random.Random(seed)
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))

    def card(k: int) -> str:
        body = r.choice("3456") + digit(k - 2)
        return next(body + d for d in "0123456789" if luhn(body + d))

    def grouped(s: str, sizes: list[int], sep: str) -> str:
        out, i = [], 0
        for size in sizes:
            out.append(s[i : i + size])
            i += size
        return sep.join(out)

    def personal() -> tuple[str, str, str]:
        kind = r.choice(KINDS)
        if kind == "email":
            a, d = r.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("(AT)", "(DOT)"), (" at ", " dot "), (" AT ", " DOT "), (" @ ", "."), (" (at) ", "."), ("[@]", "."), (" [at] ", "[.]"), (" {at} ", " {dot} "), ("(at)", ".")])
            host = word() + d + (word() + d if r.random() < 0.2 else "") + r.choice(["com", "org", "net", "de", "example", "fr", "es", "io", "edu", "info"])
            return kind, f"{word()}{r.choice(['', '', '.', '_', '-', digit(2)])}{r.choice(['', word()])}{a}{host}", r.choice(["mail", "contact", "write to", "e-mail", "reach me:", word()])
        if kind == "ip":
            parts = [f"{r.randrange(1 << r.choice([4, 8, 12, 16, 16])):x}" for _ in range(8)]
            if r.random() < 0.35:
                return kind, ":".join(parts), r.choice(["host", "from", "server", word()])
            n = r.randint(1, 7)
            m = r.randint(0, 7 - n)
            parts[0] = r.choice(["fe80", "2001", "fd00", "2a02", parts[0]])
            return kind, ":".join(parts[:n]) + "::" + ":".join(parts[8 - m :] if m else []), r.choice(["host", "from", "server", "address", "login", word()])
        if kind == "card":
            k = r.choice([15, 16])
            return kind, grouped(card(k), [4, 6, 5] if k == 15 else [4, 4, 4, 4], r.choice(["", ".", "/", " "])), r.choice(["card", "visa", "pay", word()])
        area, a, b = r.randint(200, 999), digit(3), digit(4)
        two = lambda k, sep: sep.join(digit(2) for _ in range(k))
        sep = r.choice([" ", " ", ".", "-"])
        cue = r.choice(["call", "phone", "tel", "fax", "mobile", "appel", "Anruf", "llame al", word()])
        return kind, r.choice([
            f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"({area}){a}-{b}", f"1-{area}-{a}-{b}", f"0{r.randint(1, 9)}{sep}{two(4, sep)}",
            f"0{r.choice(['30', '40', '89', '221', '171', '6131'])}{r.choice([' ', '/', '-'])}{digit(r.randint(5, 8))}", f"{r.randint(6, 9)}{digit(2)} {digit(3)} {digit(3)}", f"00{r.choice([33, 34, 44, 49])} {digit(3)} {digit(4)} {digit(r.randint(2, 4))}",
        ]), cue

    def alike() -> tuple[str, str]:
        y, mo, d = r.randint(1950, 2040), r.randint(1, 12), r.randint(1, 28)
        return r.choice([
            (f"{y}-{mo:02d}-{d:02d} {r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}", word()),
            (f"{d:02d}.{mo:02d}.{y} {digit(4)}", "date"),
            (f"{r.randint(10, 24):02d}:{r.randint(10, 59):02d}:{r.randint(10, 59):02d}:{digit(2)}", "time"),
            (f"{digit(4)} {digit(4)} {digit(4)} {digit(4)}", r.choice(["order", "ref", "serial", word()])),
            (f"{digit(3)}-{digit(4)}-{digit(4)}", r.choice(["order", "invoice", "item", "part"])),
            (f"978-{digit(1)}-{digit(4)}-{digit(4)}-{digit(1)}", "isbn"),
            (f"{digit(2)} {digit(3)} {digit(3)}", r.choice(["total", "price", word()])),
            (f"{digit(4)}-{digit(4)}-{digit(3)}", r.choice(["sku", "lot", word()])),
            (f"{y}-{y + 1} {digit(3)}", word()),
            (f"{word()} at {word()} dot the {word()}", word()),
            (f"{word()} at {word()}. {word().capitalize()}", word()),
            (f"look at {word()}.{word()}", word()),
            ("".join(r.choice("0123456789abcdef") for _ in range(12)) + ":" + digit(2) + ":" + digit(2), "hash"),
            (f"{digit(4)}/{digit(4)}/{digit(4)}", "page"),
            (f"{word()} at {word()}. {word()}", word()),
            (f"{word()} at {word()}.{r.choice(['com', 'org', 'net', 'de'])}", r.choice(["meet", "us", word()])),
            (f"{r.choice(['look', 'arrive', 'stay', 'meet', 'sold', 'good'])} at {word()}.{r.choice(['py', 'txt', 'cfg', 'json', 'log', 'ts'])}", word()),
            (f"{word()} at {word()} dot {word()}s", "the"),
            (f"{r.choice(['std', 'abc', 'bad', 'dead', 'a', 'face', 'add'])}::{r.choice(['vector', 'bad', 'b', 'fade', 'cab', 'dec', 'add'])}", r.choice(["use", "call", "class", "type"])),
            (f"{word()} ::", word()),
            (f"{digit(2)} {digit(2)} {digit(2)} {digit(2)} {digit(2)}", r.choice(["draw", "numbers", "codes", "score"])),
            (f"{r.randint(1, 5)}{digit(2)} {digit(3)} {digit(3)}", r.choice(["total", "people", "sum", word()])),
            (f"0{digit(3)}-{digit(5)}", r.choice(["part", "order", "sku", "ref"])),
            (f"{r.randint(6, 9)}{digit(2)}.{digit(3)}.{digit(3)}", r.choice(["total", "price", "sum", "amount"])),
            (f"00{digit(8)}", r.choice(["invoice", "order", "lot", "serial"])),
        ])

    out = []
    while len(out) < n:
        lead, trail = " ".join(word() for _ in range(3)), " ".join(word() for _ in range(3))
        if r.random() < 0.5:
            kind, span, cue = personal()
            text = f"{lead} {cue}{r.choice([' ', ': '])}{span}{r.choice([' ', ', ', '. '])}{trail}"
            start = text.index(span)
            for k, s, e in candidates(text):
                out.append((text, k, s, e, int(k == kind and s == start and e == start + len(span))))
        else:
            span, cue = alike()
            text = f"{lead} {cue} {span}{r.choice([' ', ', ', '. '])}{trail}"
            out.extend((text, k, s, e, 0) for k, s, e in candidates(text))
    return out[:n]


@dataclass
class Boosted:
    """Depth-limited regression trees on the gradient of the logistic loss."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    ridge: float = 1.0
    start: float = 0.0
    trees: list[list] = field(default_factory=list)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> list:
        leaf = [-self.rate * g[rows].sum() / (h[rows].sum() + self.ridge)]
        if depth == 0 or len(rows) < 8:
            return leaf
        best = (1e-6, -1, 0.0)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for j in range(x.shape[1]):
            v = x[rows, j]
            order = np.argsort(v, kind="stable")
            gs, hs, vs = np.cumsum(g[rows][order])[:-1], np.cumsum(h[rows][order])[:-1], v[order]
            gain = gs**2 / (hs + self.ridge) + (total_g - gs) ** 2 / (total_h - hs + self.ridge) - total_g**2 / (total_h + self.ridge)
            gain[vs[1:] == vs[:-1]] = 0
            if len(gain) and gain.max() > best[0]:
                i = int(gain.argmax())
                best = (float(gain[i]), j, float((vs[i] + vs[i + 1]) / 2))
        _, j, cut = best
        if j < 0:
            return leaf
        low = x[rows, j] <= cut
        return [j, cut, self._grow(x, g, h, rows[low], depth - 1), self._grow(x, g, h, rows[~low], depth - 1)]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            self.trees.append(self._grow(x, p - y, p * (1 - p), np.arange(len(y)), self.depth))
            f += np.array([self._walk(self.trees[-1], row) for row in x])
        return self

    @staticmethod
    def _walk(tree: list, row: np.ndarray) -> float:
        while len(tree) > 1:
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree[0]

    def score(self, row: list[float]) -> float:
        return self.start + sum(self._walk(t, row) for t in self.trees)


@dataclass
class Model:
    """Trees, the line that calibrates their score, and a probability threshold for each kind."""

    trees: Boosted
    slope: float
    offset: float
    thresholds: dict[str, float]

    def probability(self, row: list[float]) -> float:
        return float(1 / (1 + np.exp(-(self.slope * self.trees.score(row) + self.offset))))


def train(n: int = 8000, seed: int = 7, precision: float = 0.95) -> Model:
    """Fits trees on half of the examples; calibrates and sets thresholds on the other half."""
    made = examples(n, seed)
    x = np.array([features(t, k, s, e) for t, k, s, e, _ in made])
    y = np.array([label for *_, label in made], dtype=float)
    fit = np.arange(len(y)) % 2 == 0
    trees = Boosted().fit(x[fit], y[fit])
    raw, held = np.array([trees.score(row) for row in x[~fit]]), y[~fit]
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton's steps for the calibrating line
        p = 1 / (1 + np.exp(-(slope * raw + offset)))
        d, w = p - held, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(d * raw).sum() + 1e-2 * (slope - 1), d.sum()])
        hess = np.array([[(w * raw * raw).sum() + 1e-2, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        slope, offset = slope - step[0], offset - step[1]
    p = 1 / (1 + np.exp(-(slope * raw + offset)))
    kinds = np.array([k for (_, k, *_), f in zip(made, fit, strict=True) if not f])
    thresholds = {}
    for k in KINDS:
        pk, yk = p[kinds == k], held[kinds == k]
        fine = [c for c in np.arange(0.5, 1.0, 0.01) if (pk >= c).any() and yk[pk >= c].mean() >= precision]
        thresholds[k] = float(min(fine, default=1.01))
    return Model(trees, float(slope), float(offset), thresholds)


def find(text: str | None, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base spans with those the model adds; both by kind as listed, then start."""
    text = text or ""
    base = base_spans(text)
    taken = _Taken((s, e) for _, s, e in base)
    scored = []
    for kind, s, e in candidates(text):
        if taken.free(s, e):
            p = model.probability(features(text, kind, s, e))
            if p >= model.thresholds[kind]:
                scored.append((-p, s - e, s, e, kind))
    spans = list(base)
    for _, _, s, e, kind in sorted(scored):
        if taken.free(s, e):
            taken.add(s, e)
            spans.append((kind, s, e))
    return base, sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))


class _Taken:
    """The union of spans, so that asking whether a span meets one is a binary search."""

    def __init__(self, spans) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, s: int, e: int) -> bool:
        i = bisect.bisect_right(self.ends, s)
        return i == len(self.starts) or self.starts[i] >= e

    def add(self, s: int, e: int) -> None:
        """A span that is free."""
        i = bisect.bisect_left(self.starts, s)
        self.starts.insert(i, s)
        self.ends.insert(i, e)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_personal_data(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, base counts of each kind, the digest of base spans, all spans.

    Null and empty texts have no spans. Whole texts are read, of any length; every candidate costs a
    binary search among the spans taken. Repeated rows keep a row each.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, texts = [], [], []
            for x in batch.column("text"):
                base, spans = find(x.as_py(), held.value)
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                texts.append(_joined(spans))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", "text").transform(mapped, run, _FOUND)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans merge."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the text masked; other columns as they are, n_chars recounted where present.

    A null text stays null, an empty one empty; every row, repeated ones too, keeps its place in one row.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (t := x.as_py()) is None else mask(t, find(t, held.value)[1]) for x in batch.column("text")]
            made = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                made["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in names], names=names)

    return docs.transform(mapped, run, schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find_personal_data(table(spark, sf_dir, "documents", "doc_id", "text"), train())
