"""Personal data in whole texts: fixed base patterns, and candidates that boosted trees accept or reject.

High-recall generators propose overlapping spans of written-out or unusual forms (name [at] host, numbers without +,
cards with odd separators, bracketed dots). Gradient-boosted trees score each by its format and the words before it;
a threshold for each kind, calibrated on held-out examples, decides; of overlapping accepted spans the most
probable stays. The trees are trained here, on examples written from templates with a fixed seed: texts are no
labels of personal data. Base spans always stay and accepted ones never overlap them.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, whole_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield "email", start, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[Span]:
    for chain in _DOTTED.finditer(text):
        if chain.group().count(".") >= 3:
            parts, start = chain.group().split("."), chain.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = start + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    yield "ip", start, end
                start = end + 1


def base_spans(text: str) -> list[Span]:
    """The base spans by kind as in KINDS, then start."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += _ips(text)
        for m in _CHAIN.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return found


# Generators of candidates.
_AT = re.compile(r"[\[({<] ?(?:at|AT) ?[\])}>]| (?:AT|\(a\)) ")
_HOST_AFTER = re.compile(r"\s?[A-Za-z0-9-]++(?:(?:\.|\s?[\[({<] ?(?:dot|DOT|\.) ?[\])}>]\s?| DOT )[A-Za-z0-9-]++)++")
_IP_ODD = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?[\[(]\s?(?:\.|dot)\s?[\])]\s?[0-9]{1,3}){3}(?![0-9])")
_ZONE = re.compile(r"(?<![0-9])\(?[0-9](?:[ ./()_-]{0,3}[0-9])++")


def candidates(text: str) -> Iterator[Span]:
    """Spans that may be personal data; they may overlap."""
    done = 0
    for m in _AT.finditer(text):
        start = end = m.start() - (m.start() > done and text[m.start() - 1].isspace())
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        after = _HOST_AFTER.match(text, m.end()) if start < end else None
        if after:
            yield "email", start, after.end()
        done = m.start()  # a name before the next sign does not reach beyond this one
    if not _DIGIT.search(text):
        return
    if "[" in text or "(" in text:
        for m in _IP_ODD.finditer(text):
            yield "ip", m.start(), m.end()
    for m in _ZONE.finditer(text):
        n = m.end() - m.start()
        if n < 9:
            continue
        groups = [g for g in re.finditer(r"[0-9]+", m.group())]
        for i in range(len(groups)):
            for j in range(i, len(groups)):
                digits = sum(g.end() - g.start() for g in groups[i : j + 1])
                if digits > 19:
                    break
                start, end = m.start() + groups[i].start(), m.start() + groups[j].end()
                if start > 0 and text[start - 1] == "(" and ")" in text[start:end]:
                    start -= 1
                if 9 <= digits <= 15:
                    yield "phone", start, end
                if digits >= 13:
                    yield "card", start, end


_HINTS = (
    ("tel", "phone", "call", "mobile", "fax", "whatsapp", "cell", "telefon", "tél", "móvil", "ruf"),
    ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta", "cc"),
    ("ip", "host", "server", "address", "addr", "login"),
    ("mail", "contact", "write", "reach", "e-mail", "correo"),
    ("id", "no", "nr", "order", "invoice", "isbn", "ref", "serial", "number", "code", "date", "version", "total", "account"),
)
_PREFIXES = re.compile(r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))")


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a candidate, as small numbers."""
    kind, start, end = span
    own, digits = text[start:end], _digits(text[start:end])
    before = text[max(0, start - 32) : start].lower()
    words = re.findall(r"[^\W\d_]+", before)[-4:]
    hints = [float(any(w.startswith(h) if len(h) > 3 else w == h for w in words for h in hint)) for hint in _HINTS]
    groups = re.findall(r"[0-9]+", own)
    sizes = [len(g) for g in groups] + [0] * 5
    around = [float(0 <= i < len(text) and text[i] in "0123456789") for i in (start - 2, end + 1)]
    touching = [float(0 <= i < len(text) and (text[i].isalnum() or text[i] in "_#$€.-/")) for i in (start - 1, end)]
    return [
        float(KINDS.index(kind)), float(len(digits)), float(luhn(digits)) if digits else 0.0, float(len(groups)), *map(float, sizes[:5]), float(len({c for c in own if not c.isalnum()})),
        float("(" in own), float("." in own), float("/" in own), float(own.startswith("0")), float(digits.startswith("00")), float(bool(_PREFIXES.match(digits))), float(len(set(digits))),
        float(max([int(g) for g in groups if len(g) <= 6] or [0]) <= 255), *hints, *around, *touching, float(start > 0 and text[start - 1] == "+"), float(bool(re.search(r"(?:\.|dot|DOT)\W*[A-Za-z]{2,6}$", own))),
    ]


#: The trees and the least score for each kind.
Trained = tuple["Trees", tuple[float, ...]]


class Trees:
    """Gradient-boosted trees of depth DEPTH for two classes, on few distinct values per feature."""

    ROUNDS, DEPTH, RATE, CUTS = 60, 3, 0.3, 12

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.CUTS + 1)[:-1])) for c in x.T]
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees: list[list[tuple[int, float, float]]] = []
        margin = np.full(len(y), self.start)
        for _ in range(self.ROUNDS):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, y - p, p * (1 - p))
            self.trees.append(tree)
            margin += self.RATE * self._leaf(tree, x)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple[int, float, float]]:
        """Nodes of a full tree in level order: (feature or -1, cut, value)."""
        nodes: list[tuple[int, float, float]] = []
        rows = [np.arange(len(g))]
        for level in range(self.DEPTH + 1):
            below = []
            for r in rows:
                value = float(g[r].sum() / (h[r].sum() + 1.0))
                best, gain = (-1, 0.0), 1e-9
                if level < self.DEPTH and len(r) >= 10:
                    total, weight = g[r].sum(), h[r].sum() + 1.0
                    for f, cuts in enumerate(self.cuts):
                        left = x[r, f][:, None] <= cuts
                        gl, hl = g[r] @ left, h[r] @ left + 1.0
                        score = gl**2 / hl + (total - gl) ** 2 / (weight - hl + 2.0) - total**2 / weight
                        k = int(np.argmax(score))
                        if score[k] > gain:
                            best, gain = (f, float(cuts[k])), float(score[k])
                nodes.append((*best, value))
                left = x[r, best[0]] <= best[1] if best[0] >= 0 else np.ones(len(r), bool)
                below += [r[left], r[~left]]
            rows = below
        return nodes

    def _leaf(self, tree: list[tuple[int, float, float]], x: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(c) for c in zip(*tree))
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.DEPTH):
            f = feature[at]
            at = np.where(f < 0, 2 * at + 1, 2 * at + 1 + (x[rows, f] > cut[at]))
        return value[at]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + self.RATE * sum(self._leaf(t, x) for t in self.trees))))


def _examples(seed: int, n: int) -> Iterator[tuple[str, Span, bool]]:
    """Texts with one candidate each and whether it is personal data."""
    r = random.Random(seed)
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvw") for _ in range(r.randint(2, 9)))

    def card(valid: bool) -> str:
        head = r.choice(["4", "51", "55", "37", "6011"])
        body = head + number((15 if head == "37" else 16) - 1 - len(head))
        last = next(d for d in "0123456789" if luhn(body + d))
        return body + (last if valid else r.choice([d for d in "0123456789" if d != last]))

    def split(digits: str, by: str) -> str:
        return by.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    for _ in range(n):
        kind, good, hint = r.choice(KINDS), r.random() < 0.5, r.random() < 0.6
        if kind == "email":
            own = f"{word()}{r.choice(['.', '_', ''])}{word()}{r.choice([' [at] ', '[at]', ' (at) ', '(at)', ' AT '])}{word()}{r.choice(['.', ' [dot] ', '(dot)', '.'])}{r.choice(['com', 'org', 'net', 'de', 'fr', 'io'])}"
            if not good:
                own = f"{word()}{r.choice([' (at) ', ' [at] ', ' AT '])}{word()}.{number(r.randint(1, 3))}"
            context = r.choice(["mail", "contact", "reach me", "write to"]) if hint and good else word()
        elif kind == "ip":
            parts = [str(r.randint(0, 255)) for _ in range(4)] if good else [number(3) if int(p := number(3)) > 255 else str(256 + int(p)) for _ in range(4)]
            own = r.choice(["[.]", "(.)", "[dot]"]).join(parts)
            context = r.choice(["server", "host", "login from", "ip"]) if hint and good else word()
        elif kind == "card":
            own = split(card(good), r.choice([".", "/", "_", "  ", " - "])) if good or r.random() < 0.7 else number(r.choice([13, 14, 16, 18]))
            context = r.choice(["card", "visa", "credit card", "paid with", "mastercard"]) if hint and good else r.choice([word(), "order no", "isbn", "serial"])
        else:
            forms = [lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: f"{number(3)}-{number(3)}-{number(4)}", lambda: f"0{number(2)} {number(4)} {number(4)}", lambda: f"{number(3)}.{number(3)}.{number(4)}", lambda: f"0049 {number(3)} {number(7)}"]
            bad = [lambda: number(r.randint(9, 15)), lambda: f"{r.randint(1900, 2030)}-{number(2)}-{number(2)} {number(2)} {number(2)}", lambda: " ".join(number(r.randint(1, 3)) for _ in range(6)), lambda: f"{number(2)}/{number(2)}/{number(4)} {number(4)}", lambda: f"{number(6)}.{number(4)}", lambda: split(card(r.random() < 0.5), " ")[:14]]
            own = r.choice(forms if good else bad)()
            context = r.choice(["tel", "phone", "call me", "mobile", "fax"]) if hint and good else r.choice([word(), "ref", "total", "date", "invoice"])
            good = good and (hint or own.startswith("("))
        text = f"{word()} {context}{r.choice([' ', ': '])}{own}{r.choice([' ', '. ', ', ', chr(10)])}{word()}"
        start = text.index(own)
        yield text, (kind, start, start + len(own)), good


@lru_cache(maxsize=1)
def model() -> Trained:
    """The trees, and for each kind the least score at which 99 of 100 held-out accepted examples are right."""
    x, y, kind = [], [], []
    for text, span, good in _examples(20, 3000):
        x.append(describe(text, span))
        y.append(float(good))
        kind.append(KINDS.index(span[0]))
    x, y, kind = np.array(x), np.array(y), np.array(kind)
    trees = Trees(x[:2000], y[:2000])
    p = trees.probability(x[2000:])
    least = []
    for k in range(len(KINDS)):
        order = np.argsort(-p[kind[2000:] == k])
        score, right = p[kind[2000:] == k][order], y[2000:][kind[2000:] == k][order]
        fine = np.flatnonzero(np.cumsum(right) / np.arange(1, len(right) + 1) >= 0.99)
        least.append(max(0.5, float(score[fine[-1]]) if len(fine) else 1.0))
    return trees, tuple(least)


class _Taken:
    """Ranges that do not overlap, sorted."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.stops: list[int] = []
        for _, start, stop in sorted(spans, key=lambda s: s[1:]):
            if self.stops and start < self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], stop)
            else:
                self.starts.append(start)
                self.stops.append(stop)

    def free(self, span: Span) -> bool:
        k = bisect_right(self.stops, span[1])
        return k == len(self.starts) or span[2] <= self.starts[k]

    def take(self, span: Span) -> None:
        k = bisect_right(self.stops, span[1])
        self.starts.insert(k, span[1])
        self.stops.insert(k, span[2])


def added_spans(texts: list[str], base: list[list[Span]], trained: Trained | None = None) -> list[list[Span]]:
    """Accepted candidates of each text: none overlaps a base span or a more probable one."""
    where, rows, taken = [], [], [_Taken(b) for b in base]
    for i, text in enumerate(texts):
        for span in dict.fromkeys(candidates(text)):
            if taken[i].free(span):
                where.append((i, span))
                rows.append(describe(text, span))
    out: list[list[Span]] = [[] for _ in texts]
    if rows:
        trees, least = trained or model()
        p = trees.probability(np.array(rows))
        for k in np.lexsort(([s[1] for _, s in where], [s[1] - s[2] for _, s in where], -p)):
            i, span = where[k]
            if p[k] >= least[KINDS.index(span[0])] and taken[i].free(span):
                out[i].append(span)
                taken[i].take(span)
    return out


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def _found(texts: list[str], trained: Trained | None = None) -> tuple[list[list[Span]], list[list[Span]]]:
    base = [base_spans(t) for t in texts]
    return base, added_spans(texts, base, trained)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) for every row of docs.

    The counts and base are of base spans, spans of all, as kind:start:end in code points. A null text is an empty
    one and has none; a null id stays null; repeated rows give equal rows, an empty table none; other columns, whatever
    their names, are not looked at. The trees are trained once, on the driver, so all workers decide alike.
    """
    trained = model()

    def each(batch: pa.RecordBatch) -> dict:
        base, added = _found(batch.column(1).to_pylist(), trained)
        counts = {f"n_{k}": [sum(s[0] == k for s in b) for b in base] for k in KINDS}
        return {"doc_id": batch.column(0), **counts, "base": [_written(b) for b in base], "spans": [_written(b + a) for b, a in zip(base, added)]}

    return map_batches(docs.select(F.col(id_col).cast("long"), whole_text(text_col)), each, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redact(text: str, spans: list[Span]) -> str:
    """The text with [KIND] for each span; of overlapping spans the first takes the place."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def without_personal_data(docs: DataFrame) -> DataFrame:
    """docs with the spans in text replaced and n_chars counted again; null texts stay null.

    All other columns, whatever their names, and repeated rows stay; an empty table stays empty.
    """
    trained = model()

    def each(texts: pd.Series) -> pd.Series:
        known = [t or "" for t in texts]
        base, added = _found(known, trained)
        return pd.Series([t if t is None else redact(t, b + a) for t, b, a in zip(texts, base, added)], dtype=object)

    return docs.withColumn("text", F.pandas_udf(each, "string")(F.col("text"))).withColumn("n_chars", F.length("text").cast("long"))

