"""Personal data by weak supervision.

Patterns propose spans. Labelers vote on each: its shape, its checksum, a gazetteer of prefixes and titles, words in
front of it, digits that look made up, and other personal data beside it. Over all documents the vote patterns are
counted; expectation-maximisation estimates each labeler's reliability and each pattern's probability, and a logistic
classifier of a span's kind, votes, length and neighbours is trained on these. The spans of the base kinds always
stay; of the others, those that the classifier accepts are added.
"""

from __future__ import annotations

import hashlib
import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Covered, staged, table

# The base patterns. What stands before a number cannot be a digit that the same pattern would take.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]++(@?)")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")

# Letters of all scripts: any, upper-case ones, and a name's word; a letter may be followed by combining marks.
_LETTER, _MARKS = r"[^\W\d_]", r"[\u0300-\u036f]*"
_CAPITAL = "[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isupper() and c.isalpha() or c.istitle()) + "]"
_WORD = f"{_CAPITAL}{_MARKS}(?:{_LETTER}{_MARKS})+"

EXTRA = {
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "tel": re.compile(r"(?<![0-9+.-])(?:\(0?[0-9]{2,4}\)\x20?|0[0-9]{2,4}[\x20/-])[0-9]{3,4}[\x20-]?[0-9]{3,5}(?![0-9.-])"),
    "name": re.compile(rf"(?<!{_LETTER})(?<![\u0300-\u036f])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20{_WORD}(?:\x20{_WORD})?"),
}
KINDS = (*BASE, *EXTRA)

#: Gazetteers: dialling codes, countries of bank accounts, endings of domains.
DIAL = frozenset("1 7 20 27 30 31 32 33 34 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 359 370 371 372 380 420 421".split())
BANKS = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MT NL NO PL PT RO SE SI SK".split())
ENDINGS = frozenset("com org net edu gov info io de fr es it nl uk eu us ch at be".split())
HINTS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "tel": ("phone", "tel", "call", "mobile", "fax"),
    "name": ("by", "dear", "name", "from", "signed"),
}
AGAINST = ("version", "order", "invoice", "page", "isbn", "part", "serial", "section")
CONTEXT, BESIDE, LABELERS = 32, 80, 6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    if "@" not in text:
        return
    at = 0
    while m := LOCAL.search(text, at):
        at = m.end()
        if m[1] and (d := DOMAIN.match(text, at)):
            yield m.start(), d.end()
            at = d.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, leftmost and non-overlapping within a kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def extra_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the other kinds that no base span overlaps."""
    out, covered = [], Covered(base)
    for k, pattern in enumerate(EXTRA.values(), len(BASE)):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if not covered.overlaps(m.start(), m.end())]
    return sorted(out)


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, start: int, kind: int, end: int, starts: list[int]) -> tuple[int, ...]:
    """One vote of each labeler: 1 for personal data, -1 against, 0 for none. ``starts`` are those of all spans, sorted."""
    s, name = text[start:end], KINDS[kind]
    digits = "".join(c for c in s if "0" <= c <= "9")
    before, after = text[start - 1 : start], text[end : end + 1]
    apart = not (before.isalnum() or after.isalnum())
    check = 0
    if name == "card":
        check = 1
    elif name == "iban":
        check = 1 if _mod97(s) else -1
    elif name == "ssn":
        check = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 0
    known = 0
    if name == "email":
        known = 1 if s.rpartition(".")[2].lower() in ENDINGS else 0
    elif name == "phone":
        known = 1 if any(digits[:n] in DIAL for n in (1, 2, 3)) else -1
    elif name == "iban":
        known = 1 if s[:2] in BANKS else -1
    elif name == "name":
        known = 1
    words = re.findall(r"[a-z]+", text[max(0, start - CONTEXT) : start].lower())
    context = 1 if any(w.startswith(h) for w in words for h in HINTS[name]) else -1 if any(w in AGAINST for w in words) else 0
    made_up = -1 if len(digits) >= 6 and len(set(digits)) <= 2 else 0
    i = bisect_left(starts, start)
    beside = 1 if any(0 < abs(x - start) <= BESIDE for x in starts[max(0, i - 1) : i + 2]) else 0
    return 1 if apart else -1, check, known, context, made_up, beside


def features(text: str, span: tuple[int, int, int], starts: list[int]) -> tuple[int, ...]:
    """kind, votes, length in steps, what stands before: at most 8 * 3^6 * 4 * 3 different ones."""
    start, kind, end = span
    before = text[start - 1 : start]
    return kind, *votes(text, start, kind, end, starts), min(3, (end - start) // 8), 2 if before.isalnum() else 0 if before.isspace() or not before else 1


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Reliabilities [labeler, class, vote + 1], probability of each pattern, and the share of personal data.

    Starts from the majority of votes; counts are smoothed by one, and a labeler can at most be held for useless.
    """
    p = 1 / (1 + np.exp(-patterns.sum(1).astype(float)))
    for _ in range(rounds):
        share = float((counts * p).sum() + 1) / float(counts.sum() + 2)
        theta = np.ones((patterns.shape[1], 2, 3))
        for c, weight in ((1, counts * p), (0, counts * (1 - p))):
            for v in (-1, 0, 1):
                theta[:, c, v + 1] += ((patterns == v) * weight[:, None]).sum(0)
        theta /= theta.sum(2, keepdims=True)
        ratio = np.log(theta[:, 1]) - np.log(theta[:, 0])
        ratio[:, 2], ratio[:, 0] = np.maximum(ratio[:, 2], 0), np.minimum(ratio[:, 0], 0)
        score = np.log(share / (1 - share)) + sum(ratio[i, patterns[:, i] + 1] for i in range(patterns.shape[1]))
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return theta, p, share


def _design(rows: np.ndarray) -> np.ndarray:
    cols = [np.ones(len(rows))] + [rows[:, 0] == k for k in range(len(KINDS))]
    for i in range(1, 1 + LABELERS):
        cols += [rows[:, i] == 1, rows[:, i] == -1]
    cols += [rows[:, 7] == n for n in range(4)] + [rows[:, 8] == n for n in range(3)]
    return np.array(cols, float).T


@dataclass
class SpanModel:
    """Weights of the span classifier, and the labelers' reliabilities that it was trained with."""

    weights: np.ndarray | None = None
    reliabilities: np.ndarray | None = None
    known: dict = field(default_factory=dict)

    def accepts(self, f: tuple[int, ...]) -> bool:
        if f not in self.known:
            self.known[f] = self.weights is not None and float((_design(np.array([f])) @ self.weights)[0]) > 0
        return self.known[f]

    def accepted(self) -> list[int]:
        """Of the features seen in training those of other than the base kinds that are accepted, as numbers, sorted."""
        return sorted(number(f) for f, yes in self.known.items() if yes and f[0] >= len(BASE))


def number(f) -> int:
    """A span's features as one number."""
    kind, *votes_, length, before = f
    out = kind
    for v in votes_:
        out = out * 3 + v + 1
    return (out * 4 + length) * 3 + before


def code(f: Column) -> Column:
    """The same of a column."""
    out = f[0]
    for i in range(1, 1 + LABELERS):
        out = out * 3 + f[i] + 1
    return (out * 4 + f[1 + LABELERS]) * 3 + f[2 + LABELERS]


def train(seen: list[tuple[tuple[int, ...], int]]) -> SpanModel:
    """From the features of all spans with their counts; in a fixed order, so that equal counts give equal models."""
    if not seen:
        return SpanModel()
    seen = sorted(seen)
    rows, counts = np.array([f for f, _ in seen]), np.array([n for _, n in seen], float)
    theta, p, _ = expectation_maximisation(rows[:, 1 : 1 + LABELERS], counts)
    x, w = _design(rows), np.zeros(_design(rows[:1]).shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (counts * (q * (1 - q)) + 1e-9)[:, None]).T @ x + np.eye(len(w)), x.T @ (counts * (p - q)) - w)
    model = SpanModel(w, theta)
    for f, _ in seen:
        model.accepts(f)
    return model


def _all(text: str) -> tuple[list, list, list[int]]:
    base = base_spans(text)
    extra = extra_spans(text, base)
    return base, extra, sorted(a for a, _, _ in base + extra)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = """doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string,
    spans array<struct<start: int, kind: int, stop: int, f: array<int>>>"""
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("f", pa.list_(pa.int32()))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The one pass over the texts: base counts and digest, and all spans with their features."""
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        for t in batch.column("text"):
            text = t.as_py() or ""
            base, extra, starts = _all(text)
            n = Counter(k for _, k, _ in base)
            spans = [{"start": a, "kind": k, "stop": b, "f": list(features(text, (a, k, b), starts))} for a, k, b in sorted(base + extra)]
            for c, x in zip(cols, (n[0], n[1], n[2], n[3], hashlib.sha256(written(base).encode()).hexdigest(), spans)):
                c.append(x)
        arrays = [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.list_(_SPAN))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def fit(scanned: DataFrame) -> SpanModel:
    """Train on the counts of the features of all spans of all documents; there are at most 70,000 different ones."""
    rows = scanned.select(F.explode("spans.f").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()
    return train([(tuple(r["f"]), r["n"]) for r in rows])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of ``docs`` (doc_id, text).

    Spans are kind:start:end in code points, end exclusive, by start and then kind; base_sha256 is of the base kinds'
    spans alone. The texts are scanned once, whole; what is found is staged for training and for the result. Cases: a
    null text is empty and has no spans; a null doc_id stays null; repeated rows count each, in training too; without
    any span nothing is trained or added; an empty table gives an empty table; other columns are left alone.
    """
    scanned = staged(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_scan, SCHEMA), "spans")
    model = fit(scanned)
    # which of the features seen the classifier accepts, as numbers; base kinds stay in any case
    kinds = F.array(*[F.lit(k) for k in KINDS])
    accepted = model.accepted()
    mask = bytearray(max(accepted, default=0) + 1)
    for x in accepted:
        mask[x] = 1
    yes = lambda s: F.substr(F.lit(mask), code(s["f"]) + 1, F.lit(1)) == F.lit(bytearray(b"\x01"))
    keep = lambda s: (s["kind"] < len(BASE)) | yes(s)
    text = F.transform(F.filter("spans", keep), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")))
    return scanned.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(text, ",").alias("spans"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
