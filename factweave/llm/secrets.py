"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a maximal run of characters that keys and tokens are made of. A window slides over it, and its entropy
is kept by incremental counts: moving on by a character changes two counts. Each character class has its own
threshold; windows above it are joined to spans. An allow-list suppresses what looks random but is no secret. Strings of
letters, with separators or not, have a threshold like the rest, and a window of them must also have few of the letter
pairs that words are made of.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Covered, table

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Bits a character by class, for windows of 20: random strings of a class nearly always have more, words and numbers less.
#: Letters are told from words by their pairs, not by this.
THRESHOLDS = {"hex": 2.9, "caps": 3.4, "mixed": 3.6, "letters": 3.2}
#: Candidates that are no secrets: version-4-like ids, dates, runs of few characters.
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9A-Za-z-]*"),
    re.compile(r"[0-9=/+_-]*"),
)
#: Letters, and letters between separators with a number at the end: words, paths, snake or kebab words, or keys.
LETTERS = re.compile(r"[A-Za-z/+_=-]+|/?([A-Za-z]+[/_=-])+[A-Za-z]*[0-9]{0,4}/?")
#: What paths, kebab and snake words are made of: words with few digits at an end, numbers, dates, versions.
PART = re.compile(r"([0-9]{0,4})([A-Za-z]*)([0-9]{0,4})|[0-9]{1,8}|v[0-9]{1,4}")
#: Of the pairs of letters in such a word this share, at most, may be unusual.
MOST_ODD = 0.4
_HEX, _CAPS = re.compile(r"[0-9a-f]+|[0-9A-F]+"), re.compile(r"[A-Z0-9]+")
#: Pairs of letters that words of English, German, French and Spanish are made of, out of 676.
PAIRS = frozenset(
    (
        "ab ac ad af ag ai ak al am an ap ar as at au av aw ay ba be bi bl bo br bu by ca cc ce ch ci ck cl co cr ct cu "
        "da de di do dr ds du ea ec ed ee ef eg ei el em en eo ep eq er es et ev ew ex ey fa fe ff fi fl fo fr ft fu ga "
        "ge gh gi gl gn go gr gu ha he hi ho hr ht hu ia ib ic id ie if ig il im in io ip ir is it iv iz je ju ke ki la "
        "ld le lf li ll lo ls lt lu lv ly ma mb me mi mm mo mp ms mu my na nc nd ne nf ng ni nl nn no ns nt nu ny oa ob "
        "oc od of og oi ok ol om on oo op or os ot ou ov ow pa pe ph pi pl po pp pr ps pt pu qu ra rc rd re rg ri rk rl "
        "rm rn ro rr rs rt ru rv ry sa sc se sh si sl sm so sp ss st su sy ta te th ti tl to tr ts tt tu tw ty ua ub uc "
        "ud ue ug ui ul um un up ur us ut va ve vi vo wa we wh wi wn wo xp ye yo ys ze"
    ).split()
)
#: Of the 19 pairs in a window of letters so many at most are usual ones; runs of so few letters are words.
USUAL_PAIRS, SHORT_RUN = 11, 3
_RUN = re.compile(r"[A-Za-z]{%d,}" % (SHORT_RUN + 1))


def worded(s: str) -> bool:
    """Whether ``s`` is words, numbers and dates between separators, as paths and names of files are."""
    parts = [p for p in re.split(r"[/_=+-]+", s) if p]
    if len(parts) < 2:
        return False
    for p in parts:
        m = PART.fullmatch(p)
        if not m:
            return False
        letters = m[2] or ""
        if letters != letters.lower() and letters[1:] != letters[1:].lower() and letters != letters.upper():
            return False  # neither lower case, nor a capital first, nor all capitals
        if len(letters) > SHORT_RUN and sum(unusual_pairs(letters)) > MOST_ODD * (len(letters) - 1):
            return False
    return sum(len(p) > SHORT_RUN and p.isalpha() for p in parts) * 3 >= len(parts)


def char_class(s: str) -> str | None:
    """The class whose threshold holds for ``s``, None where no string of its kind is a secret."""
    if any(p.fullmatch(s) for p in ALLOW) or worded(s):
        return None
    if LETTERS.fullmatch(s):
        return "letters"
    if _HEX.fullmatch(s):
        return "hex"
    if _CAPS.fullmatch(s):
        return "caps"
    return "mixed" if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) else None


def unusual_pairs(s: str) -> list[int]:
    """1 for each character of ``s`` that no usual pair joins with the one before it, 0 at the start of a run of letters and outside."""
    out = [0] * len(s)
    for m in _RUN.finditer(s):
        run = m[0].lower()
        for i in range(1, len(run)):
            out[m.start() + i] = int(run[i - 1 : i + 1] not in PAIRS)
    return out


def entropy_spans(s: str, threshold: float, window: int = WINDOW, odd: list[int] | None = None, least_odd: int = 0) -> list[tuple[int, int]]:
    """The joined windows of ``s`` whose entropy is at least ``threshold`` bits a character.

    With ``odd``, one number for each character, those of a window's characters but the first must add up to ``least_odd``.
    """
    part = [0.0] + [n * math.log2(n) for n in range(1, window + 2)]  # a character enters before one leaves
    least = (math.log2(window) - threshold) * window + 1e-9  # the sum of n log2 n must not exceed it
    counts: dict[str, int] = {}
    total, n_odd, spans = 0.0, 0, []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += part[n + 1] - part[n]
        counts[c] = n + 1
        if i >= window:
            n = counts[s[i - window]]
            total += part[n - 1] - part[n]
            counts[s[i - window]] = n - 1
        if odd:
            n_odd += odd[i] - (odd[i - window + 1] if i >= window - 1 else 0)
        if i >= window - 1 and total <= least and n_odd >= least_odd:
            if spans and spans[-1][1] >= i - window + 1:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((i - window + 1, i + 1))
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within a kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def secret_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans: candidates of high entropy that no base span overlaps are added."""
    base = base_spans(text)
    extra, covered = [], Covered(base)
    for m in CANDIDATE.finditer(text):
        kind = char_class(m[0])
        if kind is None:
            continue
        letters = kind == "letters"
        for a, b in entropy_spans(m[0], THRESHOLDS[kind], WINDOW, unusual_pairs(m[0]) if letters else None, WINDOW - 1 - USUAL_PAIRS if letters else 0):
            a, b = a + m.start(), b + m.start()
            if not covered.overlaps(a, b):
                extra.append((a, 3, b))
    return base, sorted(base + extra)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            base, spans = secret_spans(text.as_py() or "")
            n = [sum(k == i for _, k, _ in base) for i in range(3)]
            rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
        n_assign, n_access, n_hex, sha, spans = zip(*rows) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_assign, n_access, n_hex)), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def secret_scan(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind; base_sha256 is of the base
    kinds' spans alone. Strings of fewer than ``WINDOW`` characters are no candidates of the window. Strings of fewer than ``WINDOW`` characters are no candidates. Cases: a null text is empty and has no spans; a null doc_id stays null; repeated rows are
    scanned each for itself; an empty table gives an empty table; other columns are left alone.
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_scan, SCHEMA)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
