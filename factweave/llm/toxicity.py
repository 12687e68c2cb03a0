"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. Both have the same background in front,
trained on windows of ordinary text, so that what has nothing to do with toxicity compresses alike. The class's own
part behind it is trained by zstandard on windows of that class: on the words of ordinary rows, and on those word
beginnings and words of toxic rows that labelled rows show to be typical of them, each as often as rows hold it.

A text's windows are its words. Each is set between pieces of the background, as zstandard finds nothing in inputs
of a few bytes, and compressed with either dictionary; the gain is the mean difference in length. How many windows
gain how much is compared with thresholds that are calibrated on labelled rows which trained no dictionary; these rows
also choose between a few sizes of the dictionaries' own parts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Bounds of the labelled sample that is fitted on: rows of each class, in the order of md5(doc_id), and their length.
TOXIC_ROWS, ORDINARY_ROWS, ROW_CHARS = 1500, 3000, 20_000
#: Compression level; bytes of the background, and of the windows that train it; bytes of a frame, how many there are,
#: and how many bytes of one stand before a word; gains in bytes that count as small, middle, large.
LEVEL, BACKGROUND, WINDOW, FRAME, FRAMES, LEAD, GAINS = 19, 8192, 256, 32, 3, 16, (1.0, 2.0, 3.0, 4.0)
#: What calibration chooses of: words in a training sample, bytes of a dictionary's own part, and of the segments and the
#: pieces in them from which zstandard puts it together. The share of the sample that trains dictionaries, in thirds.
WORDS, OWN, SEGMENTS, TRAIN_THIRDS = (1, 2), (512, 768, 1024, 1536), ((16, 6), (16, 8)), 2
#: What makes a unit typical: rows that hold it, standard deviations above chance, share of rows that are toxic.
LEAST_ROWS, LEAST_Z, LEAST_SHARE = 5, 6.0, 0.8
#: A toxic text that is missed costs as much as so many clean ones that are rejected.
MISS_COST = 3.0
#: Distinct words whose gains a worker remembers; bytes that a match has at least.
REMEMBERED, MATCH = 250_000, 4

_SPLIT = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r.,!?;:\"'()[]{}#*$%&|<>"})


def cleaned(text: str | None) -> bytes:
    """Lower case, one blank before and after each word, no punctuation."""
    words = (text or "").lower().translate(_SPLIT).split(" ")
    return b" " + "".join(f"{w} " for w in words if w).encode("utf-8", "replace")


def windows(data: bytes, size: int) -> list[bytes]:
    """Pieces of ``size`` bytes at most, cut at blanks if possible; each piece has the blank at which it was cut."""
    out, i, n = [], 0, len(data)
    while i < n - 1 or not out:
        j = min(n, i + size)
        if j < n:
            k = data.rfind(b" ", i + 1, j)
            if k > i:
                j = k + 1
        out.append(data[i:j])
        i = j - 1 if j < n and data[j - 1 : j] == b" " else j
    return out


def _units(word: str) -> set[str]:
    return {f" {word[:k]}" for k in range(4, min(len(word), 9))} | ({f" {word} "} if len(word) > 2 else set())


def _spread(texts: list[bytes], units: set[str]) -> Counter:
    """Rows with each of ``units``; a row counts only if it holds the unit between neighbours that no earlier row has, so that near copies count once."""
    seen: dict[str, set] = defaultdict(set)
    count: Counter = Counter()
    for text in texts:
        words = text.decode("utf-8", "replace").split()
        new: set[str] = set()
        for i, w in enumerate(words):
            for u in _units(w) & units:
                around = hash((words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""))
                if u not in new and around not in seen[u]:
                    seen[u].add(around)
                    new.add(u)
        count.update(new)
    return count


def _rows(text: bytes) -> set[str]:
    return set().union(*map(_units, set(text.decode("utf-8", "replace").split())))


def typical_units(toxic: list[bytes], ordinary: list[bytes]) -> list[str]:
    """The units typical of toxic rows, the strongest last; of units that hold one another, the longest one of about the same count."""
    count: Counter = Counter()
    for text in toxic:
        count.update(_rows(text))
    known = {u for u, n in count.items() if n >= LEAST_ROWS}
    other: Counter = Counter()
    for text in ordinary:
        other.update(_rows(text) & known)
    known = {u for u in known if count[u] > LEAST_SHARE * (count[u] + other[u])}
    count, other = _spread(toxic, known), _spread(ordinary, known)
    p = len(toxic) / (len(toxic) + len(ordinary))
    found = {}
    for u in known:
        n, rows = count[u], count[u] + other[u]
        z = (n - rows * p) / math.sqrt(rows * p * (1 - p))
        if n >= LEAST_ROWS and z > LEAST_Z and n > LEAST_SHARE * rows:
            found[u] = z
    kept: list[str] = []
    for u in sorted(found, key=lambda u: (len(u), u)):
        longer = any(v != u and v.startswith(u) and count[v] >= 0.6 * count[u] for v in found)
        if not longer and not any(u.startswith(v) for v in kept):
            kept.append(u)
    return sorted(kept, key=lambda u: (found[u], u))


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


def trained(samples: list[bytes], size: int, segment: tuple[int, int] = (0, 0)) -> bytes:
    """A dictionary that zstandard trains on the samples; their own bytes where they are too few for that."""
    try:
        return zstandard.train_dictionary(size, samples, level=3, k=segment[0], d=segment[1]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _mixed(words: list[bytes], n: int) -> list[bytes]:
    """Samples of ``n`` words, in an order that depends on nothing but the words and keeps equal ones apart."""
    nth: Counter = Counter()
    keyed = []
    for w in sorted(words):
        nth[w] += 1
        keyed.append((zlib.crc32(b"%d %b" % (nth[w], w)), w))
    words = [w for _, w in sorted(keyed)]
    samples = [b"".join(words[i : i + n]) for i in range(0, len(words), n)]
    return [x if len(x) >= 8 else x + x for x in samples]  # zstandard passes over shorter ones


_GAINS: dict[tuple[bytes, bytes], dict[bytes, float]] = {}  # a worker's memory, which outlives a task


@dataclass
class Model:
    """Two dictionaries and the weights of a text's features; without dictionaries the score is ``prior``."""

    background: bytes = b""
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: tuple[float, ...] = ()
    prior: float = 0.0

    def _open(self) -> None:
        self._pair = _compressor(self.background + self.toxic).compress, _compressor(self.background + self.ordinary).compress
        ends = [len(self.background) - FRAME * i for i in range(FRAMES)]
        self._frames = [f for e in ends if len(f := self.background[max(0, e - FRAME) : max(0, e)]) == FRAME] or [self.background[-FRAME:]]
        self._pieces = {self.toxic[i : i + MATCH] for i in range(len(self.toxic) - MATCH + 1)}
        key = self.toxic, self.ordinary
        if key not in _GAINS:
            _GAINS.clear()
            _GAINS[key] = {}
        self._known = _GAINS[key]

    def gain(self, word: bytes) -> float:
        """How many bytes the window of a word is shorter with the toxic dictionary; 0 if that has no piece of it."""
        found = self._known.get(word)
        if found is None:
            window = b" " + word + b" "
            found = 0.0
            if any(window[i : i + MATCH] in self._pieces for i in range(len(window) - MATCH + 1)):
                t, o = self._pair
                framed = [f[:LEAD] + window + f for f in self._frames]
                found = sum(len(o(x)) - len(t(x)) for x in framed) / len(framed)
            if len(self._known) < REMEMBERED:  # the first ones met are mostly the frequent ones
                self._known[word] = found
        return found

    def _features(self, text: str | None) -> list[float]:
        if not hasattr(self, "_pair"):
            self._open()
        words = Counter(cleaned(text).split())
        gains = {w: g for w in words if (g := self.gain(w)) >= 1}
        top = [*sorted(gains.values(), reverse=True)[:3], 0, 0, 0][:3]
        return [1.0, *top, *(math.sqrt(sum(words[w] for w, g in gains.items() if g >= least)) for least in GAINS), math.log(1 + words.total())]

    def score(self, text: str | None) -> float:
        if not self.weights:
            return self.prior
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self._features(text), self.weights))))))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of a logistic model with a small ridge, by Newton's steps, and its loss."""
    mean, std = x.mean(0), x.std(0) + 1e-9
    mean[0], std[0] = 0, 1
    a, w = (x - mean) / std, np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.eye(len(w)), a.T @ (y - p) - w)
    z = np.clip(a @ w, -30, 30)
    raw = w / std
    raw[0] -= float((w / std * mean).sum())
    return raw, float((np.log1p(np.exp(z)) - y * z).sum())


def _split(texts: list[str]) -> tuple[list[bytes], list[bytes]]:
    """The texts that train dictionaries, and those that calibrate; both have some where there are two."""
    fit = [cleaned(x) for i, x in enumerate(texts) if i % 3 < TRAIN_THIRDS]
    return fit, [cleaned(x) for i, x in enumerate(texts) if i % 3 >= TRAIN_THIRDS]


def train(toxic: list[str], ordinary: list[str], odds: float | None = None) -> Model:
    """Fit on texts of both classes: the dictionaries on two thirds, then the weights and thresholds on the others.

    ``odds`` are those of a toxic row among all labelled rows, by default those of the texts given.
    """
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    prior = (len(toxic) + 1) / (len(toxic) + len(ordinary) + 2)
    if len(toxic) < LEAST_ROWS or len(ordinary) < LEAST_ROWS:
        return Model(prior=min(prior, 0.49))
    (t, t_rest), (o, o_rest) = _split(toxic), _split(ordinary)
    background = trained([w for x in o for w in windows(x, WINDOW)], BACKGROUND)
    units = typical_units(t, o)
    count = _spread(t, set(units))
    own = [u.encode() for u in units for _ in range(count[u])]
    other = _mixed([b" " + w + b" " for x in o for w in sorted(set(x.split()))], 2)
    y = np.r_[np.ones(len(t_rest)), np.zeros(len(o_rest))]
    rest = [x.decode() for x in [*t_rest, *o_rest]]
    best = None
    for size in OWN:
        ordinary_part = trained(other, size, SEGMENTS[0])
        for words, segment in product(WORDS, SEGMENTS):
            model = Model(background, trained(_mixed(own, words), size, segment), ordinary_part, (0.0,) * (5 + len(GAINS)), prior)
            weights, loss = _logistic(np.array([model._features(x) for x in rest]), y)
            if best is None or loss < best[0]:
                best = loss, model, weights
    _, model, raw = best
    if odds is not None:  # the sample is richer in toxic rows than the table
        raw[0] += math.log(odds * MISS_COST) - math.log(len(toxic) / len(ordinary))
    model.weights = tuple(float(v) for v in raw)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of the labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("l_id"))
    known = known.agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where(F.col("toxic") == F.col("most"))  # labels that contradict one another teach nothing
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.char_length("text") <= ROW_CHARS)
    ids = docs.select("doc_id").join(known, F.col("doc_id") == F.col("l_id"))

    def sample(label: int, n: int) -> list[int]:
        rows = ids.where(F.col("toxic") == label).select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("rank")).distinct()
        return [r["doc_id"] for r in rows.orderBy("rank", "doc_id").limit(n).collect()]

    # Only ids are sorted; then the sample's texts, which the bounds limit, are read.
    picked = [(i, label) for label, n in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS)) for i in sample(label, n)]
    chosen = docs.sparkSession.createDataFrame(picked, "s_id long, label int")
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("s_id")).select("s_id", "label", "text").collect()
    rows.sort(key=lambda r: (r["s_id"], r["text"]))
    n = known.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count(F.lit(1)).alias("all")).first()
    odds = (n["toxic"] + 1) / (n["all"] - n["toxic"] + 1)
    return train([r["text"] for r in rows if r["label"] == 1], [r["text"] for r in rows if r["label"] == 0], odds)


def scorer(model: Model):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text); ``labels`` has doc_id and toxic.

    Only the text is scored, the whole of it. Cases: null and empty texts have no window and get a score; repeated rows
    get equal scores; a null doc_id stays and counts as held out; rows with a null label, and doc_ids with labels of
    both kinds, are not learnt from; with fewer than five different texts of a class the score is the prior, below 0.5.
    An empty table gives an empty table. Other columns are left alone.
    """
    model = fit(docs, labels)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(model)(F.col("text").cast("string")).alias("score"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score less than 0.5, with all their columns, whatever their names.

    Cases are those of ``toxicity``: null and empty texts are scored too, repeated rows go or stay together, and an
    empty table stays empty.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(scorer(model)(F.col("text").cast("string")) < 0.5)
