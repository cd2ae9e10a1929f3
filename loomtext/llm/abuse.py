"""Abusive, hateful and sexual content by a linear classifier of character n-grams.

Each n-gram's feature is scaled by the naive Bayes log-count ratio of the class before a linear
model is fitted. Texts are normalised first, so that spaced, dotted, stretched or look-alike
spellings meet the plain ones, and cut into sentences: the labels are given to whole documents
of which mostly one sentence is at fault, so a positive document is represented by its
sentences that score highest, and a document's score is that of its worst sentence.

The model is fitted on the driver on a bounded sample of the labelled documents and has a fixed
number of weights; every document is scored as a whole. Its thresholds stand for all labelled
documents: a sampled one counts for as many as its side of the sample leaves out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLASSES = ("abusive", "hateful", "sexual")
BITS, NGRAMS = 18, (2, 3, 4, 5)
#: Code points of the longest span that is scored at once, and how far spans of a longer sentence overlap.
SPAN, LAP = 240, 60
#: Bound of the training sample: labelled documents with and without a positive label.
MAX_POSITIVE, MAX_NEGATIVE = 2000, 2500
#: Negative spans that the linear model sees: those that the log-count ratios alone find worst, and others.
HARD, EASY = 4000, 1000

# Letters of other scripts, and signs, that stand for Latin letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ß": "ss", "ı": "i", "ł": "l", "ø": "o", "æ": "ae", "œ": "oe",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}

_LATIN = re.compile(f"[{''.join(LOOK_ALIKES)}]")
_IN_WORD = re.compile(r"(?<=[a-z])[013457@$!|€]+(?=[a-z])|(?<![^\s])[1357@$](?=[a-z]{2})")
_SPACED = re.compile(r"(?<![a-z0-9])[a-z*](?:[ .\-_*·,/]{1,2}[a-z*](?![a-z0-9])){2,}")
_STRETCHED = re.compile(r"(.{1,3}?)\1{2,}")
_GAPS = re.compile(r"[ .\-_·,/]")
_NUMBER = re.compile(r"[0-9]+(?:[.,:][0-9]+)*")
_UNSEEN = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}\p{Co}\p{Cs}]+")
#: white space but single spaces and line ends
_BLANK = re.compile(r"[^\S\n ][^\S\n]*| [^\S\n]+")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”»)]*\s+|\s*\n\s*")


def normalise(text: str) -> str:
    """Lower case without marks, format characters and look-alikes; spaced, stretched and sign spellings undone; numbers as 0."""
    t = text.replace("\r", "\n")
    if not t.isascii():
        t = _LATIN.sub(lambda m: LOOK_ALIKES[m.group()], unicodedata.normalize("NFKD", t).lower())
        t = _UNSEEN.sub("", t)
    t = t.lower()
    t = _IN_WORD.sub(lambda m: "".join(SIGNS[c] for c in m.group()), t)
    t = _SPACED.sub(lambda m: _GAPS.sub("", m.group()), t)
    t = _STRETCHED.sub(r"\1", t)
    t = _NUMBER.sub("0", t)
    return _BLANK.sub(" ", t)


def sentences(text: str | None) -> list[str]:
    """Spans of a text that are scored, with a space at either end; none for a null, empty or blank text."""
    out = []
    for s in _SENTENCE.split(normalise(text)) if text else []:
        s = s.strip()
        while s:
            if len(s) <= SPAN:
                out.append(f" {s} ")
                break
            cut = s.rfind(" ", SPAN // 2, SPAN)
            cut = SPAN if cut < 0 else cut
            out.append(f" {s[:cut]} ")
            s = s[cut - LAP :]
    return out


def _hashed(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """The length of n-grams and the feature of each in a text, for every length that it has."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = codes.copy()
    for n in range(2, max(NGRAMS) + 1):
        if n > len(codes):
            return
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        if n in NGRAMS:
            yield n, (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)


def grams(spans: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the hashed n-grams of each span, an entry per occurrence."""
    row = np.repeat(np.arange(len(spans)), [len(s) for s in spans])
    rows, features = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n, feature in _hashed("".join(spans)):
        whole = np.flatnonzero(row[: len(feature)] == row[n - 1 :])
        rows.append(row[whole])
        features.append(feature[whole])
    return np.concatenate(rows), np.concatenate(features)


@dataclass
class Model:
    """weights[c, feature] already hold the log-count ratios; a span's score is their sum and the bias."""

    weights: np.ndarray
    bias: np.ndarray
    threshold: np.ndarray

    def spans(self, texts: list[str]) -> np.ndarray:
        """(span, class) scores."""
        out = np.tile(self.bias, (len(texts), 1))
        if not texts:
            return out
        size = np.array([len(t) for t in texts])
        start, row = np.cumsum(size) - size, np.repeat(np.arange(len(texts)), size)
        by_feature = np.ascontiguousarray(self.weights.T)
        for n, feature in _hashed("".join(texts)):
            w = by_feature[feature]
            w[row[: len(feature)] != row[n - 1 :]] = 0
            # the n-grams of a span lie together
            inside = start < len(feature)
            out[inside] += np.add.reduceat(w, start[inside], axis=0, dtype=np.float64)
        return out

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """(document, class) probabilities, the greatest over the spans; 0 without any."""
        cut = [sentences(t) for t in texts]
        out = np.zeros((len(texts), len(CLASSES)))
        flat = [s for c in cut for s in c]
        if flat:
            p = 1 / (1 + np.exp(-np.clip(self.spans(flat), -30, 30)))
            doc = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
            np.maximum.at(out, doc, p)
        return out


class _Spans:
    """The distinct spans of documents, their n-grams, and which document has which."""

    def __init__(self, cut: list[list[str]]):
        self.texts = list(dict.fromkeys(s for c in cut for s in c))
        number = {s: i for i, s in enumerate(self.texts)}
        self.of = [np.array(list(dict.fromkeys(number[s] for s in c)), np.int64) for c in cut]
        row, feature = grams(self.texts)
        order = np.argsort(row, kind="stable")
        self.row, self.feature = row[order], feature[order]
        self.start = np.searchsorted(self.row, np.arange(len(self.texts) + 1))

    def counts(self, docs: np.ndarray) -> np.ndarray:
        """In how many of the documents each span stands."""
        held = [self.of[d] for d in docs]
        return np.bincount(np.concatenate(held) if held else np.zeros(0, np.int64), minlength=len(self.texts)).astype(float)

    def support(self, weight: np.ndarray) -> np.ndarray:
        """Weighted count of each feature."""
        return np.bincount(self.feature, weight[self.row], 1 << BITS)

    def score(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.feature], len(self.texts))

    def pick(self, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of chosen spans, rows counted among them."""
        size = self.start[spans + 1] - self.start[spans]
        at = np.repeat(self.start[spans] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        return np.repeat(np.arange(len(spans)), size), self.feature[at]


def _ratio(positive: np.ndarray, negative: np.ndarray, n_positive: float, n_negative: float) -> np.ndarray:
    """Log-count ratios: in which part of the positive spans a feature stands against which of the negative ones."""
    return np.log((positive + 0.5) / (n_positive + 1)) - np.log((negative + 0.5) / (n_negative + 1))


def _linear(row: np.ndarray, feature: np.ndarray, n: int, y: np.ndarray, weight: np.ndarray, ratio: np.ndarray, turns: int = 80, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on features scaled by their log-count ratios, by Adam; returns scaled weights and bias."""
    used, col = np.unique(feature, return_inverse=True)
    value = ratio[used][col]
    w, b = np.full(len(used), 0.01), -2.0
    m, v, mb, vb, rate = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0, 0.02
    total = weight.sum()
    for t in range(1, turns + 1):
        z = np.bincount(row, w[col] * value, n) + b
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
        g, gb = np.bincount(col, err[row] * value, len(used)) + decay * w, err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    out = np.zeros(1 << BITS)
    out[used] = w * ratio[used]
    return out, float(b)


def _fit_class(spans: _Spans, y: np.ndarray) -> tuple[np.ndarray, float]:
    """One class from the labels of documents (0, 1, or -1 where unknown)."""
    positive = [d for d in np.flatnonzero(y == 1) if len(spans.of[d])]
    clean = spans.counts(np.flatnonzero(y == 0))
    if not positive or not clean.any():
        return np.zeros(1 << BITS), -30.0
    below, n_clean = spans.support(clean), clean.sum()
    chosen = spans.counts(np.array(positive))
    score = np.zeros(len(spans.texts))
    for _ in range(3):
        support = spans.support(chosen)
        # a feature seen in one positive document alone says nothing for it
        score = spans.score(_ratio(np.maximum(support - 1, 0), below, chosen.sum(), n_clean))
        worst = np.array([spans.of[d][np.argmax(score[spans.of[d]])] for d in positive])
        # a document without any sentence near the usual score may be labelled by mistake
        sure = score[worst] > max(0.0, 0.3 * np.median(score[worst]))
        sure |= not sure.any()
        chosen = np.bincount(worst[sure], minlength=len(score)).astype(float)
    ratio = _ratio(spans.support(chosen), below, chosen.sum(), n_clean)
    negative = np.flatnonzero((clean > 0) & (chosen == 0))
    by_score = negative[np.argsort(-score[negative], kind="stable")]
    rest = by_score[HARD:]
    negative = np.r_[by_score[:HARD], rest[:: max(1, len(rest) // EASY)][:EASY]]
    both = np.r_[np.flatnonzero(chosen), negative]
    labels = (np.arange(len(both)) < len(both) - len(negative)).astype(float)
    weight = np.where(labels == 1, chosen[both], np.log1p(clean[both]) / np.log(2))
    weight[labels == 1] *= 0.3 * weight[labels == 0].sum() / weight[labels == 1].sum()
    row, feature = spans.pick(both)
    return _linear(row, feature, len(both), labels, weight, ratio)


def _best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The probability from which F1 is greatest on held-out documents, each counted by its weight; the middle of the gap to the next lower one."""
    known = y >= 0
    p, y, weight = p[known], y[known], weight[known]
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum((weight * y)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + max(1, (weight * y).sum()))
    if not len(f1) or not y.sum():
        return 0.5
    k = int(np.argmax(f1))
    low = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order[k]] + low) / 2, 0.3, 0.9))


def fit(texts: list[str | None], labels: np.ndarray, held_out: int = 3, weight: np.ndarray | None = None) -> Model:
    """A model from documents and labels (document, class) of 0, 1 or -1; thresholds come from every held_out-th document, that the first fit doesn't see.

    weight: how many labelled documents each one stands for; thresholds are chosen for that mixture.
    """
    weight = np.ones(len(texts)) if weight is None else weight
    spans = _Spans([sentences(t) for t in texts])
    held = np.arange(len(texts)) % held_out == 0
    seen = np.where(held[:, None], -1, labels)

    def model(y: np.ndarray, threshold: np.ndarray) -> Model:
        fitted = [_fit_class(spans, y[:, c]) for c in range(len(CLASSES))]
        return Model(np.stack([w for w, _ in fitted]).astype(np.float32), np.array([b for _, b in fitted]), threshold)

    p = model(seen, np.full(len(CLASSES), 0.5)).documents([t for t, h in zip(texts, held) if h])
    threshold = np.array([_best_threshold(p[:, c], labels[held, c], weight[held]) for c in range(len(CLASSES))])
    return model(labels, threshold)


def scores(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct(abusive, hateful, sexual, found) of each text: probabilities, and whether one reaches its threshold.

    Null, empty and blank texts score 0. The model, 3 MB whatever the corpus, is broadcast.
    """
    shared = spark.sparkContext.broadcast(model)
    kind = T.StructType([*[T.StructField(c, T.DoubleType()) for c in CLASSES], T.StructField("found", T.BooleanType())])

    @F.arrow_udf(kind)
    def f(text: pa.Array) -> pa.Array:
        model, texts = shared.value, text.to_pylist()
        p = np.zeros((len(texts), len(CLASSES)))
        start, size = 0, 0
        # spans of about a million code points are scored at once
        for i, t in enumerate(texts):
            size += len(t or "")
            if size > 1_000_000 or i + 1 == len(texts):
                p[start : i + 1] = model.documents(texts[start : i + 1])
                start, size = i + 1, 0
        found = (p >= model.threshold).any(1)
        return pa.StructArray.from_arrays([*[pa.array(p[:, c]) for c in range(len(CLASSES))], pa.array(found)], [*CLASSES, "found"])

    return f(text)
