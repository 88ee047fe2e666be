"""Quality by naive Bayes support vectors.

Indicators of n-grams are scaled by the log of how much likelier the n-gram is in good than in bad
texts, and a linear model with hinge loss is fitted on them by dual coordinate descent; a sigmoid
turns its margin into a score. What makes a text bad is its form more than its vocabulary, which has
no end: the n-grams are of token shapes (``Token,`` is ``Aa,``), where a token equal to the one before
it is marked, and each is an indicator at several densities. A long token, as texts without blanks
have, counts as several, so that all of it is looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import coded, fold, labelled_sample

#: Bounds of the sample that is fitted, read by the driver: texts per class, code points of a text.
PER_CLASS, MAX_CHARS = 3_000, 20_000
#: An n-gram counts as an indicator at each of these shares of the tokens it reaches; 0: it is there.
DENSITIES = (0.0, 1 / 32, 1 / 8, 1 / 2)
#: Shapes the model knows; others are one shape.
SHAPES = 1_024
#: Code points and shape runs of a token; what is longer counts as several tokens.
PIECE, RUNS = 64, 8
#: Characters looked at at once.
SLICE = 1 << 21
EPOCHS, COST = 10, 0.005
ACCEPT = 0.7


def _kind(c: str) -> str:
    return "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c


def shape_of(token: str) -> str:
    """Runs of capitals, small letters and digits as one sign each; other signs once per run."""
    return "".join(k for k, _ in groupby(map(_kind, token)))


def pieces_of(token: str) -> list[str]:
    """The whole token in pieces: at most ``PIECE`` code points each, and ``RUNS`` runs."""
    if len(token) <= RUNS or len(token) <= PIECE and len(shape_of(token)) <= RUNS:
        return [token]
    out = []
    for k in range(0, len(token), PIECE):
        part = token[k : k + PIECE]
        edges = np.cumsum([len(list(run)) for _, run in groupby(map(_kind, part))])[RUNS - 1 :: RUNS].tolist()
        out += [part[a:b] for a, b in zip([0, *edges], [*edges, len(part)]) if a < b]
    return out


class Grams:
    """Shape n-grams (one and two tokens) of texts, as numbers."""

    def __init__(self, shapes: list[str]):
        self.number = {s: k + 1 for k, s in enumerate(shapes)}
        self.base = 2 * len(shapes) + 2

    def indicators(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) pairs, sorted: feature is an n-gram's number with its density. Texts are
        looked at some at a time."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        begin = size = 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size >= SLICE or k == len(texts) - 1:
                who, feature = self._indicators(texts[begin : k + 1])
                found.append((who + begin, feature))
                begin, size = k + 1, 0
        return tuple(np.concatenate(x) for x in zip(*found))

    def _indicators(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        parts = [(t or "").split() for t in texts]
        tokens, different = coded(t for p in parts for t in p)
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        # Each token gives way to its pieces, nearly always one.
        pieces = [pieces_of(t) for t in different]
        counts = np.array([len(p) for p in pieces], np.int64)
        of, different = coded(x for p in pieces for x in p)
        owner, codes = np.repeat(owner, counts[tokens]), of[_ranges((np.cumsum(counts) - counts)[tokens], counts[tokens])]
        sizes = np.bincount(owner, minlength=len(texts))
        shape = np.array([self.number.get(shape_of(t), 0) for t in different] or [0], np.int64)
        same = np.r_[False, (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])] if len(codes) else np.zeros(0, bool)
        one = 2 * shape[codes] + same if len(codes) else np.zeros(0, np.int64)
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        grams = np.concatenate([one, self.base + one[pair] * self.base + one[pair + 1] if len(one) else one])
        owners = np.concatenate([owner, owner[pair]])
        width = self.base * (self.base + 1)
        keys, counts = np.unique(owners * width + grams, return_counts=True)
        who, gram = keys // width, keys % width
        share = counts / np.maximum(sizes[who], 1)
        rows = [(who[share >= d], gram[share >= d] * (len(DENSITIES) + 1) + k) for k, d in enumerate(DENSITIES)]
        # How long a text is, in powers of two: one more indicator, of no n-gram.
        length = np.array([n.bit_length() for n in sizes.tolist()], np.int64)
        rows.append((np.arange(len(texts)), (width + length) * (len(DENSITIES) + 1) + len(DENSITIES)))
        who, feature = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((feature, who))
        return who[order], feature[order]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count says, end to end."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


@dataclass(frozen=True)
class Model:
    grams: Grams
    features: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, texts: list[str | None]) -> np.ndarray:
        who, feature = self.grams.indicators(texts)
        return self.bias + _sums(who, feature, self.features, self.weights, len(texts))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -40, 40)))


def _sums(who: np.ndarray, feature: np.ndarray, known: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    if not len(known):
        return np.zeros(n)
    at = np.minimum(np.searchsorted(known, feature), len(known) - 1)
    hit = known[at] == feature
    return np.bincount(who[hit], weights[at[hit]], n)


def dual_descent(
    rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, epochs: int
) -> np.ndarray:
    """Weights (and, last, a bias) of the linear model with hinge loss, one dual variable at a time."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1 for _, v in rows])
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, value = rows[i]
            slack = y[i] * (w[at] @ value + w[size]) - 1
            new = min(max(alpha[i] - slack / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * value
                w[size] += step
                alpha[i] = new
    return w


def _fitted(who, feature, y, n, epochs, cost) -> tuple[np.ndarray, np.ndarray, float]:
    known, at, texts_with = np.unique(feature, return_inverse=True, return_counts=True)
    good = np.bincount(at[y[who] > 0], minlength=len(known)) + 1.0
    bad = texts_with + 2.0 - good
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    starts = np.searchsorted(who, np.arange(n + 1))
    rows = [(at[a:b], ratio[at[a:b]]) for a, b in zip(starts[:-1], starts[1:])]
    costs = cost * np.where(y > 0, n / (2 * (y > 0).sum()), n / (2 * (y < 0).sum()))
    w = dual_descent(rows, y, len(known), costs, epochs)
    return known, w[:-1] * ratio, float(w[-1])


def _sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid of best likelihood, targets held off 0 and 1."""
    good, bad = (y > 0).sum(), (y < 0).sum()
    goal = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x, theta = np.stack([margin, np.ones_like(margin)]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -40, 40)))
        gradient = x @ (p - goal)
        hessian = (x * np.maximum(p * (1 - p), 1e-6)) @ x.T + 1e-6 * np.eye(2)
        theta = theta - np.linalg.solve(hessian, gradient)
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(sample: list[tuple[str, int]], epochs: int = EPOCHS, cost: float = COST) -> Model:
    """A model of labelled texts. The sigmoid is fitted on margins of texts that the margin's own
    model has not seen (two halves). With only one label every score is next to that label; without
    any text every score is one half."""
    if len({label for _, label in sample}) < 2:
        shift = 0.0 if not sample else 6.0 if sample[0][1] else -6.0
        return Model(Grams([]), np.zeros(0, np.int64), np.zeros(0), 0.0, 1.0, shift)
    texts, y = [t for t, _ in sample], np.where(np.array([label for _, label in sample]) > 0, 1.0, -1.0)
    counted: dict[str, int] = {}
    for t in texts:
        for s in {shape_of(x) for w in set(t.split()) for x in pieces_of(w)}:
            counted[s] = counted.get(s, 0) + 1
    grams = Grams(sorted(counted, key=lambda s: (-counted[s], s))[:SHAPES])
    who, feature = grams.indicators(texts)
    half = np.zeros(len(y), np.int64)
    for sign in (1, -1):
        half[np.flatnonzero(y == sign)[1::2]] = 1
    margin = np.zeros(len(y))
    for k in (0, 1):
        own = half[who] != k
        place = np.cumsum(half != k) - 1
        known, w, bias = _fitted(place[who[own]], feature[own], y[half != k], int((half != k).sum()), epochs, cost)
        margin += np.where(half == k, bias + _sums(who, feature, known, w, len(y)), 0.0)
    known, w, bias = _fitted(who, feature, y, len(y), epochs, cost)
    return Model(grams, known, w, bias, *_sigmoid_fit(margin, y))


def train(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    per_class: int = PER_CLASS,
    max_chars: int = MAX_CHARS,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """A model of a bounded sample of labelled texts (see ``samples.labelled_sample``): at most
    ``per_class`` of each class. Everything it is then applied to is scored whole."""
    usable = F.lit(True) if usable is None else usable
    return fit(labelled_sample(docs, labels, label, usable, per_class, max_chars, id_col, text_col))


def scored(model: Model, docs: DataFrame, text: Column) -> Column:
    """The score (0 to 1) of each whole text; a null text counts as empty, and an empty one has its
    length as its only indicator."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.scores(texts.to_pylist()), pa.float64())

    return F.arrow_udf(run, "double")(text)


def scores(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col="doc_id", text_col="text", **sizes
) -> DataFrame:
    """One row per document: ``id, score``. Repeated rows come repeatedly; an empty table gives none."""
    model = train(docs, labels, usable, id_col=id_col, text_col=text_col, **sizes)
    return docs.select(F.col(id_col).alias("id"), scored(model, docs, F.col(text_col)).alias("score"))


def held_out(id_col: str = "doc_id") -> Column:
    """The rows whose labels are not learned: every fourth by the checksum of the id."""
    return F.coalesce(fold(id_col, 4) == 2, F.lit(False))
