"""Toxicity by multiple-instance learning.

Only documents are labelled, but what makes one toxic is a sentence. A linear model scores each
sentence, and a document is toxic unless none of its sentences is (noisy-or):
``p(doc) = 1 - prod(1 - p(sentence))``. The model is trained through the noisy-or from document
labels alone, and its sentence scores then say which sentences offend.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked
from .samples import coded, fold, labelled_sample

#: Bounds of the sample that is fitted, read by the driver: texts per class, code points of a text.
PER_CLASS, MAX_CHARS = 3_000, 20_000
#: A feature is kept, however many there are, if the classes differ in it by so much chi-square: chance
#: alone does that to one feature in a thousand.
STRENGTH = 10.83
MIN_TEXTS = 3
STEPS = 300
REJECT = 0.7

SCORED = "struct<score: double, offending: array<struct<start: int, end: int, score: double>>>"

_LETTERS = re.compile(r"[^\W\d_]+")
_STOP = (".", "!", "?")


def features_of(token: str) -> list[str]:
    """The words of a token, and how they begin: stems are what most languages inflect least."""
    out = []
    for word in _LETTERS.findall(token.lower()):
        out += [f"={word}", f"{word[:4]}^"] if len(word) > 4 else [f"={word}"]
        if len(word) > 5:
            out.append(f"{word[:5]}^^")
    return out


def tokens_of(text: str | None) -> tuple[list[str], list[int]]:
    """Tokens parted by white space, and for each sentence the token it ends before. A sentence ends
    with a token that ends in a stop, and with its line."""
    tokens: list[str] = []
    ends: list[int] = []
    for line in (text or "").split("\n"):
        for token in line.split():
            tokens.append(token)
            if token.endswith(_STOP):
                ends.append(len(tokens))
        if tokens and (not ends or ends[-1] < len(tokens)):
            ends.append(len(tokens))
    return tokens, ends


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class Model:
    """Weights of features, and the score of a sentence without any."""

    weights: dict[str, float]
    bias: float

    def sentences(self, texts: list[str | None]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """Sentence ends of each text, then the scores of all sentences and where each text's begin."""
        parts = [tokens_of(t) for t in texts]
        codes, different = coded(t for tokens, _ in parts for t in tokens)
        get = self.weights.get
        known = np.array([sum(get(f, 0.0) for f in features_of(t)) for t in different] or [0.0])
        sizes = np.array([len(tokens) for tokens, _ in parts], np.int64)
        first = np.cumsum(sizes) - sizes
        ends = [e for _, e in parts]
        counts = np.array([len(e) for e in ends], np.int64)
        at = np.array([x for e in ends for x in e], np.int64) + np.repeat(first, counts)
        offsets = np.cumsum(counts) - counts
        # Tokens that say something, each once per sentence.
        telling = np.flatnonzero(known[codes]) if len(codes) else np.zeros(0, np.int64)
        pairs = np.unique(np.searchsorted(at, telling, "right") * len(known) + codes[telling])
        z = np.bincount(pairs // len(known), known[pairs % len(known)], len(at)) if len(at) else np.zeros(0)
        return ends, _sigmoid(self.bias + z), offsets


def fit(sample: list[tuple[str, int]], strength: float = STRENGTH, steps: int = STEPS, decay: float = 5e-5) -> Model:
    """Full-batch gradient descent (Adam) on the log-loss of the noisy-or, weights starting at zero.

    Without texts, or with one label only, all sentences share one score: next to zero, or high if
    all texts are toxic.
    """
    if len({y for _, y in sample}) < 2:
        return Model({}, 6.0 if sample and sample[0][1] else -12.0)
    y = np.array([label for _, label in sample], float)
    parsed = [tokens_of(t) for t, _ in sample]
    cache: dict[str, list[str]] = {}
    with_it = (Counter(), Counter())
    for (tokens, _), label in zip(parsed, y):
        held = set()
        for token in set(tokens):
            if token not in cache:
                cache[token] = features_of(token)
            held.update(cache[token])
        with_it[int(label)].update(held)
    names = [f for f in with_it[0] | with_it[1] if with_it[0][f] + with_it[1][f] >= MIN_TEXTS]
    a = np.array([with_it[1][f] for f in names], float)
    b = np.array([with_it[0][f] for f in names], float)
    n1, n0 = y.sum(), len(y) - y.sum()
    share = (a + b) / (n1 + n0)
    found = (a - share * n1) ** 2 * (n1 + n0) / (share * (1 - share) * n1 * n0 + 1e-9)
    names = sorted(names[k] for k in np.flatnonzero(found >= strength))
    number = {f: k for k, f in enumerate(names)}

    sentence, feature, doc = [], [], []
    for d, (tokens, ends) in enumerate(parsed):
        start = 0
        for end in ends:
            for token in dict.fromkeys(tokens[start:end]):
                for f in cache[token]:
                    if f in number:
                        sentence.append(len(doc))
                        feature.append(number[f])
            doc.append(d)
            start = end
    sentence, feature, doc = (np.array(x, np.int64) for x in (sentence, feature, doc))
    w, bias = np.zeros(len(names)), -5.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    balance = np.where(y > 0, len(y) / (2 * n1), len(y) / (2 * n0))
    for step in range(1, steps + 1):
        p = _sigmoid(bias + np.bincount(sentence, w[feature], len(doc)))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))  # log of no sentence being toxic
        some = np.maximum(1 - np.exp(none), 1e-12)
        pull = np.where(y > 0, -np.exp(none) / some, 1.0) * balance / len(y)
        slope = pull[doc] * p
        grad = np.append(np.bincount(feature, slope[sentence], len(names)) + decay * w, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return Model({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-6}, float(bias))


def train(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    per_class: int = PER_CLASS,
    max_chars: int = MAX_CHARS,
    label: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """A model of a bounded sample of labelled texts (see ``samples.labelled_sample``): at most
    ``per_class`` of each class. Everything it is then applied to is scored whole."""
    usable = F.lit(True) if usable is None else usable
    return fit(labelled_sample(docs, labels, label, usable, per_class, max_chars, id_col, text_col))


def scored(model: Model, docs: DataFrame, text: Column) -> Column:
    """``score`` (0 to 1, the noisy-or over all sentences of the whole text) and the ``offending``
    sentences (score of one half or more) as ranges of its white-space tokens. A text without words,
    or a null one, has no sentence: score 0, unless the model has only seen toxic texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        ends, p, offsets = sent.value.sentences(texts.to_pylist())
        quiet = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
        counts = np.array([len(e) for e in ends], np.int64)
        score = 1 - np.exp(quiet[offsets + counts] - quiet[offsets])
        marks: list[list] = [[] for _ in ends]
        hot = np.flatnonzero(p >= 0.5)
        for k, d in zip(hot.tolist(), (np.searchsorted(offsets, hot, "right") - 1).tolist()):
            s = k - int(offsets[d])
            marks[d].append({"start": ends[d][s - 1] if s else 0, "end": ends[d][s], "score": float(p[k])})
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(np.clip(score, 0, 1)), pa.array(marks, kind)], ["score", "offending"])

    return F.arrow_udf(run, SCORED)(text)


def scores(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col="doc_id", text_col="text", **sizes
) -> DataFrame:
    """One row per document: ``id, score, offending``. Repeated rows come repeatedly, an empty table
    gives no rows, and without labels every score is 0 or next to it."""
    model = train(docs, labels, usable, id_col=id_col, text_col=text_col, **sizes)
    found = docs.select(F.col(id_col).alias("id"), scored(model, docs, F.col(text_col)).alias("s"))
    return found.select("id", "s.score", "s.offending")


def keep_civil(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, limit=REJECT, id_col="doc_id", text_col="text", **sizes
) -> DataFrame:
    """The documents whose score is below ``limit``, as they came."""
    model = train(docs, labels, usable, id_col=id_col, text_col=text_col, **sizes)
    rows = packed(docs, scored(model, docs, F.col(text_col)).alias("s"))
    return unpacked(rows.where(F.col("s.score") < limit), docs)


def held_out(id_col: str = "doc_id") -> Column:
    """The rows whose labels are not learned: every third by the checksum of the id."""
    return F.coalesce(fold(id_col, 3) == 1, F.lit(False))
