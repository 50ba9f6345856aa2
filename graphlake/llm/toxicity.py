"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are words and word beginnings, counted by their occurrences. A
bounded, documented sample of labelled documents selects the features that
toxic documents use more and fits one weight vector shared by all ordered
thresholds: P(grade >= k) = sigmoid(w x - t_k), t_1 < t_2 < ... The score of a
document is its expected severity, the sum of these probabilities.

Labels may be grades 0, 1, 2, ...; they are used as they are. Where they only
tell toxic from clean, toxic documents are graded by how many of their words
are toxic ones (1: fewer than the median, 2: as many or more), and a
document's toxic words are those that the other half of the sample shows, so
that no document's own label decides which of its words count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.llm.common import keyed_texts, tidied

#: Labelled documents that a model is fitted on at most, their code points together,
#: and features it keeps.
SAMPLE = 5000
SAMPLE_CHARS = 64_000_000
FEATURES = 4000
PREFIXES = (4, 5, 6, 7)
WORD = re.compile(r"[^\W\d_]+")
#: Tokens whose features a worker remembers.
REMEMBERED = 100_000


def word_features(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n))


@dataclass
class OrdinalModel:
    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self) -> None:
        self._known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def _learn(self, tokens: set[str]) -> None:
        if len(self._known) > REMEMBERED:
            self._known.clear()
        of = self.features.get
        for token in tokens.difference(self._known):
            own = (of(f) for w in WORD.findall(token.lower()) for f in word_features(w))
            self._known[token] = tuple(i for i in own if i is not None)

    def tokens(self, text: str) -> list[tuple[int, ...]]:
        """The features of each token of a text that has any; a token is a run
        without white space and has the features of its words."""
        found = text.split()
        self._learn(set(found))
        known = self._known
        return [f for f in [known[t] for t in found] if f]

    def row(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(features, values) of a text; a value is log(1 + occurrences of the feature)."""
        counts = Counter(i for own in self.tokens(text) for i in own)
        return np.fromiter(counts, np.int64, len(counts)), np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))

    def probabilities(self, text: str) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        at, value = self.row(text)
        return 1 / (1 + np.exp(-np.clip(self.weights[at] @ value - self.thresholds, -30, 30)))


def select(texts: list[str], toxic: np.ndarray, features: int = FEATURES, least: int = 5) -> dict[str, float]:
    """The features that toxic documents hold more often, by likelihood ratio,
    with their smoothed log odds; ties go by spelling."""
    held: list[Counter[str]] = [Counter(), Counter()]
    for text, y in zip(texts, toxic):
        held[int(y)].update({f for w in set(WORD.findall(text.lower())) for f in word_features(w)})
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    scored = []
    for f, a in held[1].items():
        b = held[0][f]
        odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
        if a >= least and odds >= 1.5:
            share = (a + b) / (n1 + n0)
            gain = a * np.log(a / (share * n1)) + (b * np.log(b / (share * n0)) if b else 0)
            scored.append((-gain, f, odds))
    return {f: odds for _, f, odds in sorted(scored)[:features]}


def grades(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """0 for clean documents; 1 or 2 for toxic ones, by how many of their words are
    strong signs of toxicity in the other half of the sample."""
    fold, words = np.arange(len(texts)) % 2, np.zeros(len(texts), np.int64)
    for f in (0, 1):
        other = np.flatnonzero(fold != f)
        strong = [w for w, odds in select([texts[i] for i in other], toxic[other]).items() if odds >= 2]
        signs = OrdinalModel({w: i for i, w in enumerate(strong)}, np.zeros(0), np.zeros(0))
        for i in np.flatnonzero((fold == f) & (toxic == 1)):
            words[i] = len(signs.tokens(texts[i]))
    middle = np.median(words[toxic == 1])
    return np.where(toxic == 1, 1 + (words >= max(middle, 1)), 0)


def thresholds(state: np.ndarray, levels: int) -> np.ndarray:
    """t_1 and, from the logs of the gaps, the thresholds above it."""
    return state[-levels] + np.concatenate([[0.0], np.cumsum(np.exp(state[len(state) - levels + 1 :]))])


def loss_and_gradient(state: np.ndarray, doc: np.ndarray, at: np.ndarray, value: np.ndarray, y: np.ndarray, levels: int, l2: float) -> tuple[float, np.ndarray]:
    """Mean -log P(grade) plus the penalty, and its derivative by the weights, the
    first threshold and the logs of the gaps."""
    n, w, t = len(y), state[:-levels], thresholds(state, levels)
    s = np.bincount(doc, weights=w[at] * value, minlength=n)
    p = 1 / (1 + np.exp(-np.clip(s[:, None] - t, -30, 30)))
    full = np.hstack([np.ones((n, 1)), p, np.zeros((n, 1))])
    rows = np.arange(n)
    chance = np.maximum(full[rows, y] - full[rows, y + 1], 1e-12)
    g = np.zeros((n, levels))  # by s - t_k
    low, high = np.flatnonzero(y > 0), np.flatnonzero(y < levels)
    slope = p * (1 - p)
    g[low, y[low] - 1] = -slope[low, y[low] - 1] / chance[low]
    g[high, y[high]] += slope[high, y[high]] / chance[high]
    g[y == 0, 0] = p[y == 0, 0]  # the same, where the quotient would lose its digits
    g[y == levels, -1] = p[y == levels, -1] - 1
    g /= n
    out = np.empty_like(state)
    out[:-levels] = np.bincount(at, weights=g.sum(axis=1)[doc] * value, minlength=len(w)) + l2 * w
    below = -g.sum(axis=0)
    out[-levels] = below.sum()
    out[len(out) - levels + 1 :] = below[::-1].cumsum()[::-1][1:] * np.exp(state[len(state) - levels + 1 :])
    return float(-np.log(chance).mean() + l2 / 2 * (w @ w)), out


def fit(texts: list[str], labels: np.ndarray, l2: float = 3e-5, rounds: int = 600) -> OrdinalModel:
    """Full-batch Adam on the likelihood of the grades. Where all labels are equal
    the model has no features and gives the base rate."""
    labels = np.asarray(labels, np.int64)
    toxic = (labels > 0).astype(np.int64)
    chosen = select(texts, toxic) if 0 < toxic.sum() < len(toxic) else {}
    y = grades(texts, toxic) if chosen and labels.max() == 1 else np.maximum(labels, 0)
    levels = max(int(y.max()) if len(y) else 0, 2)
    model = OrdinalModel({f: i for i, f in enumerate(chosen)}, np.zeros(len(chosen)), np.arange(levels, dtype=float))
    if not chosen:
        rate = np.clip(toxic.mean() if len(toxic) else 0, 1e-3, 1 - 1e-3)
        model.thresholds += np.log(1 - rate) - np.log(rate)
        return model
    rows = [model.row(t) for t in texts]
    doc = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    at, value = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    state = np.zeros(len(chosen) + levels)
    state[: len(chosen)] = 0.1
    state[len(chosen)] = 1.0
    m, v = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, rounds + 1):
        _, g = loss_and_gradient(state, doc, at, value, y, levels, l2)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        state -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights, model.thresholds = state[: len(chosen)].copy(), thresholds(state, levels)
    return model


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text", chars: int = SAMPLE_CHARS
) -> tuple[list[str], np.ndarray]:
    """At most ``rows`` labelled texts, those of the least hashed ids, of at most
    ``chars`` code points together (shorter texts first); label rows without an id
    or label are no examples, and of a repeated id the least text and label count."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = keyed_texts(docs, id_col, text_col).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    # A window over the sample, which is bounded.
    total = F.sum(F.length("text")).over(Window.orderBy(F.length("text"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    table = found.withColumn("total", total).where(F.col("total") <= chars).toPandas().sort_values("doc_id")
    return table["text"].tolist(), table["y"].to_numpy(np.int64)


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, severity (the expected grade), p_toxic =
    P(grade >= 1), toxic (1 if p_toxic >= 0.5). Null and empty texts have no feature
    and get the model's score for none; an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held.value
        for batch in batches:
            p = np.array([scorer.probabilities(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(scorer.thresholds))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((p[:, 0] >= 0.5).astype(np.int32))],
                ["doc_id", "severity", "p_toxic", "toxic"],
            )

    return keyed_texts(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id long, severity double, p_toxic double, toxic int")


def without_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not call toxic; null
    texts are judged like empty ones."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidied(lambda own: (pd.Series([held.value.probabilities(t or "")[0] < 0.5 for t in texts], dtype=bool) for texts in own))(batches)

    return docs.where(clean(F.col(f"`{text_col}`")))


def toxicity(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """Fit on a sample of ``labelled`` (``docs`` unless given) and score ``docs``."""
    texts, y = labelled_sample(labelled if labelled is not None else docs, labels, "toxic", sample)
    return score_toxicity(docs, fit(texts, y))
