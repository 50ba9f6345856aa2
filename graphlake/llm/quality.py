"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

A document is a sparse vector of two normalised blocks: how its words are
written (case, digits, attached punctuation, repetition of the word before) as
single and paired word shapes, and its hashed words weighted by inverse
document frequency. A truncated SVD of a bounded labelled sample gives the
latent space; the sample's unit vectors and labels are broadcast (their number
is a parameter). Every document is projected, its cosines with all labelled
vectors are computed in blocks, and the labels of its nearest neighbours are
weighted by similarity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm.common import keyed_texts, tidied
from graphlake.llm.encoding import slices
from graphlake.llm.toxicity import labelled_sample

#: Labelled documents a model is fitted on at most; its latent dimensions; voters;
#: the power of its similarity that a voter's weight is.
SAMPLE = 4000
DIMENSIONS = 48
NEIGHBOURS = 15
SHARPNESS = 8
SHAPES = 1024
WORDS = 3072
#: Share of the word block in a document's vector.
WORD_WEIGHT = 0.4
THRESHOLD = 0.3
BLOCK = 256

RUN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def shape(token: str) -> str:
    """How a token is written: a letter run as a (lower), A (capital first), U
    (capitals), digits as 0, and a punctuation run as itself, three signs at most."""
    out = []
    for run in RUN.findall(token):
        if run[0].isalpha():
            out.append("U" if len(run) > 1 and run.isupper() else "A" if run[0].isupper() else "a")
        else:
            out.append("0" if run[0].isdigit() else run[:3])
    return "".join(out[:4])


class Tokens:
    """Shape and word columns of tokens, kept per worker up to ``keep`` tokens."""

    def __init__(self, keep: int = 200_000):
        self.keep, self.known = keep, {}

    def of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.keep:
            self.known.clear()
        known, h = self.known, xxhash.xxh3_64_intdigest
        for t in set(tokens).difference(known):
            known[t] = h(shape(t)) % SHAPES << 32 | h(t.lower()) % WORDS
        both = np.array([known[t] for t in tokens], np.int64)
        return both >> 32, both & 0xFFFFFFFF


def counts(tokens: Tokens, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(shape block, word counts) of a text; the shape block is the root of each
    single or paired shape's share. An empty text has zeros."""
    found = text.split()
    if not found:
        return np.zeros(SHAPES, np.float32), np.zeros(WORDS, np.float32)
    shapes, words = tokens.of(found)
    again = np.zeros(len(found), bool)
    again[1:] = (words[1:] == words[:-1]) & (shapes[1:] == shapes[:-1])
    shapes = np.where(again, SHAPES - 1, shapes)
    pairs = (shapes[:-1] * 31 + shapes[1:] * 7 + 13) % SHAPES
    share = np.bincount(np.concatenate([shapes, pairs]), minlength=SHAPES) / (2 * len(found) - 1)
    return np.sqrt(share).astype(np.float32), np.bincount(words, minlength=WORDS).astype(np.float32)


def features(tokens: Tokens, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    rows = [counts(tokens, t) for t in texts]
    return np.stack([r[0] for r in rows]), np.stack([r[1] for r in rows])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class NeighbourModel:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    tokens: Tokens = field(default_factory=Tokens)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tokens": Tokens()}

    def project(self, texts: list[str]) -> np.ndarray:
        shapes, words = features(self.tokens, texts)
        return unit(weighted(shapes, words, self.idf) @ self.axes)

    def score(self, texts: list[str]) -> np.ndarray:
        """Share of label 1 among the nearest neighbours, weighted by similarity;
        the sample's mean label for a text without a word."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(texts), prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(texts), BLOCK):
            cosine = self.project(texts[a : a + BLOCK]) @ self.vectors.T
            near = nearest(cosine, k)
            weight = np.clip(np.take_along_axis(cosine, near, axis=1), 0, None) ** SHARPNESS
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1)
            out[a : a + BLOCK] = np.where(total > 0, vote / np.maximum(total, 1e-12), prior)
        return np.clip(out, 0, 1)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The k columns of each row with the greatest similarity, to six decimals; of
    equals the first columns, which are those of the least ids."""
    value = np.round(cosine, 6)
    near = np.argpartition(-value, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(value, near, axis=1).min(axis=1, keepdims=True)
    tied = (value >= least).sum(axis=1) > k
    for i in np.flatnonzero(tied):
        near[i] = np.argsort(-value[i], kind="stable")[:k]
    return near


def weighted(shapes: np.ndarray, words: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return np.hstack([unit(shapes), WORD_WEIGHT * unit(np.log1p(words) * idf)])


def fit(texts: list[str], labels: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 2) -> NeighbourModel:
    """The latent space by randomised subspace iteration on the sample's matrix."""
    if not texts:
        return NeighbourModel(np.ones(WORDS, np.float32), np.zeros((SHAPES + WORDS, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    tokens = Tokens()
    shapes, words = features(tokens, texts)
    idf = np.log((1 + len(texts)) / (1 + (words > 0).sum(axis=0))).astype(np.float32) + 1
    x = weighted(shapes, words, idf)
    basis = np.random.default_rng(seed).standard_normal((x.shape[1], dimensions + 16)).astype(np.float32)
    for _ in range(3):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ right.T)[:, :dimensions].astype(np.float32)
    return NeighbourModel(idf, axes, unit(x @ axes), labels.astype(np.float32))


def held_out(id_col: str = "doc_id"):
    """Whether labels of this document are never learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def score_quality(docs: DataFrame, model: NeighbourModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score. Null and empty texts get the
    sample's mean label; an empty table gives no rows. Only the text is scored."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores = [scorer.score(texts[a:b]) for a, b in slices(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *scores]))], ["doc_id", "score"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on labelled documents outside the held-out fifth and score all:
    doc_id, held_out, score, predicted. A null id is never held out."""
    texts, y = labelled_sample(docs, labels.where(~held_out()), "quality", sample)
    scored = score_quality(docs, fit(texts, y))
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
