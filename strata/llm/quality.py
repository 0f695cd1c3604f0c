"""Operator 5: quality by the votes of the nearest labelled documents in a latent-semantic space.

Terms are hashed byte trigrams and a few bands of document shape (length, repetition, capitals).
A truncated SVD of the weighted term counts of the labelled sample gives the latent space. The
sample's vectors, whose number and width are bounded by parameters, are broadcast; every document
is compared with all of them by exact blocked cosine products, and its nearest ones vote.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField

from strata.llm.common import labelled_sample, texts_of, with_columns

TRIGRAMS = 2048
BANDS = 16  # per measure of shape
SHAPES = 6
TERMS = TRIGRAMS + BANDS * SHAPES
BLOCK = 512
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _band(values: list[float]) -> np.ndarray:
    """One-hot bands of numbers between 0 and 1, the neighbours of a band at half weight."""
    out = np.zeros((len(values), BANDS), np.float32)
    for row, value in zip(out, values, strict=True):
        at = min(BANDS - 1, int(max(0.0, value) * BANDS))
        row[at] = 1.0
        row[max(0, at - 1)] = max(row[max(0, at - 1)], 0.5)
        row[min(BANDS - 1, at + 1)] = max(row[min(BANDS - 1, at + 1)], 0.5)
    return out.ravel()


def terms_of(text: str) -> np.ndarray:
    """Logarithmic trigram counts, then the bands of shape. An empty text has bands only."""
    data = np.frombuffer(text.encode(), np.uint8)
    out = np.zeros(TERMS, np.float32)
    n = len(data)
    different = 0
    if n >= 3:
        wide = data.astype(np.uint32)
        codes = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        codes = (codes * np.uint32(2654435761)) >> np.uint32(21)
        counts = np.bincount(codes, minlength=TRIGRAMS)
        different = np.count_nonzero(counts)
        out[:TRIGRAMS] = np.log1p(counts)
        norm = np.linalg.norm(out[:TRIGRAMS])
        out[:TRIGRAMS] /= norm
    size = max(1, n)
    kinds = np.bincount(data, minlength=256)
    letters = kinds[WORD_BYTE].sum()
    capitals = kinds[65:91].sum()
    words = text.split()
    shapes = [
        np.log1p(n) / 14,
        different / min(size, TRIGRAMS),
        len(set(words)) / max(1, len(words)),
        capitals / max(1, letters),
        1 - letters / size,
        len(words) / size * 2,
    ]
    out[TRIGRAMS:] = _band(shapes)
    return out


@dataclass
class Space:
    """Term weights, projection, and the labelled vectors with their votes."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    worth: np.ndarray
    neighbours: int
    sharpness: float

    def project(self, terms: np.ndarray) -> np.ndarray:
        latent = (terms * self.weights) @ self.axes
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def score(self, terms: np.ndarray) -> np.ndarray:
        """Shares of the votes for 1; all that are as close as the last of the neighbours vote."""
        cosine = self.project(terms) @ self.vectors.T
        k = min(self.neighbours, cosine.shape[1])
        last = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k, None]
        row, near = np.nonzero(cosine >= last)
        weight = np.exp(self.sharpness * (cosine[row, near].astype(np.float64) - 1.0)) * self.worth[near]
        total = np.bincount(row, weight, len(cosine))
        return np.bincount(row, weight * self.votes[near], len(cosine)) / np.maximum(total, 1e-300)


def fit(
    terms: np.ndarray, labels: np.ndarray, sizes: dict[int, int], width: int, neighbours: int,
    sharpness: float,
) -> Space:
    """Latent space of the sample's terms; a vote weighs what its class was thinned out by."""
    there = (terms > 0).sum(0)
    weights = np.log((1 + len(terms)) / (1 + there)) + 0.3
    _, _, axes = np.linalg.svd(terms * weights, full_matrices=False)
    space = Space(
        weights.astype(np.float32), axes[:width].T.astype(np.float32), np.empty(0), labels,
        np.ones(len(labels)), neighbours, sharpness,
    )
    space.vectors = space.project(terms.astype(np.float32))
    for value, total in sizes.items():
        chosen = labels == value
        space.worth[chosen] = total / max(1, chosen.sum())
    return space


def score_quality(
    documents: DataFrame,
    labels: DataFrame,
    train: Column,
    label: str = "quality",
    text: str = "text",
    out: str = "score",
    per_class: int = 1500,
    width: int = 64,
    neighbours: int = 15,
    sharpness: float = 12.0,
) -> DataFrame:
    """Append ``out`` (0 to 1, higher: label 1 likelier) to every row of ``documents``.

    Only rows of ``labels`` with ``train`` (a condition on ``doc_id``) are learned from: at most
    ``per_class`` per class, chosen by hash, their latent vectors of ``width`` numbers broadcast.
    Neighbours as close as the last of the ``neighbours`` nearest vote too. An id with several texts
    is learned from with the least of them, an id labelled twice with the greater label. Null and empty texts are scored by their shape alone; rows stay one to one,
    repeated or not; an empty table stays empty.
    Without a usable label every score is 0.5; with one class, that class. A column named as
    ``out`` is replaced.
    """
    chosen, sizes = labelled_sample(labels, label, train, {0: per_class, 1: per_class})

    def describe():
        return lambda texts: [
            pa.array([terms_of(t).tobytes() for t in texts_of(texts)], pa.binary())
        ]

    sample = (
        documents.select("doc_id", text)
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id").agg(F.max("label").alias("label"), F.min(text).alias(text))
    )
    rows = (
        with_columns(sample, [text], [StructField("terms", BinaryType())], describe)
        .select("doc_id", "label", "terms")
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    space = None
    if rows:
        terms = np.stack([np.frombuffer(r["terms"], np.float32) for r in rows])
        space = fit(terms, np.array([r["label"] for r in rows]), sizes, width, neighbours, sharpness)
    shared = documents.sparkSession.sparkContext.broadcast(space)

    def start():
        model = shared.value

        def work(texts):
            whole = texts_of(texts)
            if model is None:
                return [pa.array([0.5] * len(whole), pa.float64())]
            scores = [
                model.score(np.stack([terms_of(t) for t in whole[at : at + BLOCK]]))
                for at in range(0, len(whole), BLOCK)
            ]
            return [pa.array(np.concatenate(scores) if scores else [], pa.float64())]

        return work

    return with_columns(documents, [text], [StructField(out, DoubleType())], start)
