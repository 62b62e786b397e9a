"""Quality by nearest-neighbour voting in a latent-semantic space.

Words and word shapes of labelled texts give a tf-idf matrix, whose leading
singular directions span the latent space. The labelled vectors are broadcast;
each document's vector meets all of them in blocked matrix products (exact
cosines), and its nearest neighbours vote with their similarity as weight.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .labels import id_remainder, labelled_sample

BLOCK = 512
RUN = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, other marks as they are; runs shortened to one."""
    return RUN.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))


REPEATS = tuple(f"r:{i}" for i in range(8))


def counts(text: str) -> tuple[Counter, int]:
    """Words of a text, and in tenths the share that repeats the word before."""
    words = text.split()
    return Counter(words), 10 * sum(map(operator.eq, words, words[1:])) // max(1, len(words))


def word_terms(word: str) -> tuple[str, ...]:
    """The word and its shape; a long shape in pieces of 64 marks, which all count."""
    form = shape(word)
    return *("s:" + form[i : i + 64] for i in range(0, len(form), 64)), "w:" + word.lower()


@dataclass
class NeighbourModel:
    """Latent space (``terms`` to rows of ``directions``, which hold the idf) and
    the labelled unit vectors with their labels and vote weights."""

    terms: dict[str, int]
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    neighbours: int
    prior: float


class Embedder:
    """Unit latent vectors of texts; remembers the terms of words it has seen."""

    MOST = 150_000

    def __init__(self, terms: dict[str, int], directions: np.ndarray):
        self.terms, self.directions, self.words = terms, directions, {}

    def rows(self, word: str) -> tuple[int, ...]:
        got = self.words.get(word)
        if got is None:
            got = tuple(self.terms[t] for t in word_terms(word) if t in self.terms)
            if len(self.words) >= self.MOST:
                self.words.clear()
            if len(word) <= 64:
                self.words[word] = got
        return got

    def term_counts(self, text: str) -> dict[int, int]:
        found: dict[int, int] = {}
        words, twice = counts(text)
        for w, n in words.items():
            for i in self.rows(w):
                found[i] = found.get(i, 0) + n
        for t in REPEATS[:twice]:  # one term for each tenth that is reached
            if t in self.terms:
                found[self.terms[t]] = 10
        return found

    def vectors(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.directions.shape[1]), np.float32)
        for i, t in enumerate(texts):
            if found := self.term_counts(t):
                tf = np.log1p(np.fromiter(found.values(), np.float32, len(found)))
                v = tf @ self.directions[np.fromiter(found, np.int64, len(found))]
                out[i] = v / (np.linalg.norm(v) or 1.0)
        return out


def fit(texts: Sequence[str], labels: Sequence[int], class_weight: dict[int, float], *, most_terms: int = 6_000, least_docs: int = 4, dimensions: int = 64, neighbours: int = 15, seed: int = 17) -> NeighbourModel:
    """Fit the space to the sample by a randomized singular value decomposition.
    Terms are the ``most_terms`` that occur in most texts, in ``least_docs`` at least."""
    seen: Counter = Counter()
    parsed = [counts(t) for t in texts]
    for words, twice in parsed:
        seen.update({t for w in words for t in word_terms(w)})
        seen.update(REPEATS[:twice])
    known = sorted((t for t, n in seen.items() if n >= min(least_docs, max(1, len(texts) // 4))), key=lambda t: (-seen[t], t))[:most_terms]
    terms = {t: i for i, t in enumerate(known)}
    idf = np.array([math.log((1 + len(texts)) / (1 + seen[t])) + 0.3 for t in known], np.float32)
    plain = Embedder(terms, np.zeros((len(terms), 1), np.float32))
    x = np.zeros((len(texts), len(terms)), np.float32)
    for d, t in enumerate(texts):
        for i, n in plain.term_counts(t).items():
            x[d, i] = math.log1p(n) * idf[i]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    k = min(dimensions, *x.shape)
    y = x @ np.random.default_rng(seed).standard_normal((x.shape[1], min(k + 16, *x.shape))).astype(np.float32)
    for _ in range(3):
        y = x @ (x.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    _, _, right = np.linalg.svd(q.T @ x, full_matrices=False)
    directions = (right[:k].T * idf[:, None]).astype(np.float32)
    vectors = Embedder(terms, directions).vectors(texts)
    y1 = np.array(labels, np.float32)
    weights = np.array([class_weight.get(v, 1.0) for v in labels], np.float32)
    return NeighbourModel(terms, directions, vectors, y1, weights, min(neighbours, len(texts)), float((weights * y1).sum() / weights.sum()))


def vote(model: NeighbourModel, embedder: Embedder, texts: Sequence[str]) -> np.ndarray:
    """Scores of a block of texts. Texts without a known term get the prior."""
    vectors = embedder.vectors(texts)
    cosine = vectors @ model.vectors.T
    near = np.argpartition(-cosine, model.neighbours - 1, axis=1)[:, : model.neighbours]
    # similarity to a power, so that the closest count most; a trace of the prior decides ties
    power = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** 8 * model.weights[near]
    empty = ~vectors.any(axis=1)
    score = ((power * model.labels[near]).sum(1) + 1e-6 * model.prior) / (power.sum(1) + 1e-6)
    return np.clip(np.where(empty, model.prior, score), 0, 1).astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, *, learn: Column, most_per_class: int = 2_000, most_chars: int = 20_000, text_col: str = "text", id_col: str = "doc_id") -> NeighbourModel | None:
    """A model from up to ``most_per_class`` labelled texts of each class, of up
    to ``most_chars`` characters; None if there is no label."""
    sample, sizes = labelled_sample(docs, labels, "quality", learn=learn, most_per_class=most_per_class, most_chars=most_chars, text_col=text_col, id_col=id_col)
    if not sample:
        return None
    drawn = Counter(y for _, y in sample)
    return fit([t for t, _ in sample], [y for _, y in sample], {y: sizes[y] / drawn[y] for y in drawn})


def scorer(spark: SparkSession, model: NeighbourModel | None):
    """A column function from text to a score between 0 and 1; null and empty
    texts get the share of good labels, everything 1/2 without a model. At most
    2 x ``most_per_class`` labelled vectors are broadcast, about 3 MB with the space."""
    if model is None:
        return lambda text: F.lit(0.5)
    shared = spark.sparkContext.broadcast(model)
    held: list[Embedder] = []

    def score(texts: pa.Array) -> pa.Array:
        m = shared.value
        if not held:
            held.append(Embedder(m.terms, m.directions))
        out = [vote(m, held[0], [t or "" for t in texts.slice(i, BLOCK).to_pylist()]) for i in range(0, len(texts), BLOCK)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return F.arrow_udf(score, "double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: quality of every document; learns where the remainder is not 1."""
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    model = train(docs, labels, learn=id_remainder(labels["doc_id"], 3) != 1)
    scored = docs.select("doc_id", scorer(spark, model)(F.col("text")).alias("score"))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
