"""Toxicity by multiple-instance learning.

A document is a bag of sentences and is toxic if one of them is. Each sentence
has a probability from its words; the fit takes the document's as their noisy-or,
scores take that of the offending sentences only, which a text's length doesn't
raise. Only documents carry labels, so the gradient of the document's likelihood tells the
sentences apart, and the fitted model then locates the offending ones.
"""

from __future__ import annotations

import math
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

SENTENCE = re.compile(r"[^\n.!?]+[.!?]*")
MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())
PREFIXES = (4, 5, 6, 7)


def word_features(word: str) -> list[str]:
    """The bare word and its beginnings (stems carry meaning across endings)."""
    word = word.strip(MARKS).lower()
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)] if word else []


@dataclass
class SentenceModel:
    """Log-odds of a sentence: ``bias`` and the weights of its words' features."""

    bias: float
    weights: dict[str, float]

    def words(self) -> WordWeights:
        return WordWeights(self.weights)


class WordWeights(dict):
    """Weight of a word as written; remembers words it has seen."""

    MOST = 150_000

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        w = sum(self.weights.get(f, 0.0) for f in word_features(word))
        if len(self) >= self.MOST:
            self.clear()
        if len(word) <= 64:
            self[word] = w
        return w


def softplus(x: float) -> float:
    return x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))


def surprise(a: np.ndarray, n: np.ndarray, q: float) -> np.ndarray:
    """How unlikely (Chernoff, in nats) ``a`` of ``n`` hits are where the share is ``q``."""
    p = np.clip(a / n, 1e-12, 1 - 1e-12)
    return np.where(p > q, n * (p * np.log(p / q) + (1 - p) * np.log((1 - p) / (1 - q))), 0.0)


def fit(texts: Sequence[str], labels: Sequence[int], class_weight: dict[int, float], *, most_features: int = 20_000, least_surprise: float = 10.0, steps: int = 400, rate: float = 0.1, l2: float = 3e-6, first_bias: float = -7.0) -> SentenceModel:
    """Fit by Adam on the likelihood of the documents' labels. Features are those
    that occur in sentences of toxic documents more often than chance allows;
    a sentence that recurs (copies, shared passages) counts once for that."""
    bags = list(dict.fromkeys(zip(texts, labels, strict=True)))
    sentences: tuple[set[str], set[str]] = (set(), set())
    for t, y in bags:
        sentences[y].update(x.strip() for x in SENTENCE.findall(t))
    seen = (Counter(), Counter())
    for y in (0, 1):
        for s in sentences[y]:
            seen[y].update({f for w in set(s.split()) for f in word_features(w)})
    share = len(sentences[1]) / max(1, len(sentences[0]) + len(sentences[1]))
    names = [f for f, n in seen[1].items() if n >= 3]
    index: dict[str, int] = {}
    if names and 0 < share < 1:
        a = np.array([seen[1][f] for f in names], float)
        odd = surprise(a, a + np.array([seen[0][f] for f in names], float), share)
        ranked = sorted((-x, f) for x, f in zip(odd, names, strict=True) if x >= least_surprise)[:most_features]
        index = {f: i for i, (_, f) in enumerate(ranked)}
    rows, cols, doc, plain, n = [], [], [], np.zeros(len(bags)), 0
    for d, (t, _) in enumerate(bags):
        for s in SENTENCE.findall(t):
            found = [index[f] for w in set(s.split()) for f in word_features(w) if f in index]
            if found:
                rows.extend([n] * len(found))
                cols.extend(found)
                doc.append(d)
                n += 1
            else:
                plain[d] += bool(s.strip())
    rows, cols, doc = np.array(rows, np.int64), np.array(cols, np.int64), np.array(doc, np.int64)
    y = np.array([v for _, v in bags], float)
    weight = np.array([class_weight.get(v, 1.0) for _, v in bags], float)
    weight /= weight.sum() or 1.0
    theta = np.zeros(len(index) + 1)
    theta[-1] = first_bias
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        b = theta[-1]
        x = b + np.bincount(rows, theta[cols], n)
        total = np.bincount(doc, np.logaddexp(0, x), len(bags)) + plain * np.logaddexp(0, b)
        # d loss / d total: 1 for clean documents, -1 / (e^total - 1) for toxic ones
        slope = weight * np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-6, 50)), 1.0)
        gx = slope[doc] / (1 + np.exp(-x))
        g = l2 * theta
        g[:-1] += np.bincount(cols, gx[rows], len(index))
        g[-1] = gx.sum() + (slope * plain).sum() / (1 + math.exp(-b))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return SentenceModel(float(theta[-1]), {f: float(theta[i]) for f, i in index.items() if abs(theta[i]) > 1e-3})


def document_score(text: str, weight: WordWeights, bias: float, spans: bool = True) -> tuple[float, list[tuple[int, int, float]]]:
    """The noisy-or of the sentences at 1/2 or more, and (begin, end, probability)
    of each; without such, the greatest probability of a sentence. A sentence
    without known features has 0. So harmless sentences don't add up, however many."""
    total, most, found, get = 0.0, -math.inf, [], weight.__getitem__
    for m in SENTENCE.finditer(text):
        x = sum(map(get, set(m.group().split())))
        if not x:
            continue
        x += bias
        most = max(most, x)
        if x >= 0:
            total += softplus(x)
            if spans:
                found.append((m.start(), m.end(), 1 / (1 + math.exp(-min(x, 700.0)))))
    return -math.expm1(-total) if total else 1 / (1 + math.exp(min(-most, 700.0))) if most > -math.inf else 0.0, found


def train(docs: DataFrame, labels: DataFrame, *, learn: Column, most_per_class: int = 3_000, most_chars: int = 20_000, text_col: str = "text", id_col: str = "doc_id") -> SentenceModel:
    """A model from a bounded sample: up to ``most_per_class`` documents of each
    class, of up to ``most_chars`` characters. Without labels every score is 0."""
    sample, sizes = labelled_sample(docs, labels, "toxic", learn=learn, most_per_class=most_per_class, most_chars=most_chars, text_col=text_col, id_col=id_col)
    if not sample:
        return SentenceModel(-50.0, {})
    drawn = Counter(y for _, y in sample)
    return fit([t for t, _ in sample], [y for _, y in sample], {y: sizes[y] / drawn[y] for y in drawn})


SCORED = "struct<score double, sentences array<struct<begin int, end int, score double>>>"


def scorer(model: SentenceModel):
    """A column function from text to ``score`` (0 to 1) and ``sentences``, the
    spans (code points) that offend. Null and empty texts score 0."""
    out = pa.struct([("score", pa.float64()), ("sentences", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])
    bias, weights = model.bias, model.weights
    held: list[WordWeights] = []

    def score(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(WordWeights(weights))
        rows = (document_score(t.as_py() or "", held[0], bias) for t in texts)
        return pa.array([{"score": s, "sentences": [{"begin": a, "end": b, "score": p} for a, b, p in spans]} for s, spans in rows], type=out)

    return F.arrow_udf(score, SCORED)


def reject_toxic(docs: DataFrame, model: SentenceModel, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose score is below ``threshold``; columns as they are,
    repeated rows and null ids included."""
    rows = C.packed(docs, _text=docs[text_col])
    return rows.where(scorer(model)("_text")["score"] < threshold).select(f"{C.ROW}.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: toxicity of every document; learns where the remainder is not 0."""
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    model = train(docs, labels, learn=id_remainder(labels["doc_id"], 5) != 0)
    scored = docs.select("doc_id", scorer(model)("text").alias("s"))
    score = F.least(F.greatest(F.col("s.score"), F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("s.sentences").alias("sentences"))
