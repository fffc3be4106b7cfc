"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams of lower-cased text, with document frequencies over all
learning rows. The weights are trained by follow-the-regularised-leader with an elastic-net penalty on a bounded
sample of labelled rows: the L1 part leaves most weights zero. A fifth of the sample is kept apart to find the
temperature that calibrates the probabilities.

Defined results: null texts and texts without a letter are `und` with score 0; null labels and
null ids are not learned from, blank labels are labels like others; without any label everything is `und`; repeated rows are predicted alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import ROWS, bounded_sample, document_frequencies, idf_of, ngram_counts, tfidf
from .hashing import column, pieces
from .quality import held_out

BITS = 14
#: The bound on the labelled rows that the classifier is fitted on.
SAMPLE = 6000
#: So many labelled rows of each language are drawn besides, if it has them.
EACH = 100
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01


def counts_of(texts: list[str | None]) -> np.ndarray:
    return ngram_counts([(t or "").lower() for t in texts], BITS)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, kinds: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (features x kinds) by FTRL-proximal over sparse rows (indices, values); the last feature is the bias."""
    width = (1 << BITS) + 1
    z, n = np.zeros((width, kinds)), np.zeros((width, kinds))

    def weights(at):
        zi, ni = z[at], n[at]
        return np.where(np.abs(zi) <= L1, 0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    order = np.random.default_rng(3)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, width - 1), np.append(x, 1.0)
            w = weights(at)
            p = softmax((x @ w)[None])[0]
            p[labels[i]] -= 1
            g = x[:, None] * p
            g2 = g * g
            z[at] += g - (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g2
    return weights(np.arange(width)).astype(np.float32)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits that makes the labels likeliest, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean()
    lo, hi, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(docs: DataFrame, label: str = "lang") -> tuple:
    """docs: doc_id, text, label, the rows to learn from -> languages, idf, weights, temperature."""
    idf = idf_of(document_frequencies(docs, 1 << BITS, counts_of))
    labelled = docs.select("doc_id", "text", F.col(label).alias("label")).where("doc_id is not null and label is not null")

    def sparse(batches):
        for part in pieces(batches, most=1 << 18, rows=ROWS):
            counts = counts_of(column(part, "text").to_pylist())
            x = tfidf(counts, idf)
            at = [np.flatnonzero(c).astype(np.int32) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), column(part, "label"), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([r[a].astype(np.float32).tobytes() for r, a in zip(x, at)], pa.binary())],
                ["doc_id", "label", "at", "x"],
            )

    found = bounded_sample(labelled, "label", SAMPLE, EACH).mapInArrow(sparse, "doc_id long, label string, at binary, x binary").toArrow().to_pylist()
    found.sort(key=lambda r: (r["doc_id"], r["label"], r["at"]))
    kinds = sorted({r["label"] for r in found})
    if not kinds:
        return [], idf, None, 1.0
    rows = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32).astype(np.float64)) for r in found]
    labels = np.array([kinds.index(r["label"]) for r in found])
    apart = np.arange(len(rows)) % 5 == 4
    learn = np.flatnonzero(~apart)
    w = follow_the_leader([rows[i] for i in learn], labels[learn], len(kinds))
    logits = np.array([x @ w[at] + w[-1] for (at, x), a in zip(rows, apart) if a]).reshape(-1, len(kinds))
    return kinds, idf, w, temperature(logits, labels[apart])


def predict(docs: DataFrame, model: tuple) -> DataFrame:
    """docs: doc_id, text -> doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        kinds, idf, w, heat = shared.value
        for part in pieces(batches, most=1 << 18, rows=ROWS):
            texts = column(part, "text").to_pylist()
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            if kinds:
                p = softmax((tfidf(counts_of(texts), idf) @ w[:-1] + w[-1]).astype(np.float64) / heat)
                best = p.argmax(axis=1)
                for i, t in enumerate(texts):
                    if t and any(map(str.isalpha, t)):
                        names[i], scores[i] = kinds[best[i]], p[i, best[i]]
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; learns from the other folds' lang."""
    away = held_out(F.col("doc_id"), folds, fold)
    model = fit(docs.where(~away).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", away.alias("held_out"), "lang_pred", "score")
