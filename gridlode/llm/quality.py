"""Quality by nearest-neighbour voting in a latent-semantic space.

Features are TF-IDF weights of hashed character n-grams and of n-grams of character shapes (runs of lower case,
upper case, digits, spaces, each mark for itself), with document frequencies over all learning rows, and the
share of words that repeat the word before. Each kind has unit length, so that all weigh alike. A bounded sample of labelled rows spans the latent space (a truncated SVD by subspace iteration) and gives the
labelled vectors, which are broadcast: SAMPLE x LATENT numbers at most, whatever the input. Every document is
projected, its cosines with all labelled vectors are computed exactly in blocks, and its nearest neighbours
vote with weights that grow with their similarity.

Defined results: null and empty texts have no features and get the share of label 1 in the sample; labels other
than 0 and 1 and null labels or ids are not learned from; repeated rows are scored alike; without any label
every score is 0.5; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, without
from .features import ROWS, bounded_sample, code_points, document_frequencies, hashed_counts, idf_of, tfidf
from .hashing import column, pieces

BITS, SHAPE_BITS = 12, 10
CHARS, SHAPES, WIDTH = 1 << BITS, 1 << SHAPE_BITS, (1 << BITS) + (1 << SHAPE_BITS) + 2
_SHAPE = np.arange(128, dtype=np.uint32)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58] = 97, 65, 48
#: The bound on the labelled rows that the classifier is fitted on.
SAMPLE = 4096
LATENT = 48
NEIGHBOURS = 15
POWER = 4
CUT = 0.3


def counts_of(texts: list[str | None]) -> np.ndarray:
    """Counts of n-grams and of shapes, then of words that repeat the one before and of other words."""
    texts = [t or "" for t in texts]
    chars, row = code_points(texts)
    shape = np.where(chars < 128, _SHAPE[np.minimum(chars, 127)], 97).astype(np.uint32)
    edge = np.ones(len(shape), bool)
    edge[1:] = (shape[1:] != shape[:-1]) | (row[1:] != row[:-1])
    words = [t.split() for t in texts]
    same = np.array([sum(map(eq, w, w[1:])) for w in words], np.int64)
    other = np.array([len(w) for w in words], np.int64) - same
    parts = [hashed_counts(chars, row, len(texts), BITS), hashed_counts(shape[edge], row[edge], len(texts), SHAPE_BITS, (1, 2, 3, 4))]
    return np.hstack([*parts, same[:, None], other[:, None]])


def features_of(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of each kind, side by side."""
    own = slice(CHARS, CHARS + SHAPES)
    repeats = np.sqrt(counts[:, -2:] / np.maximum(counts[:, -2:].sum(axis=1, keepdims=True), 1)).astype(np.float32)
    return np.hstack([tfidf(counts[:, :CHARS], idf[:CHARS]), tfidf(counts[:, own], idf[own]), repeats])


class SparseRows:
    """The non-zero numbers of a matrix, row by row; it is made dense a block of rows at a time."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.rows, self.width = rows, width

    @classmethod
    def of(cls, x: np.ndarray) -> SparseRows:
        return cls([(at, row[at]) for row in x for at in [np.flatnonzero(row)]], x.shape[1])

    def blocks(self, size: int = 256):
        for lo in range(0, len(self.rows), size):
            part = self.rows[lo : lo + size]
            out = np.zeros((len(part), self.width), np.float32)
            for dense, (at, x) in zip(out, part):
                dense[at] = x
            yield out

    def times(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([b @ q for b in self.blocks()])


def latent_space(x: SparseRows, rank: int, rounds: int = 6) -> np.ndarray:
    """Leading right singular vectors of x, as columns."""
    rank = min(rank, len(x.rows), x.width)
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((x.width, rank)).astype(np.float32))[0]
    for _ in range(rounds):
        product = np.zeros(q.shape, np.float32)
        for b in x.blocks():
            product += b.T @ (b @ q)
        q = np.linalg.qr(product)[0]
    return q


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


class Voter:
    """A fitted model: small arrays only."""

    def __init__(self, idf, space, vectors, labels):
        self.idf, self.space, self.vectors, self.labels = idf, space, vectors, labels

    @classmethod
    def fit(cls, x: SparseRows, labels: np.ndarray, idf: np.ndarray) -> Voter:
        space = latent_space(x, LATENT)
        return cls(idf, space, _unit(x.times(space)), labels.astype(np.float32))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        z = _unit(features_of(counts_of(texts), self.idf) @ self.space)
        near = z @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** POWER
        total = weight.sum(axis=1)
        voted = (weight * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.where(total > 1e-9, np.clip(voted, 0, 1), float(self.labels.mean()))


def held_out(doc_id, folds: int, fold: int):
    """Whether crc32 of the id as text has that remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit(docs: DataFrame, labels: DataFrame) -> Voter:
    """docs: doc_id, text, the rows to learn from; labels: doc_id, label."""
    labels = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    labelled = docs.where("doc_id is not null").select("doc_id", "text").join(labels, "doc_id")
    idf = idf_of(document_frequencies(docs, WIDTH, counts_of))
    sample = bounded_sample(labelled, "label", SAMPLE)

    def weighed(batches):
        for part in pieces(batches, most=1 << 18, rows=ROWS):
            sparse = SparseRows.of(features_of(counts_of(column(part, "text").to_pylist()), idf)).rows
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), column(part, "label").cast(pa.int32()), pa.array([at.astype(np.int16).tobytes() for at, _ in sparse], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in sparse], pa.binary())],
                ["doc_id", "label", "at", "x"],
            )

    found = sample.mapInArrow(weighed, "doc_id long, label int, at binary, x binary").toArrow()
    if not len(found):
        return Voter(idf, None, None, np.zeros(0, np.float32))
    ids, label = (found.column(c).to_numpy() for c in ("doc_id", "label"))
    order = np.lexsort((label, ids))
    numbers = lambda c, i, kind: np.frombuffer(found.column(c)[i].as_buffer(), kind)
    rows = [(numbers("at", i, np.int16), numbers("x", i, np.float32)) for i in order]
    return Voter.fit(SparseRows(rows, WIDTH), label[order], idf)


def score(docs: DataFrame, model: Voter, keep: list[str]) -> DataFrame:
    """docs' columns `keep` and score, for whole texts (column text)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.space, model.vectors, model.labels))
    docs = docs.select(*keep, "text")

    def run(batches):
        voter = Voter(*shared.value)
        for part in pieces(batches, most=1 << 18, rows=4 * ROWS):
            texts = column(part, "text").to_pylist()
            found = np.concatenate([voter.score(texts[i : i + ROWS]) for i in range(0, len(texts), ROWS)])
            yield pa.RecordBatch.from_arrays([*(column(part, c) for c in keep), pa.array(found, pa.float64())], [*keep, "score"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", score double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. labels: doc_id, label."""
    docs = docs.select("doc_id", "text")
    model = fit(docs.where(~held_out(F.col("doc_id"), folds, fold)), labels)
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects; the scores of other rows are never written."""
    model = fit(docs.select("doc_id", "text"), labels)
    return without(docs, lambda rows: score(rows, model, ["_rid"]).where(F.col("score") < CUT))
