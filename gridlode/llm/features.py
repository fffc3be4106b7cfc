"""Hashed character n-gram counts, document frequencies and bounded training samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, small
from .hashing import column, pieces

ORDERS = (1, 2, 3)
ROWS = 64
_SALT = np.random.default_rng(7).integers(1, 2**31, 8, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, end to end, and the row of each."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return chars, np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])


def ngram_counts(texts: list[str | None], bits: int, orders=ORDERS) -> np.ndarray:
    """Counts of the hashed character n-grams of whole texts: a row per text, 2**bits columns."""
    texts = [t or "" for t in texts]
    return hashed_counts(*code_points(texts), len(texts), bits, orders)


def hashed_counts(chars: np.ndarray, row: np.ndarray, rows: int, bits: int, orders=ORDERS) -> np.ndarray:
    """Counts of the hashed n-grams of integers that belong to rows."""
    out = np.zeros(rows << bits, np.int64)
    for n in orders:
        if len(chars) < n:
            continue
        m = len(chars) - n + 1
        h = chars[:m] * _SALT[0]
        for k in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * _SALT[6] + chars[k : k + m] * _SALT[k]
        h = (h ^ (h >> np.uint32(13))) * _SALT[7]
        place = (h >> np.uint32(32 - bits)).astype(np.int64)
        place += row[:m] << bits
        if n > 1:  # no n-gram runs from one text into the next
            place = place[row[:m] == row[n - 1 :]]
        out += np.bincount(place, minlength=len(out))
    return out.reshape(rows, 1 << bits)


def document_frequencies(docs: DataFrame, width: int, counts) -> np.ndarray:
    """Number of documents that have each of `width` features, then their number, over all rows of docs (text).

    counts: from texts to a matrix. Each task sums its own rows; at most `width` sums leave it.
    """

    def run(batches):
        total, n = np.zeros(width, np.int64), 0
        for part in pieces(batches, most=1 << 18, rows=ROWS):
            total += (counts(column(part, "text").to_pylist()) > 0).sum(axis=0)
            n += len(part)
        if n:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["feature", "n"])

    found = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(width + 1, np.int64)
    for r in found:
        out[r["feature"]] = r["n"]
    return out


def idf_of(frequencies: np.ndarray) -> np.ndarray:
    """Smoothed inverse document frequencies."""
    return np.log((1 + frequencies[-1]) / (1 + frequencies[:-1])).astype(np.float32) + 1


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length (or zero) of dampened counts times idf."""
    x = np.log1p(counts, dtype=np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def bounded_sample(rows: DataFrame, label: str, most: int, each: int = 0) -> DataFrame:
    """At most `most` of the (doc_id, label) of rows, by a hash of doc_id: the same ones at each run; one row (doc_id, text, label) of each.

    each: besides, up to so many of every label, by the same hash, so that no rare label is missing. Of repeated rows
    the least text counts. The ids are drawn first, without their texts; a hash threshold near the wanted share keeps
    what is ordered small.
    """
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))

    def least(wanted, total):
        return (F.least(F.lit(1.0), (1.3 * wanted + 200) / F.greatest(total, F.lit(1))) * (1 << 30)).cast("long") + 1

    ids = rows.select("doc_id", label, drawn.alias("_d"))
    distinct = F.approx_count_distinct(F.xxhash64("doc_id", label), 0.02)  # the threshold leaves 30 % of room
    picked = ids.where(F.col("_d") < least(most, F.lit(ids.agg(distinct).head()[0]))).distinct().orderBy("_d", "doc_id", label).limit(most)
    if each:
        sizes = checkpoint(ids.groupBy(label).agg(distinct.alias("_n")))
        near = ids.join(small(sizes), label).where(F.col("_d") < least(each, F.col("_n"))).select(*ids.columns).distinct()
        first = near.withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy("_d", "doc_id"))).where(F.col("_k") <= each)
        picked = picked.unionByName(first.drop("_k")).distinct()
    picked = checkpoint(picked.drop("_d"))
    found = rows.join(small(picked), ["doc_id", label], "left_semi")
    return found.groupBy("doc_id", label).agg(F.min("text").alias("text")).select("doc_id", "text", label)
