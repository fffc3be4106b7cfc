"""Periodic runs of words, found by repeated k-gram masking and Main-Lorentz.

A run is a stretch of words with smallest period q, at least max(least, times * q) words long, that no neighbouring word
extends with this period. Two of its parts, q words apart, overlap in all but q words; the least such overlap over all
periods is k. So each word of a run lies in a k-gram that occurs twice in its document. Tasks hash the k-grams of a
batch, and words outside repeated ones part the texts into segments; in ordinary texts little is left. Only in these
segments does Main-Lorentz look for runs: a segment is halved again and again, and the runs across each middle come from
prefix and suffix matches of the halves, in n log n steps. Segments are compared by their words; hashes only mask.

Each text is read by itself, so nothing is shuffled and no key can be hot.

Defined results: words are separated by ASCII white space and compared as they are; null, empty and blank texts have
no words, no run and an empty collapsed text; repeated rows each give their row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import U, WHOLE_BYTE, column, hash_runs, hash_words, mix, pieces, text_bytes, word_bounds

LEAST, TIMES = 6, 4
WORDS = r"[^\x20\x09-\x0D]+"


def gram_size(least: int, times: int) -> int:
    """The least overlap of a run with itself, one period on."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def masked_segments(hashed: np.ndarray, first: np.ndarray, k: int, least: int) -> list[tuple[int, int, int]]:
    """hashed: word hashes of all texts of a batch; first: where each text's words begin, and the end of all.

    (text, from, to) of each stretch of at least `least` words in k-grams that their text has twice, in order.
    """
    n = len(hashed)
    grams = hash_runs(hashed, k)
    if not len(grams):
        return []
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(owner[: n - k + 1] == owner[k - 1 :])  # no gram runs from one text into the next
    keys = mix(grams[at] + owner[at].astype(np.uint64) * U(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + k, -1)
    inside = np.cumsum(cover)[:n] > 0
    edge = np.ones(n + 1, bool)
    edge[1:n] = (inside[1:] != inside[:-1]) | (owner[1:] != owner[:-1])
    cuts = np.flatnonzero(edge)
    lo, hi = cuts[:-1], cuts[1:]
    keep = inside[lo] & (hi - lo >= least)
    return list(zip(owner[lo[keep]].tolist(), lo[keep].tolist(), hi[keep].tolist()))


def prefix_matches(s: list[int], most: int) -> list[int]:
    """z[i] for i up to most: how many elements of s from i on equal those from 0 on."""
    n, z, lo, hi = len(s), [0] * (most + 1), 0, 0
    for i in range(1, most + 1):
        m = min(hi - i, z[i - lo]) if i < hi else 0
        if i + m >= hi:
            while i + m < n and s[m] == s[i + m]:
                m += 1
            lo, hi = i, i + m
        z[i] = m
    return z


def runs_of(s: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of a sequence of integers from 0 on, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    stack = [(0, len(s))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < least:
            continue
        mid, most = (lo + hi) // 2, (hi - lo) // times
        stack += [(lo, mid), (mid, hi)]
        left, right = s[lo:mid][::-1], s[mid:hi]
        most = min(most, mid - lo)
        z_left = prefix_matches(left + [-1], most)
        z_right = prefix_matches(right + [-2], most)
        # how far s before mid equals s before mid + q, and s from mid on equals s from mid - q on, for up to q elements
        back = prefix_matches(left[:most] + [-1] + right[:most][::-1], 2 * most)
        on = prefix_matches(right[:most] + [-1] + left[:most][::-1], 2 * most)
        for q in range(1, most + 1):
            before, after = back[2 * most + 1 - q], on[2 * most + 1 - q]
            if before >= q:
                start, end = mid - q - z_left[q], mid + q + z_right[q]
                wide = [(start, end)]
            else:
                wide = [(mid - before, mid + q + z_right[q]), (mid - q - z_left[q], mid + after)]
            for start, end in wide:
                if end - start < max(least, times * q):
                    continue
                # cut off by lo or hi: a wider part of the sequence has the whole run
                if (start == lo > 0 and s[lo - 1] == s[lo - 1 + q]) or (end == hi < len(s) and s[hi] == s[hi - q]):
                    continue
                # multiples of a period have the same ends
                found[start, end] = min(q, found.get((start, end), q))
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """words without those that a run contains after its first period, joined by one space."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone)[: len(words)] == 0
    return b" ".join(w for w, k in zip(words, keep.tolist()) if k)


def find_runs(docs: DataFrame, keep: str = "doc_id", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """keep, n_words, runs (start, length, period; by start, then period) and collapsed, a row per row of docs.

    collapsed: the words, without those that a run has after its first period, joined by one space. times: 2 or more.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")
    k = gram_size(least, times)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    rows = docs.select(F.col(keep), "text")

    def find(batches):
        for part in pieces(batches):
            data, at = text_bytes(column(part, "text"))
            starts, ends, first = word_bounds(data, at)
            segments: dict[int, list[tuple[int, int]]] = {}
            for row, lo, hi in masked_segments(hash_words(data, starts, ends, WHOLE_BYTE), first, k, least):
                segments.setdefault(row, []).append((lo - int(first[row]), hi - int(first[row])))
            runs, texts = [], []
            for row in range(len(part)):
                words = data[at[row] : at[row + 1]].tobytes().split()
                mine = []
                for lo, hi in segments.get(row, ()):
                    names: dict[bytes, int] = {}
                    mine += [(lo + a, n, q) for a, n, q in runs_of([names.setdefault(w, len(names)) for w in words[lo:hi]], least, times)]
                runs.append([{"start": a, "length": n, "period": q} for a, n, q in mine])
                texts.append((collapsed(words, mine) if mine else b" ".join(words)).decode())
            counts = pa.array(np.diff(first).astype(np.int64))
            yield pa.RecordBatch.from_arrays([column(part, keep), counts, pa.array(runs, run_type), pa.array(texts, pa.string())], [keep, "n_words", "runs", "collapsed"])

    kind = rows.schema[keep].dataType.simpleString()
    return rows.mapInArrow(find, f"`{keep}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: where 10 divides h, the unsigned crc32 of the decimal doc_id, words from a place on repeat with a period.

    With g = h div 10 and n words, word i from a = g mod n on is word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORDS), 0)
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w")
    g = F.expr("h div 10")
    placed = chosen.select("*", F.when(n > 0, (g % n).cast("int")).alias("a"), (3 + g % 8).cast("int").alias("e"))
    placed = placed.select("doc_id", "text", "w", "a", F.expr("cast(1 + (size(w) - a) div e as int)").alias("p"))

    def repeated(word: Column, i: Column) -> Column:
        return F.when(i < F.col("a"), word).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p")))

    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.transform("w", repeated), " ")).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256 of every document.

    Of equally long runs the one with the smallest start counts, then that with the smallest period.
    """
    found = find_runs(docs)
    ranked = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), F.get(ranked, F.lit(0)).alias("best"), F.sha2(lines, 256).alias("runs_sha256"))
    length = -F.col("best.l")
    return out.select(
        "doc_id",
        "n_runs",
        F.col("best.s").alias("start"),
        length.alias("length"),
        F.col("best.q").alias("period"),
        F.expr("1000 * -best.l div best.q").alias("exponent_milli"),
        "runs_sha256",
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
