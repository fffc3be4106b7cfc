"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and every run of characters other than letters and digits becomes one space. An item of m
characters may differ in up to RATE * m edits (k). It is split into k + 1 pieces: wherever it occurs with at most k
edits, at least one piece occurs unchanged. An automaton over all pieces finds their exact hits in one pass over
each whole text; around each hit Myers' bit-parallel algorithm computes the least edit distance between the item
and any passage there.

Items are broadcast in slices of at most SLICE_BYTES, each with a pass of its own over the documents; as many
slices are taken as the table needs, and the least distance over all of them counts.

Items too short for a budget (RATE * m under 1) must occur unchanged, as whole words (next to a character of a script
that is written without spaces any place will do): as a part of words they would be found everywhere.

Defined results: null and empty texts have no hits; items without a letter or digit match nothing; items with null ids are kept as such; of repeated items with one id, the least
distance counts; repeated documents each give their rows; an empty table on either side gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_row_id, without
from .hashing import column, pieces

RATE = 0.08
SLICE_BYTES = 16 << 20
_OTHER = re.compile(r"[\W_]+")
#: Scripts from here on are written without spaces between words.
UNSPACED = "\u2e80"


def normalise(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def whole_words(text: str, lo: int, hi: int) -> bool:
    """Whether text[lo:hi] begins and ends between words."""
    cut = lambda at: not 0 < at < len(text) or " " in text[at - 1 : at + 1] or max(text[at - 1 : at + 1]) >= UNSPACED
    return cut(lo) and cut(hi)


def least_distance(item: str, places: dict[str, int], text: str) -> int:
    """The least edit distance between item and any substring of text. places: bit set of each character's places."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    get = places.get
    for c in text:
        same = get(c, 0)
        x = same | down
        h = (((same & up) + up) ^ up) | same
        plus = down | (full & ~(h | up))
        minus = up & h
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best = score
        plus <<= 1
        up = ((minus << 1) | ~(x | plus)) & full
        down = plus & x & full
    return best


class Matcher:
    """Finds benchmark items in normalised texts. items: id, text."""

    def __init__(self, items: list[tuple], rate: float = RATE):
        import ahocorasick

        self.items, pieces = [], defaultdict(list)
        for key, text in sorted({(k, normalise(t)) for k, t in items}, key=repr):
            m = len(text)
            if not m:
                continue
            budget = int(rate * m)
            places = defaultdict(int)
            for at, c in enumerate(text):
                places[c] |= 1 << at
            for j in range(budget + 1):
                a, e = j * m // (budget + 1), (j + 1) * m // (budget + 1)
                pieces[text[a:e]].append((len(self.items), a))
            self.items.append((key, text, dict(places) if budget else None, budget))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def match(self, raw: str | None) -> dict:
        """Item id -> least distance, for items within their budget."""
        if not self.items or not raw:
            return {}
        text, starts = normalise(raw), defaultdict(set)
        for end, (size, where) in self.automaton.iter(text):
            for item, offset in where:
                starts[item].add(end + 1 - size - offset)
        found = {}
        for item, at in starts.items():
            key, pattern, places, budget = self.items[item]
            if places is None:
                if any(whole_words(text, s, s + len(pattern)) for s in at):
                    found[key] = 0
                continue
            spans, best = [], budget + 1
            for s in sorted(at):
                lo, hi = max(0, s - budget), s + len(pattern) + budget
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                best = min(best, least_distance(pattern, places, text[lo:hi]))
                if best == 0:
                    break
            if best <= budget:
                found[key] = min(best, found.get(key, best))
        return found


def slices_of(items: DataFrame) -> list[DataFrame]:
    """items (item_id, text), without repeated rows, in parts of at most SLICE_BYTES; one item, or several of one hash bucket, can be more.

    Rows are dealt by a hash of id and text to buckets, on average 16 to a slice, whose sizes the driver adds up.
    """
    items = items.distinct()
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    if total < SLICE_BYTES:
        return [items]
    buckets = 16 * (total // SLICE_BYTES + 1)
    items = items.withColumn("_b", F.pmod(F.xxhash64("item_id", "text"), F.lit(buckets)))
    ends, held = [], 0
    for r in items.groupBy("_b").agg(F.sum(F.octet_length("text")).alias("n")).orderBy("_b").collect():
        if ends and held + r["n"] <= SLICE_BYTES:
            ends[-1], held = (ends[-1][0], r["_b"]), held + r["n"]
        else:
            ends.append((r["_b"], r["_b"]))
            held = r["n"]
    return [items.where(F.col("_b").between(*e)).drop("_b") for e in ends]


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: str = "doc_id", rate: float = RATE) -> DataFrame:
    """A row for each document and benchmark item in it: keep, item_id, distance. benchmark: item_id, text."""
    spark = docs.sparkSession
    docs = docs.select(F.col(keep).cast("long").alias(keep), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    slices = slices_of(items)
    ids = [keep]
    if len(slices) > 1 and keep != "_rid":  # tells repeated documents apart when slices are put together
        docs, ids = with_row_id(docs), ["_rid", keep]
    names, out = [*ids, "item_id", "distance"], None
    schema = ", ".join(f"{c} long" for c in names[:-1]) + ", distance int"
    for part in slices:
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part.collect()])

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, rate)
            kinds = pa.schema([(c, pa.int64()) for c in names[:-1]] + [("distance", pa.int32())])
            for batch in pieces(batches):
                keys = zip(*(column(batch, c).to_pylist() for c in ids))
                rows = [dict(zip(names, (*d, k, n))) for d, t in zip(keys, column(batch, "text").to_pylist()) for k, n in matcher.match(t).items()]
                yield pa.RecordBatch.from_pylist(rows, kinds)

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if len(slices) > 1:  # an item's texts can be in several slices
        out = out.groupBy(*ids, "item_id").agg(F.min("distance").alias("distance"))
    return out.select(keep, "item_id", "distance")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """docs without the rows that hold a benchmark item."""
    return without(docs, lambda rows: find_leaks(rows, benchmark, "_rid", rate).select("_rid").distinct())
