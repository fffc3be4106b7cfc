"""Near-duplicate grouping by SuperMinHash, banding, exact verification and union-find.

Signatures: SuperMinHash gives the elements of a set correlated ranks, so that each slot of the signature is
hit by a permutation instead of independent draws, and stops as soon as no later rank can lower any slot.
Banding: four slots make a band; so many bands are used that a pair at the threshold is missed with a
probability under 1e-5. Copies of the same set are one class, so a group of exact copies is one row here.

Candidates of a bucket of up to BUCKET classes are its pairs. A larger bucket is never expanded into pairs:
its members are dealt into chunks by number and size, each compared in one task with the bucket's first member and within itself
by products of shingle incidence matrices; only a spanning forest of the confirmed links leaves the task. In buckets
with members that didn't join the first one's group, all members are dealt anew, by prefix filtering: with the shingles
of each set ordered from rare to common, two sets as similar as asked share one of the first few (for 85 %, a bit over 15 %
of a set), so those are the new buckets, where they hold a member that didn't join. Texts that only share a common
passage part there. What is still large is compared chunk by chunk. Every candidate is confirmed on full shingle sets, and no link between classes of one bucket
is lost.

Sets hold 64-bit hashes of five words' 64-bit hashes: two sets of n shingles differ by a collision with a probability
of about n * n / 2**64, under 1e-9 for texts of 100,000 words.

Defined results: words are separated by ASCII white space and A-Z are lower-cased; a text of fewer words than
a shingle has is one shingle; null, empty and blank texts have none and link with nothing; of repeated rows,
one is kept; the smallest doc_id names the component, null after all others; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_counted, with_row_id, without
from .components import components
from .hashing import U, column, hash_runs, hash_sequence, hash_words, mix, pieces, text_bytes, word_bounds

WORDS = 5
ROWS = 4
MISS = 1e-5
BUCKET = 32
CHUNK = 512
#: Members with so many shingles in all are a chunk too.
CHUNK_SHINGLES = 4 << 20
#: The order of shingles in prefix filtering follows counts of so many hash cells, added up in so many parts.
CELL_BITS, CELL_PARTS = 20, 64


def bands_for(percent: int) -> int:
    """Bands of four rows so that a pair at the threshold shares none with a probability under MISS."""
    return int(np.ceil(np.log(MISS) / np.log(1 - (percent / 100) ** ROWS)))


def shingle_sets(column_of_text, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    data, at = text_bytes(column_of_text)
    starts, ends, first = word_bounds(data, at)
    hashed = hash_words(data, starts, ends)
    runs = hash_runs(hashed, words)
    out = []
    for lo, hi in zip(first[:-1], first[1:]):
        if hi - lo >= words:
            out.append(np.unique(runs[lo : hi - words + 1]))
        else:
            out.append(np.array([hash_sequence(hashed[lo:hi])] if hi > lo else [], np.uint64))
    return out


def superminhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures, a row per set: the level of a slot in the upper half of each integer, a random part below.

    All sets go through the levels together. At level j each element draws a rank and the next place of its
    own permutation of the slots; a set is finished when all its slots have levels below the next.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    elements = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = None
    flat = out.reshape(-1)
    for level in range(slots):
        if not len(elements):
            break
        drawn = mix(elements + U((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = level + ((drawn & U(0xFFFFFFFF)) * U(slots - level) >> U(32)).astype(np.int64)
        value = (drawn >> U(32)) | U(level << 32)
        if order is None:
            place = pick
        else:
            row = np.arange(len(elements))
            place = order[row, pick].astype(np.int64)
            order[row, pick] = order[row, level]
            order[row, level] = place
        np.minimum.at(flat, owner * slots + place, value)
        unfinished = (out.max(axis=1) >> U(32)) > U(level)
        unfinished &= sizes > 0
        stay = unfinished[owner]
        if order is None:
            elements, owner, pick = elements[stay], owner[stay], pick[stay]
            order = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
            row = np.arange(len(elements))
            order[row, 0], order[row, pick] = pick, 0
        elif not stay.all():
            elements, owner, order = elements[stay], owner[stay], order[stay]
    return out


def _signed(words: int, bands: int):
    def run(batches):
        for part in pieces(batches, most=1 << 20):
            sets = shingle_sets(column(part, "text"), words)
            signatures = superminhash(sets, bands * ROWS).reshape(len(sets), bands, ROWS)
            keys = np.full((len(sets), bands), U(0)) + np.arange(1, bands + 1, dtype=np.uint64)
            for k in range(ROWS):
                keys = mix(keys * U(0x9E3779B97F4A7C15) + signatures[:, :, k])
            sizes = np.array([len(s) for s in sets], np.int64)
            sums = [np.array([mix(s ^ U(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for salt in (0x1234567, 0x7654321)]
            at = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
            flat = keys[sizes > 0].reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [column(part, "_rid"), column(part, "doc_id").cast(pa.int64()), pa.array(sizes), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                ["_rid", "doc_id", "size", "d1", "d2", "bands"],
            )

    return run


def _packed(batches):
    """Texts compressed for the way to the tasks that compare them."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [press.compress((t or "").encode()) for t in column(batch, "text").to_pylist()]
        yield pa.RecordBatch.from_arrays([column(batch, "_rid"), pa.array(texts, pa.binary())], ["_rid", "packed"])


def _unpacked(packed, words: int) -> list[np.ndarray]:
    press = zstandard.ZstdDecompressor()
    return shingle_sets(pa.array([press.decompress(p).decode() for p in packed], pa.large_string()), words)


def _confirmed(words: int, percent: int):
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                left, right = (_unpacked(column(part, c).to_pylist(), words) for c in ("pa", "pb"))
                ok = []
                for x, y in zip(left, right):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([column(part, "a"), column(part, "b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def overlap_matrix(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct integers, from incidence matrices of `width` columns."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = often[place] > 1
    number = np.cumsum(often > 1) - 1
    owner, place = owner[keep], number[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        i, j = np.searchsorted(place, [lo, lo + width])
        block = np.zeros((len(sets), width), np.float32)
        block[owner[i:j], place[i:j] - lo] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _forest(linked: np.ndarray, first: int) -> np.ndarray:
    """The root of each row in the graph of a boolean matrix; `first` roots its own group."""
    root = np.full(len(linked), -1)
    for start in [first, *range(len(linked))]:
        if root[start] >= 0:
            continue
        group = np.zeros(len(linked), bool)
        group[start] = True
        edge = group.copy()
        while edge.any():
            new = linked[edge].any(axis=0) & ~group
            group |= new
            edge = new
        root[group] = start
    return root


def _rooted(words: int, percent: int):
    """Groups of rows of a bucket (_rid, pivot, packed) -> the root of each row among those it came with."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("_rid").sort_values("_rid", ignore_index=True)
        sets = _unpacked(pdf["packed"], words)
        size = np.array([len(s) for s in sets])
        both = overlap_matrix(sets)
        linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        rid = pdf["_rid"].to_numpy()
        first = np.flatnonzero(rid == pdf["pivot"].iloc[0])
        root = _forest(linked, int(first[0]) if len(first) else 0)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "_rid": rid, "root": rid[root], "pivot": pdf["pivot"].iloc[0]})

    return run


def _shingled(words: int):
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                sets = [s.view(np.int64) for s in _unpacked(column(part, "packed").to_pylist(), words)]
                yield pa.RecordBatch.from_arrays([column(part, "_rid"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["_rid", "size", "s"])

    return run


def _cells(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> U(64 - CELL_BITS)).astype(np.int64)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all sets of a batch, end to end, and the size of each set."""
    sets = column(batch, "s").cast(pa.large_list(pa.int64()))
    return sets.flatten().to_numpy(zero_copy_only=False), sets.value_lengths().to_numpy(zero_copy_only=False)


def cell_counts(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many elements of all sets fall into each of 2**CELL_BITS hash cells, and whether open sets have one there.

    Each task counts its own sets; tasks that add up a part of the cells read the counts of others one after the other.
    """
    width = (1 << CELL_BITS) // CELL_PARTS
    kinds = "part int, counts binary, opened binary"

    def rows(counts, opened, parts):
        press = zstandard.ZstdCompressor(level=1)
        packed = [[pa.array([press.compress(x[p].tobytes()) for p in parts], pa.binary())] for x in (counts, opened)]
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *packed[0], *packed[1]], ["part", "counts", "opened"])

    def count(batches):
        counts, opened, any_ = np.zeros(1 << CELL_BITS, np.int64), np.zeros(1 << CELL_BITS, bool), False
        for batch in batches:
            keys, sizes = _flat(batch)
            at = _cells(keys)
            np.add.at(counts, at, 1)
            opened[at[np.repeat(column(batch, "open").to_numpy(zero_copy_only=False).astype(bool), sizes)]] = True
            any_ = any_ or len(keys) > 0
        if any_:
            yield rows(counts.reshape(CELL_PARTS, width), opened.reshape(CELL_PARTS, width), range(CELL_PARTS))

    def add(batches):
        press, counts, opened = zstandard.ZstdDecompressor(), {}, {}
        for batch in batches:
            for p, n, o in zip(*(column(batch, c).to_pylist() for c in ("part", "counts", "opened"))):
                counts[p] = counts.get(p, 0) + np.frombuffer(press.decompress(n), np.int64)
                opened[p] = opened.get(p, False) | np.frombuffer(press.decompress(o), bool)
        if counts:
            yield rows(counts, opened, sorted(counts))

    # each part is of one size, whatever the sets hold
    summed = sets.select("open", "s").mapInArrow(count, kinds).repartition("part").mapInArrow(add, kinds).collect()
    press, counts, opened = zstandard.ZstdDecompressor(), np.zeros((CELL_PARTS, width), np.int64), np.zeros((CELL_PARTS, width), bool)
    for r in summed:
        counts[r["part"]] += np.frombuffer(press.decompress(r["counts"]), np.int64)
        opened[r["part"]] |= np.frombuffer(press.decompress(r["opened"]), bool)
    return counts.reshape(-1), opened.reshape(-1)


def prefix_keys(sets: DataFrame, percent: int) -> DataFrame:
    """sets: _rid, size, open, s (distinct integers) -> _rid, size, open, key: the first few of each set from rare to common that open sets have too.

    An open set has a key in common with any other set for which 100 * intersection >= percent * union. Any order
    of elements that is the same for all sets will do; here it is by the counts of hash cells, a table of a fixed size.
    """
    shared = sets.sparkSession.sparkContext.broadcast(cell_counts(sets))

    def firsts(batches):
        counts, opened = shared.value
        for batch in batches:
            keys, sizes = _flat(batch)
            cells = _cells(keys)
            number = counts[cells]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((keys, number, owner))
            rank = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            most = sizes - (sizes * percent + 99) // 100 + 1
            # a cell with one element has an element of one set
            kept = order[(rank < most[owner]) & (number[order] > 1) & opened[cells[order]]]
            of = owner[kept]
            take = [column(batch, c).take(pa.array(of)) for c in ("_rid", "size", "open")]
            yield pa.RecordBatch.from_arrays([*take, pa.array(keys[kept])], ["_rid", "size", "open", "key"])

    keys = checkpoint(sets.mapInArrow(firsts, "_rid long, size long, open boolean, key long"))
    often = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("open").alias("opened"))
    often = checkpoint(often.where("n > 1 and opened").drop("opened"))
    # written once: bucket counts and members read it again
    return checkpoint(join_counted(keys, often, ["key"]).where("n is not null").select("_rid", "size", "open", "key"))


def _buckets(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """keys: _rid, size, open, key -> buckets of two or more with an open one (key, c, pivot, most), and their members with these.

    most: members of this bucket that a task holds at a time, by their shingles on average.
    """
    buckets = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("_rid").alias("pivot"), F.max("open").alias("opened"), F.avg("size").alias("w"))
    fits = F.greatest(F.lit(1.0), F.least(F.lit(float(CHUNK)), F.floor(CHUNK_SHINGLES / F.greatest("w", F.lit(1.0))))).alias("most")
    buckets = checkpoint(buckets.where("c > 1 and opened").select("key", "c", "pivot", fits))
    keys = keys.drop("open")
    return buckets, checkpoint(join_counted(keys, buckets, ["key"], "c").where("c is not null"))


def _pairs(members: DataFrame, percent: int) -> DataFrame:
    """The pairs a < b of each bucket of up to BUCKET members, by sizes that allow the similarity."""
    few = members.where(F.col("c") <= BUCKET).groupBy("key").agg(F.collect_list(F.struct("_rid", "size")).alias("l"))
    fits = "filter(l, y -> y._rid > x._rid and 100 * least(x.size, y.size) >= {0} * greatest(x.size, y.size))".format(percent)
    pairs = few.select(F.expr(f"inline(flatten(transform(l, x -> transform({fits}, y -> named_struct('a', x._rid, 'b', y._rid)))))"))
    return checkpoint(pairs.distinct())


def _links(pairs: DataFrame, hot: DataFrame, buckets: DataFrame, packed: DataFrame, words: int, percent: int, last: bool = False) -> list[DataFrame]:
    """Confirmed links a, b among pairs and within the large buckets whose members are hot."""
    side = lambda c: packed.select(F.col("_rid").alias(c), F.col("packed").alias("p" + c))
    links = [pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_confirmed(words, percent), "a long, b long")]
    return links if hot.isEmpty() else links + _hot_links(hot, buckets.where(F.col("c") > BUCKET), packed, words, percent, last)


def _hot_links(members: DataFrame, sizes: DataFrame, packed: DataFrame, words: int, percent: int, last: bool) -> list[DataFrame]:
    """members: key, _rid of large buckets; sizes: key, pivot, c, most -> links a, b that connect all that is linked.

    last: members that don't join the first one's group meet all others; else they are dealt into smaller buckets before.
    """
    schema = "key long, _rid long, root long, pivot long"
    rooted = _rooted(words, percent)
    spread = F.ceil(F.col("c") / F.col("most")).cast("int")
    each = members.withColumn("chunk", F.pmod(F.xxhash64("_rid"), spread).cast("int")).select("key", "_rid", "pivot", "chunk")
    firsts = sizes.select("key", F.col("pivot").alias("_rid"), "pivot", F.explode(F.sequence(F.lit(0), spread - 1)).alias("chunk"))
    rows = each.unionByName(firsts).join(packed, "_rid")
    one = checkpoint(rows.groupBy("key", "chunk").applyInPandas(rooted, schema).where("_rid <> pivot"))
    joined = F.col("root") == F.col("pivot")
    counts = one.groupBy("key").agg(F.count_if(~joined).alias("rest"), (F.count_if(joined) + 1).alias("main"), F.count("*").alias("n"), F.first("pivot").alias("pivot"))
    counts = checkpoint(counts.where("rest > 0").join(sizes.select("key", "most"), "key"))
    link = lambda df: df.where("_rid <> root").select(F.col("_rid").alias("a"), F.col("root").alias("b"))
    if counts.isEmpty():
        return [link(one)]
    if not last:
        each = join_counted(one.select("key", "_rid", (~joined).alias("open")), counts.select("key", "n"), ["key"]).where("n is not null").select("_rid", "open")
        each = each.unionByName(counts.select(F.col("pivot").alias("_rid"), F.lit(False).alias("open")))
        each = checkpoint(each.groupBy("_rid").agg(F.max("open").alias("open")))
        sets = packed.join(each, "_rid", "left_semi").mapInArrow(_shingled(words), "_rid long, size long, s array<long>")
        sets = checkpoint(sets.join(each, "_rid"))
        buckets, dealt = _buckets(prefix_keys(sets, percent))
        hot = dealt.where(F.col("c") > BUCKET).select("key", "_rid", "pivot", "c", "most")
        return [link(one), *_links(_pairs(dealt, percent), hot, buckets, packed, words, percent, True)]
    parts = lambda n: F.ceil(F.col(n) / F.col("most")).cast("int")
    two = join_counted(one.drop("pivot"), counts, ["key"]).where("rest is not null").withColumn("rests", parts("rest")).withColumn("mains", parts("main"))
    two = two.withColumn("at", F.pmod(F.xxhash64("_rid"), F.when(joined, F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    lead = counts.withColumn("rests", parts("rest")).withColumn("mains", parts("main")).select("key", F.col("pivot").alias("_rid"), F.col("pivot").alias("root"), "rests", "mains", "pivot")
    lead = lead.withColumn("at", F.pmod(F.xxhash64("_rid"), F.col("mains")).cast("int"))
    two = two.select(*lead.columns).unionByName(lead)
    # rests meet each other as (i, j), i < j, and each chunk of the main group as (i, -1 - j)
    up = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda j: F.struct(F.least("at", j).alias("i"), F.greatest("at", j).alias("j")))
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: F.struct(F.col("at").alias("i"), (-1 - j).alias("j")))
    from_main = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda i: F.struct(i.alias("i"), (-1 - F.col("at")).alias("j")))
    meets = F.when(joined, from_main).otherwise(F.concat(F.filter(up, lambda p: p["i"] != p["j"]), with_main))
    rows = two.select("key", "_rid", "pivot", F.inline(meets)).join(packed, "_rid")
    again = rows.groupBy("key", "i", "j").applyInPandas(rooted, schema)
    return [link(one), link(again)]


def near_groups(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """docs with _rid -> _rid, doc_id, n_shingles, component_id, kept of every row."""
    docs = docs.select("_rid", "doc_id", "text")
    schema = "_rid long, doc_id long, size long, d1 long, d2 long, bands array<long>"
    signed = checkpoint(docs.mapInArrow(_signed(words, bands_for(percent)), schema))
    same = ["size", "d1", "d2"]
    classes = checkpoint(signed.where("size > 0").groupBy(*same).agg(F.min("_rid").alias("rep"), F.count("*").alias("n")))
    reps = signed.join(classes.select(F.col("rep").alias("_rid")), "_rid", "left_semi")
    bands = checkpoint(reps.select("_rid", "size", F.lit(True).alias("open"), F.explode("bands").alias("key")))
    buckets, members = _buckets(bands)
    pairs = _pairs(members, percent)

    hot = checkpoint(members.where(F.col("c") > BUCKET).select("key", "_rid", "pivot", "c", "most"))
    wanted = pairs.select(F.col("a").alias("_rid")).union(pairs.select("b")).union(hot.select("_rid")).distinct()
    texts = docs.select("_rid", "text").join(checkpoint(wanted), "_rid", "left_semi")
    packed = checkpoint(texts.mapInArrow(_packed, "_rid long, packed binary"))
    links = _links(pairs, hot, buckets, packed, words, percent)
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    roots = components(edges)

    placed = join_counted(signed.drop("bands"), classes, same).select("_rid", "doc_id", "size", F.coalesce("rep", "_rid").alias("node"))
    placed = join_counted(placed, checkpoint(roots.withColumn("n", F.lit(1))), ["node"]).select("_rid", "doc_id", "size", F.coalesce("root", "node").alias("root"))
    placed = checkpoint(placed)
    names = placed.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("z"), "doc_id", "_rid")).alias("first"), F.count("*").alias("n"))
    out = join_counted(placed, checkpoint(names), ["root"])
    return out.select("_rid", "doc_id", F.col("size").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), (F.col("_rid") == F.col("first._rid")).alias("kept"))


def near_dedup(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return near_groups(with_row_id(docs.select("doc_id", "text")), percent, words).drop("_rid")


def drop_near(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """docs with one row of each group of near duplicates."""
    return without(docs, lambda rows: near_groups(rows, percent, words).where(~F.col("kept")))
