"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of bigrams and unigrams and a uniform one. The weights of the mixture
depend on how often the context was seen (a bucket per power of two) and are learned by expectation-maximisation:
a tenth of the training documents is held out from the counts and its tokens tell how far each estimate can be
trusted. The final scores use the counts of all training documents.

Counting and looking up are one exchange. A task takes its documents in blocks; a block asks each hash bucket for the
counts of its distinct words and bigrams and brings its own counts along; a bucket sums what all blocks bring and
answers each of them in its order. The texts are read once: a block travels with its requests, compressed.
Blocks have a bounded size whatever the input, and so have buckets: their number grows with the input, and where there
are more than FAN blocks, the requests of FAN blocks to a bucket are merged into one, and these again, until a bucket
gets FAN requests at most, however many blocks ask for its words; answers go down the same way. Words are told apart
by 64 bits; bigrams by 39 bits in a bucket of under 800,000 tokens.

Defined results: A-Z are lower-cased, words are parted by ASCII white space, each text ends in one end token; a null
or empty text is the end token alone; ids count by their decimal text, null as the empty text; repeated rows all
count and are scored alike; without training documents every count is 0; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, stored
from .hashing import U, column, hash_words, mix, pieces, text_bytes, word_bounds

FOLDS, TEST, TUNE = 10, 0, 1
BLOCK_BYTES = 8 << 20
BUCKET_TOKENS = 750_000
LOW_BITS = 39
#: The most requests that meet in a bucket.
FAN = 512
END, START = U(0x51ED270B9A3C6E5F), U(0xA24BAED4963EE407)
WORD, PAIR, OWN = 0, 1, 2
SCHEMA = "kind int, bucket long, block long, a binary, b binary, c binary"
#: Steps per octave in which held-out probabilities are gathered for expectation-maximisation.
STEPS = 4
ROUNDS = 60


def _pack(x: np.ndarray) -> bytes:
    """Small integers, bytes of one place together, compressed."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=U(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def token_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each text followed by END, and the number of tokens of each."""
    data, at = text_bytes(texts)
    starts, ends, first = word_bounds(data, at)
    sizes = np.diff(first) + 1
    out = np.full(int(sizes.sum()), END)
    word = np.ones(len(out), bool)
    word[np.cumsum(sizes) - 1] = False
    out[word] = hash_words(data, starts, ends)
    return out, sizes


def contexts(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each one, START at the beginning of a text."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.cumsum(sizes) - sizes] = START
    return out


def pair_keys(before: np.ndarray, tokens: np.ndarray, bits: int) -> np.ndarray:
    return mix(before * U(0x9E3779B97F4A7C15) + mix(tokens)) >> U(64 - LOW_BITS - bits)


class _Block:
    """The documents of a block as they come, then its rows (kind, bucket, block, a, b, c)."""

    def __init__(self):
        self.tokens, self.sizes, self.docs, self.folds, self.bytes = [], [], [], [], 0

    def add(self, texts, ids, folds: np.ndarray):
        tokens, sizes = token_hashes(texts)
        self.tokens.append(tokens)
        self.sizes.append(sizes)
        self.docs.append(pa.record_batch([ids.cast(pa.int64()), pa.array(folds), texts.cast(pa.large_string())], ["doc_id", "fold", "text"]))
        self.folds.append(folds)
        self.bytes += texts.nbytes

    def rows(self, block: int, bits: int):
        """For each kind and bucket its distinct keys and their counts outside and inside the held-out fold, then the documents."""
        tokens, sizes, folds = (np.concatenate(x) for x in (self.tokens, self.sizes, self.folds))
        fold = np.repeat(folds, sizes)
        for kind, keys in ((WORD, tokens), (PAIR, pair_keys(contexts(tokens, sizes), tokens, bits))):
            every, place = np.unique(keys, return_inverse=True)
            counts = [np.bincount(place[mine], minlength=len(every)) for mine in ((fold != TEST) & (fold != TUNE), fold == TUNE)]
            bucket = (every >> U(LOW_BITS if kind == PAIR else 64 - bits)).astype(np.int64) if bits or kind == PAIR else np.zeros(len(every), np.int64)
            edge = np.flatnonzero(np.diff(bucket, prepend=-1))
            for lo, hi in zip(edge, [*edge[1:], len(every)]):
                yield kind, int(bucket[lo]), block, _pack_sorted(every[lo:hi]), _pack(counts[0][lo:hi]), _pack(counts[1][lo:hi])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.docs[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))) as out:
            out.write_table(pa.Table.from_batches(self.docs).combine_chunks())
        yield OWN, block, block, None, None, sink.getvalue().to_pybytes()


def _asked(bits: int):
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def rows(block: _Block, number: int):
        found = block.rows(number, bits)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), kinds)], ["kind", "bucket", "block", "a", "b", "c"])

    def run(batches):
        # odd numbers are blocks of held-out documents
        first, made, open_ = TaskContext.get().partitionId() << 24, 0, {}
        for part in pieces(batches):
            fold = column(part, "fold").to_numpy().astype(np.int64)
            for held in (0, 1):
                at = np.flatnonzero((fold == TUNE) == held)
                if not len(at):
                    continue
                block = open_.setdefault(held, _Block())
                block.add(column(part, "text").take(pa.array(at)), column(part, "doc_id").take(pa.array(at)), fold[at])
                if block.bytes >= BLOCK_BYTES:
                    yield rows(open_.pop(held), (first + made) * 2 + held)
                    made += 1
        for held, block in open_.items():
            yield rows(block, (first + made) * 2 + held)
            made += 1

    return run


def _summed(pdf: pd.DataFrame):
    """Requests to a bucket -> their distinct keys, the sums of both counts, and the place of each request's keys."""
    keys = [_unpack_sorted(k) for k in pdf["a"]]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums, at, places = np.zeros((2, len(every)), np.int64), 0, []
    for k, *counts in zip(keys, pdf["b"], pdf["c"]):
        own = place[at : at + len(k)]
        at += len(k)
        for total, packed in zip(sums, counts):
            total[own] += _unpack(packed, np.int64)
        places.append(own)
    return every, sums, places


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """Requests of several blocks to a bucket -> one."""
    every, (main, tune), _ = _summed(pdf)
    head = pdf.iloc[0]
    return pd.DataFrame({"kind": [head["kind"]], "bucket": [head["bucket"]], "block": [head["up"]], "a": [_pack_sorted(every)], "b": [_pack(main)], "c": [_pack(tune)]})


def _answered(pdf: pd.DataFrame) -> pd.DataFrame:
    """All requests to a bucket -> an answer to each (all counts, then held-out ones), and a row of sums under block -1."""
    kind, bucket = int(pdf["kind"].iloc[0]), int(pdf["bucket"].iloc[0])
    if kind == OWN:
        return pdf.assign(tokens=0, types=0, tune_tokens=0)
    _, (main, tune), places = _summed(pdf)
    total = main + tune
    out = [(kind, bucket, block, _pack(total[own]), _pack(tune[own]), None, 0, 0, 0) for block, own in zip(pdf["block"], places)]
    out.append((kind, bucket, -1, None, None, None, int(total.sum()), int((total > 0).sum()), int(tune.sum())))
    return pd.DataFrame(out, columns=["kind", "bucket", "block", "a", "b", "c", "tokens", "types", "tune_tokens"])


def _passed(asked: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
    """Requests that were merged, and the answer to the merged one -> the answer to each."""
    _, _, places = _summed(asked)
    total, tune = (_unpack(answer[c].iloc[0], np.int64) for c in "ab")
    out = [(k, bucket, block, _pack(total[own]), _pack(tune[own]), None) for k, bucket, block, own in zip(asked["kind"], asked["bucket"], asked["block"], places)]
    return pd.DataFrame(out, columns=["kind", "bucket", "block", "a", "b", "c"])


def tiers(blocks: int) -> list[int]:
    """How many requests a bucket gets after each merging, until they are few."""
    out = []
    while blocks > FAN:
        blocks = -(-blocks // FAN)
        out.append(blocks)
    return out


def exchange(asked: DataFrame, blocks: int) -> tuple[DataFrame, tuple]:
    """asked: the rows of all blocks -> their answers and own rows; and tokens, types, held-out tokens in training documents."""
    sums = SCHEMA + ", tokens long, types long, tune_tokens long"
    steps, asked_at, own = tiers(blocks), [], None
    if steps:
        asked = stored(asked)
        asked, own = asked.where(F.col("kind") != OWN), asked.where(F.col("kind") == OWN)
    for n in steps:
        asked_at.append(asked.withColumn("up", F.pmod(F.xxhash64("block"), F.lit(n))))
        asked = stored(asked_at[-1].groupBy("kind", "bucket", "up").applyInPandas(_merged, SCHEMA))
    answers = checkpoint(asked.groupBy("kind", "bucket").applyInPandas(_answered, sums))
    totals = answers.where(f"block = -1 and kind = {WORD}").agg(F.sum("tokens"), F.sum("types"), F.sum("tune_tokens")).head()
    answers = answers.where("block >= 0").select("kind", "bucket", "block", "a", "b", "c")
    for below in reversed(asked_at):
        answers = answers.withColumn("up", F.col("block")).groupBy("kind", "bucket", "up")
        answers = below.groupBy("kind", "bucket", "up").cogroup(answers).applyInPandas(_passed, SCHEMA)
    if own is not None:
        answers = checkpoint(answers.unionByName(own))
    return answers, tuple(x or 0 for x in totals)


class _Counts:
    """The answers to a block, put back to its tokens. rows: all of the block, its own among them."""

    def __init__(self, rows: pa.Table, bits: int):
        rows = sorted(zip(*(rows.column(c).to_pylist() for c in ("kind", "bucket", "a", "b", "c"))), key=lambda r: r[:2])
        self.docs = pa.ipc.open_stream(rows[-1][4]).read_all()
        tokens, self.sizes = token_hashes(self.docs.column("text"))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.got = {}
        for kind, keys in ((WORD, tokens), (PAIR, pair_keys(contexts(tokens, self.sizes), tokens, bits))):
            place = np.unique(keys, return_inverse=True)[1]
            mine = [r for r in rows if r[0] == kind]
            self.got[kind] = [np.concatenate([_unpack(r[c], np.int64) for r in mine])[place] for c in (2, 3)]

    def counts(self, documents: int, held: bool):
        """c(word), c(context), c(context, word) of each token; held: without the held-out documents."""
        word, pair = (self.got[k][0] - self.got[k][1] if held else self.got[k][0] for k in (WORD, PAIR))
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[self.first] = documents
        return word, before, pair


def context_bucket(before: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the whole part of its count's binary logarithm."""
    return np.where(before > 0, np.frexp(np.maximum(before, 1).astype(np.float64))[1], 0)


def mixture_weights(bucket: np.ndarray, bins: np.ndarray, often: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """EM: bucket of each cell, its estimates (cells x 3: bigram, unigram, uniform) and count -> weights (64 x 3)."""
    w = np.full((64, 3), 1 / 3)
    w[0] = 0, 0.5, 0.5
    for _ in range(rounds):
        part = bins * w[bucket]
        part *= (often / np.maximum(part.sum(axis=1), 1e-300))[:, None]
        new = np.stack([np.bincount(bucket, part[:, k], minlength=64) for k in range(3)], axis=1).astype(float)
        new += [[0.0 if b == 0 else 0.1, 0.5, 0.5] for b in range(64)]  # keeps every estimate possible
        w = new / new.sum(axis=1, keepdims=True)
    return w


def _estimates(word, before, pair, tokens: int, types: int):
    two = np.where(before > 0, pair / np.maximum(before, 1), 0.0)
    one = word / max(tokens, 1)
    return two, one, 1 / (types + 1)


def language_scores(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select("doc_id", "text")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"), F.count_if(fold != TEST).alias("d"), F.count_if(fold == TUNE).alias("t")).head()
    rows, byte, documents, held_documents = size["n"], size["b"] or 0, size["d"], size["t"]
    bits = max(0, int(np.ceil(np.log2(max(1.0, (byte / 6 + rows) / BUCKET_TOKENS)))))

    asked = docs.withColumn("fold", fold).mapInArrow(_asked(bits), SCHEMA)
    answers, (tokens, types, tune_tokens) = exchange(asked, 2 * byte // BLOCK_BYTES)

    def tuned(rows: pa.Table) -> pa.Table:
        got = _Counts(rows, bits).counts(documents - held_documents, True)
        two, one, _ = _estimates(*got, tokens - tune_tokens, types)
        step = lambda p: np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300)) * STEPS), 9999).astype(np.int64)
        cells, n = np.unique(np.stack([context_bucket(got[1]), step(two), step(one)], axis=1), axis=0, return_counts=True)
        return pa.table([cells[:, 0], cells[:, 1], cells[:, 2], n], names=["b", "two", "one", "n"])

    own = answers.where("block % 2 = 1").groupBy("block")
    cells = own.applyInArrow(tuned, "b long, two long, one long, n long").groupBy("b", "two", "one").agg(F.sum("n").alias("n")).toPandas()
    value = lambda q: np.where(q == 9999, 0.0, 2.0 ** (np.minimum(q, 0) / STEPS))
    bins = np.stack([value(cells["two"].to_numpy()), value(cells["one"].to_numpy()), np.full(len(cells), 1 / (types + 1))], axis=1)
    weights = mixture_weights(cells["b"].to_numpy(), bins, cells["n"].to_numpy().astype(float))

    def scored(rows: pa.Table) -> pa.Table:
        block = _Counts(rows, bits)
        word, before, pair = block.counts(documents, False)
        two, one, none = _estimates(word, before, pair, tokens, types)
        w = weights[context_bucket(before)]
        total = lambda x: np.add.reduceat(x, block.first)
        base = np.log10((word + 0.1) / (tokens + 0.1 * (types + 1)))
        score = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] * none)
        held = pa.array(block.docs.column("fold").to_numpy() == TEST)
        out = [block.docs.column("doc_id"), held, block.sizes, total((word > 0).astype(np.int64)), np.full(len(held), tokens), total(base), total(score)]
        return pa.table([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in out], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return answers.groupBy("block").applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
