"""Token ids of documents as binary files of compressed, checksummed blocks, and a splittable reader of them.

Documents are ordered by doc_id over ranges of it, a file each; their ids, an end id after each document, are cut into
blocks of up to BLOCK_IDS, whose ids `id_coder` compresses by an adaptive context-mixing range coder, reset at every
block. A block stands for itself: its head has the file's number, its own, the place of its first id in the file, which
documents it holds and a CRC-32 of all of it. Files are written by Spark's text writer, blocks apart by MAGIC, which no
block contains, and read by its line reader, so that tasks get byte ranges of files on any store.

    block: mask byte, then, each byte xor mask: crc32 of the rest (4), version (1), file (4), block (4), first (8), ids (4),
    documents (4), length of the table (4), table, words of the coder. Little-endian.
    table, after a byte that is 1 if it is by zlib: doc_ids as differences (8 each), ids in this block (4 each), flags (1 each): 1 begins here, 2 ends here, 4 null doc_id

A document that runs over several blocks is put together where it is read, and one that runs over several ranges from
the parts of these. Readers raise if a checksum differs or blocks of a file are missing.

Defined results: null counts as the empty text, which has the end id only; null doc_ids come first; of rows with one
doc_id, the order is by a hash of the text; repeated rows each have their ids; an empty table gives files without a
block and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from itertools import chain, compress, repeat
from operator import is_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import id_coder
from .common import checkpoint, small
from .hashing import column, pieces
from .token_counts import MEMO_BYTES

#: Eight bytes, all different.
MAGIC = b"\x8fIDX\x9f\xa3\xb7\xc1"
VERSION = 2
#: Version, file, block, first, ids, documents, length of the table.
HEAD = "<BIIQIII"
BEGINS, ENDS, NO_ID = 1, 2, 4
#: Bytes of a table that zlib would hardly make less.
PLAIN_TABLE = 64
#: Blocks that are coded in step; twice as many are read so.
LANES = 1536
#: A worker keeps the ids of the words it met last: between so many and about twice as many.
MEMO_WORDS = 500_000
#: Words that are encoded together, bytes of texts whose words are.
JOINED, TEXTS = 64, 4 << 20


#: Normalizer and pre-tokenizer of tokenizers whose words are told by bytes, see Encoder.
LOWERED = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _lower(byte: int) -> int:
    low = chr(byte).lower()
    return 32 if 9 <= byte <= 13 else ord(low) if ord(low) < 256 else byte


#: Of Latin-1: lower case, white space as spaces.
LATIN_LOWER = bytes(map(_lower, range(256)))
#: White space as spaces.
SPACED = bytes(32 if 9 <= i <= 13 else i for i in range(256))
#: Letters and digits of Latin-1.
SOLID = np.array([chr(i).isalnum() for i in range(256)])
#: A space and letters; these and ASCII marks but no apostrophe.
LETTERS = re.compile(b" [a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+")
MARKED = re.compile(b"(" + LETTERS.pattern + rb")([!-&(-/:-@\[-`{-~]+)")


class Encoder:
    """The ids of texts, as little-endian unsigned 32-bit integers. by_words: as for token_counts.

    A tokenizer that lower-cases and parts letters, digits and marks from each other (_parts_marks) has the same ids for
    Latin-1 texts in lower case, with dots and commas that end words as words of their own; so fewer words are new.
    """

    def __init__(self, path: str, by_words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        # each: words and their ids, those of the words before these
        self.by_words, self.memo, self.plain = by_words, ({}, {}), ({}, {})
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.parts_marks = by_words and _parts_marks(spec)
        # in Latin-1's lower case, where any of them could arise from other case; others don't occur in Latin-1
        added = [t["content"].lower() for t in spec["added_tokens"]]
        self.added_bytes = [t.encode("latin-1") for t in added if max(t, default="") < "\u0100"]
        # words of letters in lower case pass unchanged through the rest
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = spec["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word, JOINED words at a time: a call costs more than a word."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        out = []
        for group, found in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4").tobytes()
            begins = np.cumsum([0] + [len(w) + 1 for w in group])
            cuts = (4 * np.searchsorted([at for at, _ in found.offsets], begins)).tolist()
            out += [ids[i:j] for i, j in zip(cuts, cuts[1:])]
        return out

    def _letters_ids(self, words: list[bytes]) -> list[bytes]:
        """_word_ids of words that are a space and Latin-1's small letters, whose last ids tell that they end them."""
        groups = [b"".join(words[i : i + JOINED]).decode("latin-1") for i in range(0, len(words), JOINED)]
        ids = np.array(list(chain.from_iterable(x.ids for x in self.letters.encode_batch_fast(groups, add_special_tokens=False))), "<u4")
        cuts = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
        if len(cuts) != len(words) + 1:
            return self._word_ids([w[1:].decode("latin-1") for w in words])
        ids = ids.tobytes()
        return [ids[i:j] for i, j in zip(cuts, cuts[1:])]

    def _plain(self, text: str) -> bytes | None:
        """A text in Latin-1's lower case, after a space; None if it isn't so plain."""
        try:
            data = b" " + text.encode("latin-1").translate(LATIN_LOWER)
        except UnicodeEncodeError:
            return None
        return None if any(t in data for t in self.added_bytes) else data

    def _learn_plain(self, new: set[bytes], plain: dict[bytes, bytes]) -> None:
        """Puts the ids of new plain words into plain."""
        wanted, marked, odd = set(), [], set()
        for w in new:
            if w[1:].isalpha() or LETTERS.fullmatch(w):
                wanted.add(w)
            elif len(w) <= MEMO_BYTES and (found := MARKED.fullmatch(w)):
                marked.append((w, *found.groups()))
            else:
                odd.add(w)
        wanted.update(w for _, w, _ in marked if w not in plain)
        odd.update(m for _, _, m in marked if m not in plain)
        wanted, odd = list(wanted), list(odd)
        plain.update(zip(wanted, self._letters_ids(wanted)))
        plain.update(zip(odd, self._word_ids([w.lstrip().decode("latin-1") for w in odd])))
        plain.update((w, plain[letters] + plain[marks]) for w, letters, marks in marked)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_words:
            return self._ids([t or "" for t in texts])
        plain = [self._plain(t or "") if self.parts_marks else None for t in texts]
        self.plain, found = _memoised([t for t in plain if t is not None], self.plain, self._learn_plain, True)
        rest = [b" " + (t or "").encode().translate(SPACED) for t, p in zip(texts, plain) if p is None]
        self.memo, others = _memoised(rest, self.memo, self._learn, False)
        found, others = iter(found), iter(others)
        return [next(others if p is None else found) for p in plain]

    def _learn(self, new: set[bytes], memo: dict[bytes, bytes]) -> None:
        new = list(new)
        memo.update(zip(new, self._word_ids([w.lstrip().decode() for w in new])))


def _memoised(texts: list[bytes], memo: tuple[dict, dict], learn, marks: bool) -> tuple[tuple[dict, dict], list[bytes]]:
    """The memo from now on, and the ids of texts from those of their words; learn puts new words into a memo.

    A space begins each text and word, in a memo too. marks: a dot or comma between a letter or digit and a space is a word without it.
    """
    young, old = memo
    if len(young) > MEMO_WORDS:
        young, old = {}, young
    data = b"".join(texts) + b" "
    found = np.frombuffer(data, np.uint8)
    begins = found == 32
    if marks:
        at = np.flatnonzero((found == 46) | (found == 44))
        begins[at[(found[at + 1] == 32) & SOLID[found[at - 1]]]] = True
    begins = np.flatnonzero(begins)
    places = np.searchsorted(begins, np.cumsum([0, *map(len, texts)]))  # words before each text
    begun = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(data)]).dictionary_encode()
    _, where, held = begun.dictionary.buffers()
    at, held = np.frombuffer(where, np.int64)[: len(begun.dictionary) + 1].tolist(), held.to_pybytes() if held else b""
    words = [held[i:j] for i, j in zip(at, at[1:])]
    ids = list(map(young.get, words))
    missing = list(compress(range(len(ids)), map(is_, ids, repeat(None))))
    new = {words[i] for i in missing}
    again = new & old.keys()
    young.update((w, old[w]) for w in again)
    new -= again
    learn(new, young)
    for i in missing:
        ids[i] = young[words[i]]
    for w in new:
        if len(w) > MEMO_BYTES:
            del young[w]
    # the ids of distinct words, end to end, are dealt to the words of the texts
    code, lengths = begun.indices.to_numpy(), np.array(list(map(len, ids)), np.int64) // 4
    begins = np.cumsum(lengths) - lengths
    many = lengths.take(code)
    after = np.cumsum(many)
    source = np.repeat(begins.take(code) - (after - many), many)
    source += np.arange(len(source))
    out = np.frombuffer(b"".join(ids), "<u4").take(source).tobytes()
    cuts = (4 * np.append(0, after).take(places)).tolist()
    return (young, old), [out[i:j] for i, j in zip(cuts, cuts[1:])]


def _parts_marks(spec: dict) -> bool:
    """Whether a tokenizer lower-cases texts, drops white space and never joins letters, digits and marks; spec: its file."""
    normalizer, before = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    lowers = [n["type"] for n in normalizer.get("normalizers", [])] == LOWERED and normalizer["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
    return lowers and before[0].get("pattern") == {"Regex": SPLIT} and [b["type"] for b in before] == ["Split", "ByteLevel"] and before[0]["behavior"] == "Removed" and before[0]["invert"]


#: The encoder that this worker made last, for its next tasks: loading one, and its words, take longer than many texts.
_made: dict[tuple, Encoder] = {}


def encoder_of(path: str, by_words: bool) -> Encoder:
    stat = os.stat(path)
    key = (path, by_words, stat.st_mtime_ns, stat.st_size)
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(path, by_words)
    return _made[key]


def pack(file: int, number: int, first: int, table: list[tuple], n: int, words: bytes) -> bytes:
    """A block. table: (doc_id or None, ids in this block, flags) of each document in it."""
    docs = np.array([d or 0 for d, _, _ in table], "<i8")
    rest = b"".join([np.diff(docs, prepend=docs[:1] * 0).astype("<i8").tobytes(), np.array([k for _, k, _ in table], "<u4").tobytes(), bytes(f for _, _, f in table)])
    rest = b"\1" + zlib.compress(rest, 1) if len(rest) > PLAIN_TABLE else b"\0" + rest
    body = struct.pack(HEAD, VERSION, file, number, first, n, len(table), len(rest)) + rest + words
    body = struct.pack("<I", zlib.crc32(body)) + body
    mask = 0
    out = b"\0" + body
    while MAGIC in out:  # about once in 2**64 bytes
        mask += 1
        out = bytes([mask]) + (np.frombuffer(body, np.uint8) ^ np.uint8(mask)).tobytes()
    return out


def unpack(block: bytes) -> tuple[int, int, int, list[tuple], int, bytes]:
    """What pack was given; raises ValueError if the block is damaged."""
    body = block[1:]
    if block[:1] != b"\0":
        body = (np.frombuffer(body, np.uint8) ^ np.uint8(block[0])).tobytes()
    if len(body) < 4 + struct.calcsize(HEAD) or zlib.crc32(body[4:]) != struct.unpack_from("<I", body)[0]:
        raise ValueError("a block of token ids fails its checksum")
    version, file, number, first, n, documents, length = struct.unpack_from(HEAD, body, 4)
    if version != VERSION:
        raise ValueError(f"blocks of version {version} are unknown")
    at = 4 + struct.calcsize(HEAD)
    rest = body[at + 1 : at + length]
    if body[at]:
        rest = zlib.decompress(rest)
    docs = np.cumsum(np.frombuffer(rest, "<i8", documents))
    counts = np.frombuffer(rest, "<u4", documents, 8 * documents)
    flags = rest[12 * documents :]
    table = [(None if f & NO_ID else d, k, f) for d, k, f in zip(docs.tolist(), counts.tolist(), flags)]
    return file, number, first, table, n, body[at + length :]


class Writer:
    """Cuts the ids of a file's documents into blocks."""

    def __init__(self, file: int, size: int):
        self.file, self.size, self.number, self.first = file, size, 0, 0
        self.held: list[tuple] = []  # doc_id, ids
        self.count = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.held.append((doc_id, ids, BEGINS))
        self.count += len(ids)

    def full(self, lanes: int) -> bool:
        return self.count >= lanes * self.size

    def blocks(self, all_: bool):
        """The blocks of what is held; if not all_, ids that don't fill one stay."""
        n = self.count if all_ else self.count // self.size * self.size
        if not n:
            return
        ids = np.concatenate([x for _, x, _ in self.held])
        tables, left = [[]], self.size
        held, done = [], 0
        for doc_id, own, flag in self.held:
            at = 0
            while at < len(own):
                if done == n:
                    held.append((doc_id, own[at:], flag))
                    break
                k = min(len(own) - at, left)
                at, done, left = at + k, done + k, left - k
                tables[-1].append((doc_id, k, flag | (ENDS if at == len(own) else 0) | (NO_ID if doc_id is None else 0)))
                flag = 0
                if not left and done < n:
                    tables.append([])
                    left = self.size
        cut = [ids[i : min(i + self.size, n)] for i in range(0, n, self.size)]
        for table, part, words in zip(tables, cut, id_coder.encode(cut)):
            yield pack(self.file, self.number, self.first, table, len(part), words)
            self.number += 1
            self.first += len(part)
        self.held, self.count = held, self.count - n


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, by_words: bool = False) -> None:
    """Writes the ids of docs (doc_id, text) to files in the folder path. tokenizer: a .json file that every executor has.

    by_words: the tokenizer drops white space and never joins across it.
    """

    def run(batches):
        encoder, writer = encoder_of(tokenizer, by_words), Writer(TaskContext.get().partitionId(), id_coder.BLOCK_IDS)
        end = struct.pack("<I", end_id)
        rows = lambda found: pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["block"])
        for part in pieces(batches, most=TEXTS):
            for doc_id, ids in zip(column(part, "doc_id").to_pylist(), encoder.ids(column(part, "text").to_pylist())):
                writer.add(doc_id, np.frombuffer(ids + end, "<u4"))
                if writer.full(LANES):
                    yield rows(list(writer.blocks(False)))
        yield rows(list(writer.blocks(True)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
    by = [F.col("doc_id").asc_nulls_first(), F.col("_h")]
    # rows with one doc_id and text go to any of their ranges
    ranged = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*by, "_salt").sortWithinPartitions(*by)
    blocks = ranged.select("doc_id", "text").mapInArrow(run, "block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)


def _stored_blocks(spark: SparkSession, path: str) -> DataFrame:
    source = spark.read.format("text").option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1")
    return source.load(path).select(F.col("value").cast("binary").alias("block"))


def _decoded(batches):
    """Lists of blocks, each as unpack gives it but with its ids in place of words, in their order."""
    held = []

    def flush():
        ids = id_coder.decode([b[5] for b in held], [b[4] for b in held])
        return [(*b[:5], x) for b, x in zip(held, ids)]

    for batch in batches:
        for block in batch.column(0).to_pylist():
            held.append(unpack(block))
            if len(held) == 2 * LANES:
                yield flush()
                held = []
    if held:
        yield flush()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, first, ids: the parts of documents as blocks have them, first counted from the begin of all files."""

    def run(batches):
        for blocks in _decoded(batches):
            rows = []
            for file, _, first, table, n, ids in blocks:
                at = 0
                for doc_id, k, _ in table:
                    rows.append((doc_id, file, first + at, ids[at : at + k].astype(np.int64)))
                    at += k
            names, kinds = ["doc_id", "file", "first", "ids"], (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    found = _stored_blocks(spark, path).mapInArrow(run, "doc_id long, file long, first long, ids array<long>")
    placed = found.join(small(_bases(_heads(spark, path))), "file")
    return placed.select("doc_id", (F.col("base") + F.col("first")).alias("first"), "ids")


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """file, number, first, n of each block, without decoding its ids."""

    def run(batches):
        for batch in batches:
            rows = [(b[0], b[1], b[2], b[4]) for b in map(unpack, batch.column(0).to_pylist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], ["file", "number", "first", "n"])

    return _stored_blocks(spark, path).mapInArrow(run, "file long, number long, first long, n long")


def _bases(blocks: DataFrame) -> DataFrame:
    """blocks: file, number, first, n, with `blocks` of them in a row if it stands for several -> file, base: ids of all files before.

    Raises if a file lacks blocks. A row per file goes through one task.
    """
    count = F.sum("blocks") if "blocks" in blocks.columns else F.count("*")
    last = F.max(F.struct("number", (F.col("first") + F.col("n")).alias("end")))
    files = blocks.groupBy("file").agg(count.alias("c"), F.sum("n").alias("n"), last.alias("l"))
    whole = (F.col("c") == F.col("l.number") + 1) & (F.col("n") == F.col("l.end"))
    files = files.withColumn("n", F.when(whole, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("blocks are missing in file "), F.col("file")))))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


#: CRC-32's polynomial, bits reversed, as the library of `zlib.crc32` has it.
_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo CRC-32's; the highest bit is the constant term."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def crc32_joined(a: int, b: int, length: int) -> int:
    """CRC-32 of two strings end to end, from theirs and the length of the second in bytes."""
    power, square, n = 1 << 31, 1 << 23, length  # x ** 0 and x ** 8
    while n:
        if n & 1:
            power = _times(power, square)
        square, n = _times(square, square), n >> 1
    return _times(power, a) ^ b


def _digests(batches):
    """Blocks of ranges -> documents or, at the ends of ranges, parts of them; and a row per stretch of blocks.

    Rows: kind (document, part or blocks), file, number, first, n, crc, doc_id, blocks, flags.
    """
    names = ["kind", "file", "number", "first", "n", "crc", "doc_id", "blocks", "flags"]
    kinds = (pa.string(), *[pa.int64()] * 8)
    rows = lambda found: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found), kinds)], names)
    open_, after, stretch = None, None, None
    whole = lambda x: ("document" if x[7] == BEGINS | ENDS else "part", *x[:6], 0, x[7])
    for blocks in _decoded(batches):
        found = []
        for file, number, first, table, n, ids in blocks:
            if (file, number) != after:
                if open_:
                    found.append(whole(open_))
                    open_ = None
                if stretch:
                    found.append(stretch)
                stretch = ("blocks", file, number, first, 0, 0, None, 0, 0)
            after = (file, number + 1)
            stretch = (*stretch[:2], number, stretch[3], stretch[4] + n, 0, None, stretch[7] + 1, 0)
            data, at = ids.astype("<u4").tobytes(), 0
            for doc_id, k, flags in table:
                own = data[4 * at : 4 * (at + k)]
                flags &= BEGINS | ENDS
                if open_:
                    open_ = (*open_[:3], open_[3] + k, zlib.crc32(own, open_[4]), doc_id, 0, open_[7] | flags)
                else:
                    open_ = (file, number, first + at, k, zlib.crc32(own), doc_id, 0, flags)
                if flags & ENDS:
                    found.append(whole(open_))
                    open_ = None
                at += k
        if found:
            yield rows(found)
    found = [whole(open_)] if open_ else []
    if stretch:
        found.append(stretch)
    if found:
        yield rows(found)


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """The parts of one document, one from each range it runs through -> the document."""
    pdf = pdf.sort_values("first")
    crc = 0
    for own, n in zip(pdf["crc"].tolist(), pdf["n"].tolist()):
        crc = crc32_joined(crc, own, 4 * n)
    head = pdf.iloc[0]
    return pd.DataFrame({"file": [head["file"]], "first": [head["first"]], "n": [int(pdf["n"].sum())], "crc": [crc], "doc_id": pdf["doc_id"].iloc[:1].tolist()})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files of a folder.

    start: ids of all documents before; ids_crc32: of the ids as little-endian unsigned 32-bit integers, the end id among them.
    """
    schema = "kind string, file long, number long, first long, n long, crc long, doc_id long, blocks long, flags long"
    # a row per document and per range, written once: files' totals and documents read it
    found = checkpoint(_stored_blocks(spark, path).mapInArrow(_digests, schema))
    bases = _bases(found.where("kind = 'blocks'"))
    columns = ["file", "first", "n", "crc", "doc_id"]
    parts = found.where("kind = 'part'")
    # each part belongs to the last begin in its file at or before it; there are two parts at most per range
    marked = parts.withColumn("begin", F.last(F.when(F.col("flags") % 2 == BEGINS, F.col("first")), True).over(Window.partitionBy("file").orderBy("first")))
    late = marked.groupBy("file", "begin").applyInPandas(_joined, "file long, first long, n long, crc long, doc_id long")
    rows = found.where("kind = 'document'").select(*columns).unionByName(late)
    return rows.join(small(bases), "file").select("doc_id", (F.col("base") + F.col("first")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
