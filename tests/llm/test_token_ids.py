"""The coder's round trip, the format's checks, and whole documents against the tokenizer by itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlode.llm import common, id_coder, registry, token_ids

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def coded(blocks):
    blocks = [np.array(b, np.uint32) for b in blocks]
    packed = id_coder.encode(blocks)
    assert [x.tolist() for x in id_coder.decode(packed, [len(b) for b in blocks])] == [b.tolist() for b in blocks]
    return packed


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), min_size=1, max_size=80), max_size=6))
def test_any_ids_come_back(blocks):
    coded(blocks)


def test_full_blocks_come_back_and_are_small():
    r = random.Random(2)
    full = id_coder.BLOCK_IDS
    phrase = [r.randrange(40_000) for _ in range(50)]
    blocks = [
        [7] * full,
        list(range(full)),
        [2**32 - 1 - i for i in range(full)],
        (phrase * full)[:full],
        [min(int(r.paretovariate(0.7)), 49_000) for _ in range(full)],
        [r.randrange(2**32) for _ in range(full)],
        [0],
    ]
    sizes = [len(x) for x in coded(blocks)]
    assert sizes[0] < 120 and sizes[3] < 400 and sizes[4] < 2 * full and sizes[5] < 4.7 * full
    # a block's bytes don't depend on the blocks beside it
    assert coded(blocks[3:5]) == coded(blocks)[3:5]


def test_the_second_time_is_cheaper():
    r = random.Random(5)
    once = [r.randrange(49_000) for _ in range(500)]
    one, two = coded([once, once + once])
    assert len(two) < 1.35 * len(one)


def test_crc32_joined():
    r = random.Random(1)
    for n in (0, 1, 3, 1000, 70_000):
        a, b = r.randbytes(37), r.randbytes(n)
        assert token_ids.crc32_joined(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


def test_blocks_keep_the_magic_out_and_show_damage():
    table = [(5, 3, 3), (None, 1, 7), (-2, 9, 1)]
    words = b"ab" + token_ids.MAGIC + bytes(range(256))
    block = token_ids.pack(3, 9, 77, table, 13, words)
    assert token_ids.MAGIC not in block and token_ids.unpack(block) == (3, 9, 77, table, 13, words)
    for at in (1, 9, len(block) - 1):
        with pytest.raises(ValueError, match="checksum"):
            token_ids.unpack(block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :])
    with pytest.raises(ValueError, match="checksum"):
        token_ids.unpack(block[:20])


def brute(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    out, start = [], 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_texts_of_many_forms_have_the_librarys_ids(monkeypatch):
    monkeypatch.setattr(token_ids, "MEMO_WORDS", 40)
    r = random.Random(9)
    forms = ["the", "The", "É", "éÀ", "ß", "µ", "ª²½", "Ÿ", "J\u030c", "e\u0301", "ΑΣ", ",", ".", "..", ").", "'s", "'S,", "'", "!!", "a" * 90, "%%%", "7", "12", " ", "  ", "\n", "\t", "\xa0", "\x85", "\x1c", "\x00"]
    forms += ["<|endoftext|>", "<|EndOfText|>", "<|", "日本"]
    texts = ["".join(r.choices(forms[: r.choice([8, 29, len(forms)])], k=r.randrange(12))) for _ in range(1500)]
    texts += [" ".join(r.choices(forms, k=60)) for _ in range(40)] + ["", None, ".", ",", " ", "\n. ,"]
    encoder = token_ids.Encoder(TOKENIZER, True)
    got = [np.frombuffer(x, "<u4").tolist() for i in range(0, len(texts), 100) for x in encoder.ids(texts[i : i + 100])]
    assert got == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_case_and_marks_make_no_new_words_and_tasks_share_them(monkeypatch):
    asked = []
    for name in ("_letters_ids", "_word_ids"):
        monkeypatch.setattr(token_ids.Encoder, name, lambda self, words, own=getattr(token_ids.Encoder, name): asked.extend(words) or own(self, words))
    monkeypatch.setattr(token_ids, "_made", {})
    token_ids.encoder_of(TOKENIZER, True).ids(["Some word, some Word. SOME word!! some,", "word."])
    assert sorted(w.decode().strip() if isinstance(w, bytes) else w for w in asked if w) == ["!!", ",", ".", "some", "word"]
    token_ids.encoder_of(TOKENIZER, True).ids(["word some!!"])
    assert len([w for w in asked if w]) == 5


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghé日") for _ in range(r.randint(1, 9))) for _ in range(500)] + ["<|endoftext|>", "<|startoftext|>x", "Σ", "ὈΔΥΣΣΕΎΣ", "#", "!"]
    out = [(i * 3, " ".join(r.choices(words, k=r.randint(0, 90)))) for i in range(200)]
    out += [(-5, "minus"), (7, None), (8, ""), (10, "# # #"), (11, " \t"), (2**62, "far"), (601, " ".join(r.choices(words, k=9000)))]
    return out


def written(spark, rows, parts, tables=4):
    docs = spark.createDataFrame([(*x, 1, "f") for x in rows], "doc_id long, text string, _h int, file string").repartition(tables)
    path = common.fresh_path(spark, "ids")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        token_ids.write_ids(docs, path, TOKENIZER, 2, by_words=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    return path


@pytest.mark.parametrize(("parts", "range_"), [(1, None), (4, None), (5, "3000b"), (2, "700b")])
def test_documents_against_the_tokenizer(spark, rows, monkeypatch, parts, range_):
    monkeypatch.setattr(token_ids, "LANES", 8)
    path = written(spark, rows, parts)
    if range_:
        spark.conf.set("spark.sql.files.maxPartitionBytes", range_)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = token_ids.read_documents(spark, path)
        assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and {t for _, t in got.dtypes} == {"bigint"}
        assert sorted(map(tuple, got.collect())) == brute(sorted(rows))
        # each part of a document stands in its place
        whole = token_ids.read_ids(spark, path).orderBy("first").collect()
        assert [r["first"] for r in whole] == [*np.cumsum([0] + [len(r["ids"]) for r in whole])[:-1]]
        assert sum(len(r["ids"]) for r in whole) == sum(x[2] for x in brute(rows))
        assert parts < 4 or len({r["doc_id"] for r in whole}) == len(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "b c"), (None, None), (4, "x y")] + [(4, "same")] * 500 + [(5, "z")]
    got = sorted(map(tuple, token_ids.read_documents(spark, written(spark, rows, 4)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None] * 2 + [4] * 501 + [5]
    assert [r[1] for r in got] == [*np.cumsum([0] + [r[2] for r in got])[:-1]]
    plain = {x[3] for x in brute(rows)}
    assert {r[3] for r in got} == plain


def test_missing_blocks_are_seen(spark, rows, monkeypatch):
    monkeypatch.setattr(id_coder, "BLOCK_IDS", 64)
    monkeypatch.setattr(id_coder, "GROUPS", 2)
    path = written(spark, rows, 1)
    blocks = [r["block"] for r in token_ids._stored_blocks(spark, path).collect()]
    assert len(blocks) > 20
    short = common.fresh_path(spark, "short")
    lost = spark.createDataFrame([(b,) for i, b in enumerate(blocks) if i != 5], "block binary").coalesce(1)
    lost.select(F.col("block").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", token_ids.MAGIC.decode("latin-1")).text(short)
    with pytest.raises(Exception, match="blocks are missing"):
        token_ids.read_documents(spark, short).collect()


def test_empty_table(spark):
    path = written(spark, [], 2)
    assert token_ids.read_documents(spark, path).collect() == [] and token_ids.read_ids(spark, path).collect() == []


def test_query_over_documents(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = registry.QUERIES["op11_token_ids"](spark, data)
    assert sorted(map(tuple, got.collect())) == brute(sorted(map(tuple, docs)))
