"""Token counts with a digest cache.

A document's normalised content and the tokenizer's file have SHA-256 digests. A cache table holds the count of
each pair. Digests that the cache lacks are found by an anti-join without any text; one row of each is encoded,
and the new counts are appended to the cache; then all documents take their counts from it by a join.

With by_words, for a tokenizer that drops white space and never joins across it, normalising makes each run of
ASCII white space one space, and tasks encode each word once; for other tokenizers the content is the text.

Defined results: null counts as the empty text, which has no tokens; repeated rows count alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, checkpoint, fresh_path, join_counted, with_row_id
from .hashing import column, pieces

LIMIT = 2048
#: A task keeps the counts of so many words of at most so many bytes.
MEMO_WORDS, MEMO_BYTES = 500_000, 64


class Counter:
    """Counts the tokens of texts in a task. by_words: the text is the sum of its words, each encoded once."""

    def __init__(self, path: str, by_words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.by_words, self.memo = by_words, {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.encode = lambda texts: tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_words:
            return [len(x) for x in self.encode(texts)]
        split = [t.encode().split() for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new = list(set().union(*split) - self.memo.keys())
        known = dict(zip(new, map(len, self.encode([w.decode() for w in new]))))
        self.memo.update((w, n) for w, n in known.items() if len(w) <= MEMO_BYTES)
        lookup = self.memo | known if any(len(w) > MEMO_BYTES for w in known) else self.memo
        return [sum(map(lookup.__getitem__, words)) for words in split]


def file_digest(path: str) -> str:
    return hashlib.sha256(open(path, "rb").read()).hexdigest()


def count_tokens(docs: DataFrame, path: str, by_words: bool = False, limit: int = LIMIT, cache: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. cache: folder of the cache table, new if None.

    by_words: the tokenizer drops white space and never joins across it.
    """
    spark = docs.sparkSession
    version = file_digest(path)
    cache = cache or fresh_path(spark, "token-cache")
    schema = "digest binary, version string, n_tokens long"
    spark.createDataFrame([], schema).write.mode("append").parquet(cache)
    cached = lambda: spark.read.schema(schema).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    text = F.coalesce(F.col("text"), F.lit(""))
    content = F.regexp_replace(text, f"[{WS}]+", " ") if by_words else text
    numbered = with_row_id(docs.select("doc_id", "text"))
    rows = numbered.select("_rid", "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest"))
    rows = checkpoint(rows)
    each = checkpoint(rows.groupBy("digest").agg(F.min("_rid").alias("_rid"), F.count("*").alias("n")))
    missing = checkpoint(each.join(cached(), "digest", "left_anti").select("_rid", "digest"))

    def encode(batches):
        counter = Counter(path, by_words)
        for part in pieces(batches):
            n = counter.count([t or "" for t in column(part, "text").to_pylist()])
            yield pa.RecordBatch.from_arrays([column(part, "digest"), pa.array([version] * len(n)), pa.array(n, pa.int64())], ["digest", "version", "n_tokens"])

    # each missing digest has one row, so no row number is hot
    texts = numbered.select("_rid", "text").join(missing, "_rid").select("digest", "text")
    texts.mapInArrow(encode, schema).write.mode("append").parquet(cache)

    counted = checkpoint(each.drop("_rid").join(cached(), "digest"))
    out = join_counted(rows, counted, ["digest"])
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
