"""The queries of the language-model operators and their DuckDB oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, language_id, lm_score, merkle, mixing, near_dedup, periodic_runs, pii, quality, token_counts, token_ids, warc
from .common import fresh_path, table


def op1_pii(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark, sf_dir):
    groups = near_dedup.near_dedup(table(spark, sf_dir, "documents"), percent=85)
    return groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))  # of rows that repeat an id, all or none


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_lm_score(spark, sf_dir):
    return lm_score.language_scores(table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), path, by_words=True)


def op8_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.quality(table(spark, sf_dir, "documents"), labels)


def op11_token_ids(spark, sf_dir):
    path = fresh_path(spark, "token-ids")
    token_ids.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2, by_words=True)
    return token_ids.read_documents(spark, path)


def op12_merkle(spark, sf_dir):
    return merkle.verified_documents(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.run_digests(periodic_runs.planted(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_near_dedup": op2_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_lm_score": op4_lm_score,
    "op5_warc": op5_warc,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_decontaminate": op8_decontaminate,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_token_ids": op11_token_ids,
    "op12_merkle": op12_merkle,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op5_warc": warc.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op12_merkle": merkle.ORACLE,
}
