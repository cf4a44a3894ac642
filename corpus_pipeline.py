"""Corpus pipeline: quality rules, line dedup, near-dedup, mixing, token ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on all that
the stage before it kept, and returns what is left. ``run`` writes each stage's result to the
shared folder as Parquet and gives the next stage what it reads back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulgrid.llm.bpe import bpe_round_trip
from haulgrid.llm.common import drop_path, materialize, table
from haulgrid.llm.line_dedup import duplicate_lines, without_lines
from haulgrid.llm.mixing import mix_sources, mixed_rows
from haulgrid.llm.quality_rules import fit_quality_model, keep_good
from haulgrid.llm.simhash import one_of_each, simhash_components


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs, fit_quality_model(docs, table(spark, sf_dir, "labels"), "quality", max_rows=4000))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or do so but for a character or a word, are cut from their documents."""
    left = without_lines(docs, duplicate_lines(docs, threshold=1, min_chars=20, least_words=8))
    return left.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in left.columns else left


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return one_of_each(docs, simhash_components(docs, radius=2, words_in_shingle=3, seed=42))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_rows(docs, mix_sources(docs, weights=(1, 2, 3), cap=3, seed=1))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of the mix."""
    out = bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", good_quality),
    ("line_dedup", unique_lines),
    ("simhash", unique_documents),
    ("mix_sources", mixed),
    ("bpe", token_ids),
]

#: SQL cannot express the learned verdict nor the byte pair merges; tests hold each stage
#: against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = materialize(stage(spark, docs, sf_dir), name)
        if before:  # the stage that read it is written
            drop_path(spark, before)
        before = path
    return docs
