"""The stages of the corpus pipeline: language, quality, near-duplicates, mix, tokens.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next one's docs. All but the last return the columns of ``documents``; each works on all that the one before kept.

In every stage null texts count as empty, repeated rows are rows of their own unless the stage says otherwise, other columns pass
through whatever their names, and an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, langid, minhash, mixing, quality, shared


def site_path():
    return F.concat_ws("/", "source", "lang")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language, empty and null ones among them, or with no clear one, go."""
    return langid.accepted(docs)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier and their site's posterior judge bad go. A null source or lang is a site like any other."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, labels, F.col("source"), site_path())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five words, a Jaccard similarity of 0.8) stays, the one with the smallest id;
    rows of one id are one document, and of texts without any word one stays. SimHash with Golay keys and MinHash bands both give
    candidates, and each is verified."""
    return minhash.survivors(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. A null source is a source."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per row of the mix with its tokens' count and digests."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("quality", quality_filter), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

#: No SQL: the stages' models, fingerprints and byte-pair merges are beyond it. The tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
