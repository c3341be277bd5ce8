"""The corpus pipeline: language ID, exact dedup, near dedup, source mixing, BPE round trip."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from coppice.llm import bpe_roundtrip, exact_dedup, language_id, near_dedup, poisson_mix
from coppice.llm.common import stage

#: Columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no letter, no text, or like no learned language go."""
    return language_id.drop_unidentified(docs).select(*COLUMNS)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the largest id."""
    return exact_dedup.drop_exact_copies(docs).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8) stays, the one with the smallest id."""
    return near_dedup.drop_near_copies(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson draws at the rates of their sources, in a shuffled order. Rows that share an id share its count; a null source is a source."""
    return poisson_mix.poisson_mix(docs, poisson_mix.source_rates(docs)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row for each copy; null texts count as empty."""
    return bpe_roundtrip.digests(bpe_roundtrip.bpe_roundtrip(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", identify),
    ("exact_dedup", dedup_exact),
    ("simhash", dedup_near),
    ("poisson_mix", mix),
    ("bpe_roundtrip", encode),
]

#: Fingerprints and tokens are beyond SQL; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read back as the next one's input.

    Null ids, shared ids, repeated rows, null, empty and very long texts are dealt with by the
    stages as their docstrings say: filters judge rows, not ids. Columns of documents beyond
    COLUMNS do not go on. Empty documents give an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs)
    return docs
