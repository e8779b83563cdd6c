"""A corpus from raw documents to packed sequences, one stage after the other.

Each stage takes all rows that the one before kept and applies one operator of
``lodestone.llm``; its result is written and read again before the next begins.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import lodestone
from lodestone.llm import exact, language, mixing, neardup, packing
from lodestone.session import stored

NEAR_PERCENT = 80
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

# Python workers get the package's functions where it is not installed.
cloudpickle.register_pickle_by_value(lodestone)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a clear language; those without a letter or between languages go.

    Null and empty texts have no letter. Repeated rows are judged alike and each stay; whole
    texts are read, whatever their length. No documents: none.
    """
    return language.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per distinct text: of equal ones, repeated rows among them, one with the largest id.

    Null text counts as empty; texts of any length are compared whole. No documents: none.
    """
    return exact.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, per group linked by a similarity of 0.8 or more.

    Texts without words, null ones too, are alone in their groups; whole texts are compared. No
    documents: none.
    """
    return neardup.drop_near_duplicates(docs, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; null is a source of its own.

    A text without words, null or empty, has no size and counts nothing. No documents: none.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, with the documents in them; null text is empty, long ones span sequences.

    Repeated rows are packed each. No documents: no sequences.
    """
    return packing.pack_sequences(docs, TOKENIZER)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack),
]

# Compression, MinHash and tokenization are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
