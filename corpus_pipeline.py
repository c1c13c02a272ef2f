"""A corpus from raw documents to packed training sequences.

Stages, in order: language ID, toxicity, SimHash near-duplicates, mixing of sources, best-fit packing. All but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import langid, mixing, packing, simhash, toxicity
from tidemark.llm.common import read_table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus has labels for."""
    model = langid.fit_language_model(docs.select("doc_id", "lang", "text"))
    return langid.in_a_language(docs, model)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't hold for toxic."""
    model = toxicity.fit(toxicity.labelled_texts(docs, read_table(spark, sf_dir, "labels")))
    return toxicity.not_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each_group(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_id),
    ("toxicity", toxicity_filter),
    ("SimHash near-duplicates", near_duplicates),
    ("source mixing", source_mix),
    ("best-fit packing", packed_sequences),
]

#: No SQL expresses trained classifiers and searches by fingerprint; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
