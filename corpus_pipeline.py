"""A training corpus from ``documents``: five stages, each a table written and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from slopeweave.llm import exact, packing, simhash, suffixes, toxicity
from slopeweave.llm.queries import TOKENIZER, table, toxicity_model
from slopeweave.session import cut


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity classifier rejects."""
    return toxicity.keep_harmless(docs, toxicity_model(spark, sf_dir))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.distinct_texts(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints."""
    return simhash.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold passages of the benchmark."""
    return suffixes.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens placed in sequences."""
    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", harmless), ("exact dedup", distinct), ("SimHash near-dedup", dissimilar),
          ("benchmark decontamination", uncontaminated), ("best-fit packing", sequences)]
# The classifier and the tokenizer are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared scratch folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
