"""From documents to packed training sequences: five stages, each an operator of lanewise.llm.

A stage takes (spark, docs, sf_dir), docs as read from Parquet, and all but the last return the columns of
docs. ``run`` writes each stage's result to the shared folder and reads it back as the next one's docs.

Texts that are null or have no letter are in no language and go in the first stage; given to a later one, a
null text stays null (personal data), is a component of its own (near-duplicates) and counts no token (mixture,
packing). Of repeated rows one remains after near-duplicates; in any other stage each is a document. Any column
may be null or have an operator's name, long texts are taken whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanewise.llm import language_id, mixing, near_dup, packing, pii
from lanewise.llm.common import cut, forget, table, written

#: No document is left out by the mixture: the budget covers each source once, and none more than so often.
REPETITIONS = 1.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labels name; others go."""
    return language_id.in_known_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dup.first_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.masked(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' weights ask for."""
    return mixing.repeated(docs, mixing.Mix(repetitions=REPETITIONS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packed),
]

#: Trained models, MinHash and tokenizers are beyond SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), written()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage{k}")
            forget(before)  # all that this stage was made of
    return docs
