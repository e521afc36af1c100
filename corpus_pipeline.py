"""From raw documents to weighted training documents, in five stages of whole-table jobs.

Toxic documents go, one document of each group of near copies stays, passages repeated across
documents are cut, documents that leak benchmark items go, and what is left gets mixing rates.
Each stage's rows are written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwarden.llm.decontaminate import drop_leaks
from cardwarden.llm.mixing import mix_documents
from cardwarden.llm.near_dedup import drop_near_duplicates
from cardwarden.llm.substring_dedup import cut_repeats
from cardwarden.llm.toxicity import drop_toxic
from cardwarden.llm.words import read_table
from cardwarden.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Shares of the tokens of good and poor text. Toxic documents are gone by then; what is left of the
#: toxic posterior is above 0 in every document, so no rates bring it to 0, and it has no target.
TARGETS = {"good": 0.9, "poor": 0.1}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group that shares 0.8 of its five-word shingles."""
    return drop_near_duplicates(docs, size=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without 50-word windows that a smaller one holds; ``n_chars`` follows."""
    cut = cut_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, with its tokens, domain posteriors and rate."""
    return mix_documents(docs, read_table(spark, sf_dir, "labels"), TARGETS)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Classifiers, sketches and fitted rates have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
