"""The registered query of each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cardwarden.llm.collocations import collocations
from cardwarden.llm.compression import compression_bands
from cardwarden.llm.decontaminate import find_leaks
from cardwarden.llm.lattice import lattice_scores
from cardwarden.llm.licenses import scan_licenses
from cardwarden.llm.line_crf import line_quality
from cardwarden.llm.mixing import mix_documents
from cardwarden.llm.near_dedup import near_duplicates
from cardwarden.llm.private_spans import find_private
from cardwarden.llm.substring_dedup import remove_repeats
from cardwarden.llm.toxicity import score_toxicity
from cardwarden.llm.url_filter import filter_urls
from cardwarden.llm.whitening import whiten
from cardwarden.llm.words import read_table

#: (verdict, host, path) of the URL rules.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op1_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(read_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: the canonical URLs of the pages whose id is divisible by 50."""
    pages = read_table(spark, sf_dir, "pages")
    judged = filter_urls(pages, pages.where("page_id % 50 = 0"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), size=2)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the chain's probabilities and whether it rejects it."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return score_toxicity(docs, labels)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(read_table(spark, sf_dir, "documents"))


def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def op13_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(read_table(spark, sf_dir, "documents"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_compression, op2_url_filter, op3_near_dedup, op4_substring_dedup, op5_toxicity,
        op6_mixing, op7_lattice, op8_line_crf, op9_licenses, op10_decontaminate,
        op11_whitening, op12_phrases, op13_private,
    )
}
