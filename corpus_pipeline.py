"""From raw documents to token ids: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.llm import common, mixing
from sparkgauge.llm.bpe import round_trip
from sparkgauge.llm.exact_dedup import drop_copies
from sparkgauge.llm.ngram_join import near_dedup
from sparkgauge.llm.quality_classifier import drop_rejected
from sparkgauge.llm.queries import byte_bpe


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among ``docs``, doesn't reject."""
    return drop_rejected(docs, common.read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the smallest doc_id."""
    return drop_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    return near_dedup(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the tree's weights; one that is taken in two epochs is there twice."""
    rows = docs.select(common.whole(docs).alias("row"), "doc_id", mixing.domain().alias("domain"), "lang", "source", mixing.n_tokens().alias("tokens"))
    return mixing.mix(rows, mixing.TREE, tokens="tokens").select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of token ids and the digests of its ids and of the bytes they decode to."""
    return round_trip(docs, byte_bpe(), keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_dedup),
    ("ngram_join", near_duplicates),
    ("source_mixing", source_mixing),
    ("byte_bpe", encoding),
]

#: SQL has no twin of the classifier; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each stage's rows written and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
