"""The corpus pipeline: quality filter, exact and near deduplication, source mixing, packing."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import exact_dedup, mixing, near_dups, packing, quality
from pressloom.llm.common import free_name, table
from pressloom.session import write_and_read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.5 or more); learned from ``labels`` outside the held-out third."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return quality.score(docs, model, score_col=score).where(F.col(score) >= 0.5).drop(score)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that links at 0.8 or more connect."""
    return near_dups.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of documents as often as the mix plays them, and the part of the one at the cut that still fits."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of binary lengths with their ids' checksum."""
    return packing.digests(packing.pack(docs))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("n-gram jaccard join", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A trained classifier and a tokenizer have no SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = table(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
