"""A training corpus from raw documents: each stage works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from depotflow.llm import decontaminate, mixing, quality, shards, simhash
from depotflow.llm.common import text_key
from depotflow.operators.bitmaps import without
from depotflow.session import stage, stage_result, unstage

SHARDS = 24
SHINGLE_WORDS, SIMILARITY = 5, 0.8
# Weights of the domains that `labels` tells apart. No document's rate falls below 1, so mixing repeats some and loses none.
TARGETS, BUDGET, LEAST_RATE = {"plain": 0.93, "toxic": 0.06, "junk": 0.01}, 1.25, 1.0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score says quality; what the classifier rejects goes.

    Every row is judged by its own text: null and shared ids have no say, a null text counts as empty, repeated rows share their fate,
    an empty table stays empty.
    """
    return without(docs, text_key(F.col("text")), stage(quality.rejected_texts(docs, _table(spark, sf_dir, "labels"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id (null ids last).

    Every row counts by its own text; of equal rows one stays. Texts without words are one group. An empty table stays empty.
    """
    return simhash.first_of_groups(docs, SHINGLE_WORDS, SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Every row is judged by its own text, whatever its id; null and empty texts hold nothing, repeated rows share their fate.
    """
    return decontaminate.remove_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate says, at least once, so that the domains come close to their target weights.

    Rows without an id draw by their text; repeated rows are repeated alike. An empty table stays empty.
    """
    labelled = _table(spark, sf_dir, "labels").select("doc_id", mixing.label_domain().alias("domain"))
    return mixing.resample(docs, lambda rows: mixing.mix(rows, labelled, TARGETS, BUDGET, LEAST_RATE))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and its slot there; shards are near equal in bytes, equal texts stay together.

    Ids have no say; a null text is empty. An empty table stays empty.
    """
    return shards.assign_shards(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("sharding", sharding),
]

# Fitted models, fingerprints and heaps have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages; what a stage returns is staged for the next, and what it or the one before staged goes then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        before, docs = docs, stage_result(lambda: step(spark, docs, sf_dir))
        if k:
            unstage(before)
    return docs
