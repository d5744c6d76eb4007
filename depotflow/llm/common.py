"""What several operators share: text batches as byte arrays, staging, and the partition count of a job."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from depotflow.session import stage, stage_result, unstage

__all__ = ["SLICE_BYTES", "bound", "partitions", "reach_package", "stage", "stage_result", "text_key", "text_rows", "text_slices", "unstage"]

# Texts are worked on in slices of about so many bytes, so that temporary arrays stay small; one text is never split.
SLICE_BYTES = 2_000_000


def reach_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, also when it is not installed."""
    root, env = str(Path(__file__).parents[2]), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, as doc_id and text; a null text is empty. Other columns don't travel."""
    reach_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_key(text: Column) -> Column:
    """Tells texts apart; a null text is empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), 0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and UTF-8 texts of (doc_id, text) batches, in slices of about SLICE_BYTES."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
        start = 0
        while start < len(ids):
            end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), SLICE_BYTES, "right")))
            yield ids[start:end], texts[start:end].to_pylist()
            start = end
