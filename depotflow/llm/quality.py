"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every text becomes a few shares and logarithms. The two classes get means and covariances from sums that Spark adds up;
each covariance is shrunk towards the pooled one and towards a multiple of the identity. A score is the logistic of the difference of log densities
plus that of the priors; a log density needs the squared Mahalanobis distance, the squared length of x - mean after whitening
with the Cholesky factor of the class. Factors and their inverses are computed once and travel with the model.

Nulls: a null text is empty; an empty text has statistics of zero and is scored like any other. Labels that are null don't count, and several
labels of one document count as their rounded mean. Without labels all scores are 0.5; with labels of one class only they
are that class's smoothed share. Repeated rows are scored as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from depotflow.llm.common import stage, text_key, text_rows, text_slices
from depotflow.llm.simhash import IS_SPACE, shingle_hashes

# Chosen by cross-validation inside the rows that may be learned from (remainders 0 and 2 of the checksum).
TO_POOLED, TO_IDENTITY = 0.70, 0.01
STATISTICS = ["upper", "symbols", "stops", "word_bytes", "same_as_last", "distinct"]
# Shares start from so many bytes or words of usual text, so that a few words alone are no evidence.
PRIOR_BYTES, PRIOR_WORDS = 60, 12

CODES = np.arange(256)
UPPER = (CODES >= 65) & (CODES <= 90)
LETTER = UPPER | ((CODES >= 97) & (CODES <= 122))
SYMBOL = np.isin(CODES, list(b"!\"#$%&*+/:;<=>@[\\]^_`{|}~"))
STOP = np.isin(CODES, list(b".,"))


def text_statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS for each text; shares go through the arcsine of the root, which evens out their spread."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = ends - [len(t) + 1 for t in texts]

    def count(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, starts, dtype=np.int64)

    size = ends - starts - 1
    upper, letters, spaces = count(UPPER[raw]), count(LETTER[raw]), count(IS_SPACE[raw]) - 1
    hashes, words = shingle_hashes(texts, 1)
    owner = np.repeat(np.arange(len(texts)), words)
    again = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner[1:][again], minlength=len(texts))
    order = np.lexsort((hashes, owner))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=len(texts))

    def share(part: np.ndarray, whole: np.ndarray, usual: float, prior: int) -> np.ndarray:
        return np.arcsin(np.sqrt(np.clip((part + usual * prior) / (np.maximum(whole, 0) + prior), 0, 1)))

    bytes_, some = PRIOR_BYTES, PRIOR_WORDS
    return np.column_stack(
        [
            share(upper, letters, 0.03, bytes_), share(count(SYMBOL[raw]), size, 0.0, bytes_), share(count(STOP[raw]), size, 0.025, bytes_),
            np.log1p((size - spaces + 5.5 * some) / (words + some)), share(repeats, words, 0.0, some),
            np.log((words + some) / (distinct + some)),
        ]
    )


def statistics(docs: DataFrame, carried: Column | None = None) -> DataFrame:
    """(doc_id, x: array of STATISTICS) of every row; `carried` may take the place of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            x = text_statistics(texts)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, x.ravel())], ["doc_id", "x"])

    rows = text_rows(docs)
    if carried is not None:
        rows = docs.select(carried.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


def held_out(doc_id: Column) -> Column:
    """Every third document by a checksum of its id; its label is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    """Log odds of the classes; of each class its mean, the inverse Cholesky factor, and half the log determinant."""

    prior: float
    means: list[np.ndarray]
    whitening: list[np.ndarray]
    half_log_det: list[float]
    scale: np.ndarray

    @staticmethod
    def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Model:
        """sums: by class, the number of rows, the sum of x, and the sum of the products of its parts."""
        n = {k: sums[k][0] if k in sums else 0.0 for k in (0, 1)}
        prior = float(np.log((n[1] + 1) / (n[0] + 1)))
        if not n[0] or not n[1]:
            return Model(prior, [], [], [], np.ones(1))
        means = [sums[k][1] / n[k] for k in (0, 1)]
        own = [sums[k][2] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
        pooled = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
        own, pooled = [c / np.outer(scale, scale) for c in own], pooled / np.outer(scale, scale)
        factors = []
        for k in (0, 1):
            mixed = (1 - TO_POOLED) * own[k] + TO_POOLED * pooled
            mixed = (1 - TO_IDENTITY) * mixed + TO_IDENTITY * max(np.trace(mixed) / len(mixed), 1e-6) * np.eye(len(mixed))
            factors.append(np.linalg.cholesky(mixed))
        half = [float(np.log(np.diag(f)).sum()) for f in factors]
        return Model(prior, [m / scale for m in means], [np.linalg.inv(f) for f in factors], half, scale)

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.prior)
        for sign, mean, white, half in zip((-1, 1), self.means, self.whitening, self.half_log_det):
            z = (x / self.scale - mean) @ white.T
            logit += sign * (-0.5 * np.square(z).sum(axis=1) - half)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Model from staged statistics and (doc_id, quality) of the rows that aren't held out; all of them count."""
    truth = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id")
    truth = truth.agg((F.avg("quality") >= 0.5).cast("int").alias("y"))

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for y, part in frame.groupby("y"):
                x = np.stack(part["x"].to_list())
                whole = np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))
                yield pd.DataFrame({"y": y, "at": np.arange(len(whole)), "part": whole})

    added = stats.join(truth, "doc_id").select("y", "x").mapInPandas(moments, "y int, at int, part double")
    d = len(STATISTICS)
    sums: dict[int, np.ndarray] = {}
    for r in added.groupBy("y", "at").agg(F.sum("part").alias("total")).collect():  # 2 * (1 + d + d * d) rows
        sums.setdefault(r["y"], np.zeros(1 + d + d * d))[r["at"]] = r["total"]
    return Model.fit({y: (s[0], s[1 : d + 1], s[d + 1 :].reshape(d, d)) for y, s in sums.items()})


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score from 0 to 1, predicted 0 or 1) of every row of `docs`."""
    stats = stage(statistics(docs))
    return _scored(stats, fit(stats, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def rejected_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text_key) of the texts that are predicted bad; labels are learned from by id, every row is judged by its own text."""
    both = F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"))
    stats = stage(statistics(docs, both))
    model = fit(stats.select("doc_id.doc_id", "x"), labels)
    keyed = stats.select(F.col("doc_id.text_key").alias("doc_id"), "x")
    return _scored(keyed, model).filter("score < 0.5").select(F.col("doc_id").alias("text_key")).distinct()


def _scored(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of (doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(len(batch), len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")
