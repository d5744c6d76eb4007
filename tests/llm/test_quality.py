from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from depotflow.llm import quality
from depotflow.llm.quality import STATISTICS, Model, text_statistics

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.98 * len(held)


def test_held_out_labels_and_other_columns_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    plain = {r["doc_id"]: r["score"] for r in quality.score(docs, labels).collect()}
    spoilt = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    renamed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None), "score": F.lit(9)})
    again = {r["doc_id"]: r["score"] for r in quality.score(renamed, spoilt).collect()}
    assert np.allclose([plain[i] for i in sorted(plain)], [again[i] for i in sorted(plain)])


def test_score_is_the_density_ratio():
    rng = np.random.default_rng(1)
    d = len(STATISTICS)
    x = [rng.normal(k, 1 + k, size=(500, d)) @ rng.normal(size=(d, d)) for k in (0, 1)]
    model = Model.fit({k: (500.0, x[k].sum(axis=0), x[k].T @ x[k]) for k in (0, 1)})
    points = np.concatenate(x)[::50]
    logit = np.zeros(len(points))
    for sign, k in ((-1, 0), (1, 1)):
        covariance = np.linalg.inv(model.whitening[k].T @ model.whitening[k])
        off = points / model.scale - model.means[k]
        logit += sign * (-0.5 * np.einsum("ni,ij,nj->n", off, np.linalg.inv(covariance), off) - 0.5 * np.linalg.slogdet(covariance)[1])
    assert np.allclose(model.score(points), 1 / (1 + np.exp(-np.clip(logit + model.prior, -500, 500))))


def test_statistics_of_odd_texts():
    x = text_statistics([b"", b"   ", b"\n", b"A", b"x" * 100_000, b"the the the the " * 50, "ÉÉÉ!!".encode()])
    assert x.shape == (7, len(STATISTICS)) and np.isfinite(x).all()
    assert x[5][STATISTICS.index("same_as_last")] > x[4][STATISTICS.index("same_as_last")]


def test_missing_labels_nulls_and_no_rows(frame):
    docs = frame("doc_id long, text string, predicted string", [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (3, "", "y")])
    labels = "doc_id long, quality int, toxic int"
    none = quality.score(docs, frame(labels, [])).collect()
    assert [(r["score"], r["predicted"]) for r in none] == [(0.5, 1)] * 4
    bad = quality.score(docs, frame(labels, [(1, 0, None), (1, None, 0), (3, 0, 0), (77, 1, 0)])).collect()
    assert all(r["score"] < 0.5 and r["predicted"] == 0 for r in bad)
    assert quality.score(frame("doc_id long, text string", []), frame(labels, [(1, 1, 0)])).count() == 0
