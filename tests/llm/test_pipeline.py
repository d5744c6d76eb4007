from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from depotflow.llm import quality
from depotflow.llm.common import text_key

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(corpus_pipeline.__file__).parent


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage kept, by name."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet").cache(), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
        out[name] = docs
    return out


def test_stages_keep_the_columns_of_documents(stages):
    columns = stages["documents"].columns
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == columns, name
    assert stages["sharding"].columns == [*columns, "size", "shard", "slot"]


def test_rejects_go_and_clean_documents_stay(spark, stages):
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages["quality_filter"].collect()}
    assert not [i for i, q in quality.items() if q == 0 and i in kept]
    assert sum(i in kept for i, q in quality.items() if q == 1) >= 0.98 * sum(q == 1 for q in quality.values())


def test_one_of_each_group_of_near_copies_stays(stages):
    from test_simhash import groups, shingles

    before = {r["doc_id"]: set(shingles(r["text"], 5)) for r in stages["quality_filter"].collect()}
    near = lambda a, b: len(before[a] & before[b]) >= 0.8 * len(before[a] | before[b])
    expected = {i for i, first in groups(sorted(before), near).items() if i == first}
    kept = [r["doc_id"] for r in stages["near_dedup"].collect()]
    assert len(kept) == len(set(kept)) and set(kept) == expected


def test_benchmark_passages_go(spark, stages):
    items = [r["text"].lower() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    holds = lambda text: any(t in text.lower() for t in items)
    before, after = (stages[n].collect() for n in ("near_dedup", "decontamination"))
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not holds(r["text"])} and len(after) < len(before)


def test_mixing_repeats_and_loses_none(stages):
    before, after = (stages[n].select("doc_id", "text").collect() for n in ("decontamination", "mix_sources"))
    assert set(after) == set(before) and len(after) > len(before)


def test_sharding_holds_every_row_once(stages):
    rows = stages["sharding"].collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in stages["mix_sources"].collect())
    where = {}
    assert all(where.setdefault(r["text"], r["shard"]) == r["shard"] for r in rows)


def test_run_gives_what_the_stages_give(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, got.select("doc_id", "shard", "slot").collect())) == sorted(
        map(tuple, stages["sharding"].select("doc_id", "shard", "slot").collect())
    )


def test_stages_survive_odd_rows_and_no_rows(spark, frame):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (2, "", "", "", 0), (None, "a b c", None, None, 5), (3, "word " * 3000, "en", "s", 15000)]
    for docs in (frame(schema, rows), frame(schema, [])):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        assert docs.count() >= 0


def test_rows_are_judged_by_their_texts_whatever_their_ids(spark, stages):
    """With every third id null and others shared, the same texts stay as with ids of their own; odd column names survive."""
    docs = stages["documents"].selectExpr("if(doc_id % 3 = 0, null, doc_id % 50) as doc_id", "text", "lang", "source", "n_chars", "doc_id as _id", "7.5D as rate")
    docs = docs.cache()
    bad = {r[0] for r in quality.rejected_texts(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()}
    keyed = {r["_id"]: r["k"] for r in docs.select("_id", text_key(docs["text"]).alias("k")).collect()}
    assert {r["_id"] for r in corpus_pipeline.quality_filter(spark, docs, FOLDER).collect()} == {i for i, k in keyed.items() if k not in bad}
    clean, found = (corpus_pipeline.decontamination(spark, d, FOLDER).collect() for d in (stages["documents"], docs))
    assert sorted(r["_id"] for r in found) == sorted(r["doc_id"] for r in clean)
    once = corpus_pipeline.near_dedup(spark, docs, FOLDER)
    assert once.columns == docs.columns and once.count() == corpus_pipeline.near_dedup(spark, stages["documents"], FOLDER).count()
    assert {r["rate"] for r in corpus_pipeline.mix_sources(spark, docs, FOLDER).collect()} == {7.5}


@pytest.mark.parametrize("gone", ["depotflow.llm", "corpus_pipeline"])
def test_entry_works_without_the_operators(gone):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        f"        if name == {gone!r} or name.startswith({gone!r} + '.'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'pipeline' not in e.queries() and 'op9_simhash' not in e.queries() and len(e.queries()) >= 62\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, timeout=120)
