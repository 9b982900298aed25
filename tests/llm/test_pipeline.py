"""The pipeline against brute force, stage by stage, and the library without this subpackage."""

import os
import shutil
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuebook.llm import quality

from . import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / str(len(kept)))
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(out)
        after = spark.read.parquet(out)
        if name != "packing":
            assert after.columns == docs.columns
        kept[name] = (before, after)
        docs = after

    before, after = kept["quality classifier"]
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    assert ids(after) == ids(quality.score(spark.read.parquet(f"{SF}/documents.parquet"), model).filter("predicted = 1"))
    known = {r.doc_id: r.quality for r in labels.collect()}
    wrong = [i for i, _ in before if i in known and (i in set(ids(after))) != (known[i] == 1)]
    assert len(wrong) <= 0.02 * len(known)

    before, after = kept["exact dedup"]
    last = {}
    for i, t in before:
        last[t] = max(i, last.get(t, i))
    assert ids(after) == sorted(last.values())

    before, after = kept["minhash near-dedup"]
    assert ids(after) == [i for i, _, _, stays in brute.near(before, 5, 80) if stays]

    before, after = kept["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(after) == [r[0] for r in brute.contamination(before, items) if not r[5]]

    before, after = kept["packing"]
    pieces = after.collect()
    tokens = {}
    for p in pieces:
        tokens[p.doc_id] = tokens.get(p.doc_id, 0) + p.length
    assert tokens == {p.doc_id: p.doc_tokens for p in pieces} and sorted(tokens) == sorted(i for i, _ in before)


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns[:3] == ["doc_id", "start", "length"]


@pytest.mark.parametrize("at", [0, 2, 3, 4])
def test_workers_get_bounded_batches(spark, at):
    @F.arrow_udf("long")
    def size(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    texts = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))  # 20 MB in one partition
    try:
        spark.conf.unset(key)
        corpus_pipeline.STAGES[at][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).count()
        sizes = texts.select(size("text").alias("n")).agg(F.max("n"), F.count("n")).first()
        assert sizes[0] < corpus_pipeline.BATCH_BYTES + 100_000 and sizes[1] == 2000
        spark.conf.set(key, 1 << 20)  # a smaller bound of the session stays
        corpus_pipeline.bounded_batches(spark)
        assert spark.conf.get(key) in ("1048576", "1048576b")
    finally:
        spark.conf.set(key, before)


def test_entry_without_the_subpackage(tmp_path):
    for part in ("cuebook", "__spark_entry__.py"):
        src = os.path.join(REPO, part)
        copy = shutil.copytree if os.path.isdir(src) else shutil.copy
        copy(src, tmp_path / part)
    shutil.rmtree(tmp_path / "cuebook" / "llm")
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), [n for n in q if n.startswith('op')], 'pipeline' in q)"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split(" ", 1)[1].strip() == "[] False" and int(said.stdout.split()[0]) > 70
