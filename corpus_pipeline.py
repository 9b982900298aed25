"""The corpus pipeline: quality, exact and near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage reads it from Parquet.
All but the last return the columns of ``documents``. It belongs to ``cuebook.llm``.

Texts go to the Python workers in Arrow batches of at most ``BATCH_BYTES``: by Spark's own bound of 10,000 rows a batch is tens of megabytes, which
JVM and worker both hold, in every running task. The bound is the session's and stays set, as results are computed later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuebook.llm import decontaminate, exact_dedup, odd_sketch, packing, quality
from cuebook.llm.common import mark, release, table, written

BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES``, or of less if the session says so. A longer text is a batch of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not reject."""
    bounded_batches(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal texts stays, that of the largest id. One micro-batch: the executors hold the memory of all five stages here."""
    return exact_dedup.keep_last(docs, batches=1)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8 or more."""
    bounded_batches(spark)
    return odd_sketch.keep_one(docs, k=5, percent=80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words of a benchmark item in a row."""
    bounded_batches(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens."""
    import public_tokenizers

    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("minhash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_free),
    ("packing", packed),
]

# SQL expresses neither the trained classifier nor the tokenizer; tests/llm checks run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        since = mark(spark)
        kept = stage(spark, docs, sf_dir)
        docs = written(kept, name.replace(" ", "-"))
        release(spark, since, keep=1)  # what the stage wrote for itself; its result was written last
    return STAGES[-1][1](spark, docs, sf_dir)
