"""Exact deduplication with stateful streaming. DataFrame and SQL functions only.

The rows' digests run as a stream through a keyed aggregation without watermark, so no state
ever expires. The state lives in RocksDB on the executors' disks and in the checkpoint folder;
for each digest it retains the identifier that stays, the locator of its content (file and row) and
the number of copies. Counts combine before the shuffle, so a group with a third of all rows is
one row a task. A table is ``BATCHES`` micro-batches (fewer where it has fewer files), so that each reads a
share of the digests and meets the state of those before. Each micro-batch writes the digests it changed into a folder of its number, so a
replay overwrites itself; values only grow, so the latest state is their maximum.

On hits (digests of several rows) the full bytes are compared with the row that stays. Rows
that differ, a collision of the digest, are grouped by their whole text instead.

Texts are equal when identical; null counts as empty. The row with the largest id stays; of rows
with equal text and id one stays (``keep_id`` is theirs, all are ``kept``), null ids stay only if all are
null. Repeated rows each get a row. Extra columns are ignored by ``exact_duplicates`` and kept by
``keep_last``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_folder, text_of, written
from .graph import counted

BATCHES = 4  # micro-batches for a table, whatever its size; later ones look the state of earlier ones up
# The state store: RocksDB, with bounded memory and small write buffers. A store is closed once its task
# has committed, so an executor's memory and disk follow its running tasks, not the number of partitions (an open
# store holds some megabytes of disk however few keys it has).
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def digest_of(text: Column) -> Column:
    return F.sha2(text, 256)


def _state(digests: DataFrame) -> DataFrame:
    """digest -> (largest id with its locator, copies); the same columns for rows and for states."""
    return digests.groupBy("digest").agg(F.max("kept").alias("kept"), F.sum("copies").alias("copies"))


def dedup_stream(rows: DataFrame, folder: str) -> None:
    """Run the streaming rows (digest, kept: struct<id, at>, copies) through the state; all that is
    available now. The changed states of batch N are in ``folder/changed/batch=N``."""

    def save(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/changed/batch={batch}")

    query = _state(rows).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint") \
        .trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()


def _size(spark: SparkSession, folder: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def states(docs: DataFrame, id_col: str, text_col: str, batch: int | None = None, partitions: int | None = None,
           digest: Callable[[Column], Column] = digest_of, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """(rows (id, digest), states (digest, id that stays, its locator, copies)). ``batch``: bytes of digest rows in a
    micro-batch, instead of ``batches``."""
    spark = docs.sparkSession
    text = text_of(docs[text_col])
    place = F.struct(docs[id_col].alias("id"), F.concat_ws("#", F.input_file_name(), F.monotonically_increasing_id().cast("string")).alias("at"))
    narrow = docs.select(digest(text).alias("digest"), place.alias("kept"), F.lit(1).cast("long").alias("copies"))
    folder = fresh_folder(spark, "dedup")
    narrow.write.parquet(f"{folder}/rows")
    batch = batch or max(1, -(-_size(spark, f"{folder}/rows") // batches))
    session = spark.newSession()  # the state store is set for this stream only
    session.conf.set("spark.sql.shuffle.partitions", str(partitions or spark.conf.get("spark.sql.shuffle.partitions")))
    for key, value in STATE_CONF.items():
        session.conf.set(key, value)
    stream = session.readStream.schema(narrow.schema).option("maxBytesPerTrigger", batch).parquet(f"{folder}/rows")
    dedup_stream(stream, folder)
    rows = spark.read.schema(narrow.schema).parquet(f"{folder}/rows").select(F.col("kept.id").alias("id"), "digest")
    if rows.isEmpty():
        return rows, _state(spark.read.schema(narrow.schema).parquet(f"{folder}/rows"))
    changed = spark.read.parquet(f"{folder}/changed")
    return rows, changed.groupBy("digest").agg(F.max("kept").alias("kept"), F.max("copies").alias("copies"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: int | None = None,
                     partitions: int | None = None, digest: Callable[[Column], Column] = digest_of, batches: int = BATCHES) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row; the last is the ``digest``."""
    rows, state = states(docs, id_col, text_col, batch, partitions, digest, batches)
    # Written, so that the joins with it are of plain tables, where Spark may split a hot digest.
    state = written(state.select("digest", F.col("kept.id").alias("keep_id"), F.col("copies").alias("group_size")), "state")
    hits = written(state.filter("group_size > 1"), "hits")
    # Full bytes: the texts of hits only, against the text that stays.
    text = text_of(docs[text_col])
    texts = docs.select(docs[id_col].alias("id"), text.alias("t"), digest(text).alias("digest")) \
        .join(counted(hits), "digest")
    stays = texts.filter(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.max("t").alias("stay"))
    other = written(texts.join(stays, "digest").filter("t <> stay").groupBy("digest", "t")
                    .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), "collisions")
    joined = rows.join(state, "digest")
    if not other.isEmpty():
        joined = _apart(docs, state, stays, other, id_col, text, digest)
    return joined.select(F.col("id").alias(id_col), "keep_id", "group_size",
                         F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def _apart(docs: DataFrame, state: DataFrame, stays: DataFrame, other: DataFrame, id_col: str, text: Column,
           digest: Callable[[Column], Column]) -> DataFrame:
    """The rows with their groups where a digest has several texts: by the whole text."""
    odd = other.groupBy("digest").agg(F.sum("group_size").alias("less"))
    own = docs.select(docs[id_col].alias("id"), text.alias("t"), digest(text).alias("digest"))
    clean = own.join(odd, "digest", "left_anti").select("id", "digest").join(state, "digest")
    mixed = own.join(odd, "digest").join(state, "digest")
    first = mixed.join(stays, "digest").filter("t = stay").select("id", "digest", "keep_id", (F.col("group_size") - F.col("less")).alias("group_size"))
    rest = mixed.select("id", "digest", "t").join(other, ["digest", "t"]).select("id", "digest", "keep_id", "group_size")
    return clean.select("id", "digest", "keep_id", "group_size").unionAll(first).unionAll(rest)


def keep_last(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """The rows of ``docs``, all columns, that stay. A row goes by its id and digest, as an id may be on several texts."""
    gone = written(exact_duplicates(docs, id_col, text_col, batches=batches).filter("not kept")
                   .select(F.col(id_col).alias("_cue_gone"), F.col("text_sha256").alias("_cue_digest")).distinct(), "gone")
    return docs.join(counted(gone), docs[id_col].eqNullSafe(F.col("_cue_gone"))
                     & (digest_of(text_of(docs[text_col])) == F.col("_cue_digest")), "left_anti")
