"""Small helpers the operators share: tables cut into the shared folder, worker-side caches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources.tables import load_table

_WRITTEN: dict[str, list[str]] = {}
_CACHE: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_table(spark, sf_dir, name)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; ``release`` removes those of a session."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/cue-{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, safe when
    executors are lost, and still pruned by column."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession) -> int:
    """How many folders were made so far; give it to ``release`` to remove only later ones."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Remove this session's intermediate folders from the one numbered ``since`` on, but for the
    ``keep`` last ones, once no result that reads them is needed."""
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    end = len(paths) - keep
    for path in paths[since:end]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    del paths[since:end]


def text_of(col: str | Column) -> Column:
    """A text column with null as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(""))


def once(key, make: Callable):
    """A value made once in each Python worker (a tokenizer, a model)."""
    if key not in _CACHE:
        _CACHE[key] = make()
    return _CACHE[key]


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
