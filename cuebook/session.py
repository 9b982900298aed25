"""Session helpers: one place that builds a local session for tests/bench and resolves the
shared checkpoint folder.

On a cluster the session is created by the platform; this module only *reads* its settings.
``checkpoint_dir`` returns the folder named by ``spark.checkpoint.dir``; when nothing is set, one under
the system temp folder in local mode and one in the warehouse on a cluster.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # SQL on raw file paths (``parquet.`/x` ``) would bypass declared scopes.
    "spark.sql.runSQLOnFiles": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # HotSpot does not JIT methods over 8000 bytes of bytecode: leave whole-stage codegen for
    # such stages (large rule programs) instead of running them in the bytecode interpreter.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Call-site capture on every Column operation costs milliseconds per call on the driver
    # (stack walk); building a 100-rule program makes thousands of such calls.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # A checkpoint's files go when nothing refers to its frame any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "cuebook",
                  driver_memory: str = "8g") -> SparkSession:
    """A local session with the settings this library expects (tests, bench, examples)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    """Driver and executors are one process."""
    master = spark.conf.get("spark.master", "") or ""
    return master == "local" or master.startswith("local[")


_SHARED: set[tuple[str, str]] = set()  # (application, folder) that ``_check_shared`` has seen through


def _check_shared(spark: SparkSession, folder: str) -> None:
    """Raise unless files that executors write below ``folder`` are there for all: a few rows written and read again, once an application."""
    if (spark.sparkContext.applicationId, folder) in _SHARED:
        return
    probe = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/cue-shared-{uuid.uuid4().hex[:12]}")
    n, cause = max(2, spark.sparkContext.defaultParallelism), None
    try:
        spark.range(0, n, 1, n).write.parquet(probe.toString())
        read = spark.read.schema("id long").parquet(probe.toString()).count()
    except (PySparkException, Py4JJavaError) as exc:
        read, cause = 0, exc
    finally:
        probe.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(probe, True)
    if read != n:
        raise RuntimeError(f"{folder!r} is not shared by driver and executors ({read} of {n} rows written there came back); "
                           "set spark.checkpoint.dir to a folder that is") from cause
    _SHARED.add((spark.sparkContext.applicationId, folder))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and lineage-cutting tables.

    Reads ``spark.checkpoint.dir`` from the session, else the context's checkpoint folder. Without these, a
    local session gets a fresh temp folder (tests) and a cluster session a folder in its warehouse, which is shared as
    well. A full URI is taken as it is. A path without a scheme may be a shared mount or one machine's disk: on a
    cluster, one that resolves to the local file system is tried out and refused if it is not shared.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir()  # set already; setting it again would nest a folder in it
    given = bool(path) and ("://" in path or path.startswith("file:"))
    if not path:  # remembered by the context: Spark lets no running session set spark.checkpoint.dir
        path = tempfile.mkdtemp(prefix="cuebook-ckpt-") if _is_local(spark) else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/cue-checkpoints"
    if not _is_local(spark) and not given:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        path = system.makeQualified(hadoop).toString()
        if system.getScheme() == "file":
            _check_shared(spark, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for a named table or stream checkpoint."""
    base = checkpoint_dir(spark)
    sub = os.path.join(base, name) if "://" not in base else base.rstrip("/") + "/" + name
    return sub
