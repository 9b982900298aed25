"""The shared folder: a path without a scheme on a cluster, and no path at all."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark

from cuebook import session

REPO = Path(__file__).resolve().parents[1]

RUN = """
import json, sys
from pyspark.sql import SparkSession
from cuebook.plans.catalog import all_queries
from cuebook.session import checkpoint_dir
spark = SparkSession.builder.master(sys.argv[1]).config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1") \\
    .config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", sys.argv[2])
spark = (spark.config("spark.checkpoint.dir", sys.argv[3]) if sys.argv[3] else spark).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
try:
    said = [checkpoint_dir(spark), checkpoint_dir(spark.newSession()),
            *[all_queries()[q](spark, "/root/testdata/sf0.001").count() for q in ("signal_store_retry", "governed_truncated")]]
except RuntimeError as exc:
    said = ["refused", str(exc)]
print("SAID", json.dumps(said))
spark.stop()
"""


def said(tmp_path: Path, master: str, folder: str) -> list:
    """What RUN says in a process of its own, where no default names a folder."""
    home = tmp_path / "home"
    for p in (home, tmp_path / "conf", tmp_path / "cwd"):
        p.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():  # the executors' folders go to work in Spark's home
        if p.name not in ("work", "conf"):
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_CONF_DIR": str(tmp_path / "conf"), "SPARK_SCALA_VERSION": "2.13", "PYTHONPATH": str(REPO), "TMPDIR": str(tmp_path),
                        "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYTHONDONTWRITEBYTECODE": "1"}
    for inherited in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET"):
        env.pop(inherited, None)
    run = subprocess.run([sys.executable, "-c", RUN, master, str(tmp_path / "warehouse"), folder], env=env, cwd=tmp_path / "cwd",
                         capture_output=True, text=True, timeout=180)
    lines = [x for x in run.stdout.splitlines() if x.startswith("SAID ")]
    assert lines, run.stderr[-3000:]
    return json.loads(lines[0][5:])


def test_a_local_session_without_a_folder_gets_one(tmp_path):
    first, again, *counts = said(tmp_path, "local[2]", "")
    assert "cuebook-ckpt-" in first and "cuebook-ckpt-" in again and counts == [1, 50]


def test_a_cluster_without_a_folder_uses_its_warehouse(tmp_path):
    first, again, *counts = said(tmp_path, "local-cluster[2,1,1024]", "")
    assert first == f"file:{tmp_path}/warehouse/cue-checkpoints" and again.startswith(first) and counts == [1, 50]


def test_a_path_that_executors_do_not_share_is_refused(tmp_path):
    outcome, why = said(tmp_path, "local-cluster[2,1,1024]", "/proc/self/cwd/ckpt")  # each process works in a folder of its own
    assert outcome == "refused" and "not shared" in why


def test_a_shared_path_without_scheme_is_used_on_a_cluster(spark, tmp_path, monkeypatch):
    get, before = type(spark.conf).get, spark.sparkContext.getCheckpointDir()
    monkeypatch.setattr(session, "_is_local", lambda s: False)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: str(tmp_path / "shared") if key == "spark.checkpoint.dir" else get(self, key, *default))
    try:
        assert session.checkpoint_dir(spark) == f"file:{tmp_path}/shared"
        assert not [p for p in (tmp_path / "shared").iterdir() if p.name.startswith("cue-")]  # nothing stays of the trial
    finally:
        spark.sparkContext.setCheckpointDir(before)
