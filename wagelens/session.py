"""Session construction and the shared checkpoint folder.

On a cluster the checkpoint folder is named by ``spark.checkpoint.dir`` (a
shared file system such as HDFS or an object store); we only read it there.
A private folder is created only for a local master where it is unset.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans shuffles from runtime sizes,
# coalesces small partitions and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "wagelens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a private one only locally.

    Spark sets the context's folder from ``spark.checkpoint.dir`` at start-up
    (the conf cannot be changed later); with neither set, a local master gets
    a private folder and a cluster run fails loudly.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is unset: a cluster run needs a shared folder "
                "(set it in the cluster configuration)")
        path = tempfile.mkdtemp(prefix="wagelens-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if base.startswith("file:"):
        base = "/" + base[len("file:"):].lstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (what ``--py-files`` does).

    Skipped where the workers' PYTHONPATH has it already; else the driver adds
    a zip of the package, once per application, and Spark hands it out.
    """
    import os
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    sc = spark.sparkContext
    on_path = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.applicationId in _SHIPPED or any(Path(p).resolve() == root for p in on_path) or not root.is_dir():
        return
    zipped = shutil.make_archive(f"{tempfile.mkdtemp(prefix='wagelens-py-')}/wagelens", "zip",
                                 root_dir=root, base_dir="wagelens")
    sc.addPyFile(zipped)
    _SHIPPED.add(sc.applicationId)
