"""Session construction and the shared scratch folder.

Everything that must survive the loss of an executor (checkpoints, file
round trips) goes under the folder the cluster names in
``spark.checkpoint.dir``. We only invent one when the session has none,
which is the local/test case.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Bound Arrow batches by bytes as well as rows, so wide feature rows
    # (d or s in the thousands) never build huge numpy blocks per batch.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def get_spark(master: str | None = None, app: str = "rowmill",
              shuffle_partitions: int | None = None,
              conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that Arrow
    kernels import it there whatever folder the driver was started from."""
    sc = spark.sparkContext
    if getattr(sc, "_rowmill_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="rowmill-zip-"), "rowmill.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in (f for f in files if f.endswith(".py")):
                full = os.path.join(folder, f)
                z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._rowmill_shipped = True


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written tables.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir). Only when neither is set (tests, local runs) a fresh
    private folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster; "
                             "a machine-local temporary folder does not survive executor loss")
        conf_dir = tempfile.mkdtemp(prefix="rowmill-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique sub-path of the shared checkpoint folder."""
    root = checkpoint_root(spark)
    return root.rstrip("/") + f"/{name}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def cached(df: DataFrame) -> DataFrame:
    """Persist a frame re-read by an iterative loop; spills instead of
    recomputing when memory is short, recomputes from lineage if an
    executor is lost."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


__all__ = ["get_spark", "ship_package", "checkpoint_root", "scratch_path", "durable", "cached"]
