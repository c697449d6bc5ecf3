"""Session settings shared by tests, the bench and jobs."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# What a Python worker is handed at a time: texts differ in length, so their bytes are bounded as well.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
           "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

# Correctness relies on the time zone only; the rest lets the runtime plan adapt.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a union of two shuffled sides must not rely on both keeping equal partition counts, as
    # the adaptive planner changes them side by side
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    **BATCHES,
}


def local_session(cpus: int | None = None, memory: str | None = None) -> SparkSession:
    """A local session for tests and the bench; ``KORVANE_MEMORY`` sets its heap."""
    memory = memory or os.environ.get("KORVANE_MEMORY", "8g")
    cpus = cpus or os.cpu_count() or 8
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("korvane")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Set what plans need in a session made elsewhere."""
    for key in ("spark.sql.unionOutputPartitioning", *BATCHES):
        spark.conf.set(key, SETTINGS[key])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local session may do without one (tests on one machine): it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="korvane-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/korvane/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str = "step"):
    """Write a step to the shared folder and read it back.

    Cuts the lineage of iterative or reused steps, survives the loss of executors, and gives
    the planner the true size of the step.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    step = df.sparkSession.read.schema(df.schema).parquet(path)
    step.step_path = path
    return step


def discard(*steps) -> None:
    """Delete steps written by ``materialize`` that no plan reads any more."""
    for step in steps:
        spark = step.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(step.step_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def unkept_listings(spark: SparkSession):
    """Files listed within leave the driver with the plan that reads them.

    Else Spark keeps the listings of all folders for later reads, up to 250 MB.
    """
    key = "spark.sql.hive.filesourcePartitionFileCacheSize"
    before = spark.conf.get(key)
    spark.conf.set(key, "0")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps.

    They go when the driver collects the steps' plans as garbage; a long chain of small steps
    gives it little reason to, while the files of all steps pile up on the executors.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
