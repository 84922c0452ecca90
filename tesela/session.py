"""Session, table and materialisation helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[tuple[SparkSession, str]] = []


def get_spark(app: str = "tesela", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; clusters bring their own."""
    cpus = os.environ.get("BENCH_CPUS", "*")
    return reach_workers(
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TESELA_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def reach_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, wherever they are started.

    Clusters without a shared file system ship the package their own way (``--py-files``).
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the file may be one file or a folder of parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are costly to work on: spread over all cores if its files give too few splits."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``; a temporary folder only in local mode without it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), f"tesela-{os.getpid()}")
        os.makedirs(shared, exist_ok=True)
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that is emptied when the program ends."""
    path = f"{scratch_dir(spark)}/{name}"
    _SCRATCH.append((spark, path))
    return path


def _drop_scratch() -> None:
    for spark, path in _SCRATCH:
        local = path.removeprefix("file://")
        if local.startswith("/") and os.path.isdir(local):
            shutil.rmtree(local, ignore_errors=True)
            continue
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001 - the session may be gone; the cluster's own cleaning remains
            pass


atexit.register(_drop_scratch)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage with a written table in the shared folder: computed once, survives lost executors.

    Unlike ``checkpoint()`` the plan runs once only, and readers still get
    column pruning and pushed filters.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
