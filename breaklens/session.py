"""Session settings for local runs, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def local_session(cores: str | int = "*", name: str = "breaklens") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.default.parallelism", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.files.minPartitionNum", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows: whole texts of a batch are held by the JVM and by its Python worker."""
    rows = int(spark.conf.get(BATCH_SETTING))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a folder of the warehouse where that is unset.

    A cluster's executors do not share local disks, so a warehouse on a local path is only taken with a
    local master.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{warehouse.rstrip('/')}/_scratch"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/breaklens/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def held(df: DataFrame) -> DataFrame:
    """Keep a step of an iteration on the executors' disks; what a lost executor held is computed again.

    Unlike `pin` it writes no files to the shared folder. Call unpersist() when the next step stands.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def pin(df: DataFrame, label: str, schema: StructType | None = None) -> DataFrame:
    """Write to the shared folder as Parquet and read back (as `schema`), for results that many jobs reuse."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)
