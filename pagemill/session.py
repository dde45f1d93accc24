"""Session settings, durable lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only while its optimizer size estimate stays below this.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

# Rows and bytes of one Arrow batch between Spark and a Python worker; pages are long.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20

# With this off, sides that are both partitioned by page are joined on finer keys without a shuffle.
BY_PAGE = "spark.sql.requireAllClusterKeysForCoPartition"


def build_session(app: str = "pagemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        BY_PAGE: "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def short_batches(spark: SparkSession) -> None:
    """From now on Python workers get batches of bounded size, however large a split is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a scratch one only when unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
        return
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="pagemill-ckpt-", dir=os.environ.get("TMPDIR")))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for tables between stages."""
    _ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, and stops iterative plans from growing."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared checkpoint folder.

    For tables that several later steps read: they are computed once, survive executor loss, and
    each reader takes only its columns.
    """
    spark = df.sparkSession
    _ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate for a plan (no job is run)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast hint only below the limit; above it the join shuffles (AQE splits skewed keys)."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core when a small input comes in fewer splits than there are cores.

    Inputs of cluster size already come in many splits and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def by_page(df: DataFrame) -> DataFrame:
    """Partition by page where joins and windows below can use it; a page is bounded in size."""
    return df.repartition("page_id") if df.sparkSession.conf.get(BY_PAGE, "true") == "false" else df
