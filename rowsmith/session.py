"""Session settings shared by the library, the bench and the tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Pages, archives and workbooks are large values; batches to Python stay small.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "rowsmith", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**BASE_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """Timestamps are UTC instants everywhere in this library."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Only a session without that setting (tests, a laptop) gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="rowsmith-checkpoint-")
    sc.setCheckpointDir(configured)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in reliable storage, so a lost executor never changes the rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: smaller than a checkpoint, as sure."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame, size: str = "8m") -> DataFrame:
    """Send at most ``size`` of rows to Python at once; a worker holds a batch in several forms."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def whole_files(spark: SparkSession, files: DataFrame) -> SparkSession:
    """A session of the same application whose file scans cut no file of ``files`` (with ``length``); small ones share a task."""
    sizes = files.selectExpr("coalesce(max(length), 0) AS largest", "coalesce(sum(length), 0) AS total").first()
    share = sizes["total"] // max(1, spark.sparkContext.defaultParallelism)
    own = spark.newSession()
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    own.conf.set("spark.sql.files.maxPartitionBytes", str(max(sizes["largest"], min(share, 128 << 20), 4 << 20)))
    return own


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name next to the checkpoints, where every executor can write and read."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/{name}-{uuid.uuid4().hex}"
