"""Session helpers: shared work folder, bounded size probes, small-side broadcast."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of an Arrow batch that goes to Python. Rows alone do not bound it: texts are long,
# and lists of code points or tokens longer.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_NO_LIMIT = str(2**31 - 1)

# Upper bound of rows that may be broadcast; every broadcast is probed against it.
MAX_BROADCAST_ROWS = 200_000


def work_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster in ``spark.checkpoint.dir``.

    A local session without the setting (tests) gets a temporary folder. On a
    cluster the setting is required: a machine-local folder would not outlive
    or even reach the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="docflow-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared work folder."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, fixes the rows for later passes."""
    work_root(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(work_root(df.sparkSession))
    return df.checkpoint(eager=True)


def at_most(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has no more than ``rows`` rows. Reads at most ``rows + 1``."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only behind a row-count probe; else leave the join to AQE."""
    return F.broadcast(df) if at_most(df, rows) else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan that is one big split over the cores; other scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def stage_by(df: DataFrame, column: str) -> DataFrame:
    """Write a table once, laid out by ``column``, and go on from the files.

    Every branch below filters on the column and reads its own files only, so a
    document is parsed and read once however many branches there are.
    """
    path = work_path(df.sparkSession, "staged")
    df.withColumn("_part", F.coalesce(F.col(column), F.lit(""))).write.partitionBy("_part").parquet(path)
    back = df.sparkSession.read.schema(df.schema.add("_part", "string")).parquet(path)
    return back.withColumn(column, F.col("_part")).select(*df.columns)


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per context, as ``--py-files`` would.

    Batches to Python are bounded by bytes, unless the session has a bound of its own.
    """
    if spark.conf.get(_BATCH, _NO_LIMIT).rstrip("bB") == _NO_LIMIT:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_docflow_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='docflow-')}/docflow", "zip", package.parent, package.name
    )
    context.addPyFile(archive)
    context._docflow_shipped = True
