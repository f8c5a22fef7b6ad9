"""Session settings the operators rely on."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

# Runtime settings only, so they can be applied to a session somebody else built.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key is split even where that costs the following aggregate a shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The usual bound; set again here because the pipeline on training corpora turns automatic broadcasts off.
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
}

# Shuffles are cut finely and small parts merged, so that a task's share follows these sizes and not the size of the input.
# Sorted or hashed in memory it takes some 16 times its compressed size.
TABLE_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "480",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.files.maxPartitionBytes": "32MB",
}


def tune(spark: SparkSession, tables: bool = True) -> SparkSession:
    """Apply the runtime settings to an existing session, give its executors this package, and return it.

    The operators on training corpora size their own tasks and go without ``TABLE_SETTINGS``.
    """
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    for key, value in TABLE_SETTINGS.items():
        if tables:
            spark.conf.set(key, value)
        elif spark.conf.get(key, None) == value:
            spark.conf.unset(key)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to all Python workers once per application; functions travel to them by name only."""
    context = spark.sparkContext
    if getattr(context, "_pitchlake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    # Spark copies the archive into its own files at once; the folder is the driver's, not the executors'.
    with tempfile.TemporaryDirectory() as folder:
        archive = Path(folder, "pitchlake-package.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as target:
            for source in sorted(root.rglob("*.py")):
                target.write(source, source.relative_to(root.parent))
        kept = Path(SparkFiles.getRootDirectory(), archive.name)
        shutil.copy(archive, kept)
    context.addPyFile(str(kept))
    context._pitchlake_shipped = True


def local_session(cores: int | str = "*", *, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pitchlake")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
        # Recording a Python stack per column expression dominates the building of larger plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in (RUNTIME_SETTINGS | TABLE_SETTINGS).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the cluster's shared folder.

    ``spark.checkpoint.dir`` names it on a cluster.  Only a local master that has neither that setting
    nor a directory set through the API gets a temporary folder; elsewhere a missing setting is an error,
    because a machine-local folder would not survive the loss of an executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
        return
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="pitchlake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a plan go when it has run, not when the driver's heap happens to be collected.

    For plans that run once: a DataFrame that is made within and run twice shuffles its rows again.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


class Scratch:
    """A folder beside the checkpoints for rows that are kept for a while: as columns, compressed, and gone at the end of the block."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.path = f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The rows, written and read back."""
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")
