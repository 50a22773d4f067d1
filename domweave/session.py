"""Runtime settings the jobs in this package rely on."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Pages vary from a few hundred bytes to megabytes: bound Arrow batches by size.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # Partial results of a page stay small; the default of 128 keys makes nearly every task sort its input.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "32768",
    "spark.sql.session.timeZone": "UTC",
    # State of streams is kept outside the heap and saved as changes; arbitrary state with expiry needs it.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

#: Whether the shuffle files of an execution go when it ends, not when the driver next collects garbage.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings and make this package importable on the executors."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local["):
        # one process: its temporary folder is shared by all tasks
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="domweave-"))
    if not spark.conf.get("spark.domweave.parsePartitions", None) and spark.sparkContext.master.startswith("local["):
        # small tables of one file would be parsed by one core
        spark.conf.set("spark.domweave.parsePartitions", str(spark.sparkContext.defaultParallelism))
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="domweave-")) / "domweave"
        zipped = shutil.make_archive(str(archive), "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(zipped)
        _shipped.add(application)
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder; an error if none is configured."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str, **options: str) -> DataFrame:
    """The same rows as a table in the shared folder, for results that are used several times.

    Unlike a cache it survives the loss of executors.  What was shuffled for it is removed once it is written.
    ``options`` are those of the Parquet writer.
    """
    path, conf = work_dir(rows.sparkSession, name), rows.sparkSession.conf
    before = conf.get(REMOVE_SHUFFLES, None)
    conf.set(REMOVE_SHUFFLES, "true")
    try:
        rows.write.parquet(path, **options)
    finally:
        conf.unset(REMOVE_SHUFFLES) if before is None else conf.set(REMOVE_SHUFFLES, before)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
