"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Nothing here fixes a partition count: AQE coalesces and splits at run time.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # No call-site record per column expression: plans here have thousands of them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Filters are written out here, so inferring more of them gains nothing, and on
    # wide projections of dependent columns that inference grows exponentially.
    "spark.sql.constraintPropagation.enabled": "false",
    # A lookup join followed by an aggregate on the same key would otherwise
    # keep a hot key in one task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(
    app_name: str = "verdictflow",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings above; ``extra`` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(RECOMMENDED)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and hand-over tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        root = configured
    elif spark.sparkContext.master.startswith("local"):
        root = os.path.join(tempfile.gettempdir(), f"verdictflow-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", root)
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage and continue from there.

    Used where one result feeds several outputs, so an expensive input is not
    computed again for each of them and the loss of an executor costs nothing.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind: nobody reads them once the table is there.

    Otherwise they stay until the driver happens to collect its garbage, and a job of many steps
    holds the shuffles of all of them at once.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back column by column."""
    path = f"{checkpoint_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` has returned and that nothing reads any more; nothing that is made of them."""
    for table in tables:
        spark = table.sparkSession
        root = checkpoint_root(spark).rstrip("/")
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            # Only what stored() itself has named, below the shared folder.
            if folder.rpartition("/")[2].startswith("table-") and folder.rpartition("/")[0].rpartition("/")[2] == root.rpartition("/")[2]:
                target = spark._jvm.org.apache.hadoop.fs.Path(folder)
                target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
