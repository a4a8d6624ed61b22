"""Session settings and the two ways to cut a lineage that survive the loss of an executor."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any size; sizes of partitions are left to the cluster's own configuration.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # files of a checkpoint go with its last DataFrame
}


def local_session(cores: int = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("cairn")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, wherever the driver was started: once a context, as one small archive that
    Spark hands out itself."""
    context = spark.sparkContext
    if getattr(context, "_cairn_shipped", False):
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="cairn-code-")) / "cairn.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(home.rglob("*.py")):
            out.write(source, source.relative_to(home.parent).as_posix())
    context.addPyFile(str(archive))
    context._cairn_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's own if it names one, else, in local mode only, a temporary one; as a
    full URI, so that all who write there mean the same file system."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if named is None and not re.match(r"local(\[[^-]|\Z)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="cairn-checkpoint-"))
    path = spark._jvm.org.apache.hadoop.fs.Path(named or spark.sparkContext.getCheckpointDir())
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def cut(df: DataFrame) -> DataFrame:
    """Evaluate df once and go on from its files in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
