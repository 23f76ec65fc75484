"""Session settings and the shared folder for data that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Right results need UTC timestamps; the rest lets Spark re-plan from measured sizes.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where the split costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Shuffle files of a query go when it ends, and not when the driver next collects garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings every plan here relies on to an existing session."""
    for name, value in _RUNTIME.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the local benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stateweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or a local one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stateweave-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared root."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a frame to a path and read it back; what was shuffled for it is freed as soon as it stands there."""
    spark = df.sparkSession
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: computed once, safe from lost executors."""
    return written(df, shared_path(df.sparkSession, label))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared root that nothing reads any more."""
    if not path.startswith(f"{shared_root(spark)}/") or ".." in path:
        raise ValueError(f"{path} is not below the shared root")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
