"""Session helpers for tests, the benchmark and local runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]")
             .appName("tabvet")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", driver_memory)
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; in local mode, where one
    machine holds everything, a scratch folder if the session sets none. A cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tabvet-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def run_folder(spark: SparkSession) -> str:
    """A new folder of this run under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tabvet-run-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` below ``folder`` (default: a new run folder) and read it back: later jobs start from files that survive
    lost executors, and nothing is computed twice."""
    path = f"{folder or run_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of one's own, wherever its file system is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder, replacing what the target held."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    fs = paths(source).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(paths(target), True)
    if not fs.rename(paths(source), paths(target)):
        raise OSError(f"could not move {source} to {target}")
