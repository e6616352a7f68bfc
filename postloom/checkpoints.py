"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: a new temporary folder in local mode (tests), an error on a cluster, whose executors
    do not see the driver's temporary folders."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="postloom-")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def keeper(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """write(df, name): the rows as a Parquet table in a folder of its own within the shared one, which goes when the program ends."""
    root = f"{shared_folder(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"

    def clear() -> None:
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  at exit the JVM may be gone; the folder is scratch
            pass

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    atexit.register(clear)
    return write
