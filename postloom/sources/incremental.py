"""Incremental reading of a source by channel: only what is newer than the last stored id of its channel, some rows of each at a time.

The state is the largest id taken from every channel, kept as a small table for each version beside the rows that were taken, and committed when both
are whole. A run that failed is done again by the next one; a committed one is never read twice. So every row of the source is taken exactly
once, by however many runs, as long as ids grow within a channel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChannelFeed:
    """A growing source (channel, id, ...), taken in portions into a folder that driver and executors share.

    per_channel: rows of a channel in a portion, the oldest new ones first. Rows without a channel or id cannot be placed and are never taken; rows
    of one channel and id are one message, the first of them by text if there are several.
    """

    spark: SparkSession
    root: str
    per_channel: int = 50

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, path = self._fs(f"{self.root.rstrip('/')}/commits")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def marks(self) -> DataFrame:
        """(channel, last_id): the largest id taken of each channel."""
        done = self.versions()
        return self.spark.read.parquet(f"{self.root}/marks/v={done[-1]}") if done else self.spark.createDataFrame([], "channel string, last_id long")

    def new(self, source: DataFrame) -> DataFrame:
        """The next portion: of each channel, the per_channel rows of the smallest ids above its mark. The rank is limited before the shuffle, and the
        marks, one row a channel, are joined by key."""
        marks = self.marks().select(F.col("channel").alias("of"), "last_id")
        s = source.where("channel is not null and id is not null")
        ahead = s.join(marks, s["channel"] == marks["of"], "left").where(F.col("last_id").isNull() | (F.col("id") > F.col("last_id"))).drop("of", "last_id")
        dense = Window.partitionBy("channel").orderBy("id")
        first = ahead.withColumn("nth", F.dense_rank().over(dense)).where(F.col("nth") <= self.per_channel)
        same = Window.partitionBy("channel", "id").orderBy("text")
        return first.withColumn("copy", F.row_number().over(same)).where("copy = 1").drop("nth", "copy")

    def poll(self, source: DataFrame) -> int:
        """Takes the next portion; the number of its rows (0: there is nothing new, and nothing is written)."""
        version = (self.versions() or [-1])[-1] + 1
        portion = self.new(source)
        portion.write.mode("overwrite").parquet(f"{self.root}/rows/v={version}")
        taken = self.spark.read.schema(portion.schema).parquet(f"{self.root}/rows/v={version}")
        n = taken.count()
        if n:
            marks = self.marks().unionByName(taken.groupBy("channel").agg(F.max("id").alias("last_id"))).groupBy("channel").agg(F.max("last_id").alias("last_id"))
            marks.write.mode("overwrite").parquet(f"{self.root}/marks/v={version}")
            fs, path = self._fs(f"{self.root}/commits/{version}")
            fs.create(path, True).close()
        return n

    def rows(self) -> DataFrame | None:
        """Everything taken so far."""
        done = self.versions()
        return self.spark.read.parquet(*(f"{self.root}/rows/v={v}" for v in done)) if done else None
