"""The live path: a stream of posts, filtered and deduplicated by key within a watermark, written as it comes; late rows and bad records beside it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import expressions as E


def incoming(spark: SparkSession, folder: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """A stream of Parquet files; offsets are the stream's own, so nothing is read twice or left out."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def classified(posts: DataFrame) -> DataFrame:
    """Posts with the filter's reason, theme, language and advertisement mark; narrow, so batch and stream agree."""
    return posts.withColumns({"reason": F.expr(E.rule_reason("text")), "theme": F.expr(E.theme("text")), "language": F.expr(E.language("text")), "is_ad": F.expr(E.is_ad("text"))})


def once(posts: DataFrame, keys: list[str], ts: str, lateness: str) -> DataFrame:
    """The first row of each key, with state bounded by the watermark. Late rows beyond it take the batch path."""
    return posts.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_counts(actions: DataFrame, ts: str, lateness: str, size: str, slide: str | None = None) -> DataFrame:
    """(start, action, n) per event-time window."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return actions.withWatermark(ts, lateness).groupBy(w.alias("w"), "action").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "action", "n")


def late(posts: DataFrame, ts: str, newest: object, lateness: str) -> DataFrame:
    """posts with behind: whether they are older than lateness before the newest event time that earlier batches saw (null: none yet)."""
    edge = F.lit(newest).cast("timestamp") - F.expr(f"interval {lateness}")
    return posts.withColumn("behind", F.coalesce(F.col(ts) < edge, F.lit(False)))


def two_paths(posts: DataFrame, ts: str, lateness: str, root: str, checkpoint: str) -> StreamingQuery:
    """A stream whose on-time rows and late rows are kept apart: root/on_time and root/late, a folder for each micro-batch, which a batch that is run
    again writes anew. Late: older than lateness before the newest time of the batches before. What there is, then stop."""
    spark = posts.sparkSession

    def write(batch: DataFrame, version: int) -> None:
        fs, path = _fs(spark, f"{root}/newest")
        marks = {int(v): int(t) for v, t in (s.getPath().getName().split("-") for s in fs.listStatus(path))} if fs.exists(path) else {}
        known = [t for v, t in marks.items() if v < version]
        newest = dt.datetime.fromtimestamp(max(known) / 1e6, dt.UTC) if known else None
        # kept once: the batch's rows are asked for three times, and what made them may be dear
        batch.dropDuplicates().write.mode("overwrite").parquet(f"{root}/batch/v={version}")
        kept = spark.read.schema(batch.schema).parquet(f"{root}/batch/v={version}")
        split = late(kept, ts, newest, lateness)
        for name, side in (("on_time", ~F.col("behind")), ("late", F.col("behind"))):
            split.where(side).drop("behind").write.mode("overwrite").parquet(f"{root}/{name}/v={version}")
        top = kept.agg(F.max(F.unix_micros(ts))).first()[0]
        if top is not None:
            fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/newest/{version}-{top}"), True).close()
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/batch/v={version}"), True)

    return posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, schema, root: str, keys: list[str], ts: str) -> DataFrame:
    """Both paths as one table: one row a key, the first by time. Late rows join by key, so the result is that of any order of arrival."""
    read = lambda name: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/{name}")
    both = read("on_time").unionByName(read("late"))
    rest = [c for c in both.columns if c not in keys]
    order = F.struct(F.col(ts).isNotNull(), ts, *(c for c in rest if c != ts))
    return both.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def parsed(raw: DataFrame, column: str, schema: str) -> DataFrame:
    """Records out of JSON texts: fields of the schema, and problem, which says why a record could not be read: 'empty', 'not json' or 'missing <field>' for
    a field declared not null. No record fails the batch."""
    fields = T.StructType.fromDDL(schema)
    open_ = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in fields), T.StructField("_broken", T.StringType(), True)])
    j = raw.withColumn("_r", F.from_json(column, open_, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    problem = F.when(F.coalesce(F.trim(column), F.lit("")) == "", "empty").when(F.col("_r").isNull() | F.col("_r._broken").isNotNull(), "not json")
    for f in fields:
        if not f.nullable:
            problem = problem.when(F.col(f"_r.`{f.name}`").isNull(), f"missing {f.name}")
    return j.select(*(c for c in raw.columns), *(F.col(f"_r.`{f.name}`").alias(f.name) for f in fields), problem.alias("problem"))


def isolated(raw: DataFrame, column: str, schema: str, work: Callable[[DataFrame], DataFrame], root: str, checkpoint: str) -> StreamingQuery:
    """Records through work, bad ones into a dead-letter table beside the results, counted in the same pass by an observation. root/results,
    root/dead (the raw text and its problem) and root/counts (good, bad) have a folder for each micro-batch."""

    def write(batch: DataFrame, version: int) -> None:
        seen = Observation()
        p = parsed(batch, column, schema).observe(seen, F.count_if(F.col("problem").isNull()).alias("good"), F.count_if(F.col("problem").isNotNull()).alias("bad"))
        p.write.mode("overwrite").parquet(f"{root}/parsed/v={version}")
        kept = batch.sparkSession.read.schema(p.schema).parquet(f"{root}/parsed/v={version}")
        work(kept.where("problem is null").drop("problem", column)).write.mode("overwrite").parquet(f"{root}/results/v={version}")
        kept.where("problem is not null").select(column, "problem").write.mode("overwrite").parquet(f"{root}/dead/v={version}")
        counts = seen.get
        batch.sparkSession.range(1).select(F.lit(counts["good"]).alias("good"), F.lit(counts["bad"]).alias("bad")).write.mode("overwrite").parquet(f"{root}/counts/v={version}")

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what there is and stops; running it again continues from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
