"""A continuous scan: a directory stream of found packages whose batches update the package table.

Each batch writes a new snapshot and moves a pointer to it, so readers always see a whole one. A batch that runs again after
a failure finds its snapshot number taken by itself and writes the same rows, so updates happen once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessitura.operators import etl


def _path(folder: str, n: int) -> str:
    return f"{folder}/snapshot={n:010d}"


def latest(spark: SparkSession, folder: str, before: int | None = None) -> tuple[int, DataFrame]:
    """The number and rows of the last complete snapshot (before a number); -1 and no rows at the start."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    done = sorted(int(n.split("=")[1]) for n in names if n.startswith("snapshot=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))
    done = [n for n in done if before is None or n < before]
    if not done:
        return -1, spark.createDataFrame([], etl.PACKAGES)
    return done[-1], spark.read.schema(etl.PACKAGES).parquet(_path(folder, done[-1]))


def apply_batch(found: DataFrame, n: int, folder: str, sweep: bool = False) -> None:
    """One batch: its packages are added, updated, moved or marked invalid. A batch sees new files only, so packages that it
    doesn't see keep their status unless it is a whole listing (sweep)."""
    spark = found.sparkSession
    _, old = latest(spark, folder, n)
    table, _ = etl.scan(old, found.dropDuplicates(["path"]), f"b{n}")
    if not sweep:
        unseen = old.join(table.where(F.col("last_scan") == f"b{n}").select("id"), "id", "left_anti")
        table = table.where(F.col("last_scan") == f"b{n}").unionByName(unseen)
    table.write.mode("overwrite").parquet(_path(folder, n))


def watch(spark: SparkSession, source: str, folder: str, checkpoint: str, files_per_trigger: int = 1000) -> StreamingQuery:
    """Follow JSON lines of found packages in a directory; the rate limit is the back-pressure."""
    found = spark.readStream.schema(etl.FOUND).option("maxFilesPerTrigger", files_per_trigger).json(source)
    return found.writeStream.foreachBatch(lambda d, n: apply_batch(d, n, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums by type and event-time window, works on streams and tables alike."""
    d = events.withWatermark("ts", late) if events.isStreaming else events
    return d.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def replay(frames: DataFrame, key: str, order: str, from_frame: int, pre_roll: int = 32) -> DataFrame:
    """Frames from a position on with the pre-roll that a decoder needs before it; `wanted` tells them apart."""
    return frames.where(F.col(order) >= max(0, from_frame - pre_roll)).withColumn("wanted", F.col(order) >= from_frame)


def current(rows: DataFrame, generation: str, key: str) -> DataFrame:
    """Rows of the last generation of each key: what older runs still deliver is dropped."""
    last = rows.groupBy(key).agg(F.max(generation).alias(generation))
    return rows.join(last, [key, generation], "left_semi")
