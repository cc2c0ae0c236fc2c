"""Session construction and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no spark.checkpoint.dir (local tests).
LOCAL_SCRATCH = "/tmp/checkpoints"
_SCRATCH: set[str] = set()


def local_session(app: str = "tessitura", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A single-JVM session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The application's folder under spark.checkpoint.dir, which every executor shares; it is deleted when the
    application's JVM ends. Where that setting is absent a local session has a folder of its own, a cluster is refused."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = LOCAL_SCRATCH
    path = f"{root}/tessitura-{context.applicationId}"
    if path not in _SCRATCH:
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(context._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
        _SCRATCH.add(path)
    return path


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """What runs within gives Python workers about so many bytes at once: for rows that are large each."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def staged(df: DataFrame, name: str, compression: str = "zstd", **options) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and a lost
    executor costs a re-read of the table instead of a recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression=compression, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
