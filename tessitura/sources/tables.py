"""Catalog tables in a folder: made where they are absent, brought to the current schema step by step.

A folder holds a table of applied steps and one folder for each table and schema version, so a step that fails or runs
again leaves the version before it whole; a step is applied once its row is there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators.catalog import SCHEMAS


@dataclass(frozen=True)
class Step:
    """A change of some tables to a schema version: name -> what makes the new table of the old ones."""

    version: int
    tables: dict[str, Callable[[dict[str, DataFrame]], DataFrame]]


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


#: The first version has the tables of the catalog, all empty; the second adds a table of sessions.
STEPS = [
    Step(1, {n: (lambda t, s=s: _empty(SparkSession.active(), s)) for n, s in SCHEMAS.items()}),
    Step(2, {"sessions": lambda t: _empty(SparkSession.active(), "session_hash string, token_hash string, created_at timestamp, last_used_at timestamp, expires_at timestamp, revoked_at timestamp")}),
]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def applied(spark: SparkSession, folder: str) -> dict[str, int]:
    """The version at which each table was last written; a row for each table and step."""
    if not _exists(spark, f"{folder}/_steps"):
        return {}
    rows = spark.read.schema("name string, version int").parquet(f"{folder}/_steps").groupBy("name").agg(F.max("version").alias("v")).collect()
    return {r.name: r.v for r in rows}


def opened(spark: SparkSession, folder: str, steps: list[Step] | None = None) -> dict[str, DataFrame]:
    """The tables of a folder after all steps that it lacks."""
    steps = STEPS if steps is None else steps
    have = applied(spark, folder)
    at = max(have.values(), default=0)
    tables = {n: spark.read.parquet(f"{folder}/{n}/v={v}") for n, v in have.items()}
    if at > max((s.version for s in steps), default=0):
        raise ValueError(f"the folder has schema version {at}, newer than this program's")
    for s in sorted((s for s in steps if s.version > at), key=lambda s: s.version):
        for name, make in s.tables.items():
            make(tables).write.mode("overwrite").parquet(f"{folder}/{name}/v={s.version}")
        # the step holds once all of its tables do: its rows are one file
        spark.createDataFrame([(n, s.version) for n in s.tables], "name string, version int").coalesce(1).write.mode("append").parquet(f"{folder}/_steps")
        tables |= {n: spark.read.parquet(f"{folder}/{n}/v={s.version}") for n in s.tables}
    return tables
