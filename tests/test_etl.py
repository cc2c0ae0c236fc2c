"""Ids and scratch folders at a size where ranges are sampled."""

import pytest
from pyspark.sql import functions as F

from tessitura import session
from tessitura.operators import etl


def test_next_ids_are_dense_and_ordered_over_many_rows(spark):
    n = 3_000_000
    d = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), (F.col("id") * 2).alias("part"), F.lit("x").alias("r"))
    out = etl.next_ids(d, "k", F.lit(5))
    got = out.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id"), F.sum("part")).first()
    assert tuple(got) == (n, n, 6, n + 5, n * (n - 1)) and sorted(out.columns) == ["id", "k", "part", "r"]
    low = out.where("id <= 1005").orderBy("id").select("k").collect()
    assert low == d.orderBy("k").limit(1000).select("k").collect()


def test_next_ids_of_nothing(spark):
    assert etl.next_ids(spark.createDataFrame([], "k string"), "k", F.lit(0)).count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master, getConf = "spark://host:7077", staticmethod(Conf)

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(Session)
