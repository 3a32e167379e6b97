"""Streams give what the batch operators give."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from penumbra.operators import statistics
from penumbra.streaming import online


def run(spark, df, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "in")
    rows = spark.range(60).select((F.col("id") % 3).alias("k"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("id") * 7)).alias("ts"), (F.col("id") * 37 % 11).cast("double").alias("v"))
    rows.orderBy("ts").coalesce(1).write.parquet(path)
    return path


def test_steady_state_over_a_stream(spark, folder):
    batch = spark.read.parquet(folder)
    out = run(spark, online.steady_state(spark.readStream.schema(batch.schema).parquet(folder), "k", "ts", "v"), "steady", "append")
    last = {r["key"]: r["ratio"] for r in out.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts")))).filter("n = 1").collect()}
    series = batch.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("ts", "v"))).alias("s"))
    want = {str(r["k"]): r["ratio"] for r in series.select("k", statistics.steady_state(F.transform("s", lambda e: e["v"])).alias("ratio")).collect()}
    assert last == pytest.approx(want)
    tests = statistics.prefix_tests(batch.withColumn("key", F.col("k").cast("string")), ["key"], ["ts"], "v").select("key", "ts", F.col("f").alias("want"))
    for r in out.join(tests, ["key", "ts"]).collect():
        assert (r["f"] is None) == (r["want"] is None) and (r["f"] is None or r["f"] == pytest.approx(r["want"]))


def test_windows_with_a_watermark(spark, folder):
    batch = spark.read.parquet(folder)
    out = run(spark, online.windowed_zonal(spark.readStream.schema(batch.schema).parquet(folder), "k", "ts", "v"), "zonal", "complete")
    assert out.agg(F.sum("n")).first()[0] == 60
