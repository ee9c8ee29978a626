"""Ranks, shared tables and cut lineage, without gathering a group or the whole table in one task."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a folder of this machine if all work is done on it (tests); on a cluster that is an error."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if set_:
        return set_
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/lexloom-shared"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that later steps survive the loss of an executor; removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def remove() -> None:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the folder's owner clears it
            pass

    atexit.register(remove)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that one bucket of ranks should hold, and the least number of buckets.
PER_BUCKET, BUCKETS = 1 << 20, 1 << 12


def ranked(df: DataFrame, keys: list[str], u: Column, ties: str, name: str = "rank", buckets: int | None = None) -> DataFrame:
    """df with the row number (from 1) of each row within `keys`, by u (a number in [0, 1)) and then `ties`.

    Rows are numbered within buckets of u, and each bucket starts where the ones below end. A key with a third of all rows is
    thus numbered in many tasks; there are as many buckets as leave each with PER_BUCKET rows. Null keys are a key.
    """
    d = df.withColumn("_u", u)
    if buckets is None:
        n = df.groupBy().agg(F.greatest(F.lit(BUCKETS), F.ceil(F.count("*") / PER_BUCKET)).alias("_m"))
        d = d.crossJoin(F.broadcast(n)).withColumn("_b", F.floor(F.col("_u") * F.col("_m")).cast("bigint")).drop("_m")  # one row
    else:
        d = d.withColumn("_b", F.floor(F.col("_u") * buckets).cast("bigint"))
    for k in keys:
        d = d.withColumn(f"_k_{k}", F.coalesce(F.col(k).cast("string"), F.lit("\x00")))
    ks = [f"_k_{k}" for k in keys]
    count = d.groupBy(*ks, "_b").agg(F.count("*").alias("_n"))
    below = count.withColumn("_below", F.sum("_n").over((Window.partitionBy(*ks) if ks else Window.partitionBy()).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select(*ks, "_b", F.coalesce("_below", F.lit(0)).alias("_below"))  # one row for each bucket of a key
    inside = F.row_number().over(Window.partitionBy(*ks, "_b").orderBy("_u", ties))
    return d.withColumn("_i", inside).join(below, [*ks, "_b"]).withColumn(name, (F.col("_i") + F.col("_below")).cast("bigint")).select(*df.columns, name)


def running(df: DataFrame, order: str, value: Column, name: str = "before") -> DataFrame:
    """df with the sum of `value` over all rows before each by `order`: ranges of `order` are summed by themselves, and each starts with the sum of the ranges before."""
    parts = 2 * df.sparkSession.sparkContext.defaultParallelism
    # the ranges are found by sampling, so they are fixed in a table before they are used twice
    d = cut(df.withColumn("_v", value).repartitionByRange(parts, order).withColumn("_p", F.spark_partition_id()))
    total = d.groupBy("_p").agg(F.sum("_v").alias("_n"))
    below = total.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"))  # one row for each range
    inside = F.sum("_v").over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_v")
    return d.withColumn("_i", inside).join(below, "_p").withColumn(name, (F.col("_i") + F.col("_below")).cast("bigint")).select(*df.columns, name)


def numbered(df: DataFrame, order: str, name: str = "rn") -> DataFrame:
    """df with the row number (from 1) over the whole table by `order`."""
    return running(df, order, F.lit(1), "_before").withColumn(name, F.col("_before") + 1).drop("_before")
