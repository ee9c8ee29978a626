"""Series of events and training logs. Windows run within a key; series over a whole log are for logs of one run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970, of a timestamp with or without zone (read as UTC in a UTC session)."""
    return F.unix_micros(ts.cast("timestamp"))


def moving_mean(df: DataFrame, key: str, order: list[str], value: str, n: int = 10) -> DataFrame:
    """df with the mean of the last n values of each key."""
    return df.withColumn("moving_mean", F.avg(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)))


def patience(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """df with best (so far), improved, and waited: rows since the last improvement."""
    w = Window.partitionBy(key).orderBy(*order)
    d = df.withColumn("_before", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("improved", F.col("_before").isNull() | (F.col(value) > F.col("_before"))).withColumn("best", F.greatest("_before", value)).withColumn("_k", F.row_number().over(w))
    last = F.max(F.when(F.col("improved"), F.col("_k")))
    return d.withColumn("waited", (F.col("_k") - last.over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("bigint")).drop("_before", "_k")


def progress(df: DataFrame, key: str, ts: str, order: list[str], total: int) -> DataFrame:
    """df with done (rows so far), fraction, and rows per minute since the key's first row."""
    w = Window.partitionBy(key).orderBy(*order)
    d = df.withColumn("done", F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_s", (micros(F.col(ts)) - F.min(micros(F.col(ts))).over(Window.partitionBy(key))) / 1e6)
    return d.withColumn("fraction", F.col("done") / total).withColumn("per_minute", F.coalesce(F.col("done") / F.nullif(F.col("_s"), F.lit(0.0)) * 60, F.lit(0.0))).drop("_s")


def rebased(df: DataFrame, key: str, ts: str) -> DataFrame:
    """df with the seconds since the key's first row."""
    return df.withColumn("seconds", (micros(F.col(ts)) - F.min(micros(F.col(ts))).over(Window.partitionBy(key))) / 1e6)


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection over the size of the union of two arrays as sets; null if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
