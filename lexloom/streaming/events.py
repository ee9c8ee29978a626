"""Audit events as streams: enrichment, counts in event-time windows, routing to sinks, and the sliding-log rate limit with state.

Each is a function of a streaming (or, but for the limiter, a batch) DataFrame; `run_once` works through what a source holds and stops.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexloom.functions.tables import shared_dir
from lexloom.operators import audit


def counts(events: DataFrame, ts: str = "ts", window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events by type and window; events later than `late` are dropped, and state older than that is let go."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    e = e.withWatermark(ts, late) if events.isStreaming else e
    return e.groupBy(F.window(ts, window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def route(events: DataFrame, folder: str, checkpoint: str):
    """A query that appends each event to the folders of its sinks, partitioned by day."""

    def write(batch: DataFrame, _: int) -> None:
        audit.routes(batch).withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("sink", "day").parquet(folder)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Limiter(StatefulProcessor):
    """The times of an api's allowed calls of the last `us` microseconds are its state, which ends with them."""

    def __init__(self, us: int, limit: int):
        self.us, self.limit = us, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getValueState("log", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(rows).sort_values(["us", "event_id"], kind="stable")
        log = [int(t) for t in self.log.get()[0]] if self.log.exists() else []
        out = []
        for t in pdf["us"].tolist():
            log = [x for x in log if x > t - self.us] if log and log[0] <= t - self.us else log
            ok = len(log) < self.limit
            if ok:
                log.append(t)
            out.append(ok)
        self.log.update((log,))
        yield pd.DataFrame({"event_id": pdf["event_id"], "event_type": pdf["event_type"], "allowed": out})

    def close(self) -> None:
        pass


def limited(calls: DataFrame, seconds: int = 60, limit: int = 100) -> DataFrame:
    """(event_id, event_type, allowed) of a stream of calls by event_type. Needs the RocksDB state store."""
    c = calls.select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return c.groupBy("event_type").transformWithStateInPandas(Limiter(seconds * 1_000_000, limit), "event_id bigint, event_type string, allowed boolean", "Append", "None")


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The stream's result on all that its source holds, as a table in the shared folder."""
    spark: SparkSession = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    else:

        def write(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{at}/out")

        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def read(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """A stream of the Parquet files of a folder whose names fit the pattern."""
    schema = spark.read.parquet(f"{path}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)
