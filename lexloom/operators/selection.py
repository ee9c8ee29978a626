"""Top-k, choices among models, and newest-first lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_k(scores: Column, k: int = 3) -> Column:
    """The k entries of an array<struct<label, p>> with the highest p; ties by label."""
    better = lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0)
    return F.slice(F.array_sort(scores, better), 1, k)


def performance(calls: DataFrame) -> DataFrame:
    """Per model: calls, mean latency and cost, tokens per second."""
    return calls.where("model is not null").groupBy("model").agg(F.count("*").alias("calls"), F.avg("latency").alias("average_latency"), F.avg("cost").alias("average_cost"), F.coalesce(F.try_divide(F.sum("output_tokens"), F.sum("latency")), F.lit(0.0)).alias("tokens_per_second"))


def candidates(models: DataFrame, perf: DataFrame, provider: str | None = None, budget: float | None = None, latency: float | None = None) -> DataFrame:
    """Models with their performance, within the limits; a limit of None or 0 is none. Models without calls have 0 in each figure."""
    d = models.join(perf.withColumnRenamed("model", "model_name"), "model_name", "left").fillna(0, ["calls", "average_latency", "average_cost", "tokens_per_second"])
    if provider:
        d = d.where(F.col("provider") == provider)
    if budget:
        d = d.where(F.col("average_cost") <= budget)
    if latency:
        d = d.where(F.col("average_latency") <= latency)
    return d


def cheapest(c: DataFrame) -> DataFrame:
    """The model of the lowest output price; ties by name."""
    return c.agg(F.min_by("model_name", F.struct("output_cost_per_1k", "model_name")).alias("model_name"))


def fastest(c: DataFrame) -> DataFrame:
    """The model of the lowest time per token, or of the lowest latency where there is no rate."""
    metric = F.when(F.col("tokens_per_second") > 0, 1 / F.col("tokens_per_second")).otherwise(F.col("average_latency"))
    return c.agg(F.min_by("model_name", F.struct(metric.alias("m"), "model_name")).alias("model_name"))


def first_of_ranking(c: DataFrame, ranking: DataFrame) -> DataFrame:
    """The candidate that stands highest in ranking (model_name, rank); the first by name if none is listed."""
    r = c.join(ranking, "model_name", "left")
    return r.agg(F.min_by("model_name", F.struct(F.coalesce("rank", F.lit(2**31 - 1)).alias("r"), "model_name")).alias("model_name"))


def balanced(c: DataFrame, preferred: DataFrame) -> DataFrame:
    """The first preferred candidate, else the cheapest."""
    p = c.join(preferred, "model_name").agg(F.min_by("model_name", "rank").alias("p"))
    return p.crossJoin(cheapest(c)).select(F.coalesce("p", "model_name").alias("model_name"))


def dispatch(c: DataFrame, strategy: str, ranking: DataFrame, default: str) -> DataFrame:
    """The choice by strategy (cost, speed, quality, balanced); the default if no candidate is left."""
    got = {"cost": cheapest, "speed": fastest, "quality": lambda x: first_of_ranking(x, ranking), "balanced": lambda x: balanced(x, ranking)}
    if strategy not in got:
        raise ValueError(f"unknown strategy {strategy}")
    return got[strategy](c).select(F.coalesce("model_name", F.lit(default)).alias("model_name"))


def fallback_order(preferred: Column, fallbacks: Column, defaults: list[str]) -> Column:
    """Names in order of trial, each once."""
    return F.array_distinct(F.filter(F.concat(F.coalesce(F.array(preferred), F.array()), F.coalesce(fallbacks, F.array()), F.array(*[F.lit(x) for x in defaults])), lambda x: x.isNotNull()))


def round_robin(df: DataFrame, order: str, members: int) -> DataFrame:
    """df with the pool member (from 0) that serves each row in turn."""
    from lexloom.functions.tables import numbered

    return numbered(df, order).withColumn("member", F.pmod(F.col("rn") - 1, F.lit(members)).cast("bigint")).drop("rn")


def least_used(c: DataFrame) -> DataFrame:
    return c.agg(F.min_by("model_name", F.struct("calls", "model_name")).alias("model_name"))


def recent(df: DataFrame, ts: str, tie: str, n: int = 50) -> DataFrame:
    """The n newest rows (a top-k: each task keeps n)."""
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def idle(last: DataFrame, now: Column, seconds: int, default: str, model: str = "model", ts: str = "last_call") -> DataFrame:
    """Models whose last call is longer ago than `seconds`, never the default."""
    return last.where((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")) > seconds * 1_000_000) & (F.col(model) != default))
