"""Audit events, sliding-log rate limits, usage accounting and key metadata. Batch operators that also run on streams where no group is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.windows import micros

#: Words of sensitive keys, sinks' event types, levels by severity.
SENSITIVE = ("api_key", "password", "token", "secret", "private_key", "ssn", "credit_card", "email", "phone", "address")
PRIVACY, TRANSFER = ("pii_detected", "security_violation"), ("data_export", "data_import")
SECURITY = ("pii_detected", "security_violation", "auth_failure")
SEVERITY = {"low": "info", "medium": "warning", "high": "error", "critical": "critical"}


def isin(c: Column, values: tuple[str, ...]) -> Column:
    return c.isin(*values)


def enrich(events: DataFrame) -> DataFrame:
    """events (event_type, level, message?, tags?) with tags that hold type and level, compliance_tags, and a default message."""
    t, lv = F.col("event_type"), F.col("level")
    empty = F.array().cast("array<string>")
    return (
        events.withColumn("message", F.when(F.coalesce("message", F.lit("")) == "", F.concat(t, F.lit(" event"))).otherwise(F.col("message")))
        .withColumn("tags", F.concat(F.coalesce("tags", empty), F.array(t, lv)))
        .withColumn("compliance_tags", F.concat(F.when(isin(t, PRIVACY), F.array(F.lit("privacy"))).otherwise(empty), F.when(isin(t, TRANSFER), F.array(F.lit("data_transfer"))).otherwise(empty)))
    )


def digest(*parts: Column) -> Column:
    """SHA-256 over the joint parts; null parts count as empty."""
    return F.sha2(F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def routes(events: DataFrame) -> DataFrame:
    """One row for each sink of each event: all to `daily`, some types to `security`, those with compliance tags to `compliance`."""
    sinks = F.array(F.lit("daily"), F.when(isin(F.col("event_type"), SECURITY), F.lit("security")), F.when(F.size("compliance_tags") > 0, F.lit("compliance")))
    return events.withColumn("sink", F.explode(F.array_compact(sinks)))


def sanitise(data: Column, sensitive: Column, limit: int = 100) -> Column:
    """A map's values: redacted where the key holds a sensitive word, cut after `limit` characters; unchanged if the event is not sensitive."""
    hit = lambda k: F.lower(k).rlike("|".join(SENSITIVE))
    return F.when(sensitive, F.transform_values(data, lambda k, v: F.when(hit(k), F.lit("[REDACTED]")).when(F.length(v) > limit, F.concat(F.left(v, F.lit(limit)), F.lit("..."))).otherwise(v))).otherwise(data)


def level(status: Column, risk: Column, failed: Column, severity: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return F.when(status >= 400, "error").when(risk > 0.7, "warning").when(failed, "error").when(severity.isNotNull(), F.coalesce(F.element_at(table, severity), F.lit("warning"))).otherwise("info")


def statistics(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def export(events: DataFrame, start=None, end=None, types: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Events from start to end (both inclusive) of the types; the limits reach the scan."""
    if start is not None:
        events = events.where(F.col(ts) >= F.lit(start))
    if end is not None:
        events = events.where(F.col(ts) <= F.lit(end))
    return events.where(F.col("event_type").isin(*types)) if types else events


def spans(events: DataFrame, key: str, ts: str, tie: str, begins: Column, ends: Column) -> DataFrame:
    """(key, started, duration_ms, ended): each begin with the next end of its key; no end gives null."""
    w = Window.partitionBy(key).orderBy(ts, tie).rowsBetween(1, Window.unboundedFollowing)
    d = events.withColumn("_next", F.min(F.when(ends, micros(F.col(ts)))).over(w))
    return d.where(begins).select(key, F.col(tie), ((F.col("_next") - micros(F.col(ts))) / 1000).alias("duration_ms"))


def limited(calls: DataFrame, api: str, ts: str, tie: str, seconds: int = 60, limit: int = 100) -> DataFrame:
    """calls with allowed: fewer than `limit` allowed calls of the api in the last `seconds`; denied calls do not count.

    The rule runs from call to call, but a pause of `seconds` clears it: each api's calls are split at such pauses, and the pieces are
    worked through by themselves, in order, by a function that holds no more than the last `limit` allowed calls. One api without a pause is one piece: one task streams it. Calls without a time are left out.
    """
    us = seconds * 1_000_000
    d = _near_before(calls, api, ts, us)
    tied = F.coalesce(F.lag("_us").over(Window.partitionBy(api, "_b").orderBy("_us", tie)) == F.col("_us"), F.lit(False))
    d = d.withColumn("_new", ((F.col("_before") == 0) & ~tied).cast("int"))
    # pieces are numbered within spans of the limit's length, and each span starts where the ones before end
    spans_ = d.groupBy(api, "_b").agg(F.sum("_new").alias("_s"))
    below = spans_.select(api, "_b", F.coalesce(F.sum("_s").over(Window.partitionBy(api).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"))
    inside = F.sum("_new").over(Window.partitionBy(api, "_b").orderBy("_us", tie).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_in", inside).join(below, [api, "_b"]).withColumn("_piece", F.col("_in") + F.col("_below")).select(*calls.columns, "_us", "_piece")
    schema = calls.schema.add("allowed", "boolean")

    def run(parts):
        from collections import deque

        import pandas as pd

        now, log = None, deque()
        for pdf in parts:
            out = []
            for name, piece, t in zip(pdf[api], pdf["_piece"], pdf["_us"]):
                at = (None if pd.isna(name) else name, piece)
                if at != now:
                    now = at
                    log.clear()
                while log and log[0] <= t - us:
                    log.popleft()
                ok = len(log) < limit
                if ok:
                    log.append(t)
                out.append(ok)
            yield pdf.drop(columns=["_us", "_piece"]).assign(allowed=out)

    return d.repartition(api, "_piece").sortWithinPartitions(api, "_piece", "_us", tie).mapInPandas(run, schema)


def _near_before(calls: DataFrame, api: str, ts: str, us: int) -> DataFrame:
    """calls with _us, _b (span of `us`), _recent (calls of the last `us`, this one and ties included) and _before (those strictly before it).

    A row looks back no further than the span before its own, so each span is worked on with the one before it, and a busy api is many tasks' work.
    """
    d = calls.withColumn("_us", micros(F.col(ts))).withColumn("_b", F.floor(F.col("_us") / us))
    d = d.withColumn("_k", F.explode(F.array("_b", F.col("_b") + 1)))
    w = Window.partitionBy(api, "_k").orderBy("_us")
    d = d.withColumn("_recent", F.count("*").over(w.rangeBetween(-us + 1, 0))).withColumn("_before", F.count("*").over(w.rangeBetween(-us + 1, -1)))
    return d.where("_k = _b").drop("_k")


def window_counts(calls: DataFrame, api: str, ts: str, seconds: int = 60) -> DataFrame:
    """calls with the number of calls of the api in the last `seconds`, denied or not."""
    return _near_before(calls, api, ts, seconds * 1_000_000).withColumn("recent_calls", F.col("_recent")).select(*calls.columns, "recent_calls")


def export_policy(size_mb: Column, limit: float = 100.0, enabled: bool = True, approval: bool = False) -> Column:
    """Reason for a denial, null if allowed."""
    return F.when(F.lit(not enabled), "disabled").when(size_mb > limit, "too large").when(F.lit(approval), "needs approval")


def retained(rows: DataFrame, ts: str, now: Column, days: float) -> DataFrame:
    return rows.where(micros(F.col(ts)) >= micros(now) - int(days * 86_400 * 1_000_000))


def health(events: DataFrame, ts: str, now: Column, limit: int = 10, minutes: int = 60) -> DataFrame:
    """recent events and the state they give."""
    d = events.agg(F.coalesce(F.sum((micros(F.col(ts)) > micros(now) - minutes * 60_000_000).cast("bigint")), F.lit(0)).alias("recent"))
    return d.withColumn("state", F.when(F.col("recent") > limit, "warning").otherwise("healthy"))


def mask(key: Column) -> Column:
    """Asterisks, but for the same few characters at both ends of keys longer than eight."""
    n = F.length(key)
    k = F.least(F.lit(4), F.floor(n / 4).cast("int"))
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(key, k), F.repeat(F.lit("*"), n - 2 * k), F.right(key, k)))


def key_statistics(keys: DataFrame, now: Column) -> DataFrame:
    """Per provider: keys, active and expired ones, usage. keys: provider, is_active, expires_at?, usage_count."""
    return keys.groupBy("provider").agg(F.count("*").alias("n_keys"), F.sum(F.col("is_active").cast("bigint")).alias("active"), F.sum(F.coalesce(F.col("expires_at") < now, F.lit(False)).cast("bigint")).alias("expired"), F.sum("usage_count").alias("usage"))


def permitted(permissions: Column, wanted: str) -> Column:
    """An empty or missing list permits everything."""
    return F.coalesce((F.size(permissions) == 0) | F.array_contains(permissions, wanted), F.lit(True))


def key_states(log: DataFrame, key: str = "name", action: str = "action", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last state of each key of an event log (store, get, rotate, deactivate, delete): usage and last use since the last store or rotate; deleted keys are gone."""
    start = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    d = log.withColumn("_gen", F.coalesce(F.sum(F.col(action).isin("store", "rotate").cast("int")).over(start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    live = d.where("_gen = 0").groupBy(key).agg(F.sum((F.col(action) == "get").cast("bigint")).alias("usage_count"), F.max(F.when(F.col(action) == "get", F.col(ts))).alias("last_used"), F.max_by(action, F.struct(ts, tie)).alias("_last"), F.bool_or(F.col(action) == "deactivate").alias("inactive"))
    return live.where("_last <> 'delete'").select(key, "usage_count", "last_used", (~F.col("inactive")).alias("is_active"))


def usage(calls: DataFrame, by: str = "model") -> DataFrame:
    """Per model: calls, tokens, cost, mean latency, output tokens per second, share of failed calls."""
    failed = F.lower(F.coalesce("finish_reason", F.lit(""))) == "error"
    return calls.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count("*").alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.sum("cost").alias("cost"),
        F.avg("latency").alias("mean_latency"),
        F.coalesce(F.try_divide(F.sum("output_tokens"), F.sum("latency")), F.lit(0.0)).alias("tokens_per_second"),
        F.avg(failed.cast("double")).alias("error_rate"),
    )


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def error_code(message: Column, family: str = "api") -> Column:
    """Code of an error message by its words; the first rule that fits holds."""
    m = F.lower(message)
    rules = {
        "api": ((("rate limit",), "rate_limit"), (("quota",), "quota_exceeded"), (("connection",), "connection_failed"), ((), "invalid_response")),
        "model": ((("connection", "download"), "download_failed"), (("corrupted", "invalid"), "corrupted"), ((), "load_failed")),
        "training": ((("out of memory", "oom"), "out_of_memory"), (("cuda",), "no_gpu"), ((), "failed")),
    }[family]
    out = None
    for words, code in rules:
        if not words:
            return out.otherwise(code)
        cond = F.lit(False)
        for w in words:
            cond = cond | m.contains(w)
        out = F.when(cond, code) if out is None else out.when(cond, code)
    return out


def access(limited_ok: Column, allowed: Column) -> Column:
    """Reason for a denial, null if granted; unknown flags deny."""
    return F.when(~F.coalesce(limited_ok, F.lit(False)), "rate limit exceeded").when(~F.coalesce(allowed, F.lit(False)), "permission denied")


def typed(kind: str, rows: DataFrame, id_col: str, ts: str, **data: Column) -> DataFrame:
    """Rows as events of one type, with their data as a map."""
    pairs = [x for k, v in data.items() for x in (F.lit(k), v.cast("string"))]
    return rows.select(F.col(id_col).cast("string").alias("event_id"), F.col(ts).alias("ts"), F.lit(kind).alias("event_type"), F.create_map(*pairs).alias("data"))


def text_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def redact_config(key: Column, value: Column) -> Column:
    return F.when(F.lower(key).contains("api_key"), "sk-***REDACTED***").when(F.lower(key).contains("encryption_key"), "***REDACTED***").otherwise(value)


def waits(calls: DataFrame, api: str, ts: str, tie: str, interval_s: float) -> DataFrame:
    """calls with wait_s: what is missing from the interval since the api's call before."""
    w = Window.partitionBy(api).orderBy(ts, tie)
    gap = (micros(F.col(ts)) - F.lag(micros(F.col(ts))).over(w)) / 1e6
    return calls.withColumn("wait_s", F.coalesce(F.greatest(F.lit(interval_s) - gap, F.lit(0.0)), F.lit(0.0)))
