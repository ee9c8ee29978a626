"""Queries of personal data and audit (m), with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import audit as A
from lexloom.operators import pii, selection
from lexloom.plans.text_plans import _docs, q
from lexloom.streaming import events as S


def _t(name):
    return lambda s, d: s.read.parquet(f"{d}/{name}.parquet")


_events, _calls, _pii, _matches, _models = _t("events"), _t("generation_results"), _t("pii_results"), _t("pii_matches"), _t("model_info")
NOW = datetime.datetime(2024, 1, 15)
NOW_SQL = "timestamp '2024-01-15 00:00:00'"


def _r(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _log(s, d):
    """events in the shape of audit events."""
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "user_action", "signup", "data_import", "purchase", "data_export", "error", "security_violation", "click", "pii_detected")]), F.col("event_type"))
    return _events(s, d).select("event_id", "ts", kind.alias("event_type"), F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"), F.when(F.col("event_type") == "click", "clicked").alias("message"), F.lit(None).cast("array<string>").alias("tags"), "props")


LOG = "lg as (select event_id, ts, case event_type when 'view' then 'user_action' when 'signup' then 'data_import' when 'purchase' then 'data_export' when 'error' then 'security_violation' when 'click' then 'pii_detected' end event_type, case when event_type = 'error' then 'error' else 'info' end as level, case when event_type = 'click' then 'clicked' else coalesce(case event_type when 'view' then 'user_action' when 'signup' then 'data_import' when 'purchase' then 'data_export' when 'error' then 'security_violation' end, '') || ' event' end message, case when event_type in ('error', 'click') then 'privacy' when event_type in ('signup', 'purchase') then 'data_transfer' else '' end tags from events)"
RISK_SQL = "case pii_type " + " ".join(f"when '{k}' then {v}" for k, v in pii.RISK.items()) + " else 0.5 end"


def _clean_sql() -> str:
    out = "original_text"
    for k in ("email", "url", "credit_card", "ssn", "phone", "ip"):
        out = f"regexp_replace({out}, '{q(T.PERSONAL[k])}', '[{k.upper()}]', 'g')"
    return out


def _stored(s, d):
    """Scanned rows with their stored matches, in the shape that the detector gives."""
    m = _matches(s, d).groupBy("result_id").agg(F.collect_list(F.struct("pii_type", F.col("match_text").alias("text"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "confidence")).cast(pii.MATCHES).alias("matches"))
    return _pii(s, d).where("has_pii is not null").select("result_id", "has_pii", "risk_score").join(m, "result_id", "left").withColumn("matches", F.coalesce("matches", F.array().cast(pii.MATCHES)))


def _stream(s, d):
    return S.read(s, d, "events.parquet")


def _limiter(s, d):
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return S.run_once(S.limited(_stream(s, d), 3600, 20))


LUHN = "select event_id, len(g) between 13 and 19 and list_sum(list_transform(range(1, len(g) + 1), lambda i: case when i % 2 = 1 then g[i]::INT when g[i]::INT * 2 > 9 then g[i]::INT * 2 - 9 else g[i]::INT * 2 end)) % 10 = 0 ok from (select event_id, string_split(reverse('4' || lpad((event_id * 7919)::VARCHAR, 15, '0')), '') g from events)"

PLANS: dict[str, tuple] = {
    "m01_matches": (lambda s, d: pii.detect(_pii(s, d).select("result_id", "original_text"), "original_text").select("result_id", F.explode("matches").alias("m")).select("result_id", "m.*"), None),
    "m01_flags": (lambda s, d: pii.flags(_pii(s, d), "result_id", "original_text"), "select result_id, " + ", ".join(f"coalesce(regexp_matches(original_text, '{q(p)}'), false) {k}" for k, p in T.PERSONAL.items()) + " from pii_results"),
    "m02_luhn": (lambda s, d: _events(s, d).select("event_id", pii.luhn_valid(F.concat(F.lit("4"), F.lpad((F.col("event_id") * 7919).cast("string"), 15, "0"))).alias("ok")), LUHN),
    "m04_settled": (lambda s, d: pii.detect(_docs(s, d).select("doc_id", "text")).select("doc_id", F.size("matches").alias("n")), None),
    "m05_detected": (lambda s, d: pii.detect(_pii(s, d).select("result_id", "original_text"), "original_text").select("result_id", "cleaned_text", "has_pii", F.round("risk_score", 6).alias("risk_score")), None),
    "m06_removed": (lambda s, d: pii.detect(_pii(s, d).select("result_id", "original_text"), "original_text", mode="remove").select("result_id", "cleaned_text"), None),
    "m05_cleaned": (lambda s, d: _pii(s, d).select("result_id", pii.redact(F.col("original_text")).alias("cleaned")), f"select result_id, {_clean_sql()} cleaned from pii_results"),
    "m06_masked": (lambda s, d: pii.detect(_pii(s, d).select("result_id", "original_text"), "original_text", mode="mask").select("result_id", "cleaned_text"), None),
    "m07_risk": (lambda s, d: _r(_matches(s, d).groupBy("result_id").agg(F.collect_list("pii_type").alias("t")).select("result_id", pii.risk(F.col("t")).alias("risk"))), f"select result_id, round(least(max({RISK_SQL}) + least(count(*) * 0.1, 0.5), 1.0), 6)::DOUBLE risk from pii_matches group by 1"),
    "m08_summary": (lambda s, d: _r(pii.batch_summary(_stored(s, d))), "select count(*) total, sum(has_pii::INT)::BIGINT with_pii, round(avg(has_pii::INT), 6) rate, round(avg(risk_score), 6) mean_risk, sum((risk_score > 0.7)::INT)::BIGINT high_risk, (select count(*) from pii_matches m join pii_results r using (result_id) where r.has_pii is not null) n_matches from pii_results where has_pii is not null"),
    "m08_type_counts": (lambda s, d: pii.type_counts(_stored(s, d)), "select m.pii_type, count(*) n from pii_matches m join pii_results r using (result_id) where r.has_pii is not null group by 1"),
    "m09_decision": (lambda s, d: _matches(s, d).groupBy("result_id").agg(F.collect_set("pii_type").alias("t")).join(_pii(s, d).select("result_id", "risk_score", F.when(F.pmod("task_id", F.lit(2)) == 0, "review").otherwise("training_data").alias("p")), "result_id").select("result_id", pii.decision(F.col("t"), F.col("risk_score"), F.col("p")).alias("ok")), "select m.result_id, not (coalesce(any_value(risk_score), 0) > 0.7 or any_value(task_id) % 2 = 1 or bool_or(pii_type in ('ssn', 'credit_card', 'passport'))) ok from pii_matches m join pii_results using (result_id) group by 1"),
    "m10_enriched": (lambda s, d: A.enrich(_log(s, d)).select("event_id", "message", F.array_join("tags", ",").alias("tags"), F.array_join("compliance_tags", ",").alias("compliance")), f"with {LOG} select event_id, message, event_type || ',' || level tags, tags compliance from lg"),
    "m11_digest": (lambda s, d: A.enrich(_log(s, d)).select("event_id", A.digest(F.col("event_id"), F.col("event_type"), F.col("message")).alias("h")), f"with {LOG} select event_id, sha256(event_id || event_type || message) h from lg"),
    "m12_routes": (lambda s, d: A.routes(A.enrich(_log(s, d))).select("event_id", "sink"), f"with {LOG} select event_id, 'daily' sink from lg union all select event_id, 'security' from lg where event_type in ('pii_detected', 'security_violation', 'auth_failure') union all select event_id, 'compliance' from lg where tags <> ''"),
    "m13_sanitised": (lambda s, d: _calls(s, d).groupBy("call_id").agg(F.any_value("source").alias("source"), F.any_value("text").alias("text")).select("call_id", F.explode(A.sanitise(F.create_map(F.lit("user_email"), F.col("source"), F.lit("body"), F.coalesce("text", F.lit("")), F.lit("Token"), F.lit("x")), F.pmod("call_id", F.lit(2)) == 0)).alias("k", "v")), "with c as (select call_id, any_value(source) source, coalesce(any_value(text), '') as text from generation_results group by 1) select call_id, 'user_email' k, case when call_id % 2 = 0 then '[REDACTED]' else source end v from c union all select call_id, 'body', case when call_id % 2 = 0 and length(text) > 100 then left(text, 100) || '...' else text end from c union all select call_id, 'Token', case when call_id % 2 = 0 then '[REDACTED]' else 'x' end from c"),
    "m14_level": (lambda s, d: _events(s, d).select("event_id", A.level(F.when(F.col("event_type") == "error", 500).otherwise(200), F.col("value") / 500, F.col("value") < 1, F.when(F.col("event_type") == "click", "critical").when(F.col("event_type") == "view", "odd")).alias("level")), "select event_id, case when event_type = 'error' then 'error' when value / 500 > 0.7 then 'warning' when value < 1 then 'error' when event_type = 'click' then 'critical' when event_type = 'view' then 'warning' else 'info' end as level from events"),
    "m15_statistics": (lambda s, d: A.statistics(_events(s, d)), "select event_type, count(*) n from events group by 1"),
    "m15_window_counts": (lambda s, d: S.counts(_events(s, d), window="1 hour").select(F.unix_micros("start").alias("start_us"), "event_type", "n"), "select epoch_us(date_trunc('hour', ts)) start_us, event_type, count(*) n from events group by 1, 2"),
    "m15_stream_counts": (lambda s, d: S.run_once(S.counts(_stream(s, d), window="1 hour"), "complete").select(F.unix_micros("start").alias("start_us"), "event_type", "n"), "select epoch_us(date_trunc('hour', ts)) start_us, event_type, count(*) n from events group by 1, 2"),
    "m16_export": (lambda s, d: A.export(_events(s, d), datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 10), ["click", "view"]).select("event_id"), "select event_id from events where ts between timestamp '2024-01-05' and timestamp '2024-01-10' and event_type in ('click', 'view')"),
    "m17_spans": (lambda s, d: _r(A.spans(_events(s, d), "user_id", "ts", "event_id", F.col("event_type") == "view", F.col("event_type") == "purchase").select("event_id", "duration_ms")), "select event_id, round((nx - epoch_us(ts)) / 1000::DOUBLE, 6) duration_ms from (select *, min(case when event_type = 'purchase' then epoch_us(ts) end) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) nx from events) where event_type = 'view'"),
    "m18_limited": (lambda s, d: A.limited(_events(s, d).select("event_id", "ts", "event_type"), "event_type", "ts", "event_id", 3600, 20).select("event_id", "allowed"), None),
    "m18_stream_limited": (lambda s, d: _limiter(s, d).select("event_id", "allowed"), None),
    "m18_window_counts": (lambda s, d: A.window_counts(_events(s, d), "event_type", "ts").select("event_id", "recent_calls"), "select event_id, count(*) over (partition by event_type order by epoch_us(ts) range between 59999999 preceding and current row) recent_calls from events"),
    "m19_export_policy": (lambda s, d: _events(s, d).select("event_id", A.export_policy(F.col("value")).alias("denied")), "select event_id, case when value > 100 then 'too large' end denied from events"),
    "m20_retained": (lambda s, d: A.retained(_events(s, d), "ts", F.lit(NOW), 5).select("event_id"), f"select event_id from events where ts >= {NOW_SQL} - interval 5 day"),
    "m21_health": (lambda s, d: A.health(_events(s, d).where("event_type = 'error' and ts <= timestamp_ntz '2024-01-15 00:00:00'"), "ts", F.lit(NOW)), f"select count(*) filter (ts > {NOW_SQL} - interval 1 hour) recent, case when count(*) filter (ts > {NOW_SQL} - interval 1 hour) > 10 then 'warning' else 'healthy' end state from events where event_type = 'error' and ts <= {NOW_SQL}"),
    "m22_masked_keys": (lambda s, d: _t("customer")(s, d).select("c_custkey", A.mask(F.col("c_name")).alias("k")), "select c_custkey, case when n <= 8 then repeat('*', n) else left(c_name, w) || repeat('*', n - 2 * w) || right(c_name, w) end k from (select c_custkey, c_name, length(c_name) n, least(4, length(c_name) // 4) w from customer)"),
    "m22_key_statistics": (lambda s, d: A.key_statistics(_events(s, d).select(F.col("event_type").alias("provider"), (F.col("value") > 50).alias("is_active"), F.when(F.pmod("event_id", F.lit(3)) > 0, F.col("ts")).alias("expires_at"), F.pmod("event_id", F.lit(9)).alias("usage_count")), F.lit(NOW)), f"select event_type provider, count(*) n_keys, sum((value > 50)::INT)::BIGINT active, sum(coalesce(event_id % 3 > 0 and ts < {NOW_SQL}, false)::INT)::BIGINT expired, sum(event_id % 9)::BIGINT as usage from events group by 1"),
    "m22_permitted": (lambda s, d: _t("generation_tasks")(s, d).select("task_id", A.permitted(F.col("class_labels"), "spam").alias("ok")), "select task_id, coalesce(len(class_labels) = 0 or list_contains(class_labels, 'spam'), true) ok from generation_tasks"),
    "m24_usage": (lambda s, d: _r(A.usage(_calls(s, d))), "select model, count(*) calls, sum(input_tokens)::BIGINT input_tokens, coalesce(sum(output_tokens), 0)::BIGINT output_tokens, round(sum(cost), 6) cost, round(avg(latency), 6) mean_latency, round(coalesce(sum(output_tokens) / nullif(sum(latency), 0), 0), 6) tokens_per_second, round(avg((lower(coalesce(finish_reason, '')) = 'error')::INT), 6) error_rate from generation_results where model is not null group by 1"),
    "m25_token_estimate": (lambda s, d: _docs(s, d).select("doc_id", A.token_estimate(F.col("text")).alias("n")), "select doc_id, length(text) // 4 n from documents"),
    "m26_idle": (lambda s, d: selection.idle(_calls(s, d).where("model is not null").groupBy("model").agg(F.max("received_at").alias("last_call")), F.lit("2024-12-30 22:00:00").cast("timestamp"), 3600, "loam-7b").select("model"), "select model from generation_results where model is not null and model <> 'loam-7b' group by 1 having epoch_us(max(received_at)) < epoch_us(timestamp '2024-12-30 22:00:00') - 3600000000"),
    "m27_error_codes": (lambda s, d: _docs(s, d).select("doc_id", A.error_code(F.coalesce("text", F.lit(""))).alias("code"), A.error_code(F.coalesce("text", F.lit("")), "training").alias("training")), "select doc_id, case when contains(t, 'rate limit') then 'rate_limit' when contains(t, 'quota') then 'quota_exceeded' when contains(t, 'connection') then 'connection_failed' else 'invalid_response' end code, case when contains(t, 'out of memory') or contains(t, 'oom') then 'out_of_memory' when contains(t, 'cuda') then 'no_gpu' else 'failed' end training from (select doc_id, lower(coalesce(text, '')) t from documents)"),
    "m28_access": (lambda s, d: A.window_counts(_events(s, d), "event_type", "ts").select("event_id", A.access(F.col("recent_calls") <= 1, F.when(F.col("event_type") != "error", F.col("value") > 100)).alias("denied")), "select event_id, case when not n <= 1 then 'rate limit exceeded' when event_type = 'error' or not value > 100 then 'permission denied' end denied from (select *, count(*) over (partition by event_type order by epoch_us(ts) range between 59999999 preceding and current row) n from events)"),
    "m29_typed_events": (lambda s, d: A.typed("api_call", _calls(s, d).dropDuplicates(["call_id"]), "call_id", "requested_at", model=F.col("model"), tokens=F.col("total_tokens")).select("event_id", "event_type", F.element_at("data", "tokens").alias("tokens")), "select distinct call_id::VARCHAR event_id, 'api_call' event_type, total_tokens::VARCHAR tokens from generation_results"),
    "m29_text_hash": (lambda s, d: _docs(s, d).select("doc_id", A.text_hash(F.col("text")).alias("h")), "select doc_id, left(sha256(text), 16) h from documents"),
    "m30_key_states": (lambda s, d: A.key_states(_events(s, d).select("event_id", "ts", F.col("user_id").alias("name"), F.element_at(F.create_map(*[F.lit(x) for x in ("view", "get", "signup", "rotate", "purchase", "deactivate", "error", "delete", "click", "get")]), F.col("event_type")).alias("action"))).select("name", "usage_count", "is_active"), """with e as (select user_id as name, event_id, ts, case event_type when 'view' then 'get' when 'click' then 'get' when 'signup' then 'rotate' when 'purchase' then 'deactivate' else 'delete' end action from events),
        g as (select *, coalesce(sum((action = 'rotate')::INT) over (partition by name order by ts desc, event_id desc rows between unbounded preceding and 1 preceding), 0) gen from e), l as (select * from g where gen = 0) select name, sum((action = 'get')::INT)::BIGINT usage_count, not bool_or(action = 'deactivate') is_active from l group by 1 having arg_max(action, (ts, event_id)) <> 'delete'"""),
    "m31_redacted_config": (lambda s, d: _models(s, d).select("model_name", A.redact_config(F.when(F.col("supports_streaming"), "OPENAI_API_KEY").otherwise("encryption_key_1"), F.col("provider")).alias("v")), "select model_name, case when supports_streaming then 'sk-***REDACTED***' else '***REDACTED***' end v from model_info"),
    "m32_waits": (lambda s, d: _r(A.waits(_events(s, d), "event_type", "ts", "event_id", 30.0).select("event_id", "wait_s")), "select event_id, round(coalesce(greatest(30.0::DOUBLE - (epoch_us(ts) - lag(epoch_us(ts)) over (partition by event_type order by ts, event_id)) / 1e6::DOUBLE, 0), 0), 6) wait_s from events"),
}
PLANS["m03_confidence"] = (lambda s, d: _r(pii.detect(_pii(s, d).select("result_id", "original_text"), "original_text").select("result_id", F.explode("matches").alias("m")).groupBy("m.pii_type").agg(F.avg("m.confidence").alias("mean"), F.count("*").alias("n"))), None)
PLANS["m23_cost_estimate"] = (lambda s, d: _models(s, d).select("model_name", F.round(F.lit(1000) / 1000 * F.col("input_cost_per_1k") + F.lit(500) / 1000 * F.col("output_cost_per_1k"), 9).alias("cost")), "select model_name, round(1.0 * input_cost_per_1k + 0.5 * output_cost_per_1k, 9) cost from model_info")
