"""Queries of joins (g), selection (h), windows (i) and parsing (j), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import corpus, evaluation, generate, joins, parsing, quality, sampling, selection, windows
from lexloom.plans.evaluation_plans import PROBS
from lexloom.plans.text_plans import SPACE, TOKS, _docs, _samples, scores_sql


def _t(name):
    return lambda s, d: s.read.parquet(f"{d}/{name}.parquet")


_calls, _models, _tasks, _events = _t("generation_results"), _t("model_info"), _t("generation_tasks"), _t("events")
PERF = "perf as (select model as model_name, count(*) calls, avg(latency) average_latency, avg(cost) average_cost, coalesce(sum(output_tokens) / nullif(sum(latency), 0), 0) tps from generation_results where model is not null group by 1), cand as (select m.*, coalesce(calls, 0) calls, coalesce(average_latency, 0) average_latency, coalesce(average_cost, 0) average_cost, coalesce(tps, 0) tps from model_info m left join perf using (model_name))"
RANKING = [("loam-7b", 1), ("heron-small", 2)]
RANK_SQL = "(values ('loam-7b', 1), ('heron-small', 2)) r(model_name, rank)"
CHEAP = "(select model_name from cand order by output_cost_per_1k, model_name limit 1)"


def _cand(s, d, **k):
    return selection.candidates(_models(s, d), selection.performance(_calls(s, d)), **k)


def _rank(s):
    return s.createDataFrame(RANKING, "model_name string, rank int")


def _r(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


EDGE = "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$"
ARR = f"""a as (select call_id, regexp_replace(text, '{EDGE}', '', 'g') t from (select call_id, any_value(text) as text from generation_results group by 1)), b as (select call_id, t, instr(t, '[') s, substr(t, instr(t, '[')) r from a),
  j as (select call_id, case when s = 0 then null when contains(r, ']') then substr(t, s, length(t) - instr(reverse(t), ']') + 1 - s + 1) when contains(r, '}},') then left(r, length(r) - instr(reverse(r), ',}}')) || ']' end arr from b)"""
J3 = f"""with {ARR}, o as (select call_id, json_extract(arr, '$[*]') js from j where json_valid(arr)), e as (select call_id, unnest(js) x, generate_subscripts(js, 1) k from o),
  p as (select call_id, k, regexp_replace(json_extract_string(x, '$.text'), '{EDGE}', '', 'g') as text, coalesce(json_extract_string(x, '$.label'), '') as label, coalesce(json_extract(x, '$.confidence')::DOUBLE, 0.8) confidence from e),
  q as (select *, row_number() over (partition by call_id order by k) - 1 pos from p where length(text) >= 10) select call_id, pos, text, label, round(confidence, 6) confidence from q where pos < 25"""


def _once_calls(s, d):
    return _calls(s, d).groupBy("call_id").agg(F.any_value("text").alias("text"))


BATCH = "b0 as (select task_id, samples_per_class n, task_description, class_labels, unnest(case when len(languages) > 0 then languages else ['en'] end) as language from generation_tasks where samples_per_class > 0), b1 as (select *, unnest(class_labels) as label from b0), b2 as (select *, unnest(range(1, (ceil(n / 25) + 1)::BIGINT)) batch_no from b1), b as (select *, least(25, n - (batch_no - 1) * 25)::BIGINT batch_size from b2)"



def _stub(prompt: str) -> str:
    """A teacher for tests: fails for one prompt in sixteen, else gives as many samples as the prompt asks for."""
    import hashlib
    import json

    h = hashlib.md5(prompt.encode()).hexdigest()
    if h[0] == "0":
        raise RuntimeError("no answer")
    return "Here you are: " + json.dumps([{"text": f"Sample number {i} of {h}", "confidence": 0.9} for i in range(int(prompt.split()[1]))])


PLANS: dict[str, tuple] = {
    "n01_generate": (lambda s, d: generate.generate(_tasks(s, d), _stub).groupBy("task_id").agg(F.count(F.when(F.col("source") == "generated", 1)).alias("n_generated"), F.count(F.when(F.col("source") == "fallback", 1)).alias("n_fallback")), f"with {BATCH}, p as (select task_id, batch_size, 'Write ' || batch_size || ' texts in ' || language || ' of class \"' || label || '\" (classes: ' || array_to_string(class_labels, ', ') || '). Task: ' || coalesce(task_description, '') || '. Answer with a JSON array of objects with text, label and confidence.' prompt from b) select task_id, sum(case when left(md5(prompt), 1) = '0' then 0 else batch_size end)::BIGINT n_generated, sum(case when left(md5(prompt), 1) = '0' then batch_size else 0 end)::BIGINT n_fallback from p group by 1"),
    "g01_with_truth": (lambda s, d: joins.with_truth(evaluation.nearest_centroid(_t("embeddings")(s, d), "vec_id").select("vec_id", "predicted"), _t("embeddings")(s, d), "vec_id"), f"with {PROBS} select vec_id, cl predicted, label true_label from top where k = 1"),
    "g02_similar_pairs": (lambda s, d: corpus.near_pairs(_samples(s, d), "sample_id", threshold=0.95).select("id_a", "id_b"), f"""with d as (select sample_id doc_id, text from samples where text <> ''), x as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '{TOKS}')) w from d), n as (select doc_id, count(*) n from x group by 1),
        key as (select doc_id, string_agg(w, chr(1) order by w) k from x group by 1), rep as (select min(doc_id) r from key group by k), y as (select * from x where doc_id in (select r from rep)), p as (select a.doc_id a, b.doc_id b, count(*) i from y a join y b on a.w = b.w and a.doc_id < b.doc_id group by 1, 2)
        select a id_a, b id_b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where i / (na.n + nb.n - i) >= 0.95 - 1e-9"""),
    "g03_decode_labels": (lambda s, d: joins.decode(sampling.encode_labels(_samples(s, d)).select("sample_id", "label_id"), sampling.label_ids(_samples(s, d))).select("sample_id", "decoded_label"), "select sample_id, label as decoded_label from samples"),
    "g04_priced_calls": (lambda s, d: joins.priced(_calls(s, d), _models(s, d)).groupBy("call_id").agg(F.round(F.max("estimated_cost"), 9).alias("estimated_cost")), "select call_id, round(max(coalesce(input_tokens / 1000 * input_cost_per_1k + output_tokens / 1000 * output_cost_per_1k, 0)), 9) estimated_cost from generation_results left join model_info on model = model_name group by 1"),
    "g05_missing_classes": (lambda s, d: joins.missing_classes(_samples(s, d), _tasks(s, d).select(F.explode("class_labels").alias("label")).unionAll(s.createDataFrame([("no such class",)], "label string"))), "select distinct label from (select unnest(class_labels) as label from generation_tasks union all select 'no such class') where label not in (select label from samples where label is not null)"),
    "g06_not_listed": (lambda s, d: joins.not_listed(_tasks(s, d).select("task_id"), s.read.parquet(f"{d}/quality_metrics.parquet").where("pii_detected").select("task_id"), "task_id"), "select task_id from generation_tasks where task_id not in (select task_id from quality_metrics where pii_detected)"),
    "g07_listed_words": (lambda s, d: joins.containing(_t("pii_results")(s, d), _t("name_lexicon")(s, d), "result_id", "original_text"), f"select result_id, word from (select distinct result_id, unnest(regexp_extract_all(lower(original_text), '{TOKS}')) word from pii_results) where word in (select lower(entry) from name_lexicon)"),
    "h01_top_k": (lambda s, d: _r(evaluation.nearest_centroid(_t("embeddings")(s, d), "vec_id").select("vec_id", F.posexplode("top_k").alias("pos", "x")).select("vec_id", (F.col("pos") + 1).cast("bigint").alias("k"), F.col("x.label").alias("label"), F.col("x.p").alias("p"))), f"with {PROBS} select vec_id, k, cl as label, round(p, 6) p from top where k <= 3"),
    "h02_cheapest": (lambda s, d: selection.cheapest(_cand(s, d)), f"with {PERF} select {CHEAP} model_name"),
    "h03_fastest": (lambda s, d: selection.fastest(_cand(s, d)), f"with {PERF} select model_name from cand order by case when tps > 0 then 1 / tps else average_latency end, model_name limit 1"),
    "h04_highest_ranked": (lambda s, d: selection.first_of_ranking(_cand(s, d), _rank(s)), f"with {PERF} select model_name from cand left join {RANK_SQL} using (model_name) order by coalesce(rank, 2147483647), model_name limit 1"),
    "h05_balanced": (lambda s, d: selection.balanced(_cand(s, d), _rank(s)), f"with {PERF} select coalesce((select model_name from cand join {RANK_SQL} using (model_name) order by rank limit 1), {CHEAP}) model_name"),
    "h06_candidates": (lambda s, d: _r(_cand(s, d, budget=0.01, latency=6.0).select("model_name", "calls", "average_latency", "average_cost", "tokens_per_second")), f"with {PERF} select model_name, calls, round(average_latency, 6) average_latency, round(average_cost, 6) average_cost, round(tps, 6) tokens_per_second from cand where average_cost <= 0.01 and average_latency <= 6"),
    "h07_fallback_order": (lambda s, d: _tasks(s, d).select("task_id", F.array_join(selection.fallback_order(F.get("class_labels", F.lit(0)), F.col("class_labels"), ["ham", "neutral", "x"]), ",").alias("names")), "select task_id, array_to_string(list_filter(class_labels || ['ham', 'neutral', 'x'], lambda v, i: list_position(class_labels || ['ham', 'neutral', 'x'], v) = i), ',') names from generation_tasks"),
    "h08_round_robin": (lambda s, d: selection.round_robin(_samples(s, d).select("sample_id"), "sample_id", 4), "select sample_id, (row_number() over (order by sample_id) - 1) % 4 as member from samples"),
    "h08_least_used": (lambda s, d: selection.least_used(_cand(s, d)), f"with {PERF} select model_name from cand order by calls, model_name limit 1"),
    "h09_recent_events": (lambda s, d: selection.recent(_events(s, d), "ts", "event_id", 50).select("event_id"), "select event_id from events order by ts desc, event_id desc limit 50"),
    "h10_ranked_models": (lambda s, d: selection.performance(_calls(s, d)).agg(F.max_by("model", F.struct("calls", "model")).alias("most_used"), F.min_by("model", F.struct("average_latency", "model")).alias("quickest")), f"with {PERF} select (select model_name from perf order by calls desc, model_name desc limit 1) most_used, (select model_name from perf order by average_latency, model_name limit 1) quickest"),
    "h12_dispatch_cost": (lambda s, d: selection.dispatch(_cand(s, d, provider="no such provider"), "cost", _rank(s), "heron-small"), "select 'heron-small' model_name"),
    "h12_dispatch_quality": (lambda s, d: selection.dispatch(_cand(s, d), "quality", _rank(s), "heron-small"), f"with {PERF} select model_name from cand left join {RANK_SQL} using (model_name) order by coalesce(rank, 2147483647), model_name limit 1"),
    "h12_dispatch_balanced": (lambda s, d: selection.dispatch(_cand(s, d), "balanced", _rank(s), "heron-small"), f"with {PERF} select coalesce((select model_name from cand join {RANK_SQL} using (model_name) order by rank limit 1), {CHEAP}) model_name"),
    "h12_dispatch_speed": (lambda s, d: selection.dispatch(_cand(s, d), "speed", _rank(s), "heron-small"), f"with {PERF} select model_name from cand order by case when tps > 0 then 1 / tps else average_latency end, model_name limit 1"),
    "h13_lookup": (lambda s, d: _calls(s, d).select("model").distinct().where("model is not null").join(_models(s, d).select(F.col("model_name").alias("model"), "context_length"), "model", "left").select("model", F.coalesce("context_length", F.lit(512)).cast("bigint").alias("context_length")), "select model, coalesce(context_length, 512)::BIGINT context_length from (select distinct model from generation_results where model is not null) left join model_info on model = model_name"),
    "i01_union_by_name": (lambda s, d: _samples(s, d).select("sample_id", "text").unionByName(_docs(s, d).select(F.col("doc_id").alias("sample_id"), "text", "lang"), allowMissingColumns=True).groupBy("lang").agg(F.count("*").alias("n")), "select lang, count(*) n from (select sample_id, text, null as lang from samples union all select doc_id, text, lang from documents) group by 1"),
    "i02_ordered_distinct": (lambda s, d: _docs(s, d).where("text is not null").select("doc_id", F.md5(F.array_join(F.array_distinct(T.tokens(F.lower("text"))), "|")).alias("digest")), f"with t as (select doc_id, regexp_extract_all(lower(text), '{TOKS}') t from documents where text is not null), e as (select doc_id, unnest(t) w, generate_subscripts(t, 1) k from t), f as (select doc_id, w, min(k) k from e group by 1, 2) select doc_id, md5(coalesce(string_agg(w, '|' order by k), '')) digest from t left join f using (doc_id) group by 1"),
    "i03_token_overlap": (lambda s, d: _r(_samples(s, d).where("original_text is not null and text is not null").select("sample_id", windows.overlap(T.tokens(F.lower("text")), T.tokens(F.lower("original_text"))).alias("overlap"))), f"select sample_id, round(len(list_distinct(list_intersect(a, b))) / nullif(len(list_distinct(a || b)), 0), 6) overlap from (select sample_id, regexp_extract_all(lower(text), '{TOKS}') a, regexp_extract_all(lower(original_text), '{TOKS}') b from samples where original_text is not null and text is not null)"),
    "i04_high_risk": (lambda s, d: _t("pii_matches")(s, d).groupBy("result_id").agg(F.collect_set("pii_type").alias("types")).select("result_id", F.arrays_overlap("types", F.array(F.lit("ssn"), F.lit("passport"), F.lit("credit_card"))).alias("high_risk")), "select result_id, bool_or(pii_type in ('ssn', 'passport', 'credit_card')) high_risk from pii_matches group by 1"),
    "i05_adjacent_sentences": (lambda s, d: quality.score(_docs(s, d)).select("doc_id", "flow_ok"), f"with {scores_sql()} select doc_id, flow_ok from s"),
    "i06_moving_mean": (lambda s, d: _r(windows.moving_mean(_events(s, d), "user_id", ["ts", "event_id"], "value").select("event_id", "moving_mean")), "select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 9 preceding and current row), 6) moving_mean from events"),
    "i07_patience": (lambda s, d: _r(windows.patience(_events(s, d), "user_id", ["ts", "event_id"], "value").select("event_id", "best", "improved", "waited")), "with a as (select *, max(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) b, row_number() over (partition by user_id order by ts, event_id) k from events), c as (select *, b is null or value > b improved from a) select event_id, round(greatest(b, value), 6) best, improved, k - max(case when improved then k end) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) waited from c"),
    "i08_progress": (lambda s, d: _r(windows.progress(_events(s, d), "user_id", "ts", ["ts", "event_id"], 100).select("event_id", "done", "fraction", "per_minute")), "with a as (select event_id, count(*) over (partition by user_id order by ts, event_id rows unbounded preceding) done, (epoch_us(ts) - epoch_us(min(ts) over (partition by user_id))) / 1e6::DOUBLE s from events) select event_id, done, round(done / 100, 6) fraction, round(coalesce(done / nullif(s, 0) * 60, 0), 6) per_minute from a"),
    "i09_rebased": (lambda s, d: _r(windows.rebased(_events(s, d), "user_id", "ts").select("event_id", "seconds")), "select event_id, round((epoch_us(ts) - epoch_us(min(ts) over (partition by user_id))) / 1e6::DOUBLE, 6) as seconds from events"),
    "j01_json_array": (lambda s, d: _once_calls(s, d).select("call_id", parsing.json_array(F.col("text")).alias("arr")).where("arr is not null"), f"with {ARR} select call_id, arr from j where arr is not null"),
    "j02_truncated": (lambda s, d: _once_calls(s, d).where("instr(text, '[') > 0 and not contains(substr(text, instr(text, '[')), ']')").select("call_id", parsing.json_array(F.col("text")).alias("arr")), f"with {ARR} select call_id, arr from j where call_id in (select call_id from b where s > 0 and not contains(r, ']'))"),
    "j03_samples": (lambda s, d: _r(parsing.samples(_once_calls(s, d), "call_id").select("call_id", "pos", "text", "label", "confidence")), J3),
    "j04_fallbacks": (lambda s, d: parsing.fallbacks(_tasks(s, d)).select("task_id", "label", "text"), "select task_id, label, printf('Fallback sample %d for %s class', i, label) as text from (select task_id, unnest(class_labels) as label from generation_tasks), (select unnest([1, 2, 3]) i)"),
    "j05_prompts": (lambda s, d: parsing.prompts(parsing.batches(_tasks(s, d))).select("task_id", "language", "label", "batch_no", "prompt"), f"with {BATCH} select task_id, language, label, batch_no, 'Write ' || batch_size || ' texts in ' || language || ' of class \"' || label || '\" (classes: ' || array_to_string(class_labels, ', ') || '). Task: ' || coalesce(task_description, '') || '. Answer with a JSON array of objects with text, label and confidence.' prompt from b"),
    "j06_batches": (lambda s, d: parsing.batches(_tasks(s, d)).select("task_id", "language", "label", "batch_no", "batch_size"), f"with {BATCH} select task_id, language, label, batch_no, batch_size from b"),
    "j07_verdicts": (lambda s, d: _r(parsing.verdicts(_samples(s, d).withColumn("v", F.to_json(F.struct((F.col("confidence") > 0.5).alias("correct"), "quality_score", F.col("source").alias("explanation")))), "v").groupBy("source").agg(F.avg(F.col("correct").cast("int")).alias("agreement"), F.avg("jury_score").alias("score"))), "select source, round(avg(coalesce(confidence > 0.5, false)::INT), 6) agreement, round(avg(coalesce(quality_score, 3)), 6) score from samples group by 1"),
    "j08_slug": (lambda s, d: _docs(s, d).select("doc_id", parsing.slug(F.col("text")).alias("name")), f"select doc_id, case when coalesce(x, '') = '' then 'dataset' else x end as name from (select doc_id, regexp_replace(regexp_replace(left(trim(regexp_replace(text, '{SPACE}', ' ', 'g')), 50), '[<>:\"|?*\\\\/\\n\\r\\t]', '_', 'g'), '[._ ]+$', '') x from documents)"),
}
