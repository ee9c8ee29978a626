"""Queries of cleaning (c), quality (d) and the flagship report, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import clean, quality


def q(s: str) -> str:
    return s.replace("'", "''")


TOKS, SPACE, SPECIAL = q(T.TOKEN), q(T.SPACE), q(T.SPECIAL)
PII_SQL = " or ".join(f"regexp_matches(text, '{q(p)}')" for p in T.PERSONAL.values())
BIAS_SQL = "(" + " + ".join(f"regexp_matches(text, '(?i){q(p)}')::INT" for p in T.BIAS) + f") / {len(T.BIAS)}.0"
_tense = lambda ms: "(" + " + ".join(f"contains(lower(text), '{m}')::INT" for m in ms) + ")"
STOP_SQL = "[" + ",".join(f"'{w}'" for w in T.STOPWORDS) + "]"
TOXIC_SQL = "[" + ",".join(f"'{w}'" for w in T.TOXIC) + "]"


def scores_sql(table: str = "documents", cols: str = "doc_id, lang", low: int = 10, high: int = 1000) -> str:
    """Common table expressions that end in `s`, one row for each text with all scores."""
    return f"""
    b0 as (select {cols}, coalesce(text, '') as text from {table}),
    b1 as (select *, regexp_extract_all(text, '{TOKS}') toks, regexp_extract_all(lower(text), '{TOKS}') ltoks,
        list_filter(list_transform(regexp_split_to_array(text, '{q(T.SENT)}'), lambda x: trim(x)), lambda x: regexp_matches(x, '[^\\s\\p{{Z}}]')) sents from b0),
    b2 as (select *, length(text) n, len(toks) nw, len(sents) ns, length(regexp_replace(text, '\\s+', '', 'g')) nl,
        list_filter(ltoks, lambda w: length(w) > 2 and not list_contains({STOP_SQL}, w)) content,
        list_transform(sents, lambda x: list_distinct(regexp_extract_all(lower(x), '{TOKS}'))) sets,
        {_tense(quality.PAST)} tp, {_tense(quality.PRESENT)} tn, {_tense(quality.FUTURE)} tf from b1),
    b3 as (select *, list_filter(list_transform(range(1, len(sets)), lambda i: {{'i': len(list_intersect(sets[i], sets[i+1])), 'x': len(sets[i]), 'y': len(sets[i+1])}}), lambda p: p.x > 0 and p.y > 0) prs from b2),
    b4 as (select *,
        case when n < {low} or n > {high} then 0.0 when n >= {2 * low} and n <= {0.8 * high} then 1.0 when n < {2 * low} then n / {2.0 * low} else {0.8 * high} / n end::DOUBLE length_score,
        case when nw > 0 and ns > 0 then (1 / (1 + abs(nw / ns - 15) / 10) + 1 / (1 + abs(nl / nw - 5) / 3)) / 2 else 0 end::DOUBLE readability,
        (tp + tn + tf = 0 or greatest(tp, tn, tf) / nullif(tp + tn + tf, 0) > 0.7) tense_ok,
        (regexp_matches(text, '[.!?][\\s\\p{{Z}}]*$') and (n - length(replace(text, '"', ''))) % 2 = 0 and n - length(replace(text, '(', '')) = n - length(replace(text, ')', ''))) punctuation_ok,
        coalesce(round(list_sum(list_transform(prs, lambda p: p.i / (p.x + p.y - p.i))) / nullif(len(prs), 0), 9) between 0.1 and 0.7, true) flow_ok,
        (len(ltoks) < 5 or len(list_distinct(ltoks)) / nullif(len(ltoks), 0) between 0.3 and 0.9) vocabulary_ok,
        ({PII_SQL}) has_pii, list_has_any(ltoks, {TOXIC_SQL}) is_toxic, ({BIAS_SQL})::DOUBLE bias_score,
        case when len(content) > 0 then (len(list_distinct(content)) / len(content) + len(content) / len(ltoks)) / 2 else 0 end::DOUBLE richness from b3),
    b5 as (select *, case when text = '' then 0 when ns < 2 then 0.8 else (tense_ok::INT + punctuation_ok::INT + flow_ok::INT + vocabulary_ok::INT) / 4 end::DOUBLE coherence,
        case when has_pii or is_toxic or bias_score > 0.5 then 0 else 1 end::DOUBLE safety from b4),
    s as (select *, case when text = '' then 0 else least(greatest(length_score * 0.2 + readability * 0.2 + coherence * 0.2 + safety * 0.3 + richness * 0.1, 0), 1) end::DOUBLE quality_score from b5)"""


def _docs(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source")


def _samples(s, d):
    return s.read.parquet(f"{d}/samples.parquet")


def _scored(name: str, expr: str | None = None):
    r = lambda c: F.round(c, 6)
    return (lambda s, d: quality.score(_docs(s, d)).select("doc_id", r(name).alias(name))), f"with {scores_sql()} select doc_id, round({name}, 6) {name} from s"


def _flag(name: str):
    return (lambda s, d: quality.score(_docs(s, d)).select("doc_id", name)), f"with {scores_sql()} select doc_id, {name} from s"


def class_report(s, d):
    """Per language: rows, mean quality, rows that pass, and the balance of the classes."""
    g = quality.score(_docs(s, d)).groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 6).alias("mean_quality"), F.sum((F.round("quality_score", 9) >= 0.7).cast("bigint")).alias("n_passed"))
    ends = g.agg((F.min("n") / F.max("n")).alias("b"))
    return g.crossJoin(F.broadcast(ends)).select("lang", "n", "mean_quality", "n_passed", F.round("b", 6).alias("class_balance"))  # ends is one row


CLEAN_SQL = f"""with a as (select doc_id, text as original_text, trim(regexp_replace(lower(trim(regexp_replace(text, '{SPACE}', ' ', 'g'))), '{SPECIAL}', '', 'g')) t from documents where text is not null and text <> ''),
  b as (select doc_id, original_text, left(t, 1000) as text from a where length(t) >= 5),
  c as (select *, row_number() over (partition by text order by doc_id) rn from b)"""

PLANS: dict[str, tuple] = {
    "quality_class_report": (class_report, f"with {scores_sql()}, g as (select coalesce(lang, 'unknown') lang, count(*) n, round(avg(quality_score), 6) mean_quality, sum((round(quality_score, 9) >= 0.7)::INT)::BIGINT n_passed from s group by 1) select lang, n, mean_quality, n_passed, round((select min(n) / max(n) from g), 6) class_balance from g"),
    "c01_squeeze": (lambda s, d: _docs(s, d).select("doc_id", T.squeeze("text").alias("t")), f"select doc_id, trim(regexp_replace(text, '{SPACE}', ' ', 'g')) t from documents"),
    "c02_lowercase": (lambda s, d: _docs(s, d).select("doc_id", F.lower("text").alias("t")), "select doc_id, lower(text) t from documents"),
    "c03_strip_special": (lambda s, d: _docs(s, d).select("doc_id", T.strip_special("text").alias("t")), f"select doc_id, regexp_replace(text, '{SPECIAL}', '', 'g') t from documents"),
    "c04_preprocess": (lambda s, d: clean.preprocess(_docs(s, d).select("doc_id", "text"), "doc_id").select("doc_id", "text", "original_text", "preprocessed"), CLEAN_SQL + " select doc_id, text, original_text, true as preprocessed from c where rn = 1"),
    "c05_dedup_first": (lambda s, d: clean.first_of(_samples(s, d).where("text is not null").select("sample_id", "text", "label"), "text", "sample_id").select("sample_id", "label"), "select sample_id, label from (select *, row_number() over (partition by text order by sample_id) rn from samples where text is not null) where rn = 1"),
    "c06_length_gate": (lambda s, d: clean.length_gate(_samples(s, d)).select("sample_id"), "select sample_id from samples where length(text) between 10 and 1000 and label is not null and label <> ''"),
    "c07_quality_gate": (lambda s, d: quality.gate(_docs(s, d)).select("doc_id", F.round("quality_score", 6).alias("quality_score")), f"with {scores_sql()} select doc_id, round(quality_score, 6) quality_score from s where round(quality_score, 9) >= 0.7"),
    "c08_clean_labels": (lambda s, d: clean.clean_labels(_samples(s, d), "label", "sample_id"), "select label, o as first_at from (select *, row_number() over (partition by lower(label) order by o, label) rn from (select trim(label) as label, sample_id o from samples) where label <> '') where rn = 1"),
    "c09_valid_names": (lambda s, d: _samples(s, d).select("sample_id", clean.valid_name(F.col("label")).alias("ok")), "select sample_id, coalesce(trim(label) <> '' and length(trim(label)) <= 50 and not regexp_matches(label, '[/\\\\:*?\"<>|\\n\\t]'), false) ok from samples"),
    "c10_truncate": (lambda s, d: _docs(s, d).select("doc_id", clean.truncate(F.col("text"), 80).alias("t")), "select doc_id, case when length(text) > 80 then left(text, 77) || '...' else text end t from documents"),
    "c11_human_size": (lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", clean.human_size(F.col("n_chars") * F.col("doc_id")).alias("size")), "select doc_id, case when x < 1024 then printf('%.0f B', x::DOUBLE) when x < 1048576 then printf('%.1f KB', floor(x / 1024.0::DOUBLE * 10 + 0.5) / 10) when x < 1073741824 then printf('%.1f MB', floor(x / 1048576.0::DOUBLE * 10 + 0.5) / 10) when x is not null then printf('%.1f GB', floor(x / 1073741824.0::DOUBLE * 10 + 0.5) / 10) end as size from (select doc_id, n_chars * doc_id x from documents)"),
    "c11_human_duration": (lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", clean.human_duration(F.col("value") * F.pmod("event_id", F.lit(50))).alias("t")), "select event_id, case when x < 60 then printf('%.1fs', floor(x * 10 + 0.5) / 10) when x < 3600 then printf('%dm %ds', floor(x / 60)::BIGINT, floor(x)::BIGINT % 60) else printf('%dh %dm', floor(x / 3600)::BIGINT, (floor(x)::BIGINT % 3600) // 60) end t from (select event_id, value * (event_id % 50) x from events)"),
    "c11_human_number": (lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", clean.human_number(F.col("o_totalprice")).alias("t")), "select o_orderkey, case when abs(o_totalprice) >= 1000 then format('{:,.3f}', round(o_totalprice, 3)) else printf('%.3f', round(o_totalprice, 3)) end t from orders"),
    "c12_learning_rate": (lambda s, d: _samples(s, d).select("sample_id", clean.learning_rate(F.format_string("%.3f", F.col("quality_score") * 2)).alias("rate")), "select sample_id, case when x > 0 and x <= 1 then x end rate from (select sample_id, case when regexp_matches(t, '^[0-9]*\\.?[0-9]+([eE][-+]?[0-9]+)?$') then try_cast(t as double) end x from (select sample_id, printf('%.3f', quality_score * 2) t from samples))"),
    "c12_bounded_int": (lambda s, d: _docs(s, d).select("doc_id", clean.bounded_int(F.regexp_extract("text", r"([^\s]*\d[^\s]*)", 1), 1, 50000).alias("n")), "select doc_id, case when x between 1 and 50000 then x end n from (select doc_id, case when regexp_matches(t, '^[+-]?\\d+$') then try_cast(t as bigint) end x from (select doc_id, trim(regexp_extract(text, '([^\\s]*\\d[^\\s]*)', 1)) t from documents))"),
    "c13_required_fields": (lambda s, d: _samples(s, d).where("text is not null and label is not null").select("sample_id"), "select sample_id from samples where text is not null and label is not null"),
    "d00_overall": _scored("quality_score"),
    "d01_length": _scored("length_score"),
    "d02_readability": _scored("readability"),
    "d03_coherence": _scored("coherence"),
    "d04_tense": _flag("tense_ok"),
    "d05_punctuation": _flag("punctuation_ok"),
    "d06_flow": _flag("flow_ok"),
    "d07_vocabulary": _flag("vocabulary_ok"),
    "d08_safety": _scored("safety"),
    "d09_personal": _flag("has_pii"),
    "d10_toxic": _flag("is_toxic"),
    "d11_bias": _scored("bias_score"),
    "d12_richness": _scored("richness"),
    "p01_tokens": (lambda s, d: _docs(s, d).select("doc_id", F.size(T.tokens(F.lower("text"))).cast("bigint").alias("n"), F.md5(F.array_join(T.tokens(F.lower("text")), "|")).alias("digest")).where("n >= 0"), f"select doc_id, len(t)::BIGINT n, md5(array_to_string(t, '|')) digest from (select doc_id, regexp_extract_all(lower(text), '{TOKS}') t from documents where text is not null)"),
}
PLANS["t1_tokens"] = PLANS.pop("p01_tokens")
PLANS["t2_sentences"] = (lambda s, d: _docs(s, d).where("text is not null").select("doc_id", F.size(T.sentences("text")).cast("bigint").alias("n")), f"select doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '{q(T.SENT)}'), lambda x: trim(x)), lambda x: regexp_matches(x, '[^\\s\\p{{Z}}]')))::BIGINT n from documents where text is not null")
PLANS["t4_punctuation"] = (lambda s, d: _docs(s, d).select("doc_id", T.punctuation("text").alias("p")), f"select doc_id, regexp_replace(text, '{q(T.NOT_PUNCT)}', '', 'g') p from documents")
PLANS["t7_uniform"] = (lambda s, d: _docs(s, d).select("doc_id", F.round(T.uniform(42, "doc_id", "x"), 9).alias("u")), "select doc_id, round(('0x' || substr(md5('42:' || doc_id || ':x'), 1, 8))::BIGINT / 4294967296.0::DOUBLE, 9) u from documents")
