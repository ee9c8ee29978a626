"""Queries of corpus measures (e), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import corpus
from lexloom.plans.text_plans import STOP_SQL, TOKS, _docs, _samples, q, scores_sql


def _r(df, *ints):
    """Doubles to six decimals."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


W = f"w as (select unnest(regexp_extract_all(lower(text), '{TOKS}')) word from documents where text <> '')"
LIVE = "d as (select doc_id, text from documents where text <> '')"
VOCAB = f"{W} select (select count(*) from w) n_tokens, (select count(distinct word) from w) vocabulary_size, round((select count(distinct word) / count(*) from w), 6) lexical_diversity"
TFIDF = f"""{LIVE}, t as (select doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 2 and not list_contains({STOP_SQL}, x))) term from d),
 tf as (select doc_id, term, count(*) tf from t group by 1, 2), top as (select term, sum(tf) total, count(*) df from tf group by 1 order by total desc, term limit 1000),
 idf as (select term, ln((1 + (select count(*) from d)) / (1 + df)) + 1 idf from top), v as (select doc_id, term, tf * idf x from tf join idf using (term)),
 nrm as (select doc_id, sqrt(sum(x * x)) norm from v group by 1), u as (select term, sum(x / norm) s from v join nrm using (doc_id) group by 1)
 select round(1 - ((select sum(s * s) from u) - (select count(*) from nrm)) / ((select count(*) from d) * ((select count(*) from d) - 1)), 6) semantic_diversity"""
STRUCT = f"select round((count(distinct k) / count(*) + count(distinct p) / count(*)) / 2, 6) structural_diversity from (select len(list_filter(list_transform(regexp_split_to_array(text, '{q(T.SENT)}'), lambda x: trim(x)), lambda x: regexp_matches(x, '[^\\s\\p{{Z}}]'))) k, regexp_replace(text, '{q(T.NOT_PUNCT)}', '', 'g') p from documents where text <> '')"
NEAR = f"""d as (select sample_id doc_id, text from samples where text <> ''), x as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '{TOKS}')) w from d), n as (select doc_id, count(*) n from x group by 1),
 p as (select a.doc_id a, b.doc_id b, count(*) i from x a join x b on a.w = b.w and a.doc_id < b.doc_id group by 1, 2),
 near as (select a, b, i / (na.n + nb.n - i) s from p join n na on na.doc_id = a join n nb on nb.doc_id = b where i / (na.n + nb.n - i) >= 0.9 - 1e-9)"""


def _distinct_sql(n: int, stitched: bool) -> str:
    t = f"t as (select doc_id, regexp_extract_all(lower(text), '{TOKS}') t from documents where text <> '')"
    if stitched:
        g = f"s as (select row_number() over (order by doc_id, k) r, w from (select doc_id, unnest(t) w, generate_subscripts(t, 1) k from t)), g as (select {' || chr(32) || '.join('a%d.w' % i for i in range(n))} g from s a0 {' '.join(f'join s a{i} on a{i}.r = a0.r + {i}' for i in range(1, n))})"
    else:
        g = f"g as (select unnest(list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i+{n - 1}], ' '))) g from t where len(t) >= {n})"
    return f"with {t}, {g} select count(*) n_grams, count(distinct g) distinct_grams, round(count(distinct g) / count(*), 6) distinct_{n} from g"


def _metrics(s, d):
    return _r(corpus.metrics(_samples(s, d).select("sample_id", "text", "label"), "sample_id"))


PLANS: dict[str, tuple] = {
    "e01_lengths": (lambda s, d: _r(corpus.lengths(_docs(s, d))), "select count(*) total_samples, round(avg(length(text)), 6) average_length, round(coalesce(stddev_samp(length(text)), 0), 6) length_std from documents where text <> ''"),
    "e02_vocabulary": (lambda s, d: _r(corpus.vocabulary(_docs(s, d)).select("n_tokens", "vocabulary_size")), f"with {W} select count(*) n_tokens, count(distinct word) vocabulary_size from w"),
    "e03_lexical_diversity": (lambda s, d: _r(corpus.vocabulary(_docs(s, d)).select("lexical_diversity")), f"with {W} select round(count(distinct word) / count(*), 6) lexical_diversity from w"),
    "e04_semantic_diversity": (lambda s, d: _r(corpus.semantic_diversity(_docs(s, d), "doc_id")), f"with {TFIDF}"),
    "e05_structural_diversity": (lambda s, d: _r(corpus.structural_diversity(_docs(s, d))), STRUCT),
    "e06_score_means": (lambda s, d: _r(corpus.quality.score(_docs(s, d)).agg(F.avg("quality_score").alias("overall_quality"), F.avg(F.when(F.col("text") != "", F.col("readability"))).alias("readability"), F.avg(F.when(F.col("text") != "", F.col("coherence"))).alias("coherence"))), f"with {scores_sql()} select round(avg(quality_score), 6) overall_quality, round(avg(readability) filter (text <> ''), 6) readability, round(avg(coherence) filter (text <> ''), 6) coherence from s"),
    "e07_class_counts": (lambda s, d: corpus.class_counts(_samples(s, d)), "select coalesce(label, '') as label, count(*) n from samples group by 1"),
    "e08_class_balance": (lambda s, d: _r(corpus.class_balance(_samples(s, d))), "select round(min(n) / max(n), 6) class_balance from (select count(*) n from samples group by coalesce(label, ''))"),
    "e09_flags": (lambda s, d: _r(corpus.quality.score(_docs(s, d)).where("text <> ''").agg(F.avg("bias_score").alias("bias"), F.avg(F.col("is_toxic").cast("int")).alias("toxicity"), F.bool_or("has_pii").alias("pii_detected"))), f"with {scores_sql()} select round(avg(bias_score), 6) bias, round(avg(is_toxic::INT), 6) toxicity, bool_or(has_pii) pii_detected from s where text <> ''"),
    "e10_duplicate_ratio": (lambda s, d: _r(corpus.duplicate_ratio(_samples(s, d))), "select round((count(text) - count(distinct text)) / count(text), 6) duplicate_ratio from samples"),
    "e11_near_duplicate_ratio": (lambda s, d: _r(corpus.near_duplicate_ratio(_samples(s, d), "sample_id")), f"with {NEAR} select (select count(*) from near) near_pairs, round((select count(*) from near) / ((select count(*) from n) * ((select count(*) from n) - 1) / 2), 6) near_duplicate_ratio"),
    "e11_near_pairs": (lambda s, d: _r(corpus.near_pairs(_samples(s, d), "sample_id")), f"with {NEAR}, key as (select doc_id, string_agg(w, chr(1) order by w) k from x group by 1), rep as (select min(doc_id) r from key group by k) select a id_a, b id_b, round(s, 6) similarity from near where a in (select r from rep) and b in (select r from rep)"),
    "e12_distinct_1": (lambda s, d: _r(corpus.distinct_n(_docs(s, d), "doc_id", 1)), f"with {W} select count(*) n_grams, count(distinct word) distinct_grams, round(count(distinct word) / count(*), 6) distinct_1 from w"),
    "e12_distinct_2": (lambda s, d: _r(corpus.distinct_n(_docs(s, d), "doc_id", 2)), _distinct_sql(2, True)),
    "e12_distinct_3": (lambda s, d: _r(corpus.distinct_n(_docs(s, d), "doc_id", 3)), _distinct_sql(3, True)),
    "e12_distinct_2_within": (lambda s, d: _r(corpus.distinct_n(_docs(s, d), "doc_id", 2, stitched=False)), _distinct_sql(2, False)),
    "e13_metrics": (lambda s, d: _metrics(s, d).select("total_rows", "total_samples", "average_length", "length_std", "vocabulary_size", "lexical_diversity", "overall_quality", "readability", "coherence", "class_balance", "bias_score", "toxicity_score", "pii_detected", "duplicate_ratio", "distinct_1"), f"""with {scores_sql('samples', 'sample_id, label')}, w as (select unnest(ltoks) word from s where text <> '')
        select count(*) total_rows, count(*) filter (text <> '') total_samples, round(avg(n) filter (text <> ''), 6) average_length, round(stddev_samp(n) filter (text <> ''), 6) length_std, (select count(distinct word) from w) vocabulary_size, round((select count(distinct word) / count(*) from w), 6) lexical_diversity,
        round(avg(quality_score), 6) overall_quality, round(avg(readability) filter (text <> ''), 6) readability, round(avg(coherence) filter (text <> ''), 6) coherence, round((select min(k) / max(k) from (select count(*) k from s group by coalesce(label, ''))), 6) class_balance, round(avg(bias_score) filter (text <> ''), 6) bias_score, round(avg(is_toxic::INT) filter (text <> ''), 6) toxicity_score, bool_or(has_pii) filter (text <> '') pii_detected,
        round((select (count(text) - count(distinct text)) / count(text) from samples), 6) duplicate_ratio, round((select count(distinct word) / count(*) from w), 6) distinct_1 from s"""),
    "e13_metrics_all": (_metrics, None),
    "e14_balanced_within": (lambda s, d: corpus.balanced_within(_samples(s, d), s.createDataFrame([("positive",), ("negative",), ("neutral",)], "label string"), tolerance=0.5), "with c as (select t.label, n from (values ('positive'), ('negative'), ('neutral')) t(label) left join (select label, count(*) n from samples group by 1) using (label)) select coalesce(min(coalesce(n, 0)) > 0, false) and coalesce((max(n) - min(n)) / max(n) <= 0.5, false) is_balanced from c"),
    "e15_success_rate": (lambda s, d: _r(corpus.success_rate(_samples(s, d), s.read.parquet(f"{d}/generation_tasks.parquet")).select("task_id", "made", "wanted", "success_rate")), "select task_id, coalesce(made, 0) made, (len(class_labels) * samples_per_class)::BIGINT wanted, round(least(coalesce(made, 0) / (len(class_labels) * samples_per_class), 1), 6) success_rate from generation_tasks left join (select task_id, count(*) made from samples group by 1) using (task_id)"),
    "e16_completion": (lambda s, d: _r(corpus.success_rate(_samples(s, d), s.read.parquet(f"{d}/generation_tasks.parquet")).select("task_id", "completion")), "select task_id, round(coalesce(coalesce(made, 0) / nullif(len(class_labels) * samples_per_class, 0), 0), 6) completion from generation_tasks left join (select task_id, count(*) made from samples group by 1) using (task_id)"),
    "e17_class_weights": (lambda s, d: _r(corpus.class_weights(_samples(s, d))), "with c as (select coalesce(label, '') as label, count(*) n from samples group by 1) select label, round((select sum(n) from c) / ((select count(*) from c) * n), 6) weight from c"),
    "e18_analysis": (lambda s, d: _r(corpus.analysis(_samples(s, d))), f"with t as (select length(text) n, len(regexp_extract_all(text, '{TOKS}')) k from samples where text <> '') select round(avg(n), 6) mean_chars, round(stddev_pop(n), 6) std_chars, min(n) min_chars, max(n) max_chars, median(n)::DOUBLE median_chars, round(avg(k), 6) mean_tokens, round(stddev_pop(k), 6) std_tokens, min(k) min_tokens, max(k) max_tokens, median(k)::DOUBLE median_tokens, round((select min(n) / max(n) from (select count(*) n from samples group by coalesce(label, ''))), 6) class_balance from t"),
    "e19_by_language": (lambda s, d: corpus.by_language(_samples(s, d)), "select a as language, b as label, count(*) n, grouping_id(a, b)::INT as level from (select coalesce(language, 'unknown') a, coalesce(label, '') b from samples) group by cube (a, b)"),
}
