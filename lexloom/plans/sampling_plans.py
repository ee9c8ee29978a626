"""Queries of sampling, splitting and encoding (f), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import augment, sampling
from lexloom.plans.text_plans import TOKS, _docs, _samples


def _u(tag: str, key: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key} || ':{tag}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def _split_sql(sizes_first: bool, stratify: bool = True) -> str:
    key = "coalesce(label, '')" if stratify else "''"
    sizes = "a - floor(a * 0.8 + 1e-9) - floor(a * 0.1 + 1e-9) t, floor(a * 0.1 + 1e-9) v" if sizes_first else "ceil(a * 0.1 - 1e-9) t, ceil((a - ceil(a * 0.1 - 1e-9)) * (0.1 / 0.9) - 1e-9) v"
    return f"""with d as (select sample_id, {key} l from samples), c as (select l, count(*) n from d group by 1), z as (select a, {sizes} from (select sum(n)::DOUBLE a from c)),
    q0 as (select l, n, a, t, v, round(n * t / a, 9) x from c, z), q1 as (select *, floor(x) f, row_number() over (order by x - floor(x) desc, l) k, t - sum(floor(x)) over () lft from q0),
    q2 as (select l, n, a, t, v, f + (k <= lft)::INT qt from q1), q3 as (select *, round((n - qt) * v / (a - t), 9) x from q2), q4 as (select *, floor(x) f, row_number() over (order by x - floor(x) desc, l) k, v - sum(floor(x)) over () lft from q3),
    q5 as (select l, qt, f + (k <= lft)::INT qv from q4), r as (select sample_id, l, row_number() over (partition by l order by {_u('split', 'sample_id')}, sample_id) rk from d)
    select sample_id, case when rk <= qt then 'test' when rk <= qt + qv then 'validation' else 'train' end part from r join q5 using (l)"""


def _s(s, d):
    return _samples(s, d).select("sample_id", "label", "text", "source", "confidence")


def _over(target):
    top = str(target) if target else "(select max(n) from c)"
    return f"""with c as (select label, count(*) n, greatest({'(select max(k) from (select count(*) k from samples where label is not null group by label))' if not target else top} - count(*), 0) need from samples where label is not null group by 1),
    r as (select sample_id, s.label, source, confidence, row_number() over (partition by s.label order by {_u('over', 'sample_id')}, sample_id) rk, n, need from samples s join c on s.label = c.label),
    x as (select *, unnest(range(0, (need // n + (rk <= need % n)::INT + 1)::BIGINT)) copy_no from r)
    select sample_id, label, case when copy_no > 0 then 'duplicated' else source end as source, round(case when copy_no > 0 then coalesce(confidence, 0.8) * 0.8 else confidence end, 6) confidence, copy_no::INT copy_no from x"""


def _ids_sql(table: str, id_col: str, limit: int) -> str:
    return f"""w as (select {id_col}, regexp_extract_all(lower(text), '{TOKS}') t from {table}), v as (select word, row_number() over (order by md5(word)) word_id from (select distinct unnest(t) word from w)),
    x as (select {id_col}, unnest(t[1:{limit}]) word, generate_subscripts(t[1:{limit}], 1) k from w), e as (select {id_col}, list(word_id order by k) ids from x join v using (word) group by 1), enc as (select w.{id_col}, coalesce(ids, []) ids from w left join e using ({id_col}))"""


PLANS: dict[str, tuple] = {
    "f01_undersample": (lambda s, d: sampling.undersample(_s(s, d).where("label in ('positive', 'negative', 'neutral', 'spam')"), "sample_id").select("sample_id", "label"), f"with d as (select sample_id, label from samples where label in ('positive', 'negative', 'neutral', 'spam')), r as (select *, row_number() over (partition by label order by {_u('under', 'sample_id')}, sample_id) rk from d) select sample_id, label from r where rk <= (select min(n) from (select count(*) n from d group by label))"),
    "f01_undersample_all": (lambda s, d: sampling.undersample(_s(s, d), "sample_id").select("sample_id", "label"), f"with d as (select sample_id, label from samples where label is not null), r as (select *, row_number() over (partition by label order by {_u('under', 'sample_id')}, sample_id) rk from d) select sample_id, label from r where rk <= (select min(n) from (select count(*) n from d group by label))"),
    "f02_oversample": (lambda s, d: sampling.oversample(_s(s, d), "sample_id").select("sample_id", "label", "source", F.round("confidence", 6).alias("confidence"), "copy_no"), _over(None)),
    "f02_augmented": (lambda s, d: sampling.topped_up(_s(s, d), "sample_id").select("sample_id", "text", "label", "source", F.round("confidence", 6).alias("confidence"), "copy_no"), None),
    "f02_augmented_classes": (lambda s, d: sampling.topped_up(_s(s, d), "sample_id").groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("copy_no") == 0).cast("bigint")).alias("originals")), "with c as (select label, count(*) k from samples where label is not null group by 1) select label, (select max(k) from c) n, k originals from c"),
    "f03_augmented": (lambda s, d: sampling.topped_up(_s(s, d), "sample_id", target=120, within=2).select("sample_id", "text", "label", "source", F.round("confidence", 6).alias("confidence"), "copy_no"), None),
    "f03_augmented_classes": (lambda s, d: sampling.topped_up(_s(s, d), "sample_id", target=120, within=2).groupBy("label").agg(F.count("*").alias("n")), "select label, greatest(count(*), least(120, 3 * count(*))) n from samples where label is not null group by 1"),
    "f03_top_up": (lambda s, d: sampling.oversample(_s(s, d), "sample_id", target=120).select("sample_id", "label", "source", F.round("confidence", 6).alias("confidence"), "copy_no"), _over(120)),
    "f04_split": (lambda s, d: sampling.split3(_s(s, d), "sample_id").select("sample_id", "part"), _split_sql(False)),
    "f05_split_sizes_first": (lambda s, d: sampling.split3(_s(s, d), "sample_id", sizes_first=True).select("sample_id", "part"), _split_sql(True)),
    "f05_split_random": (lambda s, d: sampling.split3(_s(s, d), "sample_id", label=None, sizes_first=True).select("sample_id", "part"), _split_sql(True, False)),
    "f06_split_ratios": (lambda s, d: s.read.parquet(f"{d}/dataset_splits.parquet").select("task_id", (F.abs(F.col("train_ratio") + F.col("val_ratio") + F.col("test_ratio") - 1) <= 1e-6).alias("ok")), "select task_id, abs(train_ratio + val_ratio + test_ratio - 1) <= 1e-6 ok from dataset_splits"),
    "f07_label_ids": (lambda s, d: sampling.encode_labels(_s(s, d)).select("sample_id", "label_id"), "with l as (select label, row_number() over (order by label) - 1 label_id from (select distinct label from samples where label is not null)) select sample_id, label_id from samples left join l using (label)"),
    "f08_word_ids": (lambda s, d: sampling.word_ids(_docs(s, d), "doc_id").select("doc_id", F.size("input_ids").cast("bigint").alias("n"), F.md5(F.array_join("input_ids", ",")).alias("digest"), F.size("attention_mask").cast("bigint").alias("mask")), f"with {_ids_sql('documents', 'doc_id', 512)} select doc_id, len(ids) n, md5(array_to_string(ids, ',')) digest, len(ids) mask from enc"),
    "f09_padding": (lambda s, d: sampling.padded(sampling.word_ids(_docs(s, d), "doc_id", limit=64), "doc_id", 16, 8).select("doc_id", F.col("batch_no").cast("bigint").alias("batch_no"), F.size("input_ids").cast("bigint").alias("width"), F.expr("aggregate(attention_mask, 0, (a, x) -> a + x)").cast("bigint").alias("live")), f"with {_ids_sql('documents', 'doc_id', 64)}, b as (select doc_id, ids, (row_number() over (order by doc_id) - 1) // 16 batch_no from enc) select doc_id, batch_no, (ceil(max(len(ids)) over (partition by batch_no) / 8) * 8)::BIGINT width, len(ids) live from b"),
    "f09_padding_512": (lambda s, d: sampling.padded(sampling.word_ids(_docs(s, d), "doc_id", limit=512), "doc_id", 16, 8).select("doc_id", F.col("batch_no").cast("bigint").alias("batch_no"), F.size("input_ids").cast("bigint").alias("width"), F.expr("aggregate(attention_mask, 0, (a, x) -> a + x)").cast("bigint").alias("live")), f"with {_ids_sql('documents', 'doc_id', 512)}, b as (select doc_id, ids, (row_number() over (order by doc_id) - 1) // 16 batch_no from enc) select doc_id, batch_no, (ceil(max(len(ids)) over (partition by batch_no) / 8) * 8)::BIGINT width, len(ids) live from b"),
    "f10_jury_sample": (lambda s, d: sampling.sample_k(_s(s, d), "sample_id", 200).select("sample_id"), f"select sample_id from samples order by {_u('jury', 'sample_id')}, sample_id limit 200"),
    "f11_adversarial": (lambda s, d: augment.adversarial(_samples(s, d).select("sample_id", "text", "label", "source", "confidence"), "sample_id", 200), None),
}
