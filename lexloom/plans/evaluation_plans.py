"""Queries of evaluation (l), with their SQL. Predictions: nearest centroid over the embeddings."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lexloom.functions.tables import cut
from lexloom.operators import evaluation as E
from lexloom.operators import sampling


def probs(first: int | None = None) -> str:
    dims = f"embedding[1:{first}]" if first else "embedding"
    return f"""e as (select vec_id, label, unnest({dims})::DOUBLE x, generate_subscripts({dims}, 1) i from embeddings), c as (select label cl, i, avg(x) m from e group by 1, 2),
    dd as (select vec_id, e.label, cl, sum((x - m) * (x - m)) d from e join c using (i) group by 1, 2, 3), ww as (select *, exp(min(d) over (partition by vec_id) - d) w from dd),
    pr as (select vec_id, label, cl, w / sum(w) over (partition by vec_id) p from ww), top as (select *, row_number() over (partition by vec_id order by p desc, cl) k from pr),
    pd as (select vec_id, label truth, cl predicted, p confidence from top where k = 1)"""


PROBS = probs()
CLASSES = f"{PROBS}, lab as (select distinct truth l from pd union select distinct predicted from pd), pc as (select l as label, count(*) filter (truth = l) support, count(*) filter (predicted = l) predicted, count(*) filter (truth = l and predicted = l) hits from lab, pd group by 1), mm as (select *, coalesce(hits / nullif(predicted, 0), 0)::DOUBLE as precision, coalesce(hits / nullif(support, 0), 0)::DOUBLE recall from pc), cls as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)::DOUBLE f1 from mm)"


def _v(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet")


def _p(s, d, first=None):
    return E.nearest_centroid(_v(s, d), "vec_id", first=first).withColumn("truth", F.col("label"))


def _r(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _two(s, d):
    """Two models for comparison: all dimensions, and the first 32."""
    rows = [E.summary(_p(s, d, k)).select(F.lit(n).alias("name"), "accuracy", F.col("precision_macro").alias("precision"), F.col("recall_macro").alias("recall"), F.col("f1_macro").alias("f1"), F.lit(ms).alias("ms"), F.lit(mb).alias("mb")) for n, k, ms, mb in (("full", None, 8.0, 2.5), ("half", 32, 4.0, 1.25))]
    return rows[0].unionByName(rows[1])


def _sum_sql(first: int | None, name: str, ms: float, mb: float) -> str:
    body = CLASSES.replace(PROBS, probs(first))
    return f"(with {body} select '{name}' as name, sum(hits) / sum(support) accuracy, avg(precision) as precision, avg(recall) recall, avg(f1) f1, {ms}::DOUBLE ms, {mb}::DOUBLE mb from cls)"


LOGITS = "x as (select vec_id, label, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE] t, [embedding[4]::DOUBLE, embedding[5]::DOUBLE, embedding[6]::DOUBLE] s from embeddings), q as (select *, list_transform(t, lambda v: exp(v / 2.0)) et, list_transform(s, lambda v: exp(v / 2.0)) es, list_transform(s, lambda v: exp(v)) e1 from x), z as (select *, list_transform(et, lambda v: v / list_sum(et)) pt, list_transform(es, lambda v: v / list_sum(es)) ps from q), k as (select vec_id, list_sum(list_transform(range(1, 4), lambda i: pt[i] * (ln(pt[i]) - ln(ps[i])))) * 4 kl, -ln(e1[label % 3 + 1] / list_sum(e1)) ce from z)"


def _logits(s, d):
    part = lambda a: F.transform(F.slice("embedding", a, 3), lambda x: x.cast("double"))
    return _v(s, d).select("vec_id", "label", part(1).alias("t"), part(4).alias("s"))


def _labelled(s, d):
    """All rows with a text; label_id is null where the label is."""
    return sampling.encode_labels(s.read.parquet(f"{d}/samples.parquet").where("text is not null").select("sample_id", "text", "label"))


def _student(s, d):
    """A student of all labels; its teacher is the naive Bayes model on the hard labels. Rows without a label are predicted, not trained on."""
    rows = cut(E.with_words(_labelled(s, d)).select("sample_id", "label_id", "features"))
    known = E.naive_bayes(rows, "label_id").transform(rows.where("label_id is not null")).select("features", "label_id", vector_to_array("probability").alias("teacher"))
    model = E.student(known, "teacher", "label_id")
    return model.transform(rows).select("sample_id", "label_id", F.col("prediction").cast("bigint").alias("predicted"))


def _standard(s, d):
    """The same rows with the naive Bayes model on the hard labels alone."""
    rows = _labelled(s, d)
    return E.train_hard(rows, "label_id").transform(rows).select("sample_id", "label_id", F.col("prediction").cast("bigint").alias("predicted"))


PLANS: dict[str, tuple] = {
    "l13_standard": (_standard, None),
    "l01_summary": (lambda s, d: _r(E.summary(_p(s, d))), f"with {CLASSES} select round(sum(hits) / sum(support), 6) accuracy, round(avg(precision), 6) precision_macro, round(avg(recall), 6) recall_macro, round(avg(f1), 6) f1_macro, round(sum(precision * support) / sum(support), 6) precision_weighted, round(sum(recall * support) / sum(support), 6) recall_weighted, round(sum(f1 * support) / sum(support), 6) f1_weighted, round(sum(hits) / sum(predicted), 6) f1_micro from cls"),
    "l01_per_class": (lambda s, d: _r(E.per_class(_p(s, d))), f"with {CLASSES} select label, support, predicted, hits, round(precision, 6) as precision, round(recall, 6) recall, round(f1, 6) f1 from cls"),
    "l02_confusion": (lambda s, d: E.confusion(_p(s, d)), f"with {PROBS} select truth, predicted, count(*) n from pd group by 1, 2"),
    "l03_auc": (lambda s, d: _r(E.auc(_p(s, d))), f"with {PROBS}, rk as (select cl, label = cl pos, rank() over (partition by cl order by p) + (count(*) over (partition by cl, p) - 1) / 2 r from pr), a as (select cl, sum(case when pos then r end) sr, count(*) filter (pos) np, count(*) filter (not pos) nn from rk group by 1) select round(avg((sr - np * (np + 1) / 2) / nullif(np * nn, 0)), 6) auc_macro from a"),
    "l04_confidence": (lambda s, d: _r(E.confidence(_p(s, d))), f"with {PROBS} select round(avg(confidence), 6) mean_confidence, round(avg(case when confidence > 0.8 and truth <> predicted then 1 else 0 end), 6) overconfidence from pd"),
    "l05_calibration": (lambda s, d: _r(E.calibration_error(_p(s, d))), f"with {PROBS}, b as (select ceil(confidence * 10) bin, count(*) n, avg(confidence) c, avg((truth = predicted)::INT) a from pd where confidence > 0 group by 1) select round(sum(abs(c - a) * n) / (select count(*) from pd), 6) ece from b"),
    "l06_compare": (lambda s, d: _r(E.compare(_two(s, d))), f"with m as (select * from {_sum_sql(None, 'full', 8.0, 2.5)} union all select * from {_sum_sql(32, 'half', 4.0, 1.25)}), x as (select *, 0.4 * f1 + 0.3 * accuracy + 0.15 * precision + 0.15 * recall score, 1 / (ms + 1) + 1 / (mb + 1) efficiency from m) select name, round(accuracy, 6) accuracy, round(precision, 6) as precision, round(recall, 6) recall, round(f1, 6) f1, ms, mb, round(score, 6) score, round(efficiency, 6) efficiency, {', '.join(f'name = (select name from x order by {c} desc, name desc limit 1) best_{c}' for c in ('accuracy', 'precision', 'recall', 'f1', 'score', 'efficiency'))}, {', '.join(f'name = (select name from x order by {c}, name limit 1) best_{c}' for c in ('ms', 'mb'))} from x"),
    "l07_report": (lambda s, d: _r(E.report(_p(s, d), ms=F.pmod("vec_id", F.lit(7)) + 1.0)), f"with {PROBS} select count(*) total, round(avg(vec_id % 7 + 1), 6) mean_ms, round(1000 / avg(vec_id % 7 + 1), 6) per_second, round(avg(confidence), 6) mean_confidence, count(*) filter (confidence > 0.9) very_high, count(*) filter (confidence between 0.7 and 0.9) high, count(*) filter (confidence >= 0.5 and confidence < 0.7) medium, count(*) filter (confidence < 0.5) low, round(avg((truth = predicted)::INT), 6) accuracy from pd"),
    "l08_inference": (lambda s, d: _r(_p(s, d).select("vec_id", "predicted", "confidence")), f"with {PROBS} select vec_id, predicted, round(confidence, 6) confidence from pd"),
    "l08_external_model": (lambda s, d: E.infer(s.read.parquet(f"{d}/documents.parquet"), lambda texts: [("long" if len(t) > 1000 else "short", 1.0) for t in texts], "doc_id"), "select doc_id, case when text is null then 'ERROR' when length(text) > 1000 then 'long' else 'short' end predicted, case when text is null then 0.0 else 1.0 end::DOUBLE confidence from documents"),
    "l09_soft_loss": (lambda s, d: _r(_logits(s, d).select("vec_id", E.soft_loss(F.col("t"), F.col("s"), F.pmod("label", F.lit(3))).alias("x")).select("vec_id", "x.*")), f"with {LOGITS} select vec_id, round(kl, 6) kl, round(ce, 6) ce, round(0.7 * kl + 0.3 * ce, 6) total from k"),
    "l10_feature_loss": (lambda s, d: _r(_logits(s, d).select("vec_id", E.feature_loss(F.col("t"), F.col("s")).alias("loss"))), "with x as (select vec_id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE] t, [embedding[4]::DOUBLE, embedding[5]::DOUBLE, embedding[6]::DOUBLE] s from embeddings), n as (select *, sqrt(list_sum(list_transform(t, lambda v: v * v))) nt, sqrt(list_sum(list_transform(s, lambda v: v * v))) ns from x) select vec_id, round(list_sum(list_transform(range(1, 4), lambda i: (t[i] / nt - s[i] / ns) * (t[i] / nt - s[i] / ns))) / 3, 6) loss from n"),
    "l11_adaptive_weights": (lambda s, d: _r(E.adaptive_weights(s.read.parquet(f"{d}/events.parquet").withColumn("hard", F.pmod("event_id", F.lit(10)) + 1.0), "user_id", ["ts", "event_id"], "value", "hard")), None),
    "l12_student": (_student, None),
    "l15_learning_rates": (lambda s, d: E.learning_rates(s, 200).select("step", F.round(F.col("rate") * 1e5, 6).alias("rate")), "select step, round((case when step <= 20 then 2e-5 * step / 20 else 2e-5 * (200 - step) / 180 end) * 1e5, 6) rate from (select unnest(range(1, 201)) step)"),
    "l15_patience": (lambda s, d: _tasks(s, d).select("task_id", E.early_stop_patience(F.col("max_retries") * 10).cast("bigint").alias("patience")), "select task_id, greatest(2, least(10, floor(0.25 * max_retries * 10)))::BIGINT patience from generation_tasks"),
    "l16_size_mb": (lambda s, d: s.read.parquet(f"{d}/model_info.parquet").select("model_name", F.round(E.size_mb(F.col("context_length") * 1000), 6).alias("mb")), "select model_name, round(context_length * 1000 * 4 / 1048576, 6) mb from model_info"),
    "l17_epochs": (lambda s, d: _r(E.epoch_metrics(s.read.parquet(f"{d}/events.parquet").select(F.pmod("user_id", F.lit(10)).alias("epoch"), F.when(F.col("event_type") != "error", F.col("value")).alias("loss")))), "select user_id % 10 epoch, round(coalesce(sum(case when event_type <> 'error' then value end), 0) / count(*), 6) loss, count(*) n_batches from events group by 1"),
    "l14_report_lines": (lambda s, d: E.report_lines(E.summary(_p(s, d))).select(F.col("line_no").cast("bigint").alias("line_no"), "line"), f"with {CLASSES}, m as (select [sum(hits) / sum(support), avg(precision), avg(recall), avg(f1), sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(hits) / sum(predicted)] v from cls) select i line_no, printf('%-20s%10.4f', ['accuracy', 'precision_macro', 'recall_macro', 'f1_macro', 'precision_weighted', 'recall_weighted', 'f1_weighted', 'f1_micro'][i + 1], v[i + 1]) line from m, (select unnest(range(8)) i)"),
    "l18_registry": (lambda s, d: E.registry(s.read.parquet(f"{d}/model_info.parquet").select("model_name", F.to_json(F.struct((F.col("context_length") * 1000).alias("params"), F.array(F.lit("a"), F.lit("b")).alias("labels"), F.col("provider").alias("architecture"))).alias("meta"))).select("model_name", "params", F.round("size_mb", 6).alias("size_mb"), F.col("n_labels").cast("bigint").alias("n_labels"), "architecture"), "select model_name, context_length::BIGINT * 1000 params, round(context_length::BIGINT * 4000 / 1048576, 6) size_mb, 2::BIGINT n_labels, provider architecture from model_info"),
    "l19_metric_line": (lambda s, d: E.metric_line(E.summary(_p(s, d))), f"with {CLASSES} select printf('accuracy=%.4f, f1_macro=%.4f, f1_weighted=%.4f', sum(hits) / sum(support), avg(f1), sum(f1 * support) / sum(support)) line from cls"),
}


def _tasks(s, d):
    return s.read.parquet(f"{d}/generation_tasks.parquet")
