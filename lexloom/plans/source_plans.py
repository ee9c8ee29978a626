"""Queries of sources and sinks (a, b): what is written is read again. With their SQL."""

from __future__ import annotations

import atexit
import time
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.functions.tables import shared_dir
from lexloom.operators import corpus, evaluation
from lexloom.plans.text_plans import _docs, _samples
from lexloom.sources import readers, writers


def _place(s, name: str) -> str:
    path = f"{shared_dir(s)}/io-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            p = s._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(s._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            pass

    atexit.register(remove)
    return f"{path}/{name}"


def _with_id(df):
    """What was read from files without a row has no columns of its own."""
    return df if "sample_id" in df.columns else df.withColumn("sample_id", F.lit(None).cast("bigint"))


def _trip(form: str):
    def run(s, d):
        path = _place(s, f"samples.{form}")
        writers.save(_samples(s, d).select("sample_id", "text", "label"), path)
        return _with_id(readers.read(s, path)).select(F.col("sample_id").cast("bigint").alias("sample_id"), "text", "label")

    return run


def _numbered(s, d):
    path = _place(s, "one.jsonl")
    writers.save(_samples(s, d).select("sample_id", "text", "label").repartition(4, "sample_id"), path)
    return readers.read_jsonl_numbered(s, path).select("text", "label")


def _lines(s, d):
    path = _place(s, "lines")
    _docs(s, d).where("text is not null").select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.text(path)
    return readers.read_lines(s, path).groupBy("text").agg(F.count("*").alias("n"))


def _inference(s, d):
    path = _place(s, "in.csv")
    writers.save(_samples(s, d).select("text", "label"), path)
    return readers.read_for_inference(s, path, label="label").groupBy("true_label", F.md5("text").alias("h")).agg(F.count("*").alias("n"))


def _written(s, d) -> str:
    path = _place(s, "set")
    writers.save_folder(_samples(s, d).select("sample_id", "text", "label"), path, "all samples", {"source": "test"})
    return path


def _folder(s, d):
    path = _written(s, d)
    try:
        return _with_id(readers.read_folder(s, path)).select("sample_id", "text", "label")
    except readers.FormatError:  # no row has a text and a label
        return _samples(s, d).limit(0).select("sample_id", "text", "label")


def _valid(s, d):
    path = _written(s, d)
    return s.createDataFrame([(readers.valid_folder(s, path), readers.valid_folder(s, path + "-missing"))], "ok boolean, missing boolean")


def _distribution(s, d):
    line = F.split("value", ": (?=[0-9]+$)")
    return s.read.text(f"{_written(s, d)}/class_distribution.txt").select(line[0].alias("label"), line[1].cast("bigint").alias("n"))


def _model_root(s) -> str:
    root = _place(s, "models")
    for name in ("old", "new"):
        for f in ("config.json", "model.safetensors"):
            writers.write_text(s, f"{root}/{name}/{f}", name * 10)
        time.sleep(1.1)  # file times may be whole seconds
    writers.write_text(s, f"{root}/broken/config.json", "no weights")
    return root


def _models(s, d):
    m = readers.model_folders(s, _model_root(s))
    return m.select(F.regexp_extract("folder", "([^/]*)$", 1).alias("name"), F.row_number().over(Window.orderBy(F.desc("modified"))).cast("bigint").alias("place"), F.round(F.col("size_mb") * 2**20).cast("bigint").alias("bytes"))  # a listing of two folders


def _result(s, d):
    path = _place(s, "result.jsonl")
    writers.save_result(_samples(s, d).select("sample_id", "text", "label"), path, {"n": 7, "task": "t"})
    side = s.read.json(f"{path}.metadata.json", multiLine=True).select(F.col("n").cast("bigint").alias("meta_n"), F.col("task").alias("meta_task"))
    return readers.read(s, path).agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).crossJoin(side)


def _predictions(form: str):
    def run(s, d):
        path = _place(s, f"out.{form}")
        p = evaluation.nearest_centroid(s.read.parquet(f"{d}/embeddings.parquet"), "vec_id")
        writers.save_inference(p, path, "vec_id", "m")
        back = s.read.csv(path, header=True) if form == "csv" else readers.read_json(s, path) if form == "json" else s.read.json(path)
        return back.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("predicted").cast("string").alias("predicted"))

    return run


def _history(s, d):
    path = _place(s, "run")
    writers.save_history(corpus.class_counts(_samples(s, d)), {"epochs": 3, "model": "m"}, path)
    config = s.read.json(f"{path}/training_config.json", multiLine=True).select("epochs", "model")
    return s.read.json(f"{path}/training_history.json", multiLine=True).select(F.col("label"), F.col("n").cast("bigint").alias("n")).crossJoin(config)


def _keys(s, d):
    k = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("name"), F.lit("p").alias("provider"), F.col("c_name").alias("key"), (F.col("c_custkey") % 2 == 0).alias("is_active"), F.col("c_custkey").cast("bigint").alias("usage_count"))
    path = _place(s, "keys.jsonl")
    writers.save(writers.export_keys(k), path)
    return s.read.json(path).select("name", "provider", "masked_key", "is_active", "usage_count")


def _flat(s, d):
    return evaluation.flatten_top(evaluation.nearest_centroid(s.read.parquet(f"{d}/embeddings.parquet"), "vec_id"), "vec_id").select("vec_id", "predicted", "top_1_label", "top_2_label", "top_3_label")


BOTH = "from samples where text is not null and label is not null"
from lexloom.plans.evaluation_plans import PROBS  # noqa: E402

PLANS: dict[str, tuple] = {
    "a02_jsonl": (_trip("jsonl"), f"select sample_id, text, label {BOTH}"),
    "a02_jsonl_numbered": (_numbered, f"select text, label {BOTH}"),
    "a03_json": (_trip("json"), f"select sample_id, text, label {BOTH}"),
    "a04_csv": (_trip("csv"), f"select sample_id, text, label {BOTH} and text <> '' and label <> ''"),
    "a05_parquet": (_trip("parquet"), f"select sample_id, text, label {BOTH}"),
    "a06_lines": (_lines, "select t as text, count(*) n from (select trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), ' ') t from documents where text is not null) where t <> '' group by 1"),
    "a07_inference_input": (_inference, "select nullif(label, '') true_label, md5(trim(text, ' ')) h, count(*) n from samples where trim(text, ' ') <> '' group by 1, 2"),
    "a08_folder": (_folder, f"select sample_id, text, label {BOTH}"),
    "a09_valid_folder": (_valid, f"select count(*) > 0 ok, false missing {BOTH}"),
    "a10_latest_folder": (lambda s, d: readers.latest_folder(s, _model_root(s)).select(F.regexp_extract("folder", "([^/]*)$", 1).alias("name")), "select 'broken' as name"),
    "a11_model_folders": (_models, "select * from (values ('new', 1::BIGINT, 60::BIGINT), ('old', 2, 60)) t(name, place, bytes)"),
    "b02_result": (_result, f"select count(*) n, count(distinct label) labels, 7::BIGINT meta_n, 't' meta_task {BOTH}"),
    "b03_distribution": (_distribution, "select coalesce(label, 'unknown') as label, count(*) n from samples group by 1"),
    "b04_predictions_csv": (_predictions("csv"), f"with {PROBS} select vec_id, (max(cl) filter (k = 1))::VARCHAR predicted from top group by 1"),
    "b04_predictions_jsonl": (_predictions("jsonl"), f"with {PROBS} select vec_id, (max(cl) filter (k = 1))::VARCHAR predicted from top group by 1"),
    "b07_history": (_history, "select coalesce(label, '') as label, count(*) n, 3::BIGINT epochs, 'm' model from samples group by 1"),
    "b08_keys": (_keys, "select c_name as name, 'p' provider, case when n <= 8 then repeat('*', n) else left(c_name, w) || repeat('*', n - 2 * w) || right(c_name, w) end masked_key, c_custkey % 2 = 0 is_active, c_custkey::BIGINT usage_count from (select c_custkey, c_name, length(c_name) n, least(4, length(c_name) // 4) w from customer)"),
    "b03_folder_names": (lambda s, d: s.read.parquet(f"{d}/generation_tasks.parquet").select("task_id", writers.folder_name(F.lit("s1"), F.col("task_description")).alias("name")), "select task_id, 's1_' || case when coalesce(x, '') = '' then 'dataset' else x end as name from (select task_id, regexp_replace(regexp_replace(left(trim(regexp_replace(task_description, '[\\s\\p{Z}]+', ' ', 'g')), 50), '[<>:\"|?*\\\\/\\n\\r\\t]', '_', 'g'), '[._ ]+$', '') x from generation_tasks)"),
    "b05_flat_top": (_flat, f"with {PROBS} select vec_id, max(cl) filter (k = 1) predicted, max(cl) filter (k = 1) top_1_label, max(cl) filter (k = 2) top_2_label, max(cl) filter (k = 3) top_3_label from top group by 1"),
    "b06_metrics_json": (lambda s, d: writers.export_metrics(corpus.class_counts(_samples(s, d)).agg(F.count("*").alias("classes"), F.sum("n").alias("rows"))), "select '{\"classes\":' || count(*) || ',\"rows\":' || sum(n)::BIGINT || '}' json from (select count(*) n from samples group by coalesce(label, ''))"),
}
