"""Writers of samples, dataset folders and inference results. Each writes a folder of part files, from all tasks at once."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.evaluation import flatten_top
from lexloom.operators.parsing import slug
from lexloom.sources.readers import FormatError


def save(df: DataFrame, path: str, form: str | None = None, mode: str = "overwrite") -> None:
    """As jsonl, json, csv (columns by name, header) or parquet; by the path's suffix if no form is given. An empty table gives an empty folder."""
    form = (form or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    w = df.write.mode(mode)
    if form == "jsonl":
        w.option("ignoreNullFields", False).json(path)
    elif form == "json":
        one = df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
        one.mapInArrow(_array, "value string").write.mode(mode).text(path)
    elif form == "csv":
        nested = ("array", "map", "struct")
        flat = df.select(*[(F.to_json(c) if t.startswith(nested) else F.col(c)).alias(c) for c, t in sorted(df.dtypes)])
        flat.write.mode(mode).csv(path, header=True, escape='"', quote='"', quoteAll=True, emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    elif form == "parquet":
        w.parquet(path)
    else:
        raise FormatError(f"unsupported format: {form}")


def _array(batches):
    """Each part file is one JSON array."""
    import pyarrow as pa

    first = True
    for b in batches:
        values = b.column(0).to_pylist()
        out = []
        for v in values:
            out.append(("[" if first else ",") + v)
            first = False
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"], pa.string())], ["value"])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file (metadata, descriptions)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def save_result(df: DataFrame, path: str, metadata: dict, form: str = "jsonl") -> None:
    """Samples, and beside them a .metadata.json."""
    save(df, path, form)
    write_text(df.sparkSession, f"{path.rstrip('/')}.metadata.json", json.dumps(metadata, ensure_ascii=False, indent=2, default=str))


def folder_name(session: Column, task: Column) -> Column:
    return F.concat(session, F.lit("_"), slug(task))


def save_folder(df: DataFrame, folder: str, description: str, metadata: dict, label: str = "label") -> None:
    """A dataset folder: samples.jsonl, metadata.json, task_description.txt, class_distribution.txt (one line for each class)."""
    base = folder.rstrip("/")
    save(df, f"{base}/samples.jsonl", "jsonl")
    spark = df.sparkSession
    write_text(spark, f"{base}/metadata.json", json.dumps(metadata, ensure_ascii=False, indent=2, default=str))
    write_text(spark, f"{base}/task_description.txt", description)
    df.groupBy(F.coalesce(label, F.lit("unknown")).alias("label")).agg(F.count("*").alias("n")).select(F.concat_ws(": ", "label", F.col("n").cast("string")).alias("value")).coalesce(1).write.mode("overwrite").text(f"{base}/class_distribution.txt")


def save_inference(p: DataFrame, path: str, id_col: str, model: str) -> None:
    """Predictions (with top_k): CSV with a column for each of the three best, JSON with metadata beside it, else JSON lines."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        extra = [c for c in ("true_label",) if c in p.columns]
        save(flatten_top(p, id_col).join(p.select(id_col, *extra), id_col) if extra else flatten_top(p, id_col), path, "csv")
    elif suffix == "json":
        n = p.agg(F.count("*").alias("n")).first()["n"]
        save_result(p, path, {"model": model, "n": n}, "json")
    else:
        save(p, path, "jsonl")


def export_metrics(metrics: DataFrame) -> DataFrame:
    """One JSON string of a row of measures."""
    return metrics.select(F.to_json(F.struct(*sorted(metrics.columns))).alias("json"))


def save_history(history: DataFrame, config: dict, folder: str) -> None:
    """A training run's rows (one for each epoch) as training_history.json, and its configuration as training_config.json."""
    base = folder.rstrip("/")
    save(history, f"{base}/training_history.json", "json")
    write_text(history.sparkSession, f"{base}/training_config.json", json.dumps(config, ensure_ascii=False, indent=2, default=str))


def export_keys(keys: DataFrame, usage: bool = True) -> DataFrame:
    """Metadata of keys for export: the key itself only masked, its usage only if asked for."""
    from lexloom.operators.audit import mask

    return keys.select("name", "provider", mask(F.col("key")).alias("masked_key"), "is_active", *(["usage_count"] if usage else []))
