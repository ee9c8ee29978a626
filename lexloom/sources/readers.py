"""Readers of labelled text: JSON lines, JSON, CSV, Parquet, text lines, dataset folders and model folders.

All give text and label as strings (null stays null) and keep the other columns. Rows without one of the two are dropped; files that lack a column are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class FormatError(ValueError):
    """A format that is not supported, or a file that lacks what is needed."""


def read(spark: SparkSession, path: str, text: str = "text", label: str = "label") -> DataFrame:
    """By the path's suffix, whatever its case: .jsonl, .json, .csv, .parquet."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    readers = {"jsonl": read_jsonl, "json": read_json, "csv": read_csv, "parquet": read_parquet}
    if suffix not in readers:
        raise FormatError(f"unsupported format: {path}")
    return readers[suffix](spark, path, text, label)


def _checked(df: DataFrame, text: str, label: str) -> DataFrame:
    if not [c for c in df.columns if c != "_corrupt_record"]:  # files without any row have no columns either
        return df.sparkSession.createDataFrame([], "text string, label string")
    missing = [c for c in (text, label) if c not in df.columns]
    if missing:
        raise FormatError(f"missing columns: {', '.join(missing)}")
    rest = [c for c in df.columns if c not in (text, label, "_corrupt_record")]
    return df.select(F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label"), *rest).where("text is not null and label is not null")


def read_jsonl(spark: SparkSession, path: str, text: str = "text", label: str = "label", schema: str | None = None) -> DataFrame:
    """One object a line; lines that do not parse are skipped."""
    r = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return _checked((r.schema(schema) if schema else r).json(path), text, label)


def read_jsonl_numbered(spark: SparkSession, path: str, text: str = "text", label: str = "label") -> DataFrame:
    """(path, line_number, text, label): lines counted from 1 in each file, which is read whole: for files that fit into a task."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("k", "line")).where("trim(line) <> ''")
    o = lines.select("path", (F.col("k") + 1).cast("bigint").alias("line_number"), F.from_json("line", "map<string, string>").alias("m"))
    return o.select("path", "line_number", F.element_at("m", text).alias("text"), F.element_at("m", label).alias("label")).where("text is not null and label is not null")


def read_json(spark: SparkSession, path: str, text: str = "text", label: str = "label") -> DataFrame:
    """An array of objects, or one object, over any number of lines."""
    return _checked(spark.read.option("multiLine", True).json(path), text, label)


def read_csv(spark: SparkSession, path: str, text: str = "text", label: str = "label") -> DataFrame:
    """With a header; quoted values may hold line breaks and doubled quotes. All values are strings."""
    return _checked(spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False), text, label)


def read_parquet(spark: SparkSession, path: str, text: str = "text", label: str = "label") -> DataFrame:
    return _checked(spark.read.parquet(path), text, label)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text <> ''")


def read_for_inference(spark: SparkSession, path: str, text: str = "text", label: str | None = None) -> DataFrame:
    """Trimmed, non-blank texts of CSV or JSON lines, each with its own label where there is one."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False) if path.lower().rstrip("/").endswith("csv") else spark.read.json(path)
    if text not in raw.columns:
        raise FormatError(f"missing columns: {text}")
    kept = raw.select(F.trim(F.col(text).cast("string")).alias("text"), *([F.col(label).cast("string").alias("true_label")] if label and label in raw.columns else []))
    return kept.where("text <> ''")


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """samples.jsonl of a dataset folder; an error if it has no row with text and label."""
    d = read_jsonl(spark, f"{folder.rstrip('/')}/samples.jsonl")
    if d.limit(1).isEmpty():
        raise FormatError(f"no samples in {folder}")
    return d


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def valid_folder(spark: SparkSession, folder: str) -> bool:
    """Whether samples.jsonl and metadata.json are there and the first line parses."""
    base = folder.rstrip("/")
    if not all(_exists(spark, f"{base}/{n}") for n in ("samples.jsonl", "metadata.json")):
        return False
    first = spark.read.text(f"{base}/samples.jsonl").limit(1).select(F.from_json("value", "map<string, string>").alias("m")).collect()
    return bool(first) and first[0]["m"] is not None and len(first[0]["m"]) > 0


def files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, folder, name, size, modified) of the files that fit the glob; contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return d.withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))


def latest_folder(spark: SparkSession, root: str) -> DataFrame:
    """The folder that holds the newest file."""
    return files(spark, root).agg(F.max_by("folder", F.struct("modified", "folder")).alias("folder"))


def model_folders(spark: SparkSession, root: str) -> DataFrame:
    """(folder, size_mb, modified), newest first, of folders with a config.json and a weights file."""
    d = files(spark, root).groupBy("folder").agg(F.bool_or(F.col("name") == "config.json").alias("c"), F.bool_or(F.col("name").isin("pytorch_model.bin", "model.safetensors")).alias("w"), (F.sum("size") / 2**20).alias("size_mb"), F.max("modified").alias("modified"))
    return d.where("c and w").select("folder", "size_mb", "modified").orderBy(F.desc("modified"), "folder")
