"""Records in generator output, and what the generator is asked for. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T


def json_array(c: Column) -> Column:
    """From the first [ to the last ]; without a ] after it, up to the last complete object, closed; null without [ or complete object."""
    t = F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    start = F.instr(t, "[")
    end = F.length(t) - F.instr(F.reverse(t), F.lit("]")) + 1
    whole = F.contains(F.substr(t, start), F.lit("]"))
    rest = F.substr(t, start)
    cut = F.length(rest) - F.instr(F.reverse(rest), F.lit(",}")) + 1  # the comma of the last "},"
    return F.when(start == 0, None).when(whole, F.substr(t, start, end - start + 1)).when(F.contains(rest, F.lit("},")), F.concat(F.left(rest, cut - 1), F.lit("]")))


def samples(df: DataFrame, id_col: str, text: str = "text", expected: str | None = None, min_length: int = 10, limit: int = 25) -> DataFrame:
    """(id, pos, text, label, confidence, source): the objects of each response's array, the first `limit` that have a long enough text.

    A missing label is `expected` (a column), a missing confidence 0.8. An object without a string text is dropped alone. Responses without an array give no row.
    """
    schema = "array<struct<text: string, label: string, confidence: double>>"
    label = F.col(expected) if expected else F.lit("")
    d = T.spread(df, id_col).select(id_col, label.alias("_l"), F.posexplode(F.from_json(json_array(F.col(text)), schema)).alias("k", "x"))
    d = d.select(id_col, "_l", "k", F.regexp_replace("x.text", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("text"), F.coalesce("x.label", "_l").alias("label"), F.coalesce("x.confidence", F.lit(0.8)).alias("confidence")).where(F.length("text") >= min_length)
    kept = d.groupBy(id_col).agg(F.slice(F.array_sort(F.collect_list(F.struct("k", "text", "label", "confidence"))), 1, limit).alias("a"))  # one response's objects
    return kept.select(id_col, F.posexplode("a").alias("pos", "x")).select(id_col, F.col("pos").cast("bigint").alias("pos"), "x.text", "x.label", "x.confidence", F.lit("generated").alias("source"))


def fallbacks(tasks: DataFrame, n: int = 3) -> DataFrame:
    """n placeholder rows for each task and class."""
    d = tasks.select("task_id", F.explode("class_labels").alias("label")).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return d.select("task_id", "label", F.format_string("Fallback sample %d for %s class", F.col("i"), F.col("label")).alias("text"), F.lit(0.5).alias("confidence"), F.lit("fallback").alias("source"))


def batches(tasks: DataFrame, size: int = 25) -> DataFrame:
    """(task_id, language, label, batch_no, batch_size): languages x classes x batches of at most `size`; tasks without languages use `en`."""
    lang = F.when(F.size("languages") > 0, F.col("languages")).otherwise(F.array(F.lit("en")))
    d = tasks.where("samples_per_class > 0").select("task_id", "samples_per_class", "task_description", "class_labels", F.explode(lang).alias("language"))
    d = d.withColumn("label", F.explode("class_labels"))
    n = F.ceil(F.col("samples_per_class") / size).cast("int")
    d = d.withColumn("batch_no", F.explode(F.sequence(F.lit(1), n)))
    return d.withColumn("batch_size", F.least(F.lit(size), F.col("samples_per_class") - (F.col("batch_no") - 1) * size).cast("bigint")).withColumn("batch_no", F.col("batch_no").cast("bigint"))


def prompts(b: DataFrame) -> DataFrame:
    """batches() with the request for each."""
    line = F.concat(F.lit("Write "), F.col("batch_size").cast("string"), F.lit(" texts in "), F.col("language"), F.lit(' of class "'), F.col("label"), F.lit('" (classes: '), F.array_join("class_labels", ", "), F.lit("). Task: "), F.coalesce("task_description", F.lit("")), F.lit(". Answer with a JSON array of objects with text, label and confidence."))
    return b.withColumn("prompt", line)


def verdicts(df: DataFrame, column: str) -> DataFrame:
    """df with correct, quality_score and explanation of a judge's JSON; defaults false, 3 and empty."""
    v = F.from_json(column, "struct<correct: boolean, quality_score: double, explanation: string>")
    return df.withColumn("_v", v).withColumn("correct", F.coalesce("_v.correct", F.lit(False))).withColumn("jury_score", F.coalesce("_v.quality_score", F.lit(3.0))).withColumn("explanation", F.coalesce("_v.explanation", F.lit(""))).drop("_v")


def slug(c: Column, limit: int = 50, default: str = "dataset") -> Column:
    """A folder name: white space collapsed, cut, signs that paths cannot hold as _, dots and underscores at the end dropped."""
    s = F.regexp_replace(F.left(T.squeeze(c), F.lit(limit)), r'[<>:"|?*\\/\n\r\t]', "_")
    s = F.regexp_replace(s, r"[._ ]+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(default)).otherwise(s)
