"""Generation of labelled samples by a teacher: any picklable function from a prompt to a response text.

Prompts are spread over tasks; inside a task a small pool of threads calls the teacher, with retries. Responses are written to the shared folder before they are
parsed: calls cost money and may answer differently the second time, so no later step may repeat them. To stop a run, cancel its Spark job group, or give
a deadline: prompts that are not begun by then have the error `stopped`, and what is finished is kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from lexloom.functions.tables import cut
from lexloom.operators import corpus, parsing, quality, sampling

Teacher = Callable[[str], str]


def ask(teacher: Teacher, prompt: str, retries: int = 3, pause_s: float = 0.0, until: float | None = None) -> tuple[str | None, int, str | None, float]:
    """(response, attempts, error, latency): the first answer within `retries` attempts; the last error if there is none."""
    error = "no attempt"
    began = time.time()
    for k in range(1, max(1, retries) + 1):
        if until is not None and time.time() > until:
            return None, k - 1, "stopped", time.time() - began
        try:
            return teacher(prompt), k, None, time.time() - began
        except Exception as e:  # any failure of the teacher counts as one attempt
            error = f"{type(e).__name__}: {e}"
            if pause_s:
                time.sleep(pause_s * k)
    return None, max(1, retries), error, time.time() - began


def respond(prompts: DataFrame, teacher: Teacher, column: str = "prompt", retries: int = 3, workers: int = 5, pause_s: float = 0.0, deadline_s: float | None = None) -> DataFrame:
    """prompts with response, attempts, error and latency."""
    until = None if deadline_s is None else time.time() + deadline_s
    schema = StructType([*prompts.schema.fields, StructField("response", StringType()), StructField("attempts", IntegerType()), StructField("error", StringType()), StructField("latency", DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for pdf in frames:
                got = list(pool.map(lambda p: ask(teacher, p, retries, pause_s, until), pdf[column]))
                yield pdf.assign(response=[g[0] for g in got], attempts=[g[1] for g in got], error=[g[2] for g in got], latency=[g[3] for g in got])

    keys = [c for c, t in prompts.dtypes if t in ("string", "bigint", "int")]
    return prompts.repartition(2 * prompts.sparkSession.sparkContext.defaultParallelism, *keys).mapInPandas(run, schema)


def observed(df: DataFrame, name: str = "generation") -> tuple[DataFrame, Observation]:
    """df, and an observation of its rows and failures that fills as df is worked on. Take a session of its own for it: Spark 4.1 cannot apply ML models in a session that has observations."""
    o = Observation(name)
    return df.observe(o, F.count("*").alias("responses"), F.count("error").alias("failed"), F.sum("latency").alias("latency")), o


def generate(tasks: DataFrame, teacher: Teacher, batch: int = 25, retries: int = 3, workers: int = 5, min_length: int = 10, deadline_s: float | None = None) -> DataFrame:
    """(task_id, language, label, batch_no, pos, text, confidence, source) for all languages and classes of the tasks; batches whose last attempt failed have fallback rows."""
    asked = parsing.prompts(parsing.batches(tasks, batch)).drop("class_labels", "task_description", "samples_per_class")
    asked = asked.withColumn("request", F.concat_ws("/", "task_id", "language", "label", "batch_no"))
    answers = cut(respond(asked, teacher, retries=retries, workers=workers, deadline_s=deadline_s))
    keys = ["task_id", "language", "label", "batch_no"]
    good = parsing.samples(answers.where("error is null").withColumnRenamed("label", "asked"), "request", "response", "asked", min_length, batch)
    good = good.join(answers.select("request", *[F.col(k).alias(f"_{k}") for k in keys], "batch_size"), "request").where(F.col("pos") < F.col("batch_size"))
    good = good.select("_task_id", "_language", "label", "_batch_no", "pos", "text", "confidence", "source").toDF(*keys, "pos", "text", "confidence", "source")
    failed = answers.where("error is not null and error <> 'stopped'").withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("batch_size") - 1)))
    text = F.format_string("Fallback sample %d for %s class", (F.col("pos") + 1).cast("int"), F.col("label"))
    return good.unionByName(failed.select(*keys, F.col("pos").cast("bigint").alias("pos"), text.alias("text"), F.lit(0.5).alias("confidence"), F.lit("fallback").alias("source")))


def dataset(tasks: DataFrame, teacher: Teacher, threshold: float = 0.7, low: int = 10, high: int = 1000, **how) -> DataFrame:
    """Generated samples of the stated lengths and quality, with sample_id, each class of a task filled up to the size of its largest by copies."""
    g = generate(tasks, teacher, **how)
    g = g.withColumn("sample_id", F.xxhash64("task_id", "language", "label", "batch_no", "pos", "text"))
    kept = cut(quality.gate(g.where(F.length("text").between(low, high)), threshold, "text", low, high))
    kept = kept.withColumn("_class", F.concat_ws("/", "task_id", "label"))
    return sampling.oversample(kept, "sample_id", "_class").drop("_class")


def summary(made: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per task: samples, wanted number, success rate and completion."""
    return corpus.success_rate(made, tasks)
