"""Joins that line up predictions, labels, prices, classes and lists. Small sides are left to the optimizer, which broadcasts them by their measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T


def with_truth(predictions: DataFrame, truth: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Predictions with true_label, by key instead of by position; rows without a truth are dropped."""
    return predictions.join(truth.select(key, F.col(label).alias("true_label")), key)


def decode(df: DataFrame, ids: DataFrame, id_col: str = "label_id") -> DataFrame:
    """df with the label of each label_id; unknown ids have null."""
    return df.join(ids.select(F.col("label_id").alias(id_col), F.col("label").alias("decoded_label")), id_col, "left")


def priced(calls: DataFrame, models: DataFrame) -> DataFrame:
    """calls with estimated_cost from the price list per 1,000 tokens; unknown models and null counts cost 0."""
    p = models.select(F.col("model_name").alias("model"), "input_cost_per_1k", "output_cost_per_1k")
    cost = F.col("input_tokens") / 1000 * F.col("input_cost_per_1k") + F.col("output_tokens") / 1000 * F.col("output_cost_per_1k")
    return calls.join(p, "model", "left").withColumn("estimated_cost", F.coalesce(cost, F.lit(0.0))).drop("input_cost_per_1k", "output_cost_per_1k")


def missing_classes(df: DataFrame, targets: DataFrame, label: str = "label") -> DataFrame:
    """Target labels without a row."""
    return targets.select("label").distinct().join(df.select(F.col(label).alias("label")), "label", "left_anti")


def not_listed(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key), key, "left_anti")


def containing(df: DataFrame, words: DataFrame, id_col: str, text: str = "text", word: str = "entry") -> DataFrame:
    """(id, word): the listed words (in lower case) that occur as tokens of each text."""
    each = T.spread(df.select(id_col, text), id_col).select(id_col, F.explode(F.array_distinct(T.tokens(F.lower(text)))).alias("word"))
    return each.join(words.select(F.lower(word).alias("word")).distinct(), "word").select(id_col, "word")
