"""Cleaning, filters and predicates on samples. Null texts are kept as null by column functions and dropped by row operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T


def non_empty(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.col(text).isNotNull() & (F.col(text) != ""))


def preprocess(df: DataFrame, id_col: str, text: str = "text", lowercase: bool = True, remove_special: bool = True, min_length: int = 5, max_length: int = 1000, dedup: bool = True) -> DataFrame:
    """Squeeze, lower, strip; drop short texts, cut long ones; keep the first row (by id) of each text.

    Adds original_text and preprocessed. Empty input gives an empty result; other columns stay.
    """
    t = T.squeeze(text)
    t = F.lower(t) if lowercase else t
    t = F.trim(T.strip_special(t)) if remove_special else t
    out = non_empty(df, text).withColumn("original_text", F.col(text)).withColumn(text, t)
    out = out.where(F.length(text) >= min_length).withColumn(text, F.left(F.col(text), F.lit(max_length))).withColumn("preprocessed", F.lit(True))
    return first_of(out, text, id_col) if dedup else out


def first_of(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """One row for each key: that with the smallest id. Combined on the map side, by the key's 128-bit hash, so no long text is compared and no hot key is gathered."""
    best = df.groupBy(F.md5(F.col(key)).alias("_h")).agg(F.min_by(F.struct(*df.columns), F.col(id_col)).alias("_r"))
    return best.select(*[F.col(f"_r.{c}").alias(c) for c in df.columns])


def length_gate(df: DataFrame, text: str = "text", label: str = "label", min_length: int = 10, max_length: int = 1000) -> DataFrame:
    """Rows with a label and a text of min_length to max_length characters."""
    return df.where(F.length(text).between(min_length, max_length) & F.col(label).isNotNull() & (F.col(label) != ""))


def clean_labels(df: DataFrame, label: str, order: str) -> DataFrame:
    """Trimmed labels, each once whatever its case, in the spelling that comes first by `order`; (label, first_at)."""
    t = df.select(F.trim(label).alias("label"), F.col(order).alias("o")).where("label <> ''")
    return t.groupBy(F.lower("label").alias("k")).agg(F.min_by("label", F.struct("o", "label")).alias("label"), F.min("o").alias("first_at")).drop("k")


def valid_name(c: Column) -> Column:
    """Not blank, at most 50 characters, no path or quote sign, line break or tab."""
    return F.coalesce((F.trim(c) != "") & (F.length(F.trim(c)) <= 50) & ~c.rlike(r'[/\\:*?"<>|\n\t]'), F.lit(False))


def truncate(c: Column, limit: int, suffix: str = "...") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - len(suffix))), F.lit(suffix))).otherwise(c)


def _tenth(c: Column) -> Column:
    """To one decimal, halves up, by the same steps as in any engine with IEEE numbers."""
    return (F.floor(c * 10 + 0.5) / 10).cast("double")


def human_size(c: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal; null stays null."""
    one = lambda d, u: F.format_string(f"%.1f {u}", _tenth(c / d))
    return F.when(c < 1024, F.format_string("%.0f B", c.cast("double"))).when(c < 1024**2, one(1024.0, "KB")).when(c < 1024**3, one(1024.0**2, "MB")).when(c.isNotNull(), one(1024.0**3, "GB"))


def human_duration(c: Column) -> Column:
    """Seconds as s, m s or h m; null stays null."""
    whole = F.floor(c)
    return (
        F.when(c < 60, F.format_string("%.1fs", _tenth(c)))
        .when(c < 3600, F.format_string("%dm %ds", F.floor(c / 60), F.pmod(whole, F.lit(60))))
        .when(c.isNotNull(), F.format_string("%dh %dm", F.floor(c / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60)))
    )


def human_number(c: Column, digits: int = 3) -> Column:
    """Thousands with commas; three decimals otherwise."""
    r = F.round(c, digits).cast("double")
    return F.when(F.abs(c) >= 1000, F.format_string(f"%,.{digits}f", r)).otherwise(F.format_string(f"%.{digits}f", r))


def learning_rate(c: Column) -> Column:
    """The number, if the string is a rate above 0 and at most 1; null otherwise."""
    n = F.when(c.rlike(r"^[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?$"), c.try_cast("double"))
    return F.when((n > 0) & (n <= 1), n)


def bounded_int(c: Column, low: int = 1, high: int | None = None) -> Column:
    """The integer, if the string is one within the bounds; null otherwise."""
    n = F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("bigint"))
    return F.when((n >= low) & (F.lit(True) if high is None else n <= high), n)
