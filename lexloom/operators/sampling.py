"""Sampling, balancing, splitting and encoding. All choices depend on a seed and the row's id only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.functions.tables import cut, numbered, ranked


def undersample(df: DataFrame, id_col: str, label: str = "label", seed: int = 42) -> DataFrame:
    """As many rows of each class as the smallest class has, by hash."""
    d = df.where(F.col(label).isNotNull())
    least = d.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("_least"))
    r = ranked(d, [label], T.uniform(seed, id_col, "under"), id_col, "_r")
    return r.crossJoin(F.broadcast(least)).where("_r <= _least").select(*df.columns)  # least is one row


def oversample(df: DataFrame, id_col: str, label: str = "label", target: int | None = None, seed: int = 42) -> DataFrame:
    """Originals, and copies of them until each class has `target` rows (default: the largest class).

    Row r of a class of c rows is copied need div c times, and once more if r <= need mod c. Copies have source `duplicated`, confidence times 0.8, and copy_no from 1.
    """
    d = df.where(F.col(label).isNotNull())
    c = d.groupBy(label).agg(F.count("*").alias("_c"))
    top = c.agg(F.max("_c").alias("_top")) if target is None else None
    c = c.crossJoin(F.broadcast(top)) if top is not None else c.withColumn("_top", F.lit(target))
    c = c.select(F.col(label).alias("_l"), "_c", F.greatest(F.col("_top") - F.col("_c"), F.lit(0)).alias("_need"))
    r = ranked(d, [label], T.uniform(seed, id_col, "over"), id_col, "_r").join(c, F.col(label) == F.col("_l"))
    times = F.expr("CAST(_need DIV _c + IF(_r <= _need % _c, 1, 0) AS INT)")
    copies = r.withColumn("copy_no", F.explode(F.sequence(F.lit(0), times)))
    made = F.col("copy_no") > 0
    out = copies.withColumn("source", F.when(made, F.lit("duplicated")).otherwise(F.col("source"))).withColumn("confidence", F.when(made, F.coalesce("confidence", F.lit(0.8)) * 0.8).otherwise(F.col("confidence")))
    return out.select(*df.columns, "copy_no")


def topped_up(df: DataFrame, id_col: str, text: str = "text", label: str = "label", target: int | None = None, within: int | None = None, seed: int = 42) -> DataFrame:
    """oversample() with changed copies: each copy's text goes through synonyms, punctuation and inserted words; source is then `augmented`, confidence (0.8 if null) times 0.9. A copy that none of them
    changes (or that has no text) stays a duplicate. within: at most so many copies of each row, as a top-up by sampling has (2).
    """
    from lexloom.operators.augment import varied

    d = oversample(df.withColumn("_confidence", F.col("confidence")).withColumn("_text", F.col(text)), id_col, label, target, seed)
    if within is not None:
        d = d.where(F.col("copy_no") <= within)
    v = varied(d, F.concat_ws("/", F.col(id_col).cast("string"), F.col("copy_no").cast("string")), text, ("synonym", "punctuation", "insert"), seed)
    made = (F.col("copy_no") > 0) & (F.size("augmentation_strategies") > 0)
    v = v.withColumn(text, F.when(made, F.col(text)).otherwise(F.col("_text"))).withColumn("source", F.when(made, F.lit("augmented")).otherwise(F.col("source")))
    v = v.withColumn("confidence", F.when(made, F.coalesce("_confidence", F.lit(0.8)) * 0.9).otherwise(F.col("confidence")))
    return v.select(*df.columns, "copy_no")


def _quotas(counts: DataFrame, share: Column, name: str) -> DataFrame:
    """Whole numbers that add up to _want over the classes, in proportion to `share` (a column of _n), by largest remainder; ties by class."""
    exact = F.round(share, 9)
    q = counts.withColumn("_floor", F.floor(exact)).withColumn("_rest", exact - F.floor(exact))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("_rest"), "_l")
    q = q.withColumn("_k", F.row_number().over(w)).withColumn("_left", F.col("_want") - F.sum("_floor").over(Window.partitionBy(F.lit(0))))  # one row for each class
    return q.withColumn(name, (F.col("_floor") + F.when(F.col("_k") <= F.col("_left"), 1).otherwise(0)).cast("bigint")).drop("_floor", "_rest", "_k", "_left", "_want")


def split3(df: DataFrame, id_col: str, label: str | None = "label", ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), sizes_first: bool = False, seed: int = 42) -> DataFrame:
    """df with `part` (train, validation, test), stratified by label (null is a class of its own) or over all rows.

    Sizes: test = ceil(n * test), validation = ceil(rest * val / (train + val)); with sizes_first, train = floor(n * train), validation = floor(n * val), test the
    rest. Each class gets its share by largest remainder; within a class the rows go by hash.
    """
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError(f"the ratios add up to {sum(ratios)}, not 1")
    train, val, test = ratios
    key = F.coalesce(F.col(label), F.lit("")) if label else F.lit("")
    d = df.withColumn("_l", key)
    c = d.groupBy("_l").agg(F.count("*").alias("_n"))
    n = c.agg(F.sum("_n").alias("_all"))
    if sizes_first:
        n_val = F.floor(F.col("_all") * val + 1e-9)
        n_test = F.col("_all") - F.floor(F.col("_all") * train + 1e-9) - n_val
    else:
        n_test = F.ceil(F.col("_all") * test - 1e-9)
        n_val = F.ceil((F.col("_all") - n_test) * (val / (train + val)) - 1e-9)
    n = n.select("_all", n_test.cast("bigint").alias("_t"), n_val.cast("bigint").alias("_v"))
    c = c.crossJoin(F.broadcast(n))
    c = _quotas(c.withColumn("_want", F.col("_t")), F.col("_n") * F.col("_t") / F.col("_all"), "_qt")
    c = _quotas(c.withColumn("_want", F.col("_v")), (F.col("_n") - F.col("_qt")) * F.col("_v") / (F.col("_all") - F.col("_t")), "_qv")
    r = ranked(d, ["_l"], T.uniform(seed, id_col, "split"), id_col, "_r").join(c.select("_l", "_qt", "_qv"), "_l")
    part = F.when(F.col("_r") <= F.col("_qt"), "test").when(F.col("_r") <= F.col("_qt") + F.col("_qv"), "validation").otherwise("train")
    return r.withColumn("part", part).select(*df.columns, "part")


def label_ids(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, label_id): ids from 0 in the order of the labels. The distinct labels are a small table."""
    return df.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct().withColumn("label_id", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label")) - 1).cast("bigint"))


def encode_labels(df: DataFrame, label: str = "label") -> DataFrame:
    ids = label_ids(df, label)
    return df.join(ids.withColumnRenamed("label", "_l"), F.col(label) == F.col("_l"), "left").drop("_l")


def dictionary(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, word_id, n): ids from 1 in the order of the words' md5, which is uniform, so the ranks need no single task; n is the word's count."""
    w = T.spread(df.where(F.col(text).isNotNull()).select(text), text).select(F.explode(T.tokens(F.lower(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    u = F.conv(F.substring(F.md5("word"), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return ranked(cut(w.withColumn("_h", F.md5("word"))), [], u, "_h", "word_id").select("word", "word_id", "n")


#: A word with at least one in COMMON of all tokens is common; there can be at most COMMON such words, so their list may be broadcast.
COMMON = 2000


def word_ids(df: DataFrame, id_col: str, text: str = "text", limit: int = 512) -> DataFrame:
    """(id, input_ids, attention_mask): the ids of the first `limit` words of each text; texts without words have empty lists. Common words get their ids where they are; only the others are shuffled by word."""
    d = T.spread(df.select(id_col, text), id_col)
    each = d.select(id_col, F.posexplode(F.slice(T.tokens(F.lower(text)), 1, limit)).alias("k", "word"))
    words = cut(dictionary(df, text))
    least = words.agg((F.sum("n") / COMMON).alias("_least"))
    common = words.crossJoin(F.broadcast(least)).where("n >= _least").select("word", F.col("word_id").alias("_id"))
    marked = each.join(F.broadcast(common), "word", "left")
    rare = marked.where("_id is null").select(id_col, "k", "word").join(words.select("word", "word_id"), "word").select(id_col, "k", "word_id")
    ids = marked.where("_id is not null").select(id_col, "k", F.col("_id").alias("word_id")).unionByName(rare)
    ids = ids.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "word_id"))), lambda x: x["word_id"]).alias("input_ids"))  # `limit` words at most
    out = d.select(id_col).join(ids, id_col, "left").withColumn("input_ids", F.coalesce("input_ids", F.array().cast("array<bigint>")))
    return out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def padded(encoded: DataFrame, id_col: str, batch: int = 16, multiple: int = 1) -> DataFrame:
    """encoded with batch_no (ids in order, `batch` to a batch) and lists filled with 0 to the batch's longest, rounded up to `multiple`."""
    d = numbered(encoded, id_col).withColumn("batch_no", F.expr(f"(rn - 1) DIV {batch}"))
    top = F.max(F.size("input_ids")).over(Window.partitionBy("batch_no"))
    d = d.withColumn("_w", (F.ceil(top / multiple) * multiple).cast("int"))
    fill = lambda c: F.concat(F.col(c), F.array_repeat(F.lit(0).cast(encoded.schema[c].dataType.elementType), F.col("_w") - F.size(c)))
    return d.withColumn("input_ids", fill("input_ids")).withColumn("attention_mask", fill("attention_mask")).drop("_w", "rn")


def sample_k(df: DataFrame, id_col: str, k: int, seed: int = 42, tag: str = "jury") -> DataFrame:
    """k rows by hash (a top-k: each task keeps k)."""
    return df.withColumn("_u", T.uniform(seed, id_col, tag)).orderBy("_u", id_col).limit(k).drop("_u")
