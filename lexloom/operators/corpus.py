"""Measures of whole collections: lengths, vocabulary, diversity, class balance, duplicates, near-duplicates, distinct n-grams.

Each operator takes rows with a text and gives one row (or one for each class). Null and empty texts are left out; an empty
table gives counts of 0 and ratios of 0 or null as stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.functions.tables import cut, running
from lexloom.operators import quality


def _texts(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.col(text).isNotNull() & (F.col(text) != ""))


def tokenised(df: DataFrame, id_col: str, text: str = "text", *keep: str) -> DataFrame:
    """One row for each text with: id, t (lower-case tokens), terms (of TF-IDF), n_sentences, punctuation (hash of the pattern), and the columns of `keep`. Written once; the measures read it instead of splitting texts again."""
    d = T.spread(_texts(df, text).select(F.col(id_col).alias("id"), F.col(text).alias("_x"), *keep), "id")
    return cut(d.select("id", *keep, T.tokens(F.lower("_x")).alias("t"), tfidf_terms(F.col("_x")).alias("terms"), F.size(T.sentences("_x")).alias("n_sentences"), F.md5(T.punctuation("_x")).alias("punctuation")))


def _tokens(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, t): rows that tokenised() made as they are; others are split."""
    if "t" in df.columns and "punctuation" in df.columns:
        return df.select("id", "t")
    return T.spread(_texts(df, text).select(F.col(id_col).alias("id"), F.col(text).alias("_x")), "id").select("id", T.tokens(F.lower("_x")).alias("t"))


def words(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each lower-case token: word."""
    if "t" in df.columns and "punctuation" in df.columns:
        return df.select(F.explode("t").alias("word"))
    return T.spread(_texts(df, text).select(text), text).select(F.explode(T.tokens(F.lower(text))).alias("word"))


def lengths(df: DataFrame, text: str = "text") -> DataFrame:
    """total_samples, average_length, length_std (sample deviation; 0 for fewer than two)."""
    n = F.length(text)
    return _texts(df, text).agg(F.count("*").alias("total_samples"), F.avg(n).alias("average_length"), F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias("length_std"))


def vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """n_tokens, vocabulary_size, lexical_diversity. Words are combined before they are shuffled; no word's rows are gathered."""
    w = words(df, text).groupBy("word").agg(F.count("*").alias("n"))
    return w.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.count("*").alias("vocabulary_size"), F.coalesce(F.count("*") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("lexical_diversity"))


def tfidf_terms(text: Column) -> Column:
    """Terms of two or more letters, numbers or underscores."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: (F.length(w) >= 2) & ~F.array_contains(T.literals(T.STOPWORDS), w))


def semantic_diversity(df: DataFrame, id_col: str, text: str = "text", features: int = 1000) -> DataFrame:
    """One minus the mean cosine of all pairs of TF-IDF vectors, without making a pair.

    The mean over pairs is (|sum of the unit vectors|^2 - number of non-zero vectors) / (n (n - 1)). Vocabulary: the terms of the highest
    counts, ties by term; smooth idf. Fewer than two texts give 1.
    """
    docs = df.select("id", "terms") if "terms" in df.columns and "punctuation" in df.columns else T.spread(_texts(df, text).select(F.col(id_col).alias("id"), F.col(text).alias("_x")), "id").select("id", tfidf_terms(F.col("_x")).alias("terms"))
    tf = docs.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    top = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(features)
    n = docs.agg(F.count("*").alias("n"))
    idf = top.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    v = tf.join(F.broadcast(idf), "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("x"))  # at most `features` terms are broadcast
    norm = v.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    unit = v.join(norm, "id").groupBy("term").agg(F.sum(F.col("x") / F.col("norm")).alias("s"))
    square = unit.agg(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0)).alias("q"))
    live = norm.agg(F.count("*").alias("live"))
    mean = (F.col("q") - F.col("live")) / (F.col("n") * (F.col("n") - 1))
    return square.crossJoin(live).crossJoin(n).select(F.when(F.col("n") < 2, 1.0).otherwise(1 - mean).alias("semantic_diversity"))


def structural_diversity(df: DataFrame, text: str = "text") -> DataFrame:
    """Mean of the shares of distinct sentence counts and of distinct punctuation patterns."""
    d = df.select(F.col("n_sentences").alias("k"), F.col("punctuation").alias("p")) if "n_sentences" in df.columns and "punctuation" in df.columns else _texts(df, text).select(F.size(T.sentences(text)).alias("k"), F.md5(T.punctuation(text)).alias("p"))
    sizes = d.groupBy("k").agg(F.count("*").alias("n")).agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    patterns = d.groupBy("p").agg(F.count("*").alias("c")).agg(F.count("*").alias("p"))
    return sizes.crossJoin(patterns).select(F.coalesce((F.col("k") / F.nullif("n", F.lit(0)) + F.col("p") / F.nullif("n", F.lit(0))) / 2, F.lit(0.0)).alias("structural_diversity"))


def class_counts(df: DataFrame, label: str = "label", default: str = "") -> DataFrame:
    return df.groupBy(F.coalesce(label, F.lit(default)).alias("label")).agg(F.count("*").alias("n"))


def class_balance(df: DataFrame, label: str = "label", default: str = "") -> DataFrame:
    """Smallest over largest class; 0 without classes."""
    return class_counts(df, label, default).agg(F.coalesce(F.min("n") / F.max("n"), F.lit(0.0)).alias("class_balance"))


def duplicate_ratio(df: DataFrame, text: str = "text") -> DataFrame:
    """Share of rows beyond the first of each text; texts travel as 128-bit hashes."""
    g = df.where(F.col(text).isNotNull()).groupBy(F.md5(text).alias("h")).agg(F.count("*").alias("n"))
    return g.agg(F.coalesce((F.sum("n") - F.count("*")) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("duplicate_ratio"))


def near_pairs(df: DataFrame, id_col: str, text: str = "text", threshold: float = 0.9) -> DataFrame:
    """(id_a, id_b, similarity) for classes of equal word sets: all pairs of representatives whose word sets have at least the similarity, by an exact prefix-filtered set join.

    Rows of equal word sets are one class, represented by its smallest id; see `word_set_classes` for the members. Words are ordered by their
    frequency; two sets of the similarity share one of the rarest words of both. Only sets whose sizes allow it meet.
    """
    _, sets = _word_sets(df, id_col, text)
    return _near(sets, threshold)


def _near(sets: DataFrame, threshold: float) -> DataFrame:
    """near_pairs() of one row for each word set: id, words."""
    each = sets.select("id", F.size("words").alias("n"), F.explode("words").alias("w"))
    freq = each.groupBy("w").agg(F.count("*").alias("f"))
    ranked = each.join(freq, "w").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("o")).select("id", "n", F.transform("o", lambda x: x["w"]).alias("o"))
    keep = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    prefix = ranked.select("id", "n", F.posexplode(F.slice("o", F.lit(1), keep)).alias("k", "w"))
    a, b = prefix.toDF("a", "na", "ka", "w"), prefix.toDF("b", "nb", "kb", "w")
    # the first word that two sets share stands so far ahead that enough words can follow it in both
    enough = F.least(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb")) >= F.ceil((F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9)
    met = a.join(b, "w").where("a < b").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9).where(enough).select("a", "b").distinct()
    w = sets.toDF("a", "wa")
    both = met.join(w, "a").join(w.toDF("b", "wb"), "b").withColumn("i", F.size(F.array_intersect("wa", "wb")))
    return both.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), (F.col("i") / (F.size("wa") + F.size("wb") - F.col("i"))).alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)


def _word_sets(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rep, members), one row for each class of equal sets of words, and (id, words) of the representatives. Classes are found by 128-bit hashes; the sets themselves are fetched for the representatives only."""
    d = cut(_tokens(df, id_col, text).select("id", F.array_sort(F.array_distinct("t")).alias("words")).where(F.size("words") > 0).withColumn("h", F.md5(F.array_join("words", "\x01"))))
    classes = cut(d.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("members")))
    sets = d.join(classes.select("h", F.col("rep").alias("id")), ["h", "id"]).select("id", "words").dropDuplicates(["id"])
    return classes.select("rep", "members"), cut(sets)


def word_set_classes(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """One row for each class of equal sets of lower-case words: rep (smallest id), members, words."""
    classes, sets = _word_sets(df, id_col, text)
    return classes.join(sets.withColumnRenamed("id", "rep"), "rep").select("rep", "members", "words")


def near_duplicate_ratio(df: DataFrame, id_col: str, text: str = "text", threshold: float = 0.9) -> DataFrame:
    """Pairs of rows with similar word sets over all pairs of rows that have words. Pairs within and between classes are counted, not made."""
    c, sets = _word_sets(df, id_col, text)
    p = _near(sets, threshold)
    m = c.toDF("id_a", "ma")
    across = p.join(m, "id_a").join(m.toDF("id_b", "mb"), "id_b").agg(F.coalesce(F.sum(F.col("ma") * F.col("mb")), F.lit(0)).alias("x"))
    inside = c.agg(F.coalesce(F.sum(F.expr("members * (members - 1) div 2")), F.lit(0)).alias("i"), F.coalesce(F.sum("members"), F.lit(0)).alias("m"))
    pairs = F.col("x") + F.col("i")
    return across.crossJoin(inside).select(pairs.cast("bigint").alias("near_pairs"), F.coalesce(pairs / F.nullif(F.expr("m * (m - 1) / 2"), F.lit(0)), F.lit(0.0)).alias("near_duplicate_ratio"))


def distinct_n(df: DataFrame, id_col: str, n: int, text: str = "text", stitched: bool = True) -> DataFrame:
    """n_grams, distinct_grams and their ratio; `stitched` also counts the n-grams that run from one text into the next, in the order of the ids.

    Inner n-grams never leave their row. For the joints each text's place in the row of all tokens is a running sum over ranges of ids, and only its first and last
    n - 1 tokens are shuffled, by their places.
    """
    d = _tokens(df, id_col, text).where(F.size("t") > 0)
    if n == 1:
        grams = d.select(F.explode("t").alias("g"))
    else:
        make = lambda arr: F.when(F.size(arr) >= n, F.transform(F.sequence(F.lit(0), F.size(arr) - n), lambda i: F.array_join(F.slice(arr, i + 1, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
        grams = d.select(F.explode(make(F.col("t"))).alias("g"))
        if stitched:
            grams = grams.unionAll(_joints(d, n))
    c = grams.groupBy("g").agg(F.count("*").alias("c"))
    return c.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_grams"), F.count("*").alias("distinct_grams"), F.coalesce(F.count("*") / F.nullif(F.sum("c"), F.lit(0)), F.lit(0.0)).alias(f"distinct_{n}"))


def _joints(d: DataFrame, n: int) -> DataFrame:
    """The n-grams across the ends of neighbouring texts: n tokens at places next to each other that are not all of one text."""
    m, k = n - 1, F.col("k")
    edge = lambda at, some: F.transform(F.slice("t", at, F.lit(m)), lambda w, i: F.struct((some + i).cast("bigint").alias("o"), w.alias("w")))
    ends = d.select("id", F.size("t").cast("bigint").alias("k"), edge(F.lit(1), F.lit(0)).alias("head"), edge(F.greatest(F.lit(1), F.size("t") - m + 1), F.greatest(F.lit(0), F.size("t") - m)).alias("tail"))
    placed = running(ends.select("id", "k", F.array_union("head", "tail").alias("e")), "id", k)
    tokens = placed.select(F.col("before").alias("text"), F.col("before"), F.explode("e").alias("e")).select("text", (F.col("before") + F.col("e.o")).alias("at"), F.col("e.w").alias("w"))
    # each token to the n-grams that it may be in
    to = tokens.select(F.explode(F.sequence(F.col("at") - m, F.col("at"))).alias("g"), "text", "at", "w")
    full = to.groupBy("g").agg(F.count("*").alias("c"), F.min("text").alias("a"), F.max("text").alias("b"), F.array_sort(F.collect_list(F.struct("at", "w"))).alias("x"))  # n tokens at most
    return full.where((F.col("c") == n) & (F.col("a") < F.col("b"))).select(F.array_join(F.transform("x", lambda x: x["w"]), " ").alias("g"))


def metrics(df: DataFrame, id_col: str, text: str = "text", label: str = "label", low: int = 10, high: int = 1000) -> DataFrame:
    """All measures in one row. Texts are split into tokens once for the scores and once to a table that all other measures read."""
    s = quality.score(df.select(id_col, text, label), text, low, high)
    has = F.col(text).isNotNull() & (F.col(text) != "")
    some = lambda c: F.when(has, c)
    n = some(F.length(text))
    base = s.agg(
        F.count("*").alias("total_rows"),
        F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("overall_quality"),
        F.avg(some(F.col("readability"))).alias("readability"),
        F.avg(some(F.col("coherence"))).alias("coherence"),
        F.avg(some(F.col("bias_score"))).alias("bias_score"),
        F.avg(some(F.col("is_toxic").cast("int"))).alias("toxicity_score"),
        F.coalesce(F.bool_or(some(F.col("has_pii"))), F.lit(False)).alias("pii_detected"),
        F.count(n).alias("total_samples"),
        F.avg(n).alias("average_length"),
        F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias("length_std"),
    )
    t = tokenised(df, id_col, text)
    v = vocabulary(t).withColumn("distinct_1", F.col("lexical_diversity"))
    parts = [v, semantic_diversity(t, "id"), structural_diversity(t), class_balance(df, label), duplicate_ratio(df, text), near_duplicate_ratio(t, "id"), *(distinct_n(t, "id", k).select(f"distinct_{k}") for k in (2, 3))]
    for p in parts:
        base = base.crossJoin(p)  # one row each
    return base


def balanced_within(df: DataFrame, targets: DataFrame, label: str = "label", tolerance: float = 0.1) -> DataFrame:
    """Whether every target class occurs and the counts differ by at most the tolerance. targets: (label)."""
    c = targets.select("label").distinct().join(class_counts(df, label), "label", "left")
    return c.agg((F.coalesce(F.min(F.coalesce("n", F.lit(0))) > 0, F.lit(False)) & F.coalesce((F.max("n") - F.min("n")) / F.max("n") <= tolerance, F.lit(False))).alias("is_balanced"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """n / (k * count) for each class."""
    c = class_counts(df, label)
    t = c.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return c.crossJoin(F.broadcast(t)).select("label", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def analysis(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Text and token lengths (mean, population deviation, min, max, median) and the balance of the classes."""
    n, k = F.length(text).cast("bigint"), F.size(T.tokens(text)).cast("bigint")
    d = T.spread(_texts(df, text), text).select(n.alias("n"), k.alias("k"))
    out = d.agg(*[f(c).alias(f"{name}_{c2}") for c, c2 in (("n", "chars"), ("k", "tokens")) for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max), ("median", F.median))])
    return out.crossJoin(class_balance(df, label))


def success_rate(rows: DataFrame, tasks: DataFrame, key: str = "task_id", languages: int = 1) -> DataFrame:
    """Per task: rows that came out, rows that were asked for, their ratio (success_rate at most 1; completion uncapped)."""
    made = rows.groupBy(key).agg(F.count("*").alias("made"))
    want = F.size("class_labels") * F.col("samples_per_class") * languages
    r = F.coalesce(F.coalesce("made", F.lit(0)) / F.nullif(want, F.lit(0)), F.lit(0.0))
    return tasks.join(made, key, "left").select(key, F.coalesce("made", F.lit(0)).alias("made"), want.cast("bigint").alias("wanted"), F.least(r, F.lit(1.0)).alias("success_rate"), r.alias("completion"))


def by_language(df: DataFrame, language: str = "language", label: str = "label") -> DataFrame:
    """Counts for every language and label, with subtotals (an extension: grouping sets)."""
    d = df.select(F.coalesce(language, F.lit("unknown")).alias("language"), F.coalesce(label, F.lit("")).alias("label"))
    return d.cube("language", "label").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))
