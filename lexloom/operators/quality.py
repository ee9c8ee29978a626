"""Quality of single samples: length, readability, coherence, safety, richness, and their weighted sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T

#: Weights of the scores, and the tense markers (found as substrings).
WEIGHTS = {"length": 0.2, "readability": 0.2, "coherence": 0.2, "safety": 0.3, "richness": 0.1}
PAST = ("was", "were", "had", "did", "ed")
PRESENT = ("is", "are", "have", "do", "does")
FUTURE = ("will", "shall", "going to")


def length_score(text: Column, low: int, high: int) -> Column:
    n = F.length(text)
    return F.when((n < low) | (n > high), 0.0).when((n >= 2 * low) & (n <= 0.8 * high), 1.0).when(n < 2 * low, n / (2.0 * low)).otherwise(0.8 * high / n)


def readability(text: Column, toks: Column, sents: Column) -> Column:
    words, sentences = F.size(toks), F.size(sents)
    # tokens cover all characters but white space, so their joint length needs no second pass over them
    letters = F.length(F.regexp_replace(text, r"\s+", ""))
    sentence = 1 / (1 + F.abs(words / sentences - 15) / 10)
    word = 1 / (1 + F.abs(letters / words - 5) / 3)
    return F.when((words > 0) & (sentences > 0), (sentence + word) / 2).otherwise(0.0)


def _count(lower: Column, markers: tuple[str, ...]) -> Column:
    return sum((lower.contains(m).cast("int") for m in markers), F.lit(0))


def consistent_tense(lower: Column) -> Column:
    a, b, c = (_count(lower, m) for m in (PAST, PRESENT, FUTURE))
    return (a + b + c == 0) | (F.greatest(a, b, c) / F.nullif(a + b + c, F.lit(0)) > 0.7)


def proper_punctuation(text: Column) -> Column:
    count = lambda s: F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))
    return text.rlike(r"[.!?][\s\p{Z}]*$") & (count('"') % 2 == 0) & (count("(") == count(")"))


def logical_flow(sents: Column) -> Column:
    """Mean overlap of neighbouring sentences' words between 0.1 and 0.7; true where none can be compared."""
    sets = F.transform(sents, lambda s: F.array_distinct(T.tokens(F.lower(s))))
    pairs = F.filter(F.transform(F.arrays_zip(F.slice(sets, F.lit(1), F.greatest(F.size(sets) - 1, F.lit(0))).alias("a"), F.slice(sets, 2, 100_000_000).alias("b")), lambda p: F.struct(F.size(F.array_intersect(p["a"], p["b"])).alias("i"), F.size(p["a"]).alias("x"), F.size(p["b"]).alias("y"))), lambda p: (p["x"] > 0) & (p["y"] > 0))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["i"] / (p["x"] + p["y"] - p["i"]))
    mean = total / F.nullif(F.size(pairs), F.lit(0))
    return F.coalesce(F.round(mean, 9).between(0.1, 0.7), F.lit(True))


def vocabulary_consistency(ltoks: Column) -> Column:
    n = F.size(ltoks)
    return (n < 5) | (F.size(F.array_distinct(ltoks)) / F.nullif(n, F.lit(0))).between(0.3, 0.9)


def toxic(ltoks: Column, words: tuple[str, ...] = T.TOXIC) -> Column:
    return F.arrays_overlap(ltoks, T.literals(words))


def richness(ltoks: Column, stopwords: tuple[str, ...] = T.STOPWORDS) -> Column:
    content = F.filter(ltoks, lambda w: (F.length(w) > 2) & ~F.array_contains(T.literals(stopwords), w))
    n, k = F.size(ltoks), F.size(content)
    return F.when(k > 0, (F.size(F.array_distinct(content)) / k + k / n) / 2).otherwise(0.0)


def score(df: DataFrame, text: str = "text", low: int = 10, high: int = 1000, stopwords: tuple[str, ...] = T.STOPWORDS, toxic_words: tuple[str, ...] = T.TOXIC) -> DataFrame:
    """df with the scores and flags of each row, and quality_score. The word lists are English; other languages need their own (`die` is a German article).

    The text is split once; nothing is shuffled. Null and empty texts have 0 in every score; very long texts are scored as a whole.
    """
    df = T.spread(df, text)
    d = T.once(df, _t=F.coalesce(F.col(text), F.lit("")), _low=F.lower(F.coalesce(F.col(text), F.lit(""))))
    d = T.once(d, _toks=T.tokens("_t"), _ltoks=T.tokens("_low"), _sents=T.sentences("_t"))
    t, low_t, toks, ltoks, sents = (F.col(c) for c in ("_t", "_low", "_toks", "_ltoks", "_sents"))
    d = T.once(
        d,
        length_score=length_score(t, low, high),
        readability=readability(t, toks, sents),
        tense_ok=consistent_tense(low_t),
        punctuation_ok=proper_punctuation(t),
        flow_ok=logical_flow(sents),
        vocabulary_ok=vocabulary_consistency(ltoks),
        has_pii=T.any_personal(t),
        is_toxic=toxic(ltoks, toxic_words),
        bias_score=T.bias_score(low_t),
        richness=richness(ltoks, stopwords),
        _n=F.size(sents),
    )
    marks = sum((F.col(c).cast("int") for c in ("tense_ok", "punctuation_ok", "flow_ok", "vocabulary_ok")), F.lit(0))
    d = d.withColumn("coherence", F.when(t == "", 0.0).when(F.col("_n") < 2, 0.8).otherwise(marks / 4)).withColumn("safety", F.when(F.col("has_pii") | F.col("is_toxic") | (F.col("bias_score") > 0.5), 0.0).otherwise(1.0))
    total = sum((F.col("length_score" if k == "length" else k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return d.withColumn("quality_score", F.when(t == "", 0.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))).drop("_t", "_low", "_toks", "_ltoks", "_sents", "_n")


def gate(df: DataFrame, threshold: float = 0.7, text: str = "text", low: int = 10, high: int = 1000) -> DataFrame:
    """Rows whose quality reaches the threshold."""
    return score(df, text, low, high).where(F.round("quality_score", 9) >= threshold)
