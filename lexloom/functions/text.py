"""Text primitives as Column expressions: tokens, sentences, cleaning, reproducible random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns, the same in Java's and RE2's dialects.
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
SENT = r"[.!?]+\s+|[\r\n]+"
SPACE = r"[\s\p{Z}]+"
SOLID = r"[^\s\p{Z}]"
SPECIAL = r"[^\p{L}\p{N}_\s]"
NOT_PUNCT = r"[^!-/:-@\[-`{-~]"
#: Stop words without an external list, words of the toxicity rule, patterns of the personal-data and bias rules.
STOPWORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")
TOXIC = ("hate", "stupid", "idiot", "moron", "dumb", "kill", "die", "murder")
PERSONAL = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "url": r"https?://[^\s]+|www\.[^\s]+",
    "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "name": r"(^|[^\p{L}\p{N}_])[A-Z][a-z]+ [A-Z][a-z]+($|[^\p{L}\p{N}_])",
}
BIAS = (
    r"\b(he|she)\s+(is|was)\s+(better|worse|smarter|dumber)",
    r"\b(men|women)\s+(are|tend to be)\s+",
    r"\b(old|young)\s+people\s+(are|can't|cannot)",
    r"\b(elderly|seniors)\s+(should|shouldn't)",
    r"\b(people of color|minorities)\s+(are|tend to)",
    r"\b(christians|muslims|jews|buddhists|hindus)\s+(are|believe)",
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Words (letters, numbers, underscore) and single other signs, in order."""
    return F.regexp_extract_all(col(text), F.lit(TOKEN), F.lit(0))


def sentences(text: Column | str) -> Column:
    """Trimmed, non-empty parts between sentence ends or line breaks."""
    return F.filter(F.transform(F.split(col(text), SENT), F.trim), lambda s: s.rlike(SOLID))


def squeeze(text: Column | str) -> Column:
    """Each run of white space of any script becomes one space; trimmed."""
    return F.trim(F.regexp_replace(col(text), SPACE, " "))


def strip_special(text: Column | str) -> Column:
    """Without the characters that are neither letter, number, underscore nor white space."""
    return F.regexp_replace(col(text), SPECIAL, "")


def punctuation(text: Column | str) -> Column:
    """The ASCII punctuation of the text, in order."""
    return F.regexp_replace(col(text), NOT_PUNCT, "")


def uniform(seed: int, key: Column | str, tag: str) -> Column:
    """A number in [0, 1) that depends on seed, key and tag only, so a lost task is repeated alike."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string"), F.lit(f":{tag}"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def literals(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def any_personal(text: Column | str) -> Column:
    """Whether one of the seven simple patterns of personal data occurs."""
    c = col(text)
    # a plain search for what every match holds is far cheaper than the pattern, and most texts end there
    needs = {"email": c.contains("@"), "url": c.contains("://") | c.contains("www."), "phone": c.rlike(r"\d{3}[-.\s]?\d{4}"), "credit_card": c.rlike(r"\d{4}[-\s]?\d{4}"), "ssn": c.rlike(r"\d-\d\d-\d")}
    out = F.lit(False)
    for name, p in PERSONAL.items():
        out = out | ((needs[name] & c.rlike(p)) if name in needs else c.rlike(p))
    return out


def bias_score(lower: Column | str) -> Column:
    """Share of the bias patterns that occur in a lower-case text."""
    return sum((col(lower).rlike(p).cast("int") for p in BIAS), F.lit(0)) / len(BIAS)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df over more tasks, by the hash of `by`, if its files give fewer than there are cores; costly work on each row then uses all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(3 * cores, *by)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once for each row: the optimizer neither copies them into later expressions nor moves a filter on them below."""
    out = df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once"))
    return out.select(*df.columns, *[F.col(f"_once.{n}").alias(n) for n in columns])
