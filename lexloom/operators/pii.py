"""Rule-based detection of personal data: patterns, checks, confidence, overlaps, redaction, risk and decisions.

Positions need the regular expressions themselves, so matches are found by an Arrow-batched function, to which only rows go that a
cheap built-in test lets through. Null texts have no matches; confidence is worked out as in the rule (base, plus 0.05 for each keyword
in the text's first characters).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from lexloom.functions import text as T

#: Patterns of each type.
PATTERNS = {
    "email": [r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", r"(?i)\b[A-Za-z0-9._%+-]+\s*@\s*[A-Za-z0-9.-]+\s*\.\s*[A-Z|a-z]{2,}\b"],
    "phone": [r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b", r"\b(?:\+?1[-.\s]?)?[0-9]{3}[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b", r"\b(?:\+?[1-9][0-9]{0,3}[-.\s]?)?[0-9]{3,4}[-.\s]?[0-9]{3,4}[-.\s]?[0-9]{3,4}\b"],
    "ssn": [r"\b\d{3}-\d{2}-\d{4}\b", r"\b\d{3}\s\d{2}\s\d{4}\b", r"\b\d{9}\b"],
    "credit_card": [r"\b(?:\d{4}[-\s]?){3}\d{4}\b", r"\b(?:\d{4}[-\s]?){2}\d{4}[-\s]?\d{3}\b", r"\b\d{13,19}\b"],
    "ip_address": [r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"],
    "url": [r"(?i)https?://[^\s]+", r"(?i)www\.[^\s]+", r"\b[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(?:/[^\s]*)?\b"],
    "name": [r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", r"\b[A-Z][a-z]+ [A-Z]\. [A-Z][a-z]+\b", r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+ [A-Z][a-z]+\b"],
    "address": [r"(?i)\b\d+\s+[A-Za-z\s]+(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Circle|Cir|Boulevard|Blvd)\b", r"\b\d+\s+[A-Z][a-z]+\s+(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr)\b"],
    "date_of_birth": [r"\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])[/-](?:19|20)\d{2}\b", r"\b(?:19|20)\d{2}[/-](?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])\b", r"\b(?:0?[1-9]|[12][0-9]|3[01])[/-](?:0?[1-9]|1[0-2])[/-](?:19|20)\d{2}\b"],
    "passport": [r"\b[A-Z]{1,2}\d{6,9}\b"],
    "driver_license": [r"\b[A-Z]\d{7}\b", r"\b\d{8,12}\b"],
    "bank_account": [r"\b\d{8,17}\b"],
}
#: Base confidence, risk, keywords and name lists.
BASE = {"email": 0.9, "ssn": 0.95, "credit_card": 0.9, "phone": 0.8, "ip_address": 0.95, "url": 0.9, "name": 0.6, "address": 0.7, "date_of_birth": 0.8, "passport": 0.8, "driver_license": 0.7, "bank_account": 0.7, "custom": 0.7}
RISK = {"ssn": 1.0, "credit_card": 1.0, "passport": 0.9, "bank_account": 0.9, "driver_license": 0.8, "address": 0.8, "phone": 0.7, "date_of_birth": 0.7, "email": 0.6, "name": 0.5, "custom": 0.5, "ip_address": 0.3, "url": 0.2}
KEYWORDS = {"email": ("email", "mail", "contact", "@"), "phone": ("phone", "call", "number", "tel"), "ssn": ("ssn", "social", "security"), "name": ("name", "person", "user", "author"), "address": ("address", "street", "location")}
NO_NAMES = frozenset("The This That They There Then Thank Thanks Hello Hi Hey Yes No Maybe Please Sorry Welcome Good Great Best Better Nice Fine Here Where When What Who Why How First Last Next Previous Current New Old Big Small Large Little High Low Fast Slow Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December Apple Amazon Google Microsoft Facebook Twitter".split())
FIRST_NAMES = frozenset("James John Robert Michael William David Richard Thomas Christopher Daniel Matthew Anthony Mark Donald Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Betty Dorothy Sandra Ashley Kimberly Emily Donna Margaret Carol Michelle".split())
LAST_NAMES = frozenset("Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor Moore Jackson Martin Lee Perez Thompson White Harris Sanchez Clark Ramirez Lewis Robinson Walker Young Allen King".split())
BLOCKING = ("ssn", "credit_card", "passport")

MATCHES = ArrayType(StructType([StructField("pii_type", StringType()), StructField("text", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("confidence", DoubleType())]))
#: What every text with a match holds: a digit, an @, a dot before letters, signs of addresses, or two capitalised words.
MAY = r"\d|@|\.[A-Za-z]{2}|://|(?i:www\.)|:[0-9a-fA-F]{1,4}:|[A-Z][a-z]+\.? [A-Z]"


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plausible(kind: str, match: str, strict: bool = True) -> bool:
    """The further check of a match by its type."""
    digits = regex.sub(r"\D", "", match)
    if kind == "name":
        words = match.split()
        if len(words) != 2 or NO_NAMES & set(words):
            return False
        a, b = words[0] in FIRST_NAMES, words[1] in LAST_NAMES
        return a or b if strict else a and b
    if kind == "credit_card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "email":
        local, at, domain = match.partition("@")
        return bool(at) and "@" not in domain and "." in domain and len(local) <= 64 and len(domain) <= 253
    if kind == "ssn":
        return len(digits) == 9 and len(set(digits)) > 1 and digits != "123456789"
    if kind == "phone":
        return 7 <= len(digits) <= 15 and len(set(digits)) > 2
    return True


class Detector:
    """Matches of one text. custom: further patterns, of type `custom`; invalid ones are skipped."""

    def __init__(self, strict: bool = True, custom: tuple[str, ...] = (), context: str = "start"):
        self.least, self.strict, self.context = (0.7 if strict else 0.8), strict, context
        self.patterns = [(k, regex.compile(p)) for k, ps in PATTERNS.items() for p in ps]
        for p in custom:
            try:
                self.patterns.append(("custom", regex.compile(p)))
            except regex.error:
                pass

    def confidence(self, kind: str, start: int, end: int, text: str) -> float:
        around = text[max(0, start - 50) : end + 50] if self.context == "match" else text[: end - start + 50]
        around = around.lower()
        return min(BASE[kind] + sum(0.05 for w in KEYWORDS.get(kind, ()) if w in around), 1.0)

    def __call__(self, text: str) -> list[tuple[str, str, int, int, float]]:
        found = []
        for kind, p in self.patterns:
            for m in p.finditer(text):
                if plausible(kind, m[0], self.strict):
                    c = self.confidence(kind, m.start(), m.end(), text)
                    if c >= self.least:
                        found.append((kind, m[0], m.start(), m.end(), c))
        return settle(found)


def settle(matches: list[tuple[str, str, int, int, float]]) -> list[tuple[str, str, int, int, float]]:
    """In order of their starts, each match meets the first kept one that it overlaps, and takes its place only with a higher confidence."""
    kept: list = []
    for m in sorted(matches, key=lambda m: m[2]):
        rival = next((k for k in kept if m[2] < k[3] and m[3] > k[2]), None)
        if rival is None:
            kept.append(m)
        elif m[4] > rival[4]:
            kept.remove(rival)
            kept.append(m)
    return sorted(kept, key=lambda m: m[2])


def clean(text: str, matches: list, mode: str = "redact") -> str:
    """The text with its matches redacted ([TYPE]; [REDACTED] for custom ones), removed, or masked with asterisks."""
    for kind, value, start, end, _ in sorted(matches, key=lambda m: -m[2]):
        new = {"redact": "[REDACTED]" if kind == "custom" else f"[{kind.upper()}]", "remove": "", "mask": "*" * len(value)}[mode]
        text = text[:start] + new + text[end:]
    return text


def detect(df: DataFrame, text: str = "text", strict: bool = True, custom: tuple[str, ...] = (), mode: str = "redact", context: str = "start") -> DataFrame:
    """df with matches, cleaned_text, has_pii and risk_score."""
    kind = StructType([StructField("matches", MATCHES), StructField("cleaned", StringType())])

    @F.pandas_udf(kind)
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        d = Detector(strict, custom, context)
        for s in parts:
            got = [d(t) if t else [] for t in s]
            yield pd.DataFrame({"matches": [[dict(zip(("pii_type", "text", "start", "end", "confidence"), m)) for m in g] for g in got], "cleaned": [clean(t, g, mode) if g else None for t, g in zip(s, got)]})

    may = F.col(text).rlike(MAY) if not custom else F.lit(True)
    out = T.spread(df, text).withColumn("_x", scan(F.when(may, F.col(text))))
    m = F.coalesce(F.col("_x.matches"), F.array().cast(MATCHES))
    return out.select(*df.columns, m.alias("matches"), F.coalesce("_x.cleaned", text).alias("cleaned_text"), (F.size(m) > 0).alias("has_pii"), risk(F.transform(m, lambda x: x["pii_type"])).alias("risk_score"))


def risk(types: Column) -> Column:
    """Highest risk of the types, plus 0.1 for each match up to 0.5, at most 1; 0 without matches."""
    table = F.create_map(*[F.lit(x) for kv in RISK.items() for x in kv])
    top = F.array_max(F.transform(types, lambda t: F.coalesce(F.element_at(table, t), F.lit(0.5))))
    return F.when(F.size(types) > 0, F.least(top + F.least(F.size(types) * 0.1, F.lit(0.5)), F.lit(1.0))).otherwise(0.0)


def flags(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, one flag for each simple pattern), by built-in matching."""
    return df.select(id_col, *[F.coalesce(F.col(text).rlike(p), F.lit(False)).alias(k) for k, p in T.PERSONAL.items()])


def redact(text: Column) -> Column:
    """Built-in redaction: the simple patterns, one after another."""
    for k in ("email", "url", "credit_card", "ssn", "phone", "ip"):
        text = F.regexp_replace(text, T.PERSONAL[k], f"[{k.upper()}]")
    return text


def luhn_valid(number: Column) -> Column:
    """The card check by built-in functions: 13 to 19 digits with a check sum of 0."""
    d = F.transform(F.split(F.reverse(F.regexp_replace(number, r"\D", "")), ""), lambda x: x.try_cast("int"))
    d = F.filter(d, lambda x: x.isNotNull())
    v = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x * 2 > 9, x * 2 - 9).otherwise(x * 2))
    return F.coalesce(F.size(d).between(13, 19) & (F.aggregate(v, F.lit(0), lambda a, x: a + x) % 10 == 0), F.lit(False))


def batch_summary(detected: DataFrame) -> DataFrame:
    """total, with_pii, rate, mean and number of high risks (above 0.7), n_matches."""
    return detected.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col("has_pii").cast("bigint")), F.lit(0)).alias("with_pii"), F.avg(F.col("has_pii").cast("double")).alias("rate"), F.avg("risk_score").alias("mean_risk"), F.coalesce(F.sum((F.col("risk_score") > 0.7).cast("bigint")), F.lit(0)).alias("high_risk"), F.coalesce(F.sum(F.size("matches")), F.lit(0)).alias("n_matches"))


def type_counts(detected: DataFrame) -> DataFrame:
    return detected.select(F.explode("matches").alias("m")).groupBy("m.pii_type").agg(F.count("*").alias("n"))


def decision(types: Column, score: Column, purpose: Column) -> Column:
    """Whether a text may be used: no matches yes; risk above 0.7, training data, or a blocking type no; unknown (null) no."""
    blocked = F.arrays_overlap(types, F.array(*[F.lit(t) for t in BLOCKING]))
    return F.coalesce(F.when(F.size(types) == 0, True).when((score > 0.7) | (purpose == "training_data") | blocked, False).otherwise(True), F.lit(False))
