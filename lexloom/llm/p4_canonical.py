"""Problem 4: duplicates hidden by formatting.

A text's canonical form is its letters, marks and numbers in lower case; a record of named fields (a JSON object, or
`name: value` fields divided by `|` or line breaks) is the sorted set of its canonical (name, value) pairs. The form's
128-bit hash, with a 64-bit check and its length, is the key of one aggregation that Spark combines on the map side.

Two forms with the same 128 bits but another check or length are different records: they never merge, and
`report` counts them. Null texts, and texts without letters, marks and numbers, are in no set. Of equal rows each
counts as a copy; a JSON object that is nested deeper than the parser goes (about a thousand levels) is compared as plain text; ties on sample_id (repeated rows) are one record. Columns other than the id, the text and the group column are never read.
"""

from __future__ import annotations

import json

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DROP = r"[^\p{L}\p{M}\p{N}]+"
#: A group with at least one row in HOT rows of the table is hot; there can be at most HOT such groups, so their list may be broadcast.
HOT, SALT = 2000, 64

_drop = regex.compile(DROP)
_breaks = regex.compile(r"[|\r\n  \u0085]+")
_field = regex.compile(r"\s*(\p{L}[\p{L}\p{M}]*)\s*[:：](.*)", regex.S)
_edges = regex.compile(r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$")


def _plain(value: object) -> str:
    if isinstance(value, str):
        return _drop.sub("", value.lower())
    if value is None or isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return "[" + ",".join(map(_plain, value)) + "]"
    if isinstance(value, tuple):
        return "{" + ",".join(sorted(f"{_plain(k)}={_plain(v)}" for k, v in value)) + "}"
    return _drop.sub("", str(value).lower())


class _Pairs(tuple):
    """The pairs of a JSON object, with repeated names."""


def _number(s: str) -> str:
    return s


def record_form(text: str | None) -> str | None:
    """The canonical form of a record of named fields; None if the text is no such record."""
    if text is None:
        return None
    s = _edges.sub("", text)
    pairs: list | None = None
    if s.startswith("{"):
        try:
            got = json.loads(s, strict=False, object_pairs_hook=_Pairs, parse_float=_number, parse_int=_number)
            pairs = list(got) if isinstance(got, _Pairs) else None
        except (ValueError, RecursionError):
            pairs = None
    if pairs is None:
        parts = [p for p in (_edges.sub("", x) for x in _breaks.split(s)) if p]
        found = [_field.fullmatch(p) for p in parts]
        if len(parts) < 2 or not all(found):
            return None
        pairs = [(m[1], m[2]) for m in found]
    return "\x1e".join(sorted({f"{_plain(k)}\x1f{_plain(v)}" for k, v in pairs}))


@F.pandas_udf(StringType())
def _record_form(text: pd.Series) -> pd.Series:
    return text.map(record_form, na_action="ignore").astype(object)


def canonical(text: Column) -> Column:
    """Canonical form; null where the text has no letter, mark or number. Only texts that can be records go to Python."""
    may = text.rlike(r"^[\s\p{Z}\p{Cf}|]*(?:\{|\p{L}[\p{L}\p{M}]*[\s\p{Z}]*[:：])")
    plain = F.regexp_replace(F.lower(text), DROP, "")
    record = _record_form(F.when(may, text))
    return F.when(plain == "", None).otherwise(F.coalesce(F.concat(F.lit("R\x1e"), record), F.concat(F.lit("T"), plain)))


def keyed(df: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """id, h (128 bits), chk (64 other bits), len of each row with a canonical form, and the columns of `keep`."""
    c = df.select(F.col(id_col).alias("id"), *keep, canonical(F.col(text_col)).alias("c")).where("c is not null")
    return c.select("id", *keep, F.unhex(F.md5("c")).alias("h"), F.xxhash64("c").alias("chk"), F.length("c").alias("len"))


def groups(keys: DataFrame) -> DataFrame:
    """One row for each set: h, chk, len, first (smallest id), copies."""
    return keys.groupBy("h", "chk", "len").agg(F.min("id").alias("first"), F.count("*").alias("copies"))


def surplus(keys: DataFrame, *keep: str) -> DataFrame:
    """The rows of sets of two or more but the first of each, with `first` and `copies`. A hot set's rows go to SALT tasks."""
    many = groups(keys).where("copies > 1")
    n = keys.groupBy().count().select((F.col("count") / HOT).alias("least"))
    marked = many.crossJoin(F.broadcast(n)).withColumn("hot", F.col("copies") >= F.greatest("least", F.lit(1000))).drop("least")  # n is one row
    hot = F.broadcast(marked.where("hot").select("h", "chk", "len", F.lit(True).alias("hot")))
    rows = keys.join(hot, ["h", "chk", "len"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).otherwise(0)).drop("hot")
    sets = marked.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    return rows.join(sets, ["h", "chk", "len", "salt"]).where(F.col("id") != F.col("first")).select("id", *keep, "first", "copies")


def found(samples: DataFrame, id_col: str = "sample_id", text_col: str = "text") -> DataFrame:
    """(sample_id_a, sample_id_b): the smallest id of each set of equal records, with each other one."""
    from .base import cut

    keys = cut(keyed(samples, id_col, text_col))
    return surplus(keys).select(F.col("first").alias("sample_id_a"), F.col("id").alias("sample_id_b")).distinct()


def collapsed(samples: DataFrame, id_col: str = "sample_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct record: its smallest id and the number of copies. Texts without a form are not records."""
    return groups(keyed(samples, id_col, text_col)).select(F.col("first").alias("sample_id"), "copies")


def report(samples: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per task: records, surplus copies over the whole table, their share, and the latest measured duplicate_ratio. Hash collisions are in `collisions` (whole table)."""
    from .base import cut

    keys = cut(keyed(samples, "sample_id", "text", "task_id"))
    total = keys.groupBy("task_id").agg(F.count("*").alias("records"))
    extra = surplus(keys, "task_id").groupBy("task_id").agg(F.count("*").alias("surplus"))
    latest = metrics.dropDuplicates(["task_id", "measured_at"]).groupBy("task_id").agg(F.max_by("duplicate_ratio", "measured_at").alias("duplicate_ratio"))
    clash = groups(keys).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("collisions"))
    out = total.join(extra, "task_id", "left").join(latest, "task_id", "left").crossJoin(F.broadcast(clash))  # clash is one row
    return out.select("task_id", "records", F.coalesce("surplus", F.lit(0)).cast("bigint").alias("surplus"), F.round(F.coalesce("surplus", F.lit(0)) / F.col("records"), 6).alias("surplus_share"), "duplicate_ratio", "collisions")
