"""Problem 3: texts that were cut off.

Per source, the texts are a mixture of whole and cut ones, which is fitted by expectation-maximisation; a text's posterior decides.
Length: whole texts of a kind (JSON, list, prose) are log-normal. A cut text is right-censored: at a limit of the source, or
where the transfer broke off, at any place of its whole length, which gives lengths the density S(l) / E[L]. The log-normal is fitted by
maximum likelihood in which censored values count as "at least this long"; candidate limits are lengths with more values than their neighbours.
Ending: an unclosed JSON value, string or bracket, a damaged last character, a last line without a sentence end. A list item, a
signature or a label needs no sentence end: whether its last words can end a line is counted over all lines of the table
that are known to be whole (a list item is whole if another line follows). Trailing dots are a style where the same last
sentence ends many texts that end in dots. How often an ending is a cut one is learned for each source with the rest; CHANCE is only where it starts, and
weighs as much as WEIGHT of the source's texts with the ending.

finish_reason is not read. Null, empty and blank texts are no cases; a call delivered more than once is cut if any
delivery is; a text without any letter or number is no case. Sources are compared as they are; a null source is a source.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import once

from .base import cut

#: Fixed patterns. END: sentence ends of the scripts; AFTER: what may follow one; BULLET: the start of a list item.
END = r".!?。！？؟।۔"
AFTER = r"\"'”’»›)\]）】」』*_\s\p{So}\p{Sk}\p{Cf}\x{fe0f}\x{1f3fb}-\x{1f3ff}★☆"
BULLET = r"^\s*(?:[-*•·–]|\d+[.)])\s+"
#: What is thought of an ending before any length is looked at: the chance that it is a cut one; and how much that weighs beside the source's own texts.
CHANCE = {"open": 0.99, "damaged": 0.99, "prose": 0.97, "item_cut": 0.97, "item": 0.003, "line": 0.003, "number": 0.1, "end": 0.0005, "style": 0.001, "dots": 0.97, "bracket": 0.95}
WEIGHT, AT_LEAST = 0.1, 30.0
#: Share of whole texts that may have any length, so that no length alone tells much but a limit.
ANY = 0.1
#: A last line counts as a known form, or a last sentence as a style, from this share of the lines or texts of its kind, and at least so many.
KNOWN, STYLE, LEAST = 0.004, 0.01, 3


def _phi(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def _upper(x: float) -> float:
    return max(math.erfc(x / math.sqrt(2)) / 2, 1e-300)


def censoring(length: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[float, float, np.ndarray]:
    """mu and sigma of log(length), and for each length the posterior that a value of that length is censored; lengths above 0, counted."""
    x, n = np.log(length), count.astype(float)
    total = n.sum()
    mu, sigma = float((n * x).sum() / total), 0.0
    sigma = max(float(np.sqrt((n * (x - mu) ** 2).sum() / total)), 0.05)
    post = np.zeros(len(x))
    # a limit: at least five values and four times the mean of the lengths around it
    index = {int(v): c for v, c in zip(length, n)}
    around = np.array([sum(index.get(int(v) + d, 0.0) for d in range(-12, 13) if d) / 24 for v in length])
    limit = (n >= 5) & (n > 4 * around + 3 * np.sqrt(around) + 2)
    for _ in range(rounds):
        density = np.array([_phi((v - mu) / sigma) / (sigma * w) for v, w in zip(x, length)])
        expected = np.maximum(total * density, around)
        new = np.where(limit, np.clip(1 - expected / np.maximum(n, 1), 0, 1), 0.0)
        z = (x - mu) / sigma
        hazard = np.array([_phi(v) / _upper(v) for v in z])
        first = (1 - new) * x + new * (mu + sigma * hazard)
        second = (1 - new) * x**2 + new * (mu**2 + 2 * mu * sigma * hazard + sigma**2 * (1 + z * hazard))
        m = float((n * first).sum() / total)
        s = math.sqrt(max(float((n * second).sum() / total) - m * m, 1e-4))
        moved = abs(m - mu) + abs(s - sigma) + float(np.abs(new - post).max(initial=0))
        mu, sigma, post = m, s, new
        if moved < 1e-6:
            break
    return mu, sigma, post


_tail = np.vectorize(_upper, otypes=[float])
_density = np.vectorize(_phi, otypes=[float])


def mixture(kind: np.ndarray, form: np.ndarray, length: np.ndarray, count: np.ndarray, rounds: int = 300) -> np.ndarray:
    """The posterior of being cut of one source's texts, counted by kind, form of the ending and length."""
    n = count.astype(float)
    whole = np.unique(length)
    _, _, post = censoring(whole, np.bincount(np.searchsorted(whole, length), n))
    limit = post > 0.05
    at = np.searchsorted(whole, length)
    on_limit = limit[at]
    start = np.array([CHANCE[f] for f in form])
    forms, f = np.unique(form, return_inverse=True)
    kinds, k = np.unique(kind, return_inverse=True)
    n_form = np.bincount(f, n)
    prior, weight = np.array([CHANCE[x] for x in forms]), np.maximum(AT_LEAST, WEIGHT * n_form)
    r, x = start.copy(), np.log(length)
    x_k = np.array([(n * x)[k == j].sum() / n[k == j].sum() for j in range(len(kinds))])
    s_k = np.array([max(0.2, np.sqrt((n * (x - x_k[j]) ** 2)[k == j].sum() / n[k == j].sum())) for j in range(len(kinds))])
    # what the limits hold: lengths with more texts than their neighbours whose endings may be cut ones; a common length of whole texts is no limit
    w = n * r * np.where(on_limit, post[at], 0.0)
    lam, share = float(w.sum() / (n * r).sum()), np.bincount(at, w)[at] / max(w.sum(), 1e-300)
    for _ in range(rounds):
        z = (x - x_k[k]) / s_k[k]
        tail = _tail(z)
        mean = np.exp(x_k + s_k**2 / 2)[k]
        density = (1 - ANY) * _density(z) / (s_k[k] * length) + ANY * tail / mean
        broken, limited = (1 - lam) * tail / mean, np.where(on_limit, lam * share, 0.0)
        p = (np.bincount(f, n * r) + weight * prior) / (n_form + weight)
        odds = p[f] / (1 - p[f]) * (broken + limited) / density
        new = odds / (1 + odds)
        moved = float(np.abs(new - r).max(initial=0))
        r = new
        w = n * r * limited / np.maximum(broken + limited, 1e-300)
        lam, share = min(0.98, float(w.sum() / max((n * r).sum(), 1e-300))), np.bincount(at, w)[at] / max(w.sum(), 1e-300)
        # cut texts count as "at least this long"
        hazard = _density(z) / tail
        for j in range(len(kinds)):
            w, mu, s, q = n * (k == j), x_k[j], s_k[j], r
            first = (1 - q) * x + q * (mu + s * hazard)
            second = (1 - q) * x**2 + q * (mu**2 + 2 * mu * s * hazard + s**2 * (1 + z * hazard))
            x_k[j] = (w * first).sum() / w.sum()
            s_k[j] = math.sqrt(max(float((w * second).sum() / w.sum()) - x_k[j] ** 2, 0.04))
        if moved < 1e-5:
            break
    return r


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    p = mixture(pdf["kind"].to_numpy(), pdf["form"].to_numpy(), pdf["len"].to_numpy(), pdf["n"].to_numpy())
    return pdf[["source", "kind", "form", "len"]].assign(p=p)


def _features(results: DataFrame) -> DataFrame:
    """One row for each non-blank text: its ending's form, and the keys that are looked up for it."""
    t = F.regexp_replace("text", r"[\s\p{Z}\p{Cf}]+$", "")
    rows = results.where("text is not null").select("call_id", "source", F.length("text").cast("bigint").alias("len"), "text")
    rows = once(rows, t=t).where(F.col("t").rlike(r"[\p{L}\p{N}]"))
    # a JSON value: at the start, behind a code fence, or on a line of its own
    body = F.regexp_extract("t", r"(?s)^\s*(?:[^\n\[{]{0,80}\n)?\s*(?:```\w*\s*)?([\[{]\s*[\[{\"].*|[\[{]\s*)$", 1)
    many = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    rows = once(rows, _body=body)
    rows = once(rows, json=F.col("_body") != "", bare=F.regexp_replace("_body", r'(?s)"(?:[^"\\]++|\\.)*+"', "")).drop("_body")
    rows = rows.withColumn("open", F.col("json") & (F.col("bare").contains('"') | (many(F.col("bare"), "[{") > many(F.col("bare"), "]}"))))
    stem = F.regexp_replace("t", r"\s*(?:\.{2,}|…)[\s.…]*$", "")
    rows = rows.withColumn("dots", F.col("t").rlike(r"(?:\.{2,}|…)$"))
    rows = once(rows, stem=F.when(F.col("dots"), stem).otherwise(F.regexp_replace("t", rf"[\s\p{{So}}\p{{Sk}}\x{{fe0f}}\x{{1f3fb}}-\x{{1f3ff}}★☆]+$", "")))
    last = F.element_at(F.split("stem", r"[\n\r]"), -1)  # a pattern that ends in $ would be tried from each character
    rows = once(rows, last=last).withColumn("n_lines", F.size(F.split(F.trim("stem"), r"\r?\n")))
    rows = rows.withColumn("ended", F.col("stem").rlike(rf"[{END}][{AFTER}]*$")).withColumn("frag", F.element_at(F.split("last", rf"[{END}]"), -1))
    words = F.split(F.trim(F.regexp_replace("last", r"\s+", " ")), " ")
    rows = rows.withColumn("w1", F.element_at(words, -1)).withColumn("w2", F.when(F.size(words) > 1, F.concat_ws(" ", F.element_at(words, -2), F.element_at(words, -1)))).withColumn("n_words", F.size(words))
    opened = many(F.col("last"), "(（[") > many(F.col("last"), ")）]")
    form = (
        F.when(F.col("t").rlike(r"\x{fffd}[\s.…\"'\]})]*$"), "damaged")
        .when(F.col("open"), "open")
        .when(F.col("json"), "end")
        .when(F.col("dots") & F.col("ended"), "end")
        .when(F.col("dots"), "dots")
        .when(opened & ~F.col("last").rlike(r"[)）\]][^(（\[]*$"), "bracket")
        .when(F.col("ended") & F.col("stem").rlike(r"\d\.$") & ~F.col("last").rlike(r"^\s*\d+\.$"), "number")
        .when(F.col("ended"), "end")
        .when(F.col("last").rlike(BULLET), "list")
        .when((F.col("n_words") <= 4) & (F.col("n_lines") > 1), "short")
        .otherwise("prose")
    )
    return rows.select("call_id", "source", "len", form.alias("form"), F.trim("frag").alias("frag"), F.lower("w1").alias("w1"), F.lower("w2").alias("w2"), F.lower(F.trim("last")).alias("last"), F.when(F.col("text").rlike(r"(?m)" + BULLET), F.col("stem")).alias("lines"), "json")


def scored(results: DataFrame) -> DataFrame:
    """(call_id, source, form, p): the chance that a delivery's text is cut."""
    rows = cut(_features(results))
    # words of list items that another line follows: how often they end their item
    lines = rows.where("lines is not null").select(F.split("lines", r"\r?\n").alias("l")).where("size(l) > 1").select(F.explode(F.slice("l", F.lit(1), F.size("l") - 1)).alias("line")).where(F.col("line").rlike(BULLET))
    words = lines.select(F.split(F.lower(F.trim(F.regexp_replace("line", r"\s+", " "))), " ").alias("w")).select("w", F.size("w").alias("n"))
    each = words.select(F.posexplode("w").alias("k", "x"), "w", "n")
    each = each.select(F.explode(F.array(F.struct(F.col("x").alias("key"), (F.col("k") == F.col("n") - 1).alias("ends")), F.struct(F.when(F.col("k") > 0, F.concat_ws(" ", F.expr("try_element_at(w, k)"), "x")).alias("key"), (F.col("k") == F.col("n") - 1).alias("ends")))).alias("s")).select("s.*").where("key is not null")
    stat = each.groupBy("key").agg(F.avg(F.col("ends").cast("int")).alias("share")).where("share > 0")
    # last lines without a sentence end, by their last word and by the whole line
    short = rows.where("form = 'short'")
    n_short = short.agg(F.greatest(F.lit(LEAST), F.count("*") * KNOWN).alias("least"))
    known = short.groupBy("w1").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n_short)).where("n >= least").select("w1", F.lit(True).alias("known"))
    # last sentences before dots
    dots = rows.where("form = 'dots' and size(split(frag, ' ')) >= 3")
    n_dots = rows.where("form = 'dots'").agg(F.greatest(F.lit(LEAST), F.count("*") * STYLE).alias("least"))
    style = dots.groupBy("frag").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n_dots)).where("n >= least").select("frag", F.lit(True).alias("style"))
    r = rows.withColumn("listed", F.col("lines").isNotNull()).drop("lines", "last").join(stat.select(F.col("key").alias("w2"), F.col("share").alias("share2")), "w2", "left").join(stat.select(F.col("key").alias("w1"), F.col("share").alias("share1")), "w1", "left")
    r = r.join(known, "w1", "left").join(style, "frag", "left")
    can_end = F.coalesce("share2", "share1", F.lit(0.0)) >= 0.5
    form = (
        F.when(F.col("form") == "list", F.when(can_end, "item").otherwise("item_cut"))
        .when(F.col("form") == "short", F.when(F.col("known"), "line").otherwise("prose"))
        .when((F.col("form") == "dots") & F.col("style"), "style")
        .otherwise(F.col("form"))
    )
    kind = F.when(F.col("json"), "json").when(F.col("listed"), "list").otherwise("prose")
    r = cut(r.select("call_id", "source", "len", form.alias("form"), kind.alias("kind")))  # read twice
    # one source's texts as counts: no more rows than forms times lengths
    post = r.groupBy("source", "kind", "form", "len").agg(F.count("*").alias("n")).groupBy("source").applyInPandas(_fit, "source string, kind string, form string, len bigint, p double")
    post = post.select(F.col("source").alias("s"), F.col("kind").alias("k"), F.col("form").alias("f"), F.col("len").alias("l"), "p")
    return r.join(post, F.col("source").eqNullSafe(F.col("s")) & (F.col("kind") == F.col("k")) & (F.col("form") == F.col("f")) & (F.col("len") == F.col("l")), "left").select("call_id", "source", "form", F.coalesce("p", F.lit(0.0)).alias("p"))


def found(results: DataFrame) -> DataFrame:
    """(call_id): the distinct cut calls."""
    return scored(results).where("p > 0.5").select("call_id").distinct()


def report(results: DataFrame) -> DataFrame:
    """Per source: distinct calls, those with text, cut ones, and their share."""
    s = scored(results).groupBy("call_id").agg((F.max("p") > 0.5).alias("is_cut"))
    calls = results.groupBy("call_id").agg(F.min("source").alias("source"))
    return calls.join(s, "call_id", "left").groupBy("source").agg(F.count("*").alias("n_calls"), F.count("is_cut").alias("n_texts"), F.coalesce(F.sum(F.col("is_cut").cast("int")), F.lit(0)).cast("bigint").alias("n_cut")).withColumn("share", F.round(F.col("n_cut") / F.col("n_calls"), 6))
