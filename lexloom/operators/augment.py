"""Reproducible text augmentation. Every random choice is a hash of seed, id, variant and rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T

#: A small built-in lexicon of common words; a table of (word, synonym) may take its place, see `lexicon`.
SYNONYMS = {"big": "large", "small": "little", "fast": "rapid", "slow": "gradual", "happy": "glad", "sad": "unhappy", "begin": "start", "finish": "complete", "help": "assist", "buy": "purchase", "show": "display", "choose": "select", "keep": "retain", "need": "require", "give": "provide", "get": "obtain", "make": "create", "change": "alter", "important": "significant", "easy": "simple", "hard": "difficult", "right": "correct", "wrong": "incorrect", "good": "fine", "bad": "poor", "new": "recent", "old": "former", "house": "home", "work": "labour", "road": "street", "answer": "reply", "question": "query", "price": "cost", "half": "fifty percent", "long": "lengthy", "whole": "entire", "against": "contrary to", "again": "once more", "during": "throughout", "without": "lacking"}
INSERT = ("really", "very", "quite", "extremely", "particularly", "especially", "however", "moreover", "furthermore", "additionally", "also", "indeed", "certainly", "absolutely", "definitely", "truly")
ADVERBS = ("really", "very", "quite", "extremely", "particularly", "especially", "also", "indeed", "certainly", "absolutely", "definitely", "truly", "again", "never", "always", "often", "soon", "honestly", "oddly")
REWRITES = (
    (r"(^|[^\p{L}\p{N}_])(\w+)\s+(is|are|was|were)\s+(\w+ing)($|[^\p{L}\p{N}_])", "{1}{4} {3} being done by {2}{5}"),
    (r"(^|[^\p{L}\p{N}_])because\s+([^\r\n]+?),\s+([^\r\n]+)", "{1}{3} because {2}"),
    (r"([^\r\n]+?),\s+but\s+([^\r\n]+)", "{2}, although {1}"),
    (r"(^|[^\p{L}\p{N}_])very\s+(\w+)", "{1}extremely {2}"),
    (r"(^|[^\p{L}\p{N}_])good($|[^\p{L}\p{N}_])", "{1}excellent{2}"),
    (r"(^|[^\p{L}\p{N}_])bad($|[^\p{L}\p{N}_])", "{1}poor{2}"),
    (r"(^|[^\p{L}\p{N}_])big($|[^\p{L}\p{N}_])", "{1}large{2}"),
    (r"(^|[^\p{L}\p{N}_])small($|[^\p{L}\p{N}_])", "{1}tiny{2}"),
)
EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
PUNCTUATION = {".": ("!", ".", "..."), "!": ("!", "!!", "."), "?": ("?", "??", ".")}
CONTRACTIONS = (("won't", "will not"), ("can't", "cannot"), ("n't", " not"), ("'re", " are"), ("'ve", " have"), ("'ll", " will"), ("'d", " would"), ("'m", " am"))
STRATEGIES = ("synonym", "paraphrase", "reorder", "insert", "delete", "punctuation", "case", "contraction")


def chance(seed: int, key: Column, tag: str) -> Column:
    return T.uniform(seed, key, tag)


def lexicon(table: DataFrame, most: int = 20_000) -> dict[str, str]:
    """A lexicon from a table of (word, synonym): of each word the first synonym. It becomes a part of the plan, so a table of more than `most` words is an error."""
    rows = table.where("word is not null and synonym is not null").groupBy(F.lower("word").alias("word")).agg(F.min("synonym").alias("synonym")).limit(most + 1).collect()  # bounded by `most`
    if len(rows) > most:
        raise ValueError(f"more than {most} words in the lexicon")
    return {r["word"]: r["synonym"] for r in rows}


def synonyms(text: Column, seed: int, key: Column, p: float = 0.3, lexicon: dict[str, str] = SYNONYMS) -> Column:
    """Each word of the lexicon is replaced with chance p; words are joined by single spaces."""
    table = F.create_map(*[F.lit(x) for kv in lexicon.items() for x in kv])
    words = F.split(T.squeeze(text), " ")
    swap = lambda w, i: F.when((T.uniform(seed, F.concat_ws("/", key, i), "synonym") < p) & F.array_contains(T.literals(tuple(lexicon)), F.lower(w)), F.element_at(table, F.lower(w))).otherwise(w)
    return F.array_join(F.transform(words, swap), " ")


def paraphrase(text: Column, seed: int, key: Column, p: float = 0.2) -> Column:
    """Each of eight rewrites is applied with chance p to texts of two or more sentences."""
    out = text
    for i, (pattern, to) in enumerate(REWRITES):
        java = reduce(lambda t, k: t.replace(f"{{{k}}}", f"${k}"), (1, 2, 3, 4, 5), to)
        # a rule that is not drawn puts the match back: the text so far stands once in the expression, whatever the number of rules
        out = F.regexp_replace(out, F.lit("(?i)" + pattern), F.when(chance(seed, key, f"paraphrase{i}") < p, F.lit(java)).otherwise(F.lit("$0")))
    return F.when(F.size(T.sentences(text)) >= 2, out).otherwise(text)


def kept_sentences(text: Column) -> Column:
    """Sentences with their ends."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?\r\n]+[.!?]*"), F.lit(0)), lambda s: F.regexp_replace(s, EDGES, "")), lambda s: s != "")


def reorder(text: Column, seed: int, key: Column) -> Column:
    """Texts of two to four sentences have them in the order of their hashes."""
    s = kept_sentences(text)
    mixed = F.array_sort(F.transform(s, lambda x, i: F.struct(T.uniform(seed, F.concat_ws("/", key, i), "reorder").alias("u"), i.alias("i"), x.alias("x"))))
    return F.when(F.size(s).between(2, 4), F.array_join(F.transform(mixed, lambda m: m["x"]), " ")).otherwise(text)


def insert_word(text: Column, seed: int, key: Column) -> Column:
    """Texts of five or more words get one of the words to insert before a word other than the first."""
    w = F.split(T.squeeze(text), " ")
    at = (F.floor(chance(seed, key, "insert_at") * (F.size(w) - 1)) + 1).cast("int")
    word = F.element_at(T.literals(INSERT), (F.floor(chance(seed, key, "insert_word") * len(INSERT)) + 1).cast("int"))
    return F.when(F.size(w) >= 5, F.array_join(F.concat(F.slice(w, F.lit(1), F.least(at, F.size(w))), F.array(word), F.slice(w, at + 1, F.size(w))), " ")).otherwise(text)


def delete_word(text: Column, seed: int, key: Column) -> Column:
    """Texts of eight or more words lose one of their listed adverbs, by hash."""
    w = F.split(T.squeeze(text), " ")
    places = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(T.literals(ADVERBS), F.lower(x)), i).otherwise(-1)), lambda i: i >= 0)
    at = F.get(places, F.floor(chance(seed, key, "delete") * F.size(places)).cast("int"))
    return F.when((F.size(w) >= 8) & at.isNotNull(), F.array_join(F.concat(F.slice(w, F.lit(1), at), F.slice(w, at + 2, F.size(w))), " ")).otherwise(text)


def vary_punctuation(text: Column, seed: int, key: Column, p: float = 0.3) -> Column:
    """The first of each sentence end is replaced with chance p."""
    out = text
    for mark, to in PUNCTUATION.items():
        new = F.element_at(T.literals(to), (F.floor(chance(seed, key, f"mark{mark}") * len(to)) + 1).cast("int"))
        out = F.regexp_replace(out, F.lit(rf"^([^{mark}]*)[{mark}]"), F.concat(F.lit("$1"), F.when(chance(seed, key, f"punctuation{mark}") < p, new).otherwise(F.lit(mark))))
    return out


def vary_case(text: Column, seed: int, key: Column, p: float = 0.2) -> Column:
    """A text that begins with a capital begins with a small letter with chance p, its spaces squeezed."""
    t = T.squeeze(text)
    return F.when(F.left(text, F.lit(1)).rlike(r"^\p{Lu}") & (chance(seed, key, "case") < p), F.concat(F.lower(F.left(t, F.lit(1))), F.substr(t, F.lit(2)))).otherwise(text)


def contractions(text: Column, seed: int, key: Column, p: float = 0.3) -> Column:
    """One half of the texts have all contractions written out, the other half some (chance p each) drawn together."""
    wide = reduce(lambda t, c: F.replace(t, F.lit(c[0]), F.lit(c[1])), CONTRACTIONS, text)
    tight = reduce(lambda t, c: F.replace(t, F.lit(c[1]), F.when(chance(seed, key, f"contract {c[0]}") < p, F.lit(c[0])).otherwise(F.lit(c[1]))), CONTRACTIONS, text)
    return F.when(chance(seed, key, "contraction") < 0.5, wide).otherwise(tight)


RULES = {"synonym": synonyms, "paraphrase": paraphrase, "reorder": reorder, "insert": insert_word, "delete": delete_word, "punctuation": vary_punctuation, "case": vary_case, "contraction": contractions}


def augment(df: DataFrame, id_col: str, text: str = "text", factor: float = 1.5, strategies: tuple[str, ...] = STRATEGIES, seed: int = 42, keep_length: bool = False) -> DataFrame:
    """max(1, int(factor)) variants of each row: one to three strategies by hash, in the order of their hashes; unchanged variants are dropped.

    Adds variant, original_text and augmentation_strategies (those that changed the text); source is `augmented`, confidence (0.8 if null) times 0.9. With
    keep_length, variants outside 0.8 to 1.2 of the original length are dropped. Null texts have no variants.
    """
    d = T.spread(df.where(F.col(text).isNotNull()), id_col).withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(max(1, int(factor))))))
    d = varied(d, F.concat_ws("/", F.col(id_col).cast("string"), F.col("variant").cast("string")), text, strategies, seed).where(F.col(text) != F.col("original_text"))
    if keep_length:
        d = d.where((F.length(text) / F.length("original_text")).between(0.8, 1.2))
    return d.withColumn("source", F.lit("augmented")).withColumn("confidence", F.coalesce("confidence", F.lit(0.8)) * 0.9)


def varied(df: DataFrame, key: Column, text: str = "text", strategies: tuple[str, ...] = STRATEGIES, seed: int = 42) -> DataFrame:
    """Each row's text changed by one to three strategies, drawn by the hash of `key`; adds original_text and augmentation_strategies (those that changed the text, none for a text that stayed)."""
    d = df.withColumn("_key", key).withColumn("original_text", F.col(text))
    key = F.col("_key")
    drawn = F.array_sort(F.array(*[F.struct(chance(seed, key, f"draw {s}").alias("u"), F.lit(s).alias("s")) for s in strategies]))
    k = F.least(F.lit(len(strategies)), (F.floor(chance(seed, key, "count") * 3) + 1).cast("int"))
    d = T.once(d, _drawn=F.transform(F.slice(drawn, F.lit(1), k), lambda x: x["s"]))
    d = d.withColumn("_used", F.array().cast("array<string>"))
    for _round in range(min(3, len(strategies))):
        s = F.get("_drawn", F.lit(_round))
        new = F.col(text)
        for name in strategies:
            new = F.when(s == name, RULES[name](F.col(text), seed, key)).otherwise(new)
        d = T.once(d, _new=new)
        d = d.withColumn("_used", F.when(F.col("_new") != F.col(text), F.array_append("_used", s)).otherwise(F.col("_used"))).withColumn(text, F.coalesce("_new", text)).drop("_new")
    return d.withColumn("augmentation_strategies", F.col("_used")).drop("_key", "_drawn", "_used")


def adversarial(df: DataFrame, id_col: str, n: int, text: str = "text", seed: int = 42) -> DataFrame:
    """Up to n rows by hash, each changed by up to four rules; kept if changed; source `adversarial`, confidence 0.7."""
    from lexloom.operators.sampling import sample_k

    d = sample_k(df.where(F.col(text).isNotNull()), id_col, n, seed, "adversarial")
    out = augment(d, id_col, text, 1, ("synonym", "punctuation", "case", "contraction"), seed)
    return out.withColumn("source", F.lit("adversarial")).withColumn("confidence", F.lit(0.7))
