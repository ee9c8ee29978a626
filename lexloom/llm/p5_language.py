"""Problem 5: the language of each text, and of each segment of a mixed one, by a linear-chain conditional random field.

The words of a text are labelled by forward-backward. A word's features are its affixes and inner n-grams (1 to 4
characters, with marks for the word's ends) and its language in the lexicon of the training rows; the
transitions are learned with them. Training takes at most SAMPLE whole texts for each language that labels name, by the hash of their id, so that a
rare language is learned as well as a common one; a first model drops the texts that it reads otherwise,
and a second one is trained on at most PER_LANGUAGE of those left for each language, also on texts joined from several languages. Everything else covers all rows, whole texts and whole words.

A segment is a longest run of one language of at least CLAUSE words (Han characters count as parts of words); shorter runs go to
their neighbour. Its confidence is the mean posterior of its words. A text whose words make no clause is one segment.
Null and blank texts, and texts without letters, have no segment; labels are compared after case, region and spelling are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import batches, mix, spread
from .crf import forward_backward

#: The languages, and the other names of each (besides its own code).
NAMES = {
    "en": "eng english anglais ingles englisch",
    "es": "spa spanish espanol español castellano espagnol spanisch",
    "fr": "fra fre french francais français frances franzosisch",
    "de": "deu ger german deutsch allemand aleman",
    "pt": "por portuguese portugues português portugais portugiesisch",
    "ar": "ara arabic arabe العربية arabisch",
    "zh": "zho chi chinese mandarin cmn 中文 汉语 chinesisch",
    "hi": "hin hindi हिन्दी हिंदी",
}
LANGUAGES = tuple(NAMES)
N = len(LANGUAGES)
#: Bounds of a language's training rows, labelled as it and read as labelled; words of a segment, feature weights (a power of two).
SAMPLE, PER_LANGUAGE, CLAUSE, SPACE = 500, 250, 3.0, 1 << 16

#: Words; letters of codes such as XY-1234 or A12B are none.
_token = regex.compile(rf"\p{{Han}}{{1,2}}|(?<!\p{{N}})[[\p{{L}}\p{{M}}]--\p{{Han}}]++(?!\p{{N}}|-\p{{N}})", regex.V1)


def named(label: Column) -> Column:
    """The code that a label names; null if it names none of LANGUAGES."""
    key = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}\p{M}]+)(?:[-_ ].*)?$", 1)
    known = F.create_map(*[F.lit(x) for code, names in NAMES.items() for name in [code, *names.split()] for x in (name, code)])
    return F.element_at(known, key)


class Words:
    """Feature numbers of words of any length; row 0 of the weights stays zero."""

    def __init__(self, lexicon: tuple[np.ndarray, np.ndarray] | None = None):
        self.lexicon = lexicon

    @staticmethod
    def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points one after another, with 1 before and 2 behind each word; each one's word; where the words begin (with the end as last)."""
        flat = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        length = np.fromiter(map(len, words), np.int64, len(words)) + 2
        return flat, np.repeat(np.arange(len(words)), length), np.concatenate([[0], np.cumsum(length)])

    @staticmethod
    def whole(words: list[str]) -> np.ndarray:
        """One number for each word."""
        if not words:
            return np.zeros(0, np.uint64)
        flat, owner, begin = Words.codes(words)
        factor = np.cumprod(np.full(int(np.diff(begin).max()), 0x100000001B3, np.uint64))
        return mix(np.add.reduceat(flat * factor[np.arange(len(flat)) - begin[owner]], begin[:-1]))

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, feature) pairs as two lists, and each word's lexicon feature (0 if none)."""
        if not words:
            return (np.zeros(0, np.int64),) * 3
        flat, owner, begin = self.codes(words)
        owners, out = [], []
        for n in range(1, 5):
            m = len(flat) - n + 1
            if m <= 0:
                break
            h = np.full(m, np.uint64(n))
            for j in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + flat[j : j + m]
            inside = np.flatnonzero(owner[:m] == owner[n - 1 :] if n > 1 else flat > 2)
            owners.append(owner[inside])
            out.append((mix(h[inside]) >> np.uint64(48)).astype(np.int64) & (SPACE - 1))
        lex = np.zeros(len(words), np.int64)
        if self.lexicon and len(self.lexicon[0]):
            h = self.whole(words)
            k = np.minimum(np.searchsorted(self.lexicon[0], h), len(self.lexicon[0]) - 1)
            lex = np.where(self.lexicon[0][k] == h, SPACE + self.lexicon[1][k], 0)
        return np.concatenate([*owners, np.arange(len(words))]), np.concatenate([*out, lex]), lex


def summed(weights: np.ndarray, rows: np.ndarray, flat: np.ndarray, n: int) -> np.ndarray:
    """The sum of the features' weights for each of n words."""
    return np.stack([np.bincount(rows, weights[flat, k], n) for k in range(weights.shape[1])], 1).astype(np.float32)


def tokens(text: str) -> list[str]:
    return _token.findall(text.lower())


class Field:
    """The conditional random field: weights of features (SPACE + one for each lexicon language, N) and of transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]):
        self.weights, self.moves, self.words = weights, moves, Words(lexicon)
        self.known: dict[str, int] = {}
        self.emission = np.zeros((0, N), np.float32)
        self.listed = np.zeros(0, bool)

    def emissions(self, words: list[str]) -> np.ndarray:
        rows, flat, lex = self.words.features(words)
        self.listed = np.concatenate([self.listed, lex > 0])
        return summed(self.weights, rows, flat, len(words))

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Numbers of the words, whose emissions are then known."""
        if len(self.known) > 300_000:
            self.known, self.emission, self.listed = {}, np.zeros((0, N), np.float32), np.zeros(0, bool)
        known, start = self.known, len(self.known)
        out = [np.array([known.setdefault(w, len(known)) for w in t], np.int64) for t in texts]
        new = list(known)[start:]
        if new:
            self.emission = np.concatenate([self.emission] + [self.emissions(new[s : s + 20_000]) for s in range(0, len(new), 20_000)])
        return out

    def posteriors(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text, the posterior of each language for each word."""
        ids = self.numbers(texts)
        out: list = [None] * len(texts)
        order = np.argsort([len(x) for x in ids], kind="stable")
        move = np.exp(self.moves - self.moves.max()).astype(np.float32)
        for s in range(0, len(order), 512):
            some = order[s : s + 512]
            for i, p in zip(some, forward_backward([self.emission[ids[i]] for i in some], move)[0]):
                out[i] = p
        return out


def _lexicon(texts: list[list[str]], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Words that seven tenths of their training texts show to be of one language, two doubtful texts counted in: names, which all languages share, are seldom so by chance."""
    count: dict[str, np.ndarray] = {}
    for t, y in zip(texts, labels):
        for w in set(t):
            count.setdefault(w, np.zeros(N))[y] += 1
    some = [(w, int(c.argmax())) for w, c in count.items() if c.max() >= 0.7 * (c.sum() + 2)]
    if not some:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = Words.whole([w for w, _ in some])
    order = np.argsort(h)
    return h[order], np.array([y for _, y in some])[order]


def _train(texts: list[list[str]], paths: list[np.ndarray], lexicon: tuple, rounds: int) -> Field:
    """Weights that maximise the paths' likelihood, with a quadratic penalty, by full-batch Adagrad."""
    field = Field(np.zeros((SPACE + N, N), np.float32), np.zeros((N, N), np.float32), lexicon)
    if not texts:  # no row has a label that names a language: all languages stay equally likely
        return field
    vocabulary: dict[str, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t], np.int64) for t in texts]
    n = len(vocabulary)
    rows, flat, _ = field.words.features(list(vocabulary))
    # features of fewer than three words tell more of their text than of its language
    keep = (flat > 0) & ((np.bincount(np.unique(flat * n + rows) // n, minlength=SPACE + N)[flat] >= 3) | (flat >= SPACE))
    flat, rows = flat[keep], rows[keep]
    by = np.argsort(flat, kind="stable")
    flat, rows = flat[by], rows[by]
    edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    edge = edge[edge < len(flat)]
    used = flat[edge]
    order = np.argsort([len(x) for x in ids], kind="stable")
    gold_moves = np.zeros((N, N))
    gold_words = np.zeros((n, N))
    for x, y in zip(ids, paths):
        np.add.at(gold_words, (x, y), 1)
        np.add.at(gold_moves, (y[:-1], y[1:]), 1)
    seen_w, seen_m = np.full((len(used), N), 1e-3), np.full((N, N), 1e-3)
    for _ in range(rounds):
        emission = summed(field.weights, rows, flat, n)
        move = np.exp(field.moves - field.moves.max()).astype(np.float32)
        g_words, g_moves = gold_words.copy(), gold_moves.copy()
        for s in range(0, len(order), 256):
            some = order[s : s + 256]
            post, expected, _ = forward_backward([emission[ids[i]] for i in some], move, True)
            g_moves -= expected
            where = np.concatenate([ids[i] for i in some])
            p = np.concatenate(post)
            for k in range(N):
                g_words[:, k] -= np.bincount(where, weights=p[:, k], minlength=n)
        if len(used):
            g = np.add.reduceat(g_words[rows], edge, axis=0) - 0.05 * field.weights[used]
            seen_w += g * g
            field.weights[used] += (0.5 * g / np.sqrt(seen_w)).astype(np.float32)
        g_moves -= 0.05 * field.moves
        seen_m += g_moves * g_moves
        field.moves += (0.5 * g_moves / np.sqrt(seen_m)).astype(np.float32)
    return field


def train(rows: list[tuple[str, str]]) -> Field:
    """From (text, language code): a model of all rows, then one of those that it reads as labelled, with joined texts."""
    rows = sorted(rows, key=lambda r: (xxhash.xxh64_intdigest(r[0].encode("utf-8", "surrogatepass")), r))  # the same model whatever the rows' order
    texts = [tokens(t) for t, _ in rows]
    labels = [LANGUAGES.index(y) for _, y in rows]
    keep = [i for i, t in enumerate(texts) if len(t) >= 4]
    texts, labels = [texts[i] for i in keep], [labels[i] for i in keep]
    first = _train(texts, [np.full(len(t), y) for t, y in zip(texts, labels)], _lexicon(texts, labels), 12)
    for rounds in (12, 0):
        agree = [i for i, p in enumerate(first.posteriors(texts)) if (p.argmax(1) == labels[i]).mean() >= 0.9]
        texts, labels = [texts[i] for i in agree], [labels[i] for i in agree]
        if rounds:
            first = _train(texts, [np.full(len(t), y) for t, y in zip(texts, labels)], _lexicon(texts, labels), rounds)
    sure = [i for y in range(N) for i in [j for j, z in enumerate(labels) if z == y][:PER_LANGUAGE]]
    texts, labels = [texts[i] for i in sure], [labels[i] for i in sure]
    rng = np.random.default_rng(5)
    joined, paths = [], []
    for _ in range(len(texts) // 2):
        part = [(texts[i], labels[i]) for i in rng.integers(0, len(texts), int(rng.integers(2, 4)))]
        part = [(t[int(rng.integers(0, max(1, len(t) - 8))) :][: int(rng.integers(8, 30))], y) for t, y in part]
        joined.append([w for t, _ in part for w in t])
        paths.append(np.concatenate([np.full(len(t), y) for t, y in part]))
    return _train(texts + joined, [np.full(len(t), y) for t, y in zip(texts, labels)] + paths, _lexicon(texts, labels), 25)


def _weight(word: str, known: bool) -> float:
    """How much of a clause a word is: names and other words that the lexicon lacks are little."""
    return len(word) / 1.5 if "㐀" <= word[0] <= "鿿" else 1.0 if known else 0.25


def segments(words: list[str], post: np.ndarray, known: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, past the last, language) of the runs of at least a clause; shorter ones joined to a neighbour."""
    y = post.argmax(1)
    edge = [0, *(np.flatnonzero(y[1:] != y[:-1]) + 1).tolist(), len(y)]
    runs = [[a, b, int(y[a]), sum(map(_weight, words[a:b], known[a:b]))] for a, b in zip(edge, edge[1:])]
    while len(runs) > 1:
        k = min(range(len(runs)), key=lambda i: runs[i][3])
        if runs[k][3] >= CLAUSE:
            break
        left, right = (runs[k - 1] if k else None), (runs[k + 1] if k + 1 < len(runs) else None)
        to = left if right is None or (left is not None and left[3] >= right[3]) else right
        to[0], to[1], to[3] = min(to[0], runs[k][0]), max(to[1], runs[k][1]), to[3] + runs[k][3]
        del runs[k]
        for i in range(len(runs) - 1, 0, -1):
            if runs[i][2] == runs[i - 1][2]:
                runs[i - 1][1], runs[i - 1][3] = runs[i][1], runs[i - 1][3] + runs[i][3]
                del runs[i]
    return [(a, b, c) for a, b, c, _ in runs]


def fit(samples: DataFrame) -> Field:
    """The model, from at most SAMPLE labelled rows of each language."""
    rows = samples.where("text is not null and language is not null").select("sample_id", "text", named(F.col("language")).alias("code")).where("code is not null")
    have = {r["code"]: r["count"] for r in rows.groupBy("code").count().collect()}  # at most one row for each language
    if not have:
        return train([])
    # hashes among which there are somewhat more rows of a language than needed
    least = F.element_at(F.create_map(*[F.lit(x) for code, n in have.items() for x in (code, int(min(2**63 - 1, -(2**63) + 1.2 * SAMPLE / n * 2**64)))]), F.col("code"))
    h = F.xxhash64("sample_id")
    got = rows.where(h <= least).withColumn("h", h).orderBy("h", "sample_id", "text").limit(2 * SAMPLE * N).select("text", "code").collect()  # bounded by the limit
    few: dict[str, list[tuple[str, str]]] = {}
    for r in got:
        if len(few.setdefault(r["code"], [])) < SAMPLE:
            few[r["code"]].append((r["text"], r["code"]))
    return train([x for v in few.values() for x in v])


def labelled(samples: DataFrame, id_col: str = "sample_id", text_col: str = "text", label_col: str = "language") -> DataFrame:
    """One row for each segment: sample_id, seg_no, lang, confidence, start_pos, end_pos, named (language code of the label), n_segments."""
    model = fit(samples.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("text"), F.col(label_col).alias("language")))
    shared = samples.sparkSession.sparkContext.broadcast((model.weights, model.moves, model.words.lexicon))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*shared.value)
        for t in batches(it, 4000):
            texts = t["text"].to_pylist()
            words = [tokens(x) for x in texts]
            out: list[tuple] = []
            for i, (w, p) in enumerate(zip(words, field.posteriors(words))):
                if not len(w):
                    continue
                y = p.argmax(1)
                if (y == y[0]).all():
                    out.append((i, 1, int(y[0]), float(p[:, y[0]].mean()), 0, len(texts[i]), 1))
                    continue
                got = segments(w, p, field.listed[[field.known[x] for x in w]])
                if len(got) == 1:
                    out.append((i, 1, got[0][2], float(p[:, got[0][2]].mean()), 0, len(texts[i]), 1))
                    continue
                at = [m.span() for m in _token.finditer(texts[i])]
                exact = len(at) == len(w)  # lower-casing may add a character
                for k, (a, b, c) in enumerate(got, 1):
                    out.append((i, k, c, float(p[a:b, c].mean()), at[a][0] if exact else None, at[b - 1][1] if exact else None, len(got)))
            take = pa.array([x[0] for x in out], pa.int64())
            col = lambda k, kind: pa.array([x[k] for x in out], kind)
            yield pa.RecordBatch.from_arrays([t["id"].combine_chunks().take(take), col(1, pa.int32()), pa.array([LANGUAGES[x[2]] for x in out], pa.string()), col(3, pa.float64()), col(4, pa.int32()), col(5, pa.int32()), t["named"].combine_chunks().take(take), col(6, pa.int32())], ["sample_id", "seg_no", "lang", "confidence", "start_pos", "end_pos", "named", "n_segments"])

    rows = samples.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), named(F.col(label_col)).alias("named")).where(r"text rlike '\\p{L}'")
    return spread(rows, "id").mapInArrow(run, "sample_id bigint, seg_no int, lang string, confidence double, start_pos int, end_pos int, named string, n_segments int")


def found(samples: DataFrame) -> DataFrame:
    """(sample_id, seg_no, lang): the segments of texts whose label is missing or wrong, or that mix languages."""
    s = labelled(samples)
    return s.where("n_segments > 1 or named is null or named <> lang").select("sample_id", "seg_no", "lang")
