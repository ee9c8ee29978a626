"""Problem 6: personal values in free text, by a linear-chain conditional random field over word shapes.

Tokens are words, runs of digits and single other characters. Their labels mark the first and later tokens of each type's values. Features are
shapes, affixes, words and name-list membership in a window of tokens. The field is trained on the labelled table of p6_table (and the name lists); texts are
decoded by Viterbi in numpy batches.

Positions are code points from 0. Null and empty texts have no values; a text without values is its own cleaned text, a null text has null.
Rows with equal ids each have their values.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import batches, mix, spread
from .crf import forward_backward, viterbi
from .p6_table import FAMILY, GIVEN, TITLES, TITLES_OF, labelled

TYPES = ("email", "phone", "ssn", "passport", "driver_license", "address", "name")
LABELS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
K = len(LABELS)
SPACE, ROUNDS, RATE, PENALTY, BLOT, RARE = 1 << 18, 3, 0.3, 0.5, 0.35, 12

_token = regex.compile(r"\p{N}+|\p{L}[\p{L}\p{M}]*|[^\s]")
#: Columns of a token's own attributes.
WORD, SHAPE, BEFORE, SUFFIX3, SUFFIX4, PREFIX, LISTED = range(7)
#: Feature templates: (offset, attribute) pairs that are taken together.
TEMPLATES = (
    ((0, WORD),), ((-1, WORD),), ((1, WORD),), ((-2, WORD),), ((2, WORD),), ((-3, WORD),), ((-2, WORD), (0, SHAPE)), ((-3, WORD), (0, SHAPE)), ((-2, WORD), (-1, SHAPE), (0, SHAPE)), ((-1, SHAPE), (0, WORD)),
    ((0, SHAPE),), ((-1, SHAPE), (0, SHAPE)), ((0, SHAPE), (1, SHAPE)), ((-1, SHAPE), (0, SHAPE), (1, SHAPE)),
    ((-2, SHAPE), (-1, SHAPE), (0, SHAPE), (1, SHAPE), (2, SHAPE)), ((0, SHAPE), (1, SHAPE), (2, SHAPE), (3, SHAPE)), ((-3, SHAPE), (-2, SHAPE), (-1, SHAPE), (0, SHAPE)),
    ((0, SHAPE), (1, SHAPE), (2, SHAPE), (3, SHAPE), (4, SHAPE), (5, SHAPE)),
    ((0, SUFFIX3),), ((0, SUFFIX4),), ((0, PREFIX),), ((1, SUFFIX4),), ((-1, SUFFIX4),), ((0, LISTED), (0, SHAPE)), ((-1, LISTED), (0, LISTED), (1, LISTED)), ((0, LISTED), (1, WORD)), ((0, LISTED), (2, LISTED)),
    ((-1, WORD), (0, SHAPE)), ((0, SHAPE), (1, WORD)), ((-1, WORD), (0, LISTED)), ((0, BEFORE), (0, SHAPE)), ((0, BEFORE), (-1, SHAPE), (0, SHAPE)), ((0, SUFFIX4), (-1, SHAPE)), ((0, LISTED), (1, SUFFIX4)), ((-1, LISTED), (0, SUFFIX4)),
)


def _hash(s: str) -> int:
    h = 0xCBF29CE484222325
    for b in s.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


class Tokens:
    """Attributes of tokens; what a string has by itself is remembered."""

    def __init__(self, given: list[str], family: list[str]):
        self.given, self.family = {x.lower() for x in [*given, *GIVEN]}, {x.lower() for x in [*family, *FAMILY]}
        self.known: dict[str, int] = {}
        self.rows: list[list[int]] = []

    def _row(self, w: str) -> list[int]:
        low = w.lower()
        if w[0].isdigit() or regex.match(r"\p{N}", w):
            word, shape = f"#{len(w)}", f"9{len(w)}"
        elif not w[0].isalpha():
            word = shape = w
        else:
            word = low
            shape = "U" if len(w) == 1 and w.isupper() else "UU" if w.isupper() else "Uu" if w[0].isupper() else "u1" if len(w) == 1 else "u"
        lists = f"{low in self.given:d}{low in self.family:d}"
        return [_hash("w" + word), _hash("s" + shape), 0, _hash("x" + low[-3:]), _hash("y" + low[-4:]), _hash("p" + low[:3]), _hash("l" + lists)]

    @staticmethod
    def alphabetic(attributes: np.ndarray) -> np.ndarray:
        """Which tokens are words of letters."""
        return np.isin(attributes[:, SHAPE], np.array([_hash("s" + x) for x in ("U", "UU", "Uu", "u1", "u")], np.uint64))

    def attributes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
        """Attributes of all tokens, each text's first token (with the end as last), and the tokens' places."""
        if len(self.known) > 500_000:
            self.known, self.rows = {}, []
        index, gaps, places, begin = [], [], [], [0]
        known, rows = self.known, self.rows
        for t in texts:
            spans, end = [], -1
            for m in _token.finditer(t):
                w = m[0]
                i = known.get(w)
                if i is None:
                    i = known[w] = len(rows)
                    rows.append(self._row(w))
                index.append(i)
                a, b = m.span()
                gaps.append(0 if a == end else 2 if "\n" in t[max(end, 0) : a] or end < 0 else 1)
                spans.append((a, b))
                end = b
            places.append(spans)
            begin.append(len(index))
        table = np.array(rows, np.uint64).reshape(-1, 7)
        out = table[np.array(index, np.int64)] if index else np.zeros((0, 7), np.uint64)
        out[:, BEFORE] = np.array(gaps, np.uint64) + np.uint64(11)
        return out, np.array(begin), places


def features(attributes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Numbers of each token's features; places outside the text count as a token of their own."""
    n = len(attributes)
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    shifted = {}
    for k in range(-3, 6):
        at = np.arange(n) + k
        ok = (at >= 0) & (at < n)
        at = np.clip(at, 0, max(n - 1, 0))
        ok &= owner[at] == owner if n else ok
        shifted[k] = np.where(ok[:, None], attributes[at], np.uint64(7)) if n else attributes
    out = np.empty((n, len(TEMPLATES)), np.int64)
    for j, parts in enumerate(TEMPLATES):
        h = np.full(n, np.uint64(j + 1))
        for k, a in parts:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + shifted[k][:, a])
        out[:, j] = (h >> np.uint64(40)).astype(np.int64) & (SPACE - 1)
    return out


def train(given: list[str], family: list[str], table: list | None = None, rounds: int = ROUNDS, batch: int = 96) -> tuple[np.ndarray, np.ndarray]:
    """Weights (SPACE, K) and transitions (K, K) that maximise the likelihood of the labelled table, by Adagrad over small batches."""
    table = labelled(given, family) if table is None else table
    tokens = Tokens(given, family)
    a, begin, places = tokens.attributes([t for t, _ in table])
    gold = np.zeros(len(a), np.int64)
    for i, (_, spans) in enumerate(table):
        for s, e, kind in spans:
            first = True
            for j, (x, y) in enumerate(places[i]):
                if x >= s and y <= e:
                    gold[begin[i] + j] = 1 + 2 * TYPES.index(kind) + (not first)
                    first = False
    rng = np.random.default_rng(1)
    # words and lists of values, and words without capitals beside them, are blotted out here and there, so that shapes and neighbours must do for new ones
    value, small = gold > 0, np.isin(a[:, SHAPE], np.array([_hash("su"), _hash("su1")], np.uint64))
    a[value & (rng.random(len(a)) < BLOT), LISTED] = _hash("l00")
    for columns in ([WORD], [SUFFIX3, SUFFIX4, PREFIX]):
        at = np.flatnonzero((rng.random(len(a)) < BLOT) & (value | small) & tokens.alphabetic(a))
        a[np.ix_(at, columns)] = rng.integers(0, 1 << 62, (len(at), 1), np.uint64)
    f = features(a, begin)
    # features of fewer than RARE tokens tell of their sentence, not of the type: they get no weight
    often = np.bincount(f.ravel(), minlength=SPACE) >= RARE
    f = np.where(often[f], f, SPACE)
    weights, moves = np.zeros((SPACE + 1, K), np.float32), np.zeros((K, K), np.float32)
    seen_w, seen_m = np.full((SPACE + 1, K), 0.1, np.float32), np.full((K, K), 0.1)
    # batches of texts of about the same length, always the same ones, in another order each round
    by_length = np.argsort(np.diff(begin), kind="stable")
    parts = []
    for s in range(0, len(by_length), batch):
        some = by_length[s : s + batch]
        rows = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in some])
        flat = f[rows].ravel()
        by = np.argsort(flat, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], flat[by][1:] != flat[by][:-1]]))
        counts = np.zeros((K, K))
        for i in some:
            y = gold[begin[i] : begin[i + 1]]
            np.add.at(counts, (y[:-1], y[1:]), 1)
        ends = np.cumsum(np.diff(begin)[some])
        parts.append((rows, flat[by][edge], by // f.shape[1], edge, counts, [slice(e - n, e) for e, n in zip(ends, np.diff(begin)[some])]))
    share = 1 / max(1, len(parts))
    mean_w, mean_m = np.zeros_like(weights), np.zeros_like(moves)
    for _ in range(rounds):
        for k in rng.permutation(len(parts)):
            rows, used, token_of, edge, counts, spans = parts[k]
            emission = np.zeros((len(rows), K), np.float32)
            for j in range(f.shape[1]):
                emission += weights[f[rows, j]]
            post, expected, _ = forward_backward([emission[x] for x in spans], np.exp(moves - moves.max()).astype(np.float32), True)
            g = -np.concatenate(post)
            g[np.arange(len(rows)), gold[rows]] += 1
            step = np.add.reduceat(g[token_of], edge, axis=0) - PENALTY * share * weights[used]
            seen_w[used] += step * step
            weights[used] += RATE * step / np.sqrt(seen_w[used])
            weights[SPACE] = 0
            step = counts - expected - PENALTY * share * moves
            seen_m += step * step
            moves += (RATE * step / np.sqrt(seen_m)).astype(np.float32)
        # the mean of the rounds' weights depends less on the order of the batches than the last ones
        mean_w += weights / rounds
        mean_m += moves / rounds
    return mean_w[:SPACE], mean_m


@functools.lru_cache(maxsize=4)
def fitted(given: tuple[str, ...], family: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The weights for these name lists, fitted once for a session and used by all its queries."""
    return train(list(given), list(family))


class Field:
    def __init__(self, weights: np.ndarray, moves: np.ndarray, given: list[str], family: list[str]):
        self.weights, self.tokens = weights, Tokens(given, family)
        self.moves, self.start = moves.copy(), np.zeros(K, np.float32)
        for j in range(2, K, 2):  # an inner label follows its own type only
            bad = [i for i in range(K) if i not in (j, j - 1)]
            self.moves[bad, j] = -1e4
            self.start[j] = -1e4

    def values(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, past, type) of each text's values in order."""
        a, begin, places = self.tokens.attributes(texts)
        f = features(a, begin)
        emission = np.zeros((len(f), K), np.float32)
        for j in range(f.shape[1]):
            emission += self.weights[f[:, j]]
        out: list = [[] for _ in texts]
        order = np.argsort(np.diff(begin), kind="stable")
        for s in range(0, len(order), 256):
            some = order[s : s + 256]
            for i, path in zip(some, viterbi([emission[begin[i] : begin[i + 1]] for i in some], self.moves, self.start)):
                for j in np.flatnonzero(path):
                    y = int(path[j])
                    x, e = places[i][j]
                    if y % 2 or not out[i]:
                        out[i].append([x, e, TYPES[(y - 1) // 2]])
                    else:
                        out[i][-1][1] = e
        return [_whole(x, v) for x, v in zip(texts, out)]


_title = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted({regex.escape(t.rstrip('.')) for t in [*TITLES, *(x for v in TITLES_OF.values() for x in v)]}))})\.?\s+\Z", regex.I)


_at = regex.compile(r"(?:@|＠|(?<!\p{L})(?:at|arroba|chez)(?!\p{L})).*(?:\.|(?<!\p{L})(?:dot|punto)(?!\p{L}))", regex.I | regex.S)
_before, _after = regex.compile(r"(?:[\p{L}\p{N}]|\p{N}[-/.]|\p{L}-)\Z"), regex.compile(r"[-/]?[\p{L}\p{N}]")


def _formed(text: str, a: int, b: int, kind: str) -> bool:
    """What the kinds are by definition: a name is of two words or stands behind a title; an e-mail address has a sign or word for @ and a dot behind it; the others have digits; and none is a part of a longer code."""
    if kind == "name":
        return bool(regex.search(r"\p{L}[\s,.]+\p{L}", text[a:b]) or _title.search(text, max(0, a - 16), a)) and not regex.match(r"\p{N}", text[b : b + 1])
    if kind == "email":
        return bool(_at.search(text, a, b))
    return bool(regex.search(r"\p{N}", text[a:b])) and (kind != "address" or bool(regex.search(r"\p{L}", text[a:b]))) and not _before.search(text, max(0, a - 2), a) and not (kind != "address" and _after.match(text, b))


_rest = regex.compile(r"(?:[-./]?\p{N})+(?:-?\p{L}(?![\p{L}\p{N}]))?")


def _whole(text: str, values: list) -> list[tuple[int, int, str]]:
    """A number's last group may have got no label: what goes on without a space belongs to it. What isn't formed as its kind is no value."""
    out = []
    for k, (a, b, t) in enumerate(values):
        if t in ("phone", "ssn") and (m := _rest.match(text, b)):
            b = m.end() if k + 1 == len(values) or m.end() <= values[k + 1][0] else b
        if _formed(text, a, b, t):
            out.append((a, b, t))
    return out


def cleaned(text: str, values: list[tuple[int, int, str]]) -> str:
    """The text with typed placeholders in place of the values; all else stays."""
    out, at = [], 0
    for a, b, t in values:
        out += [text[at:a], f"[{t.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def lists(lexicon: DataFrame) -> tuple[list[str], list[str]]:
    """Given and family names; the lexicon is a small fixed list."""
    rows = sorted({(r["kind"], r["entry"]) for r in lexicon.where("entry is not null and kind is not null").select("kind", "entry").collect()})
    return [e for k, e in rows if k == "given"], [e for k, e in rows if k == "family"]


def scanned(results: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One row for each row: result_id, cleaned_text, found array<struct<pii_type, start_pos, end_pos, value>>."""
    given, family = lists(lexicon)
    shared = results.sparkSession.sparkContext.broadcast((*fitted(tuple(given), tuple(family)), given, family))
    kind = pa.list_(pa.struct([("pii_type", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("value", pa.string())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*shared.value)
        for t in batches(it, 2000):
            texts = t["text"].to_pylist()
            got = field.values([x or "" for x in texts])
            found = [[{"pii_type": k, "start_pos": a, "end_pos": b, "value": x[a:b]} for a, b, k in v] for x, v in zip(texts, got)]
            yield pa.RecordBatch.from_arrays([t["result_id"].combine_chunks(), pa.array([x and cleaned(x, v) for x, v in zip(texts, got)], pa.string()), pa.array(found, kind)], ["result_id", "cleaned_text", "found"])

    rows = results.select(F.col("result_id").cast("bigint").alias("result_id"), F.col("original_text").alias("text"))
    return spread(rows, "result_id").mapInArrow(run, "result_id bigint, cleaned_text string, found array<struct<pii_type: string, start_pos: int, end_pos: int, value: string>>")


def found(results: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(result_id, pii_type, start_pos): one row for each value."""
    return scanned(results, lexicon).select("result_id", F.explode("found").alias("v")).select("result_id", "v.pii_type", "v.start_pos")
