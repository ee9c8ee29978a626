"""Problem 1: the same or nearly the same text in the train rows and in the evaluation rows of a task.

The evaluation texts of a task (in shards of bounded size) are indexed by a compressed full-text index: all suffixes in order,
the Burrows-Wheeler transform of that order held as runs, and rank by run. Train texts are streamed through it in batches.
Backward search finds the windows of five characters that occur (no shorter match matters to the similarity) and the
intervals of their occurrences; windows that occur beside each other are merged to spans. Counts over the spans bound what a text
can share, and in the spans of the texts that have a partner the maximal matches are sought: in the order of the suffixes, as many characters
at once as fit one number, from few places of a span (the ends of the longest matches from a span's places never go back).

No pair is lost: of a text with D windows, a partner of similarity s holds all but (1 - s) D. So of any k + (1 - s) D
windows it holds at least k. Each text's rarest windows (by the interval's size) are looked up, and partners with
fewer hits than that are dropped. What is left is counted exactly over both sets of windows.

Work is dealt by (task, shard, block of train rows). Where a task has more than one shard, a train text goes only to the shards that hold a text which may be its partner.
That is told by parities: of each of some hundred cells, whether an odd number of a text's distinct windows fall there. Texts that differ in d windows differ in d parities at most, and a partner's
size and d are bounded, so no pair is lost; only parities travel for that. Equal texts are matched once in each part; their pairs are spread by Spark. Rows with null id, task, split or text, or fewer than
20 characters in normal form are in no pair; repeated rows count once; splits of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import GRAM, SHORTEST, batches, code_points, cut, distinct_sorted, grams, normal_form, shared_counts

#: Characters of a shard of evaluation texts, and of a block of train texts; characters and hits that are handled at once.
SHARD, BLOCK, BATCH, HITS = 3_000_000, 2_500_000, 800_000, 2_000_000
#: Where a task has more than one shard: characters of its train and of its evaluation texts whose parities are compared at once; windows of the narrowest class of sizes; rows that are compared at a stretch.
WIDE, LOT, NARROW, STRIP = 20_000_000, 200_000_000, 256, 1 << 16
#: Packed numbers of symbols that are compared at once.
AHEAD = 8
#: SPARE: windows that are looked up beyond those that a partner may lack.
SIMILARITY, SPARE = 0.7, 24
EVALUATION = ("val", "validation", "test")


class RunIndex:
    """Compressed full-text index of texts."""

    def __init__(self, texts: list[str]):
        points, at = code_points(texts)
        self.alphabet = np.unique(points)
        self.base = len(self.alphabet) + 1
        n = len(points) + len(texts)
        self.n = n
        self.bits = max(1, int(self.base - 1).bit_length())
        self.width = 62 // self.bits  # symbols that fit one number
        # symbol 0 ends each text
        where = np.arange(len(points)) + np.repeat(np.arange(len(texts)), np.diff(at))
        s = np.zeros(n, np.int64)
        s[where] = np.searchsorted(self.alphabet, points) + 1
        rows = self._order(s)
        self.rows, self.text = rows.astype(np.int32), s.astype(np.int32)
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(at) + 1)[rows]  # the text of each row
        bwt = s[rows - 1]
        start = np.concatenate([[0], np.flatnonzero(bwt[1:] != bwt[:-1]) + 1])
        symbol, length = bwt[start], np.diff(np.concatenate([start, [n]]))
        run = symbol * (n + 1) + start
        by = np.argsort(run)
        self.run = run[by]
        self.length = length[by]
        self.before = np.cumsum(self.length) - self.length  # first row of the run's images: symbols smaller, and earlier runs
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=self.base))])

    def _order(self, s: np.ndarray) -> np.ndarray:
        """Suffixes in order, each read as far as its text's end: sorted by as many symbols as fit one number, then ties alone by doubled prefixes."""
        n, bits, h = len(s), self.bits, self.width
        key = np.zeros(n, np.int64)
        padded = np.concatenate([s, np.zeros(h, np.int64)])
        for j in range(h):
            key = key << bits | padded[j : j + n]
        order = np.argsort(key)
        key = key[order]
        at = np.flatnonzero(np.concatenate([key[1:] == key[:-1], [False]]) | np.concatenate([[False], key[1:] == key[:-1]]))
        place = np.arange(n)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), place, 0))
        ends = np.flatnonzero(s == 0)
        rest = ends[np.searchsorted(ends, place)] - place if n else place  # symbols before the text's end
        while True:
            p = order[at]
            at = at[rest[p] >= h]  # those that ended are equal
            if not len(at):
                return order
            p = order[at]
            k = rank[p] * (n + 1) + rank[p + h] + 1
            by = np.argsort(k)
            order[at], k = p[by], k[by]
            fresh = np.concatenate([[True], k[1:] != k[:-1]])
            rank[order[at]] = np.maximum.accumulate(np.where(fresh, at, 0))
            at = at[~fresh | np.concatenate([~fresh[1:], [False]])]
            h *= 2

    def _keys(self, s: np.ndarray, n: int) -> np.ndarray:
        """Numbers in the order of the windows of GRAM symbols at 0 .. n - 1."""
        k = s[:n].copy()
        high = self.base
        for j in range(1, GRAM):
            if high * self.base >= 1 << 62:  # large alphabets: ranks of the prefixes instead
                _, k = np.unique(k, return_inverse=True)
                high = int(k.max()) + 1 if len(k) else 1
            k = k * self.base + s[j : j + n]
            high *= self.base
        return k

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The row that begins the rotations which have the symbol before those of rows below `row`."""
        want = symbol * (self.n + 1) + row
        j = np.searchsorted(self.run, want) - 1
        inside = (j >= 0) & (self.run[j] >= symbol * (self.n + 1))
        got = self.before[j] + np.minimum(want - self.run[j], self.length[j])
        return np.where(inside, got, self.first[symbol])

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of windows, one a row of GRAM symbols, by backward search; windows with equal ends share its first steps."""
        last = windows[:, -3] * self.base * self.base + windows[:, -2] * self.base + windows[:, -1]
        ends, which = np.unique(last, return_inverse=True)
        c = ends % self.base
        lo, hi = self.first[c], self.first[c + 1]
        for c in (ends // self.base % self.base, ends // (self.base * self.base)):
            lo, hi = self.step(c, lo), self.step(c, hi)
        lo, hi = lo[which], hi[which]
        live = np.flatnonzero(hi > lo)
        for j in range(GRAM - 4, -1, -1):
            c = windows[live, j]
            lo[live], hi[live] = self.step(c, lo[live]), self.step(c, hi[live])
            live = live[hi[live] > lo[live]]
        return lo, np.maximum(hi, lo)


    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Numbers of the characters; 0 for those that the index lacks."""
        place = np.searchsorted(self.alphabet, points)
        place[place == len(self.alphabet)] = 0
        return np.where(self.alphabet[place] == points, place + 1, 0)

    @cached_property
    def packed(self) -> np.ndarray:
        """At each place of the texts the symbols from there on, as many as fit one number, none past the text's end."""
        key, inside = np.zeros(self.n, np.int64), np.ones(self.n, bool)
        padded = np.concatenate([self.text, np.zeros(self.width, np.int32)])
        for j in range(self.width):
            c = padded[j : j + self.n]
            inside &= c > 0
            key = key << self.bits | c * inside
        return key

    @cached_property
    def leading(self) -> np.ndarray:
        """The packed symbols in the order of the suffixes."""
        return self.packed[self.rows]

    def narrowed(self, key: np.ndarray, depth: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of intervals whose suffixes, equal for depth symbols, go on with the packed symbols key (where there are none, the place that they would have); found by halving."""
        ends = []
        for above in (key, key + 1):
            a, b = (ends[0] if ends else lo).copy(), hi.copy()
            open_ = np.flatnonzero(a < b)
            while len(open_):
                m = (a[open_] + b[open_]) >> 1
                less = self.packed[self.rows[m] + depth[open_]] < above[open_]
                a[open_[less]] = m[less] + 1
                b[open_[~less]] = m[~less]
                open_ = open_[a[open_] < b[open_]]
            ends.append(a)
        return ends[0], ends[1]

    def along(self, keys: np.ndarray, at: np.ndarray, there: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where the symbols from at on, up to last, cease to be equal to those of the indexed texts from there on; some packed numbers of each are compared at once."""
        at, live, there = at.copy(), np.arange(len(at)), there.astype(np.int64)
        ahead = np.arange(AHEAD) * self.width
        while len(live):
            differ = keys[np.minimum(at[live, None] + ahead, len(keys) - 1)] ^ self.packed[np.minimum(there[:, None] + ahead, self.n - 1)]
            k = np.argmax(differ != 0, 1)
            differ = differ[np.arange(len(k)), k]
            more = differ == 0
            at[live] += np.where(more, AHEAD * self.width, k * self.width + self.alike(differ))
            more &= at[live] < last[live]
            live, there = live[more], there[more] + AHEAD * self.width
        return np.minimum(at, last)

    def alike(self, differ: np.ndarray) -> np.ndarray:
        """How many of the first packed symbols are equal in numbers whose bits differ so."""
        return self.width - np.searchsorted(np.int64(1) << self.bits * np.arange(self.width, dtype=np.int64), differ, "right")

    def reach(self, keys: np.ndarray, p: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where the longest matches that begin at p end, up to last. keys: the packed symbols of the searched texts."""
        at = p.copy()
        live, key = np.arange(len(p)), keys[p]
        lo, hi = np.zeros(len(p), np.int64), np.full(len(p), self.n)
        a, b = np.searchsorted(self.leading, key), np.searchsorted(self.leading, key, "right")
        while True:
            # those that no suffix goes on with share most with a neighbour of the place that they would have
            x = np.flatnonzero(b == a)
            depth = (at - p)[live[x]]
            differ = np.full(len(x), 1 << 62)
            for row, there in ((a[x] - 1, a[x] > lo[x]), (a[x], a[x] < hi[x])):
                differ[there] = np.minimum(differ[there], self.packed[self.rows[row[there]] + depth[there]] ^ key[x[there]])
            at[live[x]] += self.alike(differ)
            ok = np.flatnonzero(b > a)
            live, lo, hi = live[ok], a[ok], b[ok]
            at[live] += self.width
            # what is shared with the first and with the last of the suffixes left is shared with all of them; a single one is followed to its end, others for a stretch
            depth, x = (at - p)[live], at[live]
            at[live] = self.along(keys, x, self.rows[lo] + depth, np.where(hi > lo + 1, np.minimum(x + AHEAD * self.width, last[live]), last[live]))
            more = np.flatnonzero(hi > lo + 1)
            y = live[more]
            at[y] = np.minimum(at[y], self.along(keys, x[more], self.rows[hi[more] - 1] + depth[more], at[y]))
            more = more[at[y] < last[y]]
            live, lo, hi = live[more], lo[more], hi[more]
            if not len(live):
                return np.minimum(at, last)
            key = keys[at[live]]
            a, b = self.narrowed(key, (at - p)[live], lo, hi)

    def maximal(self, s: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The maximal matches (no longer to the left nor to the right) in spans begin .. end of symbols all of whose windows occur: (span, start, past the last).
        The longest match from a place ends nowhere before that from an earlier place, and a maximal match begins where that end moves: the places are halved where it differs."""
        padded = np.concatenate([s, np.zeros(self.width, s.dtype)])
        keys = np.zeros(len(s), np.int64)
        for j in range(self.width):
            keys = keys << self.bits | padded[j : j + len(s)]
        span = np.flatnonzero(end > begin)
        a, b, to_b = begin[span], end[span] - GRAM, end[span]
        to_a = self.reach(keys, a, to_b)
        out = [(span, a, to_a)]
        while True:
            more = to_a < to_b
            span, a, to_a, b, to_b = (x[more] for x in (span, a, to_a, b, to_b))
            if not len(span):
                return tuple(np.concatenate(x) for x in zip(*out))
            beside = b == a + 1
            out.append((span[beside], b[beside], to_b[beside]))
            span, a, to_a, b, to_b = (x[~beside] for x in (span, a, to_a, b, to_b))
            m = (a + b) >> 1
            to_m = self.reach(keys, m, end[span])
            span, a, to_a, b, to_b = (np.concatenate(x) for x in ((span, span), (a, m), (to_a, to_m), (m, b), (to_m, to_b)))

    def matches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, the characters in its merged spans, and its longest maximal match."""
        points, at = code_points(texts)
        covered, longest = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        m = len(points) - GRAM + 1
        if m <= 0:
            return covered, longest
        s = self.symbols(points)
        count = np.maximum(np.diff(at) - GRAM + 1, 0)
        window = np.arange(count.sum()) + np.repeat(at[:-1] - _below(count), count)
        owner = np.repeat(np.arange(len(texts)), count)
        known = np.ones(m, bool)
        for j in range(GRAM):
            known &= s[j : j + m] > 0
        ok = known[window]
        window, owner = window[ok], owner[ok]
        _, first, which = np.unique(self._keys(s, m)[window], return_index=True, return_inverse=True)
        lo, hi = self.search(np.stack([s[window[first] + j] for j in range(GRAM)], 1)) if len(first) else (window, window)
        occurs = (hi > lo)[which]
        window, owner = window[occurs], owner[occurs]
        if not len(window):
            return covered, longest
        edge = np.flatnonzero(np.concatenate([[True], (window[1:] != window[:-1] + 1) | (owner[1:] != owner[:-1])]))
        begin, end = window[edge], window[np.append(edge[1:], len(window)) - 1] + GRAM
        # windows that are apart by less than their length overlap or touch: they are one span
        apart = np.concatenate([[True], (begin[1:] > end[:-1]) | (owner[edge][1:] != owner[edge][:-1])])
        covered += np.bincount(owner[edge], np.maximum(end - np.maximum(begin, np.where(apart, begin, np.concatenate([[0], end[:-1]]))), 0), len(texts)).astype(np.int64)
        span, x, y = self.maximal(s, begin, end)
        np.maximum.at(longest, owner[edge][span], y - x)
        return covered, longest


def _below(parts: np.ndarray) -> np.ndarray:
    return np.cumsum(parts) - parts


def _candidates(index: RunIndex, texts: list[str], similarity: float, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, indexed text) that may reach the similarity; every pair that does is among them. size: distinct windows of the indexed texts."""
    n_index = len(size)
    points, at = code_points(texts)
    m = len(points) - GRAM + 1
    none = np.zeros(0, np.int64)
    if m <= 0:
        return none, none
    s = index.symbols(points)
    count = np.maximum(np.diff(at) - GRAM + 1, 0)
    window = np.arange(count.sum()) + np.repeat(at[:-1] - _below(count), count)
    owner = np.repeat(np.arange(len(texts)), count)
    known = np.ones(m, bool)
    for j in range(GRAM):
        known &= s[j : j + m] > 0
    ok = known[window]
    # distinct windows that hold a character foreign to the index: repeats would count against the bound once more each
    absent = np.zeros(len(texts), np.int64)
    if not ok.all():
        h, o = grams(texts)[0][~ok], owner[~ok]
        order = np.lexsort((h, o))
        h, o = h[order], o[order]
        absent = np.bincount(o[np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]))], minlength=len(texts))
    window, owner = window[ok], owner[ok]
    key = index._keys(s, m)[window]
    order = np.argsort(key)
    key, owner, window = key[order], owner[order], window[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at_new = window[new]
    # each text's distinct windows; numbers are sorted much faster than their order is found
    bits = len(texts).bit_length()
    code = (np.cumsum(new) - 1) << bits | owner
    code.sort()
    code = code[np.append(code[1:] != code[:-1], True)] if len(code) else code
    which, owner = code >> bits, code & ((1 << bits) - 1)
    lo, hi = index.search(np.stack([s[at_new + j] for j in range(GRAM)], 1)) if len(at_new) else (none, none)
    lo, n_hits = lo[which], (hi - lo)[which]
    distinct = absent + np.bincount(owner, minlength=len(texts))
    miss = np.floor((1 - similarity) * distinct + 1e-9).astype(np.int64)
    # the spans of windows that occur cover too little: no partner
    missing = absent + np.bincount(owner[n_hits == 0], minlength=len(texts))
    # sizes that a partner may have
    least = np.ceil(similarity * (distinct - absent) - 1e-9).astype(np.int32)
    most = np.floor(distinct / similarity + 1e-9).astype(np.int32)
    size = size.astype(np.int32)
    open_ = (missing <= miss) & (distinct > 0)
    use = (n_hits > 0) & open_[owner]
    lo, n_hits, owner = lo[use], n_hits[use], owner[use]
    if not len(owner):
        return none, none
    level = np.floor(np.log2(n_hits) * 4).astype(np.int64)
    top = int(level.max()) + 1
    table = np.bincount(owner * top + level, minlength=len(texts) * top).reshape(len(texts), top)
    sofar = missing[:, None] + np.cumsum(table, 1)
    limit = np.argmax(sofar >= (miss + SPARE)[:, None], 1)
    limit[sofar[:, -1] < miss + SPARE] = top - 1
    taken = sofar[np.arange(len(texts)), limit]
    need = np.maximum(taken - miss, 1)
    use = level <= limit[owner]
    lo, n_hits, owner = lo[use], n_hits[use], owner[use]
    order = np.sort(owner << 32 | np.arange(len(owner))) & ((1 << 32) - 1)
    lo, n_hits, owner = lo[order], n_hits[order], owner[order]
    out_t, out_e = [], []
    ends = np.cumsum(n_hits)
    begin = 0
    last_of = np.append(np.flatnonzero(owner[1:] != owner[:-1]), len(owner) - 1) + 1  # ends of the texts' runs
    while begin < len(owner):
        done = ends[begin - 1] if begin else 0
        k = np.searchsorted(ends[last_of - 1], done + HITS, "right")
        stop = int(last_of[min(max(k - 1, np.searchsorted(last_of, begin, "right")), len(last_of) - 1)])
        c = n_hits[begin:stop]
        row = np.arange(c.sum()) + np.repeat(lo[begin:stop] - _below(c), c)
        e = index.owner[row]
        x = owner[begin:stop]
        n_e = size[e]
        fits = np.flatnonzero((n_e >= np.repeat(least[x], c)) & (n_e <= np.repeat(most[x], c)))
        e, t = e[fits].astype(np.int64), np.repeat(x, c)[fits]
        t0 = int(owner[begin])
        width = int(owner[stop - 1]) - t0 + 1
        code = (t - t0) * n_index + e
        if width * n_index <= 4 * len(code) + 1_000_000:
            hits = np.bincount(code)
            code = np.flatnonzero(hits)
            hits = hits[code]
        else:
            code.sort()
            edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            hits = np.diff(np.append(edge, len(code)))
            code = code[edge]
        good = hits >= need[code // n_index + t0]
        out_t.append(code[good] // n_index + t0)
        out_e.append(code[good] % n_index)
        begin = stop
    return np.concatenate(out_t), np.concatenate(out_e)


def pairs(train: list[str], evaluation: list[str], similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (i of train, j of evaluation, similarity, share of i in spans that occur in evaluation, longest match of i) of at least the similarity; texts in normal form, each list without repetitions."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64))
    if not train or not evaluation:
        return none
    index = RunIndex(evaluation)
    eh, eb = distinct_sorted(*grams(evaluation))
    sizes = np.fromiter(map(len, train), np.int64, len(train))
    chunk = np.cumsum(sizes) // BATCH
    found = []
    for c in np.unique(chunk):
        at = np.flatnonzero(chunk == c)
        some = [train[i] for i in at]
        t, e = _candidates(index, some, similarity, np.diff(eb))
        if not len(t):
            continue
        used, t_local = np.unique(t, return_inverse=True)
        th, tb = distinct_sorted(*grams([some[i] for i in used]))
        both = shared_counts(np.concatenate([eh, th]), np.concatenate([eb, len(eh) + tb[1:]]), t_local + len(evaluation), e)
        joint = np.diff(tb)[t_local] + np.diff(eb)[e] - both
        ok = np.flatnonzero(both >= similarity * joint - 1e-9)
        found.append((at[t[ok]], e[ok], both[ok] / joint[ok]))
    if not found:
        return none
    i, j, s = (np.concatenate(x) for x in zip(*found))
    # the matches of all texts that have a partner, as many at once as possible: a step costs about the same for few as for many
    matched, which = np.unique(i, return_inverse=True)
    covered, longest = np.zeros(len(matched), np.int64), np.zeros(len(matched), np.int64)
    chunk = np.cumsum(sizes[matched]) // (4 * BATCH)
    for c in np.unique(chunk):
        at = np.flatnonzero(chunk == c)
        covered[at], longest[at] = index.matches([train[k] for k in matched[at]])
    return i, j, s, (covered / np.maximum(sizes[matched], 1))[which], longest[which]


_PAIRS = "task bigint, a array<bigint>, b array<bigint>, similarity double, covered double, longest int"


def _group(table: pa.Table) -> pa.Table:
    schema = pa.schema([("task", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("similarity", pa.float64()), ("covered", pa.float64()), ("longest", pa.int32())])
    sides: list[dict[str, set]] = [{}, {}]
    for i, e, t in zip(table["id"].to_pylist(), table["ev"].to_pylist(), table["n"].to_pylist()):
        sides[e].setdefault(t, set()).add(i)
    train, evaluation = ([*x] for x in sides)
    i, j, s, covered, longest = pairs(train, evaluation)
    columns = [np.full(len(i), table["task"][0].as_py()) if len(i) else [], [sorted(sides[0][train[x]]) for x in i], [sorted(sides[1][evaluation[x]]) for x in j], s, covered, longest]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _class(size: np.ndarray) -> np.ndarray:
    """Class of a number of windows: up to NARROW, twice that, and so on."""
    return np.ceil(np.log2(np.maximum(size, NARROW) / NARROW)).astype(np.int64)


def _parities(h: np.ndarray, begin: np.ndarray, bits: int) -> np.ndarray:
    """Of each text, for each of `bits` cells, whether an odd number of its distinct windows fall there; one row of 64-bit words a text."""
    n = len(begin) - 1
    out = np.zeros((n, bits // 64), np.uint64)
    step = max(1, (1 << 22) // bits)
    for s in range(0, n, step):
        e = min(n, s + step)
        owner = np.repeat(np.arange(e - s), np.diff(begin[s : e + 1]))
        cell = owner * bits + (h[begin[s] : begin[e]] & np.uint64(bits - 1)).astype(np.int64)
        out[s:e] = np.packbits((np.bincount(cell, minlength=(e - s) * bits) & 1).astype(np.uint8).reshape(e - s, bits), axis=1).view(np.uint64)
    return out


def _sketches(similarity: float):
    """The parities of each text's windows, twice as many as its class has windows at most. Texts of evaluation are handed to each class that a partner may be in."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches(it, 2000):
            h, begin = distinct_sorted(*grams(t["n"].to_pylist()))
            size, ev = np.diff(begin), t["ev"].to_numpy()
            low = np.where(ev == 1, _class(np.ceil(similarity * size - 1e-9)), _class(size))
            high = np.where(ev == 1, _class(np.floor(size / similarity + 1e-9)), low)
            for k in range(int(low.min()), int(high.max()) + 1):
                some = np.flatnonzero((low <= k) & (k <= high))
                if not len(some):
                    continue
                count = size[some]
                at = np.concatenate([[0], np.cumsum(count)])
                words = _parities(h[np.arange(at[-1]) + np.repeat(begin[some] - at[:-1], count)], at, 2 * NARROW << k)
                width = words.shape[1] * 8
                sketch = pa.Array.from_buffers(pa.binary(width), len(some), [None, pa.py_buffer(words)]).cast(pa.binary())
                part = t.select(["task", "ev", "lot", "block", "id", "h", "shard"]).take(pa.array(some)).combine_chunks()
                yield from part.append_column("class", pa.array(np.full(len(some), k), pa.int32())).append_column("size", pa.array(count, pa.int32())).append_column("sketch", sketch).to_batches(max_chunksize=max(1, (1 << 23) // width))

    return run


def _alike(train: np.ndarray, n_train: np.ndarray, evaluation: np.ndarray, n_evaluation: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose parities allow the similarity: two sets that differ in d windows differ in d parities at most. Every pair that reaches it is among them."""
    # by size, so that the sizes which a partner may have are a stretch of rows
    order = np.argsort(n_evaluation, kind="stable")
    evaluation, n_evaluation = evaluation[order], n_evaluation[order].astype(np.int64)
    half = train.shape[1] // 2
    # the same parities over half as many cells are looked at first
    narrow = np.ascontiguousarray((evaluation[:, :half] ^ evaluation[:, half:]).T)
    folded = train[:, :half] ^ train[:, half:]
    first = np.searchsorted(n_evaluation, np.ceil(similarity * n_train - 1e-9))
    last = np.searchsorted(n_evaluation, np.floor(n_train / similarity + 1e-9), "right")
    words, counts, sums = (np.empty(min(STRIP, len(order)), t) for t in (np.uint64, np.uint8, np.uint16))
    out_t, out_e, known, limit = [], [], -1, None
    for i in np.argsort(n_train, kind="stable"):
        lo, hi = first[i], last[i]
        if hi <= lo:
            continue
        if n_train[i] != known:
            known = n_train[i]
            both = n_evaluation[lo:hi] + known
            limit = both - 2 * np.ceil(similarity / (1 + similarity) * both - 1e-6).astype(np.int64)
            limit = np.minimum(limit, 65_535).astype(np.uint16)
        x, y = folded[i], train[i]
        for s in range(lo, hi, STRIP):
            e = min(hi, s + STRIP)
            word, count, differ = words[: e - s], counts[: e - s], sums[: e - s]
            differ[:] = 0
            for w in range(half):
                np.bitwise_xor(narrow[w, s:e], x[w], out=word)
                np.bitwise_count(word, out=count)
                np.add(differ, count, out=differ)
            j = np.flatnonzero(differ <= limit[s - lo : e - lo])
            if len(j):
                j = j[np.bitwise_count(evaluation[s + j] ^ y).sum(1, dtype=np.int64) <= limit[s - lo + j]]
                out_t.append(np.full(len(j), i))
                out_e.append(order[s + j])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_t), np.concatenate(out_e)) if out_t else (none, none)


def _once(h: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of equal texts, and of each row which of these is its own; rows stay apart if a hash is shared by different sketches."""
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    return (first, which) if (sketch == sketch[first][which]).all() else (np.arange(len(h)), np.arange(len(h)))


def _shards(table: pa.Table, similarity: float) -> pa.Table:
    """(task, id, shard): the shards that hold a text which may be a partner of a train row."""
    schema = pa.schema([("task", pa.int64()), ("id", pa.int64()), ("shard", pa.int32())])
    side = table["ev"].to_numpy()
    rows, sketch, size, first, which = [], [], [], [], []
    for e in (0, 1):
        at = np.flatnonzero(side == e)
        if not len(at):
            return schema.empty_table()
        part = table.take(pa.array(at))
        words = np.frombuffer(b"".join(part["sketch"].to_pylist()), np.uint64).reshape(len(at), -1)
        f, w = _once(part["h"].to_numpy(), words)
        rows.append(part)
        sketch.append(words[f])
        size.append(part["size"].to_numpy()[f].astype(np.int64))
        first.append(f)
        which.append(w)
    i, j = _alike(sketch[0], size[0], sketch[1], size[1], similarity)
    if not len(i):
        return schema.empty_table()
    # texts to the shards of their copies, then pairs to (train text, shard)
    shard = rows[1]["shard"].to_numpy().astype(np.int64)
    n = int(shard.max()) + 1
    held = np.unique(which[1] * n + shard)
    begin, end = np.searchsorted(held, j * n), np.searchsorted(held, (j + 1) * n)
    c = end - begin
    goes = np.unique(np.repeat(i, c) * n + held[np.arange(c.sum()) + np.repeat(begin - _below(c), c)] % n)
    # and to the rows with the train text
    by = np.argsort(which[0], kind="stable")
    own = which[0][by]
    begin, end = np.searchsorted(own, goes // n), np.searchsorted(own, goes // n, "right")
    c = end - begin
    at = by[np.arange(c.sum()) + np.repeat(begin - _below(c), c)]
    return pa.Table.from_arrays([pa.array(np.full(len(at), table["task"][0].as_py()), pa.int64()), rows[0]["id"].combine_chunks().take(pa.array(at)), pa.array(np.repeat(goes % n, c), pa.int32())], schema=schema)


def _routed(rows: DataFrame, similarity: float) -> DataFrame:
    """(task, id, shard) of train rows: the shards that hold a text whose parities allow the similarity. rows: those of tasks with more than one shard."""
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = lambda n: F.pmod("h", F.col(n)).cast("int")
    # few large parts: only parities travel. Each block of train texts meets each lot of evaluation texts
    d = rows.withColumn("h", F.xxhash64("n")).withColumn("lot", F.when(F.col("ev") == 1, F.array(mine("lots"))).otherwise(every("lots"))).withColumn("block", F.when(F.col("ev") == 0, F.array(mine("wide"))).otherwise(every("wide")))
    names = "task bigint, ev int, lot array<int>, block array<int>, id bigint, h bigint, shard int, class int, size int, sketch binary"
    d = d.select("task", "ev", "lot", "block", "id", "h", "shard", "n").mapInArrow(_sketches(similarity), names)
    d = d.withColumn("lot", F.explode("lot")).withColumn("block", F.explode("block"))
    return d.groupBy("task", "class", "lot", "block").applyInArrow(lambda t: _shards(t, similarity), "task bigint, id bigint, shard int").distinct()


def matched(samples: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each pair of different or equal texts: task, a (ids of the train rows with the one), b (ids of the evaluation rows with the other), similarity, covered (share of the train text that occurs in
    the evaluation shard) and longest (its longest match there). A text's copies are listed once for each part that they were dealt to."""
    split = F.lower(F.trim("split"))
    side = samples.where("sample_id is not null and split is not null and text is not null and task_id is not null").select(F.col("sample_id").alias("id"), F.col("task_id").alias("task"), split.isin(*EVALUATION).cast("int").alias("ev"), split.alias("s"), "text").where("ev = 1 or s = 'train'")
    # characters as they are: no fewer than those of the normal form
    size = side.groupBy("task").agg(F.sum(F.when(F.col("ev") == 1, F.length("text"))).alias("e"), F.sum(F.when(F.col("ev") == 0, F.length("text"))).alias("t")).where("e > 0 and t > 0")
    size = cut(size.select("task", F.ceil(F.col("e") / SHARD).cast("int").alias("shards"), F.ceil(F.col("t") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("t") / WIDE).cast("int").alias("wide"), F.ceil(F.col("e") / LOT).cast("int").alias("lots")))
    rows = side.select("id", "task", "ev", normal_form(F.col("text")).alias("n")).where(f"length(n) >= {SHORTEST}")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)

    def dealt(some: DataFrame) -> DataFrame:
        """Evaluation rows of a shard to each of its blocks, train rows to one."""
        return some.withColumn("block", F.explode(F.when(F.col("ev") == 0, F.array(mine("blocks"))).otherwise(every("blocks")))).select("task", "shard", "block", "id", "ev", "n")

    # size is small for any number of tasks that AQE broadcasts; else it is joined by sorting, with AQE's splitting of skewed tasks
    parts = dealt(rows.join(size.where("shards = 1"), "task").withColumn("shard", F.lit(0)))
    large = size.where("shards > 1")
    if not large.isEmpty():
        big = cut(rows.join(large, "task").withColumn("shard", F.when(F.col("ev") == 1, mine("shards"))).drop("blocks", "shards"))
        sent = cut(big.where("ev = 0").drop("shard", "wide", "lots").join(_routed(big, similarity), ["task", "id"]).select("id", "task", "ev", "n", "shard"))
        blocks = sent.groupBy("task", "shard").agg(F.ceil(F.sum(F.length("n")) / BLOCK).cast("int").alias("blocks"))
        parts = parts.unionByName(dealt(sent.unionByName(big.where("ev = 1").select("id", "task", "ev", "n", "shard")).join(blocks, ["task", "shard"])))
    return parts.groupBy("task", "shard", "block").applyInArrow(lambda t: _group(t), _PAIRS)


def found(samples: DataFrame) -> DataFrame:
    """(sample_id_a, sample_id_b): all pairs of problem 1."""
    out = matched(samples).select(F.explode("a").alias("x"), "b").select("x", F.explode("b").alias("y"))
    return out.where("x <> y").select(F.least("x", "y").alias("sample_id_a"), F.greatest("x", "y").alias("sample_id_b"))


def report(samples: DataFrame, splits: DataFrame) -> DataFrame:
    """Per task, split (validation as val) and source of the evaluation rows: rows, rows with a partner in train, rows with an equal one, pairs, the mean share of the partners' text in spans of the evaluation
    texts and their longest match; beside the task's stratify. Counted from the texts' classes: copies are never laid out in pairs."""
    links = matched(samples).select("task", F.explode("b").alias("sample_id"), F.size("a").alias("k"), F.array_contains("a", F.col("sample_id")).cast("int").alias("self"), "similarity", "covered", "longest")
    links = links.withColumn("k", F.col("k") - F.col("self")).where("k > 0").groupBy("sample_id").agg(F.sum("k").alias("links"), F.max("similarity").alias("similarity"), F.max("covered").alias("covered"), F.max("longest").alias("longest"))
    ev = samples.where("split is not null").select("sample_id", "task_id", "source", F.lower(F.trim("split")).alias("split")).where(F.col("split").isin(*EVALUATION)).withColumn("split", F.when(F.col("split") == "validation", "val").otherwise(F.col("split")))
    per = ev.join(links, "sample_id", "left").groupBy("task_id", "split", "source")
    per = per.agg(F.count("*").alias("n_rows"), F.count("links").alias("n_overlapping"), F.coalesce(F.sum(F.when(F.col("similarity") >= 1 - 1e-12, 1)), F.lit(0)).cast("bigint").alias("n_exact"), F.coalesce(F.sum("links"), F.lit(0)).alias("n_pairs"), F.round(F.avg("covered"), 6).alias("mean_covered"), F.max("longest").alias("longest_match"))
    return per.join(splits.dropDuplicates(["task_id"]).select("task_id", "stratify"), "task_id", "left").withColumn("share", F.round(F.col("n_overlapping") / F.col("n_rows"), 6))
