"""Problem 7: encoding with a public byte-level BPE vocabulary.

Texts are split by the vocabulary's public pattern. Of each distinct piece of an Arrow batch that is no vocabulary
entry itself, the byte symbols are the leaves of a segment tree whose node holds the smallest (rank, position) of the
adjacent pairs below it. The root is thus the leftmost pair of lowest rank; merging it changes three leaves, each a
logarithmic update, until the root holds no pair. The trees of all pieces of about the same length are the rows of one
numpy array and are merged in step; where there are only a few of a length, each is a plain list.

An empty and a null text have the empty list; the result has one row for each input row, in no order; very long texts
need memory in proportion to the batch they are in. Lone surrogates, which Spark cannot hold, do not occur.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import spread

#: Where the vocabularies are, and their rank file. CACHE: pieces that a worker remembers. FEW: trees for which numpy does not pay.
TOKENIZERS, RANKS, CACHE, FEW = "/opt/tokenizers", "byte_bpe_50k.tiktoken", 400_000, 20
#: Fixed value: the split pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int64(1) << 62


class Encoder:
    """Ids of texts. A pair's rank is the id of its joint bytes."""

    def __init__(self, folder: str = TOKENIZERS, ranks: str = RANKS):
        with open(f"{folder}/{ranks}", "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.base = max(self.ids.values()) + 2
        pairs = {}
        for token, rank in self.ids.items():
            for k in range(1, len(token)):
                a, b = self.ids.get(token[:k]), self.ids.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs.keys(), np.uint64, len(pairs))
        # an open hash table: linear probes in an array four times as large
        self.bits = int(np.ceil(np.log2(4 * len(keys))))
        self.slot_key = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.slot_rank = np.full(1 << self.bits, NONE)
        values, at = np.fromiter(pairs.values(), np.int64, len(pairs)), self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.slot_key[at[left]] == np.uint64(2**64 - 1)
            _, first = np.unique(at[left], return_index=True)
            take = np.zeros(len(left), bool)
            take[first] = True
            put = left[free & take]
            self.slot_key[at[put]], self.slot_rank[at[put]] = keys[put], values[put]
            left = left[~(free & take)]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the pairs (a, b), NONE where there is none; a or b below 0 is no symbol."""
        keys = (a * self.base + b).astype(np.uint64)
        at = self._slot(keys)
        out = np.full(len(keys), NONE)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        while len(left):
            k = self.slot_key[at[left]]
            hit = k == keys[left]
            out[left[hit]] = self.slot_rank[at[left[hit]]]
            left = left[~hit & (k != np.uint64(2**64 - 1))]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        return out

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        n = len(piece)
        width, none, base, pairs = 1 << max(0, n - 1).bit_length(), int(NONE), self.base, self.pairs
        symbol, after, before = [int(self.byte[b]) for b in piece], list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = pairs.get(symbol[i] * base + symbol[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(leaf: int, rank: int | None) -> None:
            i = leaf + width
            tree[i] = none if rank is None else rank * width + leaf
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                a = a if a < b else b
                if tree[i] == a:
                    return
                tree[i] = a
                i >>= 1

        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            symbol[at], symbol[gone] = rank, -1
            following = after[gone]
            after[at] = following
            put(gone, None)
            if following < n:
                before[following] = at
                put(at, pairs.get(rank * base + symbol[following]))
            else:
                put(at, None)
            if (previous := before[at]) >= 0:
                put(previous, pairs.get(symbol[previous] * base + rank))
        return [x for x in symbol if x >= 0]

    def merge(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Ids of pieces of at most `width` bytes (a power of two)."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        column = np.arange(width)
        symbol = np.where(column < size[:, None], self.byte[raw], -1)
        after = np.tile(column + 1, (n, 1))  # the next living symbol; width or a dead end has no symbol
        before = np.tile(column - 1, (n, 1))
        tree = np.full((n, 2 * width), NONE)
        if width > 1:
            r = self.rank(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(n, width - 1)
            tree[:, width : 2 * width - 1] = np.where(r < NONE, r * width + column[:-1], NONE)
            for level in range(width.bit_length() - 2, -1, -1):
                lo = 1 << level
                tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            at, rank = root % width, root // width
            gone = after[live, at]
            symbol[live, at] = rank  # a merged pair's id is its rank
            symbol[live, gone] = -1
            following = after[live, gone]
            after[live, at] = following
            inside = following < width
            before[live[inside], following[inside]] = at[inside]
            right = np.where(inside, symbol[live, np.minimum(following, width - 1)], -1)
            previous = before[live, at]
            left = np.where(previous >= 0, symbol[live, np.maximum(previous, 0)], -1)
            r = self.rank(np.concatenate([left, rank]), np.concatenate([rank, right]))
            r0, r1 = r[: len(live)], r[len(live) :]
            self._put(tree, live, at, np.where(r1 < NONE, r1 * width + at, NONE), width)
            self._put(tree, live, gone, np.full(len(live), NONE), width)
            has = previous >= 0
            self._put(tree, live[has], previous[has], np.where(r0[has] < NONE, r0[has] * width + previous[has], NONE), width)
            live = live[tree[live, 1] < NONE]
        keep = symbol >= 0
        flat = symbol[keep].tolist()
        ends = np.cumsum(keep.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def _put(tree: np.ndarray, row: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
        node = leaf + width
        tree[row, node] = value
        while len(node) and node[0] > 1:
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of the pieces into `known`."""
        by: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode("utf-8", "surrogatepass")
            i = self.ids.get(b)
            if i is not None:
                self.known[p] = [i]
            else:
                by.setdefault(1 << (len(b) - 1).bit_length(), []).append((p, b))
        for width, some in by.items():
            if len(some) < FEW:
                for p, b in some:
                    self.known[p] = self.merge_one(b)
                continue
            step = max(1, 1_000_000 // width)
            for s in range(0, len(some), step):
                for (p, _), ids in zip(some[s : s + step], self.merge([b for _, b in some[s : s + step]], width)):
                    self.known[p] = ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        new = set().union(*split) - self.known.keys() if split else set()
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = set().union(*split)
        self.learn(new)
        known = self.known
        return [[i for p in pieces for i in known[p]] for pieces in split]


@functools.lru_cache(maxsize=2)
def encoder(folder: str, ranks: str) -> Encoder:
    """One for each worker process."""
    return Encoder(folder, ranks)


def blocks(texts: pa.Array, chars: int = 4_000_000) -> Iterator[list[str | None]]:
    """The texts in lists of about so many characters; a longer text is a list by itself."""
    held, n = [], 0
    for t in texts.to_pylist():
        held.append(t)
        n += len(t or "")
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


def ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """(doc_id, ids array<int>) for each row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, ranks)
        for batch in it:
            done = 0
            for texts in blocks(batch.column(1)):
                lists = e.encode(texts)
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(lists)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])
                done += len(lists)

    return spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), "doc_id").mapInArrow(run, "doc_id bigint, ids array<int>")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n bigint): the number of ids; the lists themselves never leave the worker."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, ranks)
        for batch in it:
            n = [len(x) for texts in blocks(batch.column(1)) for x in e.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n"])

    return spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), "doc_id").mapInArrow(run, "doc_id bigint, n bigint")
