"""Problem 8: filling containers of fixed capacity with documents, by best-two-fit.

Sizes are counted in tokens by problem 7's encoder; only ids and sizes are shuffled. The pieces are dealt by the hash of
their document and number to groups of about GROUP pieces, so that a huge document is spread, and each group is packed by itself: a group wastes at most the
rest of its last few containers. Pieces of exactly the capacity are containers by themselves and go to no group. Within a group only the stock of pieces of each size matters: a container is filled greedily with the
largest piece that fits; then its smallest piece is replaced with the two pieces in stock that fit the expanded gap
most tightly, as long as that leaves less room.

A document larger than the capacity is cut into pieces of exactly the capacity and a rest; no other is split. A
document without tokens (null or empty text) takes no room: it has one row without container. Repeated ids
are packed as separate documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed capacity in tokens, and pieces packed together.
CAPACITY, GROUP = 2048, 20_000


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The container (0, 1, ..) of each size; all sizes are 1 .. capacity."""
    order = np.argsort(sizes, kind="stable")
    stock = np.bincount(sizes, minlength=capacity + 1)
    ends = np.cumsum(stock)  # pieces of size s are order[ends[s] - stock[s] : ends[s]], used from the end
    #: below[x]: the largest size in stock of at most x, 0 if none; kept up to date as sizes run out
    values = np.arange(capacity + 1)
    below = np.maximum.accumulate(np.where(stock > 0, values, 0))
    out = np.full(len(sizes), -1, np.int64)

    def take(s: int) -> None:
        stock[s] -= 1
        if stock[s] == 0:
            k = s
            to = below[s - 1]
            while k <= capacity and below[k] == s:
                k += 1
            below[s:k] = to

    def give(s: int) -> None:
        stock[s] += 1
        if stock[s] == 1:
            part = below[s:]
            part[part < s] = s

    def fill(gap: int, inside: list[int]) -> int:
        while gap and (s := int(below[gap])):
            take(s)
            inside.append(s)
            gap -= s
        return gap

    box, left = 0, len(sizes)
    while left:
        inside: list[int] = []
        gap = fill(capacity, inside)
        while gap and len(inside) > 1:
            least = min(inside)
            room = gap + least
            first = np.flatnonzero(stock[: room // 2 + 1])  # the smaller of the two
            if not len(first):
                break
            second = below[room - first]
            ok = (second > first) | ((second == first) & (stock[first] > 1))
            total = np.where(ok, first + second, 0)
            k = int(np.argmax(total))
            if total[k] <= least:
                break
            a, b = int(first[k]), int(second[k])
            take(a)
            take(b)
            give(least)
            inside.remove(least)
            inside += [a, b]
            gap = room - a - b
        for s in inside:
            ends[s] -= 1
            out[order[ends[s]]] = box
        left -= len(inside)
        box += 1
    return out


def packed(sizes: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """From (doc_id, n): one row for each piece: container, doc_id, piece_no (from 1), first_token, n_tokens, fill (tokens in the container)."""
    from .base import cut

    n = cut(sizes)
    has = n.where("n > 0")
    pieces = has.select("doc_id", F.posexplode(F.expr(f"transform(sequence(0, CAST((n - 1) DIV {capacity} AS INT)), k -> CAST(least({capacity}, n - k * {capacity}) AS INT))")).alias("k", "n_tokens"))
    whole = pieces.where(F.col("n_tokens") == capacity).select(F.concat(F.lit("full-"), F.monotonically_increasing_id()).alias("container"), "doc_id", (F.col("k") + 1).alias("piece_no"), (F.col("k").cast("bigint") * capacity).alias("first_token"), "n_tokens", F.lit(capacity).cast("bigint").alias("fill"))
    rest = pieces.where(F.col("n_tokens") < capacity)
    # the number of groups is one row: each document has at most one piece below the capacity
    count = has.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / group)).cast("bigint").alias("g"))
    dealt = rest.crossJoin(F.broadcast(count)).withColumn("grp", F.pmod(F.xxhash64("doc_id", "k", "n_tokens"), "g"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "k"], kind="stable")
        box = pack(pdf["n_tokens"].to_numpy(), capacity)
        fill = np.bincount(box, weights=pdf["n_tokens"]).astype(np.int64)
        return pd.DataFrame({"container": [f"{key[0]}-{b}" for b in box], "doc_id": pdf["doc_id"].to_numpy(), "piece_no": pdf["k"].to_numpy() + 1, "first_token": pdf["k"].to_numpy().astype(np.int64) * capacity, "n_tokens": pdf["n_tokens"].to_numpy(), "fill": fill[box]})

    schema = "container string, doc_id bigint, piece_no int, first_token bigint, n_tokens int, fill bigint"
    out = dealt.groupBy("grp").applyInPandas(run, schema)
    none = n.where("n = 0").select(F.lit(None).cast("string").alias("container"), "doc_id", F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("first_token"), F.lit(0).alias("n_tokens"), F.lit(None).cast("bigint").alias("fill"))
    return out.unionByName(whole).unionByName(none)


def containers(sizes: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """One row for each container: n_pieces, fill, free, and its pieces as doc_id:piece_no, in order."""
    p = packed(sizes, capacity, group).where("container is not null")
    return p.groupBy("container").agg(F.count("*").alias("n_pieces"), F.max("fill").alias("fill"), (F.lit(capacity) - F.max("fill")).alias("free"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "piece_no"))), lambda x: F.concat_ws(":", x["doc_id"], x["piece_no"])), ",").alias("pieces"))
