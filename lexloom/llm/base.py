"""What the text operators share: reading, spreading work, cutting lineage, n-gram arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.tables import cut, shared_dir  # noqa: F401

#: Longest window of the similarity that the pair queries use, in code points, and the shortest normal form that may be in a pair.
GRAM, SHORTEST = 5, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df over at least two tasks for each core. Files that are already split finely stay where they are; otherwise rows go by the hash of `by`, so that a lost task is repeated alike."""
    spark = df.sparkSession
    want = max(2 * spark.sparkContext.defaultParallelism, 8)
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if have >= spark.sparkContext.defaultParallelism else df.repartition(want, *by)


def normal_form(text: Column) -> Column:
    """Lower case; each run of characters that are no letters, marks or numbers becomes one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts one after another, and where each text begins (with the end as last)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(lengths)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor-shift), in place where possible."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def grams(texts: list[str], n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all windows of n code points, text after text, and each text's first window (with the end as last). Shorter texts have none."""
    points, at = code_points(texts)
    if len(points) < n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    m = len(points) - n + 1
    h = points[:m].astype(np.uint64)
    for k in range(1, n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += points[k : k + m]
    h = mix(h)
    count = np.maximum(np.diff(at) - n + 1, 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    # the windows of text t start at at[t] .. at[t] + count[t] - 1
    index = np.arange(begin[-1]) + np.repeat(at[:-1] - begin[:-1], count)
    return h[index], begin


#: Bits of a window's hash that are kept beside the number of its text or pair: of 1,000 windows two are equal by chance with odds below 10^-7.
KEPT = np.uint64(44)


def distinct_sorted(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes (of KEPT bits) in ascending order, laid out as grams() does. Fewer than 2^20 texts."""
    n = len(begin) - 1
    assert n < 1 << 20
    k = np.repeat(np.arange(n, dtype=np.uint64) << KEPT, np.diff(begin)) | (h >> (np.uint64(64) - KEPT))
    k.sort()
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    k = k[new]
    return k & ((np.uint64(1) << KEPT) - np.uint64(1)), np.searchsorted(k, np.arange(n + 1, dtype=np.uint64) << KEPT)


def shared_counts(h: np.ndarray, begin: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 10_000) -> np.ndarray:
    """How many hashes the texts a[i] and b[i] share; the sets are laid out as distinct_sorted() gives them."""
    out = np.zeros(len(a), np.int64)
    size = np.diff(begin)
    for s in range(0, len(a), block):
        x = np.stack([a[s : s + block], b[s : s + block]], 1).ravel()
        c = size[x]
        index = np.arange(c.sum()) + np.repeat(begin[x] - (np.cumsum(c) - c), c)
        k = np.repeat(np.arange(len(x), dtype=np.uint64) >> np.uint64(1) << KEPT, c) | h[index]
        k.sort()
        same = k[1:][k[1:] == k[:-1]] >> KEPT
        out[s : s + block] = np.bincount(same.astype(np.int64), minlength=len(x) // 2)
    return out


def batches(it: Iterator, rows: int) -> Iterator:
    """Arrow record batches joined to tables of at least `rows` rows (the last may be smaller)."""
    import pyarrow as pa

    held, n = [], 0
    for b in it:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)
