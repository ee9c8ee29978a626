"""Problem 2: near-duplicate records, by a multi-index join over b-bit signatures.

A text's signature has PARTS x WIDTH components of b = 8 bits, each from a minwise hash of its 5-character windows; the
distance of two signatures is the number of components that differ. The signature is split into PARTS chunks of
WIDTH components. If at most PARTS * (ERRORS + 1) - 1 = 15 components differ, some chunk has at most ERRORS = 1 differing one
(pigeonhole), so each chunk is entered once for each place where the allowed error may be, with that component left out:
all pairs within distance 15 meet in some entry, and most of those farther off too. At a similarity of exactly 0.8 a pair
is missed with odds of 0.1 %, at 0.85 with 0.004 %. Pairs that meet are compared by size, then by the whole signature, then exactly.

Equal normal forms are collapsed first, so copies meet no one; classes are joined with their members at the end. Entries are
packed on the map side, many to a row, and dealt by key to buckets of bounded size; a key of very many entries is split into lots that meet in many tasks.

Null texts and texts of fewer than 20 characters in normal form are in no pair; rows with the same id count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import GRAM, SHORTEST, batches, cut, distinct_sorted, grams, mix, normal_form, shared_counts, spread

PARTS, WIDTH, ERRORS = 8, 7, 1
SIMILARITY = 0.8
#: Signatures that differ in more components are not compared exactly: five standard deviations beyond the mean at 0.8.
FAR = 28
#: Entries of a bucket, texts packed at once, and pairs handed on at once.
BUCKET, TEXTS, PAIRS = 2_000_000, 40_000, 500_000
#: Entries of one key from which it is split, of a lot that is met at once, and tasks that a hot key is spread over at least.
HOT, LOT, SALT = 4000, 2000, 16
K = PARTS * WIDTH
_factors = mix(np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One row of K bytes for each text, and the number of its distinct windows. Texts of fewer than GRAM characters have zeros."""
    h, begin = grams(texts)
    out = np.zeros((len(texts), K), np.uint8)
    d, db = distinct_sorted(h, begin)
    size = np.diff(db)
    has = np.flatnonzero(size)
    if not len(has):
        return out, size
    x = (d >> np.uint64(12)).astype(np.uint32)
    y = np.empty_like(x)
    for k in range(K):
        np.multiply(x, _factors[k], out=y)
        low = np.minimum.reduceat(y, db[:-1][has])
        low = (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[has, k] = (low ^ (low >> np.uint32(12))) >> np.uint32(24)
    return out, size


def entries(sig: np.ndarray) -> np.ndarray:
    """Keys of the signatures, one row each: for each chunk and each component left out of it."""
    n = len(sig)
    out = np.empty((n, K), np.uint64)
    for c in range(PARTS):
        chunk = sig[:, c * WIDTH : (c + 1) * WIDTH].astype(np.uint64)
        for p in range(WIDTH):
            k = np.full(n, np.uint64(c * WIDTH + p + 1))
            for j in range(WIDTH):
                if j != p:
                    k = (k << np.uint64(8)) | chunk[:, j]
            out[:, c * WIDTH + p] = mix(k)
    return out


def _sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for t in batches(it, 4000):
        texts = t["n"].to_pylist()
        sig, size = signatures(texts)
        yield pa.RecordBatch.from_arrays([t["id"].combine_chunks(), pa.array([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in texts], pa.binary()), pa.array(size.astype(np.int32)), pa.array([r.tobytes() for r in sig], pa.binary())], ["id", "h", "size", "sig"])


def signed(samples: DataFrame, id_col: str = "sample_id", text_col: str = "text") -> DataFrame:
    """(id, h, size, sig) of the rows that may be in a pair; h: 128 bits of the normal form."""
    rows = samples.select(F.col(id_col).cast("bigint").alias("id"), normal_form(F.col(text_col)).alias("n")).where(f"id is not null and length(n) >= {SHORTEST}")
    return spread(rows, "id").mapInArrow(_sign, "id bigint, h binary, size int, sig binary")


def _packer(bits: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches(it, TEXTS):
            ids = t["id"].to_numpy()
            order = np.argsort(ids)
            ids = ids[order]
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, K)[order]
            size = np.minimum(t["size"].to_numpy()[order], 65535).astype(np.uint16)
            key = entries(sig).ravel()
            who = np.repeat(np.arange(len(ids)), K)
            bucket = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
            by = np.argsort(bucket, kind="stable")
            where, edge = np.unique(bucket[by], return_index=True)  # those that hold an entry
            blobs = []
            for a, b in zip(edge, [*edge[1:], len(by)]):
                x = by[a:b]
                i = ids[who[x]]
                raw = (key[x] >> np.uint64(20)).astype(np.uint32).tobytes() + np.diff(i, prepend=0).astype(np.int64).tobytes() + size[who[x]].tobytes()
                blobs.append(len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def _meet(key: np.ndarray, ids: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one bucket with equal keys and sizes that allow the similarity; each pair once, as far as PAIRS go."""
    order = np.lexsort((size, key))
    key, ids, size = key[order], ids[order], size[order]
    at = np.arange(len(key) - 1)
    at = at[key[1:] == key[:-1]]
    held, n, d = [], 0, 1
    while len(at):
        # sizes ascend within a key: once the d-th follower is too large, so are the later ones
        at = at[at + d < len(key)]
        at = at[(key[at + d] == key[at]) & (size[at] >= SIMILARITY * size[at + d] - 1e-9)] if len(at) else at
        for s in range(0, len(at), PAIRS):
            x, y = ids[at[s : s + PAIRS]], ids[at[s : s + PAIRS] + d]
            held.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y])
            n += len(held[-1])
            if n >= PAIRS:
                p = np.unique(np.concatenate(held), axis=0)
                yield p[:, 0], p[:, 1]
                held, n = [], 0
        d += 1
    if n:
        p = np.unique(np.concatenate(held), axis=0)
        yield p[:, 0], p[:, 1]


_MET = "a bigint, b bigint, lo int, hi int, run binary"


def _hot(bucket: int, key: np.ndarray, ids: np.ndarray, size: np.ndarray, most: int = HOT, per: int = LOT) -> tuple[np.ndarray, list[tuple]]:
    """Which entries have a key of more than `most` entries, and those entries in lots of `per` by size: (key, number of the lot, smallest and largest size, ids and sizes)."""
    _, which, n = np.unique(key, return_inverse=True, return_counts=True)
    hot = n[which] > most
    lots = []
    for k in np.unique(which[hot]):
        x = np.flatnonzero(which == k)
        x = x[np.argsort(size[x], kind="stable")]
        for j, s in enumerate(range(0, len(x), per)):
            y = x[s : s + per]
            lots.append(((bucket << 32) | int(key[y[0]]), j, int(size[y[0]]), int(size[y[-1]]), ids[y].astype(np.int64).tobytes() + size[y].astype(np.uint16).tobytes()))
    return hot, lots


def _lots(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of two lots of one key whose sizes allow the similarity; of a lot with itself, each once."""
    for batch in it:
        for j, k, x, y in zip(*(batch.column(c).to_pylist() for c in ("j", "k", "x", "y"))):
            parts = []
            for raw in (x, y):
                n = len(raw) // 10
                parts.append((np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint16, n, 8 * n).astype(np.int64)))
            (xi, xs), (yi, ys) = parts
            fits = (np.minimum(xs[:, None], ys) >= SIMILARITY * np.maximum(xs[:, None], ys) - 1e-9) & (xi[:, None] != yi)
            p, q = np.nonzero(np.triu(fits, 1) if j == k else fits)
            for s in range(0, len(p), PAIRS):
                a, b = xi[p[s : s + PAIRS]], yi[q[s : s + PAIRS]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _split(met: DataFrame) -> DataFrame:
    """The pairs of hot keys: their lots meet by Spark, one side salted and the other sent to each salt, so that no task holds a key."""
    lots = met.where("run is not null")
    left = lots.select(F.col("a").alias("key"), F.col("b").alias("j"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"), F.col("run").alias("x"), F.pmod("b", F.lit(SALT)).alias("salt"))
    right = lots.select(F.col("a").alias("key"), F.col("b").alias("k"), F.col("lo").alias("lo_k"), F.col("run").alias("y"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))).alias("salt"))
    both = left.join(right, ["key", "salt"]).where(f"j <= k and hi_j >= {SIMILARITY} * lo_k - 1e-9")  # lots follow each other by size
    return both.select("j", "k", "x", "y").repartition("j", "k", "x").mapInArrow(_lots, "a bigint, b bigint")


def _matcher(most: int, per: int):
    """Pairs of the buckets' keys. Rows of a bucket follow one another; keys of more than `most` entries are handed on as lots."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("run", pa.binary())])

        def close(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            keys, ids, sizes = [], [], []
            for b in blobs:
                raw = pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)
                n = len(raw) // 14
                keys.append(np.frombuffer(raw, np.uint32, n))
                ids.append(np.cumsum(np.frombuffer(raw, np.int64, n, 4 * n)))
                sizes.append(np.frombuffer(raw, np.uint16, n, 12 * n))
            key, i, size = np.concatenate(keys), np.concatenate(ids), np.concatenate(sizes)
            hot, lots = _hot(bucket, key, i, size, most, per)
            for lot in lots:
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(lot, schema)], schema=schema)
            for a, b in _meet(key[~hot], i[~hot], size[~hot]):
                none = pa.nulls(len(a), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none, pa.nulls(len(a), pa.binary())], schema=schema)

        now, blobs = None, []
        for batch in it:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != now and blobs:
                    yield from close(now, blobs)
                    blobs = []
                now = b
                blobs.append(blob)
        if blobs:
            yield from close(now, blobs)

    return run


def _near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, K) for c in (2, 3))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array((x != y).sum(1) <= FAR))


def _exact(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches(it, 3000):
        a, b = t["na"].to_pylist(), t["nb"].to_pylist()
        place: dict[str, int] = {}
        i = np.array([place.setdefault(x, len(place)) for x in a], np.int64)
        j = np.array([place.setdefault(x, len(place)) for x in b], np.int64)
        h, begin = distinct_sorted(*grams(list(place)))
        both = shared_counts(h, begin, i, j)
        joint = np.diff(begin)[i] + np.diff(begin)[j] - both
        ok = pa.array(both >= SIMILARITY * joint - 1e-9)
        yield from pa.Table.from_arrays([t["a"], t["b"], pa.chunked_array([pa.array(both / joint)])], ["a", "b", "similarity"]).filter(ok).to_batches()


def classes(keys: DataFrame) -> DataFrame:
    """(id, rep) from signed(): rep is the smallest id of the same normal form."""
    reps = keys.groupBy("h").agg(F.min("id").alias("rep"))
    return keys.select("id", "h").join(reps, "h").select("id", "rep").distinct()


def linked(keys: DataFrame, samples: DataFrame, id_col: str = "sample_id", text_col: str = "text") -> DataFrame:
    """(a, b, similarity): all similar pairs a < b of representatives of different normal forms. keys: signed(), cut."""
    spark = keys.sparkSession
    reps = cut(keys.groupBy("h").agg(F.min(F.struct("id", "size", "sig")).alias("x")).select("x.*"))
    n = reps.count()  # from the files' footers
    bits = max(0, int(np.ceil(np.log2(max(1, n * K) / BUCKET))))
    packed = reps.mapInArrow(_packer(bits), "bucket int, blob binary")
    tasks = max(1, min(1 << bits, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    met = packed.repartition(max(tasks, min(1 << bits, spark.sparkContext.defaultParallelism)), "bucket").sortWithinPartitions("bucket").mapInArrow(_matcher(HOT, LOT), _MET)
    met = cut(met)
    pairs = met.where("run is null").select("a", "b")
    if not met.where("run is not null").isEmpty():
        pairs = pairs.unionAll(_split(met))
    met = pairs.distinct()
    sig = reps.select("id", "sig")
    met = met.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    near = cut(met.mapInArrow(_near, "a bigint, b bigint"))
    ids = near.select(F.col("a").alias("id")).unionAll(near.select("b")).distinct()
    text = samples.select(F.col(id_col).cast("bigint").alias("id"), text_col).join(ids, "id", "left_semi").select("id", normal_form(F.col(text_col)).alias("n")).dropDuplicates(["id"])
    both = near.join(text.toDF("a", "na"), "a").join(text.toDF("b", "nb"), "b").select("a", "b", "na", "nb")
    return both.mapInArrow(_exact, "a bigint, b bigint, similarity double")


def found(samples: DataFrame) -> DataFrame:
    """(sample_id_a, sample_id_b): all pairs a < b of similarity 0.8 or more, equal texts included."""
    keys = cut(signed(samples))
    links = cut(linked(keys, samples))
    member = cut(classes(keys))
    x = member.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    y = member.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = links.select("a", "b").join(x, "a").join(y, "b").select(F.least("x", "y").alias("sample_id_a"), F.greatest("x", "y").alias("sample_id_b")).where("sample_id_a < sample_id_b")
    many = member.where("id <> rep")
    # equal texts: each member but the representative with the representative, and with the members that follow it
    within = many.select("rep", "id").unionAll(many.select("rep", F.col("rep").alias("id")).distinct())
    equal = within.toDF("a", "sample_id_a").join(within.toDF("a", "sample_id_b"), "a").where("sample_id_a < sample_id_b").select("sample_id_a", "sample_id_b")
    return across.unionAll(equal)


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, grp) for the ids of the links (a, b): grp is the smallest id of the connected component. Labels double their reach each round; nothing is gathered on the driver but whether a round changed any."""
    edges = cut(links.select("a", "b").unionAll(links.select("b", "a")).distinct())
    label = cut(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("grp")))
    for _ in range(rounds):
        near = edges.join(label.toDF("b", "grp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("grp").alias("near"))
        step = label.join(near, "id").select("id", F.col("grp").alias("old"), F.least("grp", "near").alias("grp"))
        jump = step.join(label.toDF("grp", "far"), "grp", "left").select("id", "old", F.least("grp", F.coalesce("far", "grp")).alias("grp"))
        new = cut(jump)
        label = new.select("id", "grp")
        if new.where("old <> grp").isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def groups(samples: DataFrame) -> DataFrame:
    """One row for each record that may be in a pair: sample_id, grp (smallest id of its group of similar records), n_links (similar other texts of its class), n_copies (equal texts), and the number of labels in its group."""
    keys = cut(signed(samples))
    links = cut(linked(keys, samples))
    member = cut(classes(keys))
    label = components(links)
    degree = links.select(F.col("a").alias("rep")).unionAll(links.select("b")).groupBy("rep").agg(F.count("*").alias("n_links"))
    copies = member.groupBy("rep").agg(F.count("*").alias("n_copies"))
    per = copies.join(degree, "rep", "left").join(label.withColumnRenamed("id", "rep"), "rep", "left").select("rep", F.coalesce("grp", "rep").alias("grp"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "n_copies")
    rows = member.join(per, "rep").join(samples.select(F.col("sample_id").alias("id"), F.lower(F.trim("label")).alias("label")), "id")
    rows = cut(rows)
    labels = rows.groupBy("grp").agg(F.count_distinct("label").alias("n_labels"))
    return rows.join(labels, "grp").select(F.col("id").alias("sample_id"), "grp", "n_links", "n_copies", "n_labels").distinct()
