"""Multinomial logistic regression on soft labels: rows keep their probabilities, they are not repeated for each label.

The loss of a row is log(sum(exp(m))) - q m, with margins m = x B + c and probabilities q. The second part is linear in B and c: its sum over all rows (x' q) is
taken once, and each step of the optimizer needs one pass over x alone. Features are scaled by their deviation for the penalty and centred, as Spark's own regression does.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.tables import cut

#: Texts of a block, rows of features in a slice of sums, and the most tasks whose sums are added by the driver.
BLOCK, SLICE, DIRECT = 64, 2048, 32


def _slices(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A matrix by SLICE rows, in single precision: it is the sum of one task only."""
    at = range(0, len(sums), SLICE)
    yield pa.RecordBatch.from_arrays([pa.array([i // SLICE for i in at], pa.int32()), pa.array([sums[i : i + SLICE].astype(np.float32).tobytes() for i in at], pa.binary())], ["slice", "sums"])


def _added(parts: DataFrame, rows: int, width: int, tasks: int) -> np.ndarray:
    """The sum of the matrices of all tasks. Those of few tasks go to the driver as they are; of many, each slice is added up by one task."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in t["sums"].to_pylist())
        return pa.table({"slice": t["slice"][:1].combine_chunks(), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    if tasks > DIRECT:
        parts = parts.groupBy("slice").applyInArrow(add, "slice int, sums binary")
    got, out = parts.toArrow(), np.zeros((rows, width))
    for i, x in zip(got["slice"].to_pylist(), got["sums"]):
        some = np.frombuffer(x.as_buffer(), np.float32).reshape(-1, width)
        out[i * SLICE : i * SLICE + len(some)] += some
    return out


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts: their numbers of features, the features they have, places among those and values, and the probabilities if there are any."""
    for b in it:
        if not b.num_rows:
            continue
        count = b["indices"].value_lengths().to_numpy(zero_copy_only=False)
        # texts that share their frequent features share a block, so that its table is small
        of = np.repeat(np.arange(b.num_rows), count)
        index = b["indices"].flatten().to_numpy()
        code = np.zeros(b.num_rows, np.int64)
        for place, f in enumerate(np.argsort(-np.bincount(index, minlength=1), kind="stable")[:40]):
            code[of[index == f]] |= 1 << (40 - place)
        b = b.take(pa.array(np.argsort(code, kind="stable")))
        count = b["indices"].value_lengths().to_numpy(zero_copy_only=False)
        begin = np.concatenate([[0], np.cumsum(count)])
        index, value = b["indices"].flatten().to_numpy(), b["values"].flatten().to_numpy().astype(np.float32)
        q = [b["q"].flatten().to_numpy().reshape(b.num_rows, -1)] if "q" in b.schema.names else []
        out = []
        for s in range(0, b.num_rows, BLOCK):
            e = min(b.num_rows, s + BLOCK)
            used, column = np.unique(index[begin[s] : begin[e]], return_inverse=True)
            out.append([count[s:e].astype(np.int32), used.astype(np.int32), column.astype(np.uint16 if len(used) < 1 << 16 else np.uint32), value[begin[s] : begin[e]], *(x[s:e] for x in q)])
        names = ["count", "used", "at", "value", "q"][: len(out[0])]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in c], pa.binary()) for c in zip(*out)], names)


def _tables(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each block, its features, its texts by them, and their probabilities as bytes, if they were read."""
    for b in it:
        for count, used, at, value, *q in zip(*(b[c].to_pylist() for c in b.schema.names)):
            count, used, value = np.frombuffer(count, np.int32), np.frombuffer(used, np.int32), np.frombuffer(value, np.float32)
            x = np.zeros((len(count), len(used)), np.float32)
            x[np.repeat(np.arange(len(count)), count), np.frombuffer(at, np.uint16 if len(used) < 1 << 16 else np.uint32)] = value
            yield used, x, *q


def _moments(width: int, k: int):
    """Sums over a task's texts: for each feature x' q, x and x x; in the last row q, the number of texts and 0."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width + 1, k + 2))
        for used, x, q in _tables(_blocks(it)):
            q = np.frombuffer(q, np.float64).reshape(len(x), k)
            sums[used, :k] += x.T.astype(np.float64) @ q
            sums[used, k] += x.sum(0, dtype=np.float64)
            sums[used, k + 1] += np.square(x, dtype=np.float64).sum(0)
            sums[width, :k] += q.sum(0)
            sums[width, k] += len(x)
        yield from _slices(sums)

    return run


def _expected(shared, width: int, k: int):
    """Sums over a task's texts at the coefficients and intercepts: x' p and 0; in the last row p and the log of the sum of exponents."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.frombuffer(shared.value, np.float64).reshape(width + 1, k)
        b, c = at[:width].astype(np.float32), at[width]
        sums = np.zeros((width + 1, k + 1))
        for used, x in _tables(it):
            m = x @ b[used] + c
            top = m.max(1, keepdims=True)
            p = np.exp(m - top)
            total = p.sum(1, keepdims=True)
            p /= total
            sums[used, :k] += x.T @ p.astype(np.float32)
            sums[width, :k] += p.sum(0)
            sums[width, k] += (np.log(total) + top).sum()
        yield from _slices(sums)

    return run


def _minimum(f, x: np.ndarray, steps: int, tolerance: float, memory: int = 10) -> np.ndarray:
    """L-BFGS with a weak Wolfe search. f gives value and gradient."""
    value, g = f(x)
    kept: list[tuple[np.ndarray, np.ndarray, float]] = []
    for step in range(steps):
        d, a = -g, []
        for s, y, r in reversed(kept):
            a.append(r * (s @ d))
            d = d - a[-1] * y
        if kept:
            s, y, r = kept[-1]
            d *= 1 / (r * np.square(y, dtype=np.float64).sum())
        for (s, y, r), i in zip(kept, reversed(a)):
            d += s * (i - r * (y @ d))
        slope = g @ d
        if slope >= 0 or not np.any(g):
            break
        t, low, high = (1.0 if kept else 1 / np.linalg.norm(g)), 0.0, None
        for _ in range(12):
            new, h = f(x + t * d)
            if not new <= value + 1e-4 * t * slope:
                high = t
            elif h @ d < 0.9 * slope:
                low = t
            else:
                break
            t = (low + high) / 2 if high is not None else 4 * t
        if not new < value:
            break
        s, y = t * d, h - g
        if s @ y > 0:
            kept = [*kept[1 - memory :], (s.astype(np.float32), y.astype(np.float32), 1 / (s @ y))]
        x, before, value, g = x + s, value, new, h
        if before - value <= tolerance * max(abs(before), abs(value), 1e-6):
            break
    return x


def fit(rows: DataFrame, q: str, features: str = "features", steps: int = 20, penalty: float = 0.001, tolerance: float = 1e-6):
    """A LogisticRegressionModel of the rows' sparse vectors (of one size) and probabilities (arrays of one size that add up to 1). Rows where either is null are left out; a table without rows is an error."""
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.common import _py2java
    from pyspark.ml.linalg import DenseMatrix, Vectors

    spark = rows.sparkSession
    sc = spark.sparkContext
    d = rows.where(F.col(features).isNotNull() & F.col(q).isNotNull())
    one = d.select(features, q).first()
    if one is None:
        raise ValueError("no rows to learn from")
    width, k = one[0].size, len(one[1])
    plain = d.select(F.unwrap_udt(features).alias("x"), F.col(q).cast("array<double>").alias("q")).select("x.indices", "x.values", "q")
    # a task holds one matrix of sums: no more tasks than two for each core
    tasks = 2 * sc.defaultParallelism
    x = cut(plain.drop("q").mapInArrow(_blocks, "count binary, used binary, at binary, value binary")).coalesce(tasks)
    tasks = x._jdf.queryExecution().toRdd().getNumPartitions()
    sums = _added(plain.coalesce(tasks).mapInArrow(_moments(width, k), "slice int, sums binary"), width + 1, k + 2, tasks)
    xq, n, wanted = sums[:width, :k], sums[width, k], sums[width, :k]
    mean = sums[:width, k] / n
    deviation = np.sqrt(np.maximum(sums[:width, k + 1] - n * mean * mean, 0) / max(n - 1, 1))
    scale = np.where(deviation > 1e-12, 1 / np.maximum(deviation, 1e-12), 0.0)[:, None]

    def coefficients(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = at[: width * k].reshape(width, k) * scale
        return b, at[width * k :] - mean @ b

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        b, c = coefficients(at)
        shared = sc.broadcast(np.concatenate([b.ravel(), c]).tobytes())
        got = _added(x.mapInArrow(_expected(shared, width, k), "slice int, sums binary"), width + 1, k + 1, tasks)
        shared.unpersist()
        over = got[width, :k] - wanted
        g = (got[:width, :k] - xq - np.outer(mean, over)) * scale / n + penalty * at[: width * k].reshape(width, k)
        value = (got[width, k] - (b * xq).sum() - c @ wanted) / n + penalty / 2 * np.square(at[: width * k]).sum()
        return value, np.concatenate([g.ravel(), over / n])

    start = np.log1p(wanted)
    b, c = coefficients(_minimum(loss, np.concatenate([np.zeros(width * k), start - start.mean()]), steps, tolerance))
    uid = f"SoftRegression_{uuid.uuid4().hex[:12]}"
    made = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(uid, _py2java(sc, DenseMatrix(k, width, b.ravel(), False)), _py2java(sc, Vectors.dense(c - c.mean())), k, True)
    model = LogisticRegressionModel(made)
    model._resetUid(uid)
    return model.setFeaturesCol(features)
