"""Embedding whitening (11): a bidiagonal qd solver.

Vectors are put on an integer grid and every distinct one counts once. Each task folds its centred
rows, block by block, into one triangular matrix by QR; these matrices are folded in rounds of
``FOLD`` until one is left, as wide as a vector. Its singular values and vectors (``qd``: Householder
bidiagonalisation, dqds, twisted factorisations) are those of the centred table, so the covariance
is never formed and small components keep their digits. All rows are then projected where they lie.

What is collected or sent to tasks has the size of one vector, one triangle or the chosen
components, never of the table. Sums are exact at any size: they are integers.

Edge cases: rows whose vector is null, or holds a null or a non-finite entry, are left out; so are
vectors without entries and those of another length than the most frequent one (of equally frequent
ones the longest). Null ids and repeated rows are kept, each row gets its components. Components that
the fit cannot tell from zero (one distinct vector, fewer vectors than dimensions, a constant
dimension) do not exist and give no rows; equal variances give orthogonal components in any
rotation. A deviation beyond a long is null. An empty table gives no rows. Other columns are never
read.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from korvane.session import materialize

from . import qd

MOST = 16
STEPS, SHIFT = 64, 1_000_000       # the grid
FOLD = 64                          # matrices folded by one task in one round
BLOCK = 1024                       # rows of a QR block


def on_grid(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS).cast("long") + SHIFT)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def grid_rows(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the rows that count."""
    rows = table.filter(usable(F.col(vec_col))).select(F.col(id_col).alias("id"),
                                                       on_grid(F.col(vec_col)).alias("x"))
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == (length[0] if length else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


@dataclass(frozen=True)
class Moments:
    """Number of distinct vectors, their sums and their largest size per dimension, as integers."""
    n: int
    sums: list
    largest: int

    def offset(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``: exact, in Python integers where a long could not hold it."""
        small = 2 * self.n * self.largest < 1 << 62
        return self.n * x - np.array(self.sums, np.int64) if small \
            else self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.offset(x) / self.n).astype(float)

    def deviation(self, x: np.ndarray) -> list:
        off = self.offset(x)
        if not len(off):
            return []
        if off.dtype == object or len(self.sums) * int(np.abs(off).max()) ** 2 >= 1 << 62:
            off = off.astype(object)
        sizes = (off * off).sum(axis=1)
        return [int(s) if s < 1 << 63 else None for s in sizes]


def moments(fit: DataFrame) -> Moments | None:
    """One row per task and dimension leaves the tasks; the sums are decimals, so they are exact."""
    def run(batches):
        total, largest, n = None, 0, 0
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                high = np.abs(x).max()
                part = (x if high * len(x) < 1 << 62 else x.astype(object)).sum(axis=0).astype(object)
                total = part if total is None else total + part
                largest, n = max(largest, int(high)), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()),
                 pa.array([Decimal(int(s)) for s in total], pa.decimal128(38, 0)),
                 pa.array([largest] * len(total), pa.int64()), pa.array([n] * len(total), pa.int64())],
                names=["dim", "s", "largest", "n"])

    sums = fit.select("x").mapInArrow(run, "dim int, s decimal(38,0), largest long, n long") \
        .groupBy("dim").agg(F.sum("s").alias("s"), F.max("largest").alias("largest"),
                            F.sum("n").alias("n")).orderBy("dim").collect()     # a row per dimension
    return Moments(sums[0].n, [int(r.s) for r in sums], sums[0].largest) if sums else None


def _fold(parts: DataFrame, merge) -> bytes | None:
    """One matrix from (part, m): rounds in which a task merges at most ``FOLD`` of them."""
    def some(pdf):
        import pandas as pd
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "m": [merge(sorted(pdf["m"].tolist()))]})

    parts = materialize(parts, "matrices")
    left = parts.count()
    while left > 1:
        # the numbers shrink with every round, so after log(tasks) rounds one matrix is left
        parts = materialize(parts.withColumn("part", F.floor(F.col("part") / FOLD).cast("long"))
                            .groupBy("part").applyInPandas(some, "part long, m binary"), "matrices")
        left = parts.count()
    row = parts.first()
    return bytes(row.m) if row else None


def _per_task(rows: DataFrame, start, step, end) -> DataFrame:
    """(part, m): what ``step`` makes of a task's blocks, starting from ``start``."""
    def run(batches):
        state = start()
        for batch in batches:
            x = matrix(batch.column(0))
            for i in range(0, len(x), BLOCK):
                state = step(state, x[i:i + BLOCK])
        m = end(state)
        if m is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([m], pa.binary())],
                names=["part", "m"])

    return rows.select("x").mapInArrow(run, "part long, m binary")


def triangle(fit: DataFrame, mean: Moments) -> np.ndarray:
    """R of the centred fit list: as wide as a vector, whatever the number of rows."""
    d = len(mean.sums)

    def stacked(matrices):
        return np.linalg.qr(np.vstack(matrices), mode="r")

    def merge(blobs):
        return stacked([np.frombuffer(b).reshape(-1, d) for b in blobs]).tobytes()

    parts = _per_task(fit, lambda: None,
                      lambda r, x: stacked([mean.centred(x)] if r is None else [r, mean.centred(x)]),
                      lambda r: None if r is None else r.tobytes())
    r = np.zeros((d, d))
    found = np.frombuffer(_fold(parts, merge)).reshape(-1, d)
    r[:len(found)] = np.triu(found)
    return r


def identity_error(fit: DataFrame, mean: Moments, to_white: np.ndarray) -> float:
    """How far the covariance of the whitened fit list is from the identity, from its rows: means
    and centred products are merged pairwise, so nothing cancels."""
    k = to_white.shape[1]

    def join(a, b):
        if a is None or b is None:
            return b if a is None else a
        n = a[0] + b[0]
        gap = b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def of(x):
        w = mean.centred(x) @ to_white
        m = w.mean(axis=0)
        return float(len(w)), m, (w - m).T @ (w - m)

    def pack(state):
        return None if state is None else np.concatenate(
            [[state[0]], state[1], state[2].ravel()]).tobytes()

    def unpack(blob):
        flat = np.frombuffer(blob)
        return flat[0], flat[1:k + 1], flat[k + 1:].reshape(k, k)

    def merge(blobs):
        state = None
        for b in blobs:
            state = join(state, unpack(b))
        return pack(state)

    n, _, products = unpack(_fold(_per_task(fit, lambda: None, lambda s, x: join(s, of(x)), pack), merge))
    return float(np.abs(products / n - np.eye(k)).max())


@dataclass(frozen=True)
class Whitening:
    """``directions``: unit vectors as columns, by falling ``values`` (the variances along them)."""
    moments: Moments
    values: np.ndarray
    directions: np.ndarray
    explained: np.ndarray
    error: float

    @property
    def to_white(self) -> np.ndarray:
        return self.directions / np.sqrt(self.values)


def fit(rows: DataFrame, most: int = MOST) -> Whitening | None:
    """The whitening of ``rows`` (x), each distinct vector once; ``None`` where no component exists."""
    once = materialize(rows.select("x").distinct(), "fit-list")
    mean = moments(once)
    if mean is None:
        return None
    r = triangle(once, mean)
    values, directions = qd.leading(r, most)
    if not len(values):
        return None
    to_white = directions / np.sqrt(values / mean.n)
    return Whitening(mean, values / mean.n, directions, values / np.sum(r * r),
                     identity_error(once, mean, to_white))


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened): every row with its whitened vector, where it lies."""
    mean, to_white = model.moments, model.to_white
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType),
                           T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1))
            if not len(x):
                continue
            w = mean.centred(x) @ to_white
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(mean.deviation(x), pa.int64()),
                 pa.array(list(w), pa.list_(pa.float64()))], names=["id", "deviation", "whitened"])

    return rows.select("id", "x").mapInArrow(run, schema)


def report(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           most: int = MOST) -> DataFrame:
    """One row per remaining row and component."""
    rows = grid_rows(table, id_col, vec_col)
    model = fit(rows, most)
    if model is None:
        kind = table.schema[id_col].dataType.simpleString()
        return table.sparkSession.createDataFrame([], f"{id_col} {kind}, component int, n long, deviation "
                                                  "long, whitened double, explained double, "
                                                  "identity_error double")
    shares = F.array(*[F.lit(float(e)) for e in model.explained])
    return whiten(rows, model).select("id", "deviation", F.posexplode("whitened").alias("i", "w")).select(
        F.col("id").alias(id_col), (F.col("i") + 1).alias("component"),
        F.lit(model.moments.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"),
        F.element_at(shares, F.col("i") + 1).alias("explained"),
        F.lit(model.error).alias("identity_error"))
