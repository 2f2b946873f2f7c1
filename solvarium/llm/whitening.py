"""Whitening of embeddings by matrix-free block subspace iteration.

An entry c becomes the integer floor(256 * c). The fit list holds each distinct integer vector once: n of them with
sums S. Its covariance V is never formed: a pass of Spark computes Xt(XQ) on centred rows for a block Q of orthonormal
columns, a d x b matrix for each task, which are summed by row of the matrix in a shuffle, so that the driver receives
d x b numbers whatever the table's size. There follow Rayleigh-Ritz in the block, and QR for the next one. The passes
end when the residuals of all k wanted pairs are at most TOLERANCE times the largest eigenvalue.

Spectra of embeddings can be flat, and then a block of fixed width takes hundreds of passes. So where the fall of the
residuals so far means more than PATIENCE further passes, the block gets twice the width, with new random columns. A
block as wide as the vectors is exact in one pass, so the iteration ends for every spectrum.

Defined cases: a vector that is null, empty or holds a null or non-finite entry is dropped; so is one whose length is
not the table's most common (of equally common ones the greatest), by a count over all rows; entries beyond 64 bits take
the nearest long. Repeated rows and ids are rows each, and count once in the fit list; a null id is kept. There are
min(k, d) components; one whose eigenvalue is zero but for rounding has explained 0 and a null whitened value, and takes
no part in identity_error; with a covariance of zero explained is null. A deviation beyond a long is null. Equal
eigenvalues share a space, in which any basis may come. An empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvarium.llm._shared import Scratch, table

COMPONENTS = 4
BLOCK = 32
TOLERANCE = 1e-12
PATIENCE = 6
PASSES = 500
SEED = 11
LONG = 2**63


@dataclass
class Whitening:
    """Of a fit list: how many vectors and their sums, eigenvalues in falling order with unit eigenvectors as columns,
    the trace of the covariance, residuals relative to the largest eigenvalue, and how many passes it took."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def alive(self) -> np.ndarray:
        """Which components have an eigenvalue that is more than rounding."""
        return self.values > len(self.sums) * 1e-13 * max(self.values[0], 0) if len(self.values) else np.zeros(0, bool)

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(np.where(self.alive, self.values, 1.0))


def integers(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """`df` without rows that take no part, with `x`: the vector's integers."""
    v = f"`{vec_col}`"
    fine = df.where(f"size({v}) > 0 AND forall({v}, c -> c IS NOT NULL AND NOT isnan(c) AND abs(CAST(c AS DOUBLE)) < double('infinity'))")
    sizes = fine.groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    out = fine.withColumn("x", F.expr(f"transform({v}, c -> floor(256.0D * CAST(c AS DOUBLE)))"))
    return out.where(F.size("x") == (sizes["d"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, each, kind: str) -> dict[int, np.ndarray]:
    """each(matrix of integers) is an array by key, summed over all rows: within a task as it reads, and between tasks in
    a shuffle by key. Only one array for each key reaches the driver."""

    def part(batches) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for key, v in each(_matrix(batch.column(0))).items():
                    total[key] = total[key] + v if key in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["key", "v"])

    def merge(t: pa.Table) -> pa.Table:
        v = sum(np.frombuffer(b.as_py(), kind) for b in t.column("v"))
        return pa.table({"key": t.column("key")[:1], "v": pa.array([v.tobytes()], pa.binary())})

    schema = "key int, v binary"
    found = rows.select("x").mapInArrow(part, schema).groupBy("key").applyInArrow(merge, schema).collect()
    return {r["key"]: np.frombuffer(r["v"], kind) for r in found}


def fit(df: DataFrame, vec_col: str = "embedding", k: int = COMPONENTS, block: int = BLOCK, tolerance: float = TOLERANCE) -> Whitening | None:
    """The leading k components of the distinct integer vectors of `df`; None without any."""
    scratch = Scratch(df.sparkSession, "whitening")
    rows = scratch.save(integers(df, vec_col).select("x").dropDuplicates(["x"]), "fit")
    # Sums of the upper and the lower 32 bits, and counts, are exact in 64 bits for 2^31 rows a task and 2^31 in all.
    found = _summed(rows, lambda x: {0: (x >> 32).sum(0), 1: (x & 0xFFFFFFFF).sum(0), 2: np.array([len(x)])}, "<i8")
    if not found:
        scratch.drop("fit")
        return None
    n, sums = int(found[2][0]), [int(hi) * 2**32 + int(lo) for hi, lo in zip(found[0], found[1])]
    out = _iterate(rows, n, sums, k, block, tolerance)
    alive = np.flatnonzero(out.alive)
    if len(alive):
        mean, projection = out.mean, out.projection[:, alive]
        first = _summed(rows, lambda x: _moments((x - mean) @ projection), "<f8")
        centre = first[0] / n
        second = np.array([first[i + 1] for i in range(len(alive))]) / n - np.outer(centre, centre)
        out.identity_error = float(np.abs(second - np.eye(len(alive))).max())
    scratch.drop("fit")
    return out


def _moments(w: np.ndarray) -> dict[int, np.ndarray]:
    return {0: w.sum(0)} | {i + 1: row for i, row in enumerate(w.T @ w)}


def _iterate(rows: DataFrame, n: int, sums: list[int], k: int, block: int, tolerance: float) -> Whitening:
    d, rng = len(sums), np.random.default_rng(SEED)
    mean = np.array([s / n for s in sums])
    k = min(k, d)
    q = np.linalg.qr(rng.standard_normal((d, min(d, max(block, 2 * k)))))[0]
    trace, fall, last = None, 1.0, None
    for passes in range(1, PASSES + 1):

        def product(x: np.ndarray, q=q) -> dict[int, np.ndarray]:
            c = x - mean
            return {-1: np.array([np.einsum("ij,ij->", c, c)])} | {i: row for i, row in enumerate(c.T @ (c @ q))}

        found = _summed(rows, product, "<f8")
        trace = float(found[-1][0]) / n
        y = np.array([found[i] for i in range(d)]) / n
        t = q.T @ y
        values, turn = np.linalg.eigh((t + t.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = q @ turn
        scale = values[0] if values[0] > 0 else 1.0
        residuals = np.linalg.norm(y @ turn[:, :k] - vectors[:, :k] * values[:k], axis=0) / scale
        worst = float(residuals.max())
        if worst <= tolerance or q.shape[1] == d:
            return Whitening(n, sums, np.maximum(values[:k], 0.0), vectors[:, :k], trace, residuals, passes)
        if last is not None:
            fall = worst / last
        slow = fall >= 1 or np.log(tolerance / worst) / np.log(fall) > PATIENCE
        last = worst
        y = y @ turn
        if slow and passes > 1:
            y, last, fall = np.hstack([y, rng.standard_normal((d, min(q.shape[1], d - q.shape[1]))) * scale]), None, 1.0
        q = np.linalg.qr(y)[0]
    raise ArithmeticError(f"no convergence in {PASSES} passes: residuals {residuals}")


def transform(df: DataFrame, model: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row that takes part and each component."""
    id_kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    n, sums, mean, projection, alive = model.n, model.sums, model.mean, model.projection, model.alive
    share = [float(v) / model.trace if model.trace > 0 else None for v in np.where(alive, model.values, 0.0)]
    k, error = len(alive), model.identity_error
    most = max(map(abs, sums))

    def deviations(x: np.ndarray) -> list[int | None]:
        reach = n * int(np.abs(x.astype(np.float64)).max() + 1) + most
        if len(sums) * reach * reach < LONG:
            return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(1).tolist()
        exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist())
        return [v if v < LONG else None for v in exact]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, m = _matrix(batch.column(1)), batch.num_rows
            w = (x - mean) @ projection
            dev = np.repeat(np.arange(m), k)
            columns = [
                batch.column(0).take(pa.array(dev)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, dtype=np.int64)),
                pa.array(deviations(x), pa.int64()).take(pa.array(dev)),
                pa.array(w.ravel(), mask=np.tile(~alive, m)),
                pa.array(share * m, pa.float64()),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return integers(df, vec_col).select(id_col, "x").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return transform(rows, fit(rows))
