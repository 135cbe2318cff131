"""Whitening of embeddings by a one-sided Jacobi SVD of their centred rows.

Distinct vectors are centred exactly, each partition reduces its rows to a triangular R block by block (TSQR), R factors
meet in a tree, and plane rotations make the last R's columns orthogonal: the rotations are the components, the column
norms the standard deviations times sqrt(n). The covariance matrix, whose entries would square the errors, is never formed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import shared, stage

#: Components that ``whitened`` keeps unless told otherwise.
COMPONENTS = 16
#: R factors that meet in one task of the reduction tree.
FAN_IN = 16
#: Rows that enter a QR step together.
BLOCK_ROWS = 4096
#: Scaled entries beyond this do not fit the exact arithmetic.
MOST = 1 << 40
#: A component whose standard deviation is at most this share of the largest one is no direction of the data.
RANK_TOLERANCE = 1e-12


def valid(vector: str, most: float) -> F.Column:
    """True for a vector without null or non-finite entries and without any of ``most`` or more in absolute value."""
    v = F.col(vector).cast("array<double>")
    return F.coalesce(F.forall(v, lambda c: F.coalesce(F.abs(c) < F.lit(float(most)), F.lit(False)) & ~F.isnan(c)), F.lit(False))


def with_dimension(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vectors have the table's dimension, which is the most frequent length (of several, the longest); 0 for no rows."""
    best = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = best[0]["d"] if best else 0
    return rows.where(F.size(vector) == d), d


def fixed_point(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 64, offset: int = 1_000_000) -> tuple[DataFrame, int]:
    """(id, x) of the rows with a whole vector, x = floor(scale * c) + offset as longs; and the dimension.

    Rows whose vector is null, empty, or holds null, non-finite or unrepresentable entries (2**40 and more after scaling) are
    dropped, and those whose length is not the table's most frequent one. Null and repeated ids stay as they are.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(valid("v", MOST / scale)).where("size(v) > 0")
    return with_dimension(rows.select("id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(offset).cast("long")).alias("x")), "x")


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def summed(rows: DataFrame, d: int, of: str, values, size: int, kind: str) -> np.ndarray:
    """The sum over all rows of ``values(matrix)``, a vector of ``size`` numbers; partitions add up before they meet."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                got = values(matrix(b.column(0), d))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_pydict({"s": [total.tolist()]}, schema=pa.schema([("s", pa.list_(pa.int64() if kind == "long" else pa.float64()))]))

    parts = rows.select(of).mapInArrow(run, f"s array<{kind}>")
    got = parts.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    for r in got:
        out[r["i"]] = r["v"]
    return out


def triangle(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(blocks), mode="r")


def tsqr(rows: DataFrame, d: int, center) -> np.ndarray:
    """The triangular factor of all centred rows. Partitions reduce theirs block by block, ``FAN_IN`` factors at a time meet in a task."""
    schema, r_type = "part long, r binary", pa.schema([("part", pa.int64()), ("r", pa.binary())])

    def local(batches):
        from pyspark import TaskContext

        r, held, n = [], [], 0
        for b in batches:
            if b.num_rows:
                held.append(center(matrix(b.column(0), d)))
                n += b.num_rows
            if n >= BLOCK_ROWS:
                r, held, n = [triangle(r + held)], [], 0
        if r or held:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "r": [triangle(r + held).tobytes()]}, schema=r_type)

    def meet(table: pa.Table) -> pa.Table:
        found = [np.frombuffer(r, np.float64).reshape(-1, d) for r in table.sort_by("part").column("r").to_pylist()]
        return pa.Table.from_pydict({"part": [table.column("part")[0].as_py() // FAN_IN], "r": [triangle(found).tobytes()]}, schema=r_type)

    factors = stage(rows.select("x").mapInArrow(local, schema), "tsqr")
    # parts keep their order; every level divides their numbers by FAN_IN
    while factors.count() > 1:
        level = factors.withColumn("to", F.floor(F.col("part") / FAN_IN))
        factors = stage(level.groupBy("to").applyInArrow(lambda t: meet(t.select(["part", "r"])), schema), "tsqr")
    got = factors.collect()
    return np.frombuffer(got[0]["r"], np.float64).reshape(-1, d).copy() if got else np.zeros((0, d))


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (columns) of ``r`` by one-sided Jacobi rotations.

    Each step of a sweep rotates d/2 disjoint pairs of columns at once (round robin); it ends where every pair is
    orthogonal to machine precision, so small singular values keep their relative accuracy.
    """
    d = r.shape[1]
    a, v = r.astype(np.float64).copy(), np.eye(d)
    if d < 2 or not a.size:
        return np.linalg.norm(a, axis=0) if a.size else np.zeros(d), v
    ring = np.arange(d + d % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[::-1][: len(ring) // 2]
            real = (p < d) & (q < d)
            p, q = p[real], q[real]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            go = np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)
            if go.any():
                turned = True
                p, q, x, y, alpha, beta, gamma = p[go], q[go], x[:, go], y[:, go], alpha[go], beta[go], gamma[go]
                zeta = (beta - alpha) / (2 * gamma)
                with np.errstate(over="ignore"):
                    t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                a[:, p], a[:, q] = c * x - s * y, s * x + c * y
                x, y = v[:, p], v[:, q]
                v[:, p], v[:, q] = c * x - s * y, s * x + c * y
            ring = np.concatenate([ring[:1], np.roll(ring[1:], 1)])
        if not turned:
            break
    sigma = np.linalg.norm(a, axis=0)
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], v[:, order]


@dataclass
class Whitening:
    """n distinct vectors with sums S; ``components`` in columns, their ``deviations`` sqrt(e), and shares of the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    def multiple(self, x: np.ndarray) -> np.ndarray:
        """n*x - S in whole numbers, as Python's own where longs are too short."""
        wide = x.size and int(np.abs(x).max()) * self.n >= 1 << 62
        return (x.astype(object) if wide else x) * (self.n if wide else np.int64(self.n)) - self.sums

    def centered(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, subtracted in whole numbers and divided once."""
        return self.multiple(x).astype(np.float64) / float(self.n)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centered(x) @ self.components / self.deviations

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n*x - S)^2 in whole numbers; null where it passes a long."""
        y = self.multiple(x)
        top = int(np.abs(y).max()) if y.size else 0
        if y.dtype != object and top * top * x.shape[1] < 1 << 63:
            return (y * y).sum(1).tolist()
        return [s if s < 1 << 63 else None for s in (sum(int(c) ** 2 for c in row) for row in y)]


def fit(distinct: DataFrame, d: int, keep: int = COMPONENTS) -> Whitening:
    """Fits at most ``keep`` components to (x), one row a vector. A direction without variance is no component: fewer remain where
    vectors are few or lie in a subspace, none for a single vector or an empty table."""
    counted = summed(distinct, d, "x", lambda x: np.append(x.sum(0), len(x)), d + 1, "long")
    n, sums = int(counted[d]), counted[:d]
    model = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    if not n:
        return model
    sigma, v = jacobi(tsqr(distinct, d, model.centered))
    real = sigma > RANK_TOLERANCE * max(sigma.max(initial=0), np.finfo(float).tiny)
    k = min(keep, int(real.sum()))
    squares = sigma**2
    model.components, model.deviations, model.explained = v[:, :k].copy(), sigma[:k] / np.sqrt(n), squares[:k] / squares.sum() if k else squares[:0]
    return model


def identity_error(distinct: DataFrame, d: int, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened vectors less the identity; 0 without components."""
    k = model.components.shape[1]
    if not k:
        return 0.0
    sent = shared(distinct.sparkSession, model)

    def products(x):
        w = sent.value.apply(x)
        return (w.T @ w).ravel()

    cov = summed(distinct, d, "x", products, k * k, "double").reshape(k, k) / model.n
    return float(np.abs(cov - np.eye(k)).max())


SCHEMA = "id long, component int, n long, deviation long, whitened double, explained double"


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each row with a whole vector and each component.

    Rows that ``fixed_point`` drops are left out; rows with equal vectors count once in the fit and all come back; ids may be
    null or repeated; other columns are ignored. Components are numbered by falling eigenvalue, equal eigenvalues as the
    rotations leave them. An empty table, or one of equal vectors, gives no rows.
    """
    rows, d = fixed_point(vectors, id_col, vector_col)
    distinct = stage(rows.select("x").distinct(), "whiten-fit")
    model = fit(distinct, d, keep)
    error = identity_error(distinct, d, model)
    sent, k = shared(vectors.sparkSession, model), model.components.shape[1]
    fields = pa.schema([("id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64())])

    def run(batches):
        m = sent.value
        for b in batches:
            if not (b.num_rows and k):
                continue
            x = matrix(b.column(1), d)
            w, size = m.apply(x), len(x) * k
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()).take(each), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(size, m.n), pa.array(m.deviation(x), pa.int64()).take(each), w.ravel(), np.tile(m.explained, len(x))], schema=fields
            )

    return rows.mapInArrow(run, SCHEMA).withColumn("identity_error", F.lit(error))


def op13_whitening(spark, sf_dir):
    """All of ``embeddings``, on its first 16 components."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
