"""Embedding whitening by shifted CholeskyQR.

Vectors become integers, and each distinct one counts once: the fit list, whose length and sums are exact. Passes
over it sum the Gram matrix of its centred rows. The first is shifted and factored by Cholesky; each later one sums
the Gram matrix of the rows solved against the triangular factors so far, whose product approaches the R of a QR
factorisation. What the last Gram matrix still lacks of the identity goes into R too, so rows of less than full rank
need no case of their own. The right singular vectors of R are the components.

A task holds a batch of rows and a square matrix of the vectors' length. Those matrices are added up in two steps.

Vectors that are null, empty, or hold null or non-finite entries take no part, nor do those of another length than the
commonest (of equally common ones the longest), as they share no components. Entries past a long count as its ends, and
so do deviations. A repeated id is a row of its own. A component without variance has an explained share of 0 and no
whitened values. Columns other than key and vector are not looked at. Without vectors there are no rows.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE = 256.0
#: Factors of R before the last Gram matrix, and how far that may be from the identity to stop before.
ROUNDS, SETTLED = 3, 1e-13
#: Matrices of tasks are added up to so many first, then to one.
SUMS = 32
EPS = float(np.finfo(float).eps)
#: The largest long and the first power of two past it.
TOP, EDGE = (1 << 63) - 1, float(1 << 63)


@dataclasses.dataclass(frozen=True)
class Whitening:
    """``components``: one a row, by falling ``variances``. ``sums`` are those of the fit list of ``n`` vectors."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    identity_error: float

    @property
    def explained(self) -> np.ndarray:
        total = float(self.variances.sum())
        return self.variances / total if total > 0 else np.zeros(len(self.variances))

    @property
    def live(self) -> np.ndarray:
        """Which components have variance."""
        d = len(self.variances)
        return self.variances > (10 * d * EPS) ** 2 * self.variances[:1]


def quantised(rows: DataFrame, key: str, vector: str, scale: float = SCALE) -> DataFrame:
    """id, x, d: floor(scale * entry) as consecutive longs, and how many, for each vector of finite entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            length = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            ends = np.cumsum(length)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            good = (length > 0) & (bad[ends] == bad[ends - length])
            with np.errstate(over="ignore"):
                x = np.floor(scale * flat[np.repeat(good, length)])
            whole = np.clip(x, -EDGE, np.nextafter(EDGE, 0)).astype(np.int64)
            whole[x >= EDGE] = TOP
            at = np.concatenate(([0], 8 * np.cumsum(length[good]))).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), int(good.sum()), [None, pa.py_buffer(at), pa.py_buffer(whole)])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), packed, pa.array(length[good].astype(np.int32))], names=["id", "x", "d"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key), F.col(vector)).mapInArrow(run, f"id {kind}, x binary, d int")


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A batch of packed vectors, one a row."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, d)


def offsets(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exactly: longs where they fit, else Python integers."""
    most = float(n) * max(abs(float(x.max(initial=0))), abs(float(x.min(initial=0)))) + float(max(map(abs, sums)))
    if most < EDGE / 2:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return offsets(x, n, sums).astype(np.float64) / n


def deviations(y: np.ndarray) -> np.ndarray:
    """Sums of squares of rows of integers: exact, up to the largest long. Products of longs wrap, which cancels out
    where the sum is a long."""
    about = (y.astype(np.float64) ** 2).sum(1)
    out = np.full(len(y), TOP, np.int64)
    fits = about < EDGE * (1 - 1e-9) if y.dtype != object else np.zeros(len(y), bool)
    with np.errstate(over="ignore"):
        out[fits] = (y[fits] * y[fits]).sum(1)
    for k in np.flatnonzero(~fits & (about < EDGE * (1 + 1e-9))):
        out[k] = min(TOP, sum(int(v) ** 2 for v in y[k]))
    return out


def added(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], d: int, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of ``part`` of all batches of packed vectors. One array of ``shape`` a task goes on."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(matrix(batch.column(0), d))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), np.float64).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    parts = rows.select("x").mapInArrow(first, "total binary").repartition(SUMS).mapInArrow(again, "total binary")
    found = parts.repartition(1).mapInArrow(again, "total binary").first()
    return np.frombuffer(found[0], np.float64).reshape(shape) if found else np.zeros(shape)


def exact_sums(rows: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """Number of packed vectors and their sum in each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), d)
                n += len(x)
                small = float(np.abs(x.astype(np.float64)).max()) * len(x) < EDGE / 2
                total = [a + int(b) for a, b in zip(total, (x if small else x.astype(object)).sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(t) for t in total])], names=["dim", "n", "total"])

    sums = rows.select("x").mapInArrow(run, "dim int, n long, total string").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    held = sorted(sums.collect())  # a row a dimension
    return (int(held[0]["n"]), tuple(int(r["total"]) for r in held)) if held else (0, (0,) * d)


def solved(block: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows of ``block`` times the inverse of each upper triangular factor in turn."""
    for r in factors:
        block = np.linalg.solve(r.T, block.T).T
    return block


def factored(rows: DataFrame, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """A square R with R'R = A'A for the centred rows A, and the passes made."""
    d = len(sums)
    factors: list[np.ndarray] = []
    for passes in range(1, ROUNDS + 2):
        before = list(factors)

        def gram(x: np.ndarray) -> np.ndarray:
            q = solved(centred(x, n, sums), before)
            return q.T @ q

        g = added(rows, gram, d, (d, d))
        share, axes = np.linalg.eigh(g)
        short = share[0] <= 10 * d * EPS * share[-1]  # of less than full rank, as far as this pass tells
        if share[-1] <= 0 or factors and np.abs(share - 1).max() < SETTLED or passes > ROUNDS or short and passes > 2:
            break
        shift = 11 * EPS * d * (n + d + 1) * share[-1] if short or not factors else 0.0
        factors.append(np.linalg.cholesky(g + shift * np.eye(d)).T)
    r = np.eye(d)
    for f in factors:
        r = f @ r
    keep = share > 1e-10 * max(share[-1], 0.0)
    return (np.sqrt(np.where(keep, share, 0.0))[:, None] * axes.T) @ r, passes


def fit(packed: DataFrame, d: int, components: int = 4) -> Whitening | None:
    """``packed``: x of ``quantised``, all of length ``d``. None without vectors. ``identity_error`` is measured over
    as many components as stated."""
    rows = written(packed.select("x").distinct(), "fit-list")
    n, sums = exact_sums(rows, d)
    if n == 0:
        return None
    r, _ = factored(rows, n, sums)
    _, size, axes = np.linalg.svd(r)
    axes = axes * np.sign(axes[np.arange(d), np.abs(axes).argmax(1)])[:, None]  # the largest part is positive
    out = Whitening(n, sums, axes, size**2 / n, 0.0)
    k = int(out.live[:components].sum())
    if k == 0:
        return out
    to = (axes[:k] / np.sqrt(out.variances[:k])[:, None]).T
    mean = added(rows, lambda x: (centred(x, n, sums) @ to).sum(0), d, (k,)) / n

    def cov(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums) @ to - mean
        return w.T @ w

    return dataclasses.replace(out, identity_error=float(np.abs(added(rows, cov, d, (k, k)) / n - np.eye(k)).max()))


def whitened(packed: DataFrame, model: Whitening, components: int = 4) -> DataFrame:
    """A row for each row and component: id, component, n, deviation, whitened, explained, identity_error."""
    d, n, sums, error = len(model.sums), model.n, model.sums, model.identity_error
    k = min(components, d)
    live, explained = model.live[:k], model.explained[:k]
    to = np.where(live[:, None], model.components[:k] / np.sqrt(np.where(live, model.variances[:k], 1.0))[:, None], 0.0).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            y = offsets(matrix(batch.column(1), d), n, sums)
            m = len(y)
            w = (y.astype(np.float64) / n) @ to
            each = np.repeat(np.arange(m), k)
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, np.int64)),
                pa.array(deviations(y)[each]),
                pa.array(w.ravel(), mask=~np.tile(live, m)),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = packed.schema["id"].dataType.simpleString()
    return packed.select("id", "x").mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(rows: DataFrame, key: str, vector: str, components: int = 4, scale: float = SCALE) -> DataFrame:
    """Whitened values of every vector, by components of the distinct ones."""
    packed = quantised(rows, key, vector, scale)
    common = packed.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 1
    packed = packed.where(F.col("d") == d)
    model = fit(packed, d, components) or Whitening(1, (0,) * d, np.eye(d), np.zeros(d), 0.0)
    return whitened(packed, model, components).withColumnRenamed("id", key)
