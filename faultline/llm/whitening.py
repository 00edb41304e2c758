"""Whitening of embeddings: leading eigenvectors of their covariance by Jacobi-Davidson over distributed products.

The covariance is never formed. A product with a few vectors is one pass over the distinct vectors: each task centres its
rows exactly (n*x - S is an integer) and returns its share of M'(M w). On the driver live only vectors of the
embedding's dimension: the search space, the locked eigenvectors and the corrections.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Steps of the inner solver at most; vectors of the search space before it is restarted, and after.
INNER, SPACE, KEPT = 5, 24, 8
#: A residual of so many units of rounding of the largest eigenvalue is double precision.
UNITS = 32
_EPS = np.finfo(float).eps
#: Partial sums that the driver takes directly; more are first added up by Spark.
DIRECT = 256


def integers(vector: Column) -> Column:
    """floor(256 * c) of each entry; null for a null vector or one with null or non-finite entries. Beyond a long it stays at the long's end."""
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & sound, F.transform(vector, lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long")))


def matrix(batch: pa.RecordBatch, column: int, d: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Centre:
    """n*x - S as exact integers and x - S/n as doubles. Python integers take over where 64 bits would not hold."""

    def __init__(self, n: int, sums: list[int], largest: int):
        self.n, self.d, self.sums = n, len(sums), sums
        bound = n * largest + max(map(abs, sums), default=0)
        self.small, self.square = bound < 1 << 62, self.d * bound * bound < 1 << 63

    def exact(self, x: np.ndarray) -> np.ndarray:
        return self.n * x - np.array(self.sums, np.int64) if self.small else self.n * x.astype(object) - np.array(self.sums, object)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.exact(x).astype(float) / self.n

    def deviation(self, x: np.ndarray) -> list:
        """Sum of squares of n*x - S; None where a long can't hold it."""
        e = self.exact(x)
        if self.square:
            return (e * e).sum(axis=1).tolist()
        return [s if (s := sum(int(v) * int(v) for v in row)) < 1 << 63 else None for row in e]


def passed(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray], d: int, width: int) -> np.ndarray:
    """Sum over all rows of fit of what ``of`` gives for the rows of a batch: one pass, and one row of ``width`` numbers a task."""

    def share(batches):
        total = np.zeros(width)
        for batch in batches:
            total += of(matrix(batch, 0, d)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part", "v"])

    parts = fit.mapInArrow(share, "part int, v array<double>")
    if fit.rdd.getNumPartitions() > DIRECT:
        add = lambda pdf: pd.DataFrame({"part": [pdf["part"].min()], "v": [np.sum(pdf.sort_values("part")["v"].tolist(), axis=0)]})
        parts = parts.groupBy(F.col("part") % 64).applyInPandas(add, "part int, v array<double>")
    return np.sum([r[1] for r in sorted(parts.collect())] or [np.zeros(width)], axis=0)


def totals(fit: DataFrame, d: int) -> tuple[int, list[int], int]:
    """Rows, exact sums of each dimension and largest absolute entry; sums go in two halves, so that no task overflows."""

    def share(batches):
        n, high, low, largest = 0, np.zeros(d, np.int64), np.zeros(d, np.int64), 0
        for batch in batches:
            x = matrix(batch, 0, d)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            largest = max(largest, abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
        yield pa.RecordBatch.from_pydict({"n": [n], "s": [[str((h << 32) + lo) for h, lo in zip(high.tolist(), low.tolist())]], "largest": [str(largest)]})

    rows = fit.mapInArrow(share, "n long, s array<string>, largest string")
    sums = rows.select(F.posexplode("s").alias("j", "s")).groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    top = rows.agg(F.sum("n"), F.max(F.col("largest").cast("decimal(38,0)"))).first()
    by = {r["j"]: int(r["s"]) for r in sums}
    return top[0] or 0, [by.get(j, 0) for j in range(d)], int(top[1] or 0)


def orthonormal(new: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    """Columns of new as an orthonormal set that is orthogonal to the others; directions that they hold already are left out."""
    kept: list[np.ndarray] = []
    for t in new.T:
        size = np.linalg.norm(t)
        for _ in range(3):
            for basis in against:
                t = t - basis @ (basis.T @ t)
            for q in kept:
                t = t - q * (q @ t)
        if np.linalg.norm(t) > 1e-10 * max(size, 1e-300):
            kept.append(t / np.linalg.norm(t))
    return np.array(kept).T.reshape(len(new), len(kept))


def corrections(product: Callable, theta: np.ndarray, u: np.ndarray, r: np.ndarray, locked: np.ndarray, accuracy: float) -> np.ndarray:
    """Approximate solutions t of (I-QQ')(A-theta I)(I-QQ') t = -r, Q holding the locked vectors and u, by MINRES.

    One solution for each column; the columns go in step, so that a step is one distributed product for all of them.
    """

    def project(j: int, v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - u[:, j] * (u[:, j] @ v) - locked @ (locked.T @ v)
        return v

    k = r.shape[1]
    v = np.array([project(j, -r[:, j]) for j in range(k)]).T
    beta = np.linalg.norm(v, axis=0)
    start, eta = beta.copy(), beta.copy()
    live = beta > 0
    v = v / np.where(live, beta, 1)
    x, w, w0, v0 = (np.zeros_like(v) for _ in range(4))
    beta, c, c0, s, s0 = np.zeros(k), np.ones(k), np.ones(k), np.zeros(k), np.zeros(k)
    for _ in range(INNER):
        on = np.flatnonzero(live)
        if not len(on):
            break
        av = product(v[:, on])
        for j, y in zip(on, av.T):
            y = project(j, y - theta[j] * v[:, j])
            alpha = v[:, j] @ y
            y = project(j, y - alpha * v[:, j] - beta[j] * v0[:, j])
            after = np.linalg.norm(y)
            delta = c[j] * alpha - c0[j] * s[j] * beta[j]
            rho = np.hypot(delta, after)
            if rho <= _EPS * abs(theta[j]):
                live[j] = False
                continue
            step = (v[:, j] - s0[j] * beta[j] * w0[:, j] - (s[j] * alpha + c0[j] * c[j] * beta[j]) * w[:, j]) / rho
            w0[:, j], w[:, j] = w[:, j], step
            c0[j], c[j], s0[j], s[j] = c[j], delta / rho, s[j], after / rho
            x[:, j] += c[j] * eta[j] * step
            eta[j] *= -s[j]
            live[j] = abs(eta[j]) > accuracy * start[j] and after > _EPS * abs(theta[j])
            v0[:, j], v[:, j], beta[j] = v[:, j], y / max(after, 1e-300), after
    return x


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, count: int, turns: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric positive matrix given by its products.

    A pair is locked once its residual is within UNITS units of rounding of the largest eigenvalue, or once the search space with
    the locked vectors is the whole space, where the Rayleigh-Ritz pairs are as exact as the products. Vectors have their largest entry positive.
    """
    count = min(count, d)
    locked, values = np.zeros((d, 0)), []
    space = orthonormal(np.random.default_rng(11).standard_normal((d, min(d, count + 2))), [])
    image = product(space)
    for turn in range(turns):
        theta, y = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        order = np.argsort(-theta)
        theta, space, image = theta[order], space @ y[:, order], image @ y[:, order]
        scale = max([*values, *np.abs(theta), 0.0])
        r = image - space * theta
        r = r - locked @ (locked.T @ r)
        residual = np.linalg.norm(r, axis=0)
        whole = space.shape[1] + locked.shape[1] == d and turn > 0
        ready = 0
        while ready < len(theta) and len(values) + ready < count and (residual[ready] <= UNITS * _EPS * scale or whole):
            ready += 1
        values += theta[:ready].tolist()
        locked, space, image, theta, r = np.hstack([locked, space[:, :ready]]), space[:, ready:], image[:, ready:], theta[ready:], r[:, ready:]
        if len(values) == count:
            break
        if space.shape[1] > SPACE:
            space, image = space[:, :KEPT], image[:, :KEPT]
        want = slice(0, count - len(values))
        if whole or not space.shape[1]:
            new = np.zeros((d, 0))
        else:
            new = orthonormal(corrections(product, theta[want], space[:, want], r[:, want], locked, 0.5 ** (turn + 2)), [locked, space])
        if not new.shape[1]:  # the corrections are in the space already: go on with any other direction, and renew the image
            new = orthonormal(np.random.default_rng(turn).standard_normal((d, count)), [locked, space])[:, : d - locked.shape[1] - space.shape[1]]
            space = orthonormal(space, [locked])
            image = product(np.hstack([space, new]))
            space = np.hstack([space, new])
        else:
            space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    else:
        raise RuntimeError("eigenvectors were not settled")
    order = np.argsort(-np.array(values), kind="stable")
    locked = locked[:, order]
    signs = np.sign(locked[np.abs(locked).argmax(axis=0), np.arange(count)]) if d else np.ones(0)
    return np.array(values)[order], locked * signs


def whiten(vectors: DataFrame, count: int = 4) -> DataFrame:
    """Each vector's coordinates on the ``count`` leading components, scaled to unit variance.

    vectors: (vec_id, vector). Rows whose vector is null or has null or non-finite entries are dropped; an entry c counts as
    floor(256*c). Mean and covariance are those of the distinct vectors; repeated rows and ids are kept. Vectors shorter than the longest are filled up
    with zeros. Components without variance (all vectors equal, fewer vectors than components) have no unit scale and give no
    rows; so do empty tables. deviation is null where a long can't hold it.
    Columns: vec_id, component (from 1), n (distinct vectors), deviation, whitened, explained, identity_error.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("vector")).alias("x")).where("x is not null")
    longest, shortest = rows.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    d = longest or 0
    if not d:
        return spark.createDataFrame([], schema)
    if shortest < d:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))))
    fit = written(rows.select("x").distinct())
    n, sums, largest = totals(fit, d)
    centre = Centre(n, sums, largest)

    def product(w: np.ndarray) -> np.ndarray:
        return passed(fit, lambda x: (m := centre(x)).T @ (m @ w), d, w.size).reshape(w.shape) / n

    trace = float(passed(fit, lambda x: (centre(x) ** 2).sum(axis=0), d, d).sum()) / n
    values, axes = leading(product, d, count)
    good = values > d * _EPS * trace
    values, axes = values[good], axes[:, good]
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    scaled = axes / np.sqrt(values)
    spread = passed(fit, lambda x: (w := centre(x) @ scaled).T @ w, d, k * k).reshape(k, k) / n
    error, explained = float(np.abs(spread - np.eye(k)).max()), (values / trace).tolist()
    drop_written(fit)

    def coordinates(batches):
        for batch in batches:
            x = matrix(batch, 1, d)
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array([v for v in centre.deviation(x) for _ in range(k)], pa.int64()), pa.array((centre(x) @ scaled).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ], schema=pa.schema(zip(("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))),
            )

    return rows.mapInArrow(coordinates, schema)
