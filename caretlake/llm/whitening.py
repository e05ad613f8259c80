"""Embedding whitening: principal components of all vectors, and vectors seen along them.

Entries become integers, so sums and products are exact and no order of tasks shows. Tasks hand
on sums of products of entries already centred at the rounded means; the covariance follows from
them without rounding. Its eigenvectors are taken in float32 and corrected in extended precision
by the matrix multiplications of Ogita and Aishima, with a small eigenproblem of its own for each
cluster of eigenvalues.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretlake.llm.common import arrow_map, prepare

# Entries become floor(SCALE * entry) + OFFSET, at most 2^53 away from OFFSET.
SCALE, OFFSET, LARGEST = 1024, 100_000, 1 << 53

# An eigenvalue below this share of the trace is none: nothing varies along its vector.
NOTHING = 1e-18

# Corrections of eigenvectors are trusted where eigenvalues differ by this many times the errors.
MARGIN = 1_000

_EXACT = "decimal(38,0)"


@dataclass
class Whitening:
    """What is known of a table of vectors; its size depends on their length alone."""

    n: int
    sums: list            # of the integers, by dimension, exact
    values: np.ndarray    # eigenvalues, falling
    vectors: np.ndarray   # unit eigenvectors as columns, sign: the largest entry is positive
    explained: np.ndarray

    @property
    def length(self) -> int:
        return len(self.sums)

    @property
    def centre(self) -> np.ndarray:
        """The means, rounded to integers."""
        return np.array([_rounded(s, self.n) for s in self.sums], dtype=np.int64)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Centred rows along the components, over the square roots of their eigenvalues."""
        centre = self.centre
        rest = np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, centre)])
        return ((x - centre) - rest) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list:
        """Sum over the dimensions of (n * x - sum)^2, exact."""
        x = x.astype(object) if _wide(x, self.n) else x
        sums = np.array(self.sums, dtype=object if x.dtype == object else np.int64)
        y = self.n * x - sums
        if y.dtype != object and _largest(y) ** 2 * max(1, self.length) >= 1 << 63:
            y = y.astype(object)
        return [int(v) for v in (y * y).sum(axis=1)]


def fit_whitening(vectors: DataFrame, vector_col: str = "embedding",
                  components: int = 8) -> Whitening | None:
    """The components of all vectors, at most `components`; None where no vector is usable.

    A vector that is null, empty or holds null or non-finite entries is not used; nor is one of
    another length than most have (of equally frequent lengths the larger one). Directions
    along which nothing varies are no components. The driver gets sums by pairs of dimensions.
    """
    prepare(vectors.sparkSession)
    rows = _integers(vectors, vector_col)
    sums = _first_sums(rows).collect()
    if not sums:
        return None
    _, length = max((int(r.n), r.length) for r in sums)
    sums = sorted((r for r in sums if r.length == length), key=lambda r: r.dim)
    n, totals = int(sums[0].n), [int(r.total) for r in sums]
    centre = np.array([_rounded(s, n) for s in totals], dtype=np.int64)
    products = {(r.i, r.j): int(r.total) for r in _products(rows, length, centre).collect()}
    rest = [s - n * int(c) for s, c in zip(totals, centre)]
    covariance = np.empty((length, length), np.longdouble)
    for (i, j), total in products.items():
        covariance[i, j] = covariance[j, i] = _ratio(n * total - rest[i] * rest[j], n * n)
    trace = np.trace(covariance)
    values, found = eigenvectors(covariance)
    keep = [k for k in range(min(components, length)) if values[k] > NOTHING * trace > 0]
    return Whitening(n, totals, values[keep].astype(float), found[:, keep].astype(float),
                     (values[keep] / trace).astype(float) if keep else np.empty(0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = 8, model: Whitening | None = None) -> DataFrame:
    """id, n, deviation (decimal), whitened and explained (arrays), identity_error, a row a vector.

    Vectors that `fit_whitening` wouldn't use are left out; ids may be null or repeat, each row
    stays. identity_error is the largest absolute entry of the covariance of the whitened vectors
    minus the identity, 0 where there are no components. Other columns are not read.
    """
    spark = prepare(vectors.sparkSession)
    model = model or fit_whitening(vectors, vector_col, components)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = (f"id {kind}, n bigint, deviation {_EXACT}, whitened array<double>, "
              "explained array<double>, identity_error double")
    if model is None:
        return spark.createDataFrame([], schema)
    rows = _integers(vectors, vector_col, id_col).filter(F.size("x") == model.length)
    error = identity_error(rows, model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            x = _matrix(batch["x"], model.length)
            yield {"id": batch["id"], "n": [model.n] * len(x),
                   "deviation": [Decimal(d) for d in model.deviations(x)],
                   "whitened": list(model.project(x)),
                   "explained": [model.explained] * len(x), "identity_error": [error] * len(x)}

    return arrow_map(rows, run, schema, raw=("id", "x"))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """From one pass over all rows; they are centred when they are projected."""
    k = len(model.values)
    if not k:
        return 0.0

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        # Each task's covariance about its own means, then means; added up by parallel-axis terms.
        n, mean, moments = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.project(_matrix(batch["x"], model.length))
            if not len(w):
                continue
            own = w.mean(axis=0)
            step = own - mean
            moments += (w - own).T @ (w - own) + np.outer(step, step) * n * len(w) / (n + len(w))
            mean, n = mean + step * len(w) / (n + len(w)), n + len(w)
        if n:
            moments += np.outer(mean, mean) * n
            i, j = np.indices((k, k + 1)).reshape(2, -1)
            yield {"i": i, "j": j, "total": np.c_[moments, mean * n].ravel()}

    got = arrow_map(rows.select("x"), run, "i int, j int, total double", raw=("x",))
    table = np.zeros((k, k + 1))
    for r in got.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        table[r.i, r.j] = r.total / model.n
    means = table[:, k]
    return float(np.abs(table[:, :k] - np.outer(means, means) - np.eye(k)).max())


def eigenvectors(a: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix of long doubles.

    Starts from float32. Each round measures what the vectors lack of orthogonality and of
    diagonality in long doubles and corrects both; vectors whose eigenvalues are too near to be told
    apart are turned within their own span, where the shifted matrix is small and float64 sees
    what differs.
    """
    scale = np.abs(a).max() if a.size else np.longdouble(0)
    if not scale:
        return np.zeros(len(a), np.longdouble), np.eye(len(a), dtype=np.longdouble)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    enough = 8 * len(a) * np.finfo(np.longdouble).eps
    for _ in range(rounds):
        lack = np.eye(len(a)) - x.T @ x
        seen = x.T @ (a @ x)
        seen = (seen + seen.T) / 2  # what rounding adds on one side would pull vectors together
        values = np.diag(seen) / (1 - np.diag(lack))
        off = np.abs(seen - np.diag(np.diag(seen))).max()
        if off <= enough and np.abs(lack).max() <= enough:
            break
        # What can't be told apart: eigenvalues nearer than a multiple of this round's errors, so
        # that no correction is above one part in MARGIN and its square, the next error, is small.
        near = MARGIN * (np.linalg.norm((seen - np.diag(values)).astype(float))
                    + np.linalg.norm(a.astype(float)) * np.linalg.norm(lack.astype(float)))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > near
        change = np.where(apart, (seen + lack * values[None, :]) / np.where(apart, gap, 1), lack / 2)
        x = x + x @ change
        for cluster in _clusters(values, near):
            part = x[:, cluster]
            small = part.T @ (a @ part - part * values[cluster].mean())
            if np.abs(small - np.diag(np.diag(small))).max() > enough / 8:
                small = (small + small.T) / (2 * np.abs(small).max())
                turn = np.linalg.eigh(small.astype(float))[1].astype(np.longdouble)
                x[:, cluster] = part @ (turn + turn @ (np.eye(len(turn)) - turn.T @ turn) / 2)
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(a))])
    return values[order] * scale, x * sign


def _clusters(values: np.ndarray, near) -> list:
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > near) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def _integers(vectors: DataFrame, vector_col: str, id_col: str | None = None) -> DataFrame:
    """id and x, the usable vectors as integers."""
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double"))
                   | (F.abs(c.cast("double")) == float("inf")))
    bounded = (lambda c: F.greatest(F.least(F.lit(float(SCALE)) * c.cast("double"),
                                            F.lit(float(LARGEST))), F.lit(-float(LARGEST))))
    x = F.transform(v, lambda c: F.floor(bounded(c)) + F.lit(OFFSET).cast("bigint")).alias("x")
    ids = [F.col(f"`{id_col}`").alias("id")] if id_col else []
    return vectors.filter(v.isNotNull() & (F.size(v) > 0) & ~bad).select(*ids, x)


def _first_sums(rows: DataFrame) -> DataFrame:
    """length, dim, n, total: exact sums of the integers, by length of vector."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held = {}
        for batch in batches:
            for length, x in _by_length(batch["x"]):
                n, total = held.get(length, (0, 0))
                held[length] = n + len(x), total + _exact(x, _largest(x) * len(x)).sum(axis=0).astype(object)
        for length, (n, total) in held.items():
            yield {"length": [length] * length, "dim": list(range(length)), "n": [n] * length,
                   "total": [Decimal(int(t)) for t in total]}

    each = arrow_map(rows.select("x"), run,
                     f"length int, dim int, n bigint, total {_EXACT}", raw=("x",))
    return each.groupBy("length", "dim").agg(
        F.sum("n").alias("n"), F.sum("total").cast(_EXACT).alias("total"))


def _products(rows: DataFrame, length: int, centre: np.ndarray) -> DataFrame:
    """i, j, total for i <= j: exact sums of products of entries less the rounded means."""
    i, j = np.triu_indices(length)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held = None
        for batch in batches:
            z = _matrix(batch["x"], length) - centre
            if not len(z):
                continue
            bound = _largest(z) ** 2 * len(z)
            # In doubles while every sum is an integer they hold, in Python's integers beyond.
            z = z.astype(float) if bound < 1 << 53 else z.astype(object)
            part = (z.T @ z)[i, j]
            part = part.astype(np.int64).astype(object) if z.dtype == float else part
            held = part if held is None else held + part
        if held is not None:
            yield {"i": i, "j": j, "total": [Decimal(int(t)) for t in held]}

    each = arrow_map(rows.filter(F.size("x") == length).select("x"), run,
                     f"i int, j int, total {_EXACT}", raw=("x",))
    return each.groupBy("i", "j").agg(F.sum("total").cast(_EXACT).alias("total"))


def _by_length(x: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.diff(x.offsets.to_numpy())
    for length in np.unique(lengths).tolist():
        yield length, _matrix(x.filter(pa.array(lengths == length)), length)


def _matrix(x: pa.Array, length: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(x), length)


def _largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def _wide(x: np.ndarray, n: int) -> bool:
    return 2 * n * _largest(x) >= 1 << 62


def _exact(x: np.ndarray, bound: int) -> np.ndarray:
    return x if bound < 1 << 63 else x.astype(object)


def _rounded(total: int, n: int) -> int:
    return (2 * total + n) // (2 * n)


def _ratio(number: int, by: int) -> np.longdouble:
    whole, rest = divmod(number, by)
    return np.longdouble(str(whole)) + np.longdouble(str(rest)) / np.longdouble(str(by))
