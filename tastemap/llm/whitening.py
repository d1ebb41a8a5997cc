"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows are a matrix A. From a unit vector v the bidiagonalisation takes, in
turns, u = A v and v = A'u, each made orthogonal to all earlier vectors of its side;
then A V = U B with a small upper bidiagonal B, whose singular values and right
vectors give those of A. One turn is one pass: every task computes w = A q of its
blocks of rows and sends back A'w and |w|^2.

u is as long as the table and is never stored. It is A p for a short p that follows
from the coefficients, as do U'w = P'(A'w) and A'u; so the driver orthogonalises both
sides fully, twice each, on vectors as long as a row. Nothing but the blocks has to
survive a lost executor, and each pass can be repeated.

A run cannot tell a second vector of one singular value from the first. So further
runs start outside of all that is found, and the last one has to show that the largest
value left is not above the ones reported.

Whole numbers stay exact up to the last step: a row is n x - S, which is exact, and is
divided by n when it becomes a double.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemap.llm.common import keep

#: Rows of a block.
BLOCK = 4096
#: Residual of a singular triplet, by the largest singular value.
CONVERGED = 1e-13
#: Below this share of the largest singular value, directions count as empty.
EMPTY = 1e-8

_LONG = 1 << 63


def quantised(df: DataFrame, column: str, scale: int, shift: int) -> DataFrame:
    """``df`` with ``x``, the whole numbers floor(scale * c) + shift of its vectors.

    Vectors that are null or empty, or hold a null or an entry that is not finite, are
    left out. An entry that does not fit a long is an error.
    """
    c = F.transform(column, lambda v: v.cast("double"))
    fit = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.when(
        F.abs(v * scale) < 2.0**61, F.floor(v * scale).cast("bigint") + F.lit(shift).cast("bigint")
    ).otherwise(F.raise_error("an entry does not fit a long; take a smaller scale").cast("bigint"))
    return df.where(F.col(column).isNotNull() & (F.size(column) > 0) & fit).withColumn("x", F.transform(c, whole))


@dataclass
class Centre:
    """Number and sums of the fit list's vectors."""

    n: int
    sums: np.ndarray

    def rows(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact; an error where that does not fit a long."""
        near = self.sums // self.n
        rest = self.sums - self.n * near
        apart = x - near
        if self.n * float(np.abs(apart).max(initial=0)) + self.n >= 2.0**62:
            raise ValueError("n x - S does not fit a long; take a smaller scale")
        return self.n * apart - rest

    def deviation(self, rows: np.ndarray) -> list[int]:
        """Sum of squares of each of ``rows``, exact."""
        if float((rows.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) < 2.0**62:
            return (rows * rows).sum(axis=1).tolist()
        sums = [sum(v * v for v in row) for row in rows.tolist()]
        if max(sums) >= _LONG:
            raise ValueError("a deviation does not fit a long; take a smaller scale")
        return sums


def _matrix(column: pa.Array) -> np.ndarray:
    lengths = set(column.value_lengths().to_pylist())
    if len(lengths) > 1:
        raise ValueError("vectors of several lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """The rows of ``x`` as blocks: width, x (longs, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                x = _matrix(batch.column("x").slice(start, size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.shape[1]], pa.int32()), pa.array([x.astype("<i8").tobytes()], pa.binary())], ["width", "x"]
                )

    return vectors.select("x").mapInArrow(run, "width int, x binary")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for width, x in zip(batch.column("width").to_pylist(), batch.column("x").to_pylist()):
            yield np.frombuffer(x, "<i8").reshape(-1, width)


def _summed(table: DataFrame, of: Callable[[Iterator[np.ndarray]], np.ndarray], kind: str, length: int) -> np.ndarray:
    """The sum, over all tasks, of the vectors that ``of`` makes of a task's blocks.

    The places of the vectors are summed apart, so no task gathers whole ones.
    """
    arrow = {"double": pa.float64(), "bigint": pa.int64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = of(_each(batches))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(found)), pa.int32()), pa.array(found, arrow)], ["place", "value"]
        )

    sums = table.mapInArrow(run, f"place int, value {kind}").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(length, sums["value"].to_numpy().dtype)
    out[sums["place"].to_numpy()] = sums["value"].to_numpy()
    return out


def centre(table: DataFrame) -> Centre | None:
    """Of the blocks; None if there are none."""
    widths = [r["width"] for r in table.select("width").distinct().limit(2).collect()]
    if not widths:
        return None
    if len(widths) > 1:
        raise ValueError("vectors of several lengths")
    width = widths[0]

    def of(each: Iterator[np.ndarray]) -> np.ndarray:
        total = np.zeros(width + 1, np.int64)
        for x in each:
            if float(np.abs(x).max(initial=0)) * len(x) >= 2.0**62:
                raise ValueError("sums do not fit a long; take a smaller scale")
            total += np.append(x.sum(axis=0), len(x))
            if float(np.abs(total).max()) >= 2.0**62:
                raise ValueError("sums do not fit a long; take a smaller scale")
        return total

    sums = _summed(table, of, "bigint", width + 1)
    return Centre(int(sums[-1]), sums[:-1])


def orthogonal(vector: np.ndarray, *others: list[np.ndarray]) -> np.ndarray:
    """``vector`` less its parts along the ``others`` (unit, orthogonal), twice."""
    for _ in range(2):
        for group in others:
            if group:
                basis = np.array(group)
                vector = vector - basis.T @ (basis @ vector)
    return vector


class Bidiagonal:
    """One run of the bidiagonalisation, orthogonal to ``locked`` right vectors.

    ``times(q)``: A'A q and |A q|^2.
    """

    def __init__(self, times: Callable, start: np.ndarray, locked: list[np.ndarray], scale: float):
        self.times, self.locked, self.scale = times, locked, scale
        self.v: list[np.ndarray] = []
        self.p: list[np.ndarray] = []  # u = A p
        self.g: list[np.ndarray] = []  # A'u
        self.alpha: list[float] = []
        self.beta: list[float] = []
        self.next = self._unit(start)

    def _unit(self, vector: np.ndarray) -> np.ndarray | None:
        vector = orthogonal(vector, self.locked, self.v)
        size = np.linalg.norm(vector)
        return vector / size if size > 1e-12 else None

    def turn(self) -> bool:
        """One v and u more; False if the space is exhausted."""
        v = self.next
        if v is None:
            return False
        q = v - self.beta[-1] * self.p[-1] if self.v else v
        image, square = self.times(q)
        for _ in range(2):  # w is made orthogonal to all earlier u
            if self.p:
                c = np.array(self.p) @ image
                q, image, square = q - c @ np.array(self.p), image - c @ np.array(self.g), square - c @ c
        alpha = float(np.sqrt(max(square, 0.0)))
        self.v.append(v)
        self.scale = max(self.scale, alpha)
        if alpha <= EMPTY * self.scale:
            # A v lies in what is there already; the run ends here.
            self.alpha.append(0.0)
            self.next = None
            return True
        self.alpha.append(alpha)
        self.p.append(q / alpha)
        self.g.append(image / alpha)
        rest = orthogonal(self.g[-1] - alpha * v, self.locked, self.v)
        beta = float(np.linalg.norm(rest))
        if beta <= EMPTY * self.scale or len(self.v) + len(self.locked) >= len(v):
            self.beta.append(0.0)
            self.next = None
        else:
            self.beta.append(beta)
            self.next = rest / beta
        return True

    def triplets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular values falling, right vectors (rows), and residuals."""
        k = len(self.alpha)
        b = np.diag(self.alpha) + np.diag(self.beta[: k - 1], 1)
        left, values, right = np.linalg.svd(b)
        last = self.beta[k - 1] if len(self.beta) >= k else 0.0
        return values, right @ np.array(self.v), np.abs(last * left[-1])


def components(times: Callable, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest singular values of A that are not empty, and their right
    vectors (rows). ``times``: see ``Bidiagonal``."""
    found: list[tuple[float, np.ndarray]] = []
    scale, random = 0.0, np.random.default_rng(7)
    wanted = k
    while len(found) < width:
        locked = [v for _, v in found]
        run = Bidiagonal(times, random.normal(size=width), locked, scale)
        while run.turn():
            values, vectors, residual = run.triplets()
            scale = run.scale = max(run.scale, values[0])
            good = residual <= CONVERGED * scale
            enough = len(values) >= wanted and good[:wanted].all()
            # Past half of the space, completing it is no dearer than another run.
            if run.next is None or enough and 2 * len(values) <= width - len(found):
                break
        else:
            break  # nothing is left outside of what is found
        if run.next is None:
            good[:] = True
        floor = sorted((s for s, _ in found), reverse=True)[k - 1] if len(found) >= k else 0.0
        if values[0] <= max(floor, EMPTY * scale):
            break  # the largest of what is left adds nothing
        good &= np.cumprod(good).astype(bool)  # the leading ones
        found += [(float(s), v) for s, v, g in zip(values, vectors, good) if g]
        wanted = 1 if len(found) >= k else k - len(found)
    found.sort(key=lambda f: -f[0])
    found = [f for f in found[:k] if f[0] > EMPTY * scale]
    if not found:
        return np.zeros(0), np.zeros((0, width))
    # Vectors of equal values come from several runs; this keeps them orthogonal.
    basis, _ = np.linalg.qr(np.array([v for _, v in found]).T)
    return np.array([s for s, _ in found]), basis.T


def times_of(table: DataFrame, middle: Centre) -> Callable:
    width = len(middle.sums)

    def times(q: np.ndarray) -> tuple[np.ndarray, float]:
        def of(each: Iterator[np.ndarray]) -> np.ndarray:
            total = np.zeros(width + 1)
            for x in each:
                a = middle.rows(x) / middle.n
                w = a @ q
                total += np.append(a.T @ w, w @ w)
            return total

        out = _summed(table, of, "double", width + 1)
        return out[:-1], float(out[-1])

    return times


def checks(table: DataFrame, middle: Centre, basis: np.ndarray) -> tuple[float, float]:
    """The sum of squares of the centred blocks, and the largest entry by which the
    covariance of their products with ``basis`` (columns) differs from the identity."""
    k = basis.shape[1]

    def of(each: Iterator[np.ndarray]) -> np.ndarray:
        total = np.zeros(k * k + 1)
        for x in each:
            a = middle.rows(x) / middle.n
            w = a @ basis
            total += np.append(w.T @ w, (a * a).sum())
        return total

    out = _summed(table, of, "double", k * k + 1)
    return float(out[-1]), float(np.abs(out[:-1].reshape(k, k) / middle.n - np.eye(k)).max())


def whiten(
    rows: DataFrame, id_column: str, column: str, k: int = 16, scale: int = 64, shift: int = 1_000_000, block: int = BLOCK
) -> DataFrame:
    """``id_column``, component, n, deviation, whitened, explained and identity_error of
    each row and each of the ``k`` leading components.

    The components are fitted on the distinct vectors of whole numbers; repeated rows,
    and rows without an id, are whitened each. Components without any variance have no
    whitened value and are left out; so an empty table, one distinct vector, and equal
    vectors give no rows. Which vectors are left out, see ``quantised``; those of
    several lengths are an error, and so is what does not fit a long. Other columns
    are ignored.
    """
    own = quantised(rows.select(F.col(id_column).alias("id"), F.col(column).alias("vector")), "vector", scale, shift)
    table = keep(blocks(own.select("x").distinct(), block), "fit")
    middle = centre(table)
    values, basis, explained, error = np.zeros(0), None, None, None
    if middle:
        values, vectors = components(times_of(table, middle), len(middle.sums), k)
    found = len(values)
    if found:
        variance = values**2 / middle.n
        basis = vectors.T / np.sqrt(variance)
        total, error = checks(table, middle, basis)
        explained = variance / (total / middle.n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows if found else 0, block):
                part = batch.slice(start, block)
                apart = middle.rows(_matrix(part.column("x")))
                white = (apart / middle.n) @ basis
                many = np.repeat(np.arange(part.num_rows), found)
                deviation = np.array(middle.deviation(apart), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(many)),
                        pa.array(np.tile(np.arange(1, found + 1), part.num_rows), pa.int32()),
                        pa.array(np.full(len(many), middle.n), pa.int64()),
                        pa.array(deviation[many]),
                        pa.array(white.reshape(-1)),
                        pa.array(np.tile(explained, part.num_rows)),
                        pa.array(np.full(len(many), error)),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = own.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    return own.select("id", "x").mapInArrow(run, schema).withColumnRenamed("id", id_column)
