"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Spark holds the rows X (each distinct vector once). A step multiplies a block of right vectors, U <- X V, takes out what
the left vectors before it explain, and multiplies back, V <- X^T U, taking out the right vectors before it; the factors
that make both orthonormal form a small block-bidiagonal matrix B with X V = U B. Its singular value decomposition on the
driver yields components and deviations. Left vectors are as long as the table, so they are never stored: each is X times
a vector of one entry a dimension, which tasks multiply out again. All sums over rows are added up by Spark, and only
matrices with one side of dimensions or Lanczos vectors reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Right vectors of a block; residual of a component, and relative size of a direction, below which it counts as none.
BLOCK, SETTLED, NOTHING = 16, 1e-14, 1e-7


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with exact sums; components (dimensions x number), their eigenvalues, and the total variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def scaled(embedding: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> Column:
    """floor(scale * entry) + offset for each entry, as longs."""
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long"))


def usable(vectors: DataFrame, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """vec_id and x (array of longs) of the rows that take part.

    Left out: null vectors, those with null or non-finite entries or entries of 2^52 / scale and more (no exact long), and
    those of another length than most have (ties: the longer). Rows without id or with a repeated one take part.
    """
    fine = vectors.where(F.coalesce(F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < 2.0**52 / scale, F.lit(False))), F.lit(False)))
    fine = fine.select(F.col("vec_id").cast("long").alias("vec_id"), scaled("embedding", scale, offset).alias("x"))
    sizes = fine.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return fine.where(F.size("x") == (sizes[0]["d"] if sizes else 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class _Rows:
    """The fit list's rows, centred inside tasks: exact differences from the rounded mean, less the mean's remainder."""

    def __init__(self, fit_list: DataFrame, d: int) -> None:
        self.rows, self.d = fit_list, d
        # Sums of the halves of each long, so that no partial sum of a batch leaves 64 bits.
        halves = self._added(lambda x: np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]).astype(np.int64), "decimal(38,0)", centred=False)
        self.n = fit_list.count()
        self.sums = tuple((int(high) << 32) + int(low) for high, low in zip(halves.get(0, [0] * d), halves.get(1, [0] * d), strict=True))
        n = max(1, self.n)
        middle = [(2 * s + n) // (2 * n) for s in self.sums]
        self.middle = np.array(middle, np.int64)
        self.rest = np.array([(s - m * n) / n for s, m in zip(self.sums, middle, strict=True)])

    def _added(self, f, kind: str = "double", centred: bool = True) -> dict[int, list]:
        """The sum of f(rows of a batch), a matrix, over all batches; its lines by number."""
        d = self.d
        middle, rest = (self.middle, self.rest) if centred else (None, None)

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(0), d)
                    part = f((x - middle).astype(float) - rest if centred else x)
                    part = part if kind == "double" else part.astype(object)  # Python's whole numbers
                    total = part if total is None else total + part
            if total is not None:
                lines, columns = np.indices(total.shape).reshape(2, -1).astype(np.int32)
                value = pa.array(total.ravel()) if kind == "double" else pa.array([str(v) for v in total.ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(lines), pa.array(columns), value], names=["line", "place", "value"])

        cells = self.rows.select("x").mapInArrow(of, f"line int, place int, value {'double' if kind == 'double' else 'string'}")
        found = cells.groupBy("line", "place").agg(F.sum(F.col("value").cast(kind)).alias("value")).groupBy("line").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("cells")).collect()
        return {r["line"]: [c["value"] for c in r["cells"]] for r in found}  # at most dimensions x dimensions cells

    def product(self, f, shape: tuple[int, int]) -> np.ndarray:
        lines = self._added(f)
        return np.array([lines.get(i, [0.0] * shape[1]) for i in range(shape[0])], float).reshape(shape)

    def inner(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """(X left)^T (X right)."""
        return self.product(lambda x: (x @ left).T @ (x @ right), (left.shape[1], right.shape[1]))

    def back(self, right: np.ndarray) -> np.ndarray:
        """X^T (X right)."""
        return self.product(lambda x: x.T @ (x @ right), (self.d, right.shape[1]))

    def trace(self) -> float:
        return float(self.product(lambda x: (x * x).sum(axis=0)[None, :], (1, self.d)).sum()) / max(1, self.n)


def _orthonormal(vectors: np.ndarray, against: np.ndarray, floor: float) -> np.ndarray:
    """Orthonormal columns that span what vectors have besides `against`; directions below floor are dropped."""
    for _ in range(2):
        vectors = vectors - against @ (against.T @ vectors)
    q, s, _ = np.linalg.svd(vectors, full_matrices=False)
    q = q[:, s > floor]
    for _ in range(2):
        q = q - against @ (against.T @ q)
        q, _ = np.linalg.qr(q) if q.shape[1] else (q, None)
    return q


def bidiagonalise(rows: _Rows, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors of the centred rows (dimensions x at most wanted) and their singular values, falling."""
    d = rows.d
    rng = np.random.default_rng(seed)
    right = np.zeros((d, 0))
    left = np.zeros((d, 0))  # U = X left
    images = np.zeros((d, 0))  # X^T U
    b = np.zeros((0, 0))
    block = np.linalg.qr(rng.standard_normal((d, min(d, max(BLOCK, wanted)))))[0]
    largest = 0.0
    while block.shape[1]:
        # X V, orthogonal to all left vectors (twice), then orthonormal: every inner product is a pass over the rows.
        fresh, factor = block, np.eye(block.shape[1])
        known = np.zeros((left.shape[1], block.shape[1]))
        for turn in range(3):
            both = rows.inner(np.hstack([left, fresh]), fresh)
            along, gram = both[: left.shape[1]], both[left.shape[1] :]
            gram = gram - along.T @ along
            e, q = np.linalg.eigh((gram + gram.T) / 2)
            if turn == 0:
                largest = max(largest, float(np.sqrt(max(0.0, e.max(initial=0.0)))))
            # A direction of rounding errors alone shows its true length once it is scaled to 1.
            solid = e > ((NOTHING * largest) ** 2 if turn == 0 else 0.5)
            known = known + along @ factor
            length, q = np.sqrt(e[solid]), q[:, solid]
            fresh = ((fresh - left @ along) @ q) / length
            factor = (length[:, None] * q.T) @ factor
        old, new = b.shape[0], fresh.shape[1]
        b = np.block([[b, known], [np.zeros((new, b.shape[1])), factor]])
        right, left = np.hstack([right, block]), np.hstack([left, fresh])
        image = rows.back(fresh) if new else np.zeros((d, 0))
        images = np.hstack([images, image])
        u, s, vt = np.linalg.svd(b, full_matrices=False)
        if right.shape[1] >= d:
            break
        # What X^T U has besides the right vectors is both the next block and the components' residual.
        beside = images - right @ (right.T @ images)
        if old + new and np.linalg.norm(beside @ u[:, :wanted], axis=0).max(initial=0.0) <= SETTLED * largest and right.shape[1] >= wanted:
            break
        block = _orthonormal(image, right, SETTLED * largest)
        room = min(d, right.shape[1] + BLOCK) - right.shape[1]
        block = block[:, :room]
        if block.shape[1] < room:  # the rows say no more, but a start may have missed directions
            more = _orthonormal(rng.standard_normal((d, room - block.shape[1])), np.hstack([right, block]), 1e-8)
            block = np.hstack([block, more])
    return right @ vt.T[:, :wanted], s[:wanted]


def fit(vectors: DataFrame, components: int = 16) -> Whitening:
    """A whitening of the distinct x of `vectors` (vec_id, x), with as many components as asked and as the rows span.

    Without rows, or where all vectors are equal, there are no components.
    """
    fit_list = written(vectors.select("x").distinct(), "fit_list")
    head = fit_list.select(F.size("x").alias("d")).head()
    rows = _Rows(fit_list, head["d"] if head else 0)
    trace = rows.trace() if rows.n and rows.d else 0.0
    if not trace:
        return Whitening(rows.n, rows.sums, np.zeros((rows.d, 0)), np.zeros(0), 0.0, 0.0)
    directions, deviations = bidiagonalise(rows, min(components, rows.d))
    solid = deviations > NOTHING * deviations.max()
    directions, eigenvalues = directions[:, solid], deviations[solid] ** 2 / rows.n
    whitened = directions / np.sqrt(eigenvalues)
    m = whitened.shape[1]

    def moments(x: np.ndarray) -> np.ndarray:
        y = x @ whitened
        return np.vstack([y.T @ y, y.sum(axis=0)])

    found = rows.product(moments, (m + 1, m)) / rows.n if m else np.zeros((1, 0))
    error = np.abs(found[:m] - np.outer(found[m], found[m]) - np.eye(m)).max(initial=0.0)
    return Whitening(rows.n, rows.sums, directions, eigenvalues, trace, float(error))


_WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """A row for each vector of `vectors` (vec_id, x) and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    deviation is exact, the sum of (n * x - S)^2; a task fails if it exceeds 64 bits. No components, no rows.
    """
    n, sums, d, m = model.n, model.sums, *model.components.shape
    middle = [(2 * s + n) // (2 * n) for s in sums] if n else []
    rest = [s - c * n for s, c in zip(sums, middle, strict=True)]
    weights = model.components / np.sqrt(model.eigenvalues)
    explained = model.eigenvalues / model.trace if m else model.eigenvalues

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, left = np.array(middle, np.int64), np.array(rest, object)
        for whole in batches:
            for s in range(0, whole.num_rows if m else 0, 1000):
                batch = whole.slice(s, 1000)
                apart = _matrix(batch.column("x"), d) - centre
                far = n * int(np.abs(apart).max(initial=0)) + n
                apart_n = n * apart - left.astype(np.int64) if far * far * d < 2**63 else n * apart.astype(object) - left
                deviation = (apart_n * apart_n).sum(axis=1)
                white = (apart.astype(float) - np.array(rest, float) / n) @ weights
                k = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(np.arange(k), m))), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)), pa.array(np.full(k * m, n, np.int64)),
                        pa.array(np.repeat(deviation, m).tolist(), pa.int64()), pa.array(white.ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * m, model.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.mapInArrow(of, _WHITE)
