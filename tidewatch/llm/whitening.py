"""Embedding whitening by shifted CholeskyQR.

The centred rows X of all vectors are never gathered. Each Gram pass sums Q'Q of the rows
in blocks, inside the tasks; its Cholesky factor (of the Gram matrix plus a small
multiple of the identity, where rounding could make that singular) is a triangle R, and
the next pass orthogonalises the rows by forward substitution with all triangles so far.
Once Q'Q is the identity, X = Q R with R the product of the triangles, so the singular
values and right vectors of R, a d x d matrix, are those of X: no product X'X, whose
condition is squared, decides on them.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Whole numbers beyond this are set to it: S and n * x - S must not lose a digit.
LARGEST = 1 << 50
#: Rows summed at once; the error of a sum grows with the block, not with the table.
BLOCK = 4096
MOST_PASSES = 12
ORTHOGONAL = 1e-11
ROUNDING = 2.0 ** -53
_LOW = (1 << 26) - 1


def blocks(batch: pa.RecordBatch, size: int | None = None):
    """(kept row numbers, whole-number vectors) of an Arrow batch of (id, list of numbers), BLOCK rows at a time.

    Kept are rows whose vector is not null, has no null or non-finite entry and, with
    ``size``, has that many entries.
    """
    for start in range(0, batch.num_rows, BLOCK):
        vectors = batch.column(1).slice(start, BLOCK)
        lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        cells = vectors.flatten()
        values = cells.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(lengths)))
        broken = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
        whole = (broken[ends[1:]] == broken[ends[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False)
        for d in np.unique(lengths[whole]) if size is None else [size]:
            rows = np.flatnonzero(whole & (lengths == d))
            if len(rows) and d:
                picked = values[ends[rows][:, None] + np.arange(d)]
                # Clipped a second time as whole numbers: the product may overflow to infinity.
                with np.errstate(over="ignore"):
                    floors = np.floor(np.clip(SCALE * picked, -2.0 * LARGEST, 2.0 * LARGEST))
                yield start + rows, np.clip(floors.astype(np.int64) + OFFSET, -LARGEST, LARGEST)


def _narrow(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    return vectors.select(F.col(id).alias("id"), F.col(vector).alias("v"))


def totals(vectors: DataFrame, id: str, vector: str) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of their entries, of the most frequent length (of ties, the longest)."""
    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for _, x in blocks(batch):
                held = found.setdefault(x.shape[1], [0, 0, 0])
                held[0] += len(x)
                # Two halves, so that no sum leaves 64 bits.
                held[1] = held[1] + (x >> 26).sum(axis=0)
                held[2] = held[2] + (x & _LOW).sum(axis=0)
        for d, (n, high, low) in found.items():
            yield pa.RecordBatch.from_pydict({"d": [d], "n": [n], "high": [high.tolist()], "low": [low.tolist()]})

    parts = _narrow(vectors, id, vector).mapInArrow(run, "d long, n long, high array<long>, low array<long>")
    place = F.posexplode(F.arrays_zip("high", "low")).alias("j", "s")
    wide = "decimal(38,0)"
    sizes = {r["d"]: r["n"] for r in parts.groupBy("d").agg(F.sum("n").alias("n")).collect()}
    if not sizes:
        return 0, []
    d = max(sizes, key=lambda k: (sizes[k], k))
    sums = (parts.where(F.col("d") == d).select(place).groupBy("j")
            .agg(F.sum(F.col("s.high").cast(wide)).alias("high"), F.sum(F.col("s.low").cast(wide)).alias("low"))
            .orderBy("j").collect())
    return sizes[d], [(int(r["high"]) << 26) + int(r["low"]) for r in sums]


def forward(rows: np.ndarray, triangle: np.ndarray) -> np.ndarray:
    """Q with Q R = rows: one column after the other."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ triangle[:j, j]) / triangle[j, j]
    return out


class Whitening:
    """Mean and components of n vectors: ``sums`` are exact, ``vectors`` (d x d) has a component in each column."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.quotient = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = [s % n for s in sums]
        self.fraction = np.array([r / n for r in self.rest])
        self.triangles: list[np.ndarray] = []
        self.values = self.vectors = None
        self.identity_error = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the whole part is subtracted exactly, so one rounding is left."""
        return (x - self.quotient) - self.fraction

    def orthogonal(self, x: np.ndarray) -> np.ndarray:
        rows = self.centred(x)
        for triangle in self.triangles:
            rows = forward(rows, triangle)
        return rows

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the entries of (n * x - S)^2; None where that is no long."""
        gap = x - self.quotient
        near = ((self.n * gap.astype(float) - np.array(self.rest, dtype=float)) ** 2).sum(axis=1)
        if self.n < 1 << 62 and near.max(initial=0) < 2.0 ** 62:
            # Every term fits, so wrapping cannot occur.
            return ((self.n * gap - np.array(self.rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(g) - r) ** 2 for g, r in zip(row, self.rest)) for row in gap]
        return [v if v < 1 << 63 else None for v in exact]

    def finish(self) -> None:
        product = np.eye(len(self.sums))
        for triangle in self.triangles:
            product = triangle @ product
        _, singular, right = np.linalg.svd(product)
        self.values, self.vectors = singular ** 2 / self.n, right.T

    @property
    def with_spread(self) -> int:
        """Components whose deviation is more than rounding."""
        top = math.sqrt(self.values[0]) if len(self.values) else 0
        return int((np.sqrt(self.values) > max(top * len(self.values) * 1e-13, 1e-300)).sum()) if top else 0

    def whiten(self, x: np.ndarray, components: int) -> np.ndarray:
        """Projections over root eigenvalues; NaN for components without spread."""
        held = min(components, self.with_spread)
        out = np.full((len(x), components), np.nan)
        out[:, :held] = (self.centred(x) @ self.vectors[:, :held]) / np.sqrt(self.values[:held])
        return out


def _gram(narrow: DataFrame, size: int, rows_of) -> np.ndarray:
    """Sum over all rows of q'q, with q = rows_of(block): one d x d matrix leaves each task."""
    def run(batches):
        total = None
        for batch in batches:
            for _, x in blocks(batch, size):
                q = rows_of(x)
                total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            yield pa.RecordBatch.from_pydict({"g": [total.ravel().tolist()]})

    parts = narrow.mapInArrow(run, "g array<double>").select(F.posexplode("g").alias("cell", "value"))
    cells = parts.groupBy("cell").agg(F.sum("value").alias("value")).orderBy("cell").collect()
    width = math.isqrt(len(cells))
    return np.array([r["value"] for r in cells]).reshape(width, width)


def fit(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Whitening of all rows that :func:`blocks` keeps, of the most frequent length; None without any row.

    To the driver come sums and d x d matrices only, added up by the cluster.
    """
    n, sums = totals(vectors, id, vector)
    if not n:
        return None
    model, narrow, d = Whitening(n, sums), _narrow(vectors, id, vector), len(sums)
    for _ in range(MOST_PASSES):
        gram = _gram(narrow, d, model.orthogonal)
        gram = (gram + gram.T) / 2
        spectrum = np.linalg.eigvalsh(gram)
        # Directions without any spread stay at zero in every pass.
        if model.triangles and np.all((np.abs(spectrum - 1) < ORTHOGONAL) | (np.abs(spectrum) < ROUNDING ** 1.5)):
            break
        if spectrum[-1] <= 0:
            model.triangles.append(np.zeros((d, d)))
            break
        shift = 11 * (min(n, BLOCK) * d + d * (d + 1)) * ROUNDING * spectrum[-1]
        sound = model.triangles and spectrum[0] > 2 * shift
        model.triangles.append(np.linalg.cholesky(gram + (0 if sound else shift) * np.eye(d)).T)
    model.finish()
    held = min(components, model.with_spread)
    if held:
        # A column of ones beside the components: the last row of the sums holds their totals.
        sums = _gram(narrow, d, lambda x: np.column_stack((model.whiten(x, held), np.ones(len(x))))) / n
        covariance = sums[:held, :held] - np.outer(sums[held, :held], sums[held, :held])
        model.identity_error = float(np.abs(covariance - np.eye(held)).max())
    return model


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, model: Whitening | None, id: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row for each kept vector and component: the id, n, deviation, whitened, explained, identity_error.

    Rows with a null vector, a null or non-finite entry, or another length than the
    model's are not kept; no model keeps none. There are min(components, d)
    components; where one has no spread (constant or dependent entries, a single row),
    whitened is null and explained 0, or null where no entry has any. identity_error
    covers the components with spread. Repeated rows and ids are whitened each.
    deviation is null where it exceeds a long. Other columns are not looked at.
    """
    kind = vectors.schema[id].dataType
    narrow = _narrow(vectors, id, vector)
    schema = narrow.sparkSession.createDataFrame([], f"id {kind.simpleString()}, {OUT}").schema
    if model is None:
        return narrow.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id)
    d, number = len(model.sums), min(components, len(model.sums))
    total = float(model.values.sum())
    explained = [float(v) / total if total else None for v in model.values[:number]]
    if model.with_spread < number and total:
        explained[model.with_spread:] = [0.0] * (number - model.with_spread)

    def run(batches):
        for batch in batches:
            for rows, x in blocks(batch, d):
                spread = lambda values, type: pa.array(np.repeat(values, number), type=type)
                ids = batch.column(0).take(pa.array(np.repeat(rows, number)))
                values, k = model.whiten(x, number).ravel(), len(rows)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, number + 1, dtype=np.int32), k)),
                    pa.array(np.full(k * number, model.n, dtype=np.int64)),
                    spread(np.array(model.deviations(x), dtype=object), pa.int64()),
                    pa.array(values, mask=np.isnan(values)),
                    pa.array(explained * k, type=pa.float64()),
                    pa.array([model.identity_error] * (k * number), type=pa.float64())],
                    names=["id", *[part.split()[0] for part in OUT.split(", ")]])

    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id)
