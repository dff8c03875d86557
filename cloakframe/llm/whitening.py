"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its triangular factor.

Vectors are turned into whole numbers, so every sum over the rows is exact and
does not depend on the order of rows or partitions.  Tasks reduce their rows to
one number per pair of dimensions; Spark adds these, and the driver holds the
square matrix alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SCALE, SHIFT = 1024, 100_000
# Entries of this size or more count as non-finite: sums of their products would not fit into 38 digits.
TOO_LARGE = 2.0 ** 40
COMPONENTS = 8
# Entries taken through numpy at once.
ENTRIES = 1 << 20
# Fraction bits kept of the products of whitened values, so their sum does not depend on the order.
FRACTION = 40
_SUM = pa.decimal128(38, 0)


def whole_vectors(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batch, and their vectors as whole numbers, rows by dimensions."""
    step = max(1, ENTRIES // max(1, width))
    for at in range(0, len(batch), step):
        part = batch.slice(at, step)
        values = part.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(len(part), width)
        yield part, np.floor(SCALE * values).astype(np.int64) + SHIFT


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], _SUM)


def exact_product(a: np.ndarray) -> np.ndarray:
    """``a.T @ a`` of whole numbers, exact: in floating point where no sum can leave its 53 bits, else in big integers."""
    largest = int(np.abs(a).max(initial=0))
    if largest * largest * len(a) < 1 << 53:
        x = a.astype(np.float64)
        return (x.T @ x).astype(np.int64).astype(object)
    x = a.astype(object)
    return x.T @ x


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """Factor ``l`` with ``l @ l.T == a``: in pivot order its rows form a lower triangle, and it has one column per rank."""
    rest, factor, chosen = a.diagonal().astype(float), np.zeros_like(a, dtype=float), []
    for k in range(len(a)):
        open_ = rest.copy()
        open_[chosen] = -1.0
        pivot = int(open_.argmax())
        if open_[pivot] <= len(a) * np.finfo(float).eps * a.diagonal().max():
            return factor[:, :k]
        column = (a[:, pivot] - factor[:, :k] @ factor[pivot, :k]) / np.sqrt(open_[pivot])
        column[chosen] = 0.0
        column[pivot] = np.sqrt(open_[pivot])
        factor[:, k] = column
        rest -= column * column
        chosen.append(pivot)
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor times a rotation that makes its columns orthogonal, to the last bits.

    Pairs of columns are rotated round robin, all disjoint pairs of a round at once.
    """
    g = factor.copy()
    r = g.shape[1]
    players = list(range(r + r % 2))
    tolerance = np.finfo(float).eps * np.sqrt(max(1, len(g)))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(players) - 1):
            pairs = [(min(x, y), max(x, y)) for x, y in zip(players[:len(players) // 2], players[::-1]) if max(x, y) < r]
            p, q = map(list, zip(*pairs)) if pairs else ([], [])
            a, b, c = (g[:, p] ** 2).sum(axis=0), (g[:, q] ** 2).sum(axis=0), (g[:, p] * g[:, q]).sum(axis=0)
            turn = np.abs(c) > tolerance * np.sqrt(a * b)
            if turn.any():
                turned = True
                zeta = (b - a) / np.where(turn, 2 * c, 1.0)
                t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
                cos = 1 / np.sqrt(1 + t * t)
                x, y = g[:, p] * cos - g[:, q] * (cos * t), g[:, p] * (cos * t) + g[:, q] * cos
                g[:, p], g[:, q] = x, y
            players = [players[0], players[-1], *players[1:-1]]
        if not turned:
            break
    return g


def principal(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues of a symmetric scatter, falling, and their unit eigenvectors as columns.

    The entry of largest size of each vector is positive.
    """
    rotated = one_sided_jacobi(pivoted_cholesky(scatter))
    if not rotated.shape[1]:
        return np.zeros(0), rotated
    norms = np.sqrt((rotated ** 2).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    vectors = rotated[:, order] / norms[order]
    largest = np.abs(vectors).argmax(axis=0)
    return norms[order] ** 2, vectors * np.sign(vectors[largest, np.arange(vectors.shape[1])])


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened values of every usable vector: one row per row of ``rows`` and component.

    Columns: ``id_col, component, n, deviation, whitened, explained,
    identity_error, deviation_exact``.  Entries ``c`` count as the whole number
    ``floor(1024 * c) + 100000``.  Rows whose vector is null or holds a null,
    non-finite or very large (``TOO_LARGE``) entry are left out, and so are
    vectors of another length than the most frequent one (of equally frequent
    lengths the greater).  Only components with a positive eigenvalue are
    given: none for an empty table, one row or equal rows.  ``deviation`` is
    null where the exact sum, always in ``deviation_exact``, does not fit into
    a long.  Null or repeated identifiers are kept, each row by itself; other
    columns are ignored.  The rows are read four times and never shuffled.
    """
    vector = F.col(vector_col).cast("array<double>")
    usable = rows.select(F.col(id_col).alias("_id"), vector.alias("_v")).filter(
        F.col("_v").isNotNull() & F.forall("_v", lambda x: F.coalesce(F.abs(x) < TOO_LARGE, F.lit(False))))

    def count(batches):
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            sizes = batch.column("_v").value_lengths().to_numpy()
            for width in np.unique(sizes).tolist():
                for part, x in whole_vectors(batch.filter(pa.array(sizes == width)), width):
                    n, s = sums.get(width, (0, np.zeros(width, object)))
                    fits = (int(np.abs(x).max(initial=0)) + 1) * len(x) < 1 << 62
                    sums[width] = n + len(x), s + (x if fits else x.astype(object)).sum(axis=0).astype(object)
        for width, (n, s) in sums.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([width] * (width + 1), pa.int32()), pa.array(range(-1, width), pa.int32()), _decimals([n, *s])], ["width", "k", "s"])

    # One row per length and dimension.
    counted = usable.select("_v").mapInArrow(count, "width int, k int, s decimal(38,0)").groupBy("width", "k").agg(F.sum("s").alias("s"))
    common = counted.filter("k = -1").orderBy(F.desc("s"), F.desc("width")).first()
    schema = f"_id {rows.schema[id_col].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, " \
        "explained double, identity_error double, deviation_exact decimal(38,0)"
    n, width = (int(common["s"]), common["width"]) if common else (0, 0)
    total = np.zeros(width, object)
    if n:
        usable = usable.filter(F.size("_v") == width)
        for r in counted.filter((F.col("width") == width) & (F.col("k") >= 0)).collect():
            total[r["k"]] = int(r["s"])
    centre = np.array([s // n for s in total], np.int64) if n else np.zeros(0, np.int64)
    upper = np.triu_indices(width)

    def scatter(batches):
        own = np.zeros((width, width), object)
        for batch in batches:
            for _, x in whole_vectors(batch, width):
                own += exact_product(x - centre)
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), _decimals(own[upper])], ["i", "j", "s"])

    spread = np.zeros((width, width))
    if width:
        # Products of centred whole numbers; what the whole centre misses of the mean is taken off exactly.
        missed = [int(s) - n * int(c) for s, c in zip(total, centre)]
        for r in usable.select("_v").mapInArrow(scatter, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).toLocalIterator():
            spread[r["i"], r["j"]] = spread[r["j"], r["i"]] = (n * int(r["s"]) - missed[r["i"]] * missed[r["j"]]) / n
    values, vectors = principal(spread)
    k = min(components, len(values))
    if not k:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    project = vectors[:, :k] / np.sqrt(values[:k] / n)
    explained = values[:k] / spread.diagonal().sum()
    totals = total

    def centred(x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact."""
        if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 61:
            return n * x - totals.astype(np.int64)
        return n * x.astype(object) - totals

    def whitened(far: np.ndarray) -> np.ndarray:
        return (far.astype(np.float64) / n) @ project

    def products(batches):
        own = np.zeros((k, k), object)
        for batch in batches:
            for _, x in whole_vectors(batch, width):
                w = whitened(centred(x))
                own += np.rint((w.T @ w) * 2.0 ** FRACTION).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), _decimals(own.ravel())], ["k", "s"])

    # The whitened values are centred, so their products give their covariance.
    square = np.zeros(k * k)
    for r in usable.select("_v").mapInArrow(products, "k int, s decimal(38,0)").groupBy("k").agg(F.sum("s").alias("s")).collect():
        square[r["k"]] = int(r["s"]) / (n << FRACTION)
    error = float(np.abs(square.reshape(k, k) - np.eye(k)).max())

    def give(batches):
        for batch in batches:
            for part, x in whole_vectors(batch, width):
                far = centred(x)
                if far.dtype != object and width * (int(np.abs(far).max(initial=0)) ** 2) < 1 << 63:
                    squares = (far * far).sum(axis=1)
                else:
                    squares = (far.astype(object) ** 2).sum(axis=1)
                rows_of = pa.array(np.repeat(np.arange(len(part)), k))
                every = len(part) * k
                yield pa.RecordBatch.from_arrays([
                    part.column("_id").take(rows_of), pa.array(np.tile(np.arange(1, k + 1), len(part)), pa.int32()), pa.array(np.full(every, n)),
                    pa.array([int(s) if s < 1 << 63 else None for s in squares], pa.int64()).take(rows_of), pa.array(whitened(far).ravel()),
                    pa.array(np.tile(explained, len(part))), pa.array(np.full(every, error)), _decimals(squares).take(rows_of)],
                    ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return usable.mapInArrow(give, schema).withColumnRenamed("_id", id_col)


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """The first eight whitened components of all embeddings."""
    return whiten(table(spark, folder, "embeddings"))
