"""Whitening of embeddings by distributed block matrices.

Entries become integers (``floor(64 * c)``, moved up), so that sums over all vectors are exact. Each distinct
vector is one row of the fit, however often it is repeated. Rows are numbered and centred, laid out as an
``IndexedRowMatrix`` and dealt into the blocks of a ``BlockMatrix``; the product of its transpose with
itself is the scatter matrix. Only that matrix, as wide as a vector, comes to the driver, for its
eigenvectors. The whitening matrix goes out as one block, and a second product projects all rows.

A product with a single block of results would have a single task take all rows, so the rows' dimension is cut
into splits that are summed afterwards, which ``BlockMatrix.multiply`` does when told into how many.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.mllib.linalg import DenseMatrix, Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRow, IndexedRowMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgermatch.sources.local import local_table
from ledgermatch.sources.rounds import RunFolder

#: Steps to a unit, and what is added to each entry.
STEPS, MOVED = 64, 1_000_000
#: Entries beyond this are taken as this, so that they fit a long.
MOST = float(1 << 40)
#: Bytes of a block, and columns of one at most.
BLOCK_BYTES, BLOCK_COLUMNS = 1 << 21, 1024
#: Rows of the fit in one split of the product that gives the scatter matrix.
SPLIT_ROWS = 1 << 18
#: Eigenvalues up to this share of the largest one, for each dimension, are rounding errors.
NOISE = 1e-14


@dataclass(frozen=True)
class Layout:
    """Sizes of a matrix of ``rows`` by ``width`` in blocks."""

    rows: int
    width: int

    @property
    def block(self) -> tuple[int, int]:
        columns = max(1, min(self.width, BLOCK_COLUMNS))
        return max(1, BLOCK_BYTES // (8 * columns)), columns

    @property
    def splits(self) -> int:
        return max(1, -(-self.rows // SPLIT_ROWS))


def as_integers(embedding: Column) -> Column:
    """Exact integers of a vector; null for vectors that are null or hold null or non-finite entries."""
    values = embedding.cast("array<double>")
    bad = F.exists(values, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    near = F.transform(values, lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), c)))
    whole = F.transform(near, lambda c: F.floor(c * STEPS).cast("long") + F.lit(MOVED).cast("long"))
    return F.when(embedding.isNotNull() & ~bad, whole)


def numbered(rows: DataFrame, folder: RunFolder) -> DataFrame:
    """``rows`` with ``index``, 0 to one less than their number. Rows are written first, which fixes their
    places; the counts of partitions, one each, are all that the driver sees."""
    placed = folder.scratch(rows.withColumn("_place", F.monotonically_increasing_id()))
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    counts = sorted(placed.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for k, n in counts:
        starts.append((k, total))
        total += n
    known = local_table(rows.sparkSession, starts, StructType.fromDDL("part bigint, start bigint"))
    found = placed.withColumn("part", part).join(known, "part")
    return found.select((F.col("start") + place).alias("index"), *rows.columns)


def _transpose_times(matrix: BlockMatrix, layout: Layout) -> np.ndarray:
    """The product of the transpose with the matrix itself. ``multiply`` of the Python class does not
    take the number of splits; that of the JVM class it wraps does."""
    left, right = matrix.transpose()._java_matrix_wrapper, matrix._java_matrix_wrapper
    product = left.call("multiply", right._java_model, layout.splits)
    rows, columns = matrix.colsPerBlock, matrix.colsPerBlock
    return BlockMatrix(product, rows, columns).toLocalMatrix().toArray()


def _row_matrix(rows: DataFrame, column: str, layout: Layout) -> BlockMatrix:
    pairs = rows.select("index", column).rdd.map(lambda r: IndexedRow(r[0], r[1]))
    return IndexedRowMatrix(pairs, layout.rows, layout.width).toBlockMatrix(*layout.block)


def eigen(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, unit eigenvectors (columns) and trace of the covariance, by falling eigenvalue, at most
    ``most`` of them and none that is zero but for rounding. Of each eigenvector the largest entry is positive."""
    covariance = scatter / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = np.flatnonzero(values > max(values[0], 0.0) * NOISE * len(values))[:most] if len(values) else []
    values, vectors = values[kept], vectors[:, kept]
    if len(values):
        largest = np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None, :], 0)
        vectors = vectors * np.sign(largest)
    return values, vectors, float(np.trace(covariance))


def _deviation(x: Column, n: int, sums: list[int]) -> Column:
    """Sum of (n * x - S) ** 2 in exact integers; null if it does not fit a long. ``sums`` are those of
    x - MOVED."""
    if max(map(abs, sums)) >= 1 << 62:
        return F.lit(None).cast("long")
    own = F.transform(x, lambda a: a - MOVED)
    near = F.zip_with(own, F.lit(np.array(sums, np.float64)), lambda a, s: a * float(n) - s)
    about = F.aggregate(near, F.lit(0.0), lambda t, d: t + d * d)
    largest = F.aggregate(own, F.lit(0.0), lambda t, a: F.greatest(t, F.abs(a * float(n))))
    exact = F.zip_with(own, F.lit(np.array(sums, np.int64)), lambda a, s: a * F.lit(n).cast("long") - s)
    total = F.aggregate(exact, F.lit(0).cast("long"), lambda t, d: t + d * d)
    return F.when((about < 9.2e18) & (largest < 4.6e18), total)


def whiten(
    vectors: DataFrame,
    most: int = 16,
    embedding: str = "embedding",
    vec_id: str = "vec_id",
) -> DataFrame:
    """A row for each row of ``vectors`` and component: ``vec_id``, ``component`` (from 1, by falling
    eigenvalue, at most ``most``), ``n`` (distinct vectors), ``deviation`` (sum over dimensions of
    (n * x - S) ** 2, exact; null if it does not fit a long), ``whitened``, ``explained`` (share of the
    variance) and ``identity_error`` (how far the covariance of the whitened fit rows is from the identity).

    Rows whose vector is null or holds null or non-finite entries are left out. Components without
    variance are left out too, so equal vectors, a single vector, vectors of length 0 and an empty table
    give no rows. Vectors of different lengths are whitened on their own, each length by its own fit.
    Repeated rows, and rows with a null vec_id, have rows of their own. Entries beyond 2**40 count as
    that. Other columns are not read, whatever their names.
    """
    folder, spark = RunFolder(vectors.sparkSession), vectors.sparkSession
    kind = dict(vectors.dtypes)[vec_id]
    rows = vectors.select(F.col(vec_id).alias("vec_id"), as_integers(F.col(embedding)).alias("x"))
    rows = folder.scratch(rows.where(F.size("x") > 0))
    lengths = sorted(r[0] for r in rows.select(F.size("x")).distinct().collect())
    result = None
    for width in lengths:
        part = _whiten(rows.where(F.size("x") == width), width, most, folder)
        if part is not None:
            result = part if result is None else result.unionByName(part)
    if result is None:
        schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        result = spark.createDataFrame([], f"vec_id {kind}, {schema}")
    return result


def _whiten(rows: DataFrame, width: int, most: int, folder: RunFolder) -> DataFrame | None:
    fit = numbered(rows.select("x").distinct(), folder)
    n = fit.count()
    entries = fit.select(F.posexplode("x").alias("k", "v"))
    # Sums of all entries, one for each dimension.
    totals = entries.groupBy("k").agg(F.sum((F.col("v") - MOVED).cast("decimal(38,0)"))).collect()
    sums = [int(s) for _, s in sorted(totals)]
    mean = F.lit(np.array([s / n for s in sums]))
    centred = F.zip_with("x", mean, lambda a, m: (a - MOVED).cast("double") - m)
    fit = folder.scratch(fit.select("index", "x", centred.alias("centred")))
    layout = Layout(n, width)
    blocks = _row_matrix(fit, "centred", layout)
    values, axes, trace = eigen(_transpose_times(blocks, layout), n, most)
    if not len(values):
        return None
    matrix = axes / np.sqrt(values)
    sc = rows.sparkSession.sparkContext
    # Its blocks match the columns of the rows' blocks.
    deep = layout.block[1]
    pieces = [
        ((k, 0), _dense(matrix[at : at + deep])) for k, at in enumerate(range(0, width, deep))
    ]
    whitener = BlockMatrix(sc.parallelize(pieces, 1), deep, len(values), width, len(values))
    projected = blocks.multiply(whitener)
    vectors = projected.toIndexedRowMatrix().rows.map(lambda r: (r.index, r.vector.toArray().tolist()))
    whitened = folder.scratch(rows.sparkSession.createDataFrame(vectors, "index long, w array<double>"))
    error = _identity_error(whitened, Layout(n, len(values)))
    known = folder.scratch(
        fit.join(whitened, "index").select("x", "w", _deviation(F.col("x"), n, sums).alias("deviation"))
    )
    shares = F.lit(values / trace)
    each = rows.join(known, "x").select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return each.select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("k") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _dense(a: np.ndarray) -> DenseMatrix:
    return Matrices.dense(a.shape[0], a.shape[1], a.ravel(order="F"))


def _identity_error(whitened: DataFrame, layout: Layout) -> float:
    """Largest entry of the covariance of the whitened rows, less the identity."""
    # Their means are zero but for rounding; they are taken off all the same.
    sums = whitened.select(F.posexplode("w").alias("k", "v")).groupBy("k").agg(F.sum("v")).collect()
    mean = F.lit(np.array([s / layout.rows for _, s in sorted(sums)]))
    centred = whitened.select("index", F.zip_with("w", mean, lambda a, m: a - m).alias("w"))
    product = _transpose_times(_row_matrix(centred, "w", layout), layout)
    return float(np.abs(product / layout.rows - np.eye(layout.width)).max())
