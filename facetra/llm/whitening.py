"""Whitening of embeddings with block matrices.

Centred rows become the blocks of a ``BlockMatrix``; its transpose times itself is the
scatter matrix, of which the driver takes the eigenvectors (dimensions x dimensions numbers,
whatever the rows), and the blocks times the whitening matrix are the projected rows.
Rows go in slabs of blocks, because the driver holds the coordinates of all blocks of a matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import constants
from .common import column, written

BLOCK = 1_024  # rows of a block
SLAB = 16_384  # blocks of one matrix: 16.8 million rows
MOST_DIMENSIONS = 4_096
SCALE, SHIFT = 1_024, 100_000
# An eigenvalue below this share of the largest is a direction without spread.
RANK = 1e-13


def integral(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``x``: whole numbers floor(1024 c) + 100000 of the components c.

    Rows whose vector is null, or holds a null or a component that is not finite, are left out,
    as are empty vectors and those whose length is not the most frequent one (ties: the longer).
    """
    v = F.col("v")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(column(key).alias("id"), column(vector).cast("array<double>").alias("v"))
    rows = rows.filter(v.isNotNull() & (F.size(v) > 0) & ~bad)
    x = F.transform(v, lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long"))
    return rows.select("id", x.alias("x"))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``index`` 0, 1, 2, ... and ``slab``, written.

    The place within a task is written first; then the tasks' row counts, one number a task, are
    added up, so that no row is sorted or moved.
    """
    spark = rows.sparkSession
    first = written(rows.withColumn("place", F.monotonically_increasing_id()), "vectors")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(map(tuple, first.groupBy(part.alias("part")).count().collect()))
    starts, so_far = [], 0
    for p, n in counts:
        starts.append((p, so_far))
        so_far += n
    offsets = F.broadcast(spark.createDataFrame(starts, "part long, first long"))
    index = (within + F.col("first")).alias("index")
    return first.withColumn("part", part).join(offsets, "part").select("id", "x", index)


def _blocks(rows: DataFrame, values: Column, first: int, dims: int) -> BlockMatrix:
    """The rows of one slab as blocks; ``first`` is the index of its first row."""
    wanted = rows.select((F.col("index") - F.lit(first)).alias("index"), array_to_vector(values).alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(wanted, "vector"))
    return matrix.toBlockMatrix(BLOCK, dims)


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left`` times ``right``; blocks along the inner side are multiplied in ``splits`` tasks."""
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def _slabs(rows: DataFrame, n: int) -> Iterator[tuple[int, DataFrame]]:
    size = BLOCK * SLAB
    for first in range(0, n, size):
        yield first, rows.filter((F.col("index") >= first) & (F.col("index") < first + size))


def scatter(rows: DataFrame, centred: Column, n: int, dims: int) -> np.ndarray:
    """Sum over the rows of the outer products of ``centred``."""
    total = np.zeros((dims, dims))
    for first, slab in _slabs(rows, n):
        blocks = _blocks(slab, centred, first, dims)
        splits = max(1, min(1_024, (min(n - first, BLOCK * SLAB) + BLOCK - 1) // BLOCK))
        total += _product(blocks.transpose(), blocks, splits).toLocalMatrix().toArray()
    return (total + total.T) / 2


def projected(rows: DataFrame, centred: Column, weights: np.ndarray, n: int) -> DataFrame:
    """``index`` and ``w``: the rows times ``weights``."""
    dims, width = weights.shape
    context = rows.sparkSession.sparkContext
    block = DenseMatrix(dims, width, weights.ravel(order="F").tolist())
    out = None
    for first, slab in _slabs(rows, n):
        right = BlockMatrix(context.parallelize([((0, 0), block)], 1), dims, width)
        product = _product(_blocks(slab, centred, first, dims), right, 1)
        indexed = product._java_matrix_wrapper.call("toIndexedRowMatrix")
        found = callMLlibFunc("getIndexedRows", indexed)
        part = found.select((F.col("index") + F.lit(first)).alias("index"), vector_to_array("vector").alias("w"))
        out = part if out is None else out.unionByName(part)
    return out


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """The first ``components`` whitened coordinates of every usable vector.

    Returns one row per vector and component: ``key``, ``component`` int (from 1 by falling
    variance), ``n`` long (usable vectors), ``deviation`` long (sum over dimensions of
    (n x - S)^2; null where it does not fit), ``whitened`` double, ``explained`` double (share of
    the total variance) and ``identity_error`` double (how far the covariance of ``whitened`` is
    from the identity at most). Null keys and repeated rows count like any other row; other columns
    are not read. A component without spread (fewer vectors than dimensions, or equal ones) has
    null ``whitened`` and is left out of ``identity_error``. An empty table, or one without a usable
    vector, gives no rows.
    """
    spark = df.sparkSession
    kind = df.select(column(key)).schema[0].dataType.simpleString()
    shape = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integral(df, key, vector)
    lengths = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], shape)
    dims = lengths[0]["dims"]
    if dims > MOST_DIMENSIONS:
        raise ValueError(f"{dims} dimensions; the driver takes eigenvectors of {MOST_DIMENSIONS} at most")
    rows = placed(rows.filter(F.size("x") == dims))
    n = rows.count()
    sums = rows.select(F.posexplode("x").alias("d", "x")).groupBy("d").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
    totals = [int(r["s"]) for r in sums.orderBy("d").collect()]
    # n x - S is a whole number, so the only rounding of a centred value is its division by n.
    total = F.array(*[F.lit(s).cast("decimal(38,0)") for s in totals])
    rows = written(
        rows.withColumn("gap", F.zip_with("x", total, lambda x, s: (x.cast("decimal(20,0)") * F.lit(n).cast("decimal(18,0)") - s).cast("decimal(38,0)"))),
        "vectors",
    )
    centred = F.transform("gap", lambda g: g.cast("double") / F.lit(float(n)))
    covariance = scatter(rows, centred, n, dims) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(covariance))
    count = min(components, dims)
    live = [j for j in range(count) if values[j] > RANK * max(values[0], 0.0) and values[0] > 0]
    explained = F.array(*[F.lit(float(max(values[j], 0.0) / trace) if trace > 0 else None).cast("double") for j in range(count)])
    long_gap = lambda g: g.try_cast("long")
    deviation = F.aggregate(
        "gap", F.lit(0).cast("long"), lambda so_far, g: F.try_add(so_far, F.try_multiply(long_gap(g), long_gap(g)))
    ).alias("deviation")
    if live:
        found = projected(rows, centred, vectors[:, live] / np.sqrt(values[live]), n)
        out = written(rows.select("id", "index", deviation).join(found, "index"), "whitened")
        error = _identity_error(out, len(live), n)
    else:
        out, error = rows.select("id", deviation, F.array().cast("array<double>").alias("w")), None
    each = F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(count)), lambda j: F.try_element_at("w", j))).alias("at", "whitened")
    return out.select("id", "deviation", each).select(
        F.col("id").alias(key),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def _identity_error(rows: DataFrame, width: int, n: int) -> float:
    """The largest entry of the covariance of ``w`` minus the identity; one row of sums reaches the driver."""
    w = [F.element_at("w", j + 1) for j in range(width)]
    means = constants(rows, **{f"m{j}": F.sum(w[j]) / n for j in range(width)})
    gaps = [w[j] - F.lit(means[f"m{j}"]) for j in range(width)]
    found = constants(rows, **{f"c{i}_{j}": F.sum(gaps[i] * gaps[j]) / n for i in range(width) for j in range(i + 1)})
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i in range(width) for j in range(i + 1))
