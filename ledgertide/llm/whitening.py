"""Whitening of embeddings on MLlib block matrices.

Components become whole numbers, so counts, sums and squared deviations are exact. Rows are numbered by file and place,
centred, and laid into blocks of ROWS rows; the product of the transposed block matrix with itself is the scatter matrix,
whose eigenvectors numpy finds on the driver (one number per pair of dimensions, whatever the number of rows). A second
block product with the whitening matrix projects all rows.

A product whose result is one block would send all blocks to one task; the inner dimension is cut into as many splits as
there are blocks, so every task multiplies one pair and only small products are added up.

Edge cases: vectors that are null, empty, or hold a null or non-finite component take no part, nor do vectors of another
length than the most common one; repeated ids are rows of their own and a null vec_id stays null; directions without
variance (eigenvalue at most 1e-12 of the trace) are no components, so equal vectors and a single one give no rows;
`deviation` is null where the exact value, kept in `deviation_exact`, needs more than 63 bits; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgertide.llm.work import located, settle

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
ROWS = 4096  # rows in a block
FLAT = 1e-12  # share of the trace below which a direction has no variance

SCHEMA = (
    "vec_id BIGINT, component INT, n BIGINT, deviation BIGINT, whitened DOUBLE, explained DOUBLE, identity_error DOUBLE, "
    "deviation_exact DECIMAL(38,0)"
)


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and x, the shifted whole numbers; only rows that take part."""
    vector = F.col("embedding")
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    good = rows.where(vector.isNotNull() & (F.size(vector) > 0)).where(F.forall(vector, finite))
    return good.select("vec_id", F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT).alias("x"))


def numbered(rows: DataFrame) -> DataFrame:
    """Settled rows with `index`, gapless from 0: the rows of earlier files plus the place in the file."""
    placed = located(rows, "_at")
    files = placed.groupBy("_at.file").agg(F.count(F.lit(1)).alias("here"))  # a row per file
    before = F.sum("here").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select(F.col("file").alias("of"), F.coalesce(before, F.lit(0)).alias("start"))
    return placed.join(starts, F.col("_at.file") == F.col("of")).select(
        *rows.columns, (F.col("start") + F.col("_at.row")).alias("index")
    )


def multiply(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product with its inner dimension cut into splits, which Python's `multiply` does not hand on."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def deviations(n: int, sums: list[int]) -> Column:
    """Exact sum over the dimensions of (n x - S)^2."""
    apart = F.zip_with("x", F.array(*[F.lit(s).cast("long") for s in sums]), lambda x, s: (F.lit(n) * x - s).cast("decimal(19,0)"))
    zero = F.lit(0).cast("decimal(38,0)")
    return F.aggregate(apart, zero, lambda total, d: (total + d * d).cast("decimal(38,0)"))


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of the column `w` (k values, divisor n) minus the identity."""
    means = whitened.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(k)]).first()
    centred = [F.col("w")[i] - F.lit(means[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = whitened.agg(*[(F.sum(centred[i] * centred[j]) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[p] - (i == j)) for p, (i, j) in enumerate(pairs))


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact."""
    spark = rows.sparkSession
    vectors = settle(whole_vectors(rows), "vectors")
    sizes = vectors.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), "size").first()
    if common is None:
        return spark.createDataFrame([], SCHEMA)
    n, width = common["n"], common["size"]
    vectors = settle(vectors.where(F.size("x") == width), "vectors-of-one-length")
    sums = list(vectors.agg(*[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(width)]).first())

    exact = F.array(*[F.lit(s).cast("long") for s in sums])
    centred = F.zip_with("x", exact, lambda x, s: (F.lit(n) * x - s).cast("double") / n)
    indexed = settle(numbered(vectors).select("index", "vec_id", "x"), "vectors-numbered")
    laid = indexed.select("index", array_to_vector(centred).alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(laid, "vector"), n, width)
    blocks, splits = matrix.toBlockMatrix(ROWS, width), -(-n // ROWS)

    scatter = multiply(blocks.transpose(), blocks, splits).toLocalMatrix().toArray()
    values, directions = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    order = np.argsort(-values)[:components]
    trace = float(values.sum())
    order = [k for k in order if values[k] > FLAT * trace]
    if not order:
        return spark.createDataFrame([], SCHEMA)
    whitening = directions[:, order] / np.sqrt(values[order])
    local = Matrices.dense(width, len(order), whitening.flatten(order="F").tolist())
    projection = BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), width, len(order), width, len(order))
    projected = multiply(blocks, projection, 1).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    found = settle(found.select(F.col("index").alias("at"), vector_to_array("vector").alias("w")), "whitened")
    error = identity_error(found, n, len(order))

    exact_deviation = deviations(n, sums)
    told = indexed.select("index", "vec_id", exact_deviation.alias("deviation_exact")).join(found, F.col("index") == F.col("at"))
    explained = F.array(*[F.lit(float(values[k] / trace)) for k in order])
    fits = F.col("deviation_exact") <= F.lit(2**63 - 1)
    return told.select(
        "vec_id", "deviation_exact", F.posexplode(F.arrays_zip(F.col("w"), explained.alias("explained"))).alias("place", "at_place")
    ).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
        F.when(fits, F.col("deviation_exact")).cast("long").alias("deviation"), F.col("at_place.w").alias("whitened"),
        F.col("at_place.explained").alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact",
    )
