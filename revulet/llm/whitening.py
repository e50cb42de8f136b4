"""Embedding whitening with MLlib's BlockMatrix.

The fit list is each distinct integer vector once. Its centred rows are indexed and gathered into distributed blocks;
the scatter matrix is the product of the transposed blocks with the blocks, in as many parts as there are blocks, and
only this dims x dims matrix comes to the driver, where it is decomposed. A second product, of the blocks of all rows
with the whitening matrix, projects every row.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Numbers in one block (2 MB).
BLOCK_CELLS = 1 << 18
#: Eigenvalues below this share of the largest count as nought.
NOUGHT = 1e-12
SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def quantised(vector: Column) -> Column:
    """floor(64 c) + 1000000 of every component, as long."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(F.lit(float(SCALE)) * c) + F.lit(SHIFT).cast("long"))


def _usable(vectors: DataFrame) -> DataFrame:
    fine = "embedding is not null and not exists(embedding, c -> c is null or isnan(c) or abs(c) = double('infinity'))"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(fine)
    return rows.select("vec_id", quantised(F.col("embedding")).alias("x"), F.size("embedding").alias("dims"))


def _numbered(df: DataFrame, tmp: C.Scratch, name: str) -> DataFrame:
    """df, written, with index: its rows numbered from 0 without a gap. Rows are numbered within the parts that wrote
    them; a part begins where those before it end (one row for each part)."""
    rows = tmp.written(df.withColumn("_at", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_begin"))
    return rows.withColumn("_part", part).join(F.broadcast(begins), "_part").withColumn("index", F.col("_begin") + place).drop("_at", "_part", "_begin")


def _blocks(rows: DataFrame, count: int, dims: int) -> BlockMatrix:
    """rows (index, centred) as blocks of BLOCK_CELLS numbers that hold all columns up to 1,024."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("centred").alias("vector")), "vector")
    width = min(dims, 1024)
    return IndexedRowMatrix(vectors, count, dims).toBlockMatrix(max(BLOCK_CELLS // width, 16), width)


def _times(left: BlockMatrix, right: BlockMatrix, parts: int) -> BlockMatrix:
    """left times right, where the sum over the middle dimension is dealt out to so many parts."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def _gram(blocks: BlockMatrix) -> np.ndarray:
    """The transposed blocks times the blocks: columns x columns numbers."""
    parts = max(1, min(blocks.numRowBlocks, 4 * blocks.blocks.context.defaultParallelism))
    return _times(blocks.transpose(), blocks, parts).toLocalMatrix().toArray()


def _local(spark, matrix: np.ndarray) -> BlockMatrix:
    """A matrix of dims x components numbers as blocks that fit those of _blocks."""
    high, wide = min(matrix.shape[0], 1024), matrix.shape[1]
    cut = [((i, 0), DenseMatrix(len(b), wide, b.ravel(order="F"))) for i, b in enumerate(matrix[at : at + high] for at in range(0, len(matrix), high))]
    return BlockMatrix(spark.sparkContext.parallelize(cut, len(cut)), high, wide)


def _rows(blocks: BlockMatrix) -> DataFrame:
    """index, values of every row of blocks."""
    rows = callMLlibFunc("getIndexedRows", blocks.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("values"))


def _whiten(rows: DataFrame, dims: int, components: int, tmp: C.Scratch) -> DataFrame:
    """The result for the rows (vec_id, x) of one number of dimensions; one row at least."""
    spark = rows.sparkSession
    fit = _numbered(rows.select("x").distinct(), tmp, "fit")
    sums = fit.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum("v").alias("s")).orderBy("d").collect()
    n, totals = fit.count(), F.array(*[F.lit(r.s).cast("long") for r in sums])
    apart = F.zip_with("x", totals, lambda v, s: F.lit(n).cast("long") * v - s)
    centred = F.transform(apart, lambda v: v.cast("double") / F.lit(float(n)))

    blocks = _blocks(fit.select("index", centred.alias("centred")), n, dims)
    value, vector = np.linalg.eigh(_gram(blocks) / n)
    value, vector = np.maximum(value[::-1], 0.0), vector[:, ::-1]
    kept = min(components, dims)
    live = value[:kept] > NOUGHT * max(value[0], np.finfo(float).tiny)
    matrix = vector[:, :kept] * np.where(live, 1 / np.sqrt(np.where(live, value[:kept], 1.0)), 0.0)
    explained = value[:kept] / value.sum() if value.sum() > 0 else np.zeros(kept)

    local = _local(spark, matrix)
    # The fit list's projections have a mean of nought but for rounding, as its rows are centred.
    error = np.abs(_gram(_times(blocks, local, 1))[np.ix_(live, live)] / n - np.eye(live.sum()))
    all_rows = _numbered(rows.select("vec_id", "x"), tmp, "rows")
    projected = _rows(_times(_blocks(all_rows.select("index", centred.alias("centred")), all_rows.count(), dims), local, 1))

    exact = F.aggregate(apart, F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v.cast("decimal(19,0)") * v.cast("decimal(19,0)")).cast("decimal(38,0)"))
    out = all_rows.select("index", "vec_id", exact.alias("deviation")).join(projected, "index")
    out = out.select("vec_id", "deviation", F.posexplode("values").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*[F.lit(float(e)) for e in explained]), F.col("at") + 1).alias("explained"),
        F.lit(float(error.max(initial=0.0))).alias("identity_error"),
    )


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """For every usable row of vectors (vec_id, embedding) and each component up to `components`: vec_id, component
    (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error.

    Components become long x = floor(64 c) + 1000000. Every distinct x is in the fit list once: n of them, with the
    sums S. deviation is the sum of (n x - S)^2 over the dimensions, exact to 38 digits. whitened is x - S/n projected
    on the unit eigenvector of the fit list's covariance (divisor n) over the root of its eigenvalue, explained that
    eigenvalue's share of all, identity_error the largest entry of the projections' covariance minus the identity.

    Rows take no part if their vector is null or holds a null or a number that is not finite; a null vec_id stays.
    Repeated rows are projected each. Vectors of different lengths are fitted apart, empty ones give no rows.
    Components without variance (eigenvalue at most 1e-12 of the largest) are projected on nought and are left out of
    identity_error. Other columns are ignored; an empty table gives no rows.
    """
    with C.Scratch() as tmp:
        usable = tmp.written(_usable(vectors), "usable")
        lengths = [r.dims for r in usable.where("dims > 0").select("dims").distinct().orderBy("dims").collect()]
        out = vectors.sparkSession.createDataFrame([], SCHEMA)
        for dims in lengths:
            out = out.unionByName(_whiten(usable.where(F.col("dims") == dims), dims, components, tmp))
        return C.written(out, "whitened")
