"""Whitened embeddings: principal components of quantised vectors by a distributed singular value decomposition.

1. Entries become long integers, so that equal vectors are equal and sums are exact whatever their order. The fit
   list holds each distinct vector once.
2. Sums per dimension are exact longs. n * x - S, a centred row times n, is an exact integer as well, so centring
   comes before any rounding.
3. MLlib's computeSVD runs on the centred rows, which stay distributed: tasks add up their Gramian and only that
   (dimensions squared) is gathered. A singular value s of n rows is an eigenvalue s^2 / n of the covariance. All components are asked
   for, as MLlib then solves the Gramian densely to double precision; the first ones are kept.
4. The total variance comes from the exact integer deviations of all dimensions, not from the eigenvalues.
5. A last pass measures the covariance of the whitened fit list against the identity.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

COMPONENTS = 16
#: Quantisation: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Directions with less than the square of this share of the greatest singular value hold nothing but rounding.
LEAST = 1e-5


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long"))


def whole(vector: Column) -> Column:
    """Whether a vector is there, not empty, and every entry is a finite number."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def _offsets(n: int, sums: list[int]) -> Column:
    """n * x - S in each dimension: an exact long."""
    return F.zip_with("x", _longs(sums), lambda x, s: x * F.lit(n).cast("long") - s)


def _deviation() -> Column:
    squares = F.transform("off", lambda v: (v.cast("decimal(19,0)") * v.cast("decimal(19,0)")).cast("decimal(38,0)"))
    return F.aggregate(squares, F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v).cast("decimal(38,0)"))


def components_of(fit: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of the covariance of rows off / n (off: arrays of long)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    centred = fit.select(array_to_vector(F.transform("off", lambda v: v / F.lit(float(n)))).alias("v"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v"))
    found = matrix.computeSVD(matrix.numCols(), computeU=False, rCond=LEAST)
    return found.s.toArray() ** 2 / n, found.V.toArray()


def _project(weights: np.ndarray, n: int, columns: list[str]):
    """Rows with off (arrays of long) -> the columns and w, off / n on each column of weights."""

    def run(batches):
        for batch in batches:
            off = batch.column("off")
            rows = np.asarray(off.flatten()).reshape(-1, len(weights)) / float(n)
            flat = (rows @ weights).ravel()
            w = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * weights.shape[1]), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), w], [*columns, "w"])

    return run


def _products(mean: np.ndarray):
    """(w) -> (cell, value): each task's sum of centred products, one row for each pair of components."""

    def run(batches):
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            w = np.asarray(batch.column("w").flatten()).reshape(-1, len(mean)) - mean
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "value"])

    return run


def identity_error(fit: DataFrame, weights: np.ndarray, n: int) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = weights.shape[1]
    white = stage(fit.select("off").mapInArrow(_project(weights, n, []), "w array<double>"), "white-fit")
    mean = np.array(white.agg(*(F.avg(F.col("w")[i]) for i in range(k))).first())
    cells = white.mapInArrow(_products(mean), "cell long, value double").groupBy("cell").agg((F.sum("value") / n).alias("value"))
    off = F.abs(F.col("value") - F.when(F.col("cell") % (k + 1) == 0, 1.0).otherwise(0.0))
    return cells.agg(F.max(off)).first()[0]


def whiten(rows: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row with a whole vector and each component up to k: vec_id, component, n, deviation, whitened, explained, identity_error.

    n: distinct vectors of the fit list; deviation: the exact sum over dimensions of (n * x - S)^2; whitened: the centred
    vector on the component, over the root of its eigenvalue; explained: the eigenvalue's share of the total variance.
    Null and empty vectors, and those with null or non-finite entries, are left out; null ids stay and repeated rows have rows each.
    Components without variance do not exist: a table of one distinct vector, or none, gives an empty result, and fewer dimensions
    give fewer components. Vectors of different lengths are an error. Other columns are ignored. A deviation beyond a long is null.
    """
    spark: SparkSession = rows.sparkSession
    # The checks come before the quantisation: null and non-finite entries never meet floor().
    clean = rows.select(F.col(id_col).alias("vec_id"), F.when(whole(F.col(vector_col)), F.col(vector_col)).alias("v")).filter("v is not null")
    kept = stage(clean.select("vec_id", quantised(F.col("v")).alias("x")), "white-rows")
    distinct = stage(kept.select("x").distinct(), "white-distinct")
    n, shortest, longest = distinct.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    empty = spark.createDataFrame([], f"vec_id {dict(rows.dtypes)[id_col]}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if n < 2:
        return empty
    if shortest != longest:
        raise ValueError(f"vectors have {shortest} to {longest} dimensions")
    totals = distinct.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s")).collect()  # one row a dimension
    sums = [r.s for r in sorted(totals)]
    fit = stage(distinct.select(_offsets(n, sums).alias("off")), "white-centred")
    total = fit.agg(F.sum(_deviation())).first()[0]  # n^3 times the total variance
    values, vectors = components_of(fit, n)
    values, vectors = values[:k], vectors[:, :k]
    weights = vectors / np.sqrt(values)
    error = identity_error(fit, weights, n)
    share = [float(Fraction(v) * n**3 / Fraction(int(total))) for v in values.tolist()]
    white = kept.select("vec_id", _offsets(n, sums).alias("off")).select("vec_id", _deviation().try_cast("long").alias("deviation"), "off")
    kind = dict(rows.dtypes)[id_col]
    found = white.mapInArrow(_project(weights, n, ["vec_id", "deviation"]), f"vec_id {kind}, deviation long, w array<double>")
    explained = F.array(*(F.lit(v) for v in share))
    long = found.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return long.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("i") + 1).alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
