"""Linear algebra of matrices held as one row (col_id, vec) per column.

The long axis stays distributed. What reaches the driver is m x m, and m is bounded by MAX_ROWS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsieve.session import materialize

#: Most matrix rows (length of vec) for which m x m state is kept on the driver.
MAX_ROWS = 2_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def matrix_literal(a: np.ndarray) -> Column:
    return F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in np.atleast_2d(a)))


def apply_matrix(a: np.ndarray, v: Column) -> Column:
    """A v for a small matrix A, inside the plan."""
    return F.transform(matrix_literal(a), lambda row: dot(row, v))


def gram(df: DataFrame, vec: str = "vec") -> DataFrame:
    """(i, j, v) of X X^T: each task adds up its own m x m, then m x m rows for each task are shuffled and summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("vec").flatten(), dtype=float).reshape(batch.num_rows, -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            m = len(total)
            i, j = np.divmod(np.arange(m * m), m)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    return df.select(F.col(vec).cast("array<double>").alias("vec")).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def gram_relational(df: DataFrame, id_col: str = "col_id", vec: str = "vec") -> DataFrame:
    """The same by DataFrame operations alone, for small m."""
    flat = df.select(F.posexplode(vec).alias("i", "a"), F.col(vec).alias("row"))
    return flat.select("i", "a", F.posexplode("row").alias("j", "b")).groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def gram_matrix(df: DataFrame, vec: str = "vec") -> np.ndarray:
    rows = gram(df, vec).collect()  # m * m rows
    m = max((r["i"] for r in rows), default=-1) + 1
    if m > MAX_ROWS:
        raise ValueError(f"{m} matrix rows are more than {MAX_ROWS}")
    g = np.zeros((m, m))
    for r in rows:
        g[r["i"], r["j"]] = r["v"]
    return (g + g.T) / 2


def whitener(g: np.ndarray) -> np.ndarray:
    """L^-1 of the Cholesky factor of X X^T: L^-1 X has orthonormal rows."""
    try:
        return np.linalg.inv(np.linalg.cholesky(g))
    except np.linalg.LinAlgError as e:
        raise ValueError("the matrix doesn't have full row rank") from e


def map_vectors(df: DataFrame, a: np.ndarray, vec: str = "vec", out: str = "vec") -> DataFrame:
    """Adds A vec to every row: in the plan for small A, in Arrow batches beyond."""
    if a.shape[0] <= 16:
        return df.withColumn(out, apply_matrix(a, F.col(vec).cast("array<double>")))
    shared = df.sparkSession.sparkContext.broadcast(a)

    @F.pandas_udf("array<double>")
    def product(v):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(list(np.stack(v.to_numpy()).astype(float) @ shared.value.T)) if len(v) else v

    return df.withColumn(out, product(F.col(vec)))


def whiten(df: DataFrame, vec: str = "vec") -> DataFrame:
    """vec replaced by columns of a factor with orthonormal rows. Two rounds (Cholesky QR) restore what the Gram loses.

    The source is written once, as three passes read it.
    """
    df = materialize(df, "columns")
    once = map_vectors(df, whitener(gram_matrix(df, vec)), vec, vec)
    return map_vectors(once, whitener(gram_matrix(once, vec)), vec, vec)


def leverage(df: DataFrame, vec: str = "vec") -> DataFrame:
    """w = squared norm of each whitened column."""
    return whiten(df, vec).withColumn("w", dot(F.col(vec), F.col(vec)))


def pinv_norms(df: DataFrame, vec: str = "vec") -> dict[str, float]:
    """Norms of the pseudoinverse from the m x m Gram; 0 for an empty matrix, inf without full rank."""
    return norms_of_gram(gram_matrix(df, vec))


def norms_of_gram(g: np.ndarray) -> dict[str, float]:
    if not g.size:
        return {"frobenius": 0.0, "spectral": 0.0}
    values = np.linalg.eigvalsh(g)
    if values[0] <= values[-1] * np.finfo(float).eps * len(g):
        return {"frobenius": float("inf"), "spectral": float("inf")}
    return {"frobenius": float(np.sqrt((1 / values).sum())), "spectral": float(1 / np.sqrt(values[0]))}
