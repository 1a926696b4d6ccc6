"""Matrix generators as rows (col_id, vec), one for each matrix column; no value depends on partitioning."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colsieve.functions.linalg import map_vectors, whiten
from colsieve.functions.rng import normal, uniform


def _columns(spark: SparkSession, m: int, n: int, cell: Callable[[Column, Column], Column]) -> DataFrame:
    """n columns of m cells, each an expression of (row, col_id)."""
    if m < 1 or n < 1:
        raise ValueError("a matrix needs at least one row and one column")
    ids = spark.range(n).withColumnRenamed("id", "col_id")
    return ids.select("col_id", F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: cell(i, F.col("col_id"))).alias("vec"))


def zero_matrix(spark: SparkSession, m: int, n: int, **_) -> DataFrame:
    return _columns(spark, m, n, lambda i, j: F.lit(0.0))


def gaussian_matrix(spark: SparkSession, m: int, n: int, seed: int = 0, trial: int = 0, **_) -> DataFrame:
    """Independent standard normals."""
    return _columns(spark, m, n, lambda i, j: normal(seed, 0, trial, F.concat_ws("|", i.cast("string"), j.cast("string"))))


def orthonormal_matrix(spark: SparkSession, m: int, n: int, seed: int = 0, trial: int = 0, **_) -> DataFrame:
    """Haar-distributed orthonormal rows (m <= n) or columns (m > n); whitening by a positive Cholesky factor fixes the signs."""
    if m <= n:
        return whiten(gaussian_matrix(spark, m, n, seed, trial))
    q = _haar(n, m, seed, trial).T
    return spark.createDataFrame([(j, q[:, j].tolist()) for j in range(n)], "col_id bigint, vec array<double>")


def _haar(m: int, n: int, seed: int, trial: int) -> np.ndarray:
    from colsieve.functions.rng import uniform_array

    cells = np.array([f"{i}|{j}" for i in range(m) for j in range(n)])
    u, v = (uniform_array(seed, 1, trial, np.array([f"{c}|{x}" for c in cells])) for x in "ab")
    g = (np.sqrt(-2 * np.log(u)) * np.cos(2 * math.pi * v)).reshape(m, n)
    q, r = np.linalg.qr(g.T)
    return (q * np.sign(np.diag(r))).T


def sigma_matrix(spark: SparkSession, m: int, n: int, sigma: list[float], seed: int = 0, trial: int = 0, **_) -> DataFrame:
    """U diag(sigma) V^T with Haar U (m x r) and V (n x r)."""
    r = len(sigma)
    if r > min(m, n) or r < 1:
        raise ValueError("there can be at most min(m, n) singular values, and one at least")
    left = _haar(r, m, seed, trial).T * np.array(sigma, float)
    return map_vectors(orthonormal_matrix(spark, r, n, seed + 1, trial), left)


def random_edges(spark: SparkSession, vertices: int, n: int, seed: int = 0, trial: int = 0, attempt: int = 0) -> DataFrame:
    """n distinct edges (edge_id, v1, v2), v1 < v2, of the complete graph: the smallest uniforms of its pairs."""
    v = spark.range(vertices)
    pairs = v.select(F.col("id").cast("int").alias("v1")).join(v.select(F.col("id").cast("int").alias("v2")), F.col("v1") < F.col("v2"))
    drawn = pairs.withColumn("u", uniform(seed, attempt, trial, F.concat_ws("|", F.col("v1").cast("string"), F.col("v2").cast("string")))).orderBy("u", "v1", "v2").limit(n)
    return drawn.select((F.row_number().over(_by("u", "v1", "v2")) - 1).cast("bigint").alias("edge_id"), "v1", "v2")


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.orderBy(*columns)  # over at most n drawn edges


def connected(edges: list[tuple[int, int]], vertices: int) -> bool:
    """Whether the edges join all vertices (isolated ones count)."""
    parent = list(range(vertices))

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in edges:
        parent[root(a)] = root(b)
    return len({root(a) for a in range(vertices)}) == 1


def incidence(edges: DataFrame, vertices: int, weight: Column | None = None) -> DataFrame:
    """Oriented incidence columns (col_id = edge_id): 1 at v1, -1 at v2, times the square root of the weight."""
    cell = lambda i: F.when(i == F.col("v1"), 1.0).when(i == F.col("v2"), -1.0).otherwise(0.0)
    scale = F.sqrt(weight) if weight is not None else F.lit(1.0)
    return edges.select(F.col("edge_id").alias("col_id"), F.transform(F.sequence(F.lit(0), F.lit(vertices - 1)), lambda i: cell(i) * scale).alias("vec"))


def grounded(columns: DataFrame) -> DataFrame:
    """Orthonormal rows that span those of an incidence matrix: its last row depends on the others and is left out."""
    m = columns.select(F.size("vec").alias("m")).first()["m"] - 1
    return whiten(columns.withColumn("vec", F.slice("vec", 1, m)))


def graph_incidence(spark: SparkSession, m: int, n: int, seed: int = 0, trial: int = 0, weighted: bool = False, attempts: int = 100, **_) -> DataFrame:
    """Top right singular vectors of the incidence matrix of a random connected graph of m + 1 vertices and n edges."""
    if not m <= n <= m * (m + 1) // 2:
        raise ValueError(f"m <= n <= m(m+1)/2 doesn't hold: {m}, {n}")
    for attempt in range(attempts):
        edges = random_edges(spark, m + 1, n, seed, trial, attempt).cache()
        if connected([(r["v1"], r["v2"]) for r in edges.collect()], m + 1):
            weight = 1 - uniform(seed, attempts, trial, F.col("edge_id")) if weighted else None
            return grounded(incidence(edges, m + 1, weight))
    raise ValueError("no connected graph was drawn")


def weighted_graph_incidence(spark: SparkSession, m: int, n: int, seed: int = 0, trial: int = 0, **kw) -> DataFrame:
    return graph_incidence(spark, m, n, seed, trial, weighted=True, **kw)


def matrix_from_file(spark: SparkSession, path: str, **kw) -> DataFrame:
    from colsieve.sources.files import read_matrix

    return read_matrix(spark, path, **kw)


_GENERATORS: dict[str, Callable[..., DataFrame]] = {
    "zero matrix": zero_matrix,
    "gaussian matrix": gaussian_matrix,
    "matrix with orthonormal rows or columns": orthonormal_matrix,
    "matrix with a given set of singular values": sigma_matrix,
    "graph incidence matrix": graph_incidence,
    "weighted graph incidence matrix": weighted_graph_incidence,
    "matrix from file": matrix_from_file,
}


def register_generator(name: str, generator: Callable[..., DataFrame]) -> bool:
    if name in _GENERATORS:
        return False
    _GENERATORS[name] = generator
    return True


def generate(spark: SparkSession, kind: str, **params) -> DataFrame:
    if kind not in _GENERATORS:
        raise ValueError(f"no such generator: {kind!r}")
    return _GENERATORS[kind](spark, **params)


