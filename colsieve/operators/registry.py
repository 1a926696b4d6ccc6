"""Selectors by name, and the planner that runs one on a matrix held as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsieve.operators import kernels
from colsieve.session import ship_package

Selector = Callable[..., "list[int] | tuple[list[int], int]"]


class Norm(str, Enum):
    FROBENIUS = "frobenius"
    SPECTRAL = "spectral"


class Initialization(str, Enum):
    CPQR = "cpqr"
    GREEDY = "greedy"
    ADVANCED = "advanced"


_SELECTORS: dict[str, Selector] = {}

#: Doubles of a matrix up to which one task runs the kernel; above, the distributed form is used.
KERNEL_DOUBLES = 20_000_000

SELECTION_SCHEMA = "matrix_id bigint, algorithm string, k int, rank int, col_id bigint, swap_count bigint"


def register_selector(name: str, selector: Selector) -> bool:
    """Adds a selector f(x, k, ids, **params) -> positions (or positions and swaps); False if the name is taken."""
    if name in _SELECTORS:
        return False
    _SELECTORS[name] = selector
    return True


def selector(name: str) -> Selector:
    if name not in _SELECTORS:
        raise ValueError(f"no such selector: {name!r}")
    return _SELECTORS[name]


def selector_names() -> list[str]:
    return sorted(_SELECTORS)


for _name, _kernel in {
    "random columns": kernels.random_columns,
    "leverage scores": kernels.leverage_scores,
    "forward iterative volume sampling": kernels.forward_volume,
    "reverse iterative volume sampling": kernels.reverse_volume,
    "volume removal": kernels.volume_removal,
    "frobenius removal": kernels.frobenius_removal,
    "spectral removal": kernels.spectral_removal,
    "frobenius selection": kernels.frobenius_selection,
    "spectral selection": kernels.spectral_selection,
    "dual set": kernels.dual_set,
    "dominant": kernels.dominant,
    "volume add-remove": kernels.volume_add_remove,
    "rect-maxvol": kernels.rect_maxvol,
    "derandomized volume": kernels.derandomized_volume,
    "interlacing families": kernels.interlacing_families,
}.items():
    register_selector(_name, _kernel)


def run_kernel(algorithm: str | Selector, x: np.ndarray, k: int, ids: np.ndarray | None = None, **params) -> tuple[list[int], int | None]:
    """Positions of the k chosen columns and the swap count (None if not tracked). Checks 1 <= m <= k <= n."""
    x = np.asarray(x, float)
    m, n = x.shape
    if not (1 <= m <= k <= n):
        raise ValueError(f"1 <= m <= k <= n doesn't hold: m={m}, k={k}, n={n}")
    f = selector(algorithm) if isinstance(algorithm, str) else algorithm
    tracked = algorithm in ("dominant", "volume add-remove")
    if k == n:
        return list(range(n)), 0 if tracked else None
    found = f(x, k, np.arange(n) if ids is None else ids, **params)
    return found if isinstance(found, tuple) else (found, None)


def select_subset(df: DataFrame, k: int, algorithm: str, path: str = "auto", id_col: str = "col_id", vec: str = "vec", matrix_col: str | None = None, **params) -> DataFrame:
    """Selection rows (SELECTION_SCHEMA) from rows (col_id, vec), or from many matrices told apart by matrix_col.

    path: "kernel" (a task for each matrix), "distributed" (passes over the columns), or "auto" by size.
    """
    ship_package(df.sparkSession)
    f = selector(algorithm)
    if path == "auto" and matrix_col is None:
        doubles = df.agg(F.sum(F.size(vec)).alias("d")).first()["d"] or 0
        path = "kernel" if doubles <= KERNEL_DOUBLES else "distributed"
    if path == "distributed":
        from colsieve.operators.distributed import distributed_selector

        return distributed_selector(algorithm)(df.select(F.col(id_col).alias("col_id"), F.col(vec).cast("array<double>").alias("vec")), k, **params)
    rows = df.select((F.col(matrix_col) if matrix_col else F.lit(0)).cast("bigint").alias("matrix_id"), F.col(id_col).cast("bigint").alias("col_id"), F.col(vec).cast("array<double>").alias("vec"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("col_id")
        ids = pdf["col_id"].to_numpy()
        picks, swaps = run_kernel(f, np.stack(pdf["vec"].to_numpy()).T, k, ids, **params)
        return pd.DataFrame({"matrix_id": pdf["matrix_id"].iloc[0], "algorithm": algorithm, "k": k, "rank": np.arange(len(picks)), "col_id": ids[picks], "swap_count": pd.array([swaps] * len(picks), "Int64")})

    return rows.groupBy("matrix_id").applyInPandas(run, SELECTION_SCHEMA)


def gather(df: DataFrame, selection: DataFrame, id_col: str = "col_id") -> DataFrame:
    """The chosen columns."""
    return df.join(selection.select(F.col("col_id").alias(id_col)), id_col, "left_semi")


def pad_selection(df: DataFrame, selection: DataFrame, k: int, id_col: str = "col_id") -> DataFrame:
    """The selection, filled up to k with the lowest ids that it doesn't hold."""
    missing = k - selection.count()
    rest = df.select(F.col(id_col).alias("col_id")).join(selection.select("col_id"), "col_id", "left_anti").orderBy("col_id").limit(max(0, missing))
    return selection.select("col_id").unionByName(rest)


def register_sql(spark: SparkSession) -> None:
    """The table function select_subset(TABLE(m), k, algorithm) over columns (col_id, vec), and secular_eigs(d, v)."""
    from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
    from pyspark.sql.types import IntegerType, LongType, StructType

    ship_package(spark)

    class SelectSubset:
        def __init__(self) -> None:
            self._ids: list[int] = []
            self._vectors: list[list[float]] = []
            self._k, self._algorithm = 0, ""

        @staticmethod
        def analyze(table: AnalyzeArgument, k: AnalyzeArgument, algorithm: AnalyzeArgument) -> AnalyzeResult:
            return AnalyzeResult(StructType().add("rank", IntegerType()).add("col_id", LongType()), withSinglePartition=True)

        def eval(self, row, k: int, algorithm: str) -> None:  # noqa: ANN001
            self._k, self._algorithm = k, algorithm
            self._ids.append(row["col_id"])
            self._vectors.append(row["vec"])

        def terminate(self):  # noqa: ANN201
            if self._ids:
                from colsieve.operators.registry import run_kernel

                order = np.argsort(self._ids)
                ids = np.array(self._ids)[order]
                picks, _ = run_kernel(self._algorithm, np.array(self._vectors, float)[order].T, self._k, ids)
                for rank, p in enumerate(picks):
                    yield rank, int(ids[p])

    spark.udtf.register("select_subset", udtf(SelectSubset))
    spark.udf.register("secular_eigs", secular_eigs())


def secular_eigs():
    """Arrow UDF: eigenvalues of diag(d) + v v^T for arrays d (ascending) and v."""

    @F.pandas_udf("array<double>")
    def eigenvalues(d: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([kernels.secular_eigenvalues(np.asarray(a), np.asarray(b)) for a, b in zip(d, v, strict=True)])

    return eigenvalues
