"""Feature preparation: one-hot (first level dropped), standardisation, intercept, singular values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsieve.functions.linalg import gram_matrix

#: The columns of the abalone table, and the levels of its first one.
ABALONE_COLUMNS = ["sex", "length", "diameter", "height", "whole_weight", "shucked_weight", "viscera_weight", "shell_weight", "rings"]
ABALONE_SEXES = ["F", "I", "M"]


def standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation (1 if that is 0) for each column; one aggregate of two numbers a column."""
    stats = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    out = df
    for i, c in enumerate(columns):
        mean, deviation = stats[f"m{i}"] or 0.0, stats[f"s{i}"] or 1.0
        out = out.withColumn(c, (F.col(c) - F.lit(mean)) / F.lit(deviation))
    return out


def one_hot(column: str, levels: list[str]) -> list[Column]:
    """Indicators of all levels but the first."""
    return [F.when(F.col(column) == level, 1.0).otherwise(0.0) for level in levels[1:]]


def features(df: DataFrame, id_col: str, category: str, levels: list[str], numeric: list[str], target: str | None = None) -> DataFrame:
    """ColMatrix (col_id, vec, y): indicators, standardised numbers, intercept."""
    ready = standardized(df, numeric)
    vec = F.array(*one_hot(category, levels), *(F.col(c).cast("double") for c in numeric), F.lit(1.0))
    return ready.select(F.col(id_col).alias("col_id"), vec.alias("vec"), (F.col(target).cast("double") if target else F.lit(None).cast("double")).alias("y"))


def abalone(df: DataFrame) -> DataFrame:
    """The abalone table (ABALONE_COLUMNS and an id) as a 10 x n matrix with rings as target."""
    return features(df, "id", "sex", ABALONE_SEXES, ABALONE_COLUMNS[1:-1], "rings")


def singular_values(df: DataFrame) -> np.ndarray:
    """Descending singular values of a ColMatrix from its Gram."""
    return np.sqrt(np.maximum(np.linalg.eigvalsh(gram_matrix(df)), 0))[::-1]
