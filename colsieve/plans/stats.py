"""Aggregation of grid results: all relational, one shuffle by the grouping key each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that the command line of a plotting script may use, and their columns.
ALIASES = {
    "spectral": "pinv_spectral_norm_ratio",
    "frobenius": "pinv_frobenius_norm_ratio",
    "orthonormal_spectral": "X_S_dag_X_spectral_norm_inv",
    "orthonormal_frobenius": "X_S_dag_X_frobenius_norm_inv",
    "time": "wall_time_ms",
    "volume": "volume_ratio",
    "mse": "regression_mse",
}


def in_range(df: DataFrame, k_min: int | None = None, k_max: int | None = None) -> DataFrame:
    """k_min <= k <= k_max; pushed down to the scan."""
    df = df if k_min is None else df.filter(F.col("k") >= k_min)
    return df if k_max is None else df.filter(F.col("k") <= k_max)


def metric_value(metric: str) -> Column:
    """Norm metrics are squared before they are aggregated, as their bounds are."""
    return F.pow(F.col(metric), 2) if "norm" in metric else F.col(metric)


def present(metric: str) -> Column:
    return F.col(metric).isNotNull() & ~F.isnan(metric)


def mean_std(df: DataFrame, metric: str, by: tuple[str, ...] = ("algorithm", "k")) -> DataFrame:
    """Mean and sample deviation (0 for a single row) of a metric."""
    rows = df.filter(present(metric)).select(*by, metric_value(metric).alias("v"))
    return rows.groupBy(*by).agg(F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"))


def dispersion(df: DataFrame, metric: str, m: int | None = None) -> DataFrame:
    """Per k: (max - min) / mean over algorithms of their medians; null below two algorithms or for mean 0."""
    df = df if m is None else df.filter(F.col("k").between(m, 3 * m))
    medians = df.filter(present(metric)).groupBy("algorithm", "k").agg(F.percentile(metric, 0.5).alias("v"))
    agg = medians.groupBy("k").agg(F.max("v").alias("hi"), F.min("v").alias("lo"), F.avg("v").alias("mid"), F.count(F.lit(1)).alias("n"))
    return agg.select("k", F.when((F.col("n") >= 2) & (F.col("mid") != 0), (F.col("hi") - F.col("lo")) / F.col("mid")).alias("dispersion"))


def swap_quantiles(df: DataFrame, floor: float = 0.5) -> DataFrame:
    """Per (algorithm, k): quartiles of tracked swap counts, interpolated; the lower one is at least `floor`."""
    q = df.filter("swap_count >= 0").groupBy("algorithm", "k").agg(F.percentile("swap_count", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select("algorithm", "k", F.greatest(F.col("q")[0], F.lit(floor)).alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"))


def distribution(df: DataFrame, metric: str, ks: list[int], bins: int = 10) -> DataFrame:
    """Histogram of a metric for each algorithm and each of the given k: (algorithm, k, bin, n), bins over the metric's range."""
    rows = df.filter(F.col("k").isin(ks) & present(metric)).select("algorithm", "k", F.col(metric).alias("v"))
    span = rows.groupBy("algorithm", "k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(F.lit(0))
    return rows.join(span, ["algorithm", "k"]).groupBy("algorithm", "k", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def distinct_k(df: DataFrame) -> DataFrame:
    return df.select("k").distinct().orderBy("k")


def union_results(frames: list[DataFrame], order: list[str]) -> DataFrame:
    """All results by name, with each algorithm's place in a canonical order (unknown ones last)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    place = F.create_map(*(x for i, a in enumerate(order) for x in (F.lit(a), F.lit(i))))
    return out.withColumn("place", F.coalesce(place[F.col("algorithm")], F.lit(len(order))))
