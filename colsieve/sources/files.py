"""Matrices and targets from text files, read by Spark; result sinks."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colsieve.session import materialize


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, line) in file order; `at` increases along the file and is written once with the lines."""
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line"))
    return materialize(raw, "lines")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows (at, vec) with gapless numbers: offsets of partitions come from their counts."""
    parts = rows.withColumn("part", F.shiftright("at", 33))
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    within = Window.partitionBy("part").orderBy("at")
    return parts.join(F.broadcast(counts.select("part", "base")), "part").select((F.col("base") + F.row_number().over(within) - 1).alias("row"), "vec")  # a row for each file partition


def _as_columns(rows: DataFrame) -> DataFrame:
    """ColMatrix of numbered file rows; a tall matrix is transposed, so that columns are the long axis."""
    sizes = rows.agg(F.count(F.lit(1)).alias("rows"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most")).first()
    if not sizes["rows"]:
        raise ValueError("the file holds no data")
    if sizes["least"] != sizes["most"]:
        raise ValueError(f"rows have from {sizes['least']} to {sizes['most']} values")
    if sizes["rows"] > sizes["most"]:
        return rows.select(F.col("row").alias("col_id"), "vec")
    flat = rows.select("row", F.posexplode("vec").alias("col_id", "v"))
    grouped = flat.groupBy(F.col("col_id").cast("bigint").alias("col_id")).agg(F.sort_array(F.collect_list(F.struct("row", "v"))).alias("r"))
    return grouped.select("col_id", F.transform("r", lambda x: x["v"]).alias("vec"))


def read_csv_matrix(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Comma-separated rows; `#` lines and blank ones are skipped, tokens that aren't numbers are dropped (strict: an error)."""
    lines = _lines(spark, path).filter("line <> '' AND NOT startswith(line, '#')")
    tokens = F.transform(F.split("line", ","), lambda t: F.trim(t))
    number = lambda t: t.try_cast("double")
    vec = F.filter(F.transform(tokens, number), lambda x: x.isNotNull())
    if strict and not lines.filter(F.exists(F.transform(tokens, number), lambda x: x.isNull())).isEmpty():
        raise ValueError("a token isn't a number")
    return _as_columns(_numbered(lines.select("at", vec.alias("vec"))))


def read_arff_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Rows after @data; `%` lines are comments, `?` and whatever isn't a number count as 0."""
    lines = _lines(spark, path).filter("line <> '' AND NOT startswith(line, '%')")
    start = lines.filter(F.lower("line").startswith("@data")).agg(F.min("at").alias("at")).first()["at"]
    if start is None:
        raise ValueError("the file has no @data")
    rows = lines.filter((F.col("at") > start) & ~F.col("line").startswith("@"))
    vec = F.transform(F.split("line", ","), lambda t: F.coalesce(F.trim(t).try_cast("double"), F.lit(0.0)))
    return _as_columns(_numbered(rows.select("at", vec.alias("vec"))))


def read_target(spark: SparkSession, path: str) -> DataFrame:
    """(col_id, y): one number a line; lines that aren't numbers (a header) are skipped."""
    rows = _lines(spark, path).select("at", F.col("line").try_cast("double").alias("y")).filter("y IS NOT NULL")
    return _numbered(rows.select("at", F.array("y").alias("vec"))).select(F.col("row").alias("col_id"), F.col("vec")[0].alias("y"))


def read_matrix(spark: SparkSession, path: str, target_path: str | None = None, **_) -> DataFrame:
    """(col_id, vec, y) by the path's extension: .arff, .csv or .data."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "arff":
        matrix = read_arff_matrix(spark, path)
    elif kind in ("csv", "data"):
        matrix = read_csv_matrix(spark, path)
    else:
        raise ValueError(f"no reader for .{kind}")
    if target_path is None:
        return matrix.withColumn("y", F.lit(None).cast("double"))
    target = read_target(spark, target_path)
    if target.count() != matrix.count():
        raise ValueError("the target isn't as long as the matrix is wide")
    return matrix.join(target, "col_id")


def folder_name(name: str) -> str:
    return name.replace(" ", "_")


CSV_COLUMNS = ["k", "pinv_spectral_norm_ratio", "pinv_frobenius_norm_ratio", "X_S_dag_X_spectral_norm_inv", "X_S_dag_X_frobenius_norm_inv", "wall_time_ms", "swap_count", "spectral_bound", "frobenius_bound", "volume_ratio", "regression_mse"]


def write_results(results: DataFrame, path: str) -> None:
    """Parquet partitioned by experiment and algorithm."""
    results.write.mode("overwrite").partitionBy("experiment", "algorithm").parquet(path)


def export_csv(results: DataFrame, path: str) -> None:
    """CSV of the eleven result columns in folders by experiment and algorithm; an untracked swap count is -1."""
    named = results.select(F.translate("experiment", " ", "_").alias("experiment"), F.translate("algorithm", " ", "_").alias("algorithm"), *(F.coalesce(c, F.lit(-1)).alias(c) if c == "swap_count" else F.col(c) for c in CSV_COLUMNS))
    named.write.mode("overwrite").partitionBy("experiment", "algorithm").option("header", True).csv(path)


def write_manifest(spark: SparkSession, path: str, config: dict, k_values: list[int], started: datetime) -> None:
    """The resolved config with its k values and run times, and an index of the experiments, as JSON."""
    resolved = {k: v for k, v in config.items() if not k.startswith("k_values")} | {"k_values": k_values, "start_time": started.isoformat(), "finish_time": datetime.now(timezone.utc).isoformat(), "threads": spark.sparkContext.defaultParallelism}
    spark.createDataFrame([(json.dumps(resolved, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def experiment_index(spark: SparkSession, path: str) -> DataFrame:
    """Sorted distinct names of the experiments under a results folder, from its partitions alone."""
    return spark.read.parquet(path).select("experiment").distinct().orderBy("experiment")
