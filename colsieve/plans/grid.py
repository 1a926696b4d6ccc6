"""The experiment grid: (k) x (trial) x (algorithm) over generated matrices.

All algorithms of a trial see one matrix. Matrices are functions of (seed, trial), so tasks don't wait for one another.
A task takes one trial and a share of its k values; there are as many shares as keep the cluster busy, so that a
matrix isn't moved once for each k.
"""

from __future__ import annotations

import itertools
import math
import time
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsieve.functions.bounds import EXPRESSIONS, bound_value
from colsieve.operators.registry import run_kernel, selector
from colsieve.plans.metrics import kernel_metrics
from colsieve.session import ship_package
from colsieve.sources import files
from colsieve.sources.generators import generate

_BOUNDED = {name for name, _ in EXPRESSIONS}

RESULT_SCHEMA = (
    "experiment string, algorithm string, trial int, k bigint, pinv_spectral_norm_ratio double, pinv_frobenius_norm_ratio double, "
    "X_S_dag_X_spectral_norm_inv double, X_S_dag_X_frobenius_norm_inv double, wall_time_ms double, swap_count bigint, "
    "spectral_bound double, frobenius_bound double, volume_ratio double, regression_mse double"
)


@dataclass
class Algorithm:
    name: str
    params: dict = field(default_factory=dict)
    label: str | None = None

    @classmethod
    def of(cls, config: dict) -> Algorithm:
        if "name" not in config:
            raise ValueError("an algorithm needs a name")
        params = {k: v for k, v in config.items() if k not in ("name", "label")}
        if config["name"] in ("dominant", "volume add-remove", "rect-maxvol") and "c" not in params:
            raise ValueError(f"{config['name']} needs c")
        selector(config["name"])
        init = f" {params['initialization']}" if "initialization" in params else ""
        return cls(config["name"], params, config.get("label", config["name"] + init))


@dataclass
class Experiment:
    name: str
    matrix: dict
    algorithms: list[Algorithm]
    k_values: list[int]
    trials: int = 1
    enabled: bool = True

    @classmethod
    def of(cls, config: dict) -> Experiment:
        return cls(config.get("name", config["matrix"]["type"]), config["matrix"], [Algorithm.of(a) for a in config["algorithms"]], k_values(config), int(config.get("trials", config.get("n_trials", 1))), config.get("enabled", True))


def k_values(config: dict) -> list[int]:
    """k_values, else k_values_range, else k_values_ranges; stops are inclusive."""
    spans = lambda r: range(r["start"], r["stop"] + 1, r.get("step", 1))
    if "k_values" in config:
        return list(config["k_values"])
    if "k_values_range" in config:
        return list(spans(config["k_values_range"]))
    if "k_values_ranges" in config:
        return [k for r in config["k_values_ranges"] for k in spans(r)]
    raise ValueError("the experiment names no k values")


def shares_of(ks: list[int], trials: int, tasks: int) -> list[list[int]]:
    """k values in as many shares as give `trials` times them at least `tasks` tasks, as far as there are values."""
    n = max(1, min(len(ks), math.ceil(tasks / max(1, trials))))
    return [ks[i::n] for i in range(n)]


def run_experiment(spark: SparkSession, experiment: Experiment, scalar: str = "double") -> DataFrame:
    """Result rows (RESULT_SCHEMA). Trials' matrices are built as DataFrames, then a task runs each share of a trial's k values.

    scalar "float" rounds the matrices to single precision; arithmetic on them stays double.
    """
    ship_package(spark)
    if not experiment.enabled or not experiment.k_values:
        return spark.createDataFrame([], RESULT_SCHEMA)
    kind = experiment.matrix["type"]
    params = {{"rows": "m", "cols": "n"}.get(k, k): v for k, v in experiment.matrix.items() if k != "type"}
    fixed = kind == "matrix from file"
    parts = [generate(spark, kind, **params, **({} if fixed else {"trial": t})).withColumn("trial", F.lit(t)) for t in range(experiment.trials)]
    columns = parts[0]
    for p in parts[1:]:
        columns = columns.unionByName(p)
    if "y" not in columns.columns:
        columns = columns.withColumn("y", F.lit(None).cast("double"))
    matrices = columns.groupBy("trial").agg(F.sort_array(F.collect_list(F.struct("col_id", "vec", "y"))).alias("columns"))  # a matrix fits a task by contract
    shares = shares_of(experiment.k_values, experiment.trials, 2 * spark.sparkContext.defaultParallelism)
    grid = matrices.select("trial", "columns", F.explode(F.array(*(F.array(*map(F.lit, s)) for s in shares)).cast("array<array<bigint>>")).alias("ks"))
    name, algorithms, dtype = experiment.name, experiment.algorithms, np.float32 if scalar == "float" else np.float64

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for trial, columns, ks in zip(batch["trial"], batch["columns"], batch["ks"], strict=True):
                ids = np.array([c["col_id"] for c in columns])
                x = np.array([c["vec"] for c in columns], dtype).T.astype(float)
                y = np.array([c["y"] for c in columns], float) if columns[0]["y"] is not None else None
                rows = []
                for k, a in itertools.product(map(int, ks), algorithms):
                    if not (x.shape[0] <= k <= x.shape[1]) or (a.name == "dual set" and k == x.shape[0]):
                        continue  # outside the algorithm's contract
                    began = time.perf_counter()
                    picks, swaps = run_kernel(a.name, x, k, ids, trial=int(trial), **a.params)
                    spent = 1000 * (time.perf_counter() - began)
                    guarantee = {n: np.sqrt(bound_value(a.name, n, *x.shape, k, a.params.get("c", 1.0))) for n in ("spectral", "frobenius")} if a.name in _BOUNDED else {"spectral": 0.0, "frobenius": 0.0}
                    rows.append({"experiment": name, "algorithm": a.label or a.name, "trial": trial, "k": k, **kernel_metrics(x, picks, y), "wall_time_ms": spent, "swap_count": swaps, "spectral_bound": guarantee["spectral"], "frobenius_bound": guarantee["frobenius"]})
                if rows:
                    out = pd.DataFrame(rows)
                    out["swap_count"] = out["swap_count"].astype("Int64")
                    yield out[[c.split()[0] for c in RESULT_SCHEMA.split(", ")]]

    return grid.repartition(len(shares) * experiment.trials, "trial", "ks").mapInPandas(run, RESULT_SCHEMA)


def run_grid(spark: SparkSession, config: dict) -> DataFrame:
    """All enabled experiments of a config {"scalar", "experiments": [...]}."""
    scalar = config.get("scalar", "double")
    if scalar not in ("float", "double"):
        raise ValueError("scalar must be float or double")
    out = None
    for e in (Experiment.of(c) for c in config["experiments"] if c.get("enabled", True)):
        rows = run_experiment(spark, e, scalar)
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], RESULT_SCHEMA)


def run_to_folder(spark: SparkSession, config: dict, path: str) -> DataFrame:
    """Run a config into a folder and return its results, read back.

    results/ has them as Parquet, csv/ as text, both by experiment and algorithm; config/ is the resolved config with its k values
    and run times, index/ the names of the experiments, as JSON.
    """
    started = datetime.now(timezone.utc)
    enabled = [e for e in config["experiments"] if e.get("enabled", True)]
    files.write_results(run_grid(spark, config), f"{path}/results")
    results = spark.read.schema(RESULT_SCHEMA).parquet(f"{path}/results")
    files.export_csv(results, f"{path}/csv")
    files.write_manifest(spark, f"{path}/config", config, sorted({k for e in enabled for k in k_values(e)}), started)
    results.select("experiment").distinct().orderBy("experiment").coalesce(1).write.mode("overwrite").json(f"{path}/index")
    return results
