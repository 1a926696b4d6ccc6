"""Quality of a selection from m x m Grams: pinv-norm ratios, volume ratio, regression error."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsieve.functions.linalg import dot, gram_matrix, norms_of_gram, whitener
from colsieve.session import materialize

METRICS = {
    "spectral": "pinv_spectral_norm_ratio",
    "frobenius": "pinv_frobenius_norm_ratio",
    "spectral_inv": "X_S_dag_X_spectral_norm_inv",
    "frobenius_inv": "X_S_dag_X_frobenius_norm_inv",
    "time": "wall_time_ms",
    "volume": "volume_ratio",
    "mse": "regression_mse",
}


def kernel_metrics(x: np.ndarray, picks: list[int], y: np.ndarray | None = None) -> dict[str, float | None]:
    """Metrics of one selection in memory; ratios are None for a matrix without full row rank."""
    from colsieve.operators.kernels import pinv_norm

    s, t = np.linalg.svd(x, compute_uv=False), x[:, picks]
    full = s[-1] > s[0] * np.finfo(float).eps
    out: dict[str, float | None] = dict.fromkeys(("pinv_spectral_norm_ratio", "pinv_frobenius_norm_ratio", "X_S_dag_X_spectral_norm_inv", "X_S_dag_X_frobenius_norm_inv", "volume_ratio"))
    if full:
        q = np.linalg.qr(x.T)[0].T[:, picks]
        sub = np.linalg.svd(t, compute_uv=False)
        out |= {"pinv_spectral_norm_ratio": pinv_norm(x, "spectral") / pinv_norm(t, "spectral"), "pinv_frobenius_norm_ratio": pinv_norm(x, "frobenius") / pinv_norm(t, "frobenius"), "X_S_dag_X_spectral_norm_inv": 1 / pinv_norm(q, "spectral"), "X_S_dag_X_frobenius_norm_inv": 1 / pinv_norm(q, "frobenius")}
        with np.errstate(divide="ignore"):
            out["volume_ratio"] = float(np.exp(np.log(sub).sum() - np.log(s).sum()))
    out["regression_mse"] = math.nan
    if y is not None:
        beta = np.linalg.lstsq(t.T, y[picks], rcond=None)[0]
        out["regression_mse"] = float(((x.T @ beta - y) ** 2).mean())
    return out


def selection_metrics(df: DataFrame, selection: DataFrame, target: str | None = None) -> dict[str, float]:
    """The same for a distributed matrix (col_id, vec[, y]): two Grams and, with a target, one pass for the error."""
    df = materialize(df, "columns")
    chosen = materialize(df.join(selection.select("col_id"), "col_id", "left_semi"), "chosen")
    g, gs = gram_matrix(df), gram_matrix(chosen)
    whole, part = norms_of_gram(g), norms_of_gram(gs)
    w = whitener(g)
    values = np.linalg.eigvalsh(w @ gs @ w.T)
    out = {f"pinv_{n}_norm_ratio": whole[n] / part[n] for n in ("spectral", "frobenius")}
    out |= {"X_S_dag_X_spectral_norm_inv": float(np.sqrt(max(values[0], 0))), "X_S_dag_X_frobenius_norm_inv": float(1 / np.sqrt((1 / values).sum())) if values[0] > 0 else 0.0}
    out["volume_ratio"] = float(np.exp((np.linalg.slogdet(gs)[1] - np.linalg.slogdet(g)[1]) / 2))
    out["regression_mse"] = math.nan
    if target:
        xy = chosen.select(F.posexplode("vec").alias("i", "v"), target).groupBy("i").agg(F.sum(F.col("v") * F.col(target)).alias("s"))
        rhs = np.zeros(len(g))
        for r in xy.collect():
            rhs[r["i"]] = r["s"]
        beta = np.linalg.solve(gs, rhs)
        out["regression_mse"] = df.select(F.avg(F.pow(dot(F.col("vec"), F.array(*map(F.lit, beta.tolist()))) - F.col(target), 2)).alias("e")).first()["e"]
    return out
