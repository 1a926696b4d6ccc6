"""Lower bounds on the squared ratio of pseudoinverse norms, as column expressions over (m, n, k).

One SQL text for each (selector, norm) serves Spark columns, plain numbers and oracles alike. Selectors without
a guarantee have bound 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FROBENIUS, SPECTRAL = "frobenius", "spectral"

_REMOVAL = "(k - m + 1e0) / (n - m + 1e0)"
_ADDED = "k * 1e0 / (m * (n - m + 1e0))"
_BARRIER = "CASE WHEN m = 1 THEN k * 1e0 / n ELSE pow((k - sqrt((k - 1e0) * m + 1)) / (sqrt((k - 1e0) * m + 1) - 1), 2) * m / n END"
_DUAL = "CASE WHEN k > m THEN pow((sqrt(k + 1e0) - sqrt(m * 1e0)) / (sqrt(n * 1e0) + sqrt(k + 1e0)), 2) ELSE NULL END"
_INTERLACED = "CASE WHEN k = n THEN 1e0 ELSE pow((sqrt((k + 1e0) * (n - m)) - sqrt(m * (n - k - 1e0))) / n, 2) END"


def _exchange(k: str) -> tuple[str, str]:
    excess = f"((m + (c - 1e0) * {k}) * (n - {k}) / ({k} - m + 1e0))"
    return f"m / (m + {excess})", f"1e0 / (1e0 + {excess})"


def _expressions() -> dict[tuple[str, str], str]:
    swap_f, swap_s = _exchange("k")
    start_f, start_s = _exchange("m")
    table = {
        "random columns": ("0e0", "0e0"),
        "leverage scores": ("0e0", "0e0"),
        "forward iterative volume sampling": ("0e0", "0e0"),
        "reverse iterative volume sampling": ("0e0", "0e0"),
        "volume removal": ("0e0", "0e0"),
        "derandomized volume": ("0e0", "0e0"),
        "frobenius removal": (_REMOVAL, f"{_REMOVAL} / m"),
        "spectral removal": (f"{_REMOVAL} / m", "1e0 / (1e0 + m * (n - k) / (k - m + 1e0))"),
        "frobenius selection": (_ADDED, f"{_ADDED} / m"),
        "spectral selection": (_BARRIER, _BARRIER),
        "dual set": (_DUAL, _DUAL),
        "dominant": (swap_f, swap_s),
        "volume add-remove": (swap_f, swap_s),
        "rect-maxvol": (start_f, start_s),
        "interlacing families": (_INTERLACED, _INTERLACED),
    }
    return {(name, norm): text for name, pair in table.items() for norm, text in zip((FROBENIUS, SPECTRAL), pair, strict=True)}


EXPRESSIONS = _expressions()


def bound_sql(selector: str, norm: str, c: float = 1.0) -> str:
    """The bound as SQL over columns m, n, k."""
    if (selector, norm) not in EXPRESSIONS:
        raise ValueError(f"no such selector or norm: {selector!r}, {norm!r}")
    return EXPRESSIONS[selector, norm].replace("(c - 1e0)", f"({float(c)!r}e0 - 1e0)")


def bound(selector: str, norm: str, c: float = 1.0) -> Column:
    return F.expr(f"CAST({bound_sql(selector, norm, c)} AS DOUBLE)")


def bound_value(selector: str, norm: str, m: int, n: int, k: int, c: float = 1.0) -> float:
    """The bound for plain numbers, with the contract 1 <= m <= k <= n (dual set: m < k)."""
    if not 1 <= m <= k <= n:
        raise ValueError(f"1 <= m <= k <= n doesn't hold: {m}, {k}, {n}")
    if selector == "dual set" and k == m:
        raise ValueError("dual set needs k > m")
    if (selector, norm) not in EXPRESSIONS:
        raise ValueError(f"no such selector or norm: {selector!r}, {norm!r}")
    excess = lambda q: (m + (c - 1) * q) * (n - q) / (q - m + 1)
    frobenius = norm == FROBENIUS
    match selector:
        case "frobenius removal":
            return (k - m + 1) / (n - m + 1) / (1 if frobenius else m)
        case "spectral removal":
            return (k - m + 1) / ((n - m + 1) * m) if frobenius else 1 / (1 + m * (n - k) / (k - m + 1))
        case "frobenius selection":
            return k / (m * (n - m + 1)) / (1 if frobenius else m)
        case "spectral selection":
            alpha = math.sqrt((k - 1) * m + 1)
            return k / n if m == 1 else m / n * ((k - alpha) / (alpha - 1)) ** 2
        case "dual set":
            return ((math.sqrt(k + 1) - math.sqrt(m)) / (math.sqrt(n) + math.sqrt(k + 1))) ** 2
        case "dominant" | "volume add-remove" | "rect-maxvol":
            e = excess(m if selector == "rect-maxvol" else k)
            return m / (m + e) if frobenius else 1 / (1 + e)
        case "interlacing families":
            return 1.0 if k == n else ((math.sqrt((k + 1) * (n - m)) - math.sqrt(m * (n - k - 1))) / n) ** 2
    return 0.0


def orthonormal_curve(norm: str) -> Column:
    """The analytic curve for matrices with orthonormal rows (square root of the spectral removal bound)."""
    return F.sqrt(bound("spectral removal", norm))


def bounds_grid(spark: SparkSession, sizes: DataFrame, c: float = 1.0) -> DataFrame:
    """(selector, norm, m, n, k, bound) for every row (m, n, k) of sizes; one pass, the list of bounds is an array literal."""
    entries = [F.struct(F.lit(s).alias("selector"), F.lit(q).alias("norm"), bound(s, q, c).alias("bound")) for s, q in sorted(EXPRESSIONS)]
    return sizes.filter("m >= 1 AND m <= k AND k <= n").select("m", "n", "k", F.explode(F.array(*entries)).alias("e")).select("e.selector", "e.norm", "m", "n", "k", "e.bound")
