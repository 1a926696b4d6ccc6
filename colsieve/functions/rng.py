"""Stateless uniforms keyed by (seed, call, trial, id): independent of partitioning and equal in every engine."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = float(1 << 52)


def uniform(seed: int, call: int, trial: int, key: Column) -> Column:
    """Uniform in (0, 1) from the first 13 hex digits of an MD5."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(call)), F.lit(str(trial)), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(_RANGE)


def uniform_sql(seed: int, call: int, trial: int, key: str) -> str:
    """The same uniform as SQL for engines that read '0x' integers."""
    return f"((('0x' || substr(md5('{seed}|{call}|{trial}|' || CAST({key} AS VARCHAR)), 1, 13))::BIGINT)::DOUBLE + 0.5) / {_RANGE!r}"


def uniform_array(seed: int, call: int, trial: int, keys: np.ndarray) -> np.ndarray:
    return np.array([(int(hashlib.md5(f"{seed}|{call}|{trial}|{k}".encode()).hexdigest()[:13], 16) + 0.5) / _RANGE for k in keys.tolist()])


def normal(seed: int, call: int, trial: int, key: Column) -> Column:
    """Standard normal by Box-Muller from two uniforms."""
    a, b = (uniform(seed, call, trial, F.concat_ws("|", key.cast("string"), F.lit(x))) for x in ("a", "b"))
    return F.sqrt(-2 * F.log(a)) * F.cos(2 * F.lit(float(np.pi)) * b)
