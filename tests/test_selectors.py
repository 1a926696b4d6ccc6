import itertools
import math
from collections import Counter

import numpy as np
import pytest

from colsieve.functions.bounds import bound_value
from colsieve.operators import kernels
from colsieve.operators.registry import register_selector, run_kernel, select_subset, selector_names

FIXED = np.array([[1, 2, 3, 4, 5], [0, 6, 7, 8, 9], [0, 0, 10, 11, 12]], float)
RANDOM = ["random columns", "leverage scores", "forward iterative volume sampling", "reverse iterative volume sampling"]
EXCHANGE = ["dominant", "volume add-remove"]
BUILT_IN = [n for n in selector_names() if not n.startswith("test ")]


def matrices():
    rng = np.random.default_rng(1)
    yield FIXED
    yield np.array([[1, 2, 3], [4, 5, 7]], float)
    yield np.array([[1, 2, 3, 4, 5], [6, 7, 8, 9, 10]], float)
    yield rng.normal(size=(4, 15))
    yield rng.normal(size=(1, 6))


@pytest.mark.parametrize("name", BUILT_IN)
def test_subset_is_valid_and_meets_its_bounds(name):
    for x in matrices():
        m, n = x.shape
        for k in range(m + (name == "dual set"), n + 1):
            picks, swaps = run_kernel(name, x, k)
            assert len(set(picks)) == k and min(picks) >= 0 and max(picks) < n
            assert (swaps is not None) == (name in EXCHANGE)
            for norm in ("frobenius", "spectral"):
                ratio = kernels.pinv_norm(x, norm) / kernels.pinv_norm(x[:, picks], norm)
                assert ratio**2 >= bound_value(name, norm, m, n, k) * (1 - 1e-9)


@pytest.mark.parametrize("name", RANDOM)
def test_same_seed_same_calls(name):
    x = np.random.default_rng(42).normal(-1, 1, (5, 20))
    for k in range(5, 21):
        for call in range(3):
            a, b = (run_kernel(name, x, k, seed=12345, call=call)[0] for _ in range(2))
            assert a == b
    assert any(run_kernel(name, x, 7, seed=1, call=c)[0] != run_kernel(name, x, 7, seed=1, call=0)[0] for c in range(1, 4))


@pytest.mark.parametrize("name", ["forward iterative volume sampling", "reverse iterative volume sampling"])
def test_volume_sampling_follows_its_law(name):
    q = kernels.orthonormal_rows(FIXED)
    law = {s: np.linalg.det(q[:, s] @ q[:, s].T) for s in itertools.combinations(range(5), 3)}
    total, runs = sum(law.values()), 1500
    seen = Counter(tuple(sorted(run_kernel(name, FIXED, 3, trial=t)[0])) for t in range(runs))
    expected = {s: runs * p / total for s, p in law.items()}
    chi = sum((seen[s] - e) ** 2 / e for s, e in expected.items() if e > 5)
    assert chi < 27.9  # 9 degrees of freedom, one in a thousand


@pytest.mark.parametrize("init", ["cpqr", "greedy", "advanced"])
@pytest.mark.parametrize("name", EXCHANGE)
def test_exchange_ends_where_no_exchange_helps(name, init):
    x = np.random.default_rng(3).normal(size=(4, 20))
    for k in range(4, 12):
        picks, _ = run_kernel(name, x, k, c=1.0, initialization=init)
        volume = np.linalg.det(x[:, picks] @ x[:, picks].T)
        assert len(set(picks)) == k
        if name == "dominant":
            for i, j in itertools.product(picks, set(range(20)) - set(picks)):
                s = [p for p in picks if p != i] + [j]
                assert np.linalg.det(x[:, s] @ x[:, s].T) <= volume * (1 + 1e-8)


def test_single_steps_against_brute_force():
    x = np.random.default_rng(4).normal(size=(3, 9))
    full = range(9)
    drop = lambda f: min(full, key=f)
    trace = lambda s, v=x: np.trace(np.linalg.inv(v[:, s] @ v[:, s].T))
    assert set(run_kernel("frobenius removal", x, 8)[0]) == set(full) - {drop(lambda j: trace([p for p in full if p != j]))}
    q = kernels.orthonormal_rows(x)
    assert set(run_kernel("spectral removal", x, 8)[0]) == set(full) - {drop(lambda j: trace([p for p in full if p != j], q))}
    assert set(run_kernel("volume removal", x, 8)[0]) == set(full) - {drop(lambda j: -np.linalg.det(x[:, [p for p in full if p != j]] @ x[:, [p for p in full if p != j]].T))}
    start = kernels.frobenius_pivoting(q)
    assert set(run_kernel("frobenius selection", x, 4)[0]) - set(start) == {min(set(full) - set(start), key=lambda j: trace([*start, j], q))}


def test_derandomized_volume_minimises_the_conditional_mean():
    x = np.random.default_rng(5).normal(size=(3, 8))
    q = kernels.orthonormal_rows(x)

    def mean(chosen, k):
        sets = [list(chosen) + list(t) for t in itertools.combinations(set(range(8)) - set(chosen), k - len(chosen))]
        dets = [np.linalg.det(q[:, s] @ q[:, s].T) for s in sets]
        return sum(d * np.trace(np.linalg.inv(q[:, s] @ q[:, s].T)) for d, s in zip(dets, sets, strict=True)) / sum(dets)

    for k in range(3, 8):
        picks, _ = run_kernel("derandomized volume", x, k)
        for t in range(k):
            best = min(mean([*picks[:t], j], k) for j in set(range(8)) - set(picks[:t]))
            assert mean(picks[: t + 1], k) <= best * (1 + 1e-7)


def test_distributed_forms_check_the_contract_and_the_start(spark):
    x = np.random.default_rng(8).normal(size=(20, 60))
    df = spark.createDataFrame([(j, x[:, j].tolist()) for j in range(60)], "col_id bigint, vec array<double>")
    for name in ("random columns", "leverage scores"):
        for k in (10, 61):
            with pytest.raises(ValueError):
                select_subset(df, k, name, path="distributed")
    with pytest.raises(ValueError):
        select_subset(df, 30, "volume add-remove", path="distributed", initialization="advanced")
    for init in ("cpqr", "greedy"):
        picks, swaps = run_kernel("volume add-remove", x, 25, c=1.0, initialization=init)
        rows = select_subset(df, 25, "volume add-remove", path="distributed", c=1.0, initialization=init).collect()
        assert {r["col_id"] for r in rows} == set(picks) and rows[0]["swap_count"] == swaps


def test_contract_is_checked():
    for k in (2, 6):
        with pytest.raises(ValueError):
            run_kernel("dominant", FIXED, k)
    with pytest.raises(ValueError):
        run_kernel("dual set", FIXED, 3)
    with pytest.raises(ValueError):
        run_kernel("dominant", FIXED, 3, c=0.5)
    with pytest.raises(ValueError):
        run_kernel("nothing", FIXED, 3)
    with pytest.raises(ValueError):
        run_kernel("volume removal", np.vstack([FIXED, FIXED[0]])[:, :], 5 - 1)
    with pytest.raises(ValueError):
        bound_value("dual set", "frobenius", 3, 5, 3)
    assert run_kernel("volume removal", FIXED, 5)[0] == list(range(5))


def test_secular_eigenvalues():
    cases = [([1, 2, 4], [0.5, 1, 2]), ([1, 2, 3], [0, 1, 0]), ([1, 1, 2], [1, 2, 1]), ([0, 0, 0], [1, 2, 2]), ([3], [2]), ([5, 5, 5], [0, 0, 0]), ([1, 1, 1, 1], [1, 1, 1, 1]), (list(range(1, 21)), [1 / (i + 1) for i in range(20)])]
    for d, v in cases:
        d, v = np.array(d, float), np.array(v, float)
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(v, v))
        assert np.abs(kernels.secular_eigenvalues(d, v) - want).max() <= 1e-13 * max(1, np.abs(want).max())


def test_pinv_norm_of_odd_matrices():
    assert kernels.pinv_norm(np.zeros((0, 0)), "spectral") == 0
    assert kernels.pinv_norm(np.ones((2, 2)), "frobenius") == math.inf


def as_frame(spark, x):
    return spark.createDataFrame([(j, x[:, j].tolist()) for j in range(x.shape[1])], "col_id bigint, vec array<double>")


def test_distributed_forms_agree_with_kernels(spark):
    x = np.random.default_rng(6).normal(size=(3, 30))
    df = as_frame(spark, x)
    for name in ("random columns", "leverage scores", "forward iterative volume sampling", "frobenius selection", "volume add-remove"):
        got = {r["col_id"] for r in select_subset(df, 6, name, path="distributed", seed=3).collect()}
        assert got == set(run_kernel(name, x, 6, seed=3)[0]), name
    with pytest.raises(ValueError):
        select_subset(df, 6, "frobenius removal", path="distributed")


def test_selectors_of_the_barrier_and_maxvol_run_beyond_the_kernel_limit(spark, monkeypatch):
    from colsieve.operators import registry

    x = np.random.default_rng(9).normal(size=(4, 60))
    x[:, 30:40] = 20 * x[:, :10]
    df = as_frame(spark, x)
    monkeypatch.setattr(registry, "KERNEL_DOUBLES", 100)
    for name in ("dual set", "rect-maxvol"):
        for k in (7, 60):
            assert [r["col_id"] for r in select_subset(df, k, name).orderBy("rank").collect()] == run_kernel(name, x, k)[0], (name, k)


def test_dominant_and_volume_removal_run_beyond_the_kernel_limit(spark, monkeypatch):
    from colsieve.operators import distributed, registry

    x = np.random.default_rng(11).normal(size=(4, 70))
    x[:, 30:40] = 3 * x[:, :10]
    x[:, 60:] = x[:, 50:60]  # ties
    df = as_frame(spark, x)
    monkeypatch.setattr(registry, "KERNEL_DOUBLES", 100)
    for c, init in ((1.0, "greedy"), (1.0, "cpqr"), (1.5, "cpqr")):
        picks, swaps = run_kernel("dominant", x, 9, c=c, initialization=init)
        rows = select_subset(df, 9, "dominant", c=c, initialization=init).orderBy("rank").collect()
        assert [r["col_id"] for r in rows] == picks and rows[0]["swap_count"] == swaps
    assert select_subset(df, 70, "dominant").count() == 70
    with pytest.raises(ValueError):
        select_subset(df, 9, "dominant", c=0.5)
    for held in (8, 80, 4_000_000):  # 2 columns a pass, 20, and all at once
        monkeypatch.setattr(distributed, "HELD_DOUBLES", held)
        for k in (55, 70) if held == 8 else (4, 9):
            assert [r["col_id"] for r in select_subset(df, k, "volume removal").orderBy("rank").collect()] == run_kernel("volume removal", x, k)[0], (held, k)


def test_many_matrices_and_user_selectors(spark):
    register_selector("test last", lambda x, k, ids, **_: list(range(x.shape[1] - k, x.shape[1])))
    assert not register_selector("test last", lambda *_: [])
    from pyspark.sql import functions as F

    df = as_frame(spark, FIXED)
    both = df.withColumn("mid", F.lit(1)).unionByName(df.withColumn("mid", F.lit(2)))
    rows = select_subset(both, 3, "test last", matrix_col="mid").collect()
    assert {(r["matrix_id"], r["col_id"]) for r in rows} == {(m, c) for m in (1, 2) for c in (2, 3, 4)}
    assert {r["swap_count"] for r in rows} == {None}
