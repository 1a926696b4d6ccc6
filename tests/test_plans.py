import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colsieve.functions import bounds, linalg, rng
from colsieve.plans import grid, metrics, prep, stats, tt
from colsieve.plans.queries import example_train, operator_train
from colsieve.sources import files, generators


def test_bound_columns_equal_bound_values(spark):
    sizes = spark.createDataFrame([(3, 5, 4), (1, 8, 2), (10, 100, 40), (3, 5, 5)], "m int, n int, k int")
    for r in bounds.bounds_grid(spark, sizes).collect():
        if not (r["selector"] == "dual set" and r["k"] == r["m"]):
            assert r["bound"] == pytest.approx(bounds.bound_value(r["selector"], r["norm"], r["m"], r["n"], r["k"]), rel=1e-12)


def test_uniforms_are_the_same_in_both_forms(spark):
    got = [r[0] for r in spark.range(50).select(rng.uniform(3, 1, 2, F.col("id"))).collect()]
    assert got == rng.uniform_array(3, 1, 2, np.arange(50)).tolist()


def test_linear_algebra(spark):
    x = np.random.default_rng(0).normal(size=(20, 80))
    df = spark.createDataFrame([(j, x[:, j].tolist()) for j in range(80)], "col_id bigint, vec array<double>").repartition(3)
    assert np.allclose(linalg.gram_matrix(df), x @ x.T)
    rel = {(r["i"], r["j"]): r["v"] for r in linalg.gram_relational(df).collect()}
    assert all(math.isclose(rel[i, j], (x @ x.T)[i, j], rel_tol=1e-9, abs_tol=1e-9) for i in range(20) for j in range(20))
    q = np.array([r["vec"] for r in linalg.whiten(df).orderBy("col_id").collect()]).T
    assert np.allclose(q @ q.T, np.eye(20), atol=1e-12)
    n = linalg.pinv_norms(df)
    assert n["frobenius"] == pytest.approx(np.linalg.norm(np.linalg.pinv(x))) and n["spectral"] == pytest.approx(np.linalg.norm(np.linalg.pinv(x), 2))
    assert linalg.pinv_norms(df.limit(0)) == {"frobenius": 0.0, "spectral": 0.0}


def test_generators(spark):
    def matrix(df):
        return np.array([r["vec"] for r in df.orderBy("col_id").collect()]).T

    assert matrix(generators.generate(spark, "zero matrix", m=2, n=3)).tolist() == [[0.0] * 3] * 2
    g = matrix(generators.generate(spark, "gaussian matrix", m=10, n=300, seed=1))
    assert abs(g.mean()) < 0.06 and abs(g.std() - 1) < 0.06
    for m, n in ((4, 20), (20, 4)):
        q = matrix(generators.generate(spark, "matrix with orthonormal rows or columns", m=m, n=n))
        assert q.shape == (m, n) and np.allclose(q @ q.T if m < n else q.T @ q, np.eye(4), atol=1e-10)
    s = matrix(generators.generate(spark, "matrix with a given set of singular values", m=4, n=9, sigma=[3.0, 2.0]))
    assert np.allclose(np.linalg.svd(s, compute_uv=False)[:2], [3, 2])
    for kind in ("graph incidence matrix", "weighted graph incidence matrix"):
        v = matrix(generators.generate(spark, kind, m=5, n=9, seed=2))
        assert v.shape == (5, 9) and np.allclose(v @ v.T, np.eye(5), atol=1e-10)
    with pytest.raises(ValueError):
        generators.generate(spark, "graph incidence matrix", m=5, n=50)
    with pytest.raises(ValueError):
        generators.generate(spark, "nothing")
    assert not generators.connected([(0, 1)], 3) and generators.connected([(0, 1), (2, 1)], 3)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# head\n1, 2,x,3\n\n4,5,6\n7,8,9\n1,1,2\n")
    got = {r["col_id"]: r["vec"] for r in files.read_matrix(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {0: [1, 2, 3], 1: [4, 5, 6], 2: [7, 8, 9], 3: [1, 1, 2]}
    with pytest.raises(ValueError):
        files.read_csv_matrix(spark, str(tmp_path / "a.csv"), strict=True)
    (tmp_path / "b.arff").write_text("% c\n@relation r\n@attribute x numeric\n@data\n1,?,red\n2,3,4\n")
    (tmp_path / "y.csv").write_text("y\n10\n20\n30\n")
    rows = files.read_matrix(spark, str(tmp_path / "b.arff"), target_path=str(tmp_path / "y.csv")).collect()
    assert {r["col_id"]: (r["vec"], r["y"]) for r in rows} == {0: ([1, 2], 10), 1: ([0, 3], 20), 2: ([0, 4], 30)}
    (tmp_path / "c.data").write_text("1,2\n3\n")
    (tmp_path / "d.txt").write_text("1")
    (tmp_path / "e.arff").write_text("@relation r\n")
    for name in ("c.data", "d.txt", "e.arff"):
        with pytest.raises(ValueError):
            files.read_matrix(spark, str(tmp_path / name))


def test_grid_and_sinks(spark, tmp_path):
    config = {"name": "two words", "matrix": {"type": "gaussian matrix", "rows": 3, "cols": 12, "seed": 1}, "trials": 2, "k_values_ranges": [{"start": 3, "stop": 5}, {"start": 8, "stop": 8}], "algorithms": [{"name": "dominant", "c": 1}, {"name": "dual set"}, {"name": "spectral removal"}]}
    rows = grid.run_grid(spark, {"experiments": [config]}).cache()
    got = rows.toPandas()
    assert len(got) == 2 * (4 * 2 + 3) and sorted(got.k.unique()) == [3, 4, 5, 8]
    assert (got.pinv_frobenius_norm_ratio >= got.frobenius_bound * (1 - 1e-9)).all() and (got.pinv_spectral_norm_ratio >= got.spectral_bound * (1 - 1e-9)).all()
    assert got[got.algorithm == "dominant"].swap_count.notna().all() and got[got.algorithm == "dual set"].swap_count.isna().all()
    files.write_results(rows, str(tmp_path / "out"))
    assert [r[0] for r in files.experiment_index(spark, str(tmp_path / "out")).collect()] == ["two words"]
    files.export_csv(rows, str(tmp_path / "csv"))
    assert (tmp_path / "csv" / "experiment=two_words" / "algorithm=dual_set").exists()
    single = grid.run_grid(spark, {"scalar": "float", "experiments": [config]}).toPandas()
    assert len(single) == len(got) and not (single.pinv_spectral_norm_ratio == got.pinv_spectral_norm_ratio).all()
    assert [len(grid.shares_of(list(range(101)), trials, 16)) for trials in (1, 4, 64)] == [16, 4, 1]
    assert sorted(k for s in grid.shares_of(list(range(101)), 4, 16) for k in s) == list(range(101))
    back = grid.run_to_folder(spark, {"experiments": [config, {"enabled": False}]}, str(tmp_path / "run")).toPandas()
    keys = ["algorithm", "trial", "k"]
    assert back.sort_values(keys).pinv_spectral_norm_ratio.tolist() == got.sort_values(keys).pinv_spectral_norm_ratio.tolist()
    assert json.loads(spark.read.text(str(tmp_path / "run" / "config")).first()[0])["k_values"] == [3, 4, 5, 8]
    assert [r[0] for r in spark.read.json(str(tmp_path / "run" / "index")).collect()] == ["two words"]
    assert grid.run_to_folder(spark, {"experiments": []}, str(tmp_path / "none")).count() == 0
    for bad in ({"matrix": {"type": "zero matrix"}, "algorithms": []}, {"k_values": [1], "matrix": {"type": "zero matrix"}, "algorithms": [{"name": "dominant"}]}):
        with pytest.raises(ValueError):
            grid.Experiment.of(bad)


def test_metrics_agree(spark):
    rng_ = np.random.default_rng(2)
    x, y = rng_.normal(size=(3, 25)), rng_.normal(size=25)
    df = spark.createDataFrame([(j, x[:, j].tolist(), float(y[j])) for j in range(25)], "col_id bigint, vec array<double>, y double")
    picks = [0, 3, 4, 9, 20]
    a, b = metrics.kernel_metrics(x, picks, y), metrics.selection_metrics(df, df.filter(F.col("col_id").isin(picks)), "y")
    assert all(a[k] == pytest.approx(b[k], rel=1e-9) for k in b)
    assert metrics.kernel_metrics(np.ones((2, 4)), [0, 1])["volume_ratio"] is None


def test_statistics(spark):
    rows = [("a", 1, 1.0, 2), ("a", 1, 3.0, -1), ("b", 1, 5.0, 0), ("b", 2, float("nan"), 4), ("a", 2, 2.0, 8)]
    df = spark.createDataFrame(rows, "algorithm string, k bigint, volume_ratio double, swap_count bigint")
    got = {(r["algorithm"], r["k"]): (r["mean"], r["std"]) for r in stats.mean_std(df, "volume_ratio").collect()}
    assert got == {("a", 1): (2.0, pytest.approx(math.sqrt(2))), ("b", 1): (5.0, 0.0), ("a", 2): (2.0, 0.0)}
    assert {r["k"]: r["dispersion"] for r in stats.dispersion(df, "volume_ratio").collect()} == {1: pytest.approx(3 / 3.5), 2: None}
    assert {(r["algorithm"], r["k"]): r["p25"] for r in stats.swap_quantiles(df).collect()} == {("a", 1): 2, ("b", 1): 0.5, ("b", 2): 4, ("a", 2): 8}
    assert sum(r["n"] for r in stats.distribution(df, "volume_ratio", [1]).collect()) == 3


def test_abalone_preparation(spark):
    rows = [(i, "FIM"[i % 3], *(float(i * (j + 1)) for j in range(7)), i) for i in range(6)]
    df = spark.createDataFrame(rows, ["id", *prep.ABALONE_COLUMNS])
    got = prep.abalone(df).orderBy("col_id").collect()
    x = np.array([r["vec"] for r in got])
    assert x.shape == (6, 10) and x[:, :2].tolist() == [[0, 0], [1, 0], [0, 1]] * 2
    assert np.allclose(x[:, 2:9].mean(0), 0) and np.allclose(x[:, 2:9].std(0), 1) and (x[:, 9] == 1).all()


def test_tensor_trains(spark):
    cores = example_train()
    full = tt.dense(cores)
    table = tt.train_table(spark, cores)
    assert tt.valid_chain(table)
    got = {r["index"]: r["v"] for r in tt.to_dense(table, [3, 4, 2]).collect()}
    assert np.allclose([got[i] for i in range(24)], full.ravel(order="F"))
    for f in (tt.left_orthogonalize, tt.right_orthogonalize, tt.compress):
        assert np.allclose(tt.dense(f(cores)), full, rtol=1e-10)
    for g in tt.left_orthogonalize(cores)[:-1]:
        u = tt.left_unfolding(g)
        assert np.allclose(u.T @ u, np.eye(u.shape[1]))
    for extra in (0, 1):
        skeleton, slabs = tt.select_indices(cores, oversampling=extra)
        for k, s in enumerate(slabs):
            for p, i, q in np.ndindex(*s.shape):
                index = (*(skeleton.left_tuple(k - 1, p) if k else ()), i, *(skeleton.right_tuple(k, q) if k < 2 else ()))
                assert s[p, i, q] == pytest.approx(full[index], rel=1e-9)
        assert np.allclose(tt.dense(tt.cores_from_fibers(slabs, skeleton)), full, rtol=1e-8)
    ops = operator_train()
    applied = tt.to_dense(tt.zip_trains(tt.train_table(spark, ops), table, {0: 3, 1: 4, 2: 2}), [3, 4, 2])
    want = full
    for axis, (g, n) in enumerate(zip(ops, (3, 4, 2), strict=True)):
        want = np.moveaxis(np.tensordot(g.ravel().reshape(n, n).T, want, axes=(1, axis)), 0, axis)
    got = {r["index"]: r["v"] for r in applied.collect()}
    assert np.allclose([got[i] for i in range(24)], want.ravel(order="F"))
    with pytest.raises(ValueError):
        tt.check_ranks([(1, 2, 2), (3, 2, 1)])
    assert tt.rank_of(np.array([1.0, 1e-3, 1e-9]), 0, 1e-6) == 2 and tt.rank_of(np.zeros(3), 1.0, 0) == 1


def test_streamed_gram(spark, tmp_path):
    from colsieve.streaming.gram import current_gram, follow_gram

    x = np.random.default_rng(0).normal(size=(3, 12))
    for part in range(3):
        spark.createDataFrame([(j, x[:, j].tolist()) for j in range(4 * part, 4 * part + 4)], "col_id bigint, vec array<double>").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("col_id bigint, vec array<double>").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    follow_gram(stream, str(tmp_path / "gram"), str(tmp_path / "cp")).awaitTermination(120)
    g = np.zeros((3, 3))
    for r in current_gram(spark.read.parquet(str(tmp_path / "gram"))).collect():
        g[r["i"], r["j"]] = r["v"]
    assert np.allclose(g, x @ x.T)


def test_every_level_of_a_category_has_its_indicator(spark, tmp_path, monkeypatch):
    from colsieve.plans import queries

    rows = [(i, f"S{i % 60:02d}", float(i * i % 17)) for i in range(300)]
    spark.createDataFrame(rows, "c_custkey bigint, c_mktsegment string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    x = {r["col_id"]: r["vec"] for r in queries.customer_matrix(spark, str(tmp_path)).collect()}
    assert all(x[i][:59] == [float(i % 60 == level) for level in range(1, 60)] and len(x[i]) == 61 for i, _, _ in rows)
    monkeypatch.setattr(queries, "MAX_LEVELS", 59)
    with pytest.raises(ValueError):
        queries.customer_matrix(spark, str(tmp_path))


def test_norms_and_regression_on_all_order_features(spark):
    from colsieve.plans.queries import orders_matrix

    df = orders_matrix(spark, "/root/testdata/sf0.001")
    rows = df.collect()
    x, y = np.array([r["vec"] for r in rows], float).T, np.array([r["y"] for r in rows], float)
    s = np.linalg.svd(x, compute_uv=False)
    assert len(s) == 3
    n = linalg.pinv_norms(df)
    assert n["frobenius"] == pytest.approx(np.sqrt((1 / s**2).sum()), rel=1e-8) and n["spectral"] == pytest.approx(1 / s[-1], rel=1e-8)
    pick = np.array([r["col_id"] % 7 == 0 for r in rows])
    w = np.linalg.lstsq(x[:, pick].T, y[pick], rcond=None)[0]
    assert metrics.selection_metrics(df, df.filter("col_id % 7 = 0"), "y")["regression_mse"] == pytest.approx(((w @ x - y) ** 2).mean(), rel=1e-6)


def test_padding_to_a_share_of_the_table(spark):
    from colsieve.operators.registry import pad_selection

    df = spark.range(3000).withColumnRenamed("id", "col_id")
    got = sorted(r["col_id"] for r in pad_selection(df, df.filter("col_id % 10 = 3"), 600).collect())
    assert got == sorted([*range(3, 3000, 10), *[i for i in range(3000) if i % 10 != 3][:300]])
