import numpy as np
from pyspark.sql import functions as F

import reference_impl as R
from tessera.operators import runs as RN


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(40, 3))
    y = X @ np.array([0.5, -1.0, 2.0]) + 0.3 + rng.normal(scale=0.1, size=40)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(t)) for (a, b, c), t in zip(X, y)], "a double, b double, c double, y double")
    out = {r["alpha"]: r for r in RN.ridge_fit(df, ["a", "b", "c"], "y", [0.0, 0.5]).collect()}
    for alpha in (0.0, 0.5):
        Xc, yc = X - X.mean(0), y - y.mean()
        w = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(3), Xc.T @ yc)
        assert np.allclose(out[alpha]["weights"], w, atol=1e-9)
        assert abs(out[alpha]["intercept"] - (y.mean() - X.mean(0) @ w)) < 1e-9


def test_ridge_singular_gives_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 2.0)], "a double, b double, y double")
    r = RN.ridge_fit(df, ["a", "b"], "y", [0.0]).first()
    assert r["weights"] is None


def test_isoflop_matches_polyfit(spark):
    rng = np.random.default_rng(1)
    x = np.linspace(7, 9.5, 12)
    y = 0.04 * (x - 8.3) ** 2 + 0.9 + rng.normal(scale=0.001, size=12)
    rows = [(1.0, float(10 ** v), float(t)) for v, t in zip(x, y)]
    df = spark.createDataFrame(rows, "flops_budget double, effective_params double, val_bpb double")
    f = RN.isoflop_fit(df).first()
    a, b, c = np.polyfit(x, y, 2)
    assert np.allclose([f["a"], f["b"], f["c"]], [a, b, c], rtol=1e-6)
    assert abs(f["log_params"] - (-b / (2 * a))) < 1e-6


def test_smoothed_loss_equals_sequential_ema(spark):
    rng = np.random.default_rng(2)
    xs = rng.uniform(1, 5, size=900)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(xs)], "run_id int, step int, loss double")
    got = [r["smooth_loss"] for r in RN.smoothed_loss(df, chunk=400).orderBy("step").collect()]
    assert np.allclose(got, R.ema(list(xs)), rtol=1e-12)


def test_running_min_across_buckets(spark):
    vals = [5.0, 3.0, 4.0, 2.5, 6.0, 1.0, 7.0] * 20
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "run_id int, step int, val_bpb double")
    got = [r["min_val_bpb"] for r in RN.running_min_bpb(df).orderBy("step").collect()]
    assert got == list(np.minimum.accumulate(vals))


def test_pending_runs_grid_minus_done(spark):
    done = spark.createDataFrame([(1.0, 4), (2.0, 6)], "flops_budget double, depth int")
    got = {(r[0], r[1]) for r in RN.pending_runs([1.0, 2.0], [4, 6], done).collect()}
    assert got == {(1.0, 6), (2.0, 4)}
