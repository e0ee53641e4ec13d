"""Training-run analytics: run tables, scaling fits, regressions, step logs.

Fits are closed-form aggregates (power sums, ``regr_*``) computed per group
by ``groupBy``; only k×k ridge systems are solved on the driver, from a
single aggregate row. Running statistics over step logs use bucketed
windows (see ``functions.index``), never a whole run in one task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.index import prefix_sum, ranged, same_keys, with_offsets

# ------------------------------------------------------------------ run tables


def pending_runs(budgets: list[float], depths: list[int], done: DataFrame) -> DataFrame:
    """Grid budgets × depths minus finished runs (left anti join).

    The grid is generated from the two configuration lists (two explodes),
    not from a join."""
    spark = done.sparkSession
    grid = (spark.range(1)
                 .select(F.explode(F.array(*[F.lit(float(b)) for b in budgets])).alias("flops_budget"))
                 .select("flops_budget", F.explode(F.array(*[F.lit(int(d)) for d in depths])).alias("depth")))
    d = done.select(F.col("flops_budget").cast("double").alias("flops_budget"), F.col("depth").cast("int").alias("depth"))
    return grid.join(d, ["flops_budget", "depth"], "left_anti")


def filter_runs(runs: DataFrame, exclude_budgets: list | None = None, exclude_depths: list | None = None) -> DataFrame:
    """Drop runs without a usable val_bpb, and optional budgets/depths."""
    out = runs.filter(F.col("val_bpb").isNotNull() & (F.col("val_bpb") > 0))
    if exclude_budgets:
        out = out.filter(~F.col("flops_budget").isin(list(exclude_budgets)))
    if exclude_depths:
        out = out.filter(~F.col("depth").isin(list(exclude_depths)))
    return out


CONVENTIONS = {
    "all": lambda: F.col("params_total"),
    "transformer_lm_head": lambda: F.col("params_transformer") + F.col("params_lm_head"),
    "transformer": lambda: F.col("params_transformer"),
}


def effective_params(runs: DataFrame, how: str = "transformer_lm_head") -> DataFrame:
    """Effective parameter count and tokens per parameter; ``how='stack'``
    returns all three conventions as rows."""
    if how == "stack":
        parts = [runs.withColumn("convention", F.lit(k)).withColumn("effective_params", v().cast("double"))
                 for k, v in CONVENTIONS.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
    else:
        out = runs.withColumn("convention", F.lit(how)).withColumn("effective_params", CONVENTIONS[how]().cast("double"))
    return out.withColumn("param_data_ratio", F.col("tokens_trained") / F.col("effective_params"))


def _det3(a11, a12, a13, a21, a22, a23, a31, a32, a33) -> Column:
    return (a11 * (a22 * a33 - a23 * a32) - a12 * (a21 * a33 - a23 * a31) + a13 * (a21 * a32 - a22 * a31))


def isoflop_fit(runs: DataFrame, budget: str = "flops_budget") -> DataFrame:
    """Quadratic fit of val_bpb in log10(effective params) per budget.

    Power sums of the centred log size are aggregated per budget and the
    3×3 normal equations solved by Cramer's rule in column expressions. The
    optimum is −b/2a when a > 0 (with at least 3 runs); otherwise the lowest
    measured run. Output: (budget, n, a, b, c, log_params, bpb, fitted).
    """
    r = runs.withColumn("_x", F.log10("effective_params")).withColumn("_y", F.col("val_bpb"))
    mean = r.groupBy(budget).agg(F.avg("_x").alias("_xm"))
    c = r.join(mean, budget).withColumn("_u", F.col("_x") - F.col("_xm"))
    u, y = F.col("_u"), F.col("_y")
    s = c.groupBy(budget).agg(
        F.count(F.lit(1)).alias("n"), F.first("_xm").alias("_xm"),
        F.sum(u * u).alias("s2"), F.sum(u * u * u).alias("s3"), F.sum(u * u * u * u).alias("s4"), F.sum(u).alias("s1"),
        F.sum(y).alias("t0"), F.sum(u * y).alias("t1"), F.sum(u * u * y).alias("t2"),
        F.min_by(F.struct("_x", "_y"), "_y").alias("_best"))
    S0, S1, S2, S3, S4 = F.col("n").cast("double"), F.col("s1"), F.col("s2"), F.col("s3"), F.col("s4")
    T0, T1, T2 = F.col("t0"), F.col("t1"), F.col("t2")
    D = _det3(S4, S3, S2, S3, S2, S1, S2, S1, S0)
    A = F.try_divide(_det3(T2, S3, S2, T1, S2, S1, T0, S1, S0), D)
    Bc = F.try_divide(_det3(S4, T2, S2, S3, T1, S1, S2, T0, S0), D)
    Cc = F.try_divide(_det3(S4, S3, T2, S3, S2, T1, S2, S1, T0), D)
    xm = F.col("_xm")
    fit = s.select(budget, "n", "_best", xm.alias("_xm"), A.alias("a"), Bc.alias("_B"), Cc.alias("_C"))
    ok = F.coalesce((F.col("n") >= 3) & (F.col("a") > 0), F.lit(False))
    ustar = -F.col("_B") / (2 * F.col("a"))
    return fit.select(
        budget, "n",
        F.col("a"), (F.col("_B") - 2 * F.col("a") * F.col("_xm")).alias("b"),
        (F.col("_C") - F.col("_B") * F.col("_xm") + F.col("a") * F.col("_xm") * F.col("_xm")).alias("c"),
        F.when(ok, F.col("_xm") + ustar).otherwise(F.col("_best._x")).alias("log_params"),
        F.when(ok, F.col("a") * ustar * ustar + F.col("_B") * ustar + F.col("_C")).otherwise(F.col("_best._y")).alias("bpb"),
        ok.alias("fitted"))


def interp_at(runs: DataFrame, optima: DataFrame, budget: str = "flops_budget") -> DataFrame:
    """Piecewise-linear tokens and ratio at the optimum log size (ends
    clamped), from the runs of the same budget sorted by size."""
    x = F.log10("effective_params")
    w = Window.partitionBy(budget).orderBy("_x")
    r = (runs.withColumn("_x", x)
             .withColumn("_nx", F.lead("_x").over(w))
             .withColumn("_nt", F.lead("tokens_trained").over(w))
             .withColumn("_nr", F.lead("param_data_ratio").over(w)))
    j = r.join(optima.select(budget, "log_params", "fitted"), budget)
    row = F.struct("_x", F.col("tokens_trained").alias("_t"), F.col("param_data_ratio").alias("_r"), "_nx", "_nt", "_nr")
    g = j.groupBy(budget).agg(
        F.max_by(F.when(F.col("_x") <= F.col("log_params"), row), F.when(F.col("_x") <= F.col("log_params"), F.col("_x")))
        .alias("lo"),
        F.min_by(row, "_x").alias("first"),
        F.first("log_params").alias("log_params"), F.first("fitted").alias("fitted"))
    lo, fst, xs = F.col("lo"), F.col("first"), F.col("log_params")

    def at(t, nt):
        frac = F.try_divide(xs - lo["_x"], lo["_nx"] - lo["_x"])
        return (F.when(lo.isNull(), fst[t])
                 .when(lo["_nx"].isNull(), lo[t])
                 .otherwise(lo[t] + (lo[nt] - lo[t]) * frac))

    return g.select(budget, "log_params", "fitted", at("_t", "_nt").alias("tokens"), at("_r", "_nr").alias("ratio"))


def optima_table(runs: DataFrame, budget: str = "flops_budget") -> DataFrame:
    """isoflop optimum per budget with tokens and ratio: interpolated when
    the quadratic has a minimum, else those of the best run."""
    fit = isoflop_fit(runs, budget)
    it = interp_at(runs, fit, budget)
    best = runs.groupBy(budget).agg(F.min_by(F.struct("tokens_trained", "param_data_ratio"), "val_bpb").alias("_b"))
    j = fit.join(it.select(budget, "tokens", "ratio"), budget).join(best, budget)
    return j.select(budget, "n", "log_params", "bpb", "fitted",
                    F.when(F.col("fitted"), F.col("tokens")).otherwise(F.col("_b.tokens_trained")).alias("tokens"),
                    F.when(F.col("fitted"), F.col("ratio")).otherwise(F.col("_b.param_data_ratio")).alias("ratio"))


def power_law_fit(optima: DataFrame, budget: str = "flops_budget") -> DataFrame:
    """log-log slope and intercept of optimal params and tokens against the
    budget; needs at least 2 budgets."""
    lf, lp, lt = F.log10(budget), F.col("log_params"), F.log10("tokens")
    n = F.count(F.lit(1))
    return optima.agg(n.alias("n_budgets"),
                      F.regr_slope(lp, lf).alias("slope_n"), F.regr_intercept(lp, lf).alias("intercept_n"),
                      F.regr_slope(lt, lf).alias("slope_d"), F.regr_intercept(lt, lf).alias("intercept_d"),
                      F.min(budget).alias("min_budget"), F.max(budget).alias("max_budget"),
                      F.avg("ratio").alias("mean_ratio"), F.stddev_samp("ratio").alias("std_ratio"))


def optimal_ratio(optima: DataFrame, budget: str = "flops_budget") -> DataFrame:
    """Tokens per parameter at the geometric-mean budget from the two power
    laws, with the mean and sample std of the per-budget ratios and the gap
    between the exponents."""
    p = power_law_fit(optima, budget)
    ref = 0.5 * (F.log10("min_budget") + F.log10("max_budget"))
    ok = F.col("n_budgets") >= 2
    return p.select(
        "n_budgets",
        F.when(ok, F.pow(F.lit(10.0), (F.col("intercept_d") + F.col("slope_d") * ref)
                         - (F.col("intercept_n") + F.col("slope_n") * ref))).alias("optimal_ratio"),
        "mean_ratio", "std_ratio",
        F.when(ok, F.col("slope_d") - F.col("slope_n")).alias("exponent_gap"))


def best_per_budget(runs: DataFrame, order: str = "depth", budget: str = "flops_budget") -> DataFrame:
    """The run with the lowest val_bpb per budget, with its rank in ``order``."""
    w = Window.partitionBy(budget).orderBy(order)
    r = runs.withColumn("order_rank", F.row_number().over(w))
    return r.groupBy(budget).agg(F.min_by(F.struct("depth", "val_bpb", "param_data_ratio", "order_rank"), "val_bpb")
                                 .alias("b")).select(budget, "b.*")


# ------------------------------------------------------------------ accuracy regressions


def center_accuracy(acc: DataFrame, baselines: DataFrame, tasks: list[str], model: str = "model") -> DataFrame:
    """(acc − b)/(1 − b) per (model, task) pivoted to a feature matrix, plus the mean."""
    j = acc.join(baselines, "task", "left").withColumn(
        "centered", (F.col("accuracy") - F.coalesce(F.col("baseline"), F.lit(0.0))) / (1.0 - F.coalesce(F.col("baseline"), F.lit(0.0))))
    wide = j.groupBy(model).pivot("task", tasks).agg(F.first("centered"))
    mean = j.groupBy(model).agg(F.avg("centered").alias("mean_centered"))
    return wide.join(mean, model)


def ols_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One-variable least squares: slope, intercept, R²."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"),
                  F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def rank_predictors(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """One fit per feature (features stacked to long form), sorted by R²."""
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in xs]))
    long = df.select(F.col(y).alias("_y"), stack.alias("s")).select("s.feature", "s.x", "_y")
    g = long.groupBy("feature").agg(F.regr_r2("_y", "x").alias("r2"), F.regr_slope("_y", "x").alias("slope"),
                                    F.regr_intercept("_y", "x").alias("intercept"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("r2"), "feature")))  # one row per feature


def moments(df: DataFrame, xs: list[str], y: str) -> dict:
    """n, means and centred second moments of the features and the target in one
    aggregate row. Spark merges them as centred moments of parts (pairwise), so
    nothing cancels when values lie far from zero. Rows with a null are left out."""
    cols = [*xs, y]
    d = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).dropna()
    k = len(cols)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(f"c{i}").alias(f"m{i}") for i in range(k)]
    aggs += [F.covar_pop(f"c{i}", f"c{j}").alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    r = d.agg(*aggs).first()
    n = r["n"]
    second = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            second[i, j] = second[j, i] = (r[f"s{i}_{j}"] or 0.0) * n
    return {"n": n, "mean": np.array([r[f"m{i}"] or 0.0 for i in range(k)]), "second": second}


def ridge_from_moments(m: dict, alpha: float) -> tuple[float, np.ndarray, float]:
    """(intercept, weights, r²): centred normal equations of the features, the
    last column of the moments being the target."""
    G, b, syy = m["second"][:-1, :-1], m["second"][:-1, -1], m["second"][-1, -1]
    w = np.linalg.solve(G + alpha * np.eye(len(b)), b)
    ssr = syy - 2 * w @ b + w @ G @ w
    return m["mean"][-1] - m["mean"][:-1] @ w, w, 1 - ssr / syy if syy > 0 else float("nan")


def ridge_fit(df: DataFrame, xs: list[str], y: str, alphas: list[float]) -> DataFrame:
    """Ridge regression ‖Xw − y‖² + α‖w‖² with a free intercept, for each α.

    The centred moments are one Spark aggregate; the k×k solves run on the
    driver (k is the number of features, not rows). α = 0 with fewer rows than
    features is singular and yields nulls.
    """
    m = moments(df, xs, y)
    rows = []
    for a in alphas:
        try:
            b0, w, r2 = ridge_from_moments(m, a)
            rows.append((float(a), float(b0), [float(v) for v in w], float(r2), float(np.linalg.norm(w))))
        except np.linalg.LinAlgError:
            rows.append((float(a), None, None, None, None))
    return df.sparkSession.createDataFrame(
        rows, "alpha double, intercept double, weights array<double>, r2 double, weight_norm double")


def predict_core(features: DataFrame, xs: list[str], y: str, alpha: float, key: str) -> DataFrame:
    """Simple (OLS on the mean feature), ridge (all features) and
    best-single-feature predictions; final = mean of simple and ridge. All fits
    come from one row of moments; a second pass predicts."""
    f = features.withColumn("_mean", sum((F.col(c) for c in xs), F.lit(0.0)) / len(xs))
    m = moments(f, [*xs, "_mean"], y)
    second, mean, k = m["second"], m["mean"], len(xs)

    def line(i: int) -> tuple[float, float, float]:
        """Slope, intercept and r² of the target on feature i alone."""
        xx, xy, yy = second[i, i], second[i, -1], second[-1, -1]
        if xx <= 0:
            return 0.0, float(mean[-1]), float("-inf")
        return float(xy / xx), float(mean[-1] - xy / xx * mean[i]), float(xy * xy / (xx * yy)) if yy > 0 else 1.0

    best = min(range(k), key=lambda i: (-line(i)[2], xs[i]))
    own = [*range(k), k + 1]
    b0, w, _ = ridge_from_moments({"mean": mean[own], "second": second[np.ix_(own, own)]}, alpha)
    ridge = F.lit(float(b0)) + sum((F.lit(float(wi)) * F.col(c) for wi, c in zip(w, xs)), F.lit(0.0))
    (s1, i1, _), (s2, i2, _) = line(k), line(best)
    p_simple = F.lit(i1) + F.lit(s1) * F.col("_mean")
    p_best = F.lit(i2) + F.lit(s2) * F.col(xs[best])
    return f.select(key, p_simple.alias("pred_simple"), ridge.alias("pred_ridge"), p_best.alias("pred_best"),
                    ((p_simple + ridge) / 2).alias("pred_final"), F.col(y).alias("actual"))


# ------------------------------------------------------------------ step logs


def _ema_scan(beta: float, schema: str):
    """Rows sorted by (run, order) to the same rows with ``_n``, the row's number
    (from 1) within its run and partition, and ``_local``, the average over the
    run's rows of this partition alone."""
    def scan(batches):
        import pyarrow as pa
        run, n, ema = None, 0, 0.0
        for b in batches:
            ns, emas = [], []
            for r, x in zip(b.column("_run").to_pylist(), b.column("_x").to_pylist()):
                if r != run or not n:
                    run, n, ema = r, 0, 0.0
                n, ema = n + 1, beta * ema + (1 - beta) * x
                ns.append(n)
                emas.append(ema)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ns, pa.int64()), pa.array(emas, pa.float64())],
                                             [*b.schema.names, "_n", "_local"])

    return lambda df: df.mapInArrow(scan, schema)


def smoothed_loss(steps: DataFrame, beta: float = 0.9, run: str = "run_id", step: str = "step",
                  loss: str = "loss", chunk: int | None = None, sft: bool = False) -> DataFrame:
    """EMA of the loss per run, over its records in step order, debiased by
    1 − β^(step+1) (β^(step+2) for the SFT variant, which debiases after its
    step increment). Steps may have gaps; a null loss counts as zero loss.

    The average after n records is an associative scan of (decay, value) pairs:
    a run's records in one range give (β^n, average over them), and ranges
    compose. Each range is scanned in order by one task in constant memory; the
    table of ranges (a row per range and run) is folded per run, and a record's
    average is its own range's plus β^n times that of the ranges before.
    ``chunk``: rows in a range, about; by default as Spark sizes its partitions.
    """
    parts = None if chunk is None else max(1, -(-steps.count() // chunk))
    d = steps.withColumn("_run", F.col(run).cast("string")).withColumn("_x", F.coalesce(F.col(loss).cast("double"), F.lit(0.0)))
    keep = d.select("_run", "_x", run, step)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema) + ", _n long, _local double"
    held = ranged(keep, ["_run", step], parts, add=_ema_scan(beta, ddl))
    ends = held.groupBy("_run", "__p").agg(F.max("_n").alias("m"), F.max_by("_local", "_n").alias("e"))

    # a run's ranges in order, each with the average over those before it
    part = lambda x: F.struct(x["__p"].alias("p"), x["e"].alias("e"), x["m"].alias("m"))
    folded = F.aggregate(
        F.transform(F.array_sort(F.collect_list(F.struct("__p", "m", "e"))), part),
        F.struct(F.lit(0.0).alias("acc"), F.array().cast("array<struct<p:int,before:double>>").alias("out")),
        lambda a, x: F.struct((x["e"] + F.pow(F.lit(beta), x["m"].cast("double")) * a["acc"]).alias("acc"),
                              F.concat(a["out"], F.array(F.struct(x["p"].alias("p"), a["acc"].alias("before")))).alias("out")),
        lambda a: a["out"])
    carried = (ends.groupBy(F.col("_run").alias("_r")).agg(folded.alias("_o")).select("_r", F.explode("_o").alias("_o"))
               .select("_r", F.col("_o.p").alias("_q"), F.col("_o.before").alias("_before")))
    j = held.join(carried, same_keys(["_run", "__p"], ["_r", "_q"]))
    ema = F.col("_local") + F.pow(F.lit(beta), F.col("_n").cast("double")) * F.col("_before")
    power = F.col(step) + (2 if sft else 1)
    return j.select(run, step, (ema / (1 - F.pow(F.lit(beta), power.cast("double")))).alias("smooth_loss"))


def running_min(df: DataFrame, value: str, order: str, by: list[str], out: str, buckets: int | None = None) -> DataFrame:
    """Inclusive running minimum of ``value`` in ``order`` within ``by``,
    computed per key range and combined with the minima of the ranges before
    (a row per range and group), so no group is funnelled into one task."""
    held = ranged(df, [*by, order], buckets)
    wl = Window.partitionBy(*by, "__p").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    local = held.withColumn("_lm", F.min(value).over(wl))
    tot = held.groupBy(*by, "__p").agg(F.min(value).alias("_bm"))
    wt = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"__by{i}" for i in range(len(by))]
    off = tot.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col("__p").alias("__ob"), F.min("_bm").over(wt).alias("_om"))
    j = with_offsets(local, off, by)
    return j.withColumn(out, F.least("_lm", "_om")).drop("__p", "__at", "_lm", "_om")


def running_min_bpb(steps: DataFrame, run: str = "run_id", step: str = "step", bpb: str = "val_bpb") -> DataFrame:
    """Best val_bpb so far per run."""
    d = steps.withColumn("_o", F.col(step).cast("bigint"))
    return running_min(d, bpb, "_o", [run], "min_val_bpb").drop("_o")


# Peak BF16 FLOP/s by device-name patterns, most specific first.
PEAK_FLOPS = [
    (["gb200"], 2.5e15),
    (["grace blackwell"], 2.5e15),
    (["b200"], 2.25e15),
    (["b100"], 1.8e15),
    (["h200", "nvl"], 836e12),
    (["h200", "pcie"], 836e12),
    (["h200"], 989e12),
    (["h100", "nvl"], 835e12),
    (["h100", "pcie"], 756e12),
    (["h100"], 989e12),
    (["h800", "nvl"], 989e12),
    (["h800"], 756e12),
    (["a100"], 312e12),
    (["a800"], 312e12),
    (["a40"], 149.7e12),
    (["a30"], 165e12),
    (["l40s"], 362e12),
    (["l40-s"], 362e12),
    (["l40 s"], 362e12),
    (["l4"], 121e12),
    (["mi355"], 2.5e15),
    (["mi325"], 1.3074e15),
    (["mi300x"], 1.3074e15),
    (["mi300a"], 980.6e12),
    (["mi250x"], 383e12),
    (["mi250"], 362.1e12),
    (["5090"], 209.5e12),
    (["4090"], 165.2e12),
    (["3090"], 71e12),
]


def peak_flops_table(spark) -> DataFrame:
    rows = [(i, pats, float(v)) for i, (pats, v) in enumerate(PEAK_FLOPS)]
    return spark.createDataFrame(rows, "priority int, patterns array<string>, peak_flops double")


def device_peaks(devices: DataFrame, peaks: DataFrame, device: str = "device") -> DataFrame:
    """First matching pattern set per distinct device name (unknown → inf).

    Distinct device names are few; the pattern table is a fixed list, so the
    match is a broadcast nested-loop join over (devices × ~30 patterns)."""
    d = devices.select(device).distinct()
    name = F.lower(F.col(device))
    j = d.join(F.broadcast(peaks), F.forall("patterns", lambda p: F.instr(name, p) > 0), "left")
    g = j.groupBy(device).agg(F.min_by("peak_flops", "priority").alias("peak_flops"))
    return g.withColumn("peak_flops", F.coalesce(F.col("peak_flops"), F.lit(float("inf"))))


#: Device names that are sent to every executor; more of them are joined.
MAX_DEVICES = 10_000


def throughput(steps: DataFrame, peaks: DataFrame, batch_tokens: str = "batch_tokens",
               flops_per_token: str = "flops_per_token", world: str = "world", run: str = "run_id",
               step: str = "step", dt: str = "dt", num_iterations: str = "num_iterations") -> DataFrame:
    """tokens/s, FLOP/s, MFU %, time counted after step 10, FLOPs so far, ETA."""
    pk = device_peaks(steps, peaks).withColumnRenamed("device", "_device")
    if pk.count() <= MAX_DEVICES:
        pk = F.broadcast(pk)
    d = steps.join(pk, F.col("device").eqNullSafe(F.col("_device"))).drop("_device")
    counted = F.when(F.col(step) > 10, F.col(dt)).otherwise(F.lit(0.0))
    d = d.withColumn("_c", counted).withColumn("_o", F.col(step).cast("bigint"))
    d = prefix_sum(d, "_o", "_c", by=[run], idx="_i", before="_tb")
    total = F.col("_tb").cast("double") + F.col("_c")
    fps = F.col(flops_per_token) * F.col(batch_tokens) / F.col(dt)
    done = F.col(step) - 10
    return d.select(
        run, step,
        F.floor(F.col(batch_tokens) / F.col(dt)).cast("bigint").alias("tok_per_sec"),
        fps.alias("flops_per_sec"),
        (100 * fps / (F.col("peak_flops") * F.col(world))).alias("mfu"),
        total.alias("total_training_time"),
        (F.col(flops_per_token) * F.col(batch_tokens) * F.col(step)).alias("flops_so_far"),
        F.when(done > 0, (F.col(num_iterations) - F.col(step)) * total / done).alias("eta_seconds"),
    )
