from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagweave.operators import graph as G
from lagweave.operators import network as N
from lagweave.operators import series as T


@pytest.fixture(scope="module")
def var_obs(spark):
    """A stable three-variable VAR(1) with one strong cross effect, two profiles."""
    rng = np.random.default_rng(5)
    a = np.array([[0.5, 0.0, 0.0], [0.4, 0.3, 0.0], [0.0, 0.0, 0.2]])
    rows = []
    for p in ("x", "y"):
        x = np.zeros(3)
        for t in range(160):
            x = a @ x + rng.normal(size=3)
            rows += [(p, c, t, float(v)) for c, v in zip(("C01", "P01", "P02"), x)]
    obs = spark.createDataFrame(rows, "profile_id string, code string, t_index int, value double")
    return T.zscore(obs).select("profile_id", "code", "t_index", F.col("z").alias("value")).cache()


def dense(obs, profile):
    pdf = obs.where(F.col("profile_id") == profile).toPandas().pivot(index="t_index", columns="code", values="value").sort_index()
    return pdf.to_numpy()


def test_lasso_meets_kkt(var_obs):
    x = dense(var_obs, "x")
    z, y = x[:-1], x[1:]
    u = np.hstack([np.ones((len(z), 1)), z, y])
    alpha = 0.08
    b, c = N.lasso((u.T @ u)[None], np.full((1, 3), alpha))
    resid = y - z @ b[0].T - c[0]
    grad = resid.T @ (z - z.mean(0)) / len(z)
    assert np.all(np.abs(grad) <= alpha + 1e-8)
    active = np.abs(b[0]) > 1e-9
    assert np.allclose(grad[active], alpha * np.sign(b[0][active]), atol=1e-8)
    assert np.allclose(resid.mean(0), 0, atol=1e-9)


def test_moments_do_not_depend_on_batches(spark, var_obs):
    rows = N.lag_rows(var_obs)
    total = N.moments(rows, ("full",)).toPandas()
    got = {p: sum(np.asarray(g) for g in part["gram"]) for p, part in total.groupby("profile_id")}
    x = dense(var_obs, "y")
    u = np.hstack([np.ones((len(x) - 1, 1)), x[:-1], x[1:]])
    assert np.allclose(got["y"], (u.T @ u).ravel())


def test_static_fit_finds_the_cross_effect(var_obs):
    coefs = N.fit_static_var(N.lag_rows(var_obs)).toPandas().set_index(["profile_id", "dst", "src"])["beta"]
    assert coefs[("x", "P01", "C01")] > 0.2 and abs(coefs[("x", "C01", "P02")]) < 0.15


def test_time_varying_fit_and_interval(spark, var_obs):
    params = spark.createDataFrame([("x", 0.3, 0.02), ("y", 0.3, 0.02)], "profile_id string, bandwidth double, alpha double")
    rows = N.lag_rows(var_obs)
    tv = N.fit_tv_var(rows, params)
    assert tv.count() == 2 * N.POINTS * 9
    ci = N.bootstrap_ci(rows, params, draws=10)
    assert ci.where("ci_low > ci_high").count() == 0 and ci.where("n_draws != 10").count() == 0
    loo = N.loo_importance(var_obs, tv, N.POINTS).toPandas().set_index(["profile_id", "predictor"])["delta_mse_all"]
    assert loo[("x", "C01")] > loo[("x", "P02")]


def test_cv_matches_brute_force(spark, var_obs):
    """One bandwidth and two alphas, fitted fold by fold on the rows themselves."""
    alphas, bw = [0.05, 0.2], [0.3]
    old = N.BANDWIDTHS
    got = N.select_tv_params(N.lag_rows(var_obs.where("profile_id = 'x'")), old, alphas).first()
    x = dense(var_obs, "x")
    t = np.arange(len(x)) / (len(x) - 1 + 1e-12)
    n, best = len(x) - 1, []
    for a in alphas:
        folds = []
        for tr, va in N._folds(n):
            mu, sd = x[: tr + 1].mean(0), x[: tr + 1].std(0)
            s = (x - mu) / sd
            z, y, to = s[:-1], s[1:], t[1:]
            fits = []
            for te in np.linspace(0, 1, N.CV_POINTS):
                w = N._kernel(to[:tr], te, got["bandwidth"])
                u = np.hstack([np.ones((tr, 1)), z[:tr], y[:tr]])
                fits.append(N.lasso(((u * w[:, None]).T @ u)[None], np.full((1, 3), a)))
            near = np.argmin(np.abs(np.linspace(0, 1, N.CV_POINTS)[None] - to[tr:va, None]), axis=1)
            err = [y[tr + i] - fits[q][0][0] @ z[tr + i] - fits[q][1][0] for i, q in enumerate(near)]
            folds.append(np.mean(np.square(err)))
        best.append(np.mean(folds))
    assert got["alpha"] == alphas[int(np.argmin(best))]
    assert got["mse_alpha"] == pytest.approx(min(best), rel=1e-5)


def test_bootstrap_blocks_match_one_draw_at_a_time(spark, var_obs):
    rows, params = N.lag_rows(var_obs), spark.createDataFrame([("x", 0.3, 0.02)], "profile_id string, bandwidth double, alpha double")
    got = {(r["time_index"], r["dst"], r["src"]): (r["ci_low"], r["ci_high"], r["n_draws"]) for r in N.bootstrap_ci(rows, params, draws=5).collect()}
    x = dense(var_obs, "x")
    z, y = x[:-1], x[1:]
    u = np.hstack([np.ones((len(z), 1)), z, y])
    t = np.arange(1, len(x)) / (len(x) - 1 + 1e-12)
    draws = []
    for d in range(5):
        mult = N._multiplicity("x", d, len(z), N.BLOCK)
        grams = np.stack([((u * (mult * N._kernel(t, te, 0.3))[:, None]).T @ u) for te in np.linspace(0, 1, N.POINTS)])
        draws.append(N.lasso(grams, np.full((N.POINTS, 3), 0.02))[0])
    low, high = np.percentile(draws, 5, axis=0), np.percentile(draws, 95, axis=0)
    codes = ["C01", "P01", "P02"]
    for (q, dst, src), (a, b, n) in got.items():
        i, j = codes.index(dst), codes.index(src)
        assert n == 5 and a == pytest.approx(low[q, i, j], abs=1e-8) and b == pytest.approx(high[q, i, j], abs=1e-8)


def test_flow_follows_each_profiles_plan(spark):
    from lagweave.plans import impact

    rng, rows = np.random.default_rng(6), []
    for profile, n in (("long", 200), ("short", 40)):
        x = np.zeros(3)
        for t in range(n):
            x = np.array([[0.4, 0.2, 0.0], [0.3, 0.3, 0.0], [0.0, 0.0, 0.4]]) @ x + rng.normal(size=3)
            rows += [(profile, c, t, None if rng.random() < 0.03 else float(v)) for c, v in zip(("C01", "P01", "P02"), x)]
    obs = spark.createDataFrame(rows, "profile_id string, code string, t_index int, value double").withColumn("ts", F.timestamp_seconds(F.col("t_index") * 86400))
    f = impact.fit(obs, draws=3)
    plan = {r["profile_id"]: r for r in f.plan.collect()}
    assert plan["long"]["run_time_varying"] and not plan["short"]["run_time_varying"] and not plan["short"]["run_descriptives_only"]
    assert {(r["profile_id"], r["impact_source"]) for r in f.coefs.select("profile_id", "impact_source").distinct().collect()} == {("long", "time_varying"), ("short", "stationary")}
    assert [r["profile_id"] for r in f.params.collect()] == ["long"] and [r["profile_id"] for r in f.intervals.select("profile_id").distinct().collect()] == ["long"]
    beta = lambda df: {(r["time_index"], r["dst"], r["src"]): r["beta"] for r in df.collect()}
    assert beta(f.coefs.where("profile_id = 'long'")) == pytest.approx(beta(N.fit_tv_var(f.rows.where("profile_id = 'long'"), f.params)), abs=1e-8)
    assert beta(f.coefs.where("profile_id = 'short'")) == pytest.approx(beta(N.fit_static_var(f.rows.where("profile_id = 'short'"))), abs=1e-8)


def test_fill_keeps_observed_cells(spark, var_obs):
    holes = var_obs.withColumn("value", F.when((F.col("t_index") % 9) == 4, None).otherwise(F.col("value")))
    out = N.var_fill(holes)
    both = out.join(var_obs, ["profile_id", "code", "t_index"])
    assert out.where("filled is null").count() == 0
    assert both.where("not gap and abs(filled - value) > 1e-9").count() == 0


def test_single_variable_has_vif_one(spark):
    df = spark.createDataFrame([("p", "P01", "P02", 50, 0.0)], "profile_id string, a string, b string, n int, r double")
    row = N.collinearity(df).first()
    assert row["vif"]["P01"] == pytest.approx(1.0, abs=1e-4) and row["condition_number"] == pytest.approx(1.0)


def test_collinearity_drop_is_the_sequential_walk(spark):
    rng = np.random.default_rng(11)
    codes = [f"P{i:02d}" for i in range(9)]
    pairs = [("p", a, b, float(np.round(rng.uniform(0.9, 1.0), 4))) for i, a in enumerate(codes) for b in codes[i + 1:] if rng.random() < 0.5]
    bad = {c: float(rng.random()) for c in codes}
    stats = spark.createDataFrame([("p", c, bad[c], 0.0, 0.1, 5) for c in codes], "profile_id string, code string, missing_pct double, outlier_pct double, dominance double, n_unique int")
    gone: set[str] = set()
    for _, a, b, r in sorted(pairs, key=lambda x: (-x[3], x[1], x[2])):
        if r >= 0.95 and a not in gone and b not in gone:
            gone.add(a if bad[a] > bad[b] else b)
    df = spark.createDataFrame(pairs, "profile_id string, a string, b string, r double")
    assert {r["code"] for r in N.collinearity_drop(df, stats).collect()} == gone


@pytest.fixture(scope="module")
def coefs(spark):
    rng = np.random.default_rng(2)
    names = ["a", "b", "c", "d", "e", "f"]
    rows = [("g", 0, 1.0, d, s, float(rng.normal()) if rng.random() < 0.6 else 0.0) for d in names for s in names]
    return spark.createDataFrame(rows, "profile_id string, time_index int, t double, dst string, src string, beta double").cache()


def test_pagerank_sums_to_one(coefs):
    pr = G.pagerank(G.build_edges(coefs), G.nodes_of(coefs)).toPandas()["pagerank"]
    assert pr.sum() == pytest.approx(1.0) and (pr > 0).all()


def test_shortest_paths_against_floyd(coefs):
    edges = G.build_edges(coefs)
    got = {(r["src"], r["dst"]): r["d"] for r in G.shortest_paths(edges, G.nodes_of(coefs)).collect()}
    d = {(r["src"], r["dst"]): r["dist"] for r in edges.collect()}
    names = "abcdef"
    for k in names:
        for i in names:
            for j in names:
                if i != j and (i, k) in d and (k, j) in d:
                    d[(i, j)] = min(d.get((i, j), np.inf), d[(i, k)] + d[(k, j)])
    assert got.keys() == d.keys() and all(got[k] == pytest.approx(d[k]) for k in d)


def test_betweenness_counts_every_shortest_path(spark):
    rng = np.random.default_rng(3)
    names = [f"n{k}" for k in range(9)]
    rows = [("g", t, a, b, float(rng.choice([0.5, 1.0, 0.25]))) for t in (0, 1) for a in names for b in names if a != b and rng.random() < 0.35]
    coefs = spark.createDataFrame(rows, "profile_id string, time_index int, dst string, src string, beta double")
    edges, nodes = G.build_edges(coefs), G.nodes_of(coefs)
    old, G.SOURCES_PER_CHUNK = G.SOURCES_PER_CHUNK, 4
    got = {(r["time_index"], r["node"]): r["betweenness"] for r in G.betweenness(edges, nodes).collect()}
    G.SOURCES_PER_CHUNK = old
    for t in (0, 1):
        d = {(s, x): 1 / (abs(b) + 1e-12) for _, k, x, s, b in rows if k == t}

        def paths(s, at, seen, length, goal):
            if at == goal:
                yield length, seen
                return
            for nxt in names:
                if (at, nxt) in d and nxt not in seen:
                    yield from paths(s, nxt, [*seen, nxt], length + d[at, nxt], goal)

        want = dict.fromkeys(names, 0.0)
        for s in names:
            for goal in names:
                every = list(paths(s, s, [s], 0.0, goal)) if s != goal else []
                if every:
                    least = min(x for x, _ in every)
                    best = [p for x, p in every if x <= least * (1 + 1e-9)]
                    for p in best:
                        for v in p[1:-1]:
                            want[v] += 1 / len(best)
        assert all(got[t, v] == pytest.approx(want[v] / (8 * 7), abs=1e-9) for v in names if (t, v) in got)


def test_clique_cover_groups_are_cliques(spark):
    rng = np.random.default_rng(8)
    pairs = pd.DataFrame([(i, j, float(rng.random())) for i in range(30) for j in range(i + 1, 30) if rng.random() < 0.4], columns=["a", "b", "score"])
    ids = spark.range(32).select(F.col("id").alias("vec_id"))
    out = G.clique_cover(spark.createDataFrame(pairs), ids).toPandas()
    assert sorted(out["id"]) == list(range(32))
    linked = {(int(a), int(b)) for a, b in zip(pairs["a"], pairs["b"])}
    for _, g in out.groupby("group"):
        m = sorted(g["id"])
        assert all((x, y) in linked for i, x in enumerate(m) for y in m[i + 1:])


def test_lasso_of_groups_equals_calls_of_their_own():
    """Grams of different conditions in one call: each group stops where its own call would."""
    rng = np.random.default_rng(6)
    grams = []
    for spread in (0.1, 1.0, 3.0):
        for _ in range(4):
            u = np.hstack([np.ones((40, 1)), rng.normal(size=(40, 1)) * spread + rng.normal(size=(40, 8))])
            grams.append(u.T @ u)
    grams, alpha = np.stack(grams), np.repeat([[0.01], [0.1], [0.02]], 4, 0) * np.ones((1, 4))
    b, c = N.lasso(grams, alpha, tol=1e-4, group=np.repeat([0, 1, 2], 4))
    for k in range(3):
        at = slice(4 * k, 4 * k + 4)
        own_b, own_c = N.lasso(grams[at], alpha[at], tol=1e-4)
        assert np.allclose(b[at], own_b, rtol=0, atol=1e-13) and np.allclose(c[at], own_c, rtol=0, atol=1e-12)


def test_fill_runs_all_rounds_in_one_pass(spark, var_obs, monkeypatch):
    cuts = []
    monkeypatch.setattr(N, "cut_lineage", lambda df: cuts.append(1) or df)
    holes = var_obs.withColumn("value", F.when((F.col("t_index") % 9) == 4, None).otherwise(F.col("value")))
    once = N.var_fill(holes)
    assert len(cuts) == 1 and once._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1


def test_fill_leaves_profiles_without_name_or_with_unnamed_codes(spark):
    rows = [(p, c, t, None if t % 4 == 2 else float(t * t)) for p, codes in ((None, ("C1", "P1")), ("a", ("C1", None)), ("b", ("C1", "P1"))) for c in codes for t in range(12)]
    obs = spark.createDataFrame(rows, "profile_id string, code string, t_index int, value double")
    got = N.var_fill(obs).where("gap").collect()
    line = lambda t: ((t - 1) ** 2 + (t + 1) ** 2) / 2
    assert len(got) == 18
    assert all((r.filled == pytest.approx(line(r.t_index))) == (r.profile_id != "b") for r in got)


def test_power_rounds_derive_a_vector_once(spark):
    """A round's vector is bound before it is scaled, so the expression does not hold it several times."""
    from lagweave.operators import graph as G

    text = spark.range(1).select(G._norm2(F.transform(F.array(F.lit(3.0), F.col("id") + 4.0), lambda v: v * 2)).alias("x"))
    assert text.first()["x"] == pytest.approx([0.6, 0.8])
    assert text._jdf.queryExecution().analyzed().toString().count("* cast(2") + text._jdf.queryExecution().analyzed().toString().count("* 2") <= 1
