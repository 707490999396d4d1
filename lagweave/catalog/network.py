"""Queries on lagged networks, graph metrics and impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.catalog import fragments as S
from lagweave.catalog.registry import query, rounded
from lagweave.catalog.series import FILL
from lagweave.core.session import cut_lineage
from lagweave.functions.scores import corr
from lagweave.operators import describe as D
from lagweave.operators import graph as G
from lagweave.operators import impact as I
from lagweave.operators import network as N
from lagweave.operators import readiness as R
from lagweave.operators import series as T
from lagweave.sources import tables as M

BASE = f"""WITH {S.COHORT},{FILL},
lp AS (SELECT y.profile_id, y.t_index, y.code dst, z.code src, y.filled y, z.filled z, x.filled x FROM filled y JOIN filled z ON y.profile_id = z.profile_id AND z.t_index = y.t_index - 1 JOIN filled x ON x.profile_id = y.profile_id AND x.t_index = y.t_index AND x.code = z.code),
cf AS (SELECT profile_id, CAST(least(5, t_index // 20) AS INT) time_index, least(5, t_index // 20) / 5 t, dst, src, round(corr(y, z), 6) beta, round(avg(y), 4) intercept, round(corr(y, x), 6) pcorr, round(corr(y, z) - 1 / sqrt(count(*)), 6) ci_low, round(corr(y, z) + 1 / sqrt(count(*)), 6) ci_high FROM lp GROUP BY ALL)"""
CUT = 0.15
EDGES = f"""{BASE}, nd AS (SELECT DISTINCT profile_id, time_index, dst node FROM cf), ed AS (SELECT profile_id, time_index, src, dst, beta w, abs(beta) aw, 1 / (abs(beta) + 1e-12) dist FROM cf WHERE src <> dst AND abs(beta) >= {CUT}),
up AS (SELECT profile_id, time_index, least(src, dst) a, greatest(src, dst) b, max(aw) aw FROM ed GROUP BY ALL), un AS (SELECT profile_id, time_index, a src, b dst, aw FROM up UNION ALL SELECT profile_id, time_index, b, a, aw FROM up)"""
K = "profile_id, time_index"


def filled_obs(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(T.interpolate(M.cohort_obs(spark, d)).select("profile_id", "code", "t_index", "ts", F.col("filled").alias("value")))


def segment_coefs(spark: SparkSession, d: str) -> DataFrame:
    """Lag-1 correlations per 20-slot segment: a coefficient table that plain SQL can also build."""
    obs = filled_obs(spark, d)
    same = obs.select("profile_id", "t_index", F.col("code").alias("src"), F.col("value").alias("x"))
    pairs = T.lag_pairs(obs, 1).join(same, ["profile_id", "t_index", "src"])
    idx = F.least(F.lit(5), F.floor(F.col("t_index") / 20)).cast("int")
    n, r = F.count(F.lit(1)), corr("y", "z")
    out = pairs.groupBy("profile_id", idx.alias("time_index"), "dst", "src").agg(
        r.alias("beta"), corr("y", "x").alias("pcorr"), (r - 1 / F.sqrt(n)).alias("ci_low"), (r + 1 / F.sqrt(n)).alias("ci_high"), (F.round(F.avg("y") + 1e-7, 4)).alias("intercept"))
    return cut_lineage(rounded(out).withColumn("t", F.col("time_index") / 5))


def graph_of(spark, d):
    coefs = segment_coefs(spark, d)
    return G.build_edges(coefs, CUT), G.nodes_of(coefs)


def z_obs(spark, d):
    obs = filled_obs(spark, d)
    return cut_lineage(T.zscore(obs).select("profile_id", "code", "t_index", F.col("z").alias("value")))


@query("W14_error_ratio_segments", f"""{BASE}, rt AS (SELECT {K}, max(abs(beta)) / avg(abs(beta)) ratio FROM cf GROUP BY ALL), fl AS (SELECT *, ratio >= 2.2 hi, coalesce(lag(ratio >= 2.2) OVER w, false) ph FROM rt WINDOW w AS (PARTITION BY profile_id ORDER BY time_index)),
rn AS (SELECT *, sum(CAST(hi AND NOT ph AS INT)) OVER (PARTITION BY profile_id ORDER BY time_index) run, max(time_index) OVER (PARTITION BY profile_id) mx FROM fl), pk AS (SELECT *, hi AND row_number() OVER (PARTITION BY profile_id, run, hi ORDER BY ratio DESC, time_index) = 1 is_peak FROM rn)
SELECT {K}, round(ratio, 6) ratio, is_peak, CAST(coalesce(sum(CAST(is_peak AND time_index < mx AS INT)) OVER (PARTITION BY profile_id ORDER BY time_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) segment FROM pk""")
def w14(spark, d):
    ratio = segment_coefs(spark, d).groupBy(*G.KEY).agg((F.max(F.abs("beta")) / F.avg(F.abs("beta"))).alias("ratio"))
    return rounded(T.error_ratio_segments(ratio, 2.2))


@query("W14_fitted_segments")
def w14f(spark, d):
    """The static model's kernel-weighted error over that of the time-varying one, cut at three."""
    obs = z_obs(spark, d)
    rows, params = cut_lineage(N.lag_rows(obs)), tv_params(spark, obs)
    tv = N.fit_tv_var(rows, params)
    ratio = N.error_ratio(N.static_error_at_points(rows, N.fit_static_var(rows), params), tv)
    return rounded(T.error_ratio_segments(cut_lineage(ratio), 3.0))


@query("W15_change_points", f"""{BASE}, dl AS (SELECT profile_id, time_index, beta - lag(beta) OVER (PARTITION BY profile_id, dst, src ORDER BY time_index) x FROM cf), ds AS (SELECT {K}, sqrt(sum(x * x)) distance FROM dl WHERE x IS NOT NULL GROUP BY ALL),
zz AS (SELECT *, (distance - avg(distance) OVER w) / (stddev_pop(distance) OVER w + 1e-12) z FROM ds WINDOW w AS (PARTITION BY profile_id)) SELECT {K}, round(distance, 6) distance, round(z, 6) z, z > 1.2 is_change_point FROM zz""")
def w15(spark, d):
    return rounded(T.change_points(segment_coefs(spark, d), 1.2))


@query("W16_edge_shifts", f"""{BASE}, m AS (SELECT *, abs(beta - lag(beta) OVER (PARTITION BY profile_id, dst, src ORDER BY time_index)) delta FROM cf WHERE dst <> src),
a AS (SELECT profile_id, dst, src, coalesce(max(delta), 0) md, arg_max(time_index, (coalesce(delta, -1), -time_index)) am, max(beta) - min(beta) rg, regr_slope(beta, t) slope, avg(beta) mean, stddev_pop(beta) sd, min(beta) mn, max(beta) mx FROM m GROUP BY ALL)
SELECT profile_id, dst, src, round(md, 6) max_abs_delta, am argmax_time_index, round(rg, 6) "range", round(slope, 6) slope, round(mean, 6) mean, round(sd, 6) sd, round(mn, 6) "min", round(mx, 6) "max", row_number() OVER (PARTITION BY profile_id ORDER BY md DESC, rg DESC, dst, src) AS rank FROM a QUALIFY rank <= 10""")
def w16(spark, d):
    return rounded(T.edge_shifts(segment_coefs(spark, d), 10))


@query("W19_recency_weighted", f"""{BASE}, ns AS (SELECT {K}, t, dst node, sum(abs(beta)) s FROM cf GROUP BY ALL) SELECT profile_id, node, round(sum(exp(-ln(2) / 0.2 * (1 - t)) * s) / (sum(exp(-ln(2) / 0.2 * (1 - t))) + 1e-12), 6) s FROM ns GROUP BY ALL""")
def w19(spark, d):
    per = segment_coefs(spark, d).groupBy(*G.KEY, "t", F.col("dst").alias("node")).agg(F.sum(F.abs("beta")).alias("s"))
    return rounded(T.recency_weighted(per, ["profile_id", "node"], ["s"], 0.20))


@query("F09_kernel_weights", f"""WITH {S.COHORT}, tn AS (SELECT DISTINCT profile_id, t_index, (t_index - min(t_index) OVER w) / (max(t_index) OVER w - min(t_index) OVER w + 1e-12) t FROM obs WINDOW w AS (PARTITION BY profile_id)),
kw AS (SELECT profile_id, p, t, exp(-0.5 * pow((t - p / 19.0) / 0.15, 2)) / (sqrt(2 * pi()) * 0.15) w FROM tn, range(20) r(p)), nw AS (SELECT *, w * count(*) OVER (PARTITION BY profile_id, p) / (sum(w) OVER (PARTITION BY profile_id, p) + 1e-12) v FROM kw)
SELECT profile_id, CAST(p AS INT) point, round(sum(v), 4) total, round(pow(sum(v) + 1e-12, 2) / (sum(v * v) + 1e-12), 4) ess FROM nw GROUP BY ALL""")
def f09(spark, d):
    from lagweave.functions.scores import effective_sample_size, kernel_weight, sum_to_n

    times = T.t_norm(M.cohort_obs(spark, d)).select("profile_id", "t_index", "t_norm").distinct()
    at = times.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(19))))
    w = at.withColumn("w", kernel_weight(F.col("t_norm"), F.col("point") / 19, F.lit(0.15)))
    w = w.withColumn("v", sum_to_n(F.col("w"), ["profile_id", "point"]))
    return rounded(w.groupBy("profile_id", "point").agg(F.sum("v").alias("total"), effective_sample_size(F.col("v")).alias("ess")), 4)


@query("V03_var_fill")
def v03(spark, d):
    return rounded(N.var_fill(cut_lineage(M.cohort_obs(spark, d))))


def tv_params(spark, obs):
    return obs.select("profile_id").distinct().withColumns({"bandwidth": F.lit(0.15), "alpha": F.lit(0.05)})


@query("V04_fit_tv_var")
def v04(spark, d):
    obs = z_obs(spark, d)
    return rounded(N.fit_tv_var(N.lag_rows(obs), tv_params(spark, obs)))


@query("V05_select_tv_params")
def v05(spark, d):
    return rounded(N.select_tv_params(N.lag_rows(filled_obs(spark, d))))


@query("V06_bootstrap_ci")
def v06(spark, d):
    obs = z_obs(spark, d)
    return rounded(N.bootstrap_ci(N.lag_rows(obs), tv_params(spark, obs)))


@query("V07_fit_static_var")
def v07(spark, d):
    return rounded(N.fit_static_var(N.lag_rows(z_obs(spark, d))))


@query("V08_partial_correlation")
def v08(spark, d):
    """Shrunk precision of the one-step residuals of the static model."""
    obs = z_obs(spark, d)
    static = N.fit_static_var(N.lag_rows(obs))
    pred = N.predict_one_step(obs, static, 1).select("profile_id", "t_index", F.col("dst").alias("code"), (F.col("y") - F.col("y_hat")).alias("e"))
    return rounded(N.partial_correlation(N.residual_moments(cut_lineage(pred))))


@query("V08_shrinkage", f"""WITH {S.COHORT},{FILL}, e AS (SELECT profile_id, t_index, code, filled - avg(filled) OVER (PARTITION BY profile_id, code) x FROM filled),
cv AS (SELECT a.profile_id, a.code a, b.code b, avg(a.x * b.x) c, count(*) n FROM e a JOIN e b ON a.profile_id = b.profile_id AND a.t_index = b.t_index GROUP BY ALL), q AS (SELECT profile_id, sum(q * q) q2 FROM (SELECT profile_id, t_index, sum(x * x) q FROM e GROUP BY ALL) GROUP BY 1),
t AS (SELECT profile_id, sum(c * c) s2, sum(c) FILTER (a = b) tr, count(*) FILTER (a = b) p, max(n) n FROM cv GROUP BY 1), s AS (SELECT profile_id, tr / p mu, (q2 / n - s2) / (p * n) be, (s2 - 2 * (tr / p) * tr + p * pow(tr / p, 2)) / p de FROM t JOIN q USING (profile_id))
SELECT profile_id, a, b, round(c, 4) cov, round(mu, 4) mu, round(CASE WHEN de <= 0 THEN 0 ELSE least(be, de) / de END, 6) shrinkage FROM cv JOIN s USING (profile_id)""")
def v08s(spark, d):
    out = N.residual_moments(filled_obs(spark, d).select("profile_id", "t_index", "code", F.col("value").alias("e"))).drop("n")
    return rounded(out.select("profile_id", "a", "b", "shrinkage")).join(rounded(out.drop("shrinkage"), 4), ["profile_id", "a", "b"])


@query("V09_correlation_baselines")
def v09(spark, d):
    return rounded(N.correlation_baselines(filled_obs(spark, d)))


PRED = f"""{BASE}, mx AS (SELECT profile_id, min(t_index) lo, max(t_index) hi FROM filled GROUP BY 1), tm AS (SELECT lp.*, CAST(least(5, greatest(0, ceil((t_index - lo) / (hi - lo + 1e-12) * 5 - 0.5))) AS INT) time_index FROM lp JOIN mx USING (profile_id)),
te AS (SELECT tm.*, beta * z term, intercept FROM tm JOIN cf USING (profile_id, time_index, dst, src)), pd AS (SELECT profile_id, t_index, dst, max(y) y, sum(term) + max(intercept) y_hat FROM te GROUP BY ALL)"""


@query("V10_predict_one_step", f"{PRED} SELECT profile_id, t_index, dst, round(y, 4) y, round(y_hat, 4) y_hat FROM pd")
def v10(spark, d):
    return rounded(N.predict_one_step(filled_obs(spark, d), segment_coefs(spark, d), 6), 4)


@query("V10_prediction_quality", f"{PRED} SELECT profile_id, count(*) n, round(avg(pow(y - y_hat, 2)), 4) mse, round(1 - sum(pow(y - y_hat, 2)) / (var_pop(y) * count(*) + 1e-12), 4) r2 FROM pd GROUP BY 1")
def v10q(spark, d):
    return rounded(N.prediction_quality(N.predict_one_step(filled_obs(spark, d), segment_coefs(spark, d), 6)), 4)


@query("V11_loo_importance", f"""{PRED}, er AS (SELECT te.profile_id, src, dst, te.term, pd.y - pd.y_hat err FROM te JOIN pd USING (profile_id, t_index, dst)) SELECT profile_id, src predictor, round(avg(pow(err + term, 2) - err * err), 4) delta_mse_all, round(avg(pow(err + term, 2) - err * err) FILTER (dst LIKE 'C%'), 4) delta_mse_criteria FROM er GROUP BY ALL""")
def v11(spark, d):
    return rounded(N.loo_importance(filled_obs(spark, d), segment_coefs(spark, d), 6), 4)


@query("V12_coef_importance", f"""{BASE}, p AS (SELECT {K}, src, sum(abs(beta)) a, coalesce(sum(abs(beta)) FILTER (dst LIKE 'C%'), 0) c, sum(beta) s, avg(CAST(abs(beta) > 1e-12 AS INT)) nz FROM cf GROUP BY ALL)
SELECT profile_id, src predictor, round(avg(a), 6) out_strength_all_mean, round(stddev_pop(a), 6) out_strength_all_sd, round(avg(c), 6) out_strength_criteria_mean, round(stddev_pop(c), 6) out_strength_criteria_sd, round(avg(s), 6) signed_out_all_mean, round(avg(nz), 6) nonzero_fraction_mean FROM p GROUP BY ALL""")
def v12(spark, d):
    return rounded(N.coef_importance(segment_coefs(spark, d)))


@query("V13_criterion_dependence", f"""{BASE}, p AS (SELECT {K}, dst, sum(abs(beta)) s FROM cf WHERE dst LIKE 'C%' AND src LIKE 'P%' GROUP BY ALL) SELECT profile_id, dst criterion, round(avg(s), 6) incoming_mean, round(stddev_pop(s), 6) incoming_sd, round(max(s), 6) incoming_max FROM p GROUP BY ALL""")
def v13(spark, d):
    return rounded(N.criterion_dependence(segment_coefs(spark, d)))


@query("V14_collinearity")
def v14(spark, d):
    out = N.collinearity(D.correlation_matrix(filled_obs(spark, d), "pearson"))
    vif = F.aggregate(F.map_values("vif"), F.lit(0.0), lambda s, v: F.greatest(s, v)).alias("max_vif")
    return rounded(out.select("profile_id", "avg_abs_corr", "max_abs_corr", "n_high_80", "n_high_90", "condition_number", F.element_at("eigenvalues", 1).alias("largest_eigenvalue"), vif))


@query("V15_collinearity_drop")
def v15(spark, d):
    """Threshold .5 on the sparse daily series, where strong chance correlations occur."""
    obs = cut_lineage(M.daily_obs(spark, d))
    stats = R.profile_variables(obs).join(R.outlier_share(obs), T.SERIES, "left")
    return rounded(N.collinearity_drop(D.correlation_matrix(obs, "pearson", 3), stats, 0.5))


@query("V16_edge_recovery", f"""{BASE}, a AS (SELECT profile_id, dst, src, beta e FROM cf WHERE time_index = 0), b AS (SELECT profile_id, dst, src, beta k FROM cf WHERE time_index = 1), j AS (SELECT profile_id, coalesce(e, 0) e, coalesce(k, 0) k FROM a FULL JOIN b USING (profile_id, dst, src)),
c AS (SELECT profile_id, count(*) FILTER (abs(e) >= 0.15 AND abs(k) >= 0.15) tp, count(*) FILTER (abs(e) >= 0.15 AND abs(k) < 0.15) fp, count(*) FILTER (abs(e) < 0.15 AND abs(k) >= 0.15) fn, sqrt(avg(pow(e - k, 2))) rmse, avg(abs(e - k)) mae FROM j GROUP BY 1)
SELECT profile_id, tp, fp, fn, round(rmse, 6) rmse, round(mae, 6) mae, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) f1 FROM c""")
def v16(spark, d):
    c = segment_coefs(spark, d)
    return rounded(N.edge_recovery(c.where("time_index = 0"), c.where("time_index = 1"), 0.15))


@query("G01_build_edges", f"{EDGES} SELECT {K}, src, dst, round(w, 6) w, round(aw, 6) aw, round(dist, 6) dist, CASE WHEN w >= 0 THEN 1.0 ELSE -1.0 END sign FROM ed")
def g01(spark, d):
    return rounded(graph_of(spark, d)[0])


@query("G02_node_strength", f"""{EDGES}, i AS (SELECT {K}, dst node, count(*) n, sum(aw) a, sum(w) s FROM ed GROUP BY ALL), o AS (SELECT {K}, src node, count(*) n, sum(aw) a, sum(w) s FROM ed GROUP BY ALL)
SELECT nd.profile_id, nd.time_index, nd.node, coalesce(i.n, 0) in_degree, round(coalesce(i.a, 0), 6) in_strength_abs, round(coalesce(i.s, 0), 6) in_strength_signed, coalesce(o.n, 0) out_degree, round(coalesce(o.a, 0), 6) out_strength_abs, round(coalesce(o.s, 0), 6) out_strength_signed
FROM nd LEFT JOIN i USING (profile_id, time_index, node) LEFT JOIN o USING (profile_id, time_index, node)""")
def g02(spark, d):
    return rounded(G.node_strength(*graph_of(spark, d)))


ROUNDS = 100


def _rounds(start: str, step, norm: str | None, name: str, rounds: int = ROUNDS) -> str:
    """Unrolled iteration: x0 from `start`, then `rounds` materialized steps."""
    out = f", {name}0 AS MATERIALIZED ({start})"
    for r in range(1, rounds + 1):
        out += f", {name}{r}r AS MATERIALIZED ({step(f'{name}{r - 1}')})"
        out += f", {name}{r} AS MATERIALIZED (SELECT {K}, node, {norm or 'x'} x FROM {name}{r}r)" if norm else f", {name}{r} AS (SELECT * FROM {name}{r}r)"
    return out


ADJ = f"{EDGES}, ot AS (SELECT {K}, src, sum(aw) o FROM ed GROUP BY ALL), nn AS (SELECT {K}, count(*) n FROM nd GROUP BY ALL), gr AS (SELECT t.profile_id, t.time_index, t.node dst, s.node src, coalesce(aw, 0) aw, n, o FROM nd t JOIN nd s USING (profile_id, time_index) LEFT JOIN ed ON ed.profile_id = t.profile_id AND ed.time_index = t.time_index AND ed.src = s.node AND ed.dst = t.node JOIN nn ON nn.profile_id = t.profile_id AND nn.time_index = t.time_index LEFT JOIN ot ON ot.profile_id = t.profile_id AND ot.time_index = t.time_index AND ot.src = s.node)"


def _mul(v: str, expr: str) -> str:
    return f"SELECT gr.profile_id, gr.time_index, gr.dst node, {expr} x FROM gr JOIN {v} v ON v.profile_id = gr.profile_id AND v.time_index = gr.time_index AND v.node = gr.src GROUP BY ALL"


@query("G03_pagerank", f"{ADJ} {_rounds(f'SELECT {K}, node, 1.0 / n x FROM nd JOIN nn USING (profile_id, time_index)', lambda v: _mul(v, '0.85 * sum(CASE WHEN o > 0 THEN aw / o ELSE 1.0 / n END * v.x) + 0.15 / max(n)'), None, 'r')} SELECT {K}, node, round(x, 6) pagerank FROM r{ROUNDS}")
def g03(spark, d):
    return rounded(G.pagerank(*graph_of(spark, d), rounds=ROUNDS))


N2 = f"CASE WHEN sqrt(sum(x * x) OVER (PARTITION BY {K})) > 0 THEN x / sqrt(sum(x * x) OVER (PARTITION BY {K})) ELSE 0 END"
N1 = f"CASE WHEN sum(x) OVER (PARTITION BY {K}) > 0 THEN x / sum(x) OVER (PARTITION BY {K}) ELSE 0 END"
START2 = f"SELECT {K}, node, 1 / sqrt(n) x FROM nd JOIN nn USING (profile_id, time_index)"


@query("G04_spectral_centrality", f"""{ADJ} {_rounds(START2, lambda v: _mul(v, 'sum(aw * v.x) + max(v.x) FILTER (gr.src = gr.dst)'), N2, 'e')} {_rounds(f'SELECT {K}, node, 1.0 x FROM nd', lambda v: _mul(v, '0.1 * sum(aw * v.x) + 1'), None, 'k')}
, ga AS (SELECT a.profile_id, a.time_index, a.dst, b.dst src, sum(a.aw * b.aw) aw FROM gr a JOIN gr b ON a.profile_id = b.profile_id AND a.time_index = b.time_index AND a.src = b.src GROUP BY ALL) {_rounds(f'SELECT {K}, node, 1.0 / n x FROM nd JOIN nn USING (profile_id, time_index)', lambda v: _mul(v, 'sum(aw * v.x)').replace('gr', 'ga').replace('gaOUP', 'GROUP'), N1, 'h')}
, hb AS (SELECT gr.profile_id, gr.time_index, gr.src node, sum(aw * v.x) x FROM gr JOIN h{ROUNDS} v ON v.profile_id = gr.profile_id AND v.time_index = gr.time_index AND v.node = gr.dst GROUP BY ALL), hn AS (SELECT {K}, node, {N1} x FROM hb), kn AS (SELECT {K}, node, {N2} x FROM k{ROUNDS})
SELECT e.profile_id, e.time_index, e.node, round(e.x, 6) eigenvector, round(kn.x, 6) katz, round(h.x, 6) hits_authority, round(hn.x, 6) hits_hub FROM e{ROUNDS} e JOIN kn USING (profile_id, time_index, node) JOIN h{ROUNDS} h USING (profile_id, time_index, node) JOIN hn USING (profile_id, time_index, node)""")
def g04(spark, d):
    return rounded(G.spectral_centrality(*graph_of(spark, d), rounds=ROUNDS))


def walks(edges: str) -> str:
    """All simple paths by recursion; small graphs only."""
    return f"""wk AS (SELECT {K}, src s, dst t, 1 / (aw + 1e-12) len, [src, dst] nodes FROM {edges} UNION ALL SELECT wk.profile_id, wk.time_index, s, e.dst, len + 1 / (e.aw + 1e-12), list_append(nodes, e.dst) FROM wk JOIN {edges} e ON e.profile_id = wk.profile_id AND e.time_index = wk.time_index AND e.src = wk.t WHERE NOT list_contains(nodes, e.dst)),
ds AS (SELECT {K}, s, t, min(len) d FROM wk GROUP BY ALL)"""


RECURSIVE_EDGES = EDGES.replace("WITH ", "WITH RECURSIVE ", 1)


@query("G05_closeness", f"""{RECURSIVE_EDGES}, {walks('ed')}, nn AS (SELECT {K}, count(*) n FROM nd GROUP BY ALL), i AS (SELECT {K}, t node, count(*) r, sum(d) s, sum(1 / d) h FROM ds GROUP BY ALL)
SELECT {K}, node, round(coalesce(r / s * r / (n - 1), 0), 6) closeness, round(coalesce(h, 0), 6) harmonic FROM nd JOIN nn USING (profile_id, time_index) LEFT JOIN i USING (profile_id, time_index, node)""")
def g05(spark, d):
    edges, nodes = graph_of(spark, d)
    return rounded(G.closeness(G.shortest_paths(edges, nodes), nodes))


COMP = f"""cp0 AS (SELECT {K}, node, node c FROM nd UNION SELECT {K}, t, s FROM ds), cp AS (SELECT {K}, node, min(c) component FROM cp0 GROUP BY ALL)"""


@query("G05_path_summary", f"""{RECURSIVE_EDGES}, {walks('un')}, {COMP}, sz AS (SELECT {K}, component, count(*) n FROM cp GROUP BY ALL), bg AS (SELECT {K}, arg_max(component, (n, component)) component, max(n) largest_component_size FROM sz GROUP BY ALL),
ef AS (SELECT {K}, avg(1 / (d + 1e-12)) e FROM ds GROUP BY ALL), lc AS (SELECT ds.profile_id, ds.time_index, avg(d) a, max(d) m FROM ds JOIN cp ON cp.profile_id = ds.profile_id AND cp.time_index = ds.time_index AND cp.node = ds.s JOIN bg ON bg.profile_id = cp.profile_id AND bg.time_index = cp.time_index AND bg.component = cp.component GROUP BY ALL)
SELECT {K}, largest_component_size, round(e, 6) global_efficiency, round(a, 6) avg_path_length, round(m, 6) diameter FROM bg LEFT JOIN ef USING (profile_id, time_index) LEFT JOIN lc USING (profile_id, time_index)""")
def g05p(spark, d):
    edges, nodes = graph_of(spark, d)
    und = cut_lineage(G.undirected(edges))
    return rounded(G.path_summary(G.shortest_paths(und, nodes), G.components(und, nodes)))


@query("G06_betweenness", f"""{RECURSIVE_EDGES}, {walks('ed')}, nn AS (SELECT {K}, count(*) n FROM nd GROUP BY ALL), sp AS (SELECT wk.* FROM wk JOIN ds USING (profile_id, time_index, s, t) WHERE len <= d * (1 + 1e-9)), ct AS (SELECT {K}, s, t, count(*) k FROM sp GROUP BY ALL),
md AS (SELECT {K}, s, t, unnest(nodes[2:-2]) node FROM sp), bt AS (SELECT md.profile_id, md.time_index, node, sum(1.0 / k) b FROM md JOIN ct USING (profile_id, time_index, s, t) GROUP BY ALL)
SELECT {K}, node, round(coalesce(b / ((n - 1) * (n - 2)), 0), 6) betweenness FROM nd JOIN nn USING (profile_id, time_index) LEFT JOIN bt USING (profile_id, time_index, node)""")
def g06(spark, d):
    edges, nodes = graph_of(spark, d)
    return rounded(G.betweenness(edges, nodes))


TRI = f"""sw AS (SELECT {K}, a, b, aw / max(aw) OVER (PARTITION BY {K}) s FROM up), tr AS (SELECT x.profile_id, x.time_index, x.a a, x.b b, y.b c, cbrt(x.s * y.s * z.s) g FROM sw x JOIN sw y ON x.profile_id = y.profile_id AND x.time_index = y.time_index AND x.b = y.a JOIN sw z ON z.profile_id = x.profile_id AND z.time_index = x.time_index AND z.a = x.a AND z.b = y.b),
tn AS (SELECT {K}, node, sum(g) g, count(*) n FROM (SELECT {K}, unnest([a, b, c]) node, g FROM tr) GROUP BY ALL), dg AS (SELECT {K}, src node, count(*) k FROM un GROUP BY ALL),
cl AS (SELECT {K}, node, coalesce(n, 0) n_triangles, CASE WHEN coalesce(k, 0) > 1 THEN 2 * coalesce(g, 0) / (k * (k - 1)) ELSE 0 END clustering, coalesce(k, 0) degree FROM nd LEFT JOIN dg USING (profile_id, time_index, node) LEFT JOIN tn USING (profile_id, time_index, node))"""


@query("G07_clustering", f"{EDGES}, {TRI} SELECT {K}, node, n_triangles, round(clustering, 6) clustering, degree FROM cl")
def g07(spark, d):
    edges, nodes = graph_of(spark, d)
    return rounded(G.clustering(cut_lineage(G.undirected(edges)), nodes))


@query("G08_core_number", f"""{EDGES}, sub AS (SELECT {K}, list(node ORDER BY node) ns FROM nd GROUP BY ALL), ms AS (SELECT {K}, ns, unnest(range(1, CAST(pow(2, len(ns)) AS BIGINT))) m FROM sub), mb AS (SELECT {K}, m, unnest(list_filter(ns, lambda x, i: (m // CAST(pow(2, i - 1) AS BIGINT)) % 2 = 1)) node FROM ms),
dg AS (SELECT a.profile_id, a.time_index, a.m, a.node, count(b.node) k FROM mb a LEFT JOIN un ON un.profile_id = a.profile_id AND un.time_index = a.time_index AND un.src = a.node LEFT JOIN mb b ON b.profile_id = a.profile_id AND b.time_index = a.time_index AND b.m = a.m AND b.node = un.dst GROUP BY ALL), mn AS (SELECT {K}, m, min(k) k FROM dg GROUP BY ALL)
SELECT {K}, node, max(mn.k) core_number FROM mb JOIN mn USING (profile_id, time_index, m) GROUP BY ALL""")
def g08(spark, d):
    edges, nodes = graph_of(spark, d)
    return G.core_number(cut_lineage(G.undirected(edges)), nodes)


@query("G09_communities")
def g09(spark, d):
    edges, nodes = graph_of(spark, d)
    und = cut_lineage(G.undirected(edges))
    modules = G.communities(und, nodes)
    return modules.join(rounded(G.modularity(und, modules)), G.KEY)


@query("G10_participation", f"""{EDGES}, md AS (SELECT *, substr(node, 1, 1) module FROM nd), p AS (SELECT un.profile_id, un.time_index, un.src node, module, sum(aw) k FROM un JOIN md ON md.profile_id = un.profile_id AND md.time_index = un.time_index AND md.node = un.dst GROUP BY ALL), s AS (SELECT {K}, node, 1 - sum(k * k) / pow(sum(k), 2) pc FROM p GROUP BY ALL)
SELECT {K}, node, round(coalesce(pc, 0), 6) participation_coeff FROM nd LEFT JOIN s USING (profile_id, time_index, node)""")
def g10(spark, d):
    """Modules are the two roles."""
    edges, nodes = graph_of(spark, d)
    return rounded(G.participation(G.undirected(edges), nodes.withColumn("module", F.substring("node", 1, 1))))


@query("G11_structural_holes", f"""{EDGES}, t AS (SELECT {K}, src, dst, aw / sum(aw) OVER w p, aw / max(aw) OVER w m FROM un WINDOW w AS (PARTITION BY {K}, src)),
i2 AS (SELECT a.profile_id, a.time_index, a.src v, b.dst u, sum(a.p * b.p) q FROM t a JOIN t b ON a.profile_id = b.profile_id AND a.time_index = b.time_index AND a.dst = b.src WHERE a.src <> b.dst GROUP BY ALL), cs AS (SELECT t.profile_id, t.time_index, t.src node, sum(pow(p + coalesce(q, 0), 2)) c FROM t LEFT JOIN i2 ON i2.profile_id = t.profile_id AND i2.time_index = t.time_index AND i2.v = t.src AND i2.u = t.dst GROUP BY ALL),
rd AS (SELECT a.profile_id, a.time_index, a.src node, sum(1 - coalesce((SELECT sum(b.p * c.m) FROM t b JOIN t c ON c.profile_id = b.profile_id AND c.time_index = b.time_index AND c.dst = b.dst WHERE b.profile_id = a.profile_id AND b.time_index = a.time_index AND b.src = a.dst AND c.src = a.src), 0)) es FROM t a GROUP BY ALL)
SELECT {K}, node, round(c, 6) "constraint", round(es, 6) effective_size FROM cs JOIN rd USING (profile_id, time_index, node)""")
def g11(spark, d):
    return rounded(G.structural_holes(cut_lineage(G.undirected(graph_of(spark, d)[0]))))


@query("G12_global_metrics", f"""{EDGES}, {TRI}, e AS (SELECT x.profile_id, x.time_index, count(*) n_edges, avg(CAST(y.src IS NOT NULL AS INT)) rc FROM ed x LEFT JOIN ed y ON y.profile_id = x.profile_id AND y.time_index = x.time_index AND y.src = x.dst AND y.dst = x.src GROUP BY ALL), l AS (SELECT {K}, count(*) n, avg(clustering) ac, 2 * sum(n_triangles) / nullif(sum(degree * (degree - 1)), 0) ts FROM cl GROUP BY ALL),
asr AS (SELECT un.profile_id, un.time_index, corr(a.degree, b.degree) c FROM un JOIN cl a ON a.profile_id = un.profile_id AND a.time_index = un.time_index AND a.node = un.src JOIN cl b ON b.profile_id = un.profile_id AND b.time_index = un.time_index AND b.node = un.dst GROUP BY ALL)
SELECT {K}, n n_nodes, coalesce(n_edges, 0) n_edges, round(coalesce(rc, 0), 6) reciprocity, round(ac, 6) avg_clustering, round(coalesce(ts, 0), 6) transitivity, round(CASE WHEN isnan(c) THEN NULL ELSE c END, 6) degree_assortativity, round(coalesce(n_edges, 0) / (n * (n - 1)), 6) density FROM l LEFT JOIN e USING (profile_id, time_index) LEFT JOIN asr USING (profile_id, time_index)""")
def g12(spark, d):
    return rounded(G.global_metrics(*graph_of(spark, d)))


@query("G13_clique_cover")
def g13(spark, d):
    from lagweave.operators.retrieval import cosine_threshold_join

    vecs = M.table(spark, d, "embeddings")
    return G.clique_cover(cosine_threshold_join(vecs, 0.3), vecs.select("vec_id"))
