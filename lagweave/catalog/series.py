"""Queries on ordered series and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagweave.catalog import fragments as S
from lagweave.catalog.registry import query, rounded
from lagweave.core.session import cut_lineage
from lagweave.operators import describe as D
from lagweave.operators import readiness as R
from lagweave.operators import series as T
from lagweave.operators import tests as H
from lagweave.sources import tables as M

COLS = "profile_id, code"
OVER = "OVER (PARTITION BY profile_id, code ORDER BY t_index)"


@query("W01_order_by_time", """WITH r AS (SELECT event_id, user_id AS profile_id, CASE WHEN event_id % 13 <> 0 AND NOT (user_id % 5 = 0 AND event_id % 3 = 0) THEN ts END stamp FROM events),
u AS (SELECT profile_id, avg(CAST(stamp IS NOT NULL AS INT)) >= 0.8 by_time FROM r GROUP BY 1)
SELECT r.profile_id, event_id, by_time, row_number() OVER (PARTITION BY r.profile_id ORDER BY CASE WHEN by_time THEN epoch_us(stamp) ELSE event_id END NULLS LAST, event_id) - 1 AS seq FROM r JOIN u USING (profile_id)""")
def w01(spark, d):
    keep = (F.col("event_id") % 13 != 0) & ~((F.col("user_id") % 5 == 0) & (F.col("event_id") % 3 == 0))
    rows = M.table(spark, d, "events").select(F.col("user_id").alias("profile_id"), "event_id", F.when(keep, F.col("ts")).alias("stamp"))
    return T.order_by_time(rows, ["profile_id"], "stamp", "event_id").drop("stamp")


@query("W02_sampling_regularity", """WITH times AS (SELECT user_id AS profile_id, ts FROM events),
steps AS (SELECT profile_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY profile_id ORDER BY ts)) step FROM times),
stepn AS (SELECT profile_id, round(step / 1e7) * 10 AS rounded, count(*) n, count(*) FILTER (step = 0) dups FROM steps WHERE step IS NOT NULL GROUP BY ALL),
r AS (SELECT profile_id, CAST(sum(n) + 1 AS BIGINT) n_points, arg_max(rounded, (n, -rounded)) modal, 1 - max(n) / sum(n) irr, sum(dups) / (sum(n) + 1) dup FROM stepn GROUP BY 1)
SELECT profile_id, n_points, CASE WHEN n_points >= 5 THEN modal END modal_step, CASE WHEN n_points >= 5 THEN round(irr, 6) END irregular_fraction, CASE WHEN n_points >= 5 THEN round(dup, 6) END duplicate_fraction,
CASE WHEN n_points < 5 THEN NULL WHEN irr <= 0.15 THEN 'regular_or_quasi_regular' WHEN irr <= 0.35 THEN 'moderately_irregular' ELSE 'highly_irregular' END regularity FROM r""")
def w02(spark, d):
    return rounded(T.sampling_regularity(M.table(spark, d, "events").select(F.col("user_id").alias("profile_id"), "ts"), ["profile_id"]))


@query("W03_longest_gap", f"WITH {S.ALL_OBS},{S.GAPS} SELECT DISTINCT {COLS}, coalesce(gap, 0) max_consecutive_missing FROM obs LEFT JOIN gaps USING (profile_id, code)")
def w03(spark, d):
    return T.longest_gap(M.all_obs(spark, d))


@query("W04_effective_n", f"""WITH {S.ALL_OBS}, pres AS (SELECT profile_id, code, t_index, value IS NOT NULL AS now, coalesce(lag(value IS NOT NULL) {OVER}, false) AS before FROM obs),
v AS (SELECT profile_id, code, sum(CAST(now AND before AS INT)) ne FROM pres GROUP BY ALL),
q AS (SELECT profile_id, CAST(floor(quantile_cont(ne, 0.25)) AS BIGINT) n_eff_q25, count(*) k FROM v GROUP BY 1),
s AS (SELECT profile_id, CAST(sum(CAST(ok AS INT)) AS BIGINT) n_eff_strict FROM (SELECT profile_id, t_index, bool_and(now AND before) ok FROM pres GROUP BY ALL) GROUP BY 1)
SELECT * FROM q JOIN s USING (profile_id)""")
def w04(spark, d):
    return T.effective_n(M.all_obs(spark, d))


@query("W05_autocorr1", f"""WITH {S.ALL_OBS}, p AS (SELECT profile_id, code, value, lag(value) {OVER} b FROM obs WHERE value IS NOT NULL)
SELECT {COLS}, CASE WHEN count(*) >= 3 THEN round(CASE WHEN isnan(corr(value, b)) THEN NULL ELSE corr(value, b) END, 6) END autocorr_lag1 FROM p GROUP BY ALL""")
def w05(spark, d):
    return rounded(T.autocorr1(M.all_obs(spark, d)))


LJUNG = f"""dv AS (SELECT profile_id, code, value - avg(value) OVER (PARTITION BY profile_id, code) dv, row_number() {OVER} seq FROM obs WHERE value IS NOT NULL),
c0 AS (SELECT profile_id, code, count(*) n, sum(dv * dv) c0, least(10, greatest(2, count(*) // 6)) lag FROM dv GROUP BY ALL),
ck AS (SELECT a.profile_id, a.code, a.seq - b.seq k, sum(a.dv * b.dv) c FROM dv a JOIN dv b ON a.profile_id = b.profile_id AND a.code = b.code AND a.seq - b.seq BETWEEN 1 AND 10 GROUP BY ALL),
lj AS (SELECT profile_id, code, n, CAST(lag AS INT) lag, CASE WHEN n >= lag + 8 AND c0 > 0 THEN n * (n + 2) * coalesce((SELECT sum(pow(c / c0.c0, 2) / (c0.n - k)) FROM ck WHERE ck.profile_id = c0.profile_id AND ck.code = c0.code AND k <= c0.lag), 0) END q_stat FROM c0)"""


@query("W06_ljung_box", f"WITH {S.ALL_OBS},{LJUNG} SELECT {COLS}, n, lag, round(q_stat, 6) q_stat, round({S.chi2_tail_sql('q_stat', 'lag')}, 6) p_value FROM lj")
def w06(spark, d):
    from lagweave.functions.tails import p_chi2

    return rounded(T.ljung_box(M.all_obs(spark, d)).withColumn("p_value", p_chi2(F.col("q_stat"), F.col("lag"))))


@query("F10_tail_probabilities", f"""WITH {S.ALL_OBS},{LJUNG}, g AS (SELECT profile_id, code, q_stat, lag, n FROM lj WHERE q_stat IS NOT NULL)
SELECT {COLS}, round({S.chi2_tail_sql('q_stat', 'lag')}, 6) chi2_p, round({S.norm_tail_sql('q_stat / 5')}, 6) norm_p, round({S.t_tail_sql('q_stat / 4', 'n - 1')}, 6) t_p, round({S.f_tail_sql('q_stat / 6', 'lag', 'n - 1')}, 6) f_p FROM g""")
def f10(spark, d):
    from lagweave.functions import tails as P

    q = F.col("q_stat")
    got = T.ljung_box(M.all_obs(spark, d)).where(q.isNotNull())
    return rounded(got.select("profile_id", "code", P.p_chi2(q, F.col("lag")).alias("chi2_p"), P.p_norm(q / 5).alias("norm_p"),
                              P.p_t(q / 4, F.col("n") - 1).alias("t_p"), P.p_f(q / 6, F.col("lag"), F.col("n") - 1).alias("f_p")))


@query("W07_t_norm", f"WITH {S.COHORT} SELECT {COLS}, t_index, round((t_index - min(t_index) OVER w) / (max(t_index) OVER w - min(t_index) OVER w + 1e-12), 6) t_norm FROM obs WINDOW w AS (PARTITION BY profile_id)")
def w07(spark, d):
    return rounded(T.t_norm(M.cohort_obs(spark, d)).select("profile_id", "code", "t_index", "t_norm"))


@query("W07_time_axis", f"""WITH {S.ALL_OBS}, sl AS (SELECT profile_id, t_index slot, min(ts) ts FROM obs GROUP BY ALL), kd AS (SELECT *, hash_kind, slot % 10 d FROM (SELECT *, length(profile_id) + CAST(substr(profile_id, 2) AS BIGINT) % 3 hash_kind FROM sl)),
rw AS (SELECT profile_id, slot, CASE WHEN hash_kind % 3 = 0 AND d < 8 OR hash_kind % 3 <> 0 AND d < 3 THEN CAST(slot AS DOUBLE) END x, CASE WHEN hash_kind % 3 = 1 AND d < 9 OR hash_kind % 3 <> 1 AND d < 4 THEN CAST(epoch_us(ts) AS DOUBLE) END y FROM kd),
ct AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY slot) - 1.0 i, greatest(3, floor(0.7 * count(*) OVER w)) need, count(x) OVER w nx, count(y) OVER w ny FROM rw WINDOW w AS (PARTITION BY profile_id)),
ax AS (SELECT *, CASE WHEN nx >= need THEN 'index' WHEN ny >= need THEN 'date' ELSE 'order' END axis, CASE WHEN nx >= need THEN x WHEN ny >= need THEN y ELSE i END v FROM ct),
nb AS (SELECT *, last_value(v IGNORE NULLS) OVER u pv, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER u pi, first_value(v IGNORE NULLS) OVER d2 nv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER d2 ni FROM ax
 WINDOW u AS (PARTITION BY profile_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d2 AS (PARTITION BY profile_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fl AS (SELECT profile_id, slot, axis, coalesce(v, CASE WHEN ni > pi THEN pv + (nv - pv) * (i - pi) / (ni - pi) END, pv, nv) z FROM nb)
SELECT profile_id, slot, axis, round((z - min(z) OVER w) / (max(z) OVER w - min(z) OVER w + 1e-12), 6) t_norm FROM fl WINDOW w AS (PARTITION BY profile_id)""")
def w07a(spark, d):
    """Profiles of all three kinds: index with gaps, dates with gaps, hardly any of both."""
    slots = M.all_obs(spark, d).groupBy("profile_id", F.col("t_index").alias("slot")).agg(F.min("ts").alias("ts"))
    kind, digit = (F.length("profile_id") + F.substring("profile_id", 2, 18).cast("long") % 3) % 3, F.col("slot") % 10
    rows = slots.select("profile_id", "slot", F.when(F.when(kind == 0, digit < 8).otherwise(digit < 3), F.col("slot")).alias("t_index"),
                        F.when(F.when(kind == 1, digit < 9).otherwise(digit < 4), F.col("ts")).alias("ts"))
    return rounded(T.time_axis(rows, "slot").select("profile_id", "slot", "axis", "t_norm"))


FILL = """f AS (SELECT *, last_value(value IGNORE NULLS) OVER u pv, last_value(CASE WHEN value IS NOT NULL THEN t_index END IGNORE NULLS) OVER u px,
 first_value(value IGNORE NULLS) OVER d nv, first_value(CASE WHEN value IS NOT NULL THEN t_index END IGNORE NULLS) OVER d nx FROM obs
 WINDOW u AS (PARTITION BY profile_id, code ORDER BY t_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d AS (PARTITION BY profile_id, code ORDER BY t_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT profile_id, code, t_index, ts, value, coalesce(value, CASE WHEN nx > px THEN pv + (nv - pv) * (t_index - px) / (nx - px) END, pv, nv) filled, coalesce(value, pv, nv) carried FROM f)"""


@query("W08_interpolate", f"WITH {S.ALL_OBS},{FILL} SELECT {COLS}, t_index, round(filled, 6) filled FROM filled")
def w08(spark, d):
    return rounded(T.interpolate(M.all_obs(spark, d)).select("profile_id", "code", "t_index", "filled"))


@query("W09_ffill_bfill", f"WITH {S.ALL_OBS},{FILL} SELECT {COLS}, t_index, round(carried, 6) filled FROM filled")
def w09(spark, d):
    return rounded(T.ffill_bfill(M.all_obs(spark, d)).select("profile_id", "code", "t_index", "filled"))


BINARY_OBS = S.ALL_OBS.replace('obs AS (SELECT * FROM d_obs', 'obs0 AS (SELECT * FROM d_obs') + ", obs AS (SELECT profile_id, code, t_index, ts, CASE WHEN code = 'P02' THEN CAST(value > 30 AS DOUBLE) ELSE value END AS value FROM obs0)"
POLICY = f"""{S.PROFILE_STATS},{S.REGULARITY},{FILL},
pol AS (SELECT p.profile_id, p.code, CASE WHEN n < 8 OR missing_pct <= 0.02 OR missing_pct > 0.85 THEN 'none' WHEN var_type = 'binary' THEN 'ffill_bfill'
 WHEN n >= 20 AND missing_pct <= 0.60 AND coalesce(regularity, 'x') <> 'highly_irregular' THEN 'model' ELSE 'interpolate' END AS policy FROM prof p LEFT JOIN reg USING (profile_id))"""


def imputed(spark, d):
    """One variable made binary, so that every policy occurs."""
    from lagweave.operators.network import var_fill

    raw = M.all_obs(spark, d)
    obs = cut_lineage(raw.withColumn("value", F.when(F.col("code") == "P02", (F.col("value") > 30).cast("double")).otherwise(F.col("value"))))
    reg = T.sampling_regularity(T.filled_times(obs), ["profile_id"])
    return T.impute(obs, R.profile_variables(obs), reg, var_fill(obs)).select("profile_id", "code", "t_index", "policy", "filled")


@query("W10_impute")
def w10(spark, d):
    """Every policy; the model branch takes the lag-model fill of V03, which tests compare with plain matrices."""
    return rounded(imputed(spark, d))


@query("W10_policy", f"""WITH {BINARY_OBS},
{POLICY}
SELECT {COLS}, t_index, policy, round(CASE policy WHEN 'none' THEN value WHEN 'ffill_bfill' THEN carried ELSE filled END, 6) filled FROM filled JOIN pol USING (profile_id, code) WHERE policy <> 'model' OR value IS NOT NULL""")
def w10p(spark, d):
    """The fills that need no model: all policies but `model`, and the values that `model` leaves alone."""
    observed = M.all_obs(spark, d).where("value is not null").select("profile_id", "code", "t_index", F.lit(True).alias("seen"))
    out = imputed(spark, d).join(observed, ["profile_id", "code", "t_index"], "left")
    return rounded(out.where((F.col("policy") != "model") | F.col("seen")).drop("seen"))


@query("W11_calendar_features", f"""WITH {S.COHORT}, c AS (SELECT *, CAST(isodow(ts) - 1 AS INT) weekday, CAST(hour(ts) AS INT) "hour" FROM obs),
p AS (SELECT *, weekday >= 5 weekend, CASE WHEN "hour" <= 5 THEN 'Night' WHEN "hour" <= 11 THEN 'Morning' WHEN "hour" <= 17 THEN 'Afternoon' ELSE 'Evening' END day_part FROM c)
SELECT {COLS}, t_index, weekday, weekend, "hour", day_part, count(value) OVER (PARTITION BY profile_id, code) >= 10 weekday_ok,
count(value) OVER (PARTITION BY profile_id, code) >= 20 AND count(value) OVER (PARTITION BY profile_id, code, "hour") >= 5 hour_ok, count(value) OVER (PARTITION BY profile_id, code, day_part) >= 5 part_ok FROM p""")
def w11(spark, d):
    return T.calendar_features(M.cohort_obs(spark, d)).drop("ts", "value")


def roles(obs):
    return obs.select("profile_id", "code").distinct().withColumn("role", F.when(F.col("code").startswith("P"), "PREDICTOR").otherwise("CRITERION"))


@query("W12_rolling_coupling", f"""WITH {S.COHORT},{FILL}, l AS (SELECT profile_id, max(t_index) AS mx FROM obs GROUP BY 1), centers AS (SELECT profile_id, unnest(range(10, mx - 10 + 1)) center FROM l),
x AS (SELECT c.profile_id, center, a.code xc, b.code yc, count(*) n, covar_pop(a.filled, b.filled) cv, stddev_pop(a.filled) sx, stddev_pop(b.filled) sy FROM centers c
 JOIN filled a ON a.profile_id = c.profile_id AND a.t_index >= center - 10 AND a.t_index < center + 10 AND a.code LIKE 'P%' JOIN filled b ON b.profile_id = a.profile_id AND b.t_index = a.t_index AND b.code LIKE 'C%' GROUP BY ALL)
SELECT profile_id, CAST(center AS INT) center, round(avg(abs(n / (n - 1) * cv / ((sx + 1e-12) * (sy + 1e-12)))), 6) coupling, count(*) n_pairs FROM x WHERE n >= 3 GROUP BY ALL""")
def w12(spark, d):
    obs = M.cohort_obs(spark, d)
    filled = T.interpolate(obs).select("profile_id", "code", "t_index", F.col("filled").alias("value"))
    return rounded(T.rolling_coupling(cut_lineage(filled), roles(obs), 20))


@query("W13_zscore", f"""WITH {S.ALL_OBS} SELECT {COLS}, t_index, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w < 1e-12 THEN 1.0 ELSE stddev_pop(value) OVER w END, 6) z FROM obs WINDOW w AS (PARTITION BY profile_id, code)""")
def w13(spark, d):
    return rounded(T.zscore(M.all_obs(spark, d)).select("profile_id", "code", "t_index", "z"))


TREND = f"""sq AS (SELECT profile_id, code, value, CAST(row_number() {OVER} - 1 AS DOUBLE) t FROM obs WHERE value IS NOT NULL),
ft AS (SELECT profile_id, code, count(*) n, regr_slope(value, t) slope, regr_intercept(value, t) icpt, regr_r2(value, t) r2, avg(t) tm, regr_sxx(value, t) sxx FROM sq GROUP BY ALL HAVING count(*) >= 3),
hc AS (SELECT profile_id, code, sum(pow((t - tm) * (value - icpt - slope * t) / (1 - (1.0 / n + pow(t - tm, 2) / sxx)), 2)) / max(sxx * sxx) vr FROM sq JOIN ft USING (profile_id, code) GROUP BY ALL),
tr AS (SELECT *, CASE WHEN vr > 0 THEN slope / sqrt(vr) END z FROM ft JOIN hc USING (profile_id, code))"""


@query("W17_trend", f"WITH {S.ALL_OBS},{TREND} SELECT {COLS}, n, round(slope, 6) slope, round(icpt, 6) intercept, round(coalesce(r2, 0), 6) r2, round(sqrt(vr), 6) se_hc3, round({S.norm_tail_sql('z')}, 6) p_slope FROM tr")
def w17(spark, d):
    return rounded(D.ols_trend(M.all_obs(spark, d)))


@query("W17_logistic_trend")
def w17b(spark, d):
    """Binary version of every cohort series: above 30 or not."""
    obs = M.cohort_obs(spark, d).withColumn("value", (F.col("value") > 30).cast("double"))
    return rounded(D.logistic_trend(obs))


@query("W18_progress", f"""WITH {S.ALL_OBS},{TREND}, sm AS (SELECT profile_id, code, greatest(abs(median(value)), CASE WHEN count(value) >= 4 THEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) ELSE max(value) - min(value) END, max(value) - min(value)) sc,
 arg_min(value, t_index) rf, arg_max(value, t_index) rl FROM obs WHERE value IS NOT NULL GROUP BY ALL)
SELECT {COLS}, round(icpt, 6) fitted_start, round(icpt + slope * (n - 1), 6) fitted_end, round(slope * (n - 1), 6) fitted_delta, round(CASE WHEN abs(sc) > 1e-12 THEN 100 * slope * (n - 1) / sc END, 6) pct_of_scale, round(rf, 6) raw_first, round(rl, 6) raw_last FROM tr JOIN sm USING (profile_id, code)""")
def w18(spark, d):
    obs = cut_lineage(M.all_obs(spark, d))
    return rounded(D.progress(obs, D.ols_trend(obs)))


@query("W21_tail", f"WITH {S.DAILY} SELECT {COLS}, t_index, round(value, 6) value FROM obs QUALIFY row_number() OVER (PARTITION BY profile_id, code ORDER BY t_index DESC) <= 7")
def w21(spark, d):
    return rounded(T.tail(M.daily_obs(spark, d), T.SERIES, [F.desc("t_index")], 7).drop("ts"))


@query("J03_lag_pairs", f"WITH {S.COHORT} SELECT y.profile_id, y.t_index, y.code dst, z.code src, round(y.value, 6) y, round(z.value, 6) z FROM obs y JOIN obs z ON y.profile_id = z.profile_id AND z.t_index = y.t_index - 1")
def j03(spark, d):
    return rounded(T.lag_pairs(M.cohort_obs(spark, d), 1))


@query("J04_assign_nearest_point", f"""WITH {S.COHORT}, n AS (SELECT DISTINCT profile_id, t_index, (t_index - min(t_index) OVER w) / (max(t_index) OVER w - min(t_index) OVER w + 1e-12) t FROM obs WINDOW w AS (PARTITION BY profile_id)),
g AS (SELECT i, i / 19.0 p FROM range(20) r(i))
SELECT profile_id, t_index, CAST((SELECT arg_min(i, (round(abs(p - t), 9), i)) FROM g) AS INT) time_index FROM n""")
def j04(spark, d):
    rows = T.t_norm(M.cohort_obs(spark, d)).select("profile_id", "t_index", "t_norm").distinct()
    return T.assign_nearest_point(rows, F.col("t_norm"), 20).drop("t_norm")


@query("J04_nearest_listed_point", f"""WITH {S.COHORT}, n AS (SELECT DISTINCT profile_id, t_index, (t_index - min(t_index) OVER w) / (max(t_index) OVER w - min(t_index) OVER w + 1e-12) t FROM obs WINDOW w AS (PARTITION BY profile_id)),
g AS (SELECT i, i * i / 400.0 p FROM range(21) r(i))
SELECT profile_id, t_index, CAST((SELECT arg_min(i, (round(abs(p - t), 9), i)) FROM g) AS INT) time_index FROM n""")
def j04n(spark, d):
    rows = T.t_norm(M.cohort_obs(spark, d)).select("profile_id", "t_index", "t_norm").distinct()
    uneven = F.explode(F.array(*[F.struct(F.lit(i * i / 400).alias("at"), F.lit(i).alias("time_index")) for i in range(21)]))
    points = rows.select("profile_id").distinct().withColumn("p", uneven).select("profile_id", "p.*")
    return T.nearest_of(rows, points, ["profile_id"], "t_norm", "at").select("profile_id", "t_index", "time_index")


@query("A02_series_summary", f"WITH {S.ALL_OBS} SELECT {COLS}, count(value) n, {S.SUMMARY_COLS} FROM obs WHERE value IS NOT NULL GROUP BY ALL")
def a02(spark, d):
    return rounded(D.series_summary(M.all_obs(spark, d)))


@query("A05_group_summary", f"""WITH {S.COHORT}, o AS (SELECT *, CAST(isodow(ts) - 1 AS INT) weekday FROM obs)
SELECT {COLS}, weekday, count(*) n_total, count(value) n_nonmissing, round(1 - count(value) / count(*), 6) missing_rate, {S.SUMMARY_COLS} FROM o GROUP BY ALL""")
def a05(spark, d):
    return rounded(D.group_summary(M.cohort_obs(spark, d).withColumn("weekday", F.weekday("ts")), "weekday"))


PAIRS = "pr AS (SELECT a.profile_id, a.t_index, a.code a, b.code b, a.value x, b.value y FROM obs a JOIN obs b ON a.profile_id = b.profile_id AND a.t_index = b.t_index AND a.code < b.code WHERE a.value IS NOT NULL AND b.value IS NOT NULL)"


@query("A07_correlation_pearson", f"WITH {S.ALL_OBS},{PAIRS} SELECT profile_id, a, b, count(*) n, CASE WHEN count(*) >= 10 THEN round(corr(x, y), 6) END r FROM pr GROUP BY ALL")
def a07(spark, d):
    return rounded(D.correlation_matrix(M.all_obs(spark, d)))


@query("A07_correlation_spearman", f"""WITH {S.ALL_OBS},{PAIRS}, rk AS (SELECT profile_id, a, b, rank() OVER (PARTITION BY profile_id, a, b ORDER BY x) + (count(*) OVER (PARTITION BY profile_id, a, b, x) - 1) / 2 rx,
 rank() OVER (PARTITION BY profile_id, a, b ORDER BY y) + (count(*) OVER (PARTITION BY profile_id, a, b, y) - 1) / 2 ry FROM pr)
SELECT profile_id, a, b, count(*) n, CASE WHEN count(*) >= 10 THEN round(corr(rx, ry), 6) END r FROM rk GROUP BY ALL""")
def a07s(spark, d):
    return rounded(D.correlation_matrix(M.all_obs(spark, d), "spearman"))


def ranks_sql(g: str) -> str:
    return f"""mo AS (SELECT {COLS}, {g} g, count(*) n, avg(value) m, var_samp(value) v, median(value) md FROM base GROUP BY ALL),
ct AS (SELECT b.*, value - m AS c, abs(value - md) AS dv, mo.n gn FROM (SELECT *, {g} g FROM base) b JOIN mo USING (profile_id, code, g)),
nm AS (SELECT {COLS}, g, count(*) n, avg(c * c) m2, avg(c * c * c) m3, avg(c * c * c * c) m4, avg(dv) dm, var_samp(dv) dvv FROM ct GROUP BY ALL),
nrm AS (SELECT {COLS}, bool_and(n >= 3 AND coalesce(CASE WHEN m2 > 0 THEN exp(-n / 12.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4)) ELSE 0 END >= 0.05, false)) normal FROM nm GROUP BY ALL),
gt AS (SELECT {COLS}, count(*) k, sum(n) n, min(n) mn, sum(n * m) / sum(n) gm FROM mo GROUP BY ALL),
gd AS (SELECT {COLS}, sum(n * dm) / sum(n) gm FROM nm GROUP BY ALL),
an AS (SELECT {COLS}, (sum(mo.n * pow(m - gm, 2)) / (max(k) - 1)) / (sum((mo.n - 1) * v) / (max(gt.n) - max(k))) f FROM mo JOIN gt USING (profile_id, code) GROUP BY ALL),
lv AS (SELECT {COLS}, (sum(nm.n * pow(dm - gd.gm, 2)) / (max(k) - 1)) / (sum((nm.n - 1) * dvv) / (max(gt.n) - max(k))) f FROM nm JOIN gd USING (profile_id, code) JOIN gt USING (profile_id, code) GROUP BY ALL),
rk AS (SELECT {COLS}, {g} g, rank() OVER (PARTITION BY {COLS} ORDER BY value) + (count(*) OVER (PARTITION BY {COLS}, value) - 1) / 2.0 r, count(*) OVER (PARTITION BY {COLS}, value) t FROM base),
rs AS (SELECT {COLS}, g, sum(r) rs, count(*) n FROM rk GROUP BY ALL),
ti AS (SELECT {COLS}, sum(CAST(t AS DOUBLE) * t - 1) t3, count(*) n FROM rk GROUP BY ALL),
kw AS (SELECT {COLS}, (12.0 / (max(ti.n) * (max(ti.n) + 1)) * sum(rs * rs / rs.n) - 3 * (max(ti.n) + 1)) / (1 - max(t3) / (pow(max(ti.n), 3) - max(ti.n))) h FROM rs JOIN ti USING (profile_id, code) GROUP BY ALL)"""


OMNIBUS = f""", al AS (SELECT gt.profile_id, gt.code, k, gt.n, normal, an.f af, lv.f lf, h FROM gt JOIN nrm USING (profile_id, code) JOIN an USING (profile_id, code) JOIN lv USING (profile_id, code) JOIN kw USING (profile_id, code) WHERE k >= 2 AND mn >= 2),
dc AS (SELECT *, normal AND coalesce({S.f_tail_sql('lf', 'k - 1', 'n - k')}, 1.0) >= 0.05 anova FROM al)
SELECT {COLS}, k n_groups, CAST(n AS BIGINT) n, CASE WHEN anova THEN 'ANOVA' ELSE 'Kruskal-Wallis' END test, round(CASE WHEN anova THEN af ELSE h END, 6) "statistic",
round(CASE WHEN anova THEN {S.f_tail_sql('af', 'k - 1', 'n - k')} ELSE {S.chi2_tail_sql('h', 'k - 1')} END, 6) p_value, round(CASE WHEN NOT anova AND n > k THEN (h - k + 1) / (n - k) END, 6) epsilon_squared FROM dc"""


@query("H02_omnibus_test", f"WITH {S.COHORT}, base AS (SELECT profile_id, code, CAST(isodow(ts) - 1 AS INT) weekday, ln(1 + value) AS value FROM obs WHERE value IS NOT NULL), {ranks_sql('weekday')} {OMNIBUS}")
def h02(spark, d):
    obs = cut_lineage(M.cohort_obs(spark, d).withColumns({"weekday": F.weekday("ts"), "value": F.log(1 + F.col("value"))}))
    return rounded(H.omnibus_test(obs, T.SERIES, "weekday"))


TWO = f""", w AS (SELECT {COLS}, max(CASE WHEN NOT g THEN n END) na, max(CASE WHEN NOT g THEN m END) ma, max(CASE WHEN NOT g THEN v END) va, max(CASE WHEN g THEN n END) nb, max(CASE WHEN g THEN m END) mb, max(CASE WHEN g THEN v END) vb FROM mo GROUP BY ALL),
x AS (SELECT w.*, normal, t3, rs.rs - na * (na + 1) / 2 u FROM w JOIN nrm USING (profile_id, code) JOIN ti USING (profile_id, code) JOIN rs USING (profile_id, code) WHERE NOT rs.g AND na >= 2 AND nb >= 2),
y AS (SELECT *, (ma - mb) / sqrt(va / na + vb / nb) t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) dof,
 greatest(0.0, abs(u - na * nb / 2) - 0.5) / sqrt(na * nb / 12 * (na + nb + 1 - t3 / ((na + nb) * (na + nb - 1)))) z, sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) sp FROM x)
SELECT {COLS}, na a_n, nb b_n, CASE WHEN normal THEN 'Welch_t' ELSE 'Mann_Whitney_U' END test, round(CASE WHEN normal THEN t ELSE u END, 6) "statistic", round(CASE WHEN normal THEN {S.t_tail_sql('t', 'dof')} ELSE {S.norm_tail_sql('z')} END, 6) p_value,
round(CASE WHEN normal AND sp > 1e-12 THEN (mb - ma) / sp END, 6) cohens_d, round(CASE WHEN NOT normal THEN 1 - 2 * u / (na * nb) END, 6) rank_biserial FROM y"""


@query("H03_two_group_test", f"WITH {S.ALL_OBS}, base AS (SELECT profile_id, code, isodow(ts) >= 6 weekend, ln(1 + value) AS value FROM obs WHERE value IS NOT NULL), {ranks_sql('weekend')} {TWO}")
def h03(spark, d):
    obs = cut_lineage(M.all_obs(spark, d).withColumns({"weekend": F.weekday("ts") >= 5, "value": F.log(1 + F.col("value"))}))
    return rounded(H.two_group_test(obs, T.SERIES, "weekend"))


@query("H04_nominal_effects", f"""WITH {S.COHORT}, base0 AS (SELECT profile_id, code, CASE WHEN hour(ts) <= 5 THEN 'Night' WHEN hour(ts) <= 11 THEN 'Morning' WHEN hour(ts) <= 17 THEN 'Afternoon' ELSE 'Evening' END part, value FROM obs WHERE value IS NOT NULL),
lc0 AS (SELECT {COLS}, part, count(*) n FROM base0 GROUP BY ALL), lc AS (SELECT *, sum(n) OVER (PARTITION BY {COLS}) tot FROM lc0), lk AS (SELECT *, count(*) OVER (PARTITION BY {COLS}) nl FROM lc WHERE n >= 5),
base AS (SELECT base0.* FROM base0 JOIN lk USING (profile_id, code, part) WHERE nl >= 2 AND tot >= 10), {ranks_sql('part')} {OMNIBUS}""")
def h04(spark, d):
    obs = cut_lineage(T.calendar_features(M.cohort_obs(spark, d)))
    return rounded(H.nominal_effects(obs, T.SERIES, "day_part"))


@query("H01_stationarity")
def h01(spark, d):
    return rounded(H.stationarity(M.all_obs(spark, d)))


@query("K13_highlights")
def k13(spark, d):
    obs = cut_lineage(M.cohort_obs(spark, d))
    trend = cut_lineage(D.ols_trend(obs))
    wk = H.omnibus_test(obs.withColumn("g", F.weekday("ts")), T.SERIES, "g").select("profile_id", "code", F.lit("weekday").alias("effect"), "p_value")
    we = H.two_group_test(obs.withColumn("g", F.weekday("ts") >= 5), T.SERIES, "g").select("profile_id", "code", F.lit("weekend").alias("effect"), "p_value")
    return rounded(D.highlights(D.progress(obs, trend), trend, wk.unionByName(we)))


@query("P08_detect_nominal", """WITH s AS (SELECT 'event_type' AS "column", count(DISTINCT event_type) n_levels FROM events UNION ALL SELECT 'weekday', count(DISTINCT isodow(ts)) FROM events UNION ALL SELECT 'even_user', count(DISTINCT user_id % 2) FROM events)
SELECT * FROM s WHERE n_levels BETWEEN 2 AND CASE "column" WHEN 'event_type' THEN 12 ELSE 6 END""")
def p08(spark, d):
    rows = M.table(spark, d, "events").select("event_type", "props", F.weekday("ts").alias("weekday"), (F.col("user_id") % 2).alias("even_user"), "value")
    return D.detect_nominal(rows, {"event_type": "text", "props": "text", "weekday": "numeric", "even_user": "numeric", "value": "numeric"})
