"""Queries on data quality and readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagweave.catalog import fragments as S
from lagweave.catalog.registry import joined, query, rounded
from lagweave.core.session import cut_lineage
from lagweave.operators import readiness as R
from lagweave.operators import series as T
from lagweave.sources import tables as M

COLS = "profile_id, code"


def _stats(spark, d):
    return R.variable_drop_reasons(R.variable_table(M.all_obs(spark, d)))


def _tiers(spark, d):
    """The grid and the variable table feed many branches, so both are written once."""
    obs = cut_lineage(M.all_obs(spark, d))
    stats = cut_lineage(R.variable_drop_reasons(R.variable_table(obs)))
    reg = T.sampling_regularity(T.filled_times(obs), ["profile_id"])
    return stats, R.readiness_tiers(obs, stats, reg)


@query("A01_profile_variables", f"""WITH {S.ALL_OBS},{S.PROFILE_STATS}
SELECT {COLS}, n_total, n, n_unique, round(dominance, 6) dominance, round(mean, 6) mean, round(sd, 6) sd, round(median, 6) median, round(missing_pct, 6) missing_pct FROM prof""")
def a01(spark, d):
    return rounded(R.profile_variables(M.all_obs(spark, d)).select(
        "profile_id", "code", "n_total", "n", "n_unique", "dominance", "mean", "sd", "median", "missing_pct"))


@query("A03_outlier_share", f"WITH {S.ALL_OBS},{S.OUTLIERS} SELECT {COLS}, round(outlier_pct, 6) outlier_pct FROM outl")
def a03(spark, d):
    return rounded(R.outlier_share(M.all_obs(spark, d)))


@query("A04_normality", f"WITH {S.ALL_OBS},{S.NORMALITY} SELECT {COLS}, round(skew, 6) skew, round(kurtosis, 6) kurtosis, round(jarque_bera_p, 6) jarque_bera_p FROM norm")
def a04(spark, d):
    return rounded(R.normality(M.all_obs(spark, d)))


@query("A06_pairwise_n", f"""WITH {S.ALL_OBS}, seen AS (SELECT * FROM obs WHERE value IS NOT NULL), v AS (SELECT DISTINCT profile_id, code FROM obs),
pr AS (SELECT a.profile_id, a.code a, b.code b FROM v a JOIN v b ON a.profile_id = b.profile_id AND a.code < b.code),
co AS (SELECT x.profile_id, x.code a, y.code b, count(*) n FROM seen x JOIN seen y ON x.profile_id = y.profile_id AND x.t_index = y.t_index AND x.code < y.code GROUP BY ALL),
al AS (SELECT profile_id, a, b, coalesce(n, 0) n FROM pr LEFT JOIN co USING (profile_id, a, b))
SELECT profile_id, CAST(floor(median(n)) AS BIGINT) pair_median, CAST(floor(quantile_cont(n, 0.25)) AS BIGINT) pair_q25, min(n) pair_min FROM al GROUP BY 1""")
def a06(spark, d):
    return R.pairwise_summary(R.pairwise_n(M.all_obs(spark, d)))


@query("A08_choose_corr_method", f"""WITH {S.ALL_OBS},{S.OUTLIERS},{S.NORMALITY}
SELECT profile_id, round(avg(CAST(coalesce(outlier_pct >= 0.10, false) AS INT)), 6) outlier_share, round(avg(CAST(coalesce(jarque_bera_p < 0.01, false) AS INT)), 6) nonnormal_share,
CASE WHEN avg(CAST(coalesce(outlier_pct >= 0.10, false) AS INT)) >= 0.25 OR avg(CAST(coalesce(jarque_bera_p < 0.01, false) AS INT)) >= 0.40 THEN 'spearman' ELSE 'pearson' END "method"
FROM outl LEFT JOIN norm USING (profile_id, code) GROUP BY 1""")
def a08(spark, d):
    obs = M.all_obs(spark, d)
    return rounded(R.choose_corr_method(R.outlier_share(obs).join(R.normality(obs), T.SERIES, "left")))


@query("P01_coerce_numeric", """WITH r AS (SELECT 'u' || user_id profile_id, event_type code, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN 'inf'
 WHEN event_id % 7 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END raw FROM events),
c AS (SELECT *, CASE WHEN isfinite(TRY_CAST(raw AS DOUBLE)) THEN TRY_CAST(raw AS DOUBLE) END v FROM r),
g AS (SELECT profile_id, code, count(*) n_total, count(v) n, greatest(0.0, avg(CAST(v IS NULL AS INT)) - avg(CAST(raw IS NULL AS INT))) rate, sum(v) s FROM c GROUP BY ALL)
SELECT profile_id, code, n_total, n, round(rate, 6) non_numeric_rate, round(s, 4) total FROM g WHERE rate <= 0.25""")
def p01(spark, d):
    raw = (F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), "n/a").when(F.col("event_id") % 11 == 0, "inf")
           .when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value").cast("string")))
    rows = M.table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("profile_id"), F.col("event_type").alias("code"), raw.alias("raw_value"))
    agg = R.coerce_numeric(rows).groupBy("profile_id", "code").agg(
        F.count(F.lit(1)).alias("n_total"), F.count("value").alias("n"), F.max("non_numeric_rate").alias("non_numeric_rate"), F.sum("value").alias("total"))
    return rounded(agg.withColumn("total", F.round("total", 4)))


@query("P02_infer_time_columns", """WITH x AS (SELECT event_id, event_id // 5000 ch, CAST(ts AS VARCHAR) stamp, CAST(event_id AS VARCHAR) counter, CAST(value AS VARCHAR) reading, event_type word FROM events),
u AS (UNPIVOT x ON stamp, counter, reading, word INTO NAME "column" VALUE txt),
m AS (SELECT "column", TRY_CAST(txt AS DOUBLE) v, TRY_CAST(txt AS TIMESTAMP) IS NOT NULL AND TRY_CAST(txt AS DOUBLE) IS NULL is_date,
 TRY_CAST(txt AS DOUBLE) >= lag(TRY_CAST(txt AS DOUBLE)) OVER (PARTITION BY "column", ch ORDER BY event_id) up FROM u),
g AS (SELECT "column", round(avg(CAST(is_date AS INT)), 6) date_share, round(avg(CAST(v IS NOT NULL AS INT)), 6) numeric_share, round(avg(CAST(up AS INT)), 6) non_decreasing_share FROM m GROUP BY 1)
SELECT *, CASE WHEN date_share > 0.8 THEN 'date' WHEN numeric_share > 0.95 AND non_decreasing_share >= 0.98 THEN 'index' ELSE 'none' END AS role FROM g""")
def p02(spark, d):
    rows = M.table(spark, d, "events").select(
        "event_id", F.col("ts").cast("string").alias("stamp"), F.col("event_id").cast("string").alias("counter"),
        F.col("value").cast("string").alias("reading"), F.col("event_type").alias("word"))
    return R.infer_time_columns(rows, ["stamp", "counter", "reading", "word"], "event_id", F.floor(F.col("event_id") / 5000))


@query("P03_infer_variable_type", f"""WITH {S.ALL_OBS.replace('obs AS (SELECT * FROM d_obs', 'obs0 AS (SELECT * FROM d_obs')},
obs AS (SELECT profile_id, code, t_index, ts, CASE code WHEN 'P01' THEN round(value) WHEN 'P02' THEN CAST(value > 30 AS INT) WHEN 'P03' THEN value / 1000 WHEN 'C01' THEN round(value / 100) ELSE value END AS value FROM obs0),
{S.PROFILE_STATS} SELECT {COLS}, n_unique, var_type FROM prof""")
def p03(spark, d):
    v = F.col("value")
    varied = (F.when(F.col("code") == "P01", F.round(v)).when(F.col("code") == "P02", (v > 30).cast("double"))
              .when(F.col("code") == "P03", v / 1000).when(F.col("code") == "C01", F.round(v / 100)).otherwise(v))
    obs = M.all_obs(spark, d).withColumn("value", varied)
    return R.profile_variables(obs).select("profile_id", "code", "n_unique", "var_type")


@query("P04_variable_drop_reasons", f"WITH {S.ALL_OBS},{S.VARIABLE_TABLE} SELECT {COLS}, hard_reasons, soft_reasons, drop_level FROM stats")
def p04(spark, d):
    return _stats(spark, d).select("profile_id", "code", joined("hard_reasons").alias("hard_reasons"), joined("soft_reasons").alias("soft_reasons"), "drop_level")


@query("P05_transform_suggestions", f"""WITH {S.ALL_OBS},{S.VARIABLE_TABLE} SELECT {COLS}, concat_ws('|', CASE WHEN var_type = 'count' THEN 'sqrt_or_log1p' END,
CASE WHEN var_type IN ('continuous', 'proportion') AND abs(skew) > 1.25 AND mn >= 0 THEN 'log1p' END, CASE WHEN outlier_pct >= 0.10 THEN 'winsorize_or_robust' END,
CASE WHEN zero_infl THEN 'hurdle_or_discretize' END) suggestions FROM stats""")
def p05(spark, d):
    return R.transform_suggestions(_stats(spark, d)).select("profile_id", "code", joined("suggestions").alias("suggestions"))


@query("P06_select_network_variables", f"""WITH {S.ALL_OBS},{S.PROFILE_STATS},
a AS (SELECT *, var_type IN ('continuous', 'proportion', 'count', 'binary') AND n_unique >= 3 AND coalesce(sd, 0) >= 1e-8 typed FROM prof),
b AS (SELECT *, typed AND n >= 20 AND missing_pct <= 0.65 strict, typed AND n >= greatest(8, floor(n_total / 2)) relaxed FROM a),
e AS (SELECT *, sum(CAST(strict AS INT)) OVER (PARTITION BY profile_id) >= 2 enough FROM b)
SELECT {COLS}, CASE WHEN enough THEN 'strict' ELSE 'relaxed' END "rule", CASE WHEN enough THEN strict ELSE relaxed END selected FROM e""")
def p06(spark, d):
    return R.select_network_variables(R.profile_variables(M.all_obs(spark, d))).select("profile_id", "code", "rule", "selected")


@query("P07_select_analysis_variables", f"""WITH {S.ALL_OBS},{S.VARIABLE_TABLE},{S.REGULARITY},{S.TIERS},{S.SCORE},
f AS (SELECT *, NOT bool_or(ready) OVER (PARTITION BY profile_id) fallback FROM ready)
SELECT {COLS}, fallback FROM f WHERE CASE WHEN fallback THEN coalesce(drop_level <> 'hard', true) ELSE ready END AND n >= 8""")
def p07(spark, d):
    stats, tiers = _tiers(spark, d)
    return R.select_analysis_variables(R.ready_variables(stats, tiers), F.col("ready")).select("profile_id", "code", "fallback")


@query("V02_readiness_tiers", f"""WITH {S.ALL_OBS},{S.VARIABLE_TABLE},{S.REGULARITY},{S.TIERS}
SELECT profile_id, k1, k3 AS k3_tv, q25 AS q25_tv, n_strict AS strict_tv, pair_median, pair_q25, static_ok, tv_ok, tier2_ok, tier1_ok, variant, tier FROM tiers""")
def v02(spark, d):
    return _tiers(spark, d)[1].select("profile_id", "k1", "k3_tv", "q25_tv", "strict_tv", "pair_median", "pair_q25", "static_ok", "tv_ok", "tier2_ok", "tier1_ok", "variant", "tier")


def _scored(spark, d):
    stats, tiers = _tiers(spark, d)
    return R.readiness_score(R.ready_variables(stats, tiers), tiers)


@query("C08_readiness_score", f"""WITH {S.ALL_OBS},{S.VARIABLE_TABLE},{S.REGULARITY},{S.TIERS},{S.SCORE}
SELECT profile_id, tier, variant, round(score, 4) score, label, n_ready, round(sample_score, 4) sample_score, round(missing_score, 4) missing_score, round(quality_score, 4) quality_score,
round(time_score, 4) time_score, round(assumptions_score, 4) assumptions_score, ready_variables FROM scored""")
def c08(spark, d):
    return rounded(_scored(spark, d).select(
        "profile_id", "tier", "variant", "score", "label", "n_ready", "sample_score", "missing_score", "quality_score", "time_score",
        "assumptions_score", joined("ready_variables").alias("ready_variables")), 4)


@query("C09_readiness_report")
def c09(spark, d):
    """With the stationarity tests and the collinearity rule in place; nested report as JSON."""
    from lagweave.plans.readiness import report

    return report(M.all_obs(spark, d)).select("profile_id", "label", F.round("score", 4).alias("score"), F.to_json("report").alias("report"))


@query("F13_readiness_label", f"""WITH {S.ALL_OBS},{S.VARIABLE_TABLE},{S.REGULARITY},{S.TIERS},{S.SCORE},
p AS (SELECT profile_id, label, tier, is_tv, is_static, unnest(['NotReady', 'PartiallyReady_Low', 'PartiallyReady_High', 'Ready_Low', 'Ready_High', 'FullyReady', 'Other']) proposed FROM scored),
r AS (SELECT *, coalesce(list_position(['NotReady', 'PartiallyReady_Low', 'PartiallyReady_High', 'Ready_Low', 'Ready_High', 'FullyReady'], proposed), 0) pos,
 CASE WHEN is_tv THEN 6 WHEN is_static THEN 5 WHEN tier LIKE 'Tier2%' THEN 4 WHEN tier LIKE 'Tier1%' THEN 3 ELSE 2 END cap FROM p)
SELECT profile_id, label, proposed, CASE WHEN pos = 0 THEN 'NotReady' ELSE (['NotReady', 'PartiallyReady_Low', 'PartiallyReady_High', 'Ready_Low', 'Ready_High', 'FullyReady'])[least(pos, cap)] END capped FROM r""")
def f13(spark, d):
    names = F.array(*[F.lit(x) for x in [*R.LABELS, "Other"]])
    rows = _scored(spark, d).select("profile_id", "label", "tier", "variant", F.explode(names).alias("proposed"))
    return rows.select("profile_id", "label", "proposed", R.cap_label(F.col("proposed"), F.col("tier"), F.col("variant")).alias("capped"))


@query("V01_execution_plan", f"""WITH {S.ALL_OBS},{S.VARIABLE_TABLE},{S.REGULARITY},{S.TIERS}
SELECT profile_id, CASE WHEN coalesce(variant, '') = 'TIME_VARYING_gVAR' THEN 'tier3_full_time_varying' WHEN variant IS NOT NULL THEN 'tier3_static_lagged' WHEN tier LIKE 'Tier2%' THEN 'tier2_contemporaneous'
WHEN tier LIKE 'Tier1%' THEN 'tier1_correlation_only' ELSE 'tier0_descriptives_only' END analysis_set, coalesce(variant, '') = 'TIME_VARYING_gVAR' run_time_varying, variant IS NOT NULL run_static,
tier NOT LIKE 'Tier0%' run_correlation, tier LIKE 'Tier0%' run_descriptives_only FROM tiers""")
def v01(spark, d):
    return R.execution_plan(_tiers(spark, d)[1]).drop("tier", "variant")
