"""SQL fragments shared by the checking queries."""

CODE = ("CASE event_type WHEN 'click' THEN 'P01' WHEN 'view' THEN 'P02' WHEN 'signup' THEN 'P03' "
        "WHEN 'purchase' THEN 'C01' WHEN 'error' THEN 'C02' END")
DAILY_PROFILE = "'u' || user_id"
COHORT_PROFILE = "'c' || (user_id // 20)"


def grid_sql(profile: str, step: int, prefix: str = "") -> str:
    """CTEs ending in {prefix}obs(profile_id, code, t_index, ts, value)."""
    p = prefix
    return f"""
{p}slots AS (SELECT {profile} AS profile_id, {CODE} AS code, epoch_us(ts) // {step * 1000000} AS slot,
             round(avg(value), CAST(6 AS INTEGER)) AS value FROM events GROUP BY ALL),
{p}span AS (SELECT profile_id, min(slot) s0, max(slot) s1 FROM {p}slots GROUP BY 1),
{p}vars AS (SELECT DISTINCT profile_id, code FROM {p}slots),
{p}grid AS (SELECT profile_id, code, s0, unnest(generate_series(s0, s1)) AS slot FROM {p}vars JOIN {p}span USING (profile_id)),
{p}obs AS (SELECT g.profile_id, g.code, CAST(g.slot - g.s0 AS INTEGER) AS t_index,
           make_timestamp(g.slot * {step * 1000000}) AS ts, s.value
           FROM {p}grid g LEFT JOIN {p}slots s USING (profile_id, code, slot))"""


DAILY = grid_sql(DAILY_PROFILE, 86400)
COHORT = grid_sql(COHORT_PROFILE, 21600)
ALL_OBS = (grid_sql(DAILY_PROFILE, 86400, "d_") + "," + grid_sql(COHORT_PROFILE, 21600, "c_")
           + ",\nobs AS (SELECT * FROM d_obs UNION ALL SELECT * FROM c_obs)")

PROFILE_STATS = """
freq AS (SELECT profile_id, code, value, count(*) k FROM obs GROUP BY ALL),
prof0 AS (SELECT profile_id, code, count(*) n_total, count(value) n, count(DISTINCT value) n_unique,
          avg(value) mean, stddev_samp(value) sd, median(value) median, min(value) mn, max(value) mx,
          avg(CASE WHEN value IS NOT NULL THEN CAST(abs(value) <= 1e-8 AS DOUBLE) END) zero_rate,
          avg(CASE WHEN value IS NOT NULL THEN CAST(abs(value - round_even(value, 0)) <= 1e-8 + 1e-5 * abs(round_even(value, 0)) AS DOUBLE) END) int_share,
          bool_or(value <> 0 AND value <> 1) beyond
          FROM obs GROUP BY ALL),
dom AS (SELECT profile_id, code, max(k) top FROM freq WHERE value IS NOT NULL GROUP BY ALL),
prof AS (SELECT p.*, coalesce(top / n, 1.0) dominance, 1 - n / n_total AS missing_pct,
         CASE WHEN n = 0 THEN 'unknown' WHEN n_unique <= 2 AND NOT beyond THEN 'binary'
              WHEN mn >= 0 AND mx <= 1 AND n_unique > 2 THEN 'proportion'
              WHEN int_share > 0.98 AND n_unique <= 7 THEN 'ordinal'
              WHEN int_share > 0.98 AND mn >= 0 THEN 'count' ELSE 'continuous' END var_type
         FROM prof0 p LEFT JOIN dom USING (profile_id, code))"""

OUTLIERS = """
dev AS (SELECT profile_id, code, abs(value - median(value) OVER (PARTITION BY profile_id, code)) dev FROM obs WHERE value IS NOT NULL),
madv AS (SELECT *, median(dev) OVER (PARTITION BY profile_id, code) mad FROM dev),
outl AS (SELECT profile_id, code, CASE WHEN count(*) < 8 THEN NULL WHEN max(mad) <= 1e-12 THEN 0.0
         ELSE avg(CAST(0.6745 * dev >= 4.0 * mad AS DOUBLE)) END outlier_pct FROM madv GROUP BY ALL)"""

NORMALITY = """
ctr AS (SELECT profile_id, code, value - avg(value) OVER (PARTITION BY profile_id, code) c FROM obs WHERE value IS NOT NULL),
mom AS (SELECT profile_id, code, count(*) n, avg(c*c) m2, avg(c*c*c) m3, avg(c*c*c*c) m4 FROM ctr GROUP BY ALL),
norm AS (SELECT profile_id, code, CASE WHEN n >= 8 AND m2 > 0 THEN m3 / pow(m2, 1.5) END skew,
         CASE WHEN n >= 8 AND m2 > 0 THEN m4 / (m2 * m2) - 3 END kurtosis,
         CASE WHEN n >= 8 AND m2 > 0 THEN exp(-n / 12.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4)) END jarque_bera_p FROM mom)"""

GAPS = """
runs AS (SELECT *, count(value) OVER (PARTITION BY profile_id, code ORDER BY t_index) run FROM obs),
gaps AS (SELECT profile_id, code, max(n) AS gap FROM (SELECT profile_id, code, run, count(*) n FROM runs WHERE value IS NULL GROUP BY ALL) GROUP BY ALL)"""

VARIABLE_TABLE = f"""{PROFILE_STATS},{OUTLIERS},{NORMALITY},{GAPS},
stats0 AS (SELECT p.*, outlier_pct, skew, kurtosis, jarque_bera_p, coalesce(gap, 0) AS max_consecutive_missing
           FROM prof p LEFT JOIN outl USING (profile_id, code) LEFT JOIN norm USING (profile_id, code) LEFT JOIN gaps USING (profile_id, code)),
zi AS (SELECT *, coalesce(var_type IN ('count', 'continuous') AND zero_rate >= 0.70 AND mx > 0, false) AS zero_infl,
       max_consecutive_missing >= greatest(5, floor(0.10 * n_total)) AS long_gap FROM stats0),
stats AS (SELECT *,
  concat_ws('|', CASE WHEN n = 0 THEN 'all_missing' END, CASE WHEN missing_pct >= 0.70 THEN 'missing' END,
    CASE WHEN n_unique <= 1 THEN 'no_variability' END, CASE WHEN sd <= 1e-8 THEN 'near_constant' END) AS hard_reasons,
  concat_ws('|', CASE WHEN missing_pct >= 0.40 AND missing_pct < 0.70 THEN 'missing' END,
    CASE WHEN n_unique <= 2 AND n_unique > 1 THEN 'low_variability' END, CASE WHEN dominance >= 0.92 AND n_unique >= 2 THEN 'dominant_value' END,
    CASE WHEN var_type = 'binary' AND least(mean, 1 - mean) < 0.05 THEN 'rare_event' END,
    CASE WHEN outlier_pct >= 0.35 THEN 'outliers_extreme' END, CASE WHEN outlier_pct >= 0.20 AND outlier_pct < 0.35 THEN 'outliers' END,
    CASE WHEN long_gap THEN 'long_gap' END, CASE WHEN zero_infl THEN 'zero_inflation' END) AS soft_reasons,
  CASE WHEN hard_reasons <> '' THEN 'hard' WHEN soft_reasons <> '' THEN 'soft' END AS drop_level FROM zi)"""

REGULARITY = """
times AS (SELECT DISTINCT profile_id, ts FROM obs WHERE value IS NOT NULL),
steps AS (SELECT profile_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY profile_id ORDER BY ts)) step FROM times),
stepn AS (SELECT profile_id, round(step / 1e7) * 10 AS rounded, count(*) n, count(*) FILTER (step = 0) dups FROM steps WHERE step IS NOT NULL GROUP BY ALL),
reg0 AS (SELECT profile_id, CAST(sum(n) + 1 AS BIGINT) n_points, arg_max(rounded, (n, -rounded)) modal_step, 1 - max(n) / sum(n) irr, sum(dups) / (sum(n) + 1) dup FROM stepn GROUP BY 1),
reg AS (SELECT profile_id, n_points, CASE WHEN n_points >= 5 THEN modal_step END modal_step,
        CASE WHEN n_points >= 5 THEN irr END irregular_fraction, CASE WHEN n_points >= 5 THEN dup END duplicate_fraction,
        CASE WHEN n_points < 5 THEN NULL WHEN irr <= 0.15 THEN 'regular_or_quasi_regular' WHEN irr <= 0.35 THEN 'moderately_irregular' ELSE 'highly_irregular' END regularity FROM reg0)"""

TIERS = """
kept AS (SELECT * FROM stats WHERE drop_level IS NULL OR drop_level <> 'hard'),
t1 AS (SELECT profile_id, code, var_type FROM kept WHERE n >= 10 AND n_unique >= 2),
t3 AS (SELECT * FROM t1 WHERE var_type IN ('continuous', 'count', 'proportion', 'ordinal')),
pres AS (SELECT profile_id, code, t_index, value IS NOT NULL AS now,
         coalesce(lag(value IS NOT NULL) OVER (PARTITION BY profile_id, code ORDER BY t_index), false) AS before
         FROM obs JOIN t3 USING (profile_id, code)),
effv AS (SELECT profile_id, code, sum(CAST(now AND before AS INT)) ne FROM pres GROUP BY ALL),
eff AS (SELECT profile_id, CAST(floor(quantile_cont(ne, 0.25)) AS BIGINT) q25 FROM effv GROUP BY 1),
strict AS (SELECT profile_id, CAST(sum(CAST(ok AS INT)) AS BIGINT) n_strict FROM (SELECT profile_id, t_index, bool_and(now AND before) ok FROM pres GROUP BY ALL) GROUP BY 1),
seen1 AS (SELECT profile_id, code, t_index FROM obs JOIN t1 USING (profile_id, code) WHERE value IS NOT NULL),
pairs AS (SELECT a.profile_id, a.code a, b.code b, (SELECT count(*) FROM seen1 x JOIN seen1 y USING (profile_id, t_index)
          WHERE x.profile_id = a.profile_id AND x.code = a.code AND y.code = b.code) n
          FROM t1 a JOIN t1 b ON a.profile_id = b.profile_id AND a.code < b.code),
psum AS (SELECT profile_id, CAST(floor(median(n)) AS BIGINT) pair_median, CAST(floor(quantile_cont(n, 0.25)) AS BIGINT) pair_q25, min(n) pair_min FROM pairs GROUP BY 1),
base0 AS (SELECT DISTINCT profile_id FROM stats),
tier0 AS (SELECT profile_id, coalesce(k1, 0) k1, coalesce(k3, 0) k3, coalesce(q25, 0) q25, coalesce(n_strict, 0) n_strict,
          pair_median, pair_q25, pair_min, regularity, irregular_fraction, duplicate_fraction,
          greatest(50 + 8 * greatest(0, coalesce(k3, 0) - 1), 35) req_static,
          greatest(60, 3 * greatest(30, 6 * greatest(1, coalesce(k3, 0)))) req_tv,
          coalesce(regularity, '') <> 'highly_irregular' AND coalesce(duplicate_fraction, 0) < 0.10 AS time_ok
          FROM base0 LEFT JOIN (SELECT profile_id, count(*) k1 FROM t1 GROUP BY 1) USING (profile_id)
          LEFT JOIN (SELECT profile_id, count(*) k3 FROM t3 GROUP BY 1) USING (profile_id)
          LEFT JOIN eff USING (profile_id) LEFT JOIN strict USING (profile_id) LEFT JOIN psum USING (profile_id) LEFT JOIN reg USING (profile_id)),
tier1 AS (SELECT *, k3 >= 3 AND time_ok AND q25 >= req_static AND k3 <= floor(0.12 * greatest(1, q25)) static_ok,
          k3 >= 3 AND time_ok AND q25 >= req_tv AND k3 <= floor(0.08 * greatest(1, q25)) tv_ok,
          k1 >= 3 AND coalesce(pair_median, -1) >= 25 AND coalesce(pair_q25, -1) >= 20 AND k1 <= floor(0.25 * greatest(1, coalesce(pair_median, -1))) tier2_ok,
          k1 >= 2 AND coalesce(pair_median, -1) >= 12 AND coalesce(pair_q25, -1) >= 10 tier1_ok FROM tier0),
tiers AS (SELECT *, CASE WHEN tv_ok THEN 'TIME_VARYING_gVAR' WHEN static_ok THEN 'STATIC_gVAR' END variant,
          CASE WHEN tv_ok OR static_ok THEN 'Tier3_LaggedDynamicNetwork' WHEN tier2_ok THEN 'Tier2_ContemporaneousPartialCorrelation'
               WHEN tier1_ok THEN 'Tier1_CorrelationMatrix' ELSE 'Tier0_DescriptivesOnly' END tier FROM tier1)"""

SCORE = """
ready AS (SELECT s.*, tier, variant,
  CASE WHEN tier LIKE 'Tier3%' THEN coalesce(drop_level <> 'hard', true) AND n >= 10 AND n_unique >= 2 AND var_type IN ('continuous', 'count', 'proportion', 'ordinal')
       WHEN tier LIKE 'Tier2%' OR tier LIKE 'Tier1%' THEN coalesce(drop_level <> 'hard', true) AND n >= 10 AND n_unique >= 2 ELSE false END AS ready
  FROM stats s JOIN tiers USING (profile_id)),
basis AS (SELECT *, CASE WHEN bool_or(ready) OVER (PARTITION BY profile_id) THEN ready ELSE coalesce(drop_level <> 'hard', true) END in_base,
  least(100, greatest(0, 100 - CASE WHEN dominance >= 0.95 THEN 30 WHEN dominance >= 0.92 THEN 15 ELSE 0 END - CASE WHEN outlier_pct IS NULL THEN 0 ELSE least(35, 100 * outlier_pct) END
   - CASE WHEN n_unique <= 2 THEN 20 ELSE 0 END - CASE WHEN long_gap THEN 10 ELSE 0 END - CASE WHEN zero_infl THEN 8 ELSE 0 END)) quality FROM ready),
agg AS (SELECT profile_id, count(*) n_candidates, CAST(sum(CAST(ready AS INT)) AS BIGINT) n_ready, CAST(sum(CAST(in_base AS INT)) AS BIGINT) n_base,
  coalesce(avg(missing_pct) FILTER (in_base), 1.0) mean_missing, coalesce(avg(quality) FILTER (in_base), 0.0) quality_score,
  coalesce(string_agg(code, '|' ORDER BY code) FILTER (ready), '') ready_variables FROM basis GROUP BY 1),
s0 AS (SELECT *, tier LIKE 'Tier3%' AND variant = 'TIME_VARYING_gVAR' is_tv, tier LIKE 'Tier3%' AND variant = 'STATIC_gVAR' is_static FROM agg JOIN tiers USING (profile_id)),
s1 AS (SELECT *, CASE WHEN is_tv OR is_static THEN q25 ELSE coalesce(pair_median, 0) END n_ref,
  CASE WHEN is_tv THEN req_tv WHEN is_static THEN req_static WHEN tier LIKE 'Tier2%' THEN 25 WHEN tier LIKE 'Tier1%' THEN 12 ELSE 20 END n_req,
  coalesce(duplicate_fraction, 0) dup, coalesce(irregular_fraction, 0.20) irr,
  CAST(CASE WHEN is_static THEN 0.65 WHEN is_tv THEN 0.20 ELSE 0.10 END AS DOUBLE) st_w FROM s0),
s2 AS (SELECT *, greatest(0.20, least(0.75, 0.80 - st_w)) col_w FROM s1),
s3 AS (SELECT *, 100 * least(1.0, n_ref / greatest(1.0, n_req)) sample_score, CASE WHEN n_base > 0 THEN 100 * (1 - mean_missing) ELSE 0 END missing_score,
  100 * greatest(0.0, 1 - irr / 0.80) time_score,
  100 * (st_w * 0.7 + CASE WHEN 1 - st_w - col_w < 0.05 THEN 1 - st_w - 0.05 ELSE col_w END
    + CASE WHEN 1 - st_w - col_w < 0.05 THEN 0.05 ELSE 1 - st_w - col_w END * (1 - CASE WHEN dup >= 0.10 THEN 0.35 WHEN dup >= 0.02 THEN 0.15 ELSE 0 END)) assumptions_score FROM s2),
s4 AS (SELECT *, least(100, greatest(0, 0.30 * sample_score + 0.25 * missing_score + 0.25 * quality_score + 0.10 * time_score + 0.10 * assumptions_score
  - CASE WHEN tier LIKE 'Tier3%' THEN CASE regularity WHEN 'moderately_irregular' THEN 5 WHEN 'highly_irregular' THEN 12 ELSE 0 END + CASE WHEN dup >= 0.02 THEN 4 ELSE 0 END ELSE 0 END)) score FROM s3),
scored AS (SELECT *, (['NotReady', 'PartiallyReady_Low', 'PartiallyReady_High', 'Ready_Low', 'Ready_High', 'FullyReady'])[1 + least(
  CASE WHEN score < 20 THEN 0 WHEN score < 40 THEN 1 WHEN score < 60 THEN 2 WHEN score < 75 THEN 3 WHEN score < 90 THEN 4 ELSE 5 END,
  CASE WHEN is_tv THEN 5 WHEN is_static THEN 4 WHEN tier LIKE 'Tier2%' THEN 3 WHEN tier LIKE 'Tier1%' THEN 2 ELSE 1 END)] AS label FROM s4)"""


def chi2_tail_sql(x: str, df: str, terms: int = 300) -> str:
    """Upper chi-square tail by the ascending series in log space."""
    return (f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0, 1 - list_sum(list_transform(range(0, {terms}), lambda i_: "
            f"exp((({df}) / 2.0 + i_) * ln(greatest(({x}) / 2.0, 1e-300)) - ({x}) / 2.0 - lgamma(({df}) / 2.0 + i_ + 1))))) END")


def norm_tail_sql(z: str) -> str:
    return chi2_tail_sql(f"({z}) * ({z})", "1")


def _beta_series(a: str, b: str, x: str, terms: int) -> str:
    return (f"exp(({a}) * ln({x}) + ({b}) * ln(1 - ({x})) + lgamma(({a}) + ({b})) - lgamma(({a}) + 1) - lgamma({b})) * (1 + list_sum(list_transform(range(0, {terms}), "
            f"lambda i_: exp(lgamma(({a}) + ({b}) + i_ + 1) - lgamma(({a}) + ({b})) - lgamma(({a}) + i_ + 2) + lgamma(({a}) + 1) + (i_ + 1) * ln({x})))))")


def beta_sql(a: str, b: str, x: str, terms: int = 1500) -> str:
    """Regularized incomplete beta by its ascending series on the faster side."""
    low, high = f"least(greatest({x}, 1e-300), 1 - 1e-15)", f"least(greatest(1 - ({x}), 1e-300), 1 - 1e-15)"
    return (f"CASE WHEN ({x}) < (({a}) + 1) / (({a}) + ({b}) + 2) THEN {_beta_series(a, b, low, terms)} "
            f"ELSE 1 - {_beta_series(b, a, high, terms)} END")


def t_tail_sql(t: str, df: str) -> str:
    return beta_sql(f"({df}) / 2.0", "0.5", f"({df}) / (({df}) + ({t}) * ({t}))")


def f_tail_sql(f: str, d1: str, d2: str) -> str:
    return beta_sql(f"({d2}) / 2.0", f"({d1}) / 2.0", f"({d2}) / (({d2}) + ({d1}) * ({f}))")


SUMMARY_COLS = """round(avg(value), 6) mean, round(stddev_samp(value), 6) sd, round(median(value), 6) median, round(min(value), 6) "min", round(max(value), 6) "max",
round(CASE WHEN count(value) >= 4 THEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) ELSE max(value) - min(value) END, 6) iqr, round(mad(value), 6) mad"""
