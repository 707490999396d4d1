"""Data quality of variables and profiles, analysis tiers, readiness score and report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lagweave.operators.series import by_series, SERIES, longest_gap


@dataclass(frozen=True)
class Limits:
    """Thresholds of the quality rules and tiers."""

    hard_missing: float = 0.70
    soft_missing: float = 0.40
    hard_unique: int = 1
    soft_unique: int = 2
    flat_sd: float = 1e-8
    dominance: float = 0.92
    rare_binary: float = 0.05
    outlier_z: float = 4.0
    outlier_soft: float = 0.20
    outlier_hard: float = 0.35
    zero_rate: float = 0.70
    dup_soft: float = 0.02
    dup_hard: float = 0.10
    high_corr: float = 0.95
    static_base: int = 50
    static_per_var: int = 8
    static_floor: int = 35
    static_ratio: float = 0.12
    tv_floor: int = 60
    tv_windows: int = 3
    tv_window: int = 30
    tv_per_var: int = 6
    tv_ratio: float = 0.08
    tier2_q25: int = 20
    tier2_median: int = 25
    tier2_ratio: float = 0.25
    tier1_q25: int = 10
    tier1_median: int = 12
    weights: dict = field(default_factory=lambda: {
        "sample": 0.30, "missing": 0.25, "quality": 0.25, "time": 0.10, "assumptions": 0.10})


LIMITS = Limits()
TIER3, TIER2 = "Tier3_LaggedDynamicNetwork", "Tier2_ContemporaneousPartialCorrelation"
TIER1, TIER0 = "Tier1_CorrelationMatrix", "Tier0_DescriptivesOnly"
TV, STATIC = "TIME_VARYING_gVAR", "STATIC_gVAR"
LABELS = ["NotReady", "PartiallyReady_Low", "PartiallyReady_High", "Ready_Low", "Ready_High", "FullyReady"]


def coerce_numeric(raw: DataFrame, max_lost: float = 0.25) -> DataFrame:
    """Text values to finite doubles; variables with more than `max_lost` newly null rows are dropped."""
    from lagweave.functions.scores import finite

    values = raw.withColumn("value", finite(F.col("raw_value")))
    null_rate = lambda c: F.avg(F.col(c).isNull().cast("double"))
    rates = values.groupBy(*SERIES).agg(F.greatest(F.lit(0.0), null_rate("value") - null_rate("raw_value")).alias("non_numeric_rate"))
    return values.join(rates.where(F.col("non_numeric_rate") <= max_lost), SERIES)


def infer_time_columns(rows: DataFrame, columns: list[str], order: str, chunk: Column) -> DataFrame:
    """Per text column: share that parses as a date, share numeric, share of non-decreasing steps, and the role.

    Steps are compared inside chunks of the input order, so no task sees the whole table.
    """
    stacked = rows.select(chunk.alias("chunk"), order, *columns).unpivot(["chunk", order], columns, "column", "text")
    num = F.col("text").try_cast("double")
    steps = num >= F.lag(num).over(W.partitionBy("column", "chunk").orderBy(order))
    measured = stacked.withColumn("is_num", num.isNotNull()).withColumn(
        "is_date", F.col("text").try_cast("timestamp").isNotNull() & num.isNull()).withColumn("up", steps)
    share = lambda c: F.round(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")), 6)
    out = measured.groupBy("column").agg(
        share("is_date").alias("date_share"), share("is_num").alias("numeric_share"),
        F.round(F.avg(F.col("up").cast("double")), 6).alias("non_decreasing_share"))
    # Names taken as time columns before anything is measured.
    named_date, named_index = ["date", "datetime", "timestamp", "time", "ts"], ["t_index", "t", "day", "idx_time"]
    role = (F.when(F.lower("column").isin(named_date), "date").when(F.lower("column").isin(named_index), "index")
            .when(F.col("date_share") > 0.80, "date")
            .when((F.col("numeric_share") > 0.95) & (F.col("non_decreasing_share") >= 0.98), "index").otherwise("none"))
    return out.withColumn("role", role)


def profile_variables(obs: DataFrame) -> DataFrame:
    """Counts, distinct values, dominance, moments, median and inferred type per series.

    Equal values are counted first, so every statistic is a weighted aggregate over distinct values.
    """
    freq = obs.groupBy(*SERIES, "value").agg(F.count(F.lit(1)).alias("k"))
    v, seen = F.col("value"), F.when(F.col("value").isNotNull(), F.col("k"))
    n = F.sum(seen)
    close_to_int = F.abs(v - F.rint(v)) <= 1e-8 + 1e-5 * F.abs(F.rint(v))
    out = freq.groupBy(*SERIES).agg(
        F.sum("k").alias("n_total"), F.coalesce(n, F.lit(0)).alias("n"), F.count("value").alias("n_unique"),
        F.coalesce(F.max(seen) / n, F.lit(1.0)).alias("dominance"),
        (F.sum(v * F.col("k")) / n).alias("mean"),
        F.when(n >= 2, F.sqrt(F.greatest(F.lit(0.0), (F.sum(v * v * F.col("k")) - F.pow(F.sum(v * F.col("k")), 2) / n) / (n - 1)))).alias("sd"),
        F.percentile("value", 0.5, F.col("k")).alias("median"), F.min("value").alias("min"), F.max("value").alias("max"),
        (F.sum(F.when(F.abs(v) <= 1e-8, F.col("k")).otherwise(0)) / n).alias("zero_rate"),
        (F.sum(F.when(close_to_int, F.col("k")).otherwise(0)) / n).alias("int_share"),
        F.max(F.when((v != 0) & (v != 1), 1).otherwise(0)).alias("_beyond_01"))
    return (out.withColumn("missing_pct", 1 - F.col("n") / F.col("n_total"))
            .withColumn("var_type", infer_type()).drop("_beyond_01", "int_share"))


def infer_type() -> Column:
    """Ladder over columns n, n_unique, min, max, int_share and the flag for values other than 0 and 1."""
    return (
        F.when(F.col("n") == 0, "unknown")
        .when((F.col("n_unique") <= 2) & (F.col("_beyond_01") == 0), "binary")
        .when((F.col("min") >= 0) & (F.col("max") <= 1) & (F.col("n_unique") > 2), "proportion")
        .when((F.col("int_share") > 0.98) & (F.col("n_unique") <= 7), "ordinal")
        .when((F.col("int_share") > 0.98) & (F.col("min") >= 0), "count")
        .otherwise("continuous"))


def outlier_share(obs: DataFrame, z: float = LIMITS.outlier_z) -> DataFrame:
    """Share with |0.6745 (x - median) / MAD| >= z; null under 8 values, 0 for a flat series."""
    dev = obs.where(F.col("value").isNotNull()).withColumn("dev", F.abs(F.col("value") - F.percentile("value", 0.5).over(by_series())))
    scaled = dev.withColumn("mad", F.percentile("dev", 0.5).over(by_series()))
    out = scaled.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n"), F.max("mad").alias("mad"),
        F.avg((0.6745 * F.col("dev") >= z * F.col("mad")).cast("double")).alias("share"))
    return out.select(*SERIES, F.when(F.col("n") < 8, None).when(F.col("mad") <= 1e-12, 0.0).otherwise(F.col("share")).alias("outlier_pct"))


def normality(obs: DataFrame) -> DataFrame:
    """Population skew, Fisher kurtosis and the Jarque-Bera p (two degrees of freedom: exp(-JB / 2)); n >= 8."""
    m = obs.groupBy(*SERIES).agg(
        F.count("value").alias("n"), F.skewness("value").alias("s"), F.kurtosis("value").alias("k"))
    jb = F.col("n") / 6 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4)
    ok = (F.col("n") >= 8) & F.col("s").isNotNull() & ~F.isnan("s")
    return m.select(*SERIES, F.when(ok, F.col("s")).alias("skew"), F.when(ok, F.col("k")).alias("kurtosis"),
                    F.when(ok, F.exp(-jb / 2)).alias("jarque_bera_p"))


def variable_table(obs: DataFrame, stationarity: DataFrame | None = None) -> DataFrame:
    """All per-series diagnostics side by side."""
    out = profile_variables(obs)
    for part in (outlier_share(obs), normality(obs), longest_gap(obs)):
        out = out.join(part, SERIES, "left")
    if stationarity is None:
        return out.withColumn("stationary", F.lit(None).cast("boolean"))
    return out.join(stationarity.select(*SERIES, "stationary"), SERIES, "left")


def _zero_inflated() -> Column:
    return F.col("var_type").isin("count", "continuous") & (F.coalesce("zero_rate", F.lit(0.0)) >= LIMITS.zero_rate) & (F.col("max") > 0)


def _long_gap() -> Column:
    return F.col("max_consecutive_missing") >= F.greatest(F.lit(5), F.floor(0.10 * F.col("n_total")))


def _reasons(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in rules.items()]))


def variable_drop_reasons(stats: DataFrame) -> DataFrame:
    """Reason lists and the drop level (hard, soft or null) per series."""
    L, c = LIMITS, F.col
    rare = F.least(c("mean"), 1 - c("mean")) < L.rare_binary
    hard = _reasons({
        "all_missing": c("n") == 0,
        "missing": c("missing_pct") >= L.hard_missing,
        "no_variability": c("n_unique") <= L.hard_unique,
        "near_constant": c("sd") <= L.flat_sd,
    })
    soft = _reasons({
        "missing": (c("missing_pct") >= L.soft_missing) & (c("missing_pct") < L.hard_missing),
        "low_variability": (c("n_unique") <= L.soft_unique) & (c("n_unique") > L.hard_unique),
        "dominant_value": (c("dominance") >= L.dominance) & (c("n_unique") >= 2),
        "rare_event": (c("var_type") == "binary") & rare,
        "outliers_extreme": c("outlier_pct") >= L.outlier_hard,
        "outliers": (c("outlier_pct") >= L.outlier_soft) & (c("outlier_pct") < L.outlier_hard),
        "non_stationary": ~c("stationary"),
        "long_gap": _long_gap(),
        "zero_inflation": _zero_inflated(),
    })
    return stats.withColumn("hard_reasons", hard).withColumn("soft_reasons", soft).withColumn(
        "drop_level", F.when(F.size("hard_reasons") > 0, "hard").when(F.size("soft_reasons") > 0, "soft"))


def transform_suggestions(stats: DataFrame) -> DataFrame:
    c = F.col
    return stats.withColumn("suggestions", _reasons({
        "sqrt_or_log1p": c("var_type") == "count",
        "log1p": c("var_type").isin("continuous", "proportion") & (F.abs("skew") > 1.25) & (c("min") >= 0),
        "winsorize_or_robust": c("outlier_pct") >= 0.10,
        "detrend_or_difference": ~c("stationary"),
        "hurdle_or_discretize": _zero_inflated(),
    }))


def select_network_variables(stats: DataFrame, allowed: tuple[str, ...] = ("continuous", "proportion", "count", "binary")) -> DataFrame:
    """Type allow-list, >= 20 values, <= 65 % missing, >= 3 distinct, sd >= 1e-8; if fewer than two remain in a
    profile, the count rule is relaxed to max(8, n_total / 2) and the missing rule is lifted."""
    c = F.col
    typed = c("var_type").isin(*allowed) & (c("n_unique") >= 3) & (F.coalesce("sd", F.lit(0.0)) >= 1e-8)
    strict = typed & (c("n") >= 20) & (c("missing_pct") <= 0.65)
    relaxed = typed & (c("n") >= F.greatest(F.lit(8), F.floor(c("n_total") / 2)))
    enough = F.sum(strict.cast("int")).over(W.partitionBy("profile_id")) >= 2
    return stats.withColumn("rule", F.when(enough, "strict").otherwise("relaxed")).withColumn(
        "selected", F.when(enough, strict).otherwise(relaxed))


def select_analysis_variables(stats: DataFrame, ready: Column | None = None, min_n: int = 8) -> DataFrame:
    """Preferred set if a profile has one, else everything that is not hard-dropped; then n >= min_n."""
    not_hard = ~F.coalesce(F.col("drop_level") == "hard", F.lit(False))
    wanted = not_hard if ready is None else F.coalesce(ready, F.lit(False))
    any_wanted = F.max(wanted.cast("int")).over(W.partitionBy("profile_id")) == 1
    marked = stats.withColumn("fallback", ~any_wanted)
    return marked.where(F.when(F.col("fallback"), not_hard).otherwise(wanted) & (F.col("n") >= min_n))


def pairwise_n(obs: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Slots where both variables of a pair have a value; pairs of one profile's own variables."""
    seen = obs.where(F.col("value").isNotNull()).select("profile_id", "t_index", "code")
    own = kept.select(*SERIES) if kept is not None else obs.select(*SERIES).distinct()
    if kept is not None:
        seen = seen.join(own, SERIES)
    a, b = seen.withColumnRenamed("code", "a"), seen.withColumnRenamed("code", "b")
    both = a.join(b, ["profile_id", "t_index"]).where(F.col("a") < F.col("b")).groupBy("profile_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    every = own.withColumnRenamed("code", "a").join(own.withColumnRenamed("code", "b"), "profile_id").where(F.col("a") < F.col("b"))
    return every.join(both, ["profile_id", "a", "b"], "left").fillna(0, ["n"])


def pairwise_summary(pairs: DataFrame) -> DataFrame:
    q = lambda p: F.floor(F.percentile("n", p))
    return pairs.groupBy("profile_id").agg(q(0.5).alias("pair_median"), q(0.25).alias("pair_q25"), F.min("n").alias("pair_min"))


def choose_corr_method(stats: DataFrame) -> DataFrame:
    share = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("double"))
    return stats.groupBy("profile_id").agg(
        share(F.col("outlier_pct") >= 0.10).alias("outlier_share"), share(F.col("jarque_bera_p") < 0.01).alias("nonnormal_share")
    ).withColumn("method", F.when((F.col("outlier_share") >= 0.25) | (F.col("nonnormal_share") >= 0.40), "spearman").otherwise("pearson"))


def readiness_tiers(obs: DataFrame, stats: DataFrame, regularity: DataFrame, collinear: DataFrame | None = None,
                    lag: int = 1, prefer_time_varying: bool = True) -> DataFrame:
    """One row per profile: candidate counts, feasibility of each tier, recommended tier and variant."""
    from lagweave.operators.series import effective_n

    L, c = LIMITS, F.col
    kept = stats.where(~F.coalesce(c("drop_level") == "hard", F.lit(False)))
    tier1 = kept.where((c("n") >= L.tier1_q25) & (c("n_unique") >= 2)).select(*SERIES, "var_type", "stationary")
    tier2 = tier1 if collinear is None else tier1.join(collinear.select(*SERIES), SERIES, "left_anti")
    base = tier2.where(c("var_type").isin("continuous", "count", "proportion", "ordinal"))
    static = base.where(F.coalesce("stationary", F.lit(True)))
    count = lambda df, name: df.groupBy("profile_id").agg(F.count(F.lit(1)).alias(name))

    def eff(kept_vars: DataFrame, suffix: str) -> DataFrame:
        sub = obs.join(kept_vars.select(*SERIES), SERIES, "left_semi")
        return effective_n(sub, lag).select("profile_id", c("n_eff_q25").alias(f"q25_{suffix}"), c("n_eff_strict").alias(f"strict_{suffix}"))

    out = stats.select("profile_id").distinct()
    for part in (count(tier1, "k1"), count(tier2, "k2"), count(static, "k3_static"), count(base, "k3_tv"),
                 eff(static, "static"), eff(base, "tv"), pairwise_summary(pairwise_n(obs, tier1)),
                 regularity.select("profile_id", "regularity", "irregular_fraction", "duplicate_fraction")):
        out = out.join(part, "profile_id", "left")
    out = out.fillna(0, ["k1", "k2", "k3_static", "k3_tv", "q25_static", "q25_tv", "strict_static", "strict_tv"])
    dup = F.coalesce("duplicate_fraction", F.lit(0.0))
    time_ok = (F.coalesce("regularity", F.lit("")) != "highly_irregular") & (dup < L.dup_hard)
    req_static = F.greatest(L.static_base + L.static_per_var * F.greatest(F.lit(0), c("k3_static") - 1), F.lit(L.static_floor))
    window = F.greatest(F.lit(L.tv_window), L.tv_per_var * F.greatest(F.lit(1), c("k3_tv")))
    req_tv = F.greatest(F.lit(L.tv_floor), L.tv_windows * window)
    at_most = lambda k, ratio, n: c(k) <= F.floor(ratio * F.greatest(F.lit(1), n))
    med, q25 = F.coalesce("pair_median", F.lit(-1)), F.coalesce("pair_q25", F.lit(-1))
    flags = {
        "static_ok": (c("k3_static") >= 3) & time_ok & (c("q25_static") >= req_static) & at_most("k3_static", L.static_ratio, c("q25_static")),
        "tv_ok": (c("k3_tv") >= 3) & time_ok & (c("q25_tv") >= req_tv) & at_most("k3_tv", L.tv_ratio, c("q25_tv")),
        "tier2_ok": (c("k2") >= 3) & (med >= L.tier2_median) & (q25 >= L.tier2_q25) & at_most("k2", L.tier2_ratio, med),
        "tier1_ok": (c("k1") >= 2) & (med >= L.tier1_median) & (q25 >= L.tier1_q25),
    }
    for name, expr in {"required_static": req_static, "required_tv": req_tv, **flags}.items():
        out = out.withColumn(name, expr)
    tv_first = c("tv_ok") if prefer_time_varying else F.lit(False)
    variant = F.when(tv_first, TV).when(c("static_ok"), STATIC).when(c("tv_ok"), TV)
    out = out.withColumn("variant", variant)
    return out.withColumn("tier", F.when(c("variant").isNotNull(), TIER3).when(c("tier2_ok"), TIER2).when(c("tier1_ok"), TIER1).otherwise(TIER0))


def ready_variables(stats: DataFrame, tiers: DataFrame, collinear: DataFrame | None = None) -> DataFrame:
    """Series with the flag `ready` under their profile's tier."""
    c = F.col
    joined = stats.join(tiers.select("profile_id", "tier", "variant"), "profile_id")
    if collinear is None:
        joined = joined.withColumn("collinear", F.lit(False))
    else:
        joined = joined.join(collinear.select(*SERIES).withColumn("collinear", F.lit(True)), SERIES, "left").fillna(False, ["collinear"])
    in1 = ~F.coalesce(c("drop_level") == "hard", F.lit(False)) & (c("n") >= LIMITS.tier1_q25) & (c("n_unique") >= 2)
    in3 = in1 & ~c("collinear") & c("var_type").isin("continuous", "count", "proportion", "ordinal")
    ready = (F.when((c("tier") == TIER3) & (c("variant") == TV), in3)
             .when(c("tier") == TIER3, in3 & F.coalesce("stationary", F.lit(True)))
             .when(c("tier") == TIER2, in1 & ~c("collinear")).when(c("tier") == TIER1, in1).otherwise(F.lit(False)))
    return joined.withColumn("ready", ready)


def quality_score() -> Column:
    c = F.col
    score = (
        F.lit(100.0) - F.when(c("dominance") >= 0.95, 30.0).when(c("dominance") >= LIMITS.dominance, 15.0).otherwise(0.0)
        - F.when(c("outlier_pct").isNull(), 0.0).otherwise(F.least(F.lit(35.0), 100 * c("outlier_pct")))
        - F.when(c("n_unique") <= 2, 20.0).otherwise(0.0) - F.when(_long_gap(), 10.0).otherwise(0.0)
        - F.when(F.coalesce(_zero_inflated(), F.lit(False)), 8.0).otherwise(0.0))
    return _clip(score)


def _clip(c: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), c))


def readiness_score(ready: DataFrame, tiers: DataFrame, high_pairs: DataFrame | None = None) -> DataFrame:
    """Five component scores, tier penalties, final score and capped label per profile.

    `high_pairs(profile_id, n_high)` counts highly correlated pairs. Base set: the ready variables, or all that
    are not hard-dropped when there are none.
    """
    c, L = F.col, LIMITS
    by_profile = W.partitionBy("profile_id")
    any_ready = F.max(c("ready").cast("int")).over(by_profile) == 1
    kept = ~F.coalesce(c("drop_level") == "hard", F.lit(False))
    base = ready.withColumn("in_base", F.when(any_ready, c("ready")).otherwise(kept)).withColumn("quality", quality_score())
    of_base = lambda x: F.avg(F.when(c("in_base"), x))
    agg = base.groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.sum(c("ready").cast("int")).alias("n_ready"),
        F.sum(c("in_base").cast("int")).alias("n_base"), F.coalesce(of_base(c("missing_pct")), F.lit(1.0)).alias("mean_missing"),
        F.coalesce(of_base(c("quality")), F.lit(0.0)).alias("quality_score"),
        F.coalesce(of_base(c("stationary").cast("double")), F.lit(0.7)).alias("stationary_share"),
        F.sum(F.coalesce(c("drop_level") == "hard", F.lit(False)).cast("int")).alias("n_hard"),
        F.sum(F.coalesce(c("drop_level") == "soft", F.lit(False)).cast("int")).alias("n_soft"),
        F.array_sort(F.collect_list(F.when(c("ready"), c("code")))).alias("ready_variables"))
    out = agg.join(tiers, "profile_id")
    out = out.withColumn("n_high", F.lit(0)) if high_pairs is None else out.join(high_pairs, "profile_id", "left").fillna(0, ["n_high"])
    is_tv, is_static = (c("tier") == TIER3) & (c("variant") == TV), (c("tier") == TIER3) & (c("variant") == STATIC)
    med = F.coalesce(c("pair_median"), F.lit(0))
    n_ref = F.when(is_tv, c("q25_tv")).when(is_static, c("q25_static")).otherwise(med)
    n_req = (F.when(is_tv, c("required_tv")).when(is_static, c("required_static"))
             .when(c("tier") == TIER2, L.tier2_median).when(c("tier") == TIER1, L.tier1_median).otherwise(20))
    dup, irr = F.coalesce("duplicate_fraction", F.lit(0.0)), F.coalesce("irregular_fraction", F.lit(0.20))
    st_w = F.when(is_static, 0.65).when(is_tv, 0.20).otherwise(0.10)
    col_w = F.greatest(F.lit(0.20), F.least(F.lit(0.75), 0.80 - st_w))
    short = 1 - st_w - col_w < 0.05
    dup_w = F.when(short, 0.05).otherwise(1 - st_w - col_w)
    col_w = F.when(short, 1 - st_w - 0.05).otherwise(col_w)
    pairs = c("n_base") * (c("n_base") - 1) / 2
    corr_rate = F.when(c("n_base") >= 2, F.least(F.lit(1.0), c("n_high") / F.greatest(F.lit(1.0), pairs))).otherwise(0.0)
    dup_pen = F.when(dup >= L.dup_hard, 0.35).when(dup >= L.dup_soft, 0.15).otherwise(0.0)
    parts = {
        "sample_score": 100 * F.least(F.lit(1.0), n_ref / F.greatest(F.lit(1.0), n_req)),
        "missing_score": F.when(c("n_base") > 0, 100 * (1 - c("mean_missing"))).otherwise(0.0),
        "time_score": 100 * F.greatest(F.lit(0.0), 1 - irr / 0.80),
        "assumptions_score": _clip(100 * (st_w * c("stationary_share") + col_w * (1 - corr_rate) + dup_w * (1 - dup_pen))),
    }
    for name, expr in parts.items():
        out = out.withColumn(name, expr)
    w = L.weights
    raw = _clip(w["sample"] * c("sample_score") + w["missing"] * c("missing_score") + w["quality"] * c("quality_score")
                + w["time"] * c("time_score") + w["assumptions"] * c("assumptions_score"))
    penalty = F.when(c("tier") == TIER3, (
        F.when(c("regularity") == "moderately_irregular", 5.0).when(c("regularity") == "highly_irregular", 12.0).otherwise(0.0)
        + F.when(dup >= L.dup_soft, 4.0).otherwise(0.0))).otherwise(0.0)
    out = out.withColumn("score", _clip(raw - penalty)).withColumn("penalty", penalty)
    return out.withColumn("label", readiness_label(c("score"), c("tier"), c("variant")))


def label_rank(score: Column) -> Column:
    return (F.when(score < 20, 0).when(score < 40, 1).when(score < 60, 2).when(score < 75, 3).when(score < 90, 4).otherwise(5))


def label_cap(tier: Column, variant: Column) -> Column:
    return (F.when((tier == TIER3) & (variant == TV), 5).when((tier == TIER3) & (variant == STATIC), 4)
            .when(tier == TIER2, 3).when(tier == TIER1, 2).otherwise(1))


def cap_label(proposed: Column, tier: Column, variant: Column) -> Column:
    """Cap a proposed label by what the tier can execute; unknown labels become NotReady."""
    names = F.array(*[F.lit(x) for x in LABELS])
    rank = F.array_position(names, proposed) - 1
    return F.when(rank < 0, LABELS[0]).otherwise(F.get(names, F.least(rank, label_cap(tier, variant)).cast("int")))


def readiness_label(score: Column, tier: Column, variant: Column) -> Column:
    names = F.array(*[F.lit(x) for x in LABELS])
    return F.get(names, F.least(label_rank(score), label_cap(tier, variant)))


def execution_plan(tiers: DataFrame, all_methods: bool = False) -> DataFrame:
    c = F.col
    tv = (c("tier") == TIER3) & (F.coalesce("variant", F.lit("")) == TV)
    lagged = (c("tier") == TIER3) & c("variant").isNotNull()
    if all_methods:
        tv = lagged = F.lit(True)
    name = (F.when(tv, "tier3_full_time_varying").when(lagged, "tier3_static_lagged").when(c("tier") == TIER2, "tier2_contemporaneous")
            .when(c("tier") == TIER1, "tier1_correlation_only").otherwise("tier0_descriptives_only"))
    return tiers.select("profile_id", "tier", "variant", name.alias("analysis_set"), tv.alias("run_time_varying"), lagged.alias("run_static"),
                        (F.lit(all_methods) | (c("tier") != TIER0)).alias("run_correlation"),
                        (F.lit(not all_methods) & (c("tier") == TIER0)).alias("run_descriptives_only"))


def readiness_report(scored: DataFrame) -> DataFrame:
    """Reasons, next steps (at most six) and caveats beside a nested report struct per profile."""
    c = F.col
    irregular = c("regularity").isin("moderately_irregular", "highly_irregular")
    dup = F.coalesce("duplicate_fraction", F.lit(0.0)) >= LIMITS.dup_soft
    t3, tv, static = c("tier") == TIER3, c("variant") == TV, c("variant") == STATIC
    why = F.array_compact(F.array(
        F.concat(F.lit("Tier: "), c("tier")), F.when(t3, F.concat(F.lit("Variant: "), c("variant"))),
        F.format_string("Ready variables: %d of %d", c("n_ready"), c("n_candidates")),
        F.concat(F.lit("Regularity: "), F.coalesce("regularity", F.lit("unknown"))),
        F.when(t3, F.format_string("Effective n: %d static (needs %d), %d time-varying (needs %d)", c("q25_static"), c("required_static"), c("q25_tv"), c("required_tv")))
        .otherwise(F.concat_ws("", F.lit("Pairwise n median/q25/min: "), F.concat_ws("/", c("pair_median"), c("pair_q25"), c("pair_min")))),
        F.when(c("n_high") > 0, F.format_string("Highly collinear pairs: %d", c("n_high")))))
    steps = F.slice(_reasons({
        "Collect more time points.": c("tier").isin(TIER0, TIER1),
        "Complete more items per check-in.": c("mean_missing") > 0.20,
        "Keep a steadier schedule.": irregular,
        "Merge duplicate time stamps.": dup,
        "Review redundant items.": c("n_high") > 0,
        "Prefer variables that change over time.": c("n_soft") > 0,
        "Plan smoothing windows for time-varying estimation.": t3 & tv,
    }), 1, 6)
    caveats = _reasons({
        "Sampling regularity could not be assessed.": c("regularity").isNull(),
        "Network models are sensitive to collinearity and to variables per sample.": c("tier").isin(TIER2, TIER3),
        "A static lag model expects approximate stationarity.": t3 & static,
        "A time-varying model needs more data and a smoothing choice.": t3 & tv,
        "Time-varying result has lower confidence below a score of 90.": t3 & tv & (c("score") < 90),
    })
    out = scored.withColumn("why", why).withColumn("next_steps", steps).withColumn("caveats", caveats)
    tiers = F.struct(*[c(x) for x in ("k1", "k2", "k3_static", "k3_tv", "tier1_ok", "tier2_ok", "static_ok", "tv_ok", "required_static", "required_tv")])
    parts = F.struct(*[c(x) for x in ("sample_score", "missing_score", "quality_score", "time_score", "assumptions_score")])
    overall = F.struct(c("label"), c("score"), c("tier"), c("variant"), c("ready_variables"), c("why"), c("next_steps"), c("caveats"), parts.alias("components"))
    return out.withColumn("report", F.struct(overall.alias("overall"), tiers.alias("tiers")))
