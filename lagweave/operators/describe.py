"""Descriptive statistics of series: summaries, correlation, trend, progress, highlights."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from lagweave.core.ranking import top_n
from lagweave.functions.scores import corr
from lagweave.functions.tails import p_norm
from lagweave.operators.series import by_series, in_order, SERIES, observed_sequence


def series_summary(obs: DataFrame, by: list[str] = SERIES) -> DataFrame:
    """n, mean, sd, median, min, max, iqr and MAD of the non-null values; under four values the extremes stand in
    for the quartiles. Groups are parts of a grid series, so the built-in percentile holds few values."""
    seen = obs.where(F.col("value").isNotNull())
    dev = seen.withColumn("_dev", F.abs(F.col("value") - F.percentile("value", 0.5).over(W.partitionBy(*by))))
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    agg = dev.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        q.alias("_q"), F.min("value").alias("min"), F.max("value").alias("max"), F.percentile("_dev", 0.5).alias("mad"))
    iqr = F.when(F.col("n") >= 4, F.col("_q")[2] - F.col("_q")[0]).otherwise(F.col("max") - F.col("min"))
    return agg.select(*by, "n", "mean", F.when(F.col("n") >= 2, F.col("sd")).alias("sd"), F.col("_q")[1].alias("median"), "min", "max", iqr.alias("iqr"), "mad")


def group_summary(obs: DataFrame, level: str) -> DataFrame:
    by = [*SERIES, level]
    counts = obs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"), F.count("value").alias("n_nonmissing"))
    counts = counts.withColumn("missing_rate", 1 - F.col("n_nonmissing") / F.col("n_total"))
    return counts.join(series_summary(obs, by).drop("n"), by, "left")


def pair_rows(obs: DataFrame) -> DataFrame:
    """Slots where both variables a < b of a profile have values."""
    seen = obs.where(F.col("value").isNotNull())
    a = seen.select("profile_id", "t_index", F.col("code").alias("a"), F.col("value").alias("x"))
    b = seen.select("profile_id", "t_index", F.col("code").alias("b"), F.col("value").alias("y"))
    return a.join(b, ["profile_id", "t_index"]).where(F.col("a") < F.col("b"))


def correlation_matrix(obs: DataFrame, method: str = "pearson", min_periods: int = 10) -> DataFrame:
    """r per variable pair on pair-complete slots; Spearman ranks are average ranks of those slots."""
    pairs = pair_rows(obs)
    if method == "spearman":
        by = ["profile_id", "a", "b"]

        def mid(c: str):
            w = W.partitionBy(*by)
            return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(*by, c)) - 1) / 2

        pairs = pairs.withColumns({"rx": mid("x"), "ry": mid("y")}).select(*by, F.col("rx").alias("x"), F.col("ry").alias("y"))
    r = corr("x", "y")
    out = pairs.groupBy("profile_id", "a", "b").agg(F.count(F.lit(1)).alias("n"), r.alias("r"))
    return out.select("profile_id", "a", "b", "n", F.when(F.col("n") >= max(3, min_periods), F.col("r")).alias("r"))


def ols_trend(obs: DataFrame) -> DataFrame:
    """Slope, intercept and R2 on the position of the non-null values, with the HC3 normal p of the slope."""
    seen = observed_sequence(obs).select(*SERIES, F.col("seq").cast("double").alias("t"), "value", "n")
    fit = seen.groupBy(*SERIES).agg(
        F.max("n").alias("n"), F.regr_slope("value", "t").alias("slope"), F.regr_intercept("value", "t").alias("intercept"),
        F.regr_r2("value", "t").alias("r2"), F.avg("t").alias("tm"), F.regr_sxx("value", "t").alias("sxx")).where("n >= 3")
    dev = F.col("t") - F.col("tm")
    lev = 1 / F.col("n") + dev * dev / F.col("sxx")
    res = F.col("value") - F.col("intercept") - F.col("slope") * F.col("t")
    hc3 = seen.drop("n").join(fit, SERIES).groupBy(*SERIES).agg(
        (F.sum(F.pow(dev * res / (1 - lev), 2)) / F.max(F.col("sxx") * F.col("sxx"))).alias("var"))
    out = fit.join(hc3, SERIES).withColumn("z", F.when(F.col("var") > 0, F.col("slope") / F.sqrt("var")))
    return out.select(*SERIES, "n", "slope", "intercept", F.coalesce("r2", F.lit(0.0)).alias("r2"), F.sqrt("var").alias("se_hc3"),
                      p_norm(F.col("z")).alias("p_slope"))


def logistic_trend(obs: DataFrame, rounds: int = 12) -> DataFrame:
    """Logistic slope on time for binary series of at least eight values; odds ratio per step and Wald p.

    Each Newton round is one map-side aggregate of five sums per series; time is scaled to [0, 1] inside.
    """
    from lagweave.core.session import cut_lineage

    seen = cut_lineage(observed_sequence(obs).where("n >= 8").select(*SERIES, "n", "value", (F.col("seq") / (F.col("n") - 1)).alias("t")))
    beta = seen.groupBy(*SERIES).agg(F.max("n").alias("n")).withColumns({"b0": F.lit(0.0), "b1": F.lit(0.0)})
    beta = beta.withColumns({"h00": F.lit(None).cast("double"), "h01": F.lit(None).cast("double"), "h11": F.lit(None).cast("double")})
    p = 1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * F.col("t"))))
    for i in range(rounds):
        sums = seen.drop("n").join(beta.select(*SERIES, "n", "b0", "b1"), SERIES).groupBy(*SERIES, "n", "b0", "b1").agg(
            F.sum(F.col("value") - p).alias("g0"), F.sum((F.col("value") - p) * F.col("t")).alias("g1"),
            F.sum(p * (1 - p)).alias("h00"), F.sum(p * (1 - p) * F.col("t")).alias("h01"), F.sum(p * (1 - p) * F.col("t") * F.col("t")).alias("h11"))
        det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
        step0 = (F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1")) / det
        step1 = (F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0")) / det
        ok = det > 1e-10
        beta = sums.select(*SERIES, "n", (F.col("b0") + F.when(ok, step0).otherwise(0.0)).alias("b0"),
                           (F.col("b1") + F.when(ok, step1).otherwise(0.0)).alias("b1"), "h00", "h01", "h11")
        if i % 4 == 3:
            beta = cut_lineage(beta)
    det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
    scaled = beta.withColumn("z", F.when(det > 1e-10, F.col("b1") / F.sqrt(F.col("h00") / det))).withColumn("slope", F.col("b1") / (F.col("n") - 1))
    return scaled.select(*SERIES, "n", "slope", F.exp("slope").alias("odds_ratio"), p_norm(F.col("z")).alias("p_slope"))


def progress(obs: DataFrame, trend: DataFrame) -> DataFrame:
    """Fitted start, end and change, the change in % of scale = max(|median|, iqr, range), raw first and last."""
    base = series_summary(obs)
    ends = obs.where(F.col("value").isNotNull()).groupBy(*SERIES).agg(
        F.min_by("value", "t_index").alias("raw_first"), F.max_by("value", "t_index").alias("raw_last"))
    scale = F.greatest(F.abs("median"), F.col("iqr"), F.col("max") - F.col("min"))
    delta = F.col("slope") * (F.col("n") - 1)
    out = trend.select(*SERIES, "n", "slope", "intercept").join(base.select(*SERIES, scale.alias("scale")), SERIES).join(ends, SERIES)
    return out.select(*SERIES, F.col("intercept").alias("fitted_start"), (F.col("intercept") + delta).alias("fitted_end"),
                      delta.alias("fitted_delta"), F.when(F.abs("scale") > 1e-12, 100 * delta / F.col("scale")).alias("pct_of_scale"), "raw_first", "raw_last")


def highlights(progress_table: DataFrame, trend: DataFrame, tests: DataFrame, k: int = 5, n_tests: int = 12, alpha: float = 0.05) -> DataFrame:
    """Top k by |progress| and by |trend| per profile, and the first significant calendar effects."""
    def best(df: DataFrame, value: str, kind: str) -> DataFrame:
        top = top_n(df.where(F.col(value).isNotNull()), ["profile_id"], [F.desc(F.abs(value)), F.col("code")], k)
        return top.select("profile_id", F.lit(kind).alias("kind"), "code", F.col(value).alias("value"), "rank")

    sig = top_n(tests.where(F.col("p_value") < alpha), ["profile_id", "effect"], [F.col("code")], n_tests)
    return best(progress_table, "pct_of_scale", "progress").unionByName(best(trend, "slope", "trend")).unionByName(
        sig.select("profile_id", F.col("effect").alias("kind"), "code", F.col("p_value").alias("value"), "rank"))


def detect_nominal(rows: DataFrame, columns: dict[str, str], max_text: int = 12, max_numeric: int = 6) -> DataFrame:
    """Columns (name -> 'text' or 'numeric') with 2 to 12 (text) or 2 to 6 (numeric) levels; P*/C* variables are no factors.

    A sketch first discards columns that it puts above three times the larger limit (36 levels as given), far beyond its
    error; the others are counted exactly.
    """
    names = [c for c in columns if not re.match(r"[PC]\d", c)]
    rough = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in names]).first().asDict()
    near = [c for c in names if rough[c] <= 3 * max_text]
    # Each column is at most 3 * max_text values wide by the sketch.
    stacked = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in near])).alias("s")).select("s.*")
    exact = stacked.where(F.col("level").isNotNull()).groupBy("column").agg(F.count_distinct("level").alias("n_levels"))
    cap = F.when(F.col("column").isin([c for c in near if columns[c] == "text"]), max_text).otherwise(max_numeric)
    return exact.where((F.col("n_levels") >= 2) & (F.col("n_levels") <= cap))
