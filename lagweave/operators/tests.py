"""Grouped statistical tests. Ranks and medians come from counted values, so no group is sorted whole by one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from lagweave.core.ranking import mid_ranks, quantiles
from lagweave.functions.tails import p_chi2, p_f, p_norm, p_t
from lagweave.operators.series import SERIES

# MacKinnon response-surface coefficients for the ADF p (constant, one series), and the KPSS table.
ADF_LOW, ADF_HIGH, ADF_STAR, ADF_MIN, ADF_MAX = (
    [2.1659, 1.4412, 0.038269], [1.7339, 0.93202, -0.12745, -0.010368], -1.61, -18.83, 2.74)
KPSS_STATS, KPSS_P = [0.347, 0.463, 0.574, 0.739], [0.10, 0.05, 0.025, 0.01]


def _ols_t(y: np.ndarray, x: np.ndarray) -> tuple[float, float]:
    """t statistic of the first regressor, and the sum of squared residuals."""
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ (x.T @ y)
    ssr = float(np.sum((y - x @ beta) ** 2))
    s2 = ssr / max(1, len(y) - x.shape[1])
    return float(beta[0] / np.sqrt(max(s2 * inv[0, 0], 1e-300))), ssr


def _lag_design(x: np.ndarray, lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    dx = np.diff(x)
    rows = np.arange(skip, len(dx))
    cols = [x[rows]] + [dx[rows - k] for k in range(1, lags + 1)] + [np.ones(len(rows))]
    return dx[rows], np.column_stack(cols)


def _adf(x: np.ndarray) -> tuple[float, float, int]:
    n = len(x)
    top = max(0, min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2))
    best, chosen = np.inf, 0
    for lags in range(top + 1):
        y, d = _lag_design(x, lags, top)
        _, ssr = _ols_t(y, d)
        aic = len(y) * (np.log(2 * np.pi * max(ssr, 1e-300) / len(y)) + 1) + 2 * d.shape[1]
        if aic < best:
            best, chosen = aic, lags
    stat, _ = _ols_t(*_lag_design(x, chosen, chosen))
    if stat > ADF_MAX:
        return stat, 1.0, chosen
    if stat < ADF_MIN:
        return stat, 0.0, chosen
    coefs = ADF_LOW if stat <= ADF_STAR else ADF_HIGH
    z = sum(c * stat ** i for i, c in enumerate(coefs))
    from math import erfc, sqrt
    return stat, 0.5 * erfc(-z / sqrt(2)), chosen


def _kpss(x: np.ndarray) -> tuple[float, float]:
    n, e = len(x), x - x.mean()
    cov = lambda k: float(np.sum(e[k:] * e[: n - k]))
    first = int(n ** (2 / 9))
    s0 = cov(0) / n + sum(cov(k) / (n / 2) for k in range(1, first + 1))
    s1 = sum(k * cov(k) / (n / 2) for k in range(1, first + 1))
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    var = (cov(0) + 2 * sum(cov(k) * (1 - k / (lags + 1)) for k in range(1, lags + 1))) / n
    stat = float(np.sum(np.cumsum(e) ** 2) / n ** 2 / var)
    return stat, float(np.interp(stat, KPSS_STATS, KPSS_P))


def _both(values: pd.Series) -> pd.DataFrame:
    out = []
    for v in values:
        x = np.asarray(v, dtype=float)
        rec = {"adf_stat": None, "adf_p": None, "adf_lag": None, "kpss_stat": None, "kpss_p": None}
        if len(x) >= 15 and np.ptp(x) > 0:
            with np.errstate(all="ignore"):
                rec["adf_stat"], rec["adf_p"], rec["adf_lag"] = _adf(x)
                rec["kpss_stat"], rec["kpss_p"] = _kpss(x)
        out.append({k: None if v is None or not np.isfinite(v) else v for k, v in rec.items()})
    return pd.DataFrame(out, columns=["adf_stat", "adf_p", "adf_lag", "kpss_stat", "kpss_p"]).astype(
        {"adf_stat": "float64", "adf_p": "float64", "adf_lag": "Int32", "kpss_stat": "float64", "kpss_p": "float64"})


def stationarity(obs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """ADF (AIC lag) and KPSS (automatic lag) per series of at least 15 values.

    A series is gathered as an array; its length is bounded by the calendar grid of `obs`.
    """
    fn = F.pandas_udf(_both, "adf_stat double, adf_p double, adf_lag int, kpss_stat double, kpss_p double")
    series = obs.groupBy(*SERIES).agg(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("value").isNotNull(), F.struct("t_index", "value")))), lambda s: s["value"]).alias("values"))
    tested = series.select(*SERIES, fn("values").alias("t")).select(*SERIES, "t.*")
    clean = tested.select(*SERIES, "adf_lag", *[F.nanvl(c, F.lit(None)).alias(c) for c in ("adf_stat", "adf_p", "kpss_stat", "kpss_p")])
    unit_root_gone, level = F.col("adf_p") < alpha, F.col("kpss_p") >= alpha
    return clean.withColumn("stationary", F.coalesce(unit_root_gone & level, F.when(F.col("kpss_p").isNull(), unit_root_gone), F.when(F.col("adf_p").isNull(), level)))


def _group_moments(rows: DataFrame, by: list[str], g: str) -> DataFrame:
    return rows.where(F.col("value").isNotNull()).groupBy(*by, g).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"),
        F.skewness("value").alias("s"), F.kurtosis("value").alias("k"))


def _jb_normal(n, s, k):
    """Jarque-Bera p >= .05 on groups of 3 or more; a flat group counts as not normal."""
    p = F.exp(-n / 12 * (s * s + k * k / 4))
    return (n >= 3) & F.coalesce(F.nanvl(p, F.lit(0.0)) >= 0.05, F.lit(False))


def omnibus_test(rows: DataFrame, by: list[str], group: str, bounded: bool = True) -> DataFrame:
    """k-group test per key: ANOVA when all groups look normal and Levene passes, else Kruskal-Wallis with epsilon squared."""
    rows = rows.where(F.col("value").isNotNull() & F.col(group).isNotNull())
    mom = _group_moments(rows, by, group)
    med = quantiles(rows, [*by, group], "value", {"_med": 0.5}, bounded)
    dev = rows.join(med, [*by, group]).withColumn("dev", F.abs(F.col("value") - F.col("_med")))
    lev = dev.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"), F.avg("dev").alias("mean"), F.var_samp("dev").alias("var"))

    def f_parts(groups: DataFrame, p: str) -> DataFrame:
        total = W.partitionBy(*by)
        grand = F.sum(F.col("n") * F.col("mean")).over(total) / F.sum("n").over(total)
        parts = groups.withColumn("between", F.col("n") * F.pow(F.col("mean") - grand, 2)).withColumn("within", (F.col("n") - 1) * F.col("var"))
        return parts.groupBy(*by).agg(
            F.count(F.lit(1)).alias(f"{p}k"), F.sum("n").alias(f"{p}n"), F.min("n").alias(f"{p}min"),
            F.try_divide(F.try_divide(F.sum("between"), F.count(F.lit(1)) - 1), F.try_divide(F.sum("within"), F.sum("n") - F.count(F.lit(1)))).alias(f"{p}f"))

    normal = mom.groupBy(*by).agg(F.bool_and(_jb_normal(F.col("n"), F.col("s"), F.col("k"))).alias("normal"))
    ranks = mid_ranks(rows, by, "value", bounded)
    ties = ranks.groupBy(*by).agg((1 - F.try_divide(F.sum(F.pow("n_at", F.lit(3)) - F.col("n_at")), F.max(F.pow("n_total", F.lit(3)) - F.col("n_total")))).alias("tie"))
    rank_sums = rows.join(ranks.select(*by, "value", "mid_rank"), [*by, "value"]).groupBy(*by, group).agg(
        F.sum("mid_rank").alias("rs"), F.count(F.lit(1)).alias("n"))
    kw = rank_sums.groupBy(*by).agg(F.sum("n").alias("N"), F.sum(F.col("rs") * F.col("rs") / F.col("n")).alias("ss"))
    out = f_parts(mom, "a").join(f_parts(lev, "l"), by).join(normal, by).join(ties, by).join(kw, by).where((F.col("ak") >= 2) & (F.col("amin") >= 2))
    h = (12 / (F.col("N") * (F.col("N") + 1)) * F.col("ss") - 3 * (F.col("N") + 1)) / F.col("tie")
    out = out.withColumn("h", F.when(F.col("tie") > 0, h))
    out = out.withColumn("levene_p", p_f(F.col("lf"), F.col("lk") - 1, F.col("ln") - F.col("lk")))
    anova = F.col("normal") & (F.coalesce("levene_p", F.lit(1.0)) >= 0.05)
    out = out.withColumn("test", F.when(anova, "ANOVA").otherwise("Kruskal-Wallis"))
    out = out.withColumn("statistic", F.when(anova, F.col("af")).otherwise(F.col("h")))
    out = out.withColumn("f_p", p_f(F.col("af"), F.col("ak") - 1, F.col("an") - F.col("ak"))).withColumn("h_p", p_chi2(F.col("h"), F.col("ak") - 1))
    return out.select(*by, F.col("ak").alias("n_groups"), F.col("an").alias("n"), "test", "statistic",
                      F.when(anova, F.col("f_p")).otherwise(F.col("h_p")).alias("p_value"),
                      F.when(~anova & (F.col("an") > F.col("ak")), (F.col("h") - F.col("ak") + 1) / (F.col("an") - F.col("ak"))).alias("epsilon_squared"))


def two_group_test(rows: DataFrame, by: list[str], is_b: str, bounded: bool = True) -> DataFrame:
    """Welch t with Cohen's d when both groups look normal, else Mann-Whitney (tie-corrected, continuity-corrected
    normal tail) with the rank-biserial effect. Group a has `is_b` false."""
    rows = rows.where(F.col("value").isNotNull() & F.col(is_b).isNotNull())
    mom = _group_moments(rows, by, is_b).withColumn("ok", _jb_normal(F.col("n"), F.col("s"), F.col("k")))
    side = lambda flag, x: F.max(F.when(F.col(is_b) == flag, F.col(x)))
    wide = mom.groupBy(*by).agg(*[side(f, x).alias(f"{p}_{x}") for p, f in (("a", False), ("b", True)) for x in ("n", "mean", "var")],
                                F.bool_and("ok").alias("normal"))
    ranks = mid_ranks(rows, by, "value", bounded)
    ties = ranks.groupBy(*by).agg(F.sum(F.pow("n_at", F.lit(3)) - F.col("n_at")).alias("t3"))
    ra = rows.where(~F.col(is_b)).join(ranks.select(*by, "value", "mid_rank"), [*by, "value"]).groupBy(*by).agg(F.sum("mid_rank").alias("ra"))
    out = wide.where((F.col("a_n") >= 2) & (F.col("b_n") >= 2)).join(ties, by).join(ra, by)
    na, nb = F.col("a_n"), F.col("b_n")
    va, vb = F.col("a_var") / na, F.col("b_var") / nb
    t = F.try_divide(F.col("a_mean") - F.col("b_mean"), F.sqrt(va + vb))
    dof = F.try_divide((va + vb) * (va + vb), va * va / (na - 1) + vb * vb / (nb - 1))
    u = F.col("ra") - na * (na + 1) / 2
    n = na + nb
    sd = F.sqrt(na * nb / 12 * (n + 1 - F.col("t3") / (n * (n - 1))))
    z = F.when(sd > 0, F.greatest(F.lit(0.0), F.abs(u - na * nb / 2) - 0.5) / sd)
    pooled = F.sqrt(((na - 1) * F.col("a_var") + (nb - 1) * F.col("b_var")) / (n - 2))
    out = out.withColumn("t", t).withColumn("dof", dof).withColumn("u", u).withColumn("z", z)
    out = out.withColumn("t_p", p_t(F.col("t"), F.col("dof"))).withColumn("u_p", p_norm(F.col("z")))
    normal = F.col("normal")
    return out.select(*by, "a_n", "b_n", F.when(normal, "Welch_t").otherwise("Mann_Whitney_U").alias("test"),
                      F.when(normal, F.col("t")).otherwise(F.col("u")).alias("statistic"),
                      F.when(normal, F.col("t_p")).otherwise(F.col("u_p")).alias("p_value"),
                      F.when(normal & (pooled > 1e-12), (F.col("b_mean") - F.col("a_mean")) / pooled).alias("cohens_d"),
                      F.when(~normal, 1 - 2 * F.col("u") / (na * nb)).alias("rank_biserial"))


def nominal_levels(rows: DataFrame, by: list[str], factor: str, min_per_level: int = 5) -> DataFrame:
    """Rows of levels with enough values, for keys that keep at least two levels and twice the minimum."""
    rows = rows.where(F.col("value").isNotNull() & F.col(factor).isNotNull())
    counts = rows.groupBy(*by, factor).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*by)
    ok = (counts.withColumn("_all", F.sum("_n").over(w)).where(F.col("_n") >= min_per_level)
          .withColumn("_levels", F.count(F.lit(1)).over(w)).where((F.col("_levels") >= 2) & (F.col("_all") >= 2 * min_per_level)))
    return rows.join(ok.select(*by, factor), [*by, factor], "left_semi")


def nominal_effects(rows: DataFrame, by: list[str], factor: str, min_per_level: int = 5, bounded: bool = True) -> DataFrame:
    return omnibus_test(nominal_levels(rows, by, factor, min_per_level), by, factor, bounded)


def friedman(scores: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """Friedman test over complete blocks with tie correction; needs three treatments and five blocks."""
    w = W.partitionBy(block)
    ranked = (
        scores.where(F.col(value).isNotNull()).withColumn("_k", F.count(F.lit(1)).over(w))
        .withColumn("_ties", F.count(F.lit(1)).over(W.partitionBy(block, value)))
        .withColumn("_rank", F.rank().over(w.orderBy(value)) + (F.col("_ties") - 1) / 2))
    full = ranked.where(F.col("_k") == 3)
    sums = full.groupBy(treatment).agg(F.sum("_rank").alias("r"), F.count(F.lit(1)).alias("n"), F.sum((F.pow("_ties", F.lit(2)) - 1)).alias("t"))
    k = 3
    stat = sums.agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.max("n").alias("n_blocks"), F.sum("t").alias("ties"), F.count(F.lit(1)).alias("k")).where(
        (F.col("k") == k) & (F.col("n_blocks") >= 5))
    n = F.col("n_blocks")
    chi = F.try_divide(12 / (n * k * (k + 1)) * F.col("rr") - 3 * n * (k + 1), 1 - F.col("ties") / (n * (k ** 3 - k)))
    out = stat.withColumn("statistic", chi)
    return out.select("n_blocks", "statistic", p_chi2(F.col("statistic"), F.lit(2.0)).alias("p_value"))


def paired_differences(scores: DataFrame, block: str, treatment: str, value: str, pairs: list[tuple[str, str]]) -> DataFrame:
    names = sorted({x for p in pairs for x in p})
    wide = scores.groupBy(block).pivot(treatment, names).agg(F.max(value)).where(
        " and ".join(f"`{x}` is not null" for x in names))
    return wide.select(block, F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(a) - F.col(b)).alias("diff")) for a, b in pairs])).alias("p")).select(block, "p.*")


def wilcoxon(diffs: DataFrame) -> DataFrame:
    """Signed-rank test per pair: zeros dropped, tie-corrected normal tail, rank sums from counted |diff|."""
    all_n = diffs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_blocks"), F.avg("diff").alias("mean_diff"))
    nz = diffs.where(F.col("diff") != 0).withColumn("mag", F.abs("diff"))
    ranks = mid_ranks(nz, ["a", "b"], "mag")
    up = nz.groupBy("a", "b", "mag").agg(F.sum((F.col("diff") > 0).cast("long")).alias("pos"))
    agg = ranks.join(up, ["a", "b", "mag"]).groupBy("a", "b").agg(
        F.sum(F.col("mid_rank") * F.col("pos")).alias("w_plus"), F.max("n_total").alias("n"),
        F.sum(F.pow("n_at", F.lit(3)) - F.col("n_at")).alias("t3"))
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("t3") / 48)
    out = agg.withColumn("z", F.try_divide(F.col("w_plus") - n * (n + 1) / 4, sd))
    med = quantiles(diffs, ["a", "b"], "diff", {"median_diff": 0.5})
    full = all_n.join(med, ["a", "b"]).join(out, ["a", "b"], "left")
    full = full.withColumn("statistic", F.least("w_plus", n * (n + 1) / 2 - F.col("w_plus"))).withColumn("z", F.when(F.col("n_blocks") >= 5, F.col("z")))
    return full.select("a", "b", "n_blocks", "mean_diff", "median_diff", "statistic", p_norm(F.col("z")).alias("p_raw"))


def sign_flip_test(diffs: DataFrame, n_perm: int = 20_000, seed: int = 0) -> DataFrame:
    """Paired permutation p per pair. Every block is exploded to its signs per permutation and summed map-side, so
    only (pair, permutation) sums travel; signs are a hash of (block, permutation, seed)."""
    base = diffs.select("a", "b", F.xxhash64(F.col(diffs.columns[0]).cast("string")).alias("block"), "diff")
    obs = base.groupBy("a", "b").agg(F.abs(F.avg("diff")).alias("observed"), F.count(F.lit(1)).alias("n"))
    bits = F.explode(F.sequence(F.lit(0), F.lit((n_perm + 62) // 63 - 1))).alias("word")
    words = base.select("a", "b", "block", "diff", bits).withColumn("h", F.xxhash64("block", "word", F.lit(seed)))
    flips = [F.sum(F.when(F.shiftright("h", i).bitwiseAND(F.lit(1)) == 1, F.col("diff")).otherwise(-F.col("diff"))) for i in range(63)]
    sums = words.groupBy("a", "b", "word").agg(F.array(*flips).alias("s"))
    draws = sums.select("a", "b", "word", F.posexplode("s").alias("bit", "s")).where(F.col("word") * 63 + F.col("bit") < n_perm)
    return draws.join(obs, ["a", "b"]).groupBy("a", "b").agg(
        F.max("n").alias("n_blocks"), F.count(F.lit(1)).alias("n_perm"),
        F.avg((F.abs(F.col("s") / F.col("n")) >= F.col("observed") - 1e-12).cast("double")).alias("p_raw"))


def paired_test(diffs: DataFrame, n_perm: int = 20_000, seed: int = 0) -> DataFrame:
    """The signed-rank test, and where its normal tail is not defined (fewer than five blocks, or no spread of ranks) the
    permutation p. `method` says which; only those pairs are permuted."""
    ranked = wilcoxon(diffs)
    open_ = ranked.where(F.col("p_raw").isNull()).select("a", "b")
    flips = sign_flip_test(diffs.join(open_, ["a", "b"], "left_semi").select(*diffs.columns), n_perm, seed).select("a", "b", F.col("p_raw").alias("p_flip"))
    out = ranked.join(flips, ["a", "b"], "left")
    method = F.when(F.col("p_raw").isNotNull(), "signed_rank").when(F.col("p_flip").isNotNull(), "sign_flip")
    return out.withColumn("method", method).withColumn("p_raw", F.coalesce("p_raw", "p_flip")).drop("p_flip")


def holm(pvals: DataFrame, by: list[str], p: str, order: list[str]) -> DataFrame:
    """Step-down adjusted p within each family; families are short lists of tests."""
    w = W.partitionBy(*by).orderBy(F.col(p).asc(), *order)
    m = F.count(p).over(W.partitionBy(*by))
    val = (m - F.row_number().over(w) + 1) * F.col(p)
    tested = pvals.where(F.col(p).isNotNull()).withColumn("_v", val)
    adjusted = tested.withColumn("p_holm", F.least(F.lit(1.0), F.max("_v").over(w.rowsBetween(W.unboundedPreceding, 0)))).drop("_v")
    return adjusted.unionByName(pvals.where(F.col(p).isNull()).withColumn("p_holm", F.lit(None).cast("double")))
