"""Ordered-series operators on `obs(profile_id, code, t_index, ts, value)`.

`to_grid` resamples to at most one row per (profile, variable, slot) with map-side partial averages. From
there on a series is bounded by the calendar (slots of the study), not by the row count of the source, so
windows per (profile, variable) stay small even when one profile holds a third of all raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec
from pyspark.sql import functions as F

from lagweave.functions.scores import corr

SERIES = ["profile_id", "code"]


def by_series() -> WindowSpec:
    return W.partitionBy(*SERIES)


def in_order() -> WindowSpec:
    return by_series().orderBy("t_index")


def up_to_here() -> WindowSpec:
    return in_order().rowsBetween(W.unboundedPreceding, 0)


def from_here() -> WindowSpec:
    return in_order().rowsBetween(0, W.unboundedFollowing)


def to_grid(raw: DataFrame, step_seconds: int) -> DataFrame:
    """Average per slot, then fill each series' missing slots with null over its profile's span."""
    slots = (
        raw.withColumn("slot", F.floor(F.unix_micros("ts") / (step_seconds * 1_000_000)))
        .groupBy("profile_id", "code", "slot").agg(F.round(F.avg("value"), 6).alias("value"))
    )
    by_profile, by_slot = W.partitionBy("profile_id"), by_series().orderBy("slot")
    runs = (
        slots.withColumn("first_slot", F.min("slot").over(by_profile))
        .withColumn("last_slot", F.max("slot").over(by_profile))
        .withColumn("from_slot", F.when(F.lag("slot").over(by_slot).isNull(), F.col("first_slot")).otherwise(F.col("slot")))
        .withColumn("to_slot", F.coalesce(F.lead("slot").over(by_slot) - 1, F.col("last_slot")))
    )
    return runs.select(
        *SERIES, "first_slot", "value", F.col("slot").alias("seen"),
        F.explode(F.sequence("from_slot", "to_slot")).alias("slot"),
    ).select(
        *SERIES,
        (F.col("slot") - F.col("first_slot")).cast("int").alias("t_index"),
        F.timestamp_seconds(F.col("slot") * step_seconds).alias("ts"),
        F.when(F.col("slot") == F.col("seen"), F.col("value")).alias("value"),
    )


def order_by_time(rows: DataFrame, keys: list[str], ts: str, fallback: str, chunk_seconds: int = 86_400) -> DataFrame:
    """Stable 0-based position of each raw row in its profile.

    The timestamp orders rows when at least 80 % of the profile's stamps parse, else the numeric fallback
    column does. Positions are numbered inside calendar chunks and shifted by the rows in earlier chunks, so
    that a profile with a third of all rows is spread over many tasks. Rows without a stamp come last, in chunks of
    the fallback column.
    """
    usable = rows.groupBy(*keys).agg(
        (F.avg(F.col(ts).isNotNull().cast("double")) >= 0.8).alias("by_time"))
    keyed = rows.join(usable, keys).withColumn(
        "order_key", F.when(F.col("by_time"), F.unix_micros(ts)).otherwise(F.col(fallback).cast("long")))
    keyed = keyed.withColumn("chunk", F.when(
        F.col("by_time"), F.floor(F.col("order_key") / (chunk_seconds * 1_000_000))
    ).otherwise(F.floor(F.col("order_key") / 100_000)))
    keyed = keyed.withColumn("late", F.when(F.col("chunk").isNull(), F.floor(F.col(fallback).cast("long") / 100_000)))
    sizes = keyed.groupBy(*keys, "chunk", "late").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(*keys).orderBy(F.col("chunk").asc_nulls_last(), F.col("late").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "chunk", "late", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = W.partitionBy(*keys, "chunk", "late").orderBy("order_key", fallback)
    numbered = keyed.withColumn("_rn", F.row_number().over(inside))
    on = [numbered[k] == sizes[k] for k in keys] + [numbered[c].eqNullSafe(sizes[c]) for c in ("chunk", "late")]
    return numbered.join(sizes, on).select(
        *[numbered[c] for c in rows.columns], "by_time", (F.col("_rn") - 1 + F.col("shift")).alias("seq"))


def sampling_regularity(times: DataFrame, keys: list[str], ts: str = "ts", chunk_seconds: int = 86_400) -> DataFrame:
    """Modal step (10 s rounding), share of other steps, share of duplicate stamps, and the regularity class.

    Steps are taken inside calendar chunks; the step across a chunk border comes from the chunk's extremes.
    """
    stamped = times.where(F.col(ts).isNotNull()).select(
        *keys, F.unix_micros(ts).alias("us")).withColumn("chunk", F.floor(F.col("us") / (chunk_seconds * 1_000_000)))
    inside = W.partitionBy(*keys, "chunk").orderBy("us")
    within = stamped.select(*keys, (F.col("us") - F.lag("us").over(inside)).alias("step"))
    chunks = stamped.groupBy(*keys, "chunk").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    across = chunks.select(
        *keys, (F.col("lo") - F.lag("hi").over(W.partitionBy(*keys).orderBy("chunk"))).alias("step"))
    steps = within.unionByName(across).where(F.col("step").isNotNull())
    counted = steps.groupBy(*keys, (F.round(F.col("step") / 1e7) * 10).alias("rounded")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("step") == 0).cast("long")).alias("dups"))
    out = counted.groupBy(*keys).agg(
        (F.sum("n") + 1).alias("n_points"),
        F.max_by("rounded", F.struct("n", -F.col("rounded"))).alias("modal_step"),
        (1 - F.max("n") / F.sum("n")).alias("irregular_fraction"),
        (F.sum("dups") / (F.sum("n") + 1)).alias("duplicate_fraction"))
    enough = F.col("n_points") >= 5
    label = regularity_class(F.col("irregular_fraction"))
    return out.select(
        *keys, "n_points", *[F.when(enough, F.col(c)).alias(c) for c in ("modal_step", "irregular_fraction", "duplicate_fraction")],
        F.when(enough, label).alias("regularity"))


def regularity_class(irregular: Column) -> Column:
    # Class bounds .15 and .35.
    return (F.when(irregular <= 0.15, "regular_or_quasi_regular")
            .when(irregular <= 0.35, "moderately_irregular").otherwise("highly_irregular"))


def filled_times(obs: DataFrame) -> DataFrame:
    """The slots of a profile that hold at least one value."""
    return obs.where(F.col("value").isNotNull()).select("profile_id", "ts").distinct()


def longest_gap(obs: DataFrame) -> DataFrame:
    """Longest run of nulls per series; the count of values so far is constant inside a run of nulls."""
    runs = obs.withColumn("run", F.count("value").over(up_to_here())).where(F.col("value").isNull())
    gaps = runs.groupBy(*SERIES, "run").agg(F.count(F.lit(1)).alias("n")).groupBy(*SERIES).agg(F.max("n").alias("gap"))
    return obs.select(*SERIES).distinct().join(gaps, SERIES, "left").select(
        *SERIES, F.coalesce("gap", F.lit(0)).alias("max_consecutive_missing"))


def effective_n(obs: DataFrame, lag: int = 1) -> DataFrame:
    """Per profile: slots where all variables are present now and `lag` slots before (strict), and the
    truncated lower quartile of the per-variable counts."""
    present = obs.select(
        *SERIES, "t_index", F.col("value").isNotNull().alias("now"),
        F.coalesce(F.lag("value", lag).over(in_order()).isNotNull(), F.lit(False)).alias("before"))
    per_var = present.groupBy(*SERIES).agg(F.sum((F.col("now") & F.col("before")).cast("long")).alias("n_eff"))
    quart = per_var.groupBy("profile_id").agg(
        F.floor(F.percentile("n_eff", 0.25)).alias("n_eff_q25"), F.count(F.lit(1)).alias("k"))
    strict = present.groupBy("profile_id", "t_index").agg(F.bool_and(F.col("now") & F.col("before")).alias("ok")) \
        .groupBy("profile_id").agg(F.sum(F.col("ok").cast("long")).alias("n_eff_strict"))
    return quart.join(strict, "profile_id")


def observed_sequence(obs: DataFrame) -> DataFrame:
    """Non-null values with consecutive positions `seq` (0-based) and the series length `n`."""
    seen = obs.where(F.col("value").isNotNull())
    return seen.withColumn("seq", F.row_number().over(in_order()) - 1).withColumn("n", F.count(F.lit(1)).over(by_series()))


def autocorr1(obs: DataFrame) -> DataFrame:
    seen = obs.where(F.col("value").isNotNull()).withColumn("before", F.lag("value").over(in_order()))
    pairs = seen.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n"), corr("value", "before").alias("r"))
    return pairs.select(*SERIES, F.when(F.col("n") >= 3, F.col("r")).alias("autocorr_lag1"))


def ljung_box(obs: DataFrame) -> DataFrame:
    """Q at lag min(10, max(2, n div 6)) for n >= lag + 8; ten lag products per value, in one window pass."""
    seen = observed_sequence(obs)
    dev = F.col("value") - F.avg("value").over(by_series())
    devs = seen.select(*SERIES, "t_index", "n", dev.alias("d"))
    lags = list(range(1, 11))
    prods = devs.select(*SERIES, "n", "d", *[(F.col("d") * F.lag("d", k).over(in_order())).alias(f"p{k}") for k in lags])
    sums = prods.groupBy(*SERIES, "n").agg(F.sum(F.col("d") * F.col("d")).alias("c0"), *[F.sum(f"p{k}").alias(f"c{k}") for k in lags])
    m = F.least(F.lit(10), F.greatest(F.lit(2), F.floor(F.col("n") / 6)))
    q = sum(F.when(F.lit(k) <= m, F.pow(F.coalesce(F.col(f"c{k}"), F.lit(0.0)) / F.col("c0"), 2) / (F.col("n") - k)).otherwise(0.0) for k in lags)
    usable = (F.col("n") >= m + 8) & (F.col("c0") > 0)
    return sums.select(*SERIES, "n", m.cast("int").alias("lag"),
                       F.when(usable, F.col("n") * (F.col("n") + 2) * q).alias("q_stat"))


def t_norm(obs: DataFrame) -> DataFrame:
    """Time in [0, 1] over each profile's span, from the numeric index."""
    w = W.partitionBy("profile_id")
    lo, hi = F.min("t_index").over(w), F.max("t_index").over(w)
    return obs.withColumn("t_norm", (F.col("t_index") - lo) / (hi - lo + 1e-12))


# A time column serves if it has at least three values and 70 % of the rows.
AXIS_SHARE, AXIS_MIN = 0.7, 3


def time_axis(rows: DataFrame, order: str, index: str = "t_index", ts: str = "ts") -> DataFrame:
    """Adds axis ("index", "date" or "order") and t_norm: a profile's time in [0, 1] from its numeric index if that is
    mostly there, else from its dates, else from the order of its rows. Gaps of the chosen column lie on the line between
    the neighbours in row order, ends take the nearest value. `order` sorts a profile's rows; they are bounded by the
    calendar after `to_grid`."""
    own, w = W.partitionBy("profile_id"), W.partitionBy("profile_id").orderBy(order)
    up, down = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    number = F.col(index).cast("double")
    finite = F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf")), number)
    date = F.unix_micros(ts).cast("double")
    need = F.greatest(F.lit(AXIS_MIN), F.floor(F.lit(AXIS_SHARE) * F.count(F.lit(1)).over(own)))
    axis = F.when(F.count(finite).over(own) >= need, "index").when(F.count(date).over(own) >= need, "date").otherwise("order")
    at = rows.withColumn("axis", axis).withColumn("_i", (F.row_number().over(w) - 1).cast("double"))
    at = at.withColumn("_x", F.when(F.col("axis") == "index", finite).when(F.col("axis") == "date", date).otherwise(F.col("_i")))
    seen = F.when(F.col("_x").isNotNull(), F.col("_i"))
    pv, pi, nv, ni = F.last("_x", True).over(up), F.last(seen, True).over(up), F.first("_x", True).over(down), F.first(seen, True).over(down)
    x = at.withColumn("_x", F.coalesce("_x", F.when(ni > pi, pv + (nv - pv) * (F.col("_i") - pi) / (ni - pi)), pv, nv))
    lo, hi = F.min("_x").over(own), F.max("_x").over(own)
    return x.withColumn("t_norm", (F.col("_x") - lo) / (hi - lo + 1e-12)).drop("_i", "_x")


def interpolate(obs: DataFrame, by: str = "t_index") -> DataFrame:
    """Fill nulls on the line between the neighbours (`by` t_index or ts); ends take the nearest value."""
    x = F.col("t_index").cast("double") if by == "t_index" else F.unix_micros("ts").cast("double")
    at = F.when(F.col("value").isNotNull(), x)
    pv, px = F.last("value", True).over(up_to_here()), F.last(at, True).over(up_to_here())
    nv, nx = F.first("value", True).over(from_here()), F.first(at, True).over(from_here())
    line = F.when(nx > px, pv + (nv - pv) * (x - px) / (nx - px))
    return obs.withColumn("filled", F.coalesce("value", line, pv, nv))


def ffill_bfill(obs: DataFrame) -> DataFrame:
    return obs.withColumn("filled", F.coalesce(
        F.last("value", True).over(up_to_here()), F.first("value", True).over(from_here())))


def impute(obs: DataFrame, types: DataFrame, regularity: DataFrame, model_fill: DataFrame | None = None) -> DataFrame:
    """Choose the fill per series; `model_fill(profile_id, code, t_index, filled)` serves the model branch.

    Without a model table the model branch falls back to time interpolation, as when the model fit fails.
    """
    counts = F.count("value").over(by_series()), F.count(F.lit(1)).over(by_series())
    missing = 1 - counts[0] / counts[1]
    # No fill under 8 values, up to 2 % or over 85 % missing; model from 20 values and up to 60 %.
    policy = (
        F.when((counts[0] < 8) | (missing <= 0.02) | (missing > 0.85), "none")
        .when(F.col("var_type") == "binary", "ffill_bfill")
        .when((counts[0] >= 20) & (missing <= 0.60)
              & (F.coalesce("regularity", F.lit("regular_or_quasi_regular")) != "highly_irregular"), "model")
        .otherwise("interpolate"))
    tagged = (
        obs.join(types.select(*SERIES, "var_type"), SERIES, "left")
        .join(regularity.select("profile_id", "regularity"), "profile_id", "left")
        .withColumn("policy", policy))
    lined = interpolate(tagged, "ts").withColumnRenamed("filled", "lined")
    both = ffill_bfill(lined).withColumnRenamed("filled", "carried")
    if model_fill is None:
        modeled = both.withColumn("modeled", F.lit(None).cast("double"))
    else:
        modeled = both.join(model_fill.select(*SERIES, "t_index", F.col("filled").alias("modeled")), [*SERIES, "t_index"], "left")
    value = (F.when(F.col("policy") == "none", F.col("value")).when(F.col("policy") == "ffill_bfill", F.col("carried"))
             .when(F.col("policy") == "model", F.coalesce("value", "modeled", "lined")).otherwise(F.col("lined")))
    return modeled.select(*SERIES, "t_index", "ts", "value", "policy", value.alias("filled"))


# Day parts by hour, and the fewest values for weekday, hour and per-hour results.
WEEKDAY_MIN, HOUR_MIN, PER_BIN_MIN = 10, 20, 5


def calendar_features(obs: DataFrame) -> DataFrame:
    hour = F.hour("ts")
    part = F.when(hour <= 5, "Night").when(hour <= 11, "Morning").when(hour <= 17, "Afternoon").otherwise("Evening")
    seen = F.count("value")
    return (
        obs.withColumn("weekday", F.weekday("ts")).withColumn("weekend", F.col("weekday") >= 5)
        .withColumn("hour", hour).withColumn("day_part", part)
        .withColumn("weekday_ok", seen.over(by_series()) >= WEEKDAY_MIN)
        .withColumn("hour_ok", (seen.over(by_series()) >= HOUR_MIN) & (seen.over(W.partitionBy(*SERIES, "hour")) >= PER_BIN_MIN))
        .withColumn("part_ok", seen.over(W.partitionBy(*SERIES, "day_part")) >= PER_BIN_MIN))


def zscore(obs: DataFrame, value: str = "value") -> DataFrame:
    sd = F.stddev_pop(value).over(by_series())
    return obs.withColumn("z", (F.col(value) - F.avg(value).over(by_series())) / F.when(sd < 1e-12, 1.0).otherwise(sd))


def rolling_coupling(obs: DataFrame, roles: DataFrame, window: int) -> DataFrame:
    """Mean |r| between predictors and criteria in centred half-open windows of 2*(window div 2) rows.

    z-scores are population based and the products are divided by rows - 1, as in the surveyed work.
    """
    half = window // 2
    typed = obs.join(roles.select(*SERIES, "role"), SERIES).where(F.col("value").isNotNull())
    centers = F.sequence(F.greatest(F.col("t_index") - half + 1, F.lit(0)), F.col("t_index") + half)
    spread = typed.withColumn("center", F.explode(centers))
    last = obs.groupBy("profile_id").agg(F.max("t_index").alias("last"))
    spread = spread.join(last, "profile_id").where((F.col("center") >= half) & (F.col("center") <= F.col("last") - half)).drop("last")
    side = lambda role, p: spread.where(F.col("role") == role).select(
        "profile_id", "center", "t_index", F.col("code").alias(f"{p}_code"), F.col("value").alias(p))
    pairs = side("PREDICTOR", "x").join(side("CRITERION", "y"), ["profile_id", "center", "t_index"])
    stats = pairs.groupBy("profile_id", "center", "x_code", "y_code").agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("cov"),
        F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    r = F.col("n") / (F.col("n") - 1) * F.col("cov") / ((F.col("sx") + 1e-12) * (F.col("sy") + 1e-12))
    return stats.where(F.col("n") >= 3).groupBy("profile_id", "center").agg(
        F.avg(F.abs(r)).alias("coupling"), F.count(F.lit(1)).alias("n_pairs"))


def tail(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Last n rows per key; map tasks keep at most n rows per key before the shuffle."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def lag_pairs(obs: DataFrame, lag: int = 1, value: str = "value") -> DataFrame:
    """Y at t joined with every variable Z at t - lag of the same profile."""
    y = obs.select("profile_id", "t_index", F.col("code").alias("dst"), F.col(value).alias("y"))
    z = obs.select("profile_id", (F.col("t_index") + lag).alias("t_index"), F.col("code").alias("src"), F.col(value).alias("z"))
    return y.join(z, ["profile_id", "t_index"])


def assign_nearest_point(rows: DataFrame, t: Column, m: int) -> DataFrame:
    """Index of the nearest of m equally spaced points on [0, 1]; ties go to the lower index."""
    raw = F.ceil(t * (m - 1) - 0.5).cast("int")
    return rows.withColumn("time_index", F.least(F.lit(m - 1), F.greatest(F.lit(0), raw)))


def nearest_of(rows: DataFrame, points: DataFrame, keys: list[str], t: str, at: str) -> DataFrame:
    """As-of by absolute distance (to nine digits; ties go to the lower index) against arbitrary points per key, a
    bounded list of estimation points."""
    listed = points.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col("time_index")))).alias("_pts"))
    best = F.array_min(F.transform("_pts", lambda p: F.struct(F.round(F.abs(p["at"] - F.col(t)), 9).alias("d"), p["time_index"].alias("time_index"))))
    return rows.join(listed, keys).withColumn("time_index", best["time_index"]).drop("_pts")


def error_ratio_segments(ratio: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Peak of every run of points with ratio >= threshold; the series is cut after each peak but the last point."""
    w = W.partitionBy("profile_id").orderBy("time_index")
    high = F.col("ratio") >= threshold
    flagged = ratio.withColumn("high", high).withColumn(
        "run", F.sum(F.when(high & ~F.coalesce(F.lag(high).over(w), F.lit(False)), 1).otherwise(0)).over(w))
    peak = F.row_number().over(W.partitionBy("profile_id", "run", "high").orderBy(F.desc("ratio"), "time_index")) == 1
    last = F.max("time_index").over(W.partitionBy("profile_id"))
    marked = flagged.withColumn("is_peak", F.col("high") & peak).withColumn("cut", F.col("is_peak") & (F.col("time_index") < last))
    before = w.rowsBetween(W.unboundedPreceding, -1)
    return marked.select("profile_id", "time_index", "ratio", "is_peak",
                         F.coalesce(F.sum(F.col("cut").cast("int")).over(before), F.lit(0)).cast("int").alias("segment"))


def change_points(coefs: DataFrame, z_threshold: float = 2.5) -> DataFrame:
    """Frobenius distance of adjacent coefficient matrices, standardized over time."""
    w = W.partitionBy("profile_id", "dst", "src").orderBy("time_index")
    moved = coefs.select("profile_id", "time_index", (F.col("beta") - F.lag("beta").over(w)).alias("delta")).where(F.col("delta").isNotNull())
    dist = moved.groupBy("profile_id", "time_index").agg(F.sqrt(F.sum(F.col("delta") * F.col("delta"))).alias("distance"))
    p = W.partitionBy("profile_id")
    z = (F.col("distance") - F.avg("distance").over(p)) / (F.stddev_pop("distance").over(p) + 1e-12)
    return dist.withColumn("z", z).withColumn("is_change_point", F.col("z") > z_threshold)


def edge_shifts(coefs: DataFrame, k: int = 200) -> DataFrame:
    edge = ["profile_id", "dst", "src"]
    w = W.partitionBy(*edge).orderBy("time_index")
    moved = coefs.where(F.col("dst") != F.col("src")).withColumn("delta", F.abs(F.col("beta") - F.lag("beta").over(w)))
    out = moved.groupBy(*edge).agg(
        F.coalesce(F.max("delta"), F.lit(0.0)).alias("max_abs_delta"),
        F.max_by("time_index", F.struct(F.coalesce("delta", F.lit(-1.0)), -F.col("time_index"))).alias("argmax_time_index"),
        (F.max("beta") - F.min("beta")).alias("range"),
        F.when(F.count(F.lit(1)) >= 3, F.regr_slope("beta", "t")).otherwise(0.0).alias("slope"),
        F.avg("beta").alias("mean"), F.stddev_pop("beta").alias("sd"), F.min("beta").alias("min"), F.max("beta").alias("max"))
    best = W.partitionBy("profile_id").orderBy(F.desc("max_abs_delta"), F.desc("range"), "dst", "src")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def recency_weighted(df: DataFrame, keys: list[str], metrics: list[str], half_life: float, t: str = "t") -> DataFrame:
    from lagweave.functions.scores import recency_weight

    weighted = df.withColumn("_w", recency_weight(F.col(t), half_life))
    mean = lambda m: F.sum(F.col("_w") * F.coalesce(F.col(m), F.lit(0.0))) / (F.sum("_w") + 1e-12)
    return weighted.groupBy(*keys).agg(*[mean(m).alias(m) for m in metrics])


def previous_cycle_scores(history: DataFrame, window: int) -> DataFrame:
    """history(profile_id, cycle, paths array) -> best rank weight per path over the last `window` cycles."""
    recent = history.withColumn(
        "_r", F.dense_rank().over(W.partitionBy("profile_id").orderBy(F.desc("cycle")))).where(F.col("_r") <= window)
    ranked = recent.select("profile_id", F.posexplode("paths").alias("pos", "path"))
    weight = F.greatest(F.lit(0.1), 1 - F.col("pos") / 20.0)
    return ranked.groupBy("profile_id", F.lower("path").alias("path")).agg(F.max(weight).alias("previous_score"))
