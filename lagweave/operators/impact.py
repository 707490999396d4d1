"""Robust composites of edge and predictor impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lagweave.functions.scores import clamp01, recency_weight
from lagweave.operators.series import recency_weighted

# Component weights (name -> weight, direction) and the base and local shares.
EDGE_BASE = {"beta_abs_recent": (0.28, 1), "beta_last_abs": (0.12, 1), "pcorr_abs_recent": (0.12, 1), "pcorr_last_abs": (0.06, 1),
             "focus_recent": (0.10, 1), "stability_recent": (0.12, 1), "precision_recent": (0.08, 1), "change_last": (0.12, -1)}
EDGE_LOCAL = {"local_pred_out_strength_abs": (0.18, 1), "local_crit_in_strength_abs": (0.18, 1), "local_pr_mean_pagerank": (0.10, 1),
              "local_pr_mean_eigenvector": (0.10, 1), "local_pr_mean_katz": (0.08, 1), "local_pr_mean_betweenness": (0.06, 1),
              "local_pr_mean_closeness": (0.05, 1), "local_pr_mean_participation": (0.05, 1), "local_pr_mean_core_number": (0.10, 1)}
PRED_BASE = {"edge_impact_to_criteria": (0.55, 1), "delta_mse_criteria": (0.20, 1), "out_strength_criteria_mean": (0.15, 1), "nonzero_fraction_mean": (0.10, 1)}
PRED_LOCAL = {"local_out_strength_abs": (0.22, 1), "local_out_strength_signed": (0.08, 1), "local_pagerank": (0.12, 1), "local_eigenvector": (0.10, 1),
              "local_katz": (0.08, 1), "local_betweenness": (0.08, 1), "local_closeness": (0.06, 1), "local_participation": (0.10, 1), "local_core_number": (0.06, 1)}
SHARES = (0.60, 0.40)
NODE_METRICS = ["in_strength_abs", "out_strength_abs", "out_strength_signed", "pagerank", "betweenness", "closeness", "eigenvector", "katz", "core_number", "participation_coeff"]
HALF_LIFE = 0.20


def robust_minmax(df: DataFrame, by: list[str], cols: list[str], lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """Add `<col>_norm` in [0, 1] between two quantiles of the group; flat or all-null columns and null cells give 0.5.

    Groups are the edges or predictors of one profile, bounded by its variables, so window percentiles are small.
    """
    w = W.partitionBy(*by)

    def norm(c: str) -> Column:
        a, b = F.percentile(c, lo).over(w), F.percentile(c, hi).over(w)
        return F.when(F.col(c).isNull() | a.isNull() | (b <= a + 1e-12), 0.5).otherwise(clamp01((F.col(c) - a) / (b - a)))

    return df.withColumns({f"{c}_norm": norm(c) for c in cols})


def composite(df: DataFrame, by: list[str], stages: list[tuple[dict, float]], out: str) -> DataFrame:
    """Weighted sum over stages (components, share); each contribution is kept as `contrib__<name>`. A component that
    the frame lacks counts 0.5."""
    names = [c for comp, _ in stages for c in comp]
    absent = [c for c in names if c not in df.columns]
    df = df.withColumns({c: F.lit(None).cast("double") for c in absent}) if absent else df
    df = robust_minmax(df, by, names)
    contribs = {}
    for comp, share in stages:
        total = sum(w for w, _ in comp.values())
        for c, (w, sign) in comp.items():
            x = F.col(f"{c}_norm") if sign > 0 else 1 - F.col(f"{c}_norm")
            contribs[f"contrib__{c}"] = F.lit(w / total * share) * x
    df = df.withColumns(contribs)
    return df.withColumn(out, sum(F.col(k) for k in contribs))


def node_metrics_recent(nodes: DataFrame, half_life: float = HALF_LIFE, metrics: list[str] = NODE_METRICS) -> DataFrame:
    return recency_weighted(nodes, ["profile_id", "node"], metrics, half_life)


def edge_features(coefs: DataFrame, node_recent: DataFrame, half_life: float = HALF_LIFE, predictors: str = "P", criteria: str = "C") -> DataFrame:
    """coefs(profile_id, time_index, t, dst, src, beta, pcorr[, ci_low, ci_high]) -> one row per predictor-criterion edge."""
    edges = coefs.where(F.col("src").startswith(predictors) & F.col("dst").startswith(criteria))
    if "ci_low" not in edges.columns:
        edges = edges.withColumns({"ci_low": F.lit(None).cast("double"), "ci_high": F.lit(None).cast("double")})
    ab = F.abs("beta")
    focus = ab / (F.sum(ab).over(W.partitionBy("profile_id", "time_index", "src")) + 1e-12)
    order = W.partitionBy("profile_id", "src", "dst").orderBy("time_index")
    e = edges.withColumns({"focus": focus, "w": recency_weight(F.col("t"), half_life), "before": F.lag("beta").over(order)})
    total = F.sum("w") + 1e-12
    mean = lambda x: F.sum(F.col("w") * x) / total
    last = lambda c: F.max_by(c, "time_index")
    f = e.groupBy("profile_id", F.col("src").alias("predictor"), F.col("dst").alias("criterion")).agg(
        mean(ab).alias("beta_abs_recent"), F.abs(last("beta")).alias("beta_last_abs"), mean(F.col("beta")).alias("beta_signed_recent"),
        mean(F.abs("pcorr")).alias("pcorr_abs_recent"), F.abs(last("pcorr")).alias("pcorr_last_abs"), mean(F.col("focus")).alias("focus_recent"),
        (1 / (1 + F.stddev_pop(ab))).alias("stability_recent"), F.coalesce(1 / (1 + F.sum(F.col("w") * (F.col("ci_high") - F.col("ci_low"))) / total), F.lit(0.0)).alias("precision_recent"),
        F.coalesce(F.abs(last("beta") - F.max_by("before", "time_index")), F.lit(0.0)).alias("change_last"))
    p = node_recent.select("profile_id", F.col("node").alias("predictor"), *[F.col(m).alias(f"p_{m}") for m in NODE_METRICS])
    c = node_recent.select("profile_id", F.col("node").alias("criterion"), *[F.col(m).alias(f"c_{m}") for m in NODE_METRICS])
    j = f.join(p, ["profile_id", "predictor"]).join(c, ["profile_id", "criterion"])
    both = {"pagerank": "pagerank", "eigenvector": "eigenvector", "katz": "katz", "betweenness": "betweenness", "closeness": "closeness", "participation": "participation_coeff", "core_number": "core_number"}
    j = j.withColumns({f"local_pr_mean_{k}": 0.5 * (F.col(f"p_{m}") + F.col(f"c_{m}")) for k, m in both.items()})
    j = j.withColumns({"local_pred_out_strength_abs": F.col("p_out_strength_abs"), "local_crit_in_strength_abs": F.col("c_in_strength_abs")})
    return j.drop(*[f"{s}_{m}" for s in "pc" for m in NODE_METRICS])


def edge_impact(features: DataFrame) -> DataFrame:
    out = composite(features, ["profile_id"], [(EDGE_BASE, SHARES[0]), (EDGE_LOCAL, SHARES[1])], "edge_impact")
    out = out.withColumn("edge_impact_signed", F.col("edge_impact") * F.signum(F.coalesce("beta_signed_recent", F.lit(0.0))))
    order = W.partitionBy("profile_id").orderBy(F.desc(F.round("edge_impact", 9)), "predictor", "criterion")
    return out.withColumn("edge_rank", F.row_number().over(order))


def criterion_weights(node_recent: DataFrame, criteria: str = "C") -> DataFrame:
    """Share of the incoming strength; uniform when a profile has none."""
    w = W.partitionBy("profile_id")
    x = F.greatest(F.lit(0.0), F.col("in_strength_abs"))
    total, n = F.sum(x).over(w), F.count(F.lit(1)).over(w)
    return node_recent.where(F.col("node").startswith(criteria)).select("profile_id", F.col("node").alias("criterion"), F.when(total <= 1e-12, 1 / n).otherwise(x / total).alias("criterion_weight"))


def predictor_impact(edges: DataFrame, node_recent: DataFrame, weights: DataFrame, importance: DataFrame | None = None) -> DataFrame:
    """Edge impact weighted over criteria, optional importance columns, local metrics, composite and rank."""
    toward = edges.join(weights, ["profile_id", "criterion"]).groupBy("profile_id", "predictor").agg(F.sum(F.col("criterion_weight") * F.col("edge_impact")).alias("edge_impact_to_criteria"))
    if importance is not None:
        cols = [c for c in ("delta_mse_criteria", "out_strength_criteria_mean", "nonzero_fraction_mean") if c in importance.columns]
        toward = toward.join(importance.select("profile_id", "predictor", *[F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.col(c))).alias(c) if c == "delta_mse_criteria" else F.col(c) for c in cols]), ["profile_id", "predictor"], "left")
    names = {"participation_coeff": "participation"}
    local = node_recent.select("profile_id", F.col("node").alias("predictor"), *[F.col(m).alias(f"local_{names.get(m, m)}") for m in NODE_METRICS if m != "in_strength_abs"])
    out = composite(toward.join(local, ["profile_id", "predictor"]), ["profile_id"], [(PRED_BASE, SHARES[0]), (PRED_LOCAL, SHARES[1])], "predictor_impact")
    order = W.partitionBy("profile_id").orderBy(F.desc(F.round("predictor_impact", 9)), "predictor")
    return out.withColumn("predictor_impact_pct", 100 * F.col("predictor_impact")).withColumn("predictor_rank", F.row_number().over(order))


def coef_source(tv: DataFrame, static: DataFrame) -> DataFrame:
    """Time-varying coefficients where a profile has them, else the static ones as a single point at t = 1."""
    only = static.join(tv.select("profile_id").distinct(), "profile_id", "left_anti").withColumns({"time_index": F.lit(0), "t": F.lit(1.0)})
    return tv.withColumn("impact_source", F.lit("time_varying")).unionByName(only.withColumn("impact_source", F.lit("stationary")), allowMissingColumns=True)


def impact_matrix(edges: DataFrame, predictors: list[str], value: str = "edge_impact") -> DataFrame:
    """Criterion by predictor view over a given list of predictors, 0 for missing."""
    return edges.groupBy("profile_id", "criterion").pivot("predictor", predictors).agg(F.avg(value)).fillna(0.0)
