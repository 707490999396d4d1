"""From the observation grid to ranked predictor impact, routed by each profile's execution plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.core.session import cut_lineage
from lagweave.operators import graph as G
from lagweave.operators import impact as I
from lagweave.operators import network as N
from lagweave.operators import readiness as R
from lagweave.operators import series as T
from lagweave.plans import readiness


def node_table(coefs: DataFrame, threshold: float = 1e-10) -> DataFrame:
    """All node metrics of every (profile, time) graph."""
    edges, nodes = cut_lineage(G.build_edges(coefs, threshold)), cut_lineage(G.nodes_of(coefs))
    und = cut_lineage(G.undirected(edges))
    out = G.node_strength(edges, nodes)
    for part in (G.pagerank(edges, nodes), G.spectral_centrality(edges, nodes), G.closeness(G.shortest_paths(edges, nodes), nodes), G.betweenness(edges, nodes),
                 G.core_number(und, nodes), G.participation(und, G.communities(und, nodes))):
        out = out.join(part, [*G.KEY, "node"], "left")
    times = coefs.select(*G.KEY, "t").distinct()
    return cut_lineage(out.join(times, G.KEY))


@dataclass
class Fits:
    """What the flow has fitted: the plan of every profile, z-scored series, their lag rows, CV's choice, coefficients with
    their source, and bootstrap intervals of the time-varying ones."""

    plan: DataFrame
    z: DataFrame
    rows: DataFrame
    params: DataFrame
    coefs: DataFrame
    intervals: DataFrame


def selected_obs(obs: DataFrame, stats: DataFrame) -> DataFrame:
    """Series of the variables that the network selection keeps, in profiles with at least two of them."""
    kept = R.select_network_variables(stats).where("selected").select(*T.SERIES, "var_type")
    two = kept.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("profile_id")
    return obs.join(kept.join(two, "profile_id", "left_semi").select(*T.SERIES), T.SERIES, "left_semi")


def filled_obs(obs: DataFrame, stats: DataFrame) -> DataFrame:
    """Gaps filled by each series' policy, the model branch by the lag-model fill; what the policy leaves is interpolated."""
    regularity = T.sampling_regularity(T.filled_times(obs), ["profile_id"])
    policy = T.impute(obs, stats, regularity, N.var_fill(obs))
    return T.interpolate(policy.select(*T.SERIES, "t_index", "ts", F.col("filled").alias("value"))).select(*T.SERIES, "t_index", "ts", F.col("filled").alias("value"))


def fit(obs: DataFrame, draws: int = N.DRAWS) -> Fits:
    """Readiness plan, variable selection, fill, bandwidth search, then the fits that the plan asks for. A profile's rows
    reach the time-varying search, fit and bootstrap only if its plan runs them; the static model serves every profile
    that the plan does not leave at descriptives."""
    obs = cut_lineage(obs)
    scored, stats = readiness.scored(obs)
    plan = cut_lineage(R.execution_plan(scored))
    stats = cut_lineage(stats)
    chosen = cut_lineage(selected_obs(obs, stats))
    filled = cut_lineage(filled_obs(chosen, stats))
    z = cut_lineage(T.zscore(filled).select("profile_id", "code", "t_index", F.col("z").alias("value")))
    rows = cut_lineage(N.lag_rows(z))
    varying, lagged = plan.where("run_time_varying").select("profile_id"), plan.where("not run_descriptives_only").select("profile_id")
    plain = N.lag_rows(filled.drop("ts")).join(varying, "profile_id", "left_semi")
    params = cut_lineage(N.select_tv_params(plain).select("profile_id", "bandwidth", "alpha"))
    tv_rows = rows.join(varying, "profile_id", "left_semi")
    tv, static = N.fit_tv_var(tv_rows, params), N.fit_static_var(rows.join(lagged, "profile_id", "left_semi"))
    coefs = cut_lineage(I.coef_source(tv, static))
    return Fits(plan, z, rows, params, coefs, cut_lineage(N.bootstrap_ci(tv_rows, params, draws)))


def predictor_table(obs: DataFrame, draws: int = N.DRAWS) -> DataFrame:
    """Ranked predictor impact of every profile with coefficients, with their source."""
    f = fit(obs, draws)
    recent = cut_lineage(I.node_metrics_recent(node_table(f.coefs)))
    features = I.edge_features(f.coefs.join(f.intervals.drop("n_draws"), ["profile_id", "time_index", "dst", "src"], "left"), recent)
    edges = cut_lineage(I.edge_impact(features))
    # One static point stands for all points when rows are predicted from their nearest one.
    points = F.when(F.col("impact_source") == "stationary", F.sequence(F.lit(0), F.lit(N.POINTS - 1))).otherwise(F.array("time_index"))
    everywhere = f.coefs.withColumn("time_index", F.explode(points))
    importance = N.coef_importance(f.coefs).join(N.loo_importance(f.z, everywhere, N.POINTS), ["profile_id", "predictor"])
    out = I.predictor_impact(edges, recent, I.criterion_weights(recent), importance)
    return out.join(f.coefs.select("profile_id", "impact_source").distinct(), "profile_id")
