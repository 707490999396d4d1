"""Readiness from the observation grid to the nested report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.core.session import cut_lineage
from lagweave.operators import readiness as R
from lagweave.operators import series as T
from lagweave.operators.describe import correlation_matrix
from lagweave.operators.network import collinearity_drop
from lagweave.operators.tests import stationarity


def scored(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per profile with tier, score and label; one row per series with the ready flag)."""
    obs = cut_lineage(obs)
    stats = cut_lineage(R.variable_drop_reasons(R.variable_table(obs, stationarity(obs))))
    method = R.choose_corr_method(stats.where(~F.coalesce(F.col("drop_level") == "hard", F.lit(False)))).select("profile_id", "method")
    both = correlation_matrix(obs, "pearson").withColumn("method", F.lit("pearson")).unionByName(correlation_matrix(obs, "spearman").withColumn("method", F.lit("spearman")))
    pairs = cut_lineage(both.join(method, ["profile_id", "method"]).where(F.abs("r") >= R.LIMITS.high_corr))
    drop = collinearity_drop(pairs, stats, R.LIMITS.high_corr)
    regularity = T.sampling_regularity(T.filled_times(obs), ["profile_id"])
    tiers = cut_lineage(R.readiness_tiers(obs, stats, regularity, drop))
    ready = R.ready_variables(stats, tiers, drop)
    high = pairs.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n_high"))
    return R.readiness_score(ready, tiers, high), ready


def report(obs: DataFrame) -> DataFrame:
    return R.readiness_report(scored(obs)[0])
