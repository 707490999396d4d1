from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.operators import readiness as R
from lagweave.operators import series as T
from lagweave.operators.tests import stationarity


def test_label_cap(spark):
    rows = [("FullyReady", R.TIER3, R.STATIC), ("FullyReady", R.TIER3, R.TV), ("Ready_High", R.TIER1, None), ("bogus", R.TIER3, R.TV)]
    df = spark.createDataFrame(rows, "p string, t string, v string")
    got = [r[0] for r in df.select(R.cap_label(F.col("p"), F.col("t"), F.col("v"))).collect()]
    assert got == ["Ready_High", "FullyReady", "PartiallyReady_High", "NotReady"]


def test_execution_plan(spark):
    df = spark.createDataFrame([("a", R.TIER2, None), ("b", R.TIER3, R.STATIC)], "profile_id string, tier string, variant string")
    got = {r["profile_id"]: r for r in R.execution_plan(df).collect()}
    assert (got["a"]["analysis_set"], got["a"]["run_time_varying"], got["a"]["run_static"], got["a"]["run_correlation"]) == ("tier2_contemporaneous", False, False, True)
    assert (got["b"]["analysis_set"], got["b"]["run_time_varying"], got["b"]["run_static"]) == ("tier3_static_lagged", False, True)
    every = R.execution_plan(df, all_methods=True).first()
    assert every["run_time_varying"] and every["run_static"] and every["run_correlation"]


def series(spark, values, profile="p", code="P01"):
    rows = [(profile, code, i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "profile_id string, code string, t_index int, value double").withColumn("ts", F.timestamp_seconds(F.col("t_index") * 86400))


def test_gaps_and_fills(spark):
    obs = series(spark, [None, 1, None, None, 4, None])
    assert T.longest_gap(obs).first()["max_consecutive_missing"] == 2
    assert [r["filled"] for r in T.interpolate(obs).orderBy("t_index").collect()] == pytest.approx([1, 1, 2, 3, 4, 4])
    assert [r["filled"] for r in T.ffill_bfill(obs).orderBy("t_index").collect()] == [1, 1, 1, 1, 4, 4]


def test_all_missing_variable_is_hard_dropped(spark):
    stats = R.variable_drop_reasons(R.variable_table(series(spark, [None] * 6)))
    row = stats.first()
    assert row["drop_level"] == "hard" and row["hard_reasons"] == ["all_missing", "missing", "no_variability"]


def test_unknown_outlier_share_costs_nothing(spark):
    stats = R.variable_table(series(spark, [1, 2, 3, 4.5])).select(R.quality_score().alias("q"))
    assert stats.first()["q"] == 100.0


def test_stationarity_tells_noise_from_a_walk(spark):
    rng = np.random.default_rng(3)
    noise, walk = rng.normal(size=200), np.cumsum(rng.normal(size=200))
    obs = series(spark, noise, code="noise").unionByName(series(spark, walk, code="walk"))
    got = {r["code"]: r for r in stationarity(obs).collect()}
    assert got["noise"]["stationary"] is True and got["noise"]["adf_p"] < 0.01
    assert got["walk"]["stationary"] is False


def test_grid_spreads_and_fills(spark):
    rows = [("a", "P01", 0, 1.0), ("a", "P01", 10, 3.0), ("a", "P01", 200_000, 5.0), ("a", "C01", 90_000, 7.0)]
    raw = spark.createDataFrame(rows, "profile_id string, code string, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted((r["code"], r["t_index"], r["value"]) for r in T.to_grid(raw, 86_400).collect())
    assert got == [("C01", 0, None), ("C01", 1, 7.0), ("C01", 2, None), ("P01", 0, 2.0), ("P01", 1, None), ("P01", 2, 5.0)]
