"""The model tables, derived from the given parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.operators.series import to_grid

DAY, QUARTER_DAY = 86_400, 21_600

# Event types as variables of the observation model.
CODES = {"click": "P01", "view": "P02", "signup": "P03", "purchase": "C01", "error": "C02"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; zone-less timestamps are read in the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plain = {f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"}
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df


def code_of(event_type: Column) -> Column:
    expr = F
    for event, code in CODES.items():
        expr = expr.when(event_type == event, code)
    return expr


def raw_observations(spark: SparkSession, sf_dir: str, cohort: int | None = None) -> DataFrame:
    """events as (profile_id, ts, code, value); a profile is a user, or a cohort of neighbouring users."""
    user = F.col("user_id")
    profile = F.concat(F.lit("u"), user) if cohort is None else F.concat(F.lit("c"), F.floor(user / cohort))
    return table(spark, sf_dir, "events").select(
        profile.alias("profile_id"), "ts", code_of(F.col("event_type")).alias("code"), "value")


def daily_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per user and variable on a daily grid; sparse."""
    return to_grid(raw_observations(spark, sf_dir), DAY)


def cohort_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per cohort of 20 users and variable on a six-hour grid; dense enough for lag models."""
    return to_grid(raw_observations(spark, sf_dir, cohort=20), QUARTER_DAY)


def all_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_obs(spark, sf_dir).unionByName(cohort_obs(spark, sf_dir))


# The three primary domains.
PRIMARY = ["BIO", "PSYCHO", "SOCIAL"]


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a four-level predictor taxonomy, one row per predictor id."""
    primary = F.element_at(F.array(*[F.lit(p) for p in PRIMARY]), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("predictor_id"),
        primary.alias("primary"), F.col("p_type").alias("secondary"), F.col("p_brand").alias("tertiary"),
        F.concat_ws(" > ", primary, "p_type", "p_brand", F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey")))
        .alias("predictor_full_path"),
    )


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as scored (cluster, predictor) pairs, with duplicates."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("cluster_id"), F.col("l_partkey").alias("predictor_id"),
        (F.col("l_quantity") * 20 + F.col("l_linenumber")).alias("score"))
