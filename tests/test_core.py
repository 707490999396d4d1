"""Exactness of the skew-safe building blocks against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagweave.core.ranking import mid_ranks, number_rows, quantiles, value_positions
from lagweave.functions import paths as P
from lagweave.functions import scores as C
from lagweave.functions import tails
from lagweave.functions.text import stem


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows under one key, with heavy ties."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.where(rng.random(3000) < 0.66, "hot", "cold"), "v": np.round(rng.lognormal(3, 1, 3000), 1)})
    return pdf, spark.createDataFrame(pdf).cache()


def test_positions_match_between_the_two_ways(skewed):
    _, df = skewed
    split = value_positions(df, ["k"], "v", bounded=False, bins=16).toPandas().sort_values(["k", "v"]).reset_index(drop=True)
    whole = value_positions(df, ["k"], "v", bounded=True).toPandas().sort_values(["k", "v"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(split, whole, check_dtype=False)


def test_quantiles_are_exact(skewed):
    pdf, df = skewed
    got = quantiles(df, ["k"], "v", {"q1": 0.25, "q5": 0.5, "q98": 0.98}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert got.loc[k].tolist() == pytest.approx(np.quantile(g["v"], [0.25, 0.5, 0.98]).tolist())


def test_mid_ranks(skewed):
    pdf, df = skewed
    got = mid_ranks(df, ["k"], "v").toPandas().set_index(["k", "v"])["mid_rank"]
    pdf = pdf.assign(r=pdf.groupby("k")["v"].rank())
    want = pdf.groupby(["k", "v"])["r"].first()
    assert got.sort_index().tolist() == pytest.approx(want.sort_index().tolist())


def test_number_rows_crosses_chunks(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("o"), (F.col("id") % 2).alias("k"))
    got = number_rows(df, ["k"], "o", "pos", chunk=50).toPandas()
    want = got.sort_values("o").groupby("k").cumcount()
    assert (got.loc[want.index, "pos"] == want).all()


def test_path_similarity_examples(spark):
    rows = [("BIO / Sleep / Sleep_Routines / Consistent_Bedtime", "BIO / Sleep"), ("[A] > B > *C*", "A / C"), ("A / B", "C / D"), ("", "A")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(P.path_similarity(F.col("a"), F.col("b"))).collect()]
    # tokens 2 of 4, prefix 2 of 4, subsequence; single letters are no tokens.
    assert got == pytest.approx([0.45 * 0.5 + 0.35 * 0.5 + 0.20, 0.35 / 3 + 0.20, 0.0, 0.0])


def test_decimal_comma_and_clamp(spark):
    got = spark.createDataFrame([("0,72000",), ("x",), (None,)], "s string").select(C.clamp01(C.parse_decimal_comma(F.col("s")))).collect()
    assert [r[0] for r in got] == [0.72, None, None]


def test_stem_rules(spark):
    words = ["studies", "sleeping", "ring", "bed", "activities", "national"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(stem(F.col("w"))).collect()]
    assert got == ["study", "sleep", "ring", "bed", "activity", "nation"]


def test_tails_against_closed_forms(spark):
    df = spark.createDataFrame([(1.5,), (4.0,), (12.0,)], "x double")
    got = df.select(tails.p_chi2(F.col("x"), F.lit(2.0)), tails.p_t(F.col("x"), F.lit(1.0)), tails.p_f(F.col("x"), F.lit(2.0), F.lit(2.0))).collect()
    for (x,), (chi, t, f) in zip([(1.5,), (4.0,), (12.0,)], got):
        assert chi == pytest.approx(np.exp(-x / 2), rel=1e-9)
        assert t == pytest.approx(1 - 2 / np.pi * np.arctan(x), rel=1e-8)
        assert f == pytest.approx(1 / (1 + x), rel=1e-8)


def test_corr_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(C.corr("x", "y")).first()[0] is None


def test_path_similarity_parses_a_row_once(spark):
    rows = spark.createDataFrame([("A / b / C", "a / c"), ("x", "y / x"), (None, "a")], "a string, b string")
    got = P.with_similarity(rows, F.col("a"), F.col("b"), "s")
    want = rows.select(P.path_similarity(F.col("a"), F.col("b")).alias("s"))
    assert [r["s"] for r in got.collect()] == [r["s"] for r in want.collect()]
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all") == 2 and got.columns == ["a", "b", "s"]
