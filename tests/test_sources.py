"""File scans and model checks on small inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagweave.operators import series as T
from lagweave.operators import tests as H
from lagweave.sources import scans as I


def test_each_file_is_split_by_its_own_separator(spark, tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    (folder / "one.csv").write_text("id;name\n1;x,y\n2;z\n")
    (folder / "two.csv").write_text("id\tname\textra\n3\tp;q\te\n")
    (folder / "three.csv").write_text("name\nonly\n")
    (folder / "empty.csv").write_text("")
    got = {r["name"]: (r["id"], r["extra"]) for r in I.scan_delimited(spark, str(folder)).collect()}
    assert got == {"x,y": ("1", None), "z": ("2", None), "p;q": ("3", "e"), "only": (None, None)}


def test_profiles_of_different_separators(spark, tmp_path):
    for name, text in (("p1", "a,b\n1,2\n"), ("p2", "a|b\n3|4\n"), ("q1", "a;b\n5;6\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "data.csv").write_text(text)
    got = sorted(tuple(r) for r in I.scan_profiles(spark, str(tmp_path), "data.csv", "p", schema="a int, b int").collect())
    assert got == [(1, 2, "p1"), (3, 4, "p2")]
    assert I.scan_profiles(spark, str(tmp_path), "data.csv", max_profiles=1).select("profile_id").distinct().count() == 1


def test_grids_count_ordered_pairs(spark):
    v = spark.createDataFrame([("m", "P1", "predictor"), ("m", "P2", "PREDICTOR"), ("m", "C1", "criterion"), ("m", " ", "PREDICTOR"), ("n", "C1", "c")], "model_id string, var_id string, role string")
    e = spark.createDataFrame([("m", "P1", "C1"), ("m", "P1", "C1"), ("m", "P1", "P2"), ("m", "P1", "P1"), ("m", "P1", "none"), ("n", "P1", "C1")], "model_id string, source string, target string")
    got = {(r["model_id"], r["kind"]): (r["n_expected"], r["n_present"], r["n_missing"]) for r in I.model_grid(v, e).collect()}
    assert got == {("m", "PC"): (2, 1, 1), ("m", "PP"): (2, 1, 1), ("m", "CC"): (0, 0, 0), ("n", "PC"): (0, 0, 0), ("n", "PP"): (0, 0, 0), ("n", "CC"): (0, 0, 0)}


def test_time_axis_takes_the_best_column(spark):
    rows = [("i", k, None if k == 2 else float(k * 10), None) for k in range(5)] + [("d", k, None, None if k == 1 else k * 86400) for k in range(5)] + [("o", k, None, None) for k in range(3)]
    df = spark.createDataFrame(rows, "profile_id string, k int, t_index double, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["profile_id"], r["k"]): (r["axis"], round(r["t_norm"], 6)) for r in T.time_axis(df, "k").collect()}
    assert [got["i", k] for k in range(5)] == [("index", k / 4) for k in range(5)]
    assert [got["d", k] for k in range(5)] == [("date", k / 4) for k in range(5)]
    assert [got["o", k] for k in range(3)] == [("order", k / 2) for k in range(3)]


def test_permutations_stand_in_for_an_undefined_tail(spark):
    rows = [(f"b{k}", "x", "y", float(k - 3)) for k in range(12)] + [(f"b{k}", "x", "z", 1.0 + k) for k in range(4)] + [(f"b{k}", "y", "z", 0.0) for k in range(9)]
    got = {(r["a"], r["b"]): (r["method"], r["p_raw"]) for r in H.paired_test(spark.createDataFrame(rows, "block string, a string, b string, diff double"), 1000).collect()}
    assert got["x", "y"][0] == "signed_rank" and got["x", "z"][0] == "sign_flip" == got["y", "z"][0]
    assert abs(got["x", "z"][1] - 2 / 16) < 0.05 and got["y", "z"][1] == 1.0
