from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lagweave.functions.scores import recency_weight
from lagweave.operators import impact as I
from lagweave.operators import joins as J
from lagweave.operators import mapping as MP
from lagweave.operators import retrieval as X
from lagweave.operators import selection as Z
from lagweave.operators.hierarchy import parse_tree_lines

LEAVES = ["FIELD / Water / Canals / Gate_Height", "FIELD / Water / Canals / Night_Flow", "FIELD / Water / Wells / Pump_Hours",
          "STABLE / Feed / Hay / Cut_Length", "STABLE / Feed / Hay / Dry_Weight", "MARKET / Price / Grain / Weekly_Quote"]


def test_breadth_first_covers_domains_first(spark):
    leaves = spark.createDataFrame([(x,) for x in LEAVES], "leaf string")
    mapping = spark.createDataFrame([("q", "FIELD / Water / Canals", 0.71), ("q", "STABLE / Feed / Hay", 0.64), ("q", "MARKET / Price", 0.12)], "profile_id string, path string, score double")
    empty = spark.createDataFrame([], "profile_id string, path string, score double")
    anchors = spark.createDataFrame([("q", LEAVES[3], 0.37)], "profile_id string, anchor string, impact double")
    scored = Z.bfs_scores(leaves, mapping, empty, anchors).withColumnRenamed("leaf", "path")
    got = Z.breadth_first_select(scored.select("profile_id", "path", "domain", "score"), 6).orderBy("rank").collect()
    assert [r["stage"] for r in got[:3]] == ["breadth_domain_coverage"] * 3 and len({r["domain"] for r in got[:3]}) == 3
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)


def test_target_selection(spark):
    rows = [("q", "P11", .77), ("q", "P07", .58), ("q", "P03", .44), ("q", "P09", .41), ("q", "P02", .16), ("q", "P05", .02)]
    imp = spark.createDataFrame(rows, "profile_id string, predictor string, predictor_impact double")
    got = Z.select_targets(imp, 5, 0.40).orderBy("rank").collect()
    assert [r["predictor"] for r in got] == ["P11", "P07", "P03", "P09", "P02"] and [r["is_target"] for r in got] == [True, True, True, False, False]
    assert [r["priority"] for r in got] == ["very_high", "high", "medium", "medium", "low"]
    assert [r["predictor"] for r in Z.select_targets(imp, 5, 0.95).where("is_target").collect()] == ["P11"]
    assert Z.select_targets(imp.where("predictor_impact < 0.2"), 5, 0.95).where("is_target").count() == 0


def test_recency_weights(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "t double").select(recency_weight(F.col("t"), 0.20).alias("w"))
    w = [r["w"] for r in df.collect()]
    assert w[2] == 1.0 and w[2] > w[1] > w[0] and w[1] == pytest.approx(math.exp(-math.log(2) * 2.5))


def test_all_null_component_is_neutral(spark):
    df = spark.createDataFrame([("p", None), ("p", None)], "profile_id string, x double")
    assert [r["x_norm"] for r in I.robust_minmax(df, ["profile_id"], ["x"]).collect()] == [0.5, 0.5]


def test_tree_lines(spark):
    text = ["[FIELD]", "└─ Water", "  └─ Gate (ID:5)", "└─ Soil", "  └─ Salt (ID:41)", "  └─ Humus (ID:6)", "[MARKET]", "└─ Quote (ID:90)"]
    got = parse_tree_lines(spark.createDataFrame([("t", i, x) for i, x in enumerate(text)], "doc_id string, line_no int, text string")).orderBy("leaf_id").collect()
    assert [(r["leaf_id"], r["leaf"], r["primary"], r["secondary"]) for r in got] == [
        (5, "Gate", "FIELD", "Water"), (6, "Humus", "FIELD", "Soil"), (41, "Salt", "FIELD", "Soil"), (90, "Quote", "MARKET", "UNKNOWN_SECONDARY")]


def test_path_join_is_complete(spark):
    """The blocked join finds exactly the pairs of the full comparison, at several thresholds."""
    from lagweave.functions.paths import path_similarity

    names = ["FIELD", "Water", "Low_Gate", "Water_Low", "Gate", "Yard"]
    paths = sorted({" / ".join((names[i % 6], names[(i * 5 + 1) % 6], names[(i * i) % 6])[: 1 + i % 3]) for i in range(60)})
    a = spark.createDataFrame([(p,) for p in paths], "pa string")
    b = a.withColumnRenamed("pa", "pb")
    full = a.join(b, F.col("pa") <= F.col("pb")).withColumn("s", path_similarity(F.col("pa"), F.col("pb"))).cache()
    for cut in (0.1, 0.35, 0.66):
        want = {(r["pa"], r["pb"]) for r in full.where(F.col("s") >= cut).collect()}
        got = {(r["pa"], r["pb"]) for r in J.path_similarity_join(a, "pa", b, "pb", cut).where("pa <= pb").collect()}
        assert got == want


def test_jaccard_join_is_complete_under_a_hot_token(spark):
    docs = [(i, ["hot"] + [f"t{(i * k) % 11}" for k in range(1, 2 + i % 4)]) for i in range(60)]
    df = spark.createDataFrame(docs, "a int, ta array<string>").withColumn("ta", F.array_distinct("ta"))
    other = df.select(F.col("a").alias("b"), F.col("ta").alias("tb"))
    sets = {r["a"]: set(r["ta"]) for r in df.collect()}
    want = {(i, j) for i in sets for j in sets if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6}
    assert {(r["a"], r["b"]) for r in J.jaccard_join(df, "a", "ta", other, "b", "tb", 0.6).collect()} == want


def test_sparse_median_with_zeros(spark):
    edges = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate([5, 7, 9])], "cluster_id string, predictor_id int, score double")
    for total, want in ((3, 7.0), (4, 6.0), (5, 5.0), (6, 2.5), (9, 0.0)):
        assert MP.sparse_stats(edges, ["cluster_id"], F.lit(total)).first()["median_score"] == want


def test_guardrail_lists_missing(spark):
    s = spark.createDataFrame([("i", "a", 0.8, False), ("i", "b", 60.0, False)], "item string, dimension string, score double, critical boolean")
    row = Z.guardrail(s, {"a": 2.0, "b": 1.0, "c": 1.0}, 0.5).first()
    assert row["missing_dimensions"] == ["c"] and row["composite"] == pytest.approx(0.55) and row["decision"] == "PASS"


def test_rank_fusion_weights(spark):
    pool = spark.createDataFrame([(1, 1, 0.9, 2.0, 0.1, 0.2), (1, 2, 0.1, 0.0, 0.5, 0.3)], "query_id int, vec_id int, emb double, bm25 double, tok double, fuz double")
    got = {r["vec_id"]: r["rrf"] for r in X.rrf(pool).collect()}
    assert got[1] == pytest.approx(0.80 / 61 + 0.12 / 61 + 0.05 / 62 + 0.03 / 62)
    assert got[2] == pytest.approx(0.80 / 62 + 0.05 / 61 + 0.03 / 61)


def test_barriers_below_the_floor_meet_no_target(spark):
    """The best rows are those of all pairs, also where rounding makes ties, scores are missing or paths have few barriers."""
    paths = ["FIELD / Water", "FIELD / Feed", "STABLE / Feed", "MARKET"]
    mapping = [(p, f"b{(i * 7) % 31:02d}", None if i % 13 == 5 else 0.2 + 0.01 * (i % 17) + (i % 3) * 1e-7) for k, p in enumerate(paths) for i in range((31, 20, 3, 2)[k])]
    m = spark.createDataFrame(mapping, "predictor_path string, barrier string, score double")
    targets = [(q, x, p) for q in ("q", None) for x, p in zip(LEAVES, (0.7, 1e-6, 0.0, 0.31, 0.4, None))] + [("q", LEAVES[0], 0.7)]
    t = spark.createDataFrame(targets, "profile_id string, predictor string, priority double")
    got = Z.barrier_scores(t, m, 5)
    sims = Z.path_or_token_similarity(t, "predictor", m, "predictor_path", 0.12)
    every = t.join(sims, "predictor").join(m, "predictor_path").withColumn("c", F.round(F.col("priority") * F.col("score") * F.col("similarity"), 9)).collect()
    best = {}
    for r in every:
        best.setdefault((r["profile_id"], r["predictor"]), []).append((r["c"] is None, -(r["c"] or 0.0), r["barrier"], r["predictor_path"]))
    found = {}
    for r in got.orderBy("rank").collect():
        found.setdefault((r["profile_id"], r["predictor"]), []).append((r["contribution"] is None, -(r["contribution"] or 0.0), r["barrier"], r["predictor_path"]))
    assert found == {k: sorted(v)[:5] for k, v in best.items()} and len(found) >= 10
    assert "floor" in got._jdf.queryExecution().optimizedPlan().toString()
