from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagweave.functions import paths as P
from lagweave.operators import blocks as B
from lagweave.operators import selection as Z

WORDS = ["field", "Water", "gate 12", "a", "Hay", "hay cut", "feed", "x_1", ""]


def some_paths(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [" / ".join(rng.choices(WORDS, k=rng.randint(0, 5))) for _ in range(n)]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(B, "LEFT_ROWS", 4)
    monkeypatch.setattr(B, "RIGHT_ROWS", 5)


def every_pair(spark, seed: int = 1):
    """Groups g, h and null with left and right paths (some twice) and a value, and all their pairs with similarities."""
    left = [(k, x) for k, s in (("g", 1), ("h", 2), (None, 3)) for x in some_paths(17, seed + s)]
    right = [(k, x, i % 7 / 7.0) for k, s in (("g", 4), ("h", 5), (None, 6)) for i, x in enumerate(some_paths(23, seed + s))]
    a = spark.createDataFrame(left, "profile_id string, leaf string")
    b = spark.createDataFrame(right, "profile_id string, anchor string, impact double")
    return a, b


def test_folded_similarities_are_those_of_all_pairs(spark, small_blocks):
    a, b = every_pair(spark)
    a = a.distinct()
    sim = P.path_similarity(F.col("leaf"), F.col("anchor"))
    tok = P.jaccard(P.path_tokens(F.col("leaf")), P.path_tokens(F.col("anchor")))
    pairs = a.join(b.withColumnRenamed("profile_id", "k"), F.col("profile_id").eqNullSafe(F.col("k"))).select("profile_id", "leaf", sim.alias("p"), tok.alias("t"))
    want = {(r["profile_id"], r["leaf"]): (r["p"], r["t"], r["n"]) for r in pairs.groupBy("profile_id", "leaf").agg(F.sum("p").alias("p"), F.max("t").alias("t"), F.count(F.lit(1)).alias("n")).collect()}

    def fold(x, y, slices):
        return pd.concat([x.iloc[rows].assign(total=s.sum(axis=1), best=s.max(axis=1), n=float(len(y))) for rows, s in slices])

    got = {}
    for by_path in (True, False):
        cells = B.fold_pairs(B.with_parts(a, "leaf"), B.with_parts(b, "anchor"), "profile_id", fold, "profile_id string, leaf string, total double, best double, n double", by_path)
        assert cells.count() > len(want)
        for r in cells.groupBy("profile_id", "leaf").agg(F.sum("total").alias("total"), F.max("best").alias("best"), F.sum("n").alias("n")).collect():
            got[by_path, r["profile_id"], r["leaf"]] = r
    assert len(got) == 2 * len(want)
    for (k, leaf), (p, t, n) in want.items():
        assert got[True, k, leaf]["total"] == pytest.approx(p) and got[False, k, leaf]["best"] == pytest.approx(t) and got[True, k, leaf]["n"] == n


def test_candidates_and_anchor_scores_need_no_table_of_pairs(spark, small_blocks):
    leaves, anchors = every_pair(spark, 40)
    all_leaves = leaves.select("leaf").distinct()
    pairs = all_leaves.crossJoin(anchors)
    tok = P.jaccard(P.path_tokens(F.col("leaf")), P.path_tokens(F.col("anchor")))
    want = pairs.withColumn("t", tok).where("t > 0").groupBy("profile_id", "leaf").agg(F.max("t").alias("b"), F.max(F.col("t") * F.col("impact")).alias("a"))
    out = Z.ontology_candidates(all_leaves, anchors)
    key = lambda r: (r["profile_id"], r["leaf"])
    found = {key(r): (r["best"], r["anchored"]) for r in out.collect()}
    assert found == {key(r): (pytest.approx(r["b"]), pytest.approx(r["a"])) for r in want.collect()} and len(found) > 60
    assert "explode(toks" not in out._jdf.queryExecution().optimizedPlan().toString() and "explode(at" not in out._jdf.queryExecution().optimizedPlan().toString()
    sim = P.path_similarity(F.col("leaf"), F.col("anchor"))
    best = pairs.withColumn("s", sim).where("s >= 1e-9").groupBy("profile_id", "leaf").agg(F.max(F.col("s") * F.col("impact")).alias("v"))
    scored = {key(r): r["anchor_score"] for r in Z._anchor_scores(all_leaves, anchors).collect()}
    assert scored == {key(r): pytest.approx(r["v"]) for r in best.collect()}


def test_next_cycle_matches_wanted_of_the_own_profile(spark, small_blocks):
    a, b = every_pair(spark, 70)
    preds = a.distinct().select("profile_id", F.col("leaf").alias("code"), F.col("leaf").alias("path"), *[F.lit(0.0).alias(c) for c in ("impact", "target_score", "priority", "quality")])
    wanted = b.select("profile_id", F.col("anchor").alias("path"), (F.col("impact") * 7 + 1).cast("int").alias("rank"))
    tok = P.jaccard(P.path_tokens(F.col("code")), P.path_tokens(F.col("path")))
    best = preds.select("profile_id", "code").join(wanted, "profile_id").withColumn("m", tok / F.col("rank")).groupBy("profile_id", "code").agg(F.max("m").alias("m"))
    want = {(r["profile_id"], r["code"]): r["m"] for r in best.collect()}
    got = Z.next_cycle_variables(preds, wanted, 2, 50, 50).collect()
    assert len(got) == preds.count() and any(r["score"] > 0.01 for r in got)
    assert all(r["score"] == pytest.approx(0.35 * want.get((r["profile_id"], r["code"]), 0.0), abs=1e-8) for r in got)


def test_fused_evidence_is_weighted_over_all_predictors(spark, small_blocks):
    a, b = every_pair(spark, 90)
    cands = a.where("profile_id is not null").distinct().select("profile_id", F.col("leaf").alias("path"), F.lit(0.5).alias("prior"))
    preds = b.distinct().select("profile_id", F.concat("anchor", F.col("impact").cast("string")).alias("predictor"), F.col("anchor").alias("path"), "impact")
    criteria = cands.select("profile_id").distinct().withColumn("criterion", F.explode(F.array(F.lit("C0"), F.lit("C1")))).withColumn("path", F.lit("field / Water"))
    # C1 has no impact row for some predictors, and one of the others comes twice.
    values = preds.withColumn("criterion", F.explode(F.array(F.lit("C0"), F.lit("C1")))).where("criterion = 'C0' or impact > 0.3").withColumn("value", F.col("impact") - 0.2)
    values = values.unionByName(values.where("impact > 0.8")).select("profile_id", "predictor", "criterion", "value")
    maps = b.select("profile_id", F.col("anchor").alias("path"), F.when(F.col("impact") > 0.5, "field / a").alias("criterion_path"), F.col("impact").alias("score"))
    ready = cands.select("profile_id").distinct().withColumn("score", F.lit(50.0))
    got = {(r["profile_id"], r["path"], r["criterion"]): r for r in Z.fuse_model(cands, criteria, preds.drop("impact"), values, values, maps, ready).collect()}
    near = cands.select("profile_id", "path").join(preds.select("profile_id", "predictor", F.col("path").alias("p")), "profile_id").withColumn("s", P.path_similarity(F.col("path"), F.col("p"))).where("s > 0")
    own = near.join(criteria.select("profile_id", "criterion"), "profile_id").join(values, ["profile_id", "predictor", "criterion"], "left").fillna(0.0, ["value"])
    want = own.groupBy("profile_id", "path", "criterion").agg((F.sum(F.col("s") * F.greatest(F.lit(0.0), "value")) / F.sum("s")).alias("v"),
                                                             F.try_divide(F.sum(F.when(F.col("value") > 0, F.col("s") * F.col("value"))), F.sum(F.when(F.col("value") > 0, F.col("s")))).alias("t")).collect()
    assert len(got) == 2 * cands.count() and want
    for r in want:
        row = got[r["profile_id"], r["path"], r["criterion"]]
        assert row["individual_raw"] == pytest.approx(r["v"]) and row["transfer"] == pytest.approx(r["t"] or 0.0)
    near_maps = cands.select("profile_id", "path").join(maps.withColumnRenamed("path", "p"), "profile_id").withColumn("s", P.path_similarity(F.col("path"), F.col("p"))).where("s > 0.2 and score > 0")
    crit = F.when(F.col("criterion_path").isNull(), 0.45).otherwise(P.path_similarity(F.lit("field / Water"), F.col("criterion_path")))
    for r in near_maps.groupBy("profile_id", "path").agg(F.max(F.col("s") * F.col("score") * (0.35 + 0.65 * crit)).alias("v")).collect():
        assert got[r["profile_id"], r["path"], "C0"]["mapping_part"] == pytest.approx(r["v"])
