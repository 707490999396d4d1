"""Target selection, model update, barriers and coping: rank, quota and fusion operators on keyed tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lagweave.core.ranking import number_rows, top_n
from lagweave.core.session import cut_lineage
from lagweave.functions import paths as P
from lagweave.functions.scores import clamp01, fraction_from_hash, norm_score
from lagweave.operators.blocks import fold_pairs, with_parts
from lagweave.operators.joins import jaccard_candidates, path_similarity_join, subsequence_match

BY = "profile_id"


def _lookup(table: Column, key: Column) -> Column:
    return F.try_element_at(table, key)


def _with_parts(df: DataFrame, path: str, name: str) -> DataFrame:
    """Segments and tokens of a path column, computed once per row before it meets others."""
    return df.withColumns({f"{name}_s": P.lower_segments(F.col(path)), f"{name}_t": P.path_tokens(F.col(path))})


def breadth_first_select(cands: DataFrame, n: int) -> DataFrame:
    """cands(profile_id, path, domain, score): best of each domain, then round-robin over the domains up to three
    times their number, then by score. The order is a closed sort key, so no loop runs.

    Round r takes every domain's r-th path in the order of the domains' best scores. Rows past rank n in their
    domain can never be taken, so map tasks cut to n per domain first.
    """
    best = top_n(cands.dropDuplicates([BY, "path"]), [BY, "domain"], [F.desc("score"), F.col("path")], n, "in_domain")
    tops = best.where("in_domain = 1").select(BY, "domain", F.col("score").alias("top"))
    order = tops.withColumn("domain_order", F.row_number().over(W.partitionBy(BY).orderBy(F.desc("top"), "domain"))).withColumn(
        "n_domains", F.count(F.lit(1)).over(W.partitionBy(BY)))
    rows = best.join(order.drop("top"), [BY, "domain"]).withColumn("limit", F.least(F.lit(n), 3 * F.col("n_domains")))
    by_round = W.partitionBy(BY).orderBy("in_domain", "domain_order")
    rows = rows.withColumn("rr", F.row_number().over(by_round))
    stage = F.when((F.col("in_domain") == 1) & (F.col("rr") <= n), 0).when(F.col("rr") <= F.col("limit"), 1).otherwise(2)
    rows = rows.withColumn("stage", stage)
    final = W.partitionBy(BY).orderBy("stage", F.when(F.col("stage") < 2, F.col("rr")), F.desc("score"), "path")
    name = F.element_at(F.array(F.lit("breadth_domain_coverage"), F.lit("breadth_round_robin"), F.lit("depth_refinement")), F.col("stage") + 1)
    return rows.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= n).select(BY, "path", "domain", "score", name.alias("stage"), "rank")


def quota_select(cands: DataFrame, quotas: dict[str, int], capped: str, cap: int, n: int) -> DataFrame:
    """cands(id, category, degree): the category minimums first, then the rest by degree, at most `cap` of one category.

    Only the best n of a category can be taken, so each map task keeps n per category.
    """
    best = top_n(cands, ["category"], [F.desc("degree"), F.col("id")], n, "in_category")
    floor = F.coalesce(_lookup(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col("category")) if quotas else F.lit(0), F.lit(0))
    kept = best.withColumn("by_quota", F.col("in_category") <= floor).where((F.col("category") != capped) | (F.col("in_category") <= cap))
    ranked = kept.withColumn("_g", F.lit(0))
    return top_n(ranked, ["_g"], [F.desc("by_quota"), F.desc("degree"), F.col("id")], n).select("id", "category", "degree", "by_quota", "rank")


def weighted_sample(df: DataFrame, key: str, weight: Column, k: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """k rows per group without replacement, probability by weight: the largest u^(1/w) win; u is a hash of key and seed."""
    u = fraction_from_hash(F.col(key), F.lit(seed))
    keyed = df.withColumn("_w", weight).where(F.col("_w") > 0).withColumn("_s", F.log(u) / F.col("_w"))
    group = by or ["_g"]
    keyed = keyed if by else keyed.withColumn("_g", F.lit(0))
    out = top_n(keyed, group, [F.desc("_s"), F.col(key)], k).drop("_w", "_s")
    return out if by else out.drop("_g")


def depth_aware_weights(depth: Column, is_leaf: Column) -> Column:
    """Shallow nodes (depth <= 1) come first, leaves count twice."""
    return F.when(depth <= 1, 1e6).otherwise(F.when(is_leaf, 2.0).otherwise(1.0))


def head_tail_sample(items: DataFrame, cluster: str, order: str, n: int, extra: int, seed: int) -> DataFrame:
    """First n, last n and `extra` hash-chosen items per cluster; the order column is unique."""
    u = fraction_from_hash(F.col(cluster), F.col(order), F.lit(seed))
    head = top_n(items, [cluster], [F.col(order)], n, "r").drop("r").withColumn("part", F.lit("head"))
    tail = top_n(items, [cluster], [F.desc(order)], n, "r").drop("r").withColumn("part", F.lit("tail"))
    tail = tail.join(head.select(cluster, order), [cluster, order], "left_anti")
    ends = head.unionByName(tail)
    rest = items.join(ends.select(cluster, order), [cluster, order], "left_anti").withColumn("u", u)
    mid = top_n(rest, [cluster], [F.col("u"), F.col(order)], extra, "r").drop("r", "u").withColumn("part", F.lit("sample"))
    return ends.unionByName(mid)


def priority_band(score: Column) -> Column:
    return (F.when(score >= 0.70, "very_high").when(score >= 0.50, "high").when(score >= 0.30, "medium").when(score >= 0.10, "low").otherwise("very_low"))


def select_targets(impact: DataFrame, k: int, min_impact: float, keep: int = 3, lone: float = 0.25) -> DataFrame:
    """Top k by impact; the first `keep` at or above min_impact are targets, else the first one from `lone`."""
    top = top_n(impact, [BY], [F.desc("predictor_impact"), F.col("predictor")], k)
    strong = F.sum((F.col("predictor_impact") >= min_impact).cast("int")).over(W.partitionBy(BY)) > 0
    target = F.when(strong, (F.col("predictor_impact") >= min_impact) & (F.col("rank") <= keep)).otherwise((F.col("rank") == 1) & (F.col("predictor_impact") >= lone))
    return top.withColumn("is_target", target).withColumn("priority", priority_band(F.col("predictor_impact")))


def top_barriers(rows: DataFrame, n: int, k: int) -> DataFrame:
    """Best n barriers per predictor, then the best k barriers per profile by their largest contribution."""
    first = top_n(rows, [BY, "predictor"], [F.desc("contribution"), F.col("barrier")], n)
    best = first.groupBy(BY, "barrier").agg(F.max("contribution").alias("score"), F.count(F.lit(1)).alias("n_predictors"))
    return top_n(best, [BY], [F.desc("score"), F.col("barrier")], k)


def apply_count_policy(ranked: DataFrame, low: int, high: int, preferred: int) -> DataFrame:
    """ranked(profile_id, item, source_priority, source_rank): own choices up to `high`, filled from lower-priority
    sources until `preferred` is reached, with reason codes. Items count once, at their best source."""
    best = ranked.groupBy(BY, "item").agg(F.min(F.struct("source_priority", "source_rank")).alias("s")).select(BY, "item", "s.*")
    order = W.partitionBy(BY).orderBy("source_priority", "source_rank", "item")
    own = F.sum((F.col("source_priority") == 0).cast("int")).over(W.partitionBy(BY))
    kept = best.withColumn("own", own).withColumn("position", F.row_number().over(order)).where(
        F.col("position") <= F.greatest(F.least(F.col("own"), F.lit(high)), F.lit(min(preferred, high))))
    total = F.count(F.lit(1)).over(W.partitionBy(BY))
    reasons = F.array_compact(F.array(
        F.when(F.col("source_priority") > 0, F.lit("filled_from_fallback")), F.when(F.col("own") > high, F.lit("cut_to_max")), F.when(total < low, F.lit("below_min"))))
    return kept.withColumn("reasons", reasons).drop("own")


def batches(df: DataFrame, key: str, n: int) -> DataFrame:
    """Batch numbers of n items in the order of a non-negative integer key."""
    return number_rows(df, [], key, "_pos").withColumn("batch", F.floor(F.col("_pos") / n)).drop("_pos")


def _largest(values: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Largest valid value of each row, NaN if none."""
    best = np.where(valid, values, -np.inf).max(axis=1)
    return np.where(np.isneginf(best), np.nan, best)


def _to_every_group(leaves: DataFrame, anchors: DataFrame) -> DataFrame:
    """The distinct leaves, once for each profile with anchors, with segments and tokens."""
    return with_parts(leaves.select("leaf").where("leaf is not null").distinct(), "leaf").crossJoin(anchors.select(BY).distinct())


def ontology_candidates(leaves: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchors(profile_id, anchor, impact) on leaf paths: .55 best token similarity + .25 shared second level + .20
    best similarity times impact. Leaves without a common token score nothing and are left out."""
    second = F.get("segs", F.lit(1)).alias("second")
    left = _to_every_group(leaves, anchors).select(BY, "leaf", second, "toks").where(F.size("toks") > 0)
    right = with_parts(anchors, "anchor").select(BY, "anchor", F.col("impact").cast("double").alias("impact"), second, "toks").where(F.size("toks") > 0)

    def fold(a, b, slices):
        level, impact, parts = pd.factorize(pd.concat([a["second"], b["second"]]))[0], b["impact"].to_numpy(float), []
        mine, theirs = level[:len(a)], level[len(a):]
        for rows, sim in slices:
            near = sim > 0
            same = near & (mine[rows, None] == theirs[None]) & (theirs[None] >= 0)
            part = a.iloc[rows].assign(best=sim.max(axis=1), same=same.any(axis=1).astype(float), anchored=_largest(sim * impact, near & ~np.isnan(impact)))
            parts.append(part[near.any(axis=1)])
        return pd.concat(parts)

    cells = fold_pairs(left, right, BY, fold, f"{BY} string, leaf string, best double, same double, anchored double", by_path=False)
    agg = cells.groupBy(BY, "leaf").agg(*[F.max(c).alias(c) for c in ("best", "same", "anchored")])
    return agg.withColumn("score", clamp01(0.55 * F.col("best") + 0.25 * F.col("same") + 0.20 * F.col("anchored")))


def _anchor_scores(leaves: DataFrame, anchors: DataFrame) -> DataFrame:
    """Largest path similarity times impact of each (profile, leaf)."""
    left = _to_every_group(leaves, anchors).select(BY, "leaf", "segs", "toks")
    right = with_parts(anchors.where("anchor is not null"), "anchor").select(BY, "anchor", F.col("impact").cast("double").alias("impact"), "segs", "toks")

    def fold(a, b, slices):
        impact, parts = b["impact"].to_numpy(float), []
        for rows, sim in slices:
            near = sim >= 1e-9
            parts.append(a.iloc[rows].assign(anchor_score=_largest(np.clip(sim * impact, 0.0, 1.0), near & ~np.isnan(impact)))[near.any(axis=1)])
        return pd.concat(parts)

    cells = fold_pairs(left, right, BY, fold, f"{BY} string, leaf string, anchor_score double", by_path=True)
    return cells.groupBy(BY, "leaf").agg(F.max("anchor_score").alias("anchor_score"))


def bfs_scores(leaves: DataFrame, mapping: DataFrame, hyde: DataFrame, anchors: DataFrame) -> DataFrame:
    """Candidate score per (profile, leaf): .45 mapping + .25 retrieval + .20 anchored impact + .10 known domain.

    mapping(profile_id, path, score): a path that is a subsequence of the leaf gives its score, else score times
    similarity from .45 up. Similarities are taken once per distinct path pair.
    """
    L = leaves.select("leaf").distinct()
    m = mapping.groupBy(BY, "path").agg(F.max("score").alias("score"))
    sub = subsequence_match(m, L).withColumn("factor", F.lit(1.0))
    sims = path_similarity_join(L, "leaf", m, "path", 0.45).select("path", "leaf", F.col("similarity").alias("factor"))
    factor = sub.unionByName(sims).groupBy("path", "leaf").agg(F.max("factor").alias("factor"))
    ms = m.join(factor, "path").groupBy(BY, "leaf").agg(F.max(F.col("score") * F.col("factor")).alias("mapping_score"))
    hs = hyde.groupBy(BY, F.lower("path").alias("_l")).agg(F.max("score").alias("hyde_score"))
    hs = L.withColumn("_l", F.lower("leaf")).join(hs, "_l").select(BY, "leaf", "hyde_score")
    an = _anchor_scores(L, anchors)
    known = mapping.select(BY, P.domain_key(F.col("path")).alias("domain")).union(anchors.select(BY, P.domain_key(F.col("anchor")))).distinct()
    dom = L.withColumn("domain", P.domain_key(F.col("leaf"))).join(known, "domain").select(BY, "leaf", F.lit(1.0).alias("domain_bonus"))
    out = ms.join(hs, [BY, "leaf"], "full_outer").join(an, [BY, "leaf"], "full_outer").join(dom, [BY, "leaf"], "full_outer").fillna(0.0)
    total = clamp01(0.45 * F.col("mapping_score") + 0.25 * F.col("hyde_score") + 0.20 * F.col("anchor_score") + 0.10 * F.col("domain_bonus"))
    return out.withColumn("score", F.round(total, 9)).withColumn("domain", P.domain_key(F.col("leaf")))


def _evidence(cands: DataFrame, predictors: DataFrame, relevance: DataFrame, impact: DataFrame) -> DataFrame:
    """Means of relevance (transfer) and impact (individual_raw) per (profile, candidate, criterion) over the profile's
    predictors, weighted by path similarity. Cells give the sums; a predictor without an impact row on a criterion counts
    there with zero, so it adds to the sum of all weights only."""
    on, full = [BY, "predictor", "criterion"], F.col(BY).isNotNull() & F.col("predictor").isNotNull() & F.col("criterion").isNotNull()
    rel = relevance.where(full & (F.col("value") > 0)).groupBy(*on).agg(F.sum("value").alias("rel"), F.count(F.lit(1)).cast("double").alias("n_rel"))
    imp = impact.where(full).groupBy(*on).agg(F.sum(F.greatest(F.lit(0.0), F.col("value"))).alias("imp"), F.count(F.lit(1)).cast("double").alias("n_imp"))
    sums = ("rel", "n_rel", "imp", "n_imp")
    listed = rel.join(imp, on, "full_outer").fillna(0.0).groupBy(BY, "predictor").agg(F.collect_list(F.struct("criterion", *sums)).alias("e")).select(
        BY, "predictor", *[F.col(f"e.{x}").alias(x) for x in ("criterion", *sums)])
    right = with_parts(predictors.where(F.col(BY).isNotNull()), "path").join(listed, [BY, "predictor"], "left").select(
        BY, "predictor", "path", "criterion", *sums, "segs", "toks")

    def fold(a, b, slices):
        has = [(i, len(x)) for i, x in enumerate(b["criterion"]) if x is not None]
        row = np.repeat([i for i, _ in has], [n for _, n in has]).astype(int)
        names, column = np.unique(np.array([x for v in b["criterion"] if v is not None for x in v], dtype=str), return_inverse=True)
        tables = {}
        for x in sums:
            tables[x] = np.zeros((len(b), len(names)))
            tables[x][row, column] = [v for values in b[x] if values is not None for v in values]
        # Repeated impact rows count repeatedly in the weights as well.
        tables["more"] = np.maximum(tables["n_imp"] - 1, 0)
        parts = []
        for rows, sim in slices:
            some = a.iloc[rows][[BY, "path"]]
            parts.append(some.assign(criterion=None, weight=sim.sum(axis=1), rel=0.0, n_rel=0.0, imp=0.0, more=0.0))
            by_name = {x: sim @ tables[x] for x in ("rel", "n_rel", "imp", "more")}
            parts += [some.assign(criterion=name, weight=0.0, **{x: v[:, k] for x, v in by_name.items()}) for k, name in enumerate(names)]
        return pd.concat(parts)

    columns = ("weight", "rel", "n_rel", "imp", "more")
    cells = fold_pairs(cands, right, BY, fold, f"{BY} string, path string, criterion string, " + ", ".join(f"{x} double" for x in columns), by_path=True)
    folded = cut_lineage(cells.groupBy(BY, "path", "criterion").agg(*[F.sum(x).alias(x) for x in columns]))
    weight = folded.where("criterion is null").select(BY, "path", F.col("weight").alias("total"))
    total = F.col("total") + F.col("more")
    return folded.where("criterion is not null").join(weight, [BY, "path"]).select(
        BY, "path", "criterion", F.when(F.col("n_rel") > 0, F.col("rel") / F.col("n_rel")).alias("transfer"), F.when(total > 0, F.col("imp") / total).alias("individual_raw"))


def _nearest_mapping(cands: DataFrame, mapping: DataFrame) -> DataFrame:
    """(profile, path, criterion_path, v): largest score times similarity over the mapping rows that are more than .20 similar."""
    best = mapping.groupBy(BY, F.col("path").alias("map_path"), F.coalesce("criterion_path", F.lit("")).alias("criterion_path")).agg(F.max("score").cast("double").alias("score"))
    right = with_parts(best, "map_path").select(BY, "map_path", "criterion_path", "score", "segs", "toks")

    def fold(a, b, slices):
        names, column = np.unique(b["criterion_path"].to_numpy(str), return_inverse=True)
        order = np.argsort(column, kind="stable")
        starts, score, parts = np.searchsorted(column[order], np.arange(len(names))), b["score"].to_numpy(float)[order], []
        for rows, sim in slices:
            sim = sim[:, order]
            v = np.maximum.reduceat(np.where(sim > 0.20, sim * score, -np.inf), starts, axis=1)
            parts += [a.iloc[rows][[BY, "path"]].assign(criterion_path=name, v=v[:, k])[v[:, k] > -np.inf] for k, name in enumerate(names)]
        return pd.concat(parts)

    return fold_pairs(cands, right, BY, fold, f"{BY} string, path string, criterion_path string, v double", by_path=True).groupBy(
        BY, "path", "criterion_path").agg(F.max("v").alias("v"))


def fuse_model(cands: DataFrame, criteria: DataFrame, predictors: DataFrame, relevance: DataFrame, impact: DataFrame, mapping: DataFrame, readiness: DataFrame) -> DataFrame:
    """Group-level and individual evidence per (profile, candidate, criterion).

    cands(profile_id, path, prior), criteria(profile_id, criterion, path), predictors(profile_id, predictor, path),
    relevance and impact(profile_id, predictor, criterion, value), mapping(profile_id, path, criterion_path, score),
    readiness(profile_id, score 0-100). Candidates meet the predictors and mapping rows of their own profile only.
    """
    share = F.greatest(F.lit(1e-6), F.col("prior"))
    group = W.partitionBy(BY, "parent")
    c = cands.withColumn("parent", P.parent_key(F.col("path"))).withColumn("size", F.count(F.lit(1)).over(group)).withColumn(
        "split", F.when(F.col("size") <= 1, 1.0).otherwise(0.5 + 0.5 * share / F.sum(share).over(group) * F.col("size"))).select(BY, "path", "prior", "split")
    named = F.col(BY).isNotNull()
    left = with_parts(c.select(BY, "path").where(named).distinct(), "path")
    evidence = _evidence(left, predictors, relevance, impact)
    m = _nearest_mapping(left, mapping.where(named & (F.col("score") > 0)))
    crit = _with_parts(criteria.select(BY, "criterion", F.col("path").alias("crit_path")), "crit_path", "k")
    mc = _with_parts(m, "criterion_path", "q").join(crit, BY)
    crit_sim = F.when(F.col("criterion_path") == "", 0.45).otherwise(P.similarity_of_parts(F.col("k_s"), F.col("q_s"), F.col("k_t"), F.col("q_t")))
    maps = mc.groupBy(BY, "path", "criterion").agg(F.max(F.col("v") * (0.35 + 0.65 * crit_sim)).alias("mapping_part"))
    on = [BY, "path", "criterion"]
    grid = c.join(criteria.select(BY, "criterion"), BY).join(evidence, on, "left").join(maps, on, "left").fillna(0.0)
    weight = readiness.select(BY, clamp01(0.30 + 0.50 * clamp01(F.col("score") / 100)).alias("w_ind"))
    out = grid.join(weight, BY, "left").fillna(0.30, ["w_ind"])
    out = out.withColumn("group_level", clamp01(0.60 * F.col("mapping_part") + 0.40 * F.col("transfer"))).withColumn("individual", clamp01(F.col("individual_raw") * F.col("split")))
    return out.withColumn("fused", clamp01((1 - F.col("w_ind")) * F.col("group_level") + F.col("w_ind") * F.col("individual")))


def rank_fused(fused: DataFrame, impact: DataFrame, n: int | None = 200) -> DataFrame:
    """Candidates ranked by the criterion-weighted means; weights are the criteria's shares of the impact, uniform if none."""
    crit = fused.select(BY, "criterion").distinct().join(impact.groupBy(BY, "criterion").agg(F.sum("value").alias("v")), [BY, "criterion"], "left").fillna(0.0, ["v"])
    w = W.partitionBy(BY)
    crit = crit.select(BY, "criterion", F.when(F.sum("v").over(w) <= 1e-12, 1 / F.count(F.lit(1)).over(w)).otherwise(F.col("v") / F.sum("v").over(w)).alias("cw"))
    mean = lambda x: clamp01(F.sum(F.col(x) * F.col("cw"))).alias(f"{x}_mean")
    out = fused.join(crit, [BY, "criterion"]).groupBy(BY, "path").agg(mean("fused"), mean("group_level"), mean("individual"), F.max("prior").alias("prior"))
    order = [F.desc("fused_mean"), F.col("path")]
    return out.withColumn("rank", F.row_number().over(W.partitionBy(BY).orderBy(*order))) if n is None else top_n(out, [BY], order, n)


def memory_fusion(ranked: DataFrame, previous: DataFrame) -> DataFrame:
    """ranked(profile_id, path, fused_mean, group_level_mean, individual_mean) with previous(profile_id, path, previous_score)."""
    j = ranked.withColumn("_l", F.lower("path")).join(previous.select(BY, F.lower("path").alias("_l"), F.col("previous_score").alias("prev")), [BY, "_l"], "left").fillna(0.0, ["prev"]).drop("_l")
    cur, prev = F.col("individual_mean"), F.col("prev")
    stable = F.when((prev > 0) & (cur > 0), 0.6).otherwise(0.0) + 0.4 * (1 - F.least(F.lit(1.0), F.abs(cur - prev)))
    mem = clamp01(0.45 * cur + 0.25 * prev + 0.20 * F.col("group_level_mean") + 0.10 * clamp01(stable))
    clash = (prev > 0.60) & (cur < 0.20)
    mem = F.when(clash, clamp01(F.least(mem, 0.40 * prev + 0.60 * cur))).otherwise(mem)
    out = j.withColumns({"stability_bonus": clamp01(stable), "memory_score": mem, "contradiction": clash})
    return out.withColumn("final_score", clamp01(0.65 * F.col("fused_mean") + 0.35 * F.col("memory_score")))


def parent_feasibility(predictors: DataFrame, parents: DataFrame, k: int = 30, min_sim: float = 0.10) -> DataFrame:
    """Best k parent domains per predictor path by (.75 suitability + .25 (1 - risk)) times path similarity."""
    sims = path_similarity_join(predictors, "path", parents, "parent_domain", min_sim)
    j = sims.join(parents, "parent_domain")
    blend = clamp01(0.75 * F.col("mean_overall_suitability") + 0.25 * (1 - F.col("mean_utility_risk")))
    scored = j.withColumn("feasibility", F.round(clamp01(blend * F.col("similarity")), 9))
    return top_n(scored, ["path"], [F.desc("feasibility"), F.col("parent_domain")], k)


def feasibility_bundle(matches: DataFrame, k: int = 30) -> DataFrame:
    out = matches.groupBy("parent_domain").agg(
        F.max("feasibility").alias("feasibility"), F.max("mean_overall_suitability").alias("suitability"), F.max("mean_utility_risk").alias("risk"), F.count(F.lit(1)).alias("support"))
    return out.orderBy(F.desc("feasibility"), F.desc("suitability"), F.asc("risk"), F.desc("support"), "parent_domain").limit(k)


def path_or_token_similarity(a: DataFrame, pa: str, b: DataFrame, pb: str, min_sim: float) -> DataFrame:
    """max(path similarity, token Jaccard) from min_sim up, per distinct path pair."""
    from lagweave.operators.joins import jaccard_join

    ta = a.select(pa).distinct().withColumn("_ta", P.path_tokens(F.col(pa)))
    tb = b.select(pb).distinct().withColumn("_tb", P.path_tokens(F.col(pb)))
    both = path_similarity_join(a, pa, b, pb, min_sim).unionByName(jaccard_join(ta, pa, "_ta", tb, pb, "_tb", min_sim))
    return both.groupBy(pa, pb).agg(F.max("similarity").alias("similarity"))


def barrier_scores(targets: DataFrame, mapping: DataFrame, n: int, min_sim: float = 0.12) -> DataFrame:
    """targets(profile_id, predictor, priority) against mapping(predictor_path, barrier, score): priority * score *
    similarity, best n rows per predictor.

    A path's largest and n-th largest score give its largest and n-th largest contribution to a target. The n-th largest
    contribution of one path and the n-th of the paths' largest ones are reached by n rows at least, so rows below them
    cannot be among the best; paths below them do not meet their barriers, and ties at the floor stay.
    """
    sims = path_or_token_similarity(targets, "predictor", mapping, "predictor_path", min_sim)
    ranked = top_n(mapping.select("predictor_path", norm_score(F.col("score")).alias("s")).where("s is not null"), ["predictor_path"], [F.desc("s")], n, "r")
    heads = ranked.groupBy("predictor_path").agg(F.max("s").alias("first"), F.max(F.when(F.col("r") == n, F.col("s"))).alias("nth"))
    value = lambda s: F.round(norm_score(F.col("priority")) * s * F.col("similarity"), 9)
    near = targets.join(sims, "predictor").join(heads, "predictor_path", "left").withColumns({"first": value(F.col("first")), "nth": value(F.col("nth"))})
    near = cut_lineage(near)
    floors = near.groupBy(BY, "predictor").agg(
        F.greatest(F.max("nth"), F.get(F.sort_array(F.collect_list("first"), asc=False), F.lit(n - 1))).alias("floor")).withColumnRenamed(BY, "_by")
    open_ = near.drop("nth").join(floors.withColumnRenamed("predictor", "_p"), F.col(BY).eqNullSafe(F.col("_by")) & (F.col("predictor") == F.col("_p")))
    kept = open_.where(F.col("floor").isNull() | (F.col("first") >= F.col("floor")))
    c = kept.join(mapping, "predictor_path").withColumn("contribution", value(norm_score(F.col("score")))).where(F.col("floor").isNull() | (F.col("contribution") >= F.col("floor")))
    return top_n(c.drop("first", "floor", "_by", "_p"), [BY, "predictor"], [F.desc("contribution"), F.col("barrier"), F.col("predictor_path")], n)


def text_barrier_scores(texts: DataFrame, mapping: DataFrame) -> DataFrame:
    """texts(profile_id, text), mapping(entity, barrier, score): score * (.25 + .75 Jaccard), best per barrier; an
    empty text gives .30 * score.

    Every barrier has a score for every text; without a common token it is a constant share of the barrier's best
    mapping score, so the result has one row for each text and barrier and that part needs no comparison of tokens.
    """
    from lagweave.functions.text import tokenize

    t = texts.withColumn("tt", tokenize(F.col("text"), "set"))
    e = mapping.select("entity").distinct().withColumn("et", tokenize(F.col("entity"), "set"))
    cand = jaccard_candidates(t.select(BY, "tt"), BY, "tt", e, "entity", "et", 1e-9).join(t.select(BY, "tt"), BY).join(e, "entity")
    sims = cand.select(BY, "entity", P.jaccard(F.col("tt"), F.col("et")).alias("sim"))
    hit = sims.join(mapping, "entity").groupBy(BY, "barrier").agg(F.max(norm_score(F.col("score")) * (0.25 + 0.75 * F.col("sim"))).alias("hit"))
    base = mapping.groupBy("barrier").agg(F.max(norm_score(F.col("score"))).alias("base"))
    share = t.select(BY, F.when(F.trim("text") == "", 0.30).otherwise(0.25).alias("f"))
    full = share.crossJoin(base).join(hit, [BY, "barrier"], "left")
    return full.select(BY, "barrier", F.round(clamp01(F.greatest(F.col("f") * F.col("base"), F.coalesce("hit", F.lit(0.0)))), 9).alias("score"))


def combine_barriers(evidence: DataFrame, complaint: DataFrame, k: int) -> DataFrame:
    """evidence(profile_id, barrier, predictor_score, profile_score, context_score) with complaint(profile_id, text):
    .60 + .20 + .15 weighted sum plus .05 token match of the complaint; best k per profile."""
    from lagweave.functions.text import tokenize

    j = evidence.join(complaint.select(BY, tokenize(F.col("text"), "set").alias("ct")), BY, "left")
    match = F.coalesce(P.jaccard(F.col("ct"), tokenize(F.col("barrier"), "set")), F.lit(0.0))
    s = lambda c: norm_score(F.coalesce(F.col(c), F.lit(0.0)))
    out = j.withColumn("complaint_match", match).withColumn(
        "total", F.round(clamp01(0.60 * s("predictor_score") + 0.20 * s("profile_score") + 0.15 * s("context_score") + 0.05 * F.col("complaint_match")), 9)).drop("ct")
    return top_n(out, [BY], [F.desc("total"), F.col("barrier")], k)


def coping_scores(barriers: DataFrame, mapping: DataFrame, per_barrier: int = 12, min_sim: float = 0.20) -> DataFrame:
    """barriers(profile_id, barrier, total), mapping(barrier_path, coping, score): best 12 per barrier, then the best
    contribution per coping option with the number of barriers behind it."""
    sims = path_or_token_similarity(barriers, "barrier", mapping, "barrier_path", min_sim)
    j = barriers.join(sims, "barrier").join(mapping, "barrier_path")
    c = j.withColumn("contribution", F.round(clamp01(norm_score(F.col("total")) * norm_score(F.col("score")) * F.col("similarity")), 9))
    kept = top_n(c, [BY, "barrier"], [F.desc("contribution"), F.col("coping"), F.col("barrier_path")], per_barrier)
    return kept.groupBy(BY, "coping").agg(F.max("contribution").alias("score"), F.count_distinct("barrier").alias("n_barriers"))


# The sd at which a predictor or a criterion counts as fully variable.
SD_SCALE = {"P": 0.15, "C": 0.90}


def quality_scores(stats: DataFrame, ready: Column) -> DataFrame:
    """.55 (1 - missing) + .20 sd over the role's scale + .25 ready."""
    scale = F.when(F.col("code").startswith("P"), SD_SCALE["P"]).otherwise(SD_SCALE["C"])
    ratio = clamp01(F.abs(F.coalesce("sd", F.lit(0.0))) / scale)
    return stats.withColumn("quality", clamp01(0.55 * clamp01(1 - F.col("missing_pct")) + 0.20 * ratio + 0.25 * ready.cast("double")))


def next_cycle_criteria(criteria: DataFrame, low: int, high: int, preferred: int) -> DataFrame:
    """criteria(profile_id, code, retained, quality, severity): all retained ones, then the best others up to the
    preferred number, at most `high`; order by quality, severity, code descending."""
    n = max(low, min(high, preferred))
    order = W.partitionBy(BY).orderBy(F.desc("retained"), F.desc("quality"), F.desc("severity"), F.desc("code"))
    kept = F.sum(F.col("retained").cast("int")).over(W.partitionBy(BY))
    return criteria.withColumn("position", F.row_number().over(order)).withColumn("_n", F.least(F.lit(high), F.greatest(kept, F.lit(n)))).where("position <= _n").drop("_n")


def next_cycle_variables(predictors: DataFrame, wanted: DataFrame, low: int, high: int, preferred: int) -> DataFrame:
    """predictors(profile_id, code, path, impact, target_score, priority, quality) and wanted(profile_id, path, rank):
    .35 best token similarity over rank + .25 impact + .15 target + .10 priority + .15 quality; the best of the
    preferred number, kept within the bounds."""
    asked = F.col(BY).isNotNull() & F.col("path").isNotNull()
    left = with_parts(predictors.where(asked).select(BY, "code", "path").distinct(), "path").select(BY, "code", "path", "toks").where(F.size("toks") > 0)
    right = with_parts(wanted.where(asked), "path").select(BY, "path", F.col("rank").cast("double").alias("rank"), "toks").where(F.size("toks") > 0)

    def fold(a, b, slices):
        rank = b["rank"].to_numpy(float)
        parts = [a.iloc[rows].assign(match=_largest(sim / rank, (sim > 0) & ~np.isnan(rank))) for rows, sim in slices]
        return pd.concat(parts).dropna(subset="match")

    m = fold_pairs(left, right, BY, fold, f"{BY} string, code string, match double", by_path=False).groupBy(BY, "code").agg(F.max("match").alias("match"))
    s = lambda c: clamp01(F.coalesce(F.col(c), F.lit(0.0)))
    j = predictors.join(m, [BY, "code"], "left")
    j = j.withColumn("score", F.round(0.35 * s("match") + 0.25 * s("impact") + 0.15 * s("target_score") + 0.10 * s("priority") + 0.15 * s("quality"), 9))
    return top_n(j, [BY], [F.desc("score"), F.desc_nulls_last("impact"), F.desc_nulls_last("priority"), F.desc("code")], max(low, min(high, preferred)))


def guardrail(scores: DataFrame, weights: dict[str, float], threshold: float) -> DataFrame:
    """scores(item, dimension, score, critical): weighted composite over all dimensions (absent ones count 0 and are
    listed), PASS at the threshold unless a critical issue is reported."""
    total = sum(weights.values())
    w = _lookup(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("dimension"))
    s = norm_score(F.col("score"), "mixed")
    agg = scores.groupBy("item").agg(F.sum(F.coalesce(w, F.lit(0.0)) / total * s).alias("composite"), F.sum(F.coalesce(F.col("critical").cast("int"), F.lit(0))).alias("n_critical"), F.collect_set("dimension").alias("_have"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(k) for k in weights]), F.col("_have")))
    out = agg.withColumn("composite", F.round(clamp01(F.col("composite")), 6)).withColumn("missing_dimensions", missing).drop("_have")
    return out.withColumn("decision", F.when((F.col("n_critical") == 0) & (F.col("composite") >= threshold), "PASS").otherwise("REVISE"))


def update_shortlist(selected: DataFrame, shortlist: DataFrame, cap: int = 20) -> DataFrame:
    """Selected paths, then the earlier shortlist, each path once at its first place, at most `cap` per profile."""
    both = selected.select(BY, "path", F.lit(0).alias("source"), "position").unionByName(shortlist.select(BY, "path", F.lit(1).alias("source"), "position"))
    first = both.groupBy(BY, P.normalize_path(F.col("path")).alias("path")).agg(F.min(F.struct("source", "position")).alias("s")).where("path != ''").select(BY, "path", "s.*")
    return top_n(first, [BY], [F.col("source"), F.col("position"), F.col("path")], cap)


def column_stats(obs: DataFrame) -> DataFrame:
    """Median, sd, padded 2-98 % bounds and missing rate per series; series are bounded by the grid."""
    q = obs.groupBy("profile_id", "code").agg(
        F.percentile("value", 0.5).alias("median"), F.stddev_samp("value").alias("sd"), F.percentile("value", 0.02).alias("_lo"), F.percentile("value", 0.98).alias("_hi"),
        (1 - F.count("value") / F.count(F.lit(1))).alias("missing_rate"))
    pad = 0.05 * (F.col("_hi") - F.col("_lo"))
    return q.select("profile_id", "code", "median", "sd", (F.col("_lo") - pad).alias("low"), (F.col("_hi") + pad).alias("high"), "missing_rate")
