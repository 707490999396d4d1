"""Zero-aware statistics over sparse scored edges (cluster_id, predictor_id, score) and roll-ups along hierarchies.

Missing pairs count as zero without ever being materialized: sums are divided by the declared number of pairs,
and medians are read from counted scores shifted by the number of zeros. A cluster with a third of all edges
costs no more than its distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lagweave.core.ranking import _at_rank, quantiles, top_n, value_positions

# Score buckets (name, low, high).
BUCKETS = [("1000", 1000, 1000), ("900-999", 900, 999), ("700-899", 700, 899), ("400-699", 400, 699), ("100-399", 100, 399), ("1-99", 1, 99)]


def load_edges(raw: DataFrame) -> DataFrame:
    """Trimmed ids, numeric scores in 1..1000, best score per (cluster, predictor)."""
    rest = [c for c in raw.columns if c not in ("cluster_id", "predictor_id", "score")]
    clean = raw.select(
        F.trim(F.col("cluster_id").cast("string")).alias("cluster_id"), F.trim(F.col("predictor_id").cast("string")).try_cast("int").alias("predictor_id"),
        F.col("score").try_cast("double").alias("score"), *rest).where(F.col("score").between(1, 1000) & F.col("predictor_id").isNotNull())
    return clean.groupBy("cluster_id", "predictor_id").agg(F.max("score").alias("score"), *[F.max_by(c, "score").alias(c) for c in rest])


def attach_hierarchy(edges: DataFrame, hierarchy: DataFrame, path: str | None = None) -> DataFrame:
    """Domains by predictor id, else parsed from the edge's own path, else UNKNOWN_*. The hierarchy is reduced to one
    row per id first (the first in order of its domains, taken whole), so the join cannot multiply edges."""
    levels = ["primary", "secondary", "tertiary"]
    one = hierarchy.groupBy("predictor_id").agg(F.min(F.struct(*levels)).alias("_h")).select("predictor_id", *[F.col(f"_h.{c}").alias(c) for c in levels])
    joined = edges.join(one, "predictor_id", "left")
    parsed = F.transform(F.split(F.coalesce(F.col(path), F.lit("")), ">"), lambda s: F.trim(s)) if path else F.array().cast("array<string>")
    for i, c in enumerate(levels):
        joined = joined.withColumn(c, F.coalesce(F.col(c), F.nullif(F.get(parsed, F.lit(i)), F.lit("")), F.lit(f"UNKNOWN_{c.upper()}")))
    return joined


def sparse_stats(edges: DataFrame, keys: list[str], denom: Column, value: str = "score", bounded: bool = True) -> DataFrame:
    """Mean, sd, median, min, max, % non-zero per key over `denom` pairs, absent ones being zero.

    `bounded`: the number of distinct values per key is bounded (scores of a fixed scale).
    """
    sized = edges.groupBy(*keys).agg(
        F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_s2"), F.count(value).alias("n_edges"),
        F.min(value).alias("_mn"), F.max(value).alias("max_score"), F.max(denom).alias("_d"))
    pos = value_positions(edges, keys, value, bounded).join(sized.select(*keys, "_d"), keys)
    zeros = F.col("_d") - F.col("n_total")
    lo, hi = F.floor((F.col("_d") - 1) / 2) - zeros, F.ceil((F.col("_d") - 1) / 2) - zeros
    med = pos.groupBy(*keys).agg((F.coalesce(_at_rank(value, lo), F.lit(0.0)) + F.coalesce(_at_rank(value, hi), F.lit(0.0))).alias("_m"))
    var = (F.col("_s2") - F.col("_s") * F.col("_s") / F.col("_d")) / (F.col("_d") - 1)
    return sized.join(med, keys).select(
        *keys, (F.col("_s") / F.col("_d")).alias("mean_score"), (F.col("_m") / 2).alias("median_score"),
        F.when(F.col("_d") > 1, F.sqrt(F.greatest(F.lit(0.0), var))).alias("std_score"), "max_score",
        F.when(F.col("_d") > F.col("n_edges"), 0.0).otherwise(F.col("_mn")).alias("min_score"),
        (F.col("n_edges") / F.col("_d") * 100).alias("pct_nonzero"), "n_edges")


def domain_means(edges: DataFrame, leaves: DataFrame, levels: list[str], complete: list[str] | None = None) -> DataFrame:
    """Sum of scores per (cluster, domain) over the number of leaves in the domain. `complete` names the top domains
    that every cluster must show; absent ones are zero rows."""
    denom = leaves.groupBy(*levels).agg(F.count(F.lit(1)).alias("n_leaves"))
    sums = edges.groupBy("cluster_id", *levels).agg(F.sum("score").alias("s"))
    if complete:
        spine = edges.select("cluster_id").distinct().withColumn(levels[0], F.explode(F.array(*[F.lit(x) for x in complete])))
        sums = spine.join(sums, ["cluster_id", *levels], "left")
    return sums.join(denom, levels, "left").select(
        "cluster_id", *levels, (F.coalesce("s", F.lit(0.0)) / F.coalesce("n_leaves", F.lit(1))).alias("cluster_mean_score"))


def domain_summary(means: DataFrame, levels: list[str], n_clusters: int | None = None) -> DataFrame:
    """Per domain over clusters. With `n_clusters` absent clusters count as zero, else only present rows count."""
    v = F.col("cluster_mean_score")
    nz = F.sum((v > 0).cast("long"))
    if n_clusters is None:
        base = means.groupBy(*levels).agg(
            F.count(F.lit(1)).alias("n_clusters"), F.avg(v).alias("mean_across_clusters"), F.stddev_samp(v).alias("std_across_clusters"),
            (100 * nz / F.count(F.lit(1))).alias("pct_clusters_nonzero"), F.coalesce(F.avg(F.when(v > 0, v)), F.lit(0.0)).alias("mean_nonzero_clusters"), F.max(v).alias("max_cluster_mean"))
        return base.join(quantiles(means, levels, "cluster_mean_score", {"median_across_clusters": 0.5}), levels)
    s = sparse_stats(means, levels, F.lit(n_clusters), "cluster_mean_score", bounded=False)
    return s.select(*levels, F.lit(n_clusters).alias("n_clusters"), F.col("mean_score").alias("mean_across_clusters"), F.col("median_score").alias("median_across_clusters"),
                    F.col("std_score").alias("std_across_clusters"), F.col("pct_nonzero").alias("pct_clusters_nonzero"),
                    (F.col("mean_score") * n_clusters / F.greatest(F.col("n_edges"), F.lit(1))).alias("mean_nonzero_clusters"), F.col("max_score").alias("max_cluster_mean"))


def overview(edges: DataFrame, n_clusters: int, n_predictors: int) -> DataFrame:
    """Bucket counts over all pairs; the zero bucket is what is not observed."""
    total = n_clusters * n_predictors
    counts = edges.agg(*[F.count_if(F.floor("score").between(lo, hi)).alias(name) for name, lo, hi in BUCKETS], F.count(F.lit(1)).alias("_seen"))
    rows = [F.struct(F.lit(name).alias("bucket"), F.col(f"`{name}`").alias("n_pairs")) for name, _, _ in BUCKETS]
    rows.append(F.struct(F.lit("0").alias("bucket"), (F.lit(total) - F.col("_seen")).alias("n_pairs")))
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("pct", 100 * F.col("n_pairs") / F.lit(total))


def mapping_totals(edges: DataFrame, n_clusters: int, n_predictors: int) -> DataFrame:
    total = n_clusters * n_predictors
    return edges.agg(
        F.lit(n_clusters).alias("n_clusters"), F.lit(n_predictors).alias("n_predictors"), F.count(F.lit(1)).alias("n_edges"),
        (F.sum("score") / total).alias("mean_with_zeros"), F.avg("score").alias("mean_nonzero"), (100 * F.count(F.lit(1)) / total).alias("pct_nonzero"), F.max("score").alias("max_score"))


def pair_scores(raw: DataFrame, left: str, right: str, score: str = "score") -> DataFrame:
    """One row per pair: mean of duplicate scores, nulls ignored."""
    return raw.groupBy(left, right).agg(F.avg(F.col(score).try_cast("double")).alias("score"))


def topk_mapping(raw: DataFrame, left: str, right: str, rollup: str, shape: tuple[int, int], k: int | None = None,
                 left_ids: DataFrame | None = None, right_ids: DataFrame | None = None) -> DataFrame:
    """Corrected (missing pairs are zero) and uncorrected means.

    rollup: `left` one row per left id over the right side, `right` the reverse, `both` one overall row, `pairs` none (all
    pairs, or the k best).
    `shape` is the size of the full matrix; given id lists (one column) replace their side and get zero rows.
    """
    if left_ids is not None:
        raw = raw.join(left_ids, left, "left_semi")
    if right_ids is not None:
        raw = raw.join(right_ids, right, "left_semi")
    pairs = pair_scores(raw, left, right)
    n_left = left_ids.distinct().count() if left_ids is not None else shape[0]
    n_right = right_ids.distinct().count() if right_ids is not None else shape[1]
    stats = lambda total: [
        F.avg("score").alias("avg_uncorrected"), (F.coalesce(F.sum("score"), F.lit(0.0)) / total).alias("avg_corrected"),
        F.count(F.lit(1)).alias("pairs_present"), (F.lit(total) - F.count("score")).alias("missing_total")]
    if rollup == "both":
        return pairs.agg(*stats(n_left * n_right)).withColumn("pairs_total", F.lit(n_left * n_right))
    if rollup == "pairs":
        return pairs if k is None else pairs.orderBy(F.desc_nulls_last("score"), left, right).limit(k)
    key, ids, n_other = (left, left_ids, n_right) if rollup == "left" else (right, right_ids, n_left)
    out = pairs.groupBy(key).agg(*stats(n_other))
    if ids is not None:
        out = ids.distinct().join(out, key, "left").fillna(0, ["avg_corrected", "pairs_present"]).fillna(n_other, ["missing_total"])
    if k is not None:
        out = out.orderBy(F.desc("avg_corrected"), F.desc_nulls_last("avg_uncorrected"), key).limit(k)
    return out


def top_edges(edges: DataFrame, k: int, per: str | None = None) -> DataFrame:
    order = [F.desc("score"), F.col("cluster_id"), F.col("predictor_id")]
    if per is None:
        return edges.orderBy(*order).limit(k)
    return top_n(edges, [per], [F.desc("score"), F.col("cluster_id"), F.col("predictor_id")], k)


def filter_edges(edges: DataFrame, q: float, min_abs: float, k: int, fallback: int = 2000) -> DataFrame:
    """Edges at or above max(quantile, min_abs), then the top k per left and per right node, unioned; if nothing
    passes, the `fallback` best edges."""
    found = quantiles(edges.withColumn("_g", F.lit(0)), ["_g"], "score", {"cut": q}).first()
    kept = edges.where(F.col("score") >= max(min_abs, found["cut"] if found else min_abs))
    by_left = top_n(kept, ["cluster_id"], [F.desc("score"), F.col("predictor_id")], k).drop("rank")
    by_right = top_n(kept, ["predictor_id"], [F.desc("score"), F.col("cluster_id")], k).drop("rank")
    out = by_left.union(by_right).distinct()
    if out.limit(1).count() == 0:
        return edges.orderBy(F.desc("score"), "cluster_id", "predictor_id").limit(fallback)
    return out


def densify(edges: DataFrame, left: str, right: str, rights: list, how=F.max) -> DataFrame:
    """Wide view over a given list of right ids, 0 for missing; the long table stays primary."""
    return edges.groupBy(left).pivot(right, rights).agg(how("score")).fillna(0.0)


def complete_grid(variables: DataFrame, edges: DataFrame, left_role: str, right_role: str) -> DataFrame:
    """All ordered pairs of a model's own variables by role (no self pairs), 0 where no edge is given."""
    a = variables.where(F.col("role") == left_role).select("model_id", F.col("var_id").alias("source"))
    b = variables.where(F.col("role") == right_role).select("model_id", F.col("var_id").alias("target"))
    grid = a.join(b, "model_id").where(F.col("source") != F.col("target"))
    best = edges.groupBy("model_id", "source", "target").agg(F.max("score").alias("score"))
    return grid.join(best, ["model_id", "source", "target"], "left").fillna(0.0, ["score"])


def topk_incoming(grid: DataFrame, low: int, high: int, min_score: float = 0.0) -> DataFrame:
    """Best `high` incoming edges per target; beyond the first `low`, only those above `min_score`. Adds a tier label."""
    w = W.partitionBy("model_id", "target").orderBy(F.desc("score"), "source")
    ranked = grid.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= high)
    tier = (F.when(F.col("score") < 0.10, "very_low").when(F.col("score") < 0.30, "low").when(F.col("score") < 0.55, "medium").when(F.col("score") < 0.80, "high").otherwise("very_high"))
    return ranked.where((F.col("rank") <= low) | (F.col("score") > min_score)).withColumn("tier", tier)


def audit_selection(grid: DataFrame, chosen: DataFrame, low: int, high: int, gap: float = 0.10) -> DataFrame:
    """Per target: number chosen against the bounds, and best omitted minus worst included."""
    flagged = grid.join(chosen.select("model_id", "source", "target").withColumn("chosen", F.lit(True)), ["model_id", "source", "target"], "left").fillna(False, ["chosen"])
    out = flagged.groupBy("model_id", "target").agg(
        F.count_if("chosen").alias("n_chosen"), (F.max(F.when(~F.col("chosen"), F.col("score"))) - F.min(F.when(F.col("chosen"), F.col("score")))).alias("optimality_gap"))
    return out.withColumn("count_ok", F.col("n_chosen").between(low, high)).withColumn("suboptimal", F.coalesce(F.col("optimality_gap") >= gap, F.lit(False)))


def mass_tables(matrix: DataFrame, left: str = "predictor", right: str = "criterion", value: str = "impact", by: str = "profile_id") -> DataFrame:
    share = lambda *keys: F.col(value) / (F.sum(value).over(W.partitionBy(*keys)) + 1e-12)
    return matrix.select(by, left, right, value, share(by).alias("share_global"), share(by, left).alias("share_in_left"), share(by, right).alias("share_in_right"),
                         F.sum(value).over(W.partitionBy(by, left)).alias("left_strength"), F.sum(value).over(W.partitionBy(by, right)).alias("right_strength"))


def weighted_suitability(scores: DataFrame, weights: DataFrame, entity: str) -> DataFrame:
    """Likert 1..9 scores -> risks -> modules -> dimensions -> suitability, renormalizing over what is present.

    weights(dimension, module, feature, w_feature, w_module, w_dimension).
    """
    risk = scores.where(F.col("score").isNotNull()).join(weights, ["dimension", "module", "feature"]).withColumn("risk", (F.greatest(F.lit(1.0), F.least(F.lit(9.0), F.col("score"))) - 1) / 8)
    mean = lambda v, w: F.sum(F.col(w) * F.col(v)) / F.sum(w)
    modules = risk.groupBy(entity, "dimension", "module").agg(mean("risk", "w_feature").alias("module_risk"), F.max("w_module").alias("w_module"), F.max("w_dimension").alias("w_dimension"))
    dims = modules.groupBy(entity, "dimension").agg(mean("module_risk", "w_module").alias("dimension_risk"), F.min("module_risk").alias("best_module_risk"), F.max("w_dimension").alias("w_dimension"))
    return dims.groupBy(entity).agg((1 - mean("dimension_risk", "w_dimension")).alias("overall_suitability"), F.min("best_module_risk").alias("best_method_risk"), F.count(F.lit(1)).alias("n_dimensions"))


def risk_contributions(scores: DataFrame, weights: DataFrame, entity: str) -> DataFrame:
    """Normalized weight product times risk per leaf feature."""
    j = scores.where(F.col("score").isNotNull()).join(weights, ["dimension", "module", "feature"]).withColumn("risk", (F.greatest(F.lit(1.0), F.least(F.lit(9.0), F.col("score"))) - 1) / 8)
    over = lambda w, *k: F.col(w) / F.sum(w).over(W.partitionBy(entity, *k))
    m = j.groupBy(entity, "dimension", "module").agg(F.max("w_module").alias("w_module"), F.max("w_dimension").alias("w_dimension"))
    d = m.groupBy(entity, "dimension").agg(F.max("w_dimension").alias("w_dimension")).withColumn("nd", over("w_dimension")).drop("w_dimension")
    m = m.withColumn("nm", over("w_module", "dimension")).drop("w_module", "w_dimension")
    j = j.withColumn("nf", over("w_feature", "dimension", "module"))
    return j.join(m, [entity, "dimension", "module"]).join(d, [entity, "dimension"]).select(
        entity, "dimension", "module", "feature", (F.col("nf") * F.col("nm") * F.col("nd") * F.col("risk")).alias("contribution"))


def global_contributions(contributions: DataFrame) -> DataFrame:
    return contributions.groupBy("dimension", "module", "feature").agg(F.avg("contribution").alias("mean_contribution"), F.count(F.lit(1)).alias("n"))


def parent_domain_scores(frame: DataFrame, levels: int = 2) -> DataFrame:
    """frame(path, overall_suitability, utility_risk) rolled up to the first path levels."""
    from lagweave.functions.paths import parent_domain

    keyed = frame.withColumn("parent_domain", parent_domain(F.col("path"), levels)).where(F.col("parent_domain") != "")
    return keyed.groupBy("parent_domain").agg(
        F.count("path").alias("n_predictors"), F.avg("overall_suitability").alias("mean_overall_suitability"),
        F.max("overall_suitability").alias("max_overall_suitability"), F.avg("utility_risk").alias("mean_utility_risk"))


def majority_label(members: DataFrame, cluster: str, label: str) -> DataFrame:
    counts = members.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(cluster).agg(F.min_by(F.struct(F.col(label), F.col("n")), F.struct(-F.col("n"), F.col(label))).alias("m"), F.sum("n").alias("n_members")).select(
        cluster, F.col(f"m.{label}").alias("majority"), F.col("m.n").alias("votes"), "n_members")


def rank_stability(lists: DataFrame) -> DataFrame:
    """lists(run_id, profile_id, rank, path, score): presence and spread of each path over a profile's runs."""
    runs = lists.groupBy("profile_id").agg(F.count_distinct("run_id").alias("n_runs"))
    per = lists.groupBy("profile_id", "path").agg(
        F.count_distinct("run_id").alias("n_present_runs"), F.avg("rank").alias("mean_rank"), F.stddev_pop("rank").alias("std_rank"),
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"))
    return per.join(runs, "profile_id").select("profile_id", "path", "n_present_runs", (F.col("n_present_runs") / F.col("n_runs")).alias("presence_frequency"), "mean_rank", "std_rank", "mean_score", "std_score")


def stability_domains(stability: DataFrame, n: int) -> DataFrame:
    from lagweave.functions.paths import parent_domain

    top = top_n(stability, ["profile_id"], [F.desc("presence_frequency"), F.col("mean_rank"), F.col("path")], n)
    return top.groupBy("profile_id", parent_domain(F.col("path"), 1).alias("domain")).agg(F.count(F.lit(1)).alias("n_paths"), F.sum("mean_score").alias("total_score"))


def mapping_digest(rows: DataFrame, k: int = 30) -> DataFrame:
    """Rows per part, distinct criteria, and the k best predictors by best score."""
    totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.nullif(F.trim("criterion_path"), F.lit(""))).alias("n_criteria"))
    best = rows.groupBy("part", "predictor_path").agg(F.max("score").alias("best_score"))
    return top_n(best, ["part"], [F.desc("best_score"), F.col("predictor_path")], k).join(totals, "part")


def violation_rate(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Share of judged parent-child pairs in violation, per subtree and in total (null subtree)."""
    j = edges.join(verdicts, ["parent", "child"], "left")
    return j.rollup("domain").agg(F.count(F.lit(1)).alias("n_pairs"), F.count("violated").alias("n_judged"), F.avg(F.col("violated").cast("double")).alias("violation_rate"))


def upsert_entities(rows: DataFrame) -> DataFrame:
    """Entities by normalized label: longest label shown, union of the (few) sources and evidence per entity."""
    from lagweave.functions.text import fold_label

    keyed = rows.withColumn("key", fold_label(F.col("label"))).where(F.col("key") != "")
    return keyed.groupBy("key").agg(
        F.min_by("label", F.struct(-F.length("label"), F.col("label"))).alias("label"), F.count(F.lit(1)).alias("n_rows"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("evidence")).alias("evidence"))


def binary_matrix(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct (left, right) pairs with a flag; the long form of the 0/1 matrix."""
    return edges.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(left, right).distinct().withColumn("linked", F.lit(1))
