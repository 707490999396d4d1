"""Queries on impact composites, target selection, barriers and the next cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagweave.catalog import fragments as S
from lagweave.catalog.mapping import likert, weights_of, SCORES_SQL
from lagweave.catalog.network import CUT, EDGES, K, segment_coefs
from lagweave.catalog.registry import joined, query, rounded
from lagweave.catalog.retrieval import PRIM, PTOK, SEGS, similarity_sql
from lagweave.core.session import cut_lineage
from lagweave.operators import graph as G
from lagweave.operators import impact as I
from lagweave.operators import mapping as MP
from lagweave.operators import selection as Z
from lagweave.operators import series as T
from lagweave.sources import tables as M
from lagweave.sources.tables import table

# Node metrics that SQL can also build stand in for the graph metrics; C06_full_impact uses the real ones.
NODES = f"""{EDGES}, i AS (SELECT {K}, dst node, count(*) n, sum(aw) a FROM ed GROUP BY ALL), o AS (SELECT {K}, src node, count(*) n, sum(aw) a, sum(w) s FROM ed GROUP BY ALL), tt AS (SELECT DISTINCT {K}, t FROM cf),
nm AS (SELECT nd.profile_id, nd.time_index, node, t, coalesce(i.a, 0) in_strength_abs, coalesce(o.a, 0) out_strength_abs, coalesce(o.s, 0) out_strength_signed, coalesce(i.n, 0) / 4 pagerank, coalesce(o.n, 0) / 4 betweenness, coalesce(i.a, 0) + coalesce(o.a, 0) closeness, coalesce(i.a, 0) * 0.5 eigenvector, 1 + coalesce(i.a, 0) katz, coalesce(i.n, 0) + coalesce(o.n, 0) core_number, coalesce(o.a, 0) * 0.25 participation_coeff
 FROM nd LEFT JOIN i USING (profile_id, time_index, node) LEFT JOIN o USING (profile_id, time_index, node) JOIN tt ON tt.profile_id = nd.profile_id AND tt.time_index = nd.time_index),
nr AS (SELECT profile_id, node, {', '.join(f"sum(exp(-ln(2) / 0.2 * (1 - t)) * {m}) / (sum(exp(-ln(2) / 0.2 * (1 - t))) + 1e-12) {m}" for m in I.NODE_METRICS)} FROM nm GROUP BY ALL)"""


def simple_nodes(coefs):
    edges, nodes = G.build_edges(coefs, CUT), G.nodes_of(coefs)
    s = G.node_strength(edges, nodes).join(coefs.select(*G.KEY, "t").distinct(), G.KEY)
    c = F.col
    return s.select(*G.KEY, "node", "t", "in_strength_abs", "out_strength_abs", "out_strength_signed", (c("in_degree") / 4).alias("pagerank"), (c("out_degree") / 4).alias("betweenness"),
                    (c("in_strength_abs") + c("out_strength_abs")).alias("closeness"), (c("in_strength_abs") * 0.5).alias("eigenvector"), (1 + c("in_strength_abs")).alias("katz"),
                    (c("in_degree") + c("out_degree")).cast("double").alias("core_number"), (c("out_strength_abs") * 0.25).alias("participation_coeff"))


FEAT = f"""{NODES}, pc AS (SELECT *, exp(-ln(2) / 0.2 * (1 - t)) wt, abs(beta) / (sum(abs(beta)) OVER (PARTITION BY {K}, src) + 1e-12) focus, lag(beta) OVER (PARTITION BY profile_id, src, dst ORDER BY time_index) bp FROM cf WHERE src LIKE 'P%' AND dst LIKE 'C%'),
ef AS (SELECT profile_id, src predictor, dst criterion, sum(wt * abs(beta)) / (sum(wt) + 1e-12) beta_abs_recent, abs(arg_max(beta, time_index)) beta_last_abs, sum(wt * beta) / (sum(wt) + 1e-12) beta_signed_recent, sum(wt * abs(pcorr)) / (sum(wt) + 1e-12) pcorr_abs_recent, abs(arg_max(pcorr, time_index)) pcorr_last_abs,
 sum(wt * focus) / (sum(wt) + 1e-12) focus_recent, 1 / (1 + stddev_pop(abs(beta))) stability_recent, 1 / (1 + sum(wt * (ci_high - ci_low)) / (sum(wt) + 1e-12)) precision_recent, coalesce(abs(arg_max(beta, time_index) - arg_max(bp, time_index)), 0) change_last FROM pc GROUP BY ALL),
fe AS (SELECT ef.*, p.out_strength_abs local_pred_out_strength_abs, c.in_strength_abs local_crit_in_strength_abs, 0.5 * (p.pagerank + c.pagerank) local_pr_mean_pagerank, 0.5 * (p.eigenvector + c.eigenvector) local_pr_mean_eigenvector, 0.5 * (p.katz + c.katz) local_pr_mean_katz,
 0.5 * (p.betweenness + c.betweenness) local_pr_mean_betweenness, 0.5 * (p.closeness + c.closeness) local_pr_mean_closeness, 0.5 * (p.participation_coeff + c.participation_coeff) local_pr_mean_participation, 0.5 * (p.core_number + c.core_number) local_pr_mean_core_number
 FROM ef JOIN nr p ON p.profile_id = ef.profile_id AND p.node = predictor JOIN nr c ON c.profile_id = ef.profile_id AND c.node = criterion)"""


def _norm(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR quantile_cont({c}, 0.98) OVER w <= quantile_cont({c}, 0.02) OVER w + 1e-12 THEN 0.5 ELSE least(1.0, greatest(0.0, ({c} - quantile_cont({c}, 0.02) OVER w) / (quantile_cont({c}, 0.98) OVER w - quantile_cont({c}, 0.02) OVER w))) END"


def _composite(stages) -> str:
    terms = []
    for comp, share in stages:
        total = sum(w for w, _ in comp.values())
        terms += [f"{w / total * share} * ({_norm(c) if sign > 0 else '1 - ' + _norm(c)})" for c, (w, sign) in comp.items()]
    return " + ".join(terms)


IMPACT = f"""{FEAT}, ei AS (SELECT profile_id, predictor, criterion, beta_signed_recent, {_composite([(I.EDGE_BASE, 0.6), (I.EDGE_LOCAL, 0.4)])} edge_impact FROM fe WINDOW w AS (PARTITION BY profile_id)),
cw AS (SELECT profile_id, node criterion, CASE WHEN sum(in_strength_abs) OVER w <= 1e-12 THEN 1.0 / count(*) OVER w ELSE in_strength_abs / sum(in_strength_abs) OVER w END criterion_weight FROM nr WHERE node LIKE 'C%' WINDOW w AS (PARTITION BY profile_id)),
pf AS (SELECT profile_id, predictor, sum(criterion_weight * edge_impact) edge_impact_to_criteria FROM ei JOIN cw USING (profile_id, criterion) GROUP BY ALL),
pj AS (SELECT pf.*, out_strength_abs local_out_strength_abs, out_strength_signed local_out_strength_signed, pagerank local_pagerank, eigenvector local_eigenvector, katz local_katz, betweenness local_betweenness, closeness local_closeness, participation_coeff local_participation, core_number local_core_number,
 CAST(NULL AS DOUBLE) delta_mse_criteria, CAST(NULL AS DOUBLE) out_strength_criteria_mean, CAST(NULL AS DOUBLE) nonzero_fraction_mean FROM pf JOIN nr ON nr.profile_id = pf.profile_id AND nr.node = predictor),
pi AS (SELECT profile_id, predictor, {_composite([(I.PRED_BASE, 0.6), (I.PRED_LOCAL, 0.4)])} predictor_impact FROM pj WINDOW w AS (PARTITION BY profile_id))"""


def features(spark, d):
    coefs = segment_coefs(spark, d)
    recent = cut_lineage(I.node_metrics_recent(simple_nodes(coefs)))
    return cut_lineage(I.edge_features(coefs, recent)), recent


def impacts(spark, d):
    f, recent = features(spark, d)
    edges = cut_lineage(I.edge_impact(f))
    return edges, cut_lineage(I.predictor_impact(edges, recent, I.criterion_weights(recent))), recent


BASE_COLS = ["beta_abs_recent", "beta_last_abs", "beta_signed_recent", "pcorr_abs_recent", "pcorr_last_abs", "focus_recent", "stability_recent", "precision_recent", "change_last", "local_pred_out_strength_abs", "local_crit_in_strength_abs", "local_pr_mean_pagerank", "local_pr_mean_core_number"]


@query("C01_robust_minmax", f"{FEAT} SELECT profile_id, predictor, criterion, round({_norm('beta_abs_recent')}, 6) beta_abs_recent_norm, round({_norm('change_last')}, 6) change_last_norm FROM fe WINDOW w AS (PARTITION BY profile_id)")
def c01(spark, d):
    return rounded(I.robust_minmax(features(spark, d)[0], ["profile_id"], ["beta_abs_recent", "change_last"]).select("profile_id", "predictor", "criterion", "beta_abs_recent_norm", "change_last_norm"))


@query("C02_composite", f"{FEAT} SELECT profile_id, predictor, criterion, round({_composite([(I.EDGE_BASE, 1.0)])}, 6) base_score FROM fe WINDOW w AS (PARTITION BY profile_id)")
def c02(spark, d):
    return rounded(I.composite(features(spark, d)[0], ["profile_id"], [(I.EDGE_BASE, 1.0)], "base_score").select("profile_id", "predictor", "criterion", "base_score"))


@query("C03_edge_features", f"{FEAT} SELECT profile_id, predictor, criterion, {', '.join(f'round({c}, 6) {c}' for c in BASE_COLS)} FROM fe")
def c03(spark, d):
    return rounded(features(spark, d)[0].select("profile_id", "predictor", "criterion", *BASE_COLS))


@query("C04_edge_impact", f"{IMPACT} SELECT profile_id, predictor, criterion, round(edge_impact, 6) edge_impact, round(edge_impact * sign(beta_signed_recent), 6) edge_impact_signed, row_number() OVER (PARTITION BY profile_id ORDER BY round(edge_impact, 9) DESC, predictor, criterion) edge_rank FROM ei")
def c04(spark, d):
    return rounded(impacts(spark, d)[0].select("profile_id", "predictor", "criterion", "edge_impact", "edge_impact_signed", "edge_rank"))


@query("C05_criterion_weights", f"{IMPACT} SELECT profile_id, criterion, round(criterion_weight, 6) criterion_weight FROM cw")
def c05(spark, d):
    return rounded(I.criterion_weights(features(spark, d)[1]))


@query("C06_predictor_impact", f"{IMPACT} SELECT profile_id, predictor, round(predictor_impact, 6) predictor_impact, round(100 * predictor_impact, 4) predictor_impact_pct, row_number() OVER (PARTITION BY profile_id ORDER BY round(predictor_impact, 9) DESC, predictor) predictor_rank FROM pi")
def c06(spark, d):
    p = impacts(spark, d)[1].select("profile_id", "predictor", "predictor_impact", "predictor_impact_pct", "predictor_rank")
    return rounded(p.drop("predictor_impact_pct")).join(rounded(p.select("profile_id", "predictor", "predictor_impact_pct"), 4), ["profile_id", "predictor"])


@query("C06_full_impact")
def c06f(spark, d):
    """The whole flow by each profile's plan: selection, fill, search, time-varying or static fit, intervals, graph
    metrics, importance, edge and predictor impact."""
    from lagweave.plans.impact import predictor_table

    return rounded(predictor_table(M.cohort_obs(spark, d)))


@query("C07_coef_source", f"""{EDGES}, tv AS (SELECT * FROM cf WHERE CAST(substr(profile_id, 2) AS INT) % 2 = 0), st AS (SELECT profile_id, dst, src, round(avg(beta), 6) beta FROM cf GROUP BY ALL)
SELECT profile_id, time_index, t, dst, src, round(beta, 6) beta, 'time_varying' impact_source FROM tv UNION ALL SELECT profile_id, 0, 1.0, dst, src, round(beta, 6), 'stationary' FROM st WHERE profile_id NOT IN (SELECT profile_id FROM tv)""")
def c07(spark, d):
    c = segment_coefs(spark, d)
    tv = c.where(F.substring("profile_id", 2, 9).cast("int") % 2 == 0).select("profile_id", "time_index", "t", "dst", "src", "beta")
    return rounded(I.coef_source(tv, c.groupBy("profile_id", "dst", "src").agg(F.round(F.avg("beta") + 1e-9, 6).alias("beta"))))


@query("A20_impact_matrix", f"{IMPACT} SELECT profile_id, criterion, " + ", ".join(f"round(coalesce(avg(edge_impact) FILTER (predictor = '{p}'), 0), 6) {p}" for p in ("P01", "P02", "P03")) + " FROM ei GROUP BY ALL")
def a20(spark, d):
    return rounded(I.impact_matrix(impacts(spark, d)[0], ["P01", "P02", "P03"]))


@query("A22_mass_tables", f"""{IMPACT} SELECT profile_id, predictor, criterion, round(edge_impact, 6) edge_impact, round(edge_impact / (sum(edge_impact) OVER (PARTITION BY profile_id) + 1e-12), 6) share_global, round(edge_impact / (sum(edge_impact) OVER (PARTITION BY profile_id, predictor) + 1e-12), 6) share_in_left,
round(edge_impact / (sum(edge_impact) OVER (PARTITION BY profile_id, criterion) + 1e-12), 6) share_in_right, round(sum(edge_impact) OVER (PARTITION BY profile_id, predictor), 6) left_strength, round(sum(edge_impact) OVER (PARTITION BY profile_id, criterion), 6) right_strength FROM ei""")
def a22(spark, d):
    return rounded(MP.mass_tables(impacts(spark, d)[0], value="edge_impact"))


CUSTOM = f"""ci AS (SELECT 'n' || c_nationkey profile_id, c_mktsegment || '-' || (c_custkey % 7) predictor, round(max(c_acctbal) / 10000, 6) predictor_impact FROM customer GROUP BY ALL)"""


def customer_impact(spark, d):
    return table(spark, d, "customer").groupBy(F.concat(F.lit("n"), "c_nationkey").alias("profile_id"), F.concat("c_mktsegment", F.lit("-"), F.col("c_custkey") % 7).alias("predictor")).agg(F.round(F.max("c_acctbal") / 10000 + 1e-9, 6).alias("predictor_impact"))


@query("K10_select_targets", f"""WITH {CUSTOM}, tp AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY predictor_impact DESC, predictor) AS rank FROM ci QUALIFY rank <= 5), s AS (SELECT *, sum(CAST(predictor_impact >= 0.9 AS INT)) OVER (PARTITION BY profile_id) > 0 st FROM tp)
SELECT profile_id, predictor, predictor_impact, rank, CASE WHEN st THEN predictor_impact >= 0.9 AND rank <= 3 ELSE rank = 1 AND predictor_impact >= 0.25 END is_target, CASE WHEN predictor_impact >= 0.7 THEN 'very_high' WHEN predictor_impact >= 0.5 THEN 'high' WHEN predictor_impact >= 0.3 THEN 'medium' WHEN predictor_impact >= 0.1 THEN 'low' ELSE 'very_low' END priority FROM s""")
def k10(spark, d):
    return Z.select_targets(customer_impact(spark, d), 5, 0.9)


GRID = f"""va AS (SELECT DISTINCT 'm' || l_suppkey % 20 model_id, 'P' || l_linenumber source FROM lineitem), vb AS (SELECT DISTINCT 'm' || l_suppkey % 20 model_id, 'C' || l_returnflag target FROM lineitem), ge AS (SELECT 'm' || l_suppkey % 20 model_id, 'P' || l_linenumber source, 'C' || l_returnflag target, max(l_quantity * l_discount / 5) score FROM lineitem WHERE l_suppkey % 20 <> l_linenumber GROUP BY ALL),
gd AS (SELECT model_id, source, target, coalesce(score, 0) score FROM va JOIN vb USING (model_id) LEFT JOIN ge USING (model_id, source, target)), ch AS (SELECT *, row_number() OVER (PARTITION BY model_id, target ORDER BY score DESC, source) AS rank FROM gd QUALIFY rank <= 4 AND (rank <= 2 OR score > 0.495))"""


def grid_of(spark, d):
    li = table(spark, d, "lineitem").select(F.concat(F.lit("m"), F.col("l_suppkey") % 20).alias("model_id"), F.concat(F.lit("P"), "l_linenumber").alias("source"), F.concat(F.lit("C"), "l_returnflag").alias("target"), (F.col("l_quantity") * F.col("l_discount") / 5).alias("score"), (F.col("l_suppkey") % 20 != F.col("l_linenumber")).alias("ok"))
    variables = li.select("model_id", F.explode(F.array(F.struct(F.col("source").alias("var_id"), F.lit("PREDICTOR").alias("role")), F.struct(F.col("target").alias("var_id"), F.lit("CRITERION").alias("role")))).alias("v")).select("model_id", "v.*").distinct()
    return variables, MP.complete_grid(variables, li.where("ok"), "PREDICTOR", "CRITERION")


@query("J02_complete_grid", f"WITH {GRID} SELECT model_id, source, target, round(score, 6) score FROM gd")
def j02(spark, d):
    return rounded(grid_of(spark, d)[1])


@query("K02_topk_incoming", f"WITH {GRID} SELECT model_id, source, target, round(score, 6) score, rank, CASE WHEN score < 0.1 THEN 'very_low' WHEN score < 0.3 THEN 'low' WHEN score < 0.55 THEN 'medium' WHEN score < 0.8 THEN 'high' ELSE 'very_high' END tier FROM ch")
def k02(spark, d):
    return rounded(MP.topk_incoming(grid_of(spark, d)[1], 2, 4, 0.495))


@query("K03_audit_selection", f"""WITH {GRID}, c2 AS (SELECT * FROM gd QUALIFY row_number() OVER (PARTITION BY model_id, target ORDER BY source) <= 3), f AS (SELECT gd.*, c2.source IS NOT NULL c FROM gd LEFT JOIN c2 USING (model_id, source, target)), a AS (SELECT model_id, target, count(*) FILTER (c) n_chosen, max(score) FILTER (NOT c) - min(score) FILTER (c) g FROM f GROUP BY ALL)
SELECT model_id, target, n_chosen, round(g, 6) optimality_gap, n_chosen BETWEEN 2 AND 4 count_ok, coalesce(g >= 0.1, false) suboptimal FROM a""")
def k03(spark, d):
    from lagweave.core.ranking import top_n

    grid = cut_lineage(grid_of(spark, d)[1])
    chosen = top_n(grid, ["model_id", "target"], [F.col("source")], 3)
    return rounded(MP.audit_selection(grid, chosen, 2, 4))


CAND = f"""cd AS (SELECT 'r' || l_returnflag profile_id, concat_ws(' / ', {PRIM}, p_type, p_brand) path, {PRIM} || '/' || p_type "domain", round(avg(l_quantity * l_discount), 6) score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def candidates(spark, d):
    h = M.hierarchy(spark, d)
    j = table(spark, d, "lineitem").join(h, F.col("l_partkey") == F.col("predictor_id"))
    return j.groupBy(F.concat(F.lit("r"), "l_returnflag").alias("profile_id"), F.concat_ws(" / ", "primary", "secondary", "tertiary").alias("path"), F.concat_ws("/", "primary", "secondary").alias("domain")).agg((F.round(F.avg(F.col("l_quantity") * F.col("l_discount")) + 1e-9, 6)).alias("score"))


@query("K06_breadth_first_select", f"""WITH {CAND}, a AS (SELECT *, row_number() OVER (PARTITION BY profile_id, "domain" ORDER BY score DESC, path) k FROM cd), t AS (SELECT profile_id, "domain", max(score) top FROM cd GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY top DESC, "domain") dno, count(*) OVER (PARTITION BY profile_id) nd FROM t),
b AS (SELECT a.*, dno, nd, row_number() OVER (PARTITION BY a.profile_id ORDER BY k, dno) rr FROM a JOIN o USING (profile_id, "domain")), c AS (SELECT *, CASE WHEN k = 1 THEN 0 WHEN rr <= least(70, 3 * nd) THEN 1 ELSE 2 END st FROM b)
SELECT profile_id, path, "domain", score, (['breadth_domain_coverage', 'breadth_round_robin', 'depth_refinement'])[st + 1] stage, row_number() OVER (PARTITION BY profile_id ORDER BY st, CASE WHEN st < 2 THEN rr END, score DESC, path) AS rank FROM c QUALIFY rank <= 70""")
def k06(spark, d):
    return Z.breadth_first_select(candidates(spark, d), 70)


@query("K07_quota_select", """WITH c AS (SELECT o_custkey id, CASE WHEN o_custkey % 4 = 0 THEN 'pharm' WHEN o_custkey % 4 = 1 THEN 'psycho' ELSE 'other' END category, count(*) degree FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY degree DESC, id) k FROM c),
q AS (SELECT *, k <= CASE category WHEN 'psycho' THEN 30 WHEN 'pharm' THEN 5 ELSE 0 END by_quota FROM r WHERE category <> 'pharm' OR k <= 12) SELECT id, category, degree, by_quota, row_number() OVER (ORDER BY by_quota DESC, degree DESC, id) AS rank FROM q QUALIFY rank <= 100""")
def k07(spark, d):
    k = F.col("o_custkey") % 4
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.when(k == 0, "pharm").when(k == 1, "psycho").otherwise("other").alias("category")).agg(F.count(F.lit(1)).alias("degree"))
    return Z.quota_select(c, {"psycho": 30, "pharm": 5}, "pharm", 12, 100)


UHASH = "((CAST('0x' || right(md5({0}), 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


@query("K08_weighted_sample", f"""WITH w AS (SELECT o_orderkey, o_orderpriority, o_totalprice, ln({UHASH.format("o_orderkey || '|7'")}) / o_totalprice s FROM orders WHERE o_totalprice > 0) SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY s DESC, o_orderkey) AS rank FROM w QUALIFY rank <= 25""")
def k08(spark, d):
    return Z.weighted_sample(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderkey", F.col("o_totalprice"), 25, 7, ["o_orderpriority"]).drop("o_totalprice")


@query("K09_head_tail_sample", f"""WITH i AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber item FROM lineitem GROUP BY ALL), a AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY item) h, row_number() OVER (PARTITION BY l_suppkey ORDER BY item DESC) t FROM i),
m AS (SELECT l_suppkey, item FROM a WHERE h > 10 AND t > 10 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY {UHASH.format("l_suppkey || '|' || item || '|3'")}, item) <= 5)
SELECT l_suppkey, item, CASE WHEN h <= 10 THEN 'head' ELSE 'tail' END part FROM a WHERE h <= 10 OR t <= 10 UNION ALL SELECT l_suppkey, item, 'sample' FROM m""")
def k09(spark, d):
    items = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item")).distinct()
    return Z.head_tail_sample(items, "l_suppkey", "item", 10, 5, 3)


CONTRIB = """ct AS (SELECT 'f' || l_returnflag profile_id, 'p' || l_linenumber predictor, 'b' || l_suppkey barrier, max(l_discount * l_quantity) contribution FROM lineitem GROUP BY ALL)"""


@query("K11_top_barriers", f"""WITH {CONTRIB}, f AS (SELECT * FROM ct QUALIFY row_number() OVER (PARTITION BY profile_id, predictor ORDER BY contribution DESC, barrier) <= 8), g AS (SELECT profile_id, barrier, max(contribution) s, count(*) n_predictors FROM f GROUP BY ALL)
SELECT profile_id, barrier, round(s, 6) score, n_predictors, row_number() OVER (PARTITION BY profile_id ORDER BY s DESC, barrier) AS rank FROM g QUALIFY rank <= 10""")
def k11(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.concat(F.lit("f"), "l_returnflag").alias("profile_id"), F.concat(F.lit("p"), "l_linenumber").alias("predictor"), F.concat(F.lit("b"), "l_suppkey").alias("barrier")).agg(F.max(F.col("l_discount") * F.col("l_quantity")).alias("contribution"))
    return rounded(Z.top_barriers(rows, 8, 10))


@query("K12_apply_count_policy", """WITH r AS (SELECT c_nationkey % 5 || 'n' || c_custkey % 60 profile_id, c_mktsegment item, CASE WHEN c_acctbal > 3000 THEN 0 ELSE 1 END p, CAST(c_custkey AS INT) k FROM customer), b AS (SELECT profile_id, item, min((p, k)) s FROM r GROUP BY ALL), c AS (SELECT profile_id, item, struct_extract_at(s, 1) source_priority, struct_extract_at(s, 2) source_rank FROM b),
o AS (SELECT *, sum(CAST(source_priority = 0 AS INT)) OVER (PARTITION BY profile_id) own, row_number() OVER (PARTITION BY profile_id ORDER BY source_priority, source_rank, item) "position" FROM c), k AS (SELECT * FROM o WHERE "position" <= greatest(least(own, 4), 3))
SELECT profile_id, item, source_priority, source_rank, "position", concat_ws('|', CASE WHEN source_priority > 0 THEN 'filled_from_fallback' END, CASE WHEN own > 4 THEN 'cut_to_max' END, CASE WHEN count(*) OVER (PARTITION BY profile_id) < 2 THEN 'below_min' END) reasons FROM k""")
def k12(spark, d):
    c = table(spark, d, "customer")
    rows = c.select(F.concat(F.col("c_nationkey") % 5, F.lit("n"), F.col("c_custkey") % 60).alias("profile_id"), F.col("c_mktsegment").alias("item"), F.when(F.col("c_acctbal") > 3000, 0).otherwise(1).alias("source_priority"), F.col("c_custkey").cast("int").alias("source_rank"))
    return Z.apply_count_policy(rows, 2, 4, 3).withColumn("reasons", joined("reasons"))


@query("K14_batches", "SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 64) AS BIGINT) batch FROM orders")
def k14(spark, d):
    return Z.batches(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 64)


ANCH = f"""an AS (SELECT 'n' || s_nationkey profile_id, anchor, max(impact) impact FROM (SELECT s_nationkey, concat_ws(' / ', {PRIM}, p_type, p_brand, p_name) anchor, s_acctbal / 10000 impact FROM supplier JOIN part ON p_partkey = s_suppkey * 7 % (SELECT count(*) FROM part) WHERE s_acctbal > 0) GROUP BY ALL),
lf AS (SELECT DISTINCT concat_ws(' / ', {PRIM}, p_type, p_brand) leaf FROM part)"""
PT2 = PTOK


def paths_of(spark, d):
    h = table(spark, d, "part").join(M.hierarchy(spark, d).withColumnRenamed("predictor_id", "p_partkey"), "p_partkey")
    return h.withColumn("leaf", F.concat_ws(" / ", "primary", "secondary", "tertiary")).withColumn("long", F.concat_ws(" / ", "primary", "secondary", "tertiary", "p_name"))


def anchors_of(spark, d):
    h = paths_of(spark, d)
    n = table(spark, d, "part").count()
    s = table(spark, d, "supplier").where("s_acctbal > 0").withColumn("pk", F.col("s_suppkey") * 7 % n)
    return s.join(h, F.col("pk") == F.col("p_partkey")).groupBy(F.concat(F.lit("n"), "s_nationkey").alias("profile_id"), F.col("long").alias("anchor")).agg(F.max(F.col("s_acctbal") / 10000).alias("impact"))


SIMS = f"""xl AS (SELECT leaf, {SEGS.replace(' > ', ' / ').format('leaf')} sl, {PTOK.format('leaf')} tl FROM lf), xa AS (SELECT anchor, {SEGS.replace(' > ', ' / ').format('anchor')} sa, {PTOK.format('anchor')} ta FROM (SELECT DISTINCT anchor FROM an)), jc AS (SELECT leaf, anchor, len(list_intersect(tl, ta)) / (len(tl) + len(ta) - len(list_intersect(tl, ta))) j, sl[2] = sa[2] same, {similarity_sql('sl', 'sa', 'tl', 'ta')} s FROM xl, xa)"""


@query("C10_ontology_candidates", f"""WITH {ANCH}, {SIMS}, g AS (SELECT profile_id, leaf, max(j) b, max(CAST(same AS INT)) sm, max(j * impact) a FROM an JOIN jc USING (anchor) WHERE j > 0 GROUP BY ALL) SELECT profile_id, leaf, round(b, 6) best, CAST(sm AS DOUBLE) same, round(a, 6) anchored, round(least(1, greatest(0, 0.55 * b + 0.25 * sm + 0.2 * a)), 6) score FROM g""")
def c10(spark, d):
    return rounded(Z.ontology_candidates(paths_of(spark, d).select("leaf"), anchors_of(spark, d)))


MAPR = f"""mr AS (SELECT 'n' || c_nationkey profile_id, concat_ws(' / ', {PRIM}, p_brand) path, max(c_acctbal / 10000) score FROM customer JOIN part ON p_partkey = c_custkey WHERE c_acctbal > 0 AND c_custkey % 3 = 0 GROUP BY ALL), hy AS (SELECT 'n' || c_nationkey profile_id, concat_ws(' / ', {PRIM}, p_type, p_brand) path, max(c_acctbal / 10000) score FROM customer JOIN part ON p_partkey = c_custkey WHERE c_acctbal > 0 AND c_custkey % 3 = 1 GROUP BY ALL)"""


def mapping_rows(spark, d):
    j = table(spark, d, "customer").where("c_acctbal > 0").join(paths_of(spark, d), F.col("p_partkey") == F.col("c_custkey")).withColumn("profile_id", F.concat(F.lit("n"), "c_nationkey"))
    agg = lambda df, path: df.groupBy("profile_id", path.alias("path")).agg(F.max(F.col("c_acctbal") / 10000).alias("score"))
    return agg(j.where("c_custkey % 3 = 0"), F.concat_ws(" / ", "primary", "tertiary")), agg(j.where("c_custkey % 3 = 1"), F.col("leaf"))


BFS = f"""{ANCH}, {MAPR}, {SIMS}, xm AS (SELECT path, {SEGS.replace(' > ', ' / ').format('path')} sp, {PTOK.format('path')} tp FROM (SELECT DISTINCT path FROM mr)), mf AS (SELECT leaf, path, CASE WHEN sl[1] = sp[1] AND list_contains(sl, sp[2]) THEN 1.0 ELSE {similarity_sql('sl', 'sp', 'tl', 'tp')} END f FROM xl, xm),
ms AS (SELECT profile_id, leaf, max(score * f) v FROM mr JOIN mf USING (path) WHERE f >= 0.45 GROUP BY ALL), aa AS (SELECT profile_id, leaf, max(least(1, s * impact)) v FROM an JOIN jc USING (anchor) WHERE s > 0 GROUP BY ALL), kd AS (SELECT DISTINCT profile_id, lower(split_part(path, ' / ', 1) || ' / ' || split_part(path, ' / ', 2)) k FROM mr UNION SELECT profile_id, lower(split_part(anchor, ' / ', 1) || ' / ' || split_part(anchor, ' / ', 2)) FROM an),
dm AS (SELECT DISTINCT profile_id, leaf FROM lf JOIN kd ON lower(split_part(leaf, ' / ', 1) || ' / ' || split_part(leaf, ' / ', 2)) = k), hs AS (SELECT profile_id, path leaf, score v FROM hy), ky AS (SELECT profile_id, leaf FROM ms UNION SELECT profile_id, leaf FROM aa UNION SELECT profile_id, leaf FROM dm UNION SELECT profile_id, leaf FROM hs),
bs AS (SELECT ky.profile_id, ky.leaf, coalesce(ms.v, 0) m, coalesce(hs.v, 0) h, coalesce(aa.v, 0) a, CASE WHEN dm.leaf IS NULL THEN 0 ELSE 1 END b FROM ky LEFT JOIN ms USING (profile_id, leaf) LEFT JOIN hs USING (profile_id, leaf) LEFT JOIN aa USING (profile_id, leaf) LEFT JOIN dm USING (profile_id, leaf))"""


@query("C11_bfs_scores", f"WITH {BFS} SELECT profile_id, leaf, round(m, 6) mapping_score, round(h, 6) hyde_score, round(a, 6) anchor_score, round(least(1, 0.45 * m + 0.25 * h + 0.2 * a + 0.1 * b), 6) score FROM bs")
def c11(spark, d):
    mapping, hyde = mapping_rows(spark, d)
    out = Z.bfs_scores(paths_of(spark, d).select("leaf"), mapping, hyde, anchors_of(spark, d))
    return rounded(out.select("profile_id", "leaf", "mapping_score", "hyde_score", "anchor_score", "score"))


def fused(spark, d):
    """Model update per nation: candidates and mapping from customers, predictors and impact from suppliers."""
    mapping, hyde = mapping_rows(spark, d)
    cands = hyde.select("profile_id", "path", F.col("score").alias("prior"))
    an = anchors_of(spark, d)
    crit = table(spark, d, "region").select(F.concat(F.lit("C"), "r_regionkey").alias("criterion"), F.concat_ws(" / ", F.lit("BIO"), "r_name").alias("path"))
    profiles = cands.select("profile_id").distinct()
    two = F.explode(F.array(F.lit("C0"), F.lit("C1")))
    criteria = profiles.withColumn("criterion", two).join(crit, "criterion")
    preds = an.select("profile_id", F.col("anchor").alias("predictor"), F.col("anchor").alias("path"))
    imp = an.withColumn("criterion", two).select("profile_id", F.col("anchor").alias("predictor"), "criterion", F.col("impact").alias("value"))
    rel = imp.withColumn("value", F.col("value") * 0.5 + F.when(F.col("criterion") == "C1", 0.2).otherwise(0.0))
    ready = profiles.withColumn("score", F.substring("profile_id", 2, 9).cast("int") % 9 * 12.5)
    last = F.substring("path", -1, 1)
    maps = mapping.withColumn("criterion_path", F.when(last.isin("1", "2"), "").when(last == "3", "BIO / AFRICA / sub").otherwise("PSYCHO / AMERICA"))
    return cut_lineage(Z.fuse_model(cands, criteria, preds, rel, imp, maps, ready)), imp


FUSE = f"""{ANCH}, {MAPR}, cd AS (SELECT profile_id, path, score prior, lower(path) parent FROM hy), sp AS (SELECT *, CASE WHEN count(*) OVER w <= 1 THEN 1.0 ELSE 0.5 + 0.5 * greatest(1e-6, prior) / sum(greatest(1e-6, prior)) OVER w * count(*) OVER w END split FROM cd WINDOW w AS (PARTITION BY profile_id, parent)),
xc AS (SELECT path, {SEGS.replace(' > ', ' / ').format('path')} sc, {PTOK.format('path')} tc FROM (SELECT DISTINCT path FROM cd)), xa AS (SELECT anchor, {SEGS.replace(' > ', ' / ').format('anchor')} sa, {PTOK.format('anchor')} ta FROM (SELECT DISTINCT anchor FROM an)), ca AS (SELECT path, anchor, {similarity_sql('sc', 'sa', 'tc', 'ta')} s FROM xc, xa),
xm AS (SELECT path mpath, {SEGS.replace(' > ', ' / ').format('path')} sm, {PTOK.format('path')} tm FROM (SELECT DISTINCT path FROM mr)), cm AS (SELECT path, mpath, {similarity_sql('sc', 'sm', 'tc', 'tm')} s FROM xc, xm),
kc AS (SELECT 'C' || r_regionkey criterion, 'BIO / ' || r_name kp FROM region WHERE r_regionkey < 2), mq AS (SELECT *, CASE WHEN right(path, 1) IN ('1', '2') THEN '' WHEN right(path, 1) = '3' THEN 'BIO / AFRICA / sub' ELSE 'PSYCHO / AMERICA' END qp FROM mr),
xk AS (SELECT criterion, qp, {SEGS.replace(' > ', ' / ').format('kp')} sk, {PTOK.format('kp')} tk, {SEGS.replace(' > ', ' / ').format('qp')} sq, {PTOK.format('qp')} tq FROM kc, (SELECT DISTINCT qp FROM mq)), kq AS (SELECT criterion, qp, CASE WHEN qp = '' THEN 0.45 ELSE {similarity_sql('sk', 'sq', 'tk', 'tq')} END cs FROM xk), im AS (SELECT profile_id, anchor, criterion, impact v, impact * 0.5 + CASE WHEN criterion = 'C1' THEN 0.2 ELSE 0 END r FROM an, kc),
tr AS (SELECT sp.profile_id, sp.path, criterion, sum(s * r) / sum(s) transfer, sum(s * v) / sum(s) ind FROM sp JOIN ca USING (path) JOIN im ON im.profile_id = sp.profile_id AND im.anchor = ca.anchor WHERE s > 0 GROUP BY ALL), mp AS (SELECT sp.profile_id, sp.path, criterion, max(mq.score * s * (0.35 + 0.65 * cs)) mpart FROM sp JOIN cm USING (path) JOIN mq ON mq.profile_id = sp.profile_id AND mq.path = cm.mpath JOIN kq USING (qp) WHERE s > 0.2 AND mq.score > 0 GROUP BY ALL),
fu0 AS (SELECT sp.profile_id, sp.path, prior, split, criterion, coalesce(transfer, 0) transfer, coalesce(ind, 0) ind, coalesce(mpart, 0) mpart FROM sp CROSS JOIN kc LEFT JOIN tr USING (profile_id, path, criterion) LEFT JOIN mp USING (profile_id, path, criterion)),
fu AS (SELECT *, least(1, 0.6 * mpart + 0.4 * transfer) grp, least(1, ind * split) idv, (1 - wi) * least(1, 0.6 * mpart + 0.4 * transfer) + wi * least(1, ind * split) fused FROM (SELECT *, 0.30 + 0.50 * (CAST(substr(profile_id, 2) AS INT) % 9 * 12.5 / 100) wi FROM fu0)),
iw AS (SELECT profile_id, criterion, sum(v) v FROM im GROUP BY ALL), cw AS (SELECT profile_id, criterion, CASE WHEN sum(coalesce(v, 0)) OVER w <= 1e-12 THEN 0.5 ELSE v / sum(v) OVER w END cw FROM (SELECT DISTINCT profile_id, criterion FROM fu) LEFT JOIN iw USING (profile_id, criterion) WINDOW w AS (PARTITION BY profile_id)),
rk AS (SELECT profile_id, path, least(1, sum(fused * cw)) fm, least(1, sum(grp * cw)) gm, least(1, sum(idv * cw)) im, max(prior) prior FROM fu JOIN cw USING (profile_id, criterion) GROUP BY ALL)"""


@query("C12_fuse_model", f"WITH {FUSE} SELECT profile_id, path, criterion, round(grp, 6) group_level, round(idv, 6) individual, round(fused, 6) fused FROM fu")
def c12(spark, d):
    return rounded(fused(spark, d)[0].select("profile_id", "path", "criterion", "group_level", "individual", "fused"))


@query("C13_memory_fusion", f"""WITH {FUSE}, pv AS (SELECT profile_id, path, score prev FROM mr), j AS (SELECT rk.*, coalesce(prev, 0) prev FROM rk LEFT JOIN (SELECT profile_id, path, prior * 0.9 prev FROM cd) USING (profile_id, path)), s AS (SELECT *, CASE WHEN prev > 0 AND im > 0 THEN 0.6 ELSE 0 END + 0.4 * (1 - least(1, abs(im - prev))) st FROM j),
m AS (SELECT *, prev > 0.6 AND im < 0.2 cl, least(1, 0.45 * im + 0.25 * prev + 0.2 * gm + 0.1 * least(1, st)) mm FROM s), n AS (SELECT *, CASE WHEN cl THEN least(mm, 0.4 * prev + 0.6 * im) ELSE mm END mf FROM m)
SELECT profile_id, path, round(fm, 6) fused_mean, round(st, 6) stability_bonus, round(mf, 6) memory_score, cl contradiction, round(least(1, 0.65 * fm + 0.35 * mf), 6) final_score FROM n""")
def c13(spark, d):
    f, imp = fused(spark, d)
    ranked = Z.rank_fused(f, imp, None)
    prev = mapping_rows(spark, d)[1].select("profile_id", "path", (F.col("score") * 0.9).alias("previous_score"))
    return rounded(Z.memory_fusion(ranked, prev).select("profile_id", "path", "fused_mean", "stability_bonus", "memory_score", "contradiction", "final_score"))


FEASIBLE = f"""{SCORES_SQL}, pd AS (SELECT lang || ' / ' || source parent_domain, count(*) n, avg(overall_suitability) sv, avg(best_method_risk) rv FROM su JOIN documents USING (doc_id) GROUP BY 1), pp AS (SELECT DISTINCT concat_ws(' / ', lang, source, 'q' || (doc_id % 5)) path FROM documents),
x AS (SELECT path, {SEGS.replace(' > ', ' / ').format('path')} sa, {PTOK.format('path')} ta FROM pp), y AS (SELECT *, {SEGS.replace(' > ', ' / ').format('parent_domain')} sb, {PTOK.format('parent_domain')} tb FROM pd), s AS (SELECT path, parent_domain, {similarity_sql('sa', 'sb', 'ta', 'tb')} sim, sv, rv FROM x, y),
f AS (SELECT *, round(least(1, greatest(0, 0.75 * sv + 0.25 * (1 - rv))) * sim, 9) fe FROM s WHERE sim >= 0.1)"""


@query("C14_parent_feasibility", f"""WITH {FEASIBLE} SELECT path, parent_domain, round(sim, 6) similarity, round(fe, 6) feasibility, row_number() OVER (PARTITION BY path ORDER BY fe DESC, parent_domain) AS rank FROM f QUALIFY rank <= 10""")
def c14(spark, d):
    from lagweave.catalog.mapping import feasibility_frame

    docs = table(spark, d, "documents")
    preds = docs.select(F.concat_ws(" / ", "lang", "source", F.concat(F.lit("q"), F.col("doc_id") % 5)).alias("path")).distinct()
    parents = cut_lineage(MP.parent_domain_scores(feasibility_frame(spark, d)))
    return rounded(Z.parent_feasibility(preds, parents, 10).select("path", "parent_domain", "similarity", "feasibility", "rank"))


@query("C14_feasibility_bundle", f"""WITH {FEASIBLE}, k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY path ORDER BY fe DESC, parent_domain) <= 10), b AS (SELECT parent_domain, max(fe) fe, max(sv) sv, max(rv) rv, count(*) n FROM k GROUP BY 1)
SELECT parent_domain, round(fe, 6) feasibility, round(sv, 6) suitability, round(rv, 6) risk, n support FROM b ORDER BY fe DESC, sv DESC, rv, n DESC, parent_domain LIMIT 30""")
def c14b(spark, d):
    from lagweave.catalog.mapping import feasibility_frame

    docs = table(spark, d, "documents")
    preds = docs.select(F.concat_ws(" / ", "lang", "source", F.concat(F.lit("q"), F.col("doc_id") % 5)).alias("path")).distinct()
    parents = cut_lineage(MP.parent_domain_scores(feasibility_frame(spark, d)))
    return rounded(Z.feasibility_bundle(Z.parent_feasibility(preds, parents, 10)))


BMAP = f"""tg AS (SELECT profile_id, anchor predictor, impact priority FROM an), bm AS (SELECT concat_ws(' / ', {PRIM}, p_brand) predictor_path, p_name barrier, max(p_retailprice / 2000) score FROM part GROUP BY ALL)"""
PSIM = f"""xp AS (SELECT predictor, {SEGS.replace(' > ', ' / ').format('predictor')} sa, {PTOK.format('predictor')} ta FROM (SELECT DISTINCT predictor FROM tg)), xq AS (SELECT predictor_path, {SEGS.replace(' > ', ' / ').format('predictor_path')} sb, {PTOK.format('predictor_path')} tb FROM (SELECT DISTINCT predictor_path FROM bm)),
ps AS (SELECT predictor, predictor_path, greatest({similarity_sql('sa', 'sb', 'ta', 'tb')}, len(list_intersect(ta, tb)) / (len(ta) + len(tb) - len(list_intersect(ta, tb)))) sim FROM xp, xq)"""


def barrier_map(spark, d):
    return paths_of(spark, d).groupBy(F.concat_ws(" / ", "primary", "tertiary").alias("predictor_path"), F.col("p_name").alias("barrier")).agg(F.max(F.col("p_retailprice") / 2000).alias("score"))


def targets_of(spark, d):
    return anchors_of(spark, d).select("profile_id", F.col("anchor").alias("predictor"), F.col("impact").alias("priority"))


CONTR = f"""{ANCH}, {BMAP}, {PSIM}, bc AS (SELECT profile_id, predictor, barrier, predictor_path, round(least(1, priority) * CASE WHEN score > 1 THEN score / 1000 ELSE score END * sim, 9) contribution FROM tg JOIN ps USING (predictor) JOIN bm USING (predictor_path) WHERE sim >= 0.12), bt AS (SELECT *, row_number() OVER (PARTITION BY profile_id, predictor ORDER BY contribution DESC, barrier, predictor_path) AS rank FROM bc QUALIFY rank <= 10)"""


@query("C15_barrier_scores", f"WITH {CONTR} SELECT profile_id, predictor, barrier, predictor_path, round(contribution, 6) contribution, rank FROM bt")
def c15(spark, d):
    return rounded(Z.barrier_scores(targets_of(spark, d), barrier_map(spark, d), 10).select("profile_id", "predictor", "barrier", "predictor_path", "contribution", "rank"))


TEXTS = "tx AS (SELECT 'n' || n_nationkey profile_id, CASE WHEN n_nationkey % 5 = 4 THEN '' ELSE 'economy brand ' || lower(n_name) || CASE WHEN n_nationkey % 2 = 0 THEN ' bio 12' ELSE ' social ring' END END txt FROM nation)"


def texts_of(spark, d):
    n = F.col("n_nationkey")
    body = F.concat(F.lit("economy brand "), F.lower("n_name"), F.when(n % 2 == 0, " bio 12").otherwise(" social ring"))
    return table(spark, d, "nation").select(F.concat(F.lit("n"), n).alias("profile_id"), F.when(n % 5 == 4, "").otherwise(body).alias("text"))


TOKS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) > 1))"
def text_scores_sql(texts: str, out: str) -> str:
    """Barrier scores of the texts (profile_id, txt) in a CTE."""
    return f"""{out}_k AS (SELECT profile_id, txt, {TOKS.format('txt')} t FROM {texts}), {out}_e AS (SELECT predictor_path, {TOKS.format('predictor_path')} e FROM (SELECT DISTINCT predictor_path FROM bm)), {out}_a AS (SELECT profile_id, barrier, max(CASE WHEN trim(txt) = '' THEN 0.3 * score ELSE score * (0.25 + 0.75 * CASE WHEN len(t) > 0 AND len(e) > 0 THEN len(list_intersect(t, e)) / (len(t) + len(e) - len(list_intersect(t, e))) ELSE 0 END) END) s FROM {out}_k, bm JOIN {out}_e USING (predictor_path) GROUP BY ALL),
{out} AS (SELECT profile_id, barrier, round(s, 9) score FROM {out}_a)"""


CONTEXTS = "cx AS (SELECT 'n' || n_nationkey profile_id, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE lower(r_name) || ' psycho brand ' || n_nationkey END txt FROM nation JOIN region ON n_regionkey = r_regionkey)"
TSCORE = f"{CONTR}, {TEXTS}, {text_scores_sql('tx', 'ts')}, {CONTEXTS}, {text_scores_sql('cx', 'cs')}, tk AS (SELECT * FROM ts_k)"


def contexts_of(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.concat(F.lower("r_name"), F.lit(" psycho brand "), "n_nationkey")
    return n.select(F.concat(F.lit("n"), "n_nationkey").alias("profile_id"), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(body).alias("text"))


@query("C15_text_barrier_scores", f"WITH {TSCORE} SELECT profile_id, barrier, round(score, 6) score FROM ts")
def c15t(spark, d):
    return rounded(Z.text_barrier_scores(texts_of(spark, d), barrier_map(spark, d).withColumnRenamed("predictor_path", "entity")))


COMB = f"""{TSCORE}, pe AS (SELECT profile_id, barrier, max(contribution) p FROM bt GROUP BY ALL), ev AS (SELECT profile_id, barrier, coalesce(p, 0) ps, coalesce(ts.score, 0) xs, coalesce(cs.score, 0) qs FROM pe FULL JOIN ts USING (profile_id, barrier) FULL JOIN cs USING (profile_id, barrier)), cb AS (SELECT profile_id, barrier, round(least(1, 0.60 * ps + 0.20 * xs + 0.15 * qs + 0.05 * coalesce(CASE WHEN len(t) > 0 THEN len(list_intersect(t, {TOKS.format('barrier')})) / (len(t) + len({TOKS.format('barrier')}) - len(list_intersect(t, {TOKS.format('barrier')}))) ELSE 0 END, 0)), 9) total FROM ev LEFT JOIN tk USING (profile_id)),
tb AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY total DESC, barrier) AS rank FROM cb QUALIFY rank <= 8)"""


def combined(spark, d):
    bars = cut_lineage(Z.barrier_scores(targets_of(spark, d), barrier_map(spark, d), 10))
    pred = bars.groupBy("profile_id", "barrier").agg(F.max("contribution").alias("predictor_score"))
    text = Z.text_barrier_scores(texts_of(spark, d), barrier_map(spark, d).withColumnRenamed("predictor_path", "entity")).withColumnRenamed("score", "profile_score")
    context = Z.text_barrier_scores(contexts_of(spark, d), barrier_map(spark, d).withColumnRenamed("predictor_path", "entity")).withColumnRenamed("score", "context_score")
    ev = pred.join(text, ["profile_id", "barrier"], "full_outer").join(context, ["profile_id", "barrier"], "full_outer")
    return Z.combine_barriers(ev, texts_of(spark, d), 8)


@query("C16_combine_barriers", f"WITH {COMB} SELECT profile_id, barrier, round(total, 6) total, rank FROM tb")
def c16(spark, d):
    return rounded(combined(spark, d).select("profile_id", "barrier", "total", "rank"))


@query("C16_coping_scores", f"""WITH {COMB}, cm AS (SELECT DISTINCT p_name barrier_path, p_container coping, score FROM (SELECT p_name, p_type || ' aid' p_container, max(p_size / 50) score FROM part GROUP BY ALL)), xb AS (SELECT barrier, {PTOK.format('barrier')} tb, [lower(barrier)] sb FROM (SELECT DISTINCT barrier FROM tb)), xm AS (SELECT barrier_path, {PTOK.format('barrier_path')} tm, [lower(barrier_path)] sm FROM (SELECT DISTINCT barrier_path FROM cm)),
si AS (SELECT barrier, barrier_path, greatest({similarity_sql('sb', 'sm', 'tb', 'tm')}, len(list_intersect(tb, tm)) / (len(tb) + len(tm) - len(list_intersect(tb, tm)))) sim FROM xb, xm), cc AS (SELECT profile_id, barrier, coping, barrier_path, round(total * score * sim, 9) c FROM tb JOIN si USING (barrier) JOIN cm USING (barrier_path) WHERE sim >= 0.2),
kp AS (SELECT * FROM cc QUALIFY row_number() OVER (PARTITION BY profile_id, barrier ORDER BY c DESC, coping, barrier_path) <= 12) SELECT profile_id, coping, round(max(c), 6) score, count(DISTINCT barrier) n_barriers FROM kp GROUP BY ALL""")
def c16c(spark, d):
    mapping = table(spark, d, "part").groupBy(F.col("p_name").alias("barrier_path"), F.concat("p_type", F.lit(" aid")).alias("coping")).agg(F.max(F.col("p_size") / 50).alias("score"))
    return rounded(Z.coping_scores(cut_lineage(combined(spark, d).select("profile_id", "barrier", "total")), mapping))


@query("C17_quality_scores", f"""WITH {S.ALL_OBS},{S.PROFILE_STATS} SELECT profile_id, code, round(least(1, 0.55 * least(1, greatest(0, 1 - missing_pct)) + 0.20 * least(1, abs(coalesce(sd, 0)) / CASE WHEN code LIKE 'P%' THEN 0.15 ELSE 0.90 END) + 0.25 * CAST(n >= 10 AS INT)), 6) quality FROM prof""")
def c17q(spark, d):
    from lagweave.operators import readiness as R

    return rounded(Z.quality_scores(R.profile_variables(M.all_obs(spark, d)), F.col("n") >= 10).select("profile_id", "code", "quality"))


@query("C17_next_cycle_variables", f"""WITH {ANCH}, {MAPR}, pr AS (SELECT profile_id, anchor code, anchor path, impact, impact * 0.5 target_score, 1 - impact priority, 0.5 quality FROM an), wn AS (SELECT profile_id, path want, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, path) r FROM hy QUALIFY r <= 80),
xa AS (SELECT path, {PTOK.format('path')} ta FROM (SELECT DISTINCT path FROM pr)), xw AS (SELECT want, {PTOK.format('want')} tw FROM (SELECT DISTINCT want FROM wn)), sj AS (SELECT path, want, len(list_intersect(ta, tw)) / (len(ta) + len(tw) - len(list_intersect(ta, tw))) j FROM xa, xw), mt AS (SELECT pr.profile_id, pr.code, max(j / r) m FROM pr JOIN wn USING (profile_id) JOIN sj ON sj.path = pr.path AND sj.want = wn.want GROUP BY ALL),
sc AS (SELECT pr.*, round(0.35 * coalesce(least(1, m), 0) + 0.25 * impact + 0.15 * target_score + 0.10 * priority + 0.15 * quality, 9) score FROM pr LEFT JOIN mt USING (profile_id, code)) SELECT profile_id, code, round(score, 6) score, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, impact DESC, priority DESC, code DESC) AS rank FROM sc QUALIFY rank <= 3""")
def c17(spark, d):
    from lagweave.core.ranking import top_n

    an = anchors_of(spark, d)
    preds = an.select("profile_id", F.col("anchor").alias("code"), F.col("anchor").alias("path"), "impact", (F.col("impact") * 0.5).alias("target_score"), (1 - F.col("impact")).alias("priority"), F.lit(0.5).alias("quality"))
    wanted = top_n(mapping_rows(spark, d)[1], ["profile_id"], [F.desc("score"), F.col("path")], 80).select("profile_id", "path", "rank")
    return rounded(Z.next_cycle_variables(preds, wanted, 2, 8, 3).select("profile_id", "code", "score", "rank"))


@query("C17_next_cycle_criteria", """WITH c AS (SELECT 'n' || c_nationkey profile_id, c_mktsegment || c_custkey % 4 code, max(c_custkey % 5) = 4 retained, max(c_acctbal) / 10000 quality, count(*) severity FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY retained DESC, quality DESC, severity DESC, code DESC) "position", sum(CAST(retained AS INT)) OVER (PARTITION BY profile_id) k FROM c)
SELECT profile_id, code, retained, "position" FROM r WHERE "position" <= least(8, greatest(k, 4))""")
def c17c(spark, d):
    c = table(spark, d, "customer").groupBy(F.concat(F.lit("n"), "c_nationkey").alias("profile_id"), F.concat("c_mktsegment", F.col("c_custkey") % 4).alias("code")).agg((F.max(F.col("c_custkey") % 5) == 4).alias("retained"), (F.max("c_acctbal") / 10000).alias("quality"), F.count(F.lit(1)).alias("severity"))
    return Z.next_cycle_criteria(c, 2, 8, 4).drop("quality", "severity")


GW = {"quality": 0.5, "safety": 0.3, "reach": 0.2, "cost": 0.1}


@query("C18_guardrail", """WITH s AS (SELECT doc_id item, 'quality' AS "dimension", 30 + doc_id % 70 score, false critical FROM documents UNION ALL SELECT doc_id, 'safety', (n_chars % 900) + 101, toxic = 1 FROM labels JOIN documents USING (doc_id) UNION ALL SELECT doc_id, 'reach', quality * 0.7, false FROM labels),
n AS (SELECT *, CASE WHEN score > 100 THEN score / 1000 WHEN score > 1 THEN score / 100 ELSE score END v, CASE "dimension" WHEN 'quality' THEN 0.5 WHEN 'safety' THEN 0.3 ELSE 0.2 END / 1.1 w FROM s), g AS (SELECT item, round(least(1, sum(w * least(1, v))), 6) composite, CAST(sum(CAST(critical AS INT)) AS BIGINT) n_critical, count(*) FILTER ("dimension" = 'safety') k FROM n GROUP BY 1)
SELECT item, composite, n_critical, CASE WHEN k = 0 THEN 'cost|reach|safety' ELSE 'cost' END missing_dimensions, CASE WHEN n_critical = 0 AND composite >= 0.5 THEN 'PASS' ELSE 'REVISE' END decision FROM g""")
def c18(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    both = labels.join(docs.select("doc_id", "n_chars"), "doc_id")
    row = lambda df, dim, score, crit: df.select(F.col("doc_id").alias("item"), F.lit(dim).alias("dimension"), score.cast("double").alias("score"), crit.alias("critical"))
    scores = row(docs, "quality", 30 + F.col("doc_id") % 70, F.lit(False)).unionByName(row(both, "safety", F.col("n_chars") % 900 + 101, F.col("toxic") == 1)).unionByName(row(labels, "reach", F.col("quality") * 0.7, F.lit(False)))
    out = Z.guardrail(scores, GW, 0.5).withColumn("missing_dimensions", joined("missing_dimensions"))
    return rounded(out).withColumn("n_critical", F.col("n_critical").cast("long"))


@query("C19_update_shortlist", f"""WITH {CAND}, sl AS (SELECT profile_id, path, 0 source, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, path) "position" FROM cd QUALIFY "position" <= 10), sh AS (SELECT profile_id, path, 1 source, row_number() OVER (PARTITION BY profile_id ORDER BY path) "position" FROM cd QUALIFY "position" <= 30),
b AS (SELECT profile_id, path, min((source, "position")) s FROM (SELECT * FROM sl UNION ALL SELECT * FROM sh) GROUP BY ALL) SELECT profile_id, path, struct_extract_at(s, 1) source, CAST(struct_extract_at(s, 2) AS INT) "position", row_number() OVER (PARTITION BY profile_id ORDER BY s, path) AS rank FROM b QUALIFY rank <= 20""")
def c19(spark, d):
    from lagweave.core.ranking import top_n

    c = cut_lineage(candidates(spark, d))
    sel = top_n(c, ["profile_id"], [F.desc("score"), F.col("path")], 10, "position").select("profile_id", "path", "position")
    short = top_n(c, ["profile_id"], [F.col("path")], 30, "position").select("profile_id", "path", "position")
    return Z.update_shortlist(sel, short)


@query("C20_column_stats", """WITH """ + __import__("lagweave.catalog.fragments", fromlist=["x"]).ALL_OBS + """, q AS (SELECT profile_id, code, median(value) md, stddev_samp(value) sd, quantile_cont(value, 0.02) lo, quantile_cont(value, 0.98) hi, 1 - count(value) / count(*) mr FROM obs GROUP BY ALL)
SELECT profile_id, code, round(md, 6) median, round(sd, 6) sd, round(lo - 0.05 * (hi - lo), 6) low, round(hi + 0.05 * (hi - lo), 6) high, round(mr, 6) missing_rate FROM q""")
def c20(spark, d):
    return rounded(Z.column_stats(M.all_obs(spark, d)))


@query("W20_previous_cycle_scores", """WITH r AS (SELECT o_custkey % 100 profile_id, year(o_orderdate) AS "cycle", o_orderpriority || '/' || o_orderstatus path, sum(o_totalprice) s FROM orders GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY profile_id, "cycle" ORDER BY s DESC, path) p, dense_rank() OVER (PARTITION BY profile_id ORDER BY "cycle" DESC) c FROM r)
SELECT profile_id, lower(path) path, round(max(greatest(0.1, 1 - (p - 1) / 20)), 6) previous_score FROM k WHERE c <= 3 GROUP BY ALL""")
def w20(spark, d):
    s = table(spark, d, "orders").groupBy((F.col("o_custkey") % 100).alias("profile_id"), F.year("o_orderdate").alias("cycle"), F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("path")).agg(F.sum("o_totalprice").alias("s"))
    hist = s.groupBy("profile_id", "cycle").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("n"), "path"))), lambda x: x["path"]).alias("paths"))
    return rounded(T.previous_cycle_scores(hist, 3))
