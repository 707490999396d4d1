"""Queries on sparse mappings, suitability and rank lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.catalog import fragments as S
from lagweave.core.session import cut_lineage
from lagweave.catalog.registry import joined, query, rounded
from lagweave.operators import mapping as G
from lagweave.operators import tests as H
from lagweave.sources import tables as M
from lagweave.sources.tables import PRIMARY, table

HIER = """hier AS (SELECT p_partkey predictor_id, (['BIO', 'PSYCHO', 'SOCIAL'])[p_size % 3 + 1] "primary", p_type secondary, p_brand tertiary,
 concat_ws(' > ', (['BIO', 'PSYCHO', 'SOCIAL'])[p_size % 3 + 1], p_type, p_brand, p_name || ' ' || p_partkey) predictor_full_path FROM part)"""
EDGES = """raw AS (SELECT l_suppkey cluster_id, l_partkey predictor_id, l_quantity * 20 + l_linenumber score FROM lineitem),
edges AS (SELECT CAST(cluster_id AS VARCHAR) cluster_id, CAST(predictor_id AS INT) predictor_id, max(score) score FROM raw WHERE score BETWEEN 1 AND 1000 GROUP BY ALL)"""
HEDGES = f"""{HIER},{EDGES}, he AS (SELECT e.*, coalesce("primary", 'UNKNOWN_PRIMARY') "primary", coalesce(secondary, 'UNKNOWN_SECONDARY') secondary, coalesce(tertiary, 'UNKNOWN_TERTIARY') tertiary
 FROM edges e LEFT JOIN hier USING (predictor_id))"""


def zero_stats_sql(src: str, keys: str, denom: str, value: str = "score") -> str:
    """Zero-aware statistics with the zeros spelled out as a list, for comparison."""
    return f"""zs AS (SELECT {keys}, sum({value}) s, sum({value} * {value}) s2, count(*) k, min({value}) mn, max({value}) mx, {denom} d, list_sort(list({value})) vals FROM {src} GROUP BY ALL),
zq AS (SELECT *, d - k z, (d + 1) // 2 lo, d // 2 + 1 hi FROM zs)
SELECT {keys}, round(s / d, 6) mean_score, round((CASE WHEN lo <= z THEN 0 ELSE vals[lo - z] END + CASE WHEN hi <= z THEN 0 ELSE vals[hi - z] END) / 2, 6) median_score,
round(sqrt(greatest(0, (s2 - s * s / d) / (d - 1))), 6) std_score, round(mx, 6) max_score, round(CASE WHEN z > 0 THEN 0.0 ELSE mn END, 6) min_score, round(k / d * 100, 6) pct_nonzero, k n_edges FROM zq"""


def edges_of(spark: SparkSession, d: str) -> DataFrame:
    return G.load_edges(M.raw_edges(spark, d))


def domain_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.attach_hierarchy(edges_of(spark, d), M.hierarchy(spark, d))


def size(spark, d, name):
    return table(spark, d, name).count()


@query("S06_load_edges", f"WITH {EDGES} SELECT * FROM edges")
def s06(spark, d):
    return edges_of(spark, d)


@query("J01_attach_hierarchy", f"""WITH {HIER}, few AS (SELECT * FROM hier WHERE predictor_id % 7 <> 0), {EDGES}, pth AS (SELECT e.*, CASE WHEN predictor_id % 14 = 0 THEN 'BIO > parsed' END p FROM edges e)
SELECT cluster_id, predictor_id, score, coalesce("primary", split_part(p, ' > ', 1), 'UNKNOWN_PRIMARY') "primary", coalesce(secondary, split_part(p, ' > ', 2), 'UNKNOWN_SECONDARY') secondary, coalesce(tertiary, 'UNKNOWN_TERTIARY') tertiary
FROM pth LEFT JOIN few USING (predictor_id)""")
def j01(spark, d):
    few = M.hierarchy(spark, d).where(F.col("predictor_id") % 7 != 0)
    edges = edges_of(spark, d).withColumn("p", F.when(F.col("predictor_id") % 14 == 0, "BIO > parsed"))
    return G.attach_hierarchy(edges, few, "p").drop("p")


@query("A09_cluster_stats", f"WITH {EDGES}, {zero_stats_sql('edges', 'cluster_id', '(SELECT count(*) FROM part)')}")
def a09(spark, d):
    return rounded(G.sparse_stats(edges_of(spark, d), ["cluster_id"], F.lit(size(spark, d, "part"))))


@query("A09_predictor_stats", f"WITH {HEDGES}, {zero_stats_sql('he', 'predictor_id, secondary', '(SELECT count(*) FROM supplier)')}")
def a09p(spark, d):
    return rounded(G.sparse_stats(domain_edges(spark, d), ["predictor_id", "secondary"], F.lit(size(spark, d, "supplier"))))


DM = f"""WITH {HEDGES}, lv AS (SELECT "primary", count(*) n FROM hier GROUP BY 1), sp AS (SELECT DISTINCT cluster_id, unnest(['BIO', 'PSYCHO', 'SOCIAL']) "primary" FROM edges),
sm AS (SELECT cluster_id, "primary", sum(score) s FROM he GROUP BY ALL), pm AS (SELECT cluster_id, "primary", coalesce(s, 0) / coalesce(n, 1) cluster_mean_score FROM sp LEFT JOIN sm USING (cluster_id, "primary") LEFT JOIN lv USING ("primary")),
lv2 AS (SELECT "primary", secondary, count(*) n FROM hier GROUP BY ALL), dm AS (SELECT cluster_id, "primary", secondary, sum(score) / max(coalesce(n, 1)) cluster_mean_score FROM he LEFT JOIN lv2 USING ("primary", secondary) GROUP BY ALL)"""


def primary_means(spark, d):
    return G.domain_means(domain_edges(spark, d), M.hierarchy(spark, d), ["primary"], PRIMARY)


def secondary_means(spark, d):
    return G.domain_means(domain_edges(spark, d), M.hierarchy(spark, d), ["primary", "secondary"])


@query("A10_primary_means", f"{DM} SELECT cluster_id, \"primary\", round(cluster_mean_score, 6) cluster_mean_score FROM pm")
def a10(spark, d):
    return rounded(primary_means(spark, d))


@query("A10_secondary_means", f"{DM} SELECT cluster_id, \"primary\", secondary, round(cluster_mean_score, 6) cluster_mean_score FROM dm")
def a10s(spark, d):
    return rounded(secondary_means(spark, d))


@query("A11_primary_summary", f"""{DM} SELECT "primary", count(*) n_clusters, round(avg(cluster_mean_score), 6) mean_across_clusters, round(stddev_samp(cluster_mean_score), 6) std_across_clusters, round(100.0 * count(*) FILTER (cluster_mean_score > 0) / count(*), 6) pct_clusters_nonzero,
round(coalesce(avg(cluster_mean_score) FILTER (cluster_mean_score > 0), 0), 6) mean_nonzero_clusters, round(max(cluster_mean_score), 6) max_cluster_mean, round(median(cluster_mean_score), 6) median_across_clusters FROM pm GROUP BY 1""")
def a11(spark, d):
    return rounded(G.domain_summary(primary_means(spark, d), ["primary"]))


@query("A11_secondary_summary", f"""{DM}, zr AS (SELECT c.cluster_id, s."primary", s.secondary, coalesce(dm.cluster_mean_score, 0) v FROM (SELECT CAST(s_suppkey AS VARCHAR) cluster_id FROM supplier) c CROSS JOIN (SELECT DISTINCT "primary", secondary FROM dm) s LEFT JOIN dm USING (cluster_id, "primary", secondary))
SELECT "primary", secondary, count(*) n_clusters, round(avg(v), 6) mean_across_clusters, round(median(v), 6) median_across_clusters, round(stddev_samp(v), 6) std_across_clusters, round(100.0 * count(*) FILTER (v > 0) / count(*), 6) pct_clusters_nonzero, round(coalesce(avg(v) FILTER (v > 0), 0), 6) mean_nonzero_clusters, round(max(v), 6) max_cluster_mean FROM zr GROUP BY ALL""")
def a11s(spark, d):
    out = rounded(G.domain_summary(secondary_means(spark, d), ["primary", "secondary"], size(spark, d, "supplier")))
    return out.withColumn("n_clusters", F.col("n_clusters").cast("long"))


@query("A12_overview", f"""WITH {EDGES}, t AS (SELECT (SELECT count(*) FROM supplier) * (SELECT count(*) FROM part) n), b AS (SELECT CASE WHEN floor(score) = 1000 THEN '1000' WHEN score >= 900 THEN '900-999' WHEN score >= 700 THEN '700-899' WHEN score >= 400 THEN '400-699' WHEN score >= 100 THEN '100-399' ELSE '1-99' END bucket FROM edges),
n AS (SELECT unnest(['1000', '900-999', '700-899', '400-699', '100-399', '1-99']) bucket)
SELECT n.bucket, count(b.bucket) n_pairs, round(100.0 * count(b.bucket) / max(t.n), 6) pct FROM n LEFT JOIN b ON b.bucket = n.bucket, t GROUP BY 1 UNION ALL SELECT '0', t.n - (SELECT count(*) FROM edges), round(100.0 * (t.n - (SELECT count(*) FROM edges)) / t.n, 6) FROM t""")
def a12(spark, d):
    return rounded(G.overview(edges_of(spark, d), size(spark, d, "supplier"), size(spark, d, "part")))


@query("A12_totals", f"""WITH {EDGES}, t AS (SELECT (SELECT count(*) FROM supplier) c, (SELECT count(*) FROM part) p)
SELECT c n_clusters, p n_predictors, count(*) n_edges, round(sum(score) / (c * p), 6) mean_with_zeros, round(avg(score), 6) mean_nonzero, round(100.0 * count(*) / (c * p), 6) pct_nonzero, round(max(score), 6) max_score FROM edges, t GROUP BY c, p""")
def a12t(spark, d):
    return rounded(G.mapping_totals(edges_of(spark, d), size(spark, d, "supplier"), size(spark, d, "part")))


PAIRS = "pr AS (SELECT predictor_id, cluster_id, avg(score) score FROM (SELECT l_partkey predictor_id, l_suppkey cluster_id, CASE WHEN l_linenumber <> 7 THEN l_quantity * 20 END score FROM lineitem) GROUP BY ALL)"


def pair_rows(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("predictor_id"), F.col("l_suppkey").alias("cluster_id"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity") * 20).alias("score"))


@query("A13_by_predictor", f"""WITH {PAIRS} SELECT predictor_id, round(avg(score), 6) avg_uncorrected, round(coalesce(sum(score), 0) / (SELECT count(*) FROM supplier), 6) avg_corrected, count(*) pairs_present, (SELECT count(*) FROM supplier) - count(score) missing_total FROM pr GROUP BY 1""")
def a13(spark, d):
    return rounded(G.topk_mapping(pair_rows(spark, d), "predictor_id", "cluster_id", "left", (size(spark, d, "part"), size(spark, d, "supplier"))))


@query("A13_pairs", f"WITH {PAIRS} SELECT predictor_id, cluster_id, round(score, 6) score FROM pr")
def a13p(spark, d):
    return rounded(G.topk_mapping(pair_rows(spark, d), "predictor_id", "cluster_id", "pairs", (0, 0)))


@query("A13_by_cluster_with_ids", f"""WITH {PAIRS}, ids AS (SELECT p_partkey predictor_id FROM part WHERE p_size <= 25), cl AS (SELECT s_suppkey cluster_id FROM supplier UNION SELECT s_suppkey + 1000000 FROM supplier),
f AS (SELECT * FROM pr WHERE predictor_id IN (SELECT predictor_id FROM ids)), g AS (SELECT cluster_id, avg(score) u, coalesce(sum(score), 0) / (SELECT count(*) FROM ids) c, count(*) n, (SELECT count(*) FROM ids) - count(score) m FROM f GROUP BY 1)
SELECT cluster_id, round(u, 6) avg_uncorrected, round(coalesce(c, 0), 6) avg_corrected, coalesce(n, 0) pairs_present, coalesce(m, (SELECT count(*) FROM ids)) missing_total FROM cl LEFT JOIN g USING (cluster_id)""")
def a13c(spark, d):
    ids = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("predictor_id"))
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cluster_id"))
    both = sup.union(sup.select(F.col("cluster_id") + 1000000))
    return rounded(G.topk_mapping(pair_rows(spark, d), "predictor_id", "cluster_id", "right", (0, 0), left_ids=ids, right_ids=both))


@query("A13_overall", f"""WITH {PAIRS}, t AS (SELECT (SELECT count(*) FROM supplier) * (SELECT count(*) FROM part) n) SELECT round(avg(score), 6) avg_uncorrected, round(sum(score) / max(n), 6) avg_corrected, count(*) pairs_present, max(n) - count(score) missing_total, max(n) pairs_total FROM pr, t""")
def a13o(spark, d):
    out = G.topk_mapping(pair_rows(spark, d), "predictor_id", "cluster_id", "both", (size(spark, d, "part"), size(spark, d, "supplier")))
    return rounded(out.withColumn("pairs_total", F.col("pairs_total").cast("long")).withColumn("missing_total", F.col("missing_total").cast("long")))


@query("P12_filter_ids", "SELECT l_suppkey cluster_id, count(*) n, round(sum(l_quantity), 4) total FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def p12(spark, d):
    from lagweave.sources.contracts import filter_ids

    ids = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("cluster_id"))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cluster_id"), "l_quantity")
    return rounded(filter_ids(rows, "cluster_id", ids).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total")), 4)


@query("K04_top_edges", f"WITH {EDGES} SELECT * FROM edges ORDER BY score DESC, cluster_id, predictor_id LIMIT 50")
def k04(spark, d):
    return G.top_edges(edges_of(spark, d), 50)


@query("K04_top_edges_per_cluster", f"WITH {EDGES} SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, predictor_id) AS rank FROM edges QUALIFY rank <= 5")
def k04c(spark, d):
    return G.top_edges(edges_of(spark, d), 5, "cluster_id")


@query("K05_filter_edges", f"""WITH {EDGES}, c AS (SELECT greatest(quantile_cont(score, 0.90), 100) cut FROM edges), k AS (SELECT * FROM edges, c WHERE score >= cut)
SELECT DISTINCT cluster_id, predictor_id, score FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, predictor_id) a, row_number() OVER (PARTITION BY predictor_id ORDER BY score DESC, cluster_id) b FROM k) WHERE a <= 10 OR b <= 10""")
def k05(spark, d):
    return G.filter_edges(edges_of(spark, d), 0.90, 100.0, 10).select("cluster_id", "predictor_id", "score")


@query("A21_densify", f"WITH {HEDGES} SELECT cluster_id, " + ", ".join(f"round(coalesce(max(score) FILTER (tertiary = 'Brand#{i}'), 0), 4) AS \"Brand#{i}\"" for i in range(1, 26)) + " FROM he GROUP BY 1")
def a21(spark, d):
    return rounded(G.densify(domain_edges(spark, d), "cluster_id", "tertiary", [f"Brand#{i}" for i in range(1, 26)]), 4)


@query("H05_friedman", f"""{DM}, ft AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) k, rank() OVER (PARTITION BY cluster_id ORDER BY cluster_mean_score) + (count(*) OVER (PARTITION BY cluster_id, cluster_mean_score) - 1) / 2 r, count(*) OVER (PARTITION BY cluster_id, cluster_mean_score) t FROM pm),
g AS (SELECT "primary", sum(r) r, count(*) n, sum(t * t - 1) t3 FROM ft WHERE k = 3 GROUP BY 1), s AS (SELECT max(n) n, sum(r * r) rr, sum(t3) ties FROM g), x AS (SELECT n, (12 / (n * 3 * 4) * rr - 3 * n * 4) / (1 - ties / (n * 24)) chi FROM s WHERE n >= 5)
SELECT n n_blocks, round(chi, 6) "statistic", round({S.chi2_tail_sql('chi', '2')}, 6) p_value FROM x""")
def h05(spark, d):
    return rounded(H.friedman(primary_means(spark, d), "cluster_id", "primary", "cluster_mean_score"))


DIFFS = f"""{DM}, wd AS (SELECT cluster_id, max(cluster_mean_score) FILTER ("primary" = 'BIO') b, max(cluster_mean_score) FILTER ("primary" = 'PSYCHO') p, max(cluster_mean_score) FILTER ("primary" = 'SOCIAL') s FROM pm GROUP BY 1),
df AS (SELECT cluster_id, 'BIO' a, 'PSYCHO' b, b - p diff FROM wd UNION ALL SELECT cluster_id, 'BIO', 'SOCIAL', b - s FROM wd UNION ALL SELECT cluster_id, 'PSYCHO', 'SOCIAL', p - s FROM wd),
nz AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY a, b, abs(diff)) - 1) / 2 r, count(*) OVER (PARTITION BY a, b, abs(diff)) t FROM df WHERE diff <> 0),
ag AS (SELECT a, b, coalesce(sum(r) FILTER (diff > 0), 0) w, count(*) n, sum(t * t - 1) t3 FROM nz GROUP BY ALL), al AS (SELECT a, b, count(*) n_blocks, avg(diff) md, median(diff) me FROM df GROUP BY ALL),
wx AS (SELECT al.*, least(w, n * (n + 1) / 2 - w) st, CASE WHEN n_blocks >= 5 THEN (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t3 / 48) END z FROM al LEFT JOIN ag USING (a, b)),
wp AS (SELECT *, {S.norm_tail_sql('z')} p FROM wx)"""
DOMAIN_PAIRS = [("BIO", "PSYCHO"), ("BIO", "SOCIAL"), ("PSYCHO", "SOCIAL")]


def diffs_of(spark, d):
    return H.paired_differences(primary_means(spark, d), "cluster_id", "primary", "cluster_mean_score", DOMAIN_PAIRS)


@query("H06_paired_tests", f"{DIFFS} SELECT a, b, n_blocks, round(md, 6) mean_diff, round(me, 6) median_diff, round(st, 6) \"statistic\", round(p, 6) p_raw FROM wp")
def h06(spark, d):
    return rounded(H.wilcoxon(diffs_of(spark, d)))


@query("H06_sign_flip")
def h06s(spark, d):
    return rounded(H.sign_flip_test(diffs_of(spark, d)))


@query("H06_paired_fallback", f"""{DIFFS} SELECT a, b, n_blocks, round(md, 6) mean_diff, round(p, 6) p_raw, 'signed_rank' AS "method" FROM wp UNION ALL SELECT 'BIO', 'BIO', n_blocks, 0.0, 1.0, 'sign_flip' FROM wp WHERE b = 'PSYCHO'""")
def h06f(spark, d):
    """A domain beside itself has no spread of ranks, so its p comes from permutations."""
    diffs = H.paired_differences(primary_means(spark, d), "cluster_id", "primary", "cluster_mean_score", [*DOMAIN_PAIRS, ("BIO", "BIO")])
    return rounded(H.paired_test(cut_lineage(diffs), 2000).select("a", "b", "n_blocks", "mean_diff", "p_raw", "method"))


@query("H07_holm", f"""{DIFFS}, hp AS (SELECT a, b, p, (count(*) OVER () - row_number() OVER (ORDER BY p, a, b) + 1) * p v FROM wp WHERE p IS NOT NULL)
SELECT a, b, round(p, 6) p_raw, round(least(1.0, max(v) OVER (ORDER BY p, a, b)), 6) p_holm FROM hp""")
def h07(spark, d):
    tested = H.wilcoxon(diffs_of(spark, d)).select(F.lit("primary").alias("family"), "a", "b", "p_raw")
    return rounded(H.holm(tested, ["family"], "p_raw", ["a", "b"]).drop("family"))


# A two-dimension weight table for the suitability queries.
WEIGHTS = [("burden", "effort", "length", 0.6, 0.5, 0.4), ("burden", "effort", "reading", 0.4, 0.5, 0.4), ("burden", "access", "language", 1.0, 0.5, 0.4),
           ("utility", "evidence", "quality", 0.7, 0.8, 0.6), ("utility", "evidence", "safety", 0.3, 0.8, 0.6), ("utility", "reach", "source", 1.0, 0.2, 0.6)]
WEIGHT_COLS = "dimension string, module string, feature string, w_feature double, w_module double, w_dimension double"
SCORES_SQL = "w(dimension, module, feature, wf, wm, wd, i) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {x}, {y}, {z}, {i})" for i, (a, b, c, x, y, z) in enumerate(WEIGHTS)) + """),
ris AS (SELECT doc_id, lang, source, dimension, module, feature, CAST(wf AS DOUBLE) wf, CAST(wm AS DOUBLE) wm, CAST(wd AS DOUBLE) wd, (1 + (doc_id * 7 + n_chars * 3 + i * 5) % 9 - 1) / 8 risk FROM documents, w WHERE (doc_id + i) % 11 <> 0),
mo AS (SELECT doc_id, dimension, module, sum(wf * risk) / sum(wf) mr, max(wm) wm, max(wd) wd FROM ris GROUP BY ALL),
di AS (SELECT doc_id, dimension, sum(wm * mr) / sum(wm) dr, min(mr) br, max(wd) wd FROM mo GROUP BY ALL), su AS (SELECT doc_id, 1 - sum(wd * dr) / sum(wd) overall_suitability, min(br) best_method_risk, count(*) n_dimensions FROM di GROUP BY 1)"""


def weights_of(spark):
    return spark.createDataFrame(WEIGHTS, WEIGHT_COLS)


def likert(spark, d):
    feats = F.array(*[F.struct(F.lit(a).alias("dimension"), F.lit(b).alias("module"), F.lit(c).alias("feature"), F.lit(i).alias("i")) for i, (a, b, c, *_) in enumerate(WEIGHTS)])
    rows = table(spark, d, "documents").select("doc_id", "n_chars", F.explode(feats).alias("f")).select("doc_id", "n_chars", "f.*").where((F.col("doc_id") + F.col("i")) % 11 != 0)
    return rows.select("doc_id", "dimension", "module", "feature", (1 + (F.col("doc_id") * 7 + F.col("n_chars") * 3 + F.col("i") * 5) % 9).alias("score"))


@query("A14_weighted_suitability", f"WITH {SCORES_SQL} SELECT doc_id, round(overall_suitability, 6) overall_suitability, round(best_method_risk, 6) best_method_risk, n_dimensions FROM su")
def a14(spark, d):
    return rounded(G.weighted_suitability(likert(spark, d), weights_of(spark), "doc_id"))


CONTRIB = """, nf AS (SELECT *, wf / sum(wf) OVER (PARTITION BY doc_id, dimension, module) f FROM ris), nm AS (SELECT *, wm / sum(wm) OVER (PARTITION BY doc_id, dimension) m FROM mo), nd AS (SELECT *, wd / sum(wd) OVER (PARTITION BY doc_id) n FROM di),
ct AS (SELECT nf.doc_id, nf.dimension, nf.module, feature, f * m * n * risk c FROM nf JOIN nm USING (doc_id, dimension, module) JOIN nd USING (doc_id, dimension))"""


@query("A15_risk_contributions", f"WITH {SCORES_SQL} {CONTRIB} SELECT doc_id, dimension, module, feature, round(c, 6) contribution FROM ct")
def a15(spark, d):
    return rounded(G.risk_contributions(likert(spark, d), weights_of(spark), "doc_id"))


@query("A15_global_contributions", f"WITH {SCORES_SQL} {CONTRIB} SELECT dimension, module, feature, round(avg(c), 6) mean_contribution, count(*) n FROM ct GROUP BY ALL")
def a15g(spark, d):
    return rounded(G.global_contributions(G.risk_contributions(likert(spark, d), weights_of(spark), "doc_id")))


def feasibility_frame(spark, d):
    """Suitability of every document on the path language / source / id."""
    suit = G.weighted_suitability(likert(spark, d), weights_of(spark), "doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws(" > ", "lang", "source", F.col("doc_id").cast("string")).alias("path"))
    return docs.join(suit, "doc_id").select("path", "overall_suitability", F.col("best_method_risk").alias("utility_risk"))


@query("A16_parent_domain_scores", f"""WITH {SCORES_SQL} SELECT lang || ' / ' || source parent_domain, count(*) n_predictors, round(avg(overall_suitability), 6) mean_overall_suitability, round(max(overall_suitability), 6) max_overall_suitability, round(avg(best_method_risk), 6) mean_utility_risk FROM su JOIN documents USING (doc_id) GROUP BY 1""")
def a16(spark, d):
    return rounded(G.parent_domain_scores(feasibility_frame(spark, d)))


@query("A17_majority_label", "WITH c AS (SELECT source, lang, count(*) n FROM documents GROUP BY ALL) SELECT source, lang majority, n votes, CAST((SELECT sum(n) FROM c x WHERE x.source = c.source) AS BIGINT) n_members FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1")
def a17(spark, d):
    return G.majority_label(table(spark, d, "documents"), "source", "lang")


LISTS = """pl AS (SELECT o_custkey % 50 AS profile_id, year(o_orderdate) run_id, o_orderpriority || ' / ' || o_orderstatus path, round(avg(o_totalprice), 4) score FROM orders GROUP BY ALL),
li AS (SELECT *, row_number() OVER (PARTITION BY profile_id, run_id ORDER BY score DESC, path) AS rank FROM pl QUALIFY rank <= 10)"""


def rank_lists(spark, d):
    from lagweave.core.ranking import top_n

    per = table(spark, d, "orders").groupBy(
        (F.col("o_custkey") % 50).alias("profile_id"), F.year("o_orderdate").alias("run_id"), F.concat_ws(" / ", "o_orderpriority", "o_orderstatus").alias("path")
    ).agg((F.round(F.avg("o_totalprice") + 1e-7, 4)).alias("score"))
    return top_n(per, ["profile_id", "run_id"], [F.desc("score"), F.col("path")], 10)


STAB = f"""WITH {LISTS}, nr AS (SELECT profile_id, count(DISTINCT run_id) n FROM li GROUP BY 1), st AS (SELECT profile_id, path, count(DISTINCT run_id) n_present_runs, count(DISTINCT run_id) / max(n) presence_frequency, avg(rank) mean_rank, stddev_pop(rank) std_rank, avg(score) mean_score, stddev_pop(score) std_score FROM li JOIN nr USING (profile_id) GROUP BY ALL)"""


@query("A18_rank_stability", f"{STAB} SELECT profile_id, path, n_present_runs, round(presence_frequency, 6) presence_frequency, round(mean_rank, 6) mean_rank, round(std_rank, 6) std_rank, round(mean_score, 4) mean_score, round(std_score, 4) std_score FROM st")
def a18(spark, d):
    out = G.rank_stability(rank_lists(spark, d))
    return rounded(rounded(out.drop("mean_score", "std_score")).join(rounded(out.select("profile_id", "path", "mean_score", "std_score"), 4), ["profile_id", "path"]))


@query("A18_stability_domains", f"""{STAB}, tp AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY presence_frequency DESC, mean_rank, path) r FROM st QUALIFY r <= 8) SELECT profile_id, split_part(path, ' / ', 1) "domain", count(*) n_paths, round(sum(mean_score), 4) total_score FROM tp GROUP BY ALL""")
def a18d(spark, d):
    return rounded(G.stability_domains(G.rank_stability(rank_lists(spark, d)), 8), 4)


@query("A19_mapping_digest", """WITH r AS (SELECT l_returnflag part, CASE l_linestatus WHEN 'F' THEN ' ' ELSE l_linestatus || l_linenumber END criterion_path, p_type || ' / ' || p_brand predictor_path, l_quantity / 50 + l_tax score FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT part, count(*) n_rows, count(DISTINCT nullif(trim(criterion_path), '')) n_criteria FROM r GROUP BY 1), b AS (SELECT part, predictor_path, max(score) best_score FROM r GROUP BY ALL)
SELECT part, predictor_path, round(best_score, 6) best_score, row_number() OVER (PARTITION BY part ORDER BY best_score DESC, predictor_path) AS rank, n_rows, n_criteria FROM b JOIN t USING (part) QUALIFY rank <= 30""")
def a19(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_returnflag").alias("part"), F.when(F.col("l_linestatus") == "F", " ").otherwise(F.concat("l_linestatus", "l_linenumber")).alias("criterion_path"),
        F.concat_ws(" / ", "p_type", "p_brand").alias("predictor_path"), (F.col("l_quantity") / 50 + F.col("l_tax")).alias("score"))
    return rounded(G.mapping_digest(rows))


@query("A24_violation_rate", """WITH e AS (SELECT DISTINCT (['BIO', 'PSYCHO', 'SOCIAL'])[p_size % 3 + 1] "domain", p_type parent, p_brand child FROM part),
v AS (SELECT p_type parent, p_brand child, round(avg(l_discount), 9) > 0.05 violated FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), j AS (SELECT * FROM e LEFT JOIN v USING (parent, child))
SELECT "domain", count(*) n_pairs, count(violated) n_judged, round(avg(CAST(violated AS INT)), 6) violation_rate FROM j GROUP BY ROLLUP ("domain")""")
def a24(spark, d):
    part = table(spark, d, "part")
    edges = M.hierarchy(spark, d).select(F.col("primary").alias("domain"), F.col("secondary").alias("parent"), F.col("tertiary").alias("child")).distinct()
    verdicts = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("p_type").alias("parent"), F.col("p_brand").alias("child")).agg((F.round(F.avg("l_discount"), 9) > 0.05).alias("violated"))
    return rounded(G.violation_rate(edges, verdicts))


@query("A26_upsert_entities", """WITH r AS (SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '-') ELSE p_name || '  ' END AS label, p_brand source, p_type evidence FROM part),
k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(label), '[_\\-]+', ' ', 'g'), '\\s+', ' ', 'g')) "key" FROM r)
SELECT "key", arg_min(label, (-length(label), label)) AS label, count(*) n_rows, string_agg(DISTINCT source, '|' ORDER BY source) sources, string_agg(DISTINCT evidence, '|' ORDER BY evidence) evidence FROM k GROUP BY 1""")
def a26(spark, d):
    k = F.col("p_partkey") % 3
    label = F.when(k == 0, F.upper("p_name")).when(k == 1, F.translate("p_name", " ", "-")).otherwise(F.concat("p_name", F.lit("  ")))
    rows = table(spark, d, "part").select(label.alias("label"), F.col("p_brand").alias("source"), F.col("p_type").alias("evidence"))
    return G.upsert_entities(rows).withColumns({"sources": joined("sources"), "evidence": joined("evidence")})


@query("O09_binary_matrix", "SELECT DISTINCT o_custkey AS customer, l_suppkey AS supplier, 1 AS linked FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def o09(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return G.binary_matrix(j.select(F.col("o_custkey").alias("customer"), F.col("l_suppkey").alias("supplier")), "customer", "supplier")
