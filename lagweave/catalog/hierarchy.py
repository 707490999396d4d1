"""Queries on hierarchies, sets, sources, sinks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagweave.catalog import fragments as S
from lagweave.catalog.mapping import LISTS, SCORES_SQL, likert, rank_lists
from lagweave.catalog.registry import joined, query, rounded
from lagweave.catalog.retrieval import PRIM
from lagweave.catalog.selection import CAND, UHASH, candidates, paths_of
from lagweave.core.ranking import top_n
from lagweave.core.session import cut_lineage
from lagweave.functions import paths as P
from lagweave.functions import scores as C
from lagweave.functions import text as X
from lagweave.operators import hierarchy as O
from lagweave.operators import selection as Z
from lagweave.sources import contracts as Q
from lagweave.sources import scans as I
from lagweave.sources import tables as M
from lagweave.sources.tables import table


def leaf_arrays(spark, d):
    return paths_of(spark, d).select(F.array("primary", "secondary", "tertiary", "p_name").alias("path")).distinct()


NODES = f"""lv AS (SELECT DISTINCT {PRIM} a, p_type b, p_brand c, p_name d FROM part), no AS (SELECT DISTINCT a node, '' parent, a AS label, 1 AS depth, false is_leaf FROM lv UNION ALL SELECT DISTINCT a || ' / ' || b, a, b, 2, false FROM lv UNION ALL SELECT DISTINCT concat_ws(' / ', a, b, c), a || ' / ' || b, c, 3, false FROM lv UNION ALL SELECT concat_ws(' / ', a, b, c, d), concat_ws(' / ', a, b, c), d, 4, true FROM lv)"""


def nodes_of(spark, d):
    return cut_lineage(O.node_table(leaf_arrays(spark, d)))


@query("O01_flatten_hierarchy", f"""WITH {NODES} SELECT split_part(node, ' / ', 1) doc_id, array_to_string(string_split(node, ' / ')[2:], ' / ') path, array_to_string(string_split(node, ' / ')[2:-2], ' / ') parent, depth - 1 AS depth, is_leaf FROM no WHERE depth > 1""")
def o01(spark, d):
    """One nested JSON document per primary domain, built from part."""
    leaves = paths_of(spark, d)
    l3 = leaves.select("primary", "secondary", "tertiary", "p_name").distinct().groupBy("primary", "secondary", "tertiary").agg(F.map_from_entries(F.collect_list(F.struct("p_name", F.create_map().cast("map<string,string>")))).alias("m"))
    l2 = l3.groupBy("primary", "secondary").agg(F.map_from_entries(F.collect_list(F.struct("tertiary", "m"))).alias("m"))
    docs = l2.groupBy(F.col("primary").alias("doc_id")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("secondary", "m")))).alias("json"))
    return O.flatten_hierarchy(docs)


LINES = f"""pt AS (SELECT p_partkey, 'd' || (p_partkey // 500) doc_id, p_type, p_brand, p_name FROM part), ln AS (SELECT DISTINCT doc_id, p_type k1, '' k2, -1 k3, '[' || p_type || ']' txt FROM pt UNION ALL SELECT DISTINCT doc_id, p_type, p_brand, -1, '  └─ ' || p_brand FROM pt UNION ALL SELECT doc_id, p_type, p_brand, p_partkey, '      ' || p_name || ' (ID:' || p_partkey || ')' FROM pt)"""


def tree_lines(spark, d):
    p = table(spark, d, "part").withColumn("doc_id", F.concat(F.lit("d"), F.floor(F.col("p_partkey") / 500)))
    no = F.lit(-1).cast("long")
    a = p.select("doc_id", F.col("p_type").alias("k1"), F.lit("").alias("k2"), no.alias("k3"), F.concat(F.lit("["), "p_type", F.lit("]")).alias("text")).distinct()
    b = p.select("doc_id", F.col("p_type"), F.col("p_brand"), no, F.concat(F.lit("  └─ "), "p_brand")).distinct()
    c = p.select("doc_id", "p_type", "p_brand", "p_partkey", F.concat(F.lit("      "), "p_name", F.lit(" (ID:"), "p_partkey", F.lit(")")))
    return a.union(b).union(c).select("doc_id", F.struct("k1", "k2", "k3").alias("line_no"), "text")


@query("O02_parse_tree_lines", "WITH pt AS (SELECT 'd' || (p_partkey // 500) doc_id, CAST(p_partkey AS INT) leaf_id, p_name leaf, p_type AS \"primary\", p_brand secondary, 2 AS depth FROM part) SELECT * FROM pt")
def o02(spark, d):
    return O.parse_tree_lines(tree_lines(spark, d))


@query("K08_depth_aware_sample", f"""WITH {NODES}, w AS (SELECT node, depth, ln({UHASH.format("node || '|7'")}) / CASE WHEN depth <= 1 THEN 1e6 WHEN is_leaf THEN 2 ELSE 1 END s FROM no) SELECT node, depth, row_number() OVER (ORDER BY s DESC, node) AS rank FROM w QUALIFY rank <= 40""")
def k08d(spark, d):
    nodes = nodes_of(spark, d).select("node", "depth", "is_leaf")
    return Z.weighted_sample(nodes, "node", Z.depth_aware_weights(F.col("depth"), F.col("is_leaf")), 40, 7).drop("is_leaf")


@query("O03_nodes_at_level", f"""WITH {NODES} SELECT parent, node, row_number() OVER (ORDER BY parent, node) - 1 id FROM no WHERE depth = 3""")
def o03(spark, d):
    return O.nodes_at_level(leaf_arrays(spark, d), 3)


SIZES = f"""{NODES}, sz AS (SELECT a.node, a.depth, count(*) n_nodes, CAST(sum(CAST(b.is_leaf AS INT)) AS BIGINT) n_leaves FROM no a JOIN (SELECT array_to_string(string_split(node, ' / ')[1:k], ' / ') up, is_leaf FROM no, unnest(range(1, depth + 1)) u(k)) b ON b.up = a.node GROUP BY ALL)"""


@query("O04_subtree_size", f"WITH {SIZES} SELECT * FROM sz")
def o04(spark, d):
    return O.subtree_size(nodes_of(spark, d))


@query("O05_vertical_edges", f"""WITH {NODES} SELECT string_split(parent, ' / ')[-1] parent, label child, parent parent_path, node child_path, CAST(depth - 2 AS INT) parent_depth, is_leaf child_is_leaf FROM no WHERE starts_with(node, 'BIO / ')""")
def o05(spark, d):
    return O.vertical_edges(nodes_of(spark, d), "BIO")


@query("O06_leaf_budget_partition", f"WITH {SIZES} SELECT n.node, n.depth, s.n_leaves FROM no n JOIN sz s ON s.node = n.node LEFT JOIN sz u ON u.node = n.parent WHERE (s.n_leaves <= 20 OR n.is_leaf) AND (u.n_leaves IS NULL OR u.n_leaves > 20)")
def o06(spark, d):
    return O.leaf_budget_partition(nodes_of(spark, d), 20)


@query("O07_hierarchy_report", f"""WITH {NODES}, kd AS (SELECT parent, count(*) n FROM no WHERE parent <> '' GROUP BY 1), dp AS (SELECT label, count(*) n, count(DISTINCT depth) d FROM no GROUP BY 1 HAVING count(*) > 1), lv2 AS (SELECT depth, count(*) n FROM no GROUP BY 1)
SELECT 'nodes' metric, NULL item, CAST(count(*) AS DOUBLE) AS value FROM no UNION ALL SELECT 'leaves', NULL, count(*) FROM no WHERE is_leaf UNION ALL SELECT 'roots', NULL, count(*) FROM no WHERE depth = 1 UNION ALL SELECT 'max_depth', NULL, max(depth) FROM no UNION ALL SELECT 'min_depth', NULL, min(depth) FROM no
UNION ALL SELECT 'avg_depth', NULL, round(avg(depth), 6) FROM no UNION ALL SELECT 'leaf_ratio', NULL, round(avg(CAST(is_leaf AS INT)), 6) FROM no UNION ALL SELECT 'level_nodes', CAST(depth AS VARCHAR), n FROM lv2 UNION ALL SELECT 'widest_level', CAST(arg_max(depth, (n, -depth)) AS VARCHAR), max(n) FROM lv2 UNION ALL SELECT 'median_depth', NULL, median(depth) FROM no
UNION ALL SELECT 'avg_branching', NULL, round(avg(n), 6) FROM kd UNION ALL SELECT 'max_branching', NULL, max(n) FROM kd UNION ALL (SELECT 'top_branching', parent, n FROM kd ORDER BY n DESC, parent LIMIT 10) UNION ALL (SELECT 'deepest_leaf', node, depth FROM no WHERE is_leaf ORDER BY depth DESC, node LIMIT 10)
UNION ALL SELECT 'duplicate_labels', NULL, count(*) FROM dp UNION ALL SELECT 'duplicate_labels_over_depths', NULL, count(*) FILTER (d > 1) FROM dp UNION ALL (SELECT 'top_duplicate', label, n FROM dp ORDER BY n DESC, label LIMIT 10) UNION ALL SELECT 'sibling_duplicates', NULL, count(*) FROM (SELECT parent, lower(label) FROM no GROUP BY ALL HAVING count(*) > 1)""")
def o07(spark, d):
    return rounded(O.hierarchy_report(nodes_of(spark, d)))


@query("O08_clean_hierarchy", f"""WITH r AS (SELECT DISTINCT {PRIM} a, p_type b, p_brand c, p_size % 4 k FROM part) SELECT DISTINCT CASE WHEN a = 'BIO' THEN '' ELSE (CASE WHEN a = 'PSYCHO' THEN a ELSE lower(a) END) || ' / ' END || lower(b) || ' / ' || lower(c) path FROM r WHERE k <> 1""")
def o08(spark, d):
    k = F.col("p_size") % 4
    wrap = F.when(k == 0, F.array("primary", "secondary", F.lit("Diagnostic_Criteria"), "tertiary")).when(k == 1, F.array("primary", "secondary", F.lit("estimated prevalence percent"), "tertiary")).otherwise(F.array("primary", "secondary", "tertiary"))
    return O.clean_hierarchy(paths_of(spark, d).select(wrap.alias("path")), ["PSYCHO"], root="b-i-o").select(joined("path", " / ").alias("path"))


PARENTS = f"""pr AS (SELECT DISTINCT 'p' || p_partkey child, 'b' || replace(p_brand, 'Brand#', '') || p_type parent FROM part UNION SELECT DISTINCT 'b' || replace(p_brand, 'Brand#', '') || p_type, p_type FROM part UNION SELECT DISTINCT p_type, 'root' FROM part)"""


def parents_of(spark, d):
    p = table(spark, d, "part")
    mid = F.concat(F.lit("b"), F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")), "p_type")
    return p.select(F.concat(F.lit("p"), "p_partkey").alias("child"), mid.alias("parent")).union(p.select(mid, "p_type")).union(p.select("p_type", F.lit("root"))).distinct()


ROOTS = f"""{PARENTS}, rp AS (SELECT 'root' node, ['root'] path UNION ALL SELECT child, list_append(path, child) FROM rp JOIN pr ON pr.parent = rp.node)"""


@query("O10_root_paths", f"WITH RECURSIVE {ROOTS} SELECT node, array_to_string(path, ' / ') path FROM rp")
def o10(spark, d):
    return O.root_paths(parents_of(spark, d)).withColumn("path", joined("path", " / "))


@query("O10_ancestors", f"WITH RECURSIVE {ROOTS}, x AS (SELECT node, list_reverse(path)[2:3] up FROM rp) SELECT node, CAST(unnest(range(1, len(up) + 1)) AS INT) distance, unnest(up) ancestor FROM x")
def o10a(spark, d):
    return O.ancestors(O.root_paths(parents_of(spark, d)), 2)


TOPS = """ys AS (SELECT o_custkey % 200 profile_id, year(o_orderdate) y, o_orderpriority || o_orderstatus predictor, sum(o_totalprice) s FROM orders GROUP BY ALL), tp AS (SELECT * FROM ys QUALIFY row_number() OVER (PARTITION BY profile_id, y ORDER BY s DESC, predictor) <= 3)"""


def yearly(spark, d):
    s = table(spark, d, "orders").groupBy((F.col("o_custkey") % 200).alias("profile_id"), F.year("o_orderdate").alias("y"), F.concat("o_orderpriority", "o_orderstatus").alias("predictor")).agg(F.sum("o_totalprice").alias("s"))
    return top_n(s, ["profile_id", "y"], [F.desc("s"), F.col("predictor")], 3)


@query("T01_model_delta", f"WITH {TOPS}, a AS (SELECT profile_id, predictor FROM tp WHERE y = 1997), b AS (SELECT profile_id, predictor FROM tp WHERE y = 1998) SELECT profile_id, predictor, 'added' \"change\" FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT profile_id, predictor, 'dropped' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def t01(spark, d):
    t = yearly(spark, d)
    return O.model_delta(t.where("y = 1997"), t.where("y = 1998"))


@query("T02_merge_candidates", f"""WITH {TOPS}, u AS (SELECT profile_id, predictor AS "key", s, y FROM tp WHERE y IN (1996, 1997, 1998)) SELECT profile_id, "key", round(max(s), 4) score, 'y' || max(y) AS source, count(DISTINCT y) n_sources FROM u GROUP BY ALL""")
def t02(spark, d):
    t = yearly(spark, d).select("profile_id", "y", F.col("predictor").alias("key"), F.col("s").alias("score"))
    return rounded(O.merge_candidates([(f"y{y}", t.where(F.col("y") == y)) for y in (1996, 1997, 1998)]), 4)


@query("T03_dedupe_names", "WITH n AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) i FROM part) SELECT p_partkey, CASE WHEN i = 1 THEN p_name ELSE p_name || ' (' || i || ')' END unique_name FROM n")
def t03(spark, d):
    return O.dedupe_names(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").drop("p_name")


@query("T04_distinct_ordered", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE replace(p_name, ' ', '   ') END item FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) = 1")
def t04(spark, d):
    item = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit("   ")))
    return O.distinct_ordered(table(spark, d, "part").select("p_partkey", item.alias("item")), "item", "p_partkey")


@query("T05_merge_hierarchies", f"""WITH s0 AS (SELECT {PRIM} || ' / ' || p_type node, CAST(max(p_size) AS INT) AS value, 0 src FROM part GROUP BY ALL), s1 AS (SELECT concat_ws(' / ', {PRIM}, p_type, p_brand) node, CAST(max(p_size) AS INT) v, 1 src FROM part WHERE p_type <> 'PROMO' GROUP BY ALL), s2 AS (SELECT concat_ws(' / ', {PRIM}, p_type, p_brand) node, -1 v, 2 src FROM part WHERE p_size > 40 GROUP BY ALL),
u AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2), b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY node ORDER BY src DESC) = 1) SELECT node, value, src FROM b WHERE NOT EXISTS (SELECT 1 FROM u x WHERE starts_with(x.node, b.node || ' / '))""")
def t05(spark, d):
    h = paths_of(spark, d)
    two, three = F.array("primary", "secondary"), F.array("primary", "secondary", "tertiary")
    src = [h.groupBy(two.alias("path")).agg(F.max("p_size").alias("value")), h.where("secondary != 'PROMO'").groupBy(three.alias("path")).agg(F.max("p_size").alias("value")),
           h.where("p_size > 40").select(three.alias("path")).distinct().withColumn("value", F.lit(-1))]
    return O.merge_hierarchies(src)


@query("T06_allowed_paths", f"SELECT DISTINCT {PRIM} || ' / ' || p_type path FROM part UNION SELECT DISTINCT p_type || ' / ' || p_brand FROM part")
def t06(spark, d):
    h = paths_of(spark, d)
    return O.allowed_paths([h.select(F.concat(F.lit("["), "primary", F.lit("] > "), "secondary").alias("path")), h.select(F.concat("secondary", F.lit("/*"), "tertiary").alias("path"))])


@query("A23_stage_report", """WITH a AS (SELECT c_nationkey profile_id, count(*) n_customers FROM customer GROUP BY 1), b AS (SELECT s_nationkey profile_id, round(max(s_acctbal), 4) top_balance FROM supplier GROUP BY 1), c AS (SELECT c_nationkey profile_id, count(*) n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT coalesce(a.profile_id, b.profile_id, c.profile_id) profile_id, n_customers, top_balance, n_orders, CAST(a.profile_id IS NOT NULL AS INT) has_readiness, CAST(b.profile_id IS NOT NULL AS INT) has_network, CAST(c.profile_id IS NOT NULL AS INT) has_impact,
round((CAST(a.profile_id IS NOT NULL AS INT) + CAST(b.profile_id IS NOT NULL AS INT) + CAST(c.profile_id IS NOT NULL AS INT)) / 3, 6) completeness FROM a FULL JOIN b ON a.profile_id = b.profile_id FULL JOIN c ON coalesce(a.profile_id, b.profile_id) = c.profile_id""")
def a23(spark, d):
    cust = table(spark, d, "customer")
    a = cust.groupBy(F.col("c_nationkey").alias("profile_id")).agg(F.count(F.lit(1)).alias("n_customers"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("profile_id")).agg(F.max("s_acctbal").alias("top_balance"))
    c = table(spark, d, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("profile_id")).agg(F.count(F.lit(1)).alias("n_orders"))
    return rounded(O.stage_report({"readiness": a, "network": b, "impact": c}))


@query("A23_cycle_progression", """WITH t AS (SELECT c_nationkey profile_id, year(o_orderdate) AS "cycle", count(*) FILTER (o_orderstatus = 'F') n_targets, count(*) FILTER (o_orderstatus = 'O') n_predictors, count(*) FILTER (o_orderpriority LIKE '1%') n_barriers FROM orders JOIN customer ON o_custkey = c_custkey WHERE (o_custkey + year(o_orderdate)) % 4 <> 0 GROUP BY ALL),
k AS (SELECT *, lag("cycle") OVER w previous, row_number() OVER w n FROM t WINDOW w AS (PARTITION BY profile_id ORDER BY "cycle")) SELECT profile_id, "cycle", n cycle_number, coalesce("cycle" - previous - 1, 0) n_skipped, n_targets, n_predictors, n_barriers,
n_targets - coalesce(lag(n_targets) OVER w, 0) new_targets, sum(n_predictors) OVER (PARTITION BY profile_id ORDER BY "cycle") predictors_so_far, count(*) OVER (PARTITION BY profile_id) n_cycles FROM k WINDOW w AS (PARTITION BY profile_id ORDER BY "cycle")""")
def a23c(spark, d):
    o = table(spark, d, "orders").withColumn("cycle", F.year("o_orderdate")).where((F.col("o_custkey") + F.col("cycle")) % 4 != 0)
    rows = o.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("profile_id")), "o_custkey")
    counts = rows.groupBy("profile_id", "cycle").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("n_targets"), F.count_if(F.col("o_orderstatus") == "O").alias("n_predictors"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("n_barriers"))
    return O.cycle_progression(counts)


@query("A25_evidence_bundle", f"""WITH {CAND}, t AS (SELECT profile_id, path, score, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, path) r, row_number() OVER (PARTITION BY profile_id ORDER BY score, path) q FROM cd), u AS (SELECT profile_id, path, -score s, q FROM t)
SELECT profile_id, string_agg(path, '|' ORDER BY r) FILTER (r <= 12) importance, (SELECT string_agg(path, '|' ORDER BY q) FROM u WHERE u.profile_id = t.profile_id AND q <= 12) dependence, string_agg(path, '|' ORDER BY r) FILTER (r <= 30) relevance FROM t GROUP BY 1""")
def a25(spark, d):
    c = cut_lineage(candidates(spark, d).select("profile_id", F.col("path").alias("item"), F.col("score").alias("value")))
    out = O.evidence_bundle(c, c.withColumn("value", -F.col("value")), c)
    names = lambda col: F.array_join(F.transform(col, lambda s: s["item"]), "|").alias(col)
    return out.select("profile_id", names("importance"), names("dependence"), names("relevance"))


# Sources and sinks write and read back files in a scratch folder, then must return the given rows.
@query("S01_scan_delimited", "SELECT CAST(o_orderkey AS VARCHAR) o_orderkey, o_orderpriority, CAST(o_custkey AS VARCHAR) o_custkey FROM orders")
def s01(spark, d):
    """Files of three separators in one folder."""
    path = I.scratch_dir(spark)
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    for k, sep in enumerate((";", "\t", ",")):
        rows.where(F.col("o_orderkey") % 3 == k).write.option("sep", sep).option("header", True).csv(f"{path}/{k}")
    return I.scan_delimited(spark, path)


@query("S02_scan_profiles", "WITH p AS (SELECT 'n' || s_nationkey profile_id, CAST(s_suppkey AS VARCHAR) s_suppkey, s_name FROM supplier) SELECT * FROM p WHERE profile_id IN (SELECT DISTINCT profile_id FROM p WHERE contains(profile_id, 'n1') ORDER BY 1 LIMIT 7)")
def s02(spark, d):
    path = I.scratch_dir(spark)
    s = table(spark, d, "supplier").withColumn("folder", F.concat(F.lit("n"), "s_nationkey"))
    for even, sep in ((0, ","), (1, "|")):
        s.where(F.col("s_nationkey") % 2 == even).select("folder", "s_suppkey", "s_name").write.mode("append").partitionBy("folder").option("sep", sep).option("header", True).csv(path)
    return I.scan_profiles(spark, path, "*.csv", "n1", 7).select(F.regexp_replace("profile_id", "^folder=", "").alias("profile_id"), "s_suppkey", "s_name")


WIDE = f"WITH {S.DAILY}, wd AS (SELECT profile_id, t_index, max(value) FILTER (code = 'P01') P01, max(value) FILTER (code = 'C01') C01 FROM obs GROUP BY ALL)"


def wide_of(spark, d):
    return M.daily_obs(spark, d).groupBy("profile_id", "t_index").pivot("code", ["P01", "C01"]).agg(F.max("value"))


@query("S03_conform_wide", f"{WIDE} SELECT profile_id, CAST(t_index AS BIGINT) t_index, CAST(DATE '2025-01-01' + t_index AS VARCHAR) \"date\", round(P01, 6) P01, CAST(NULL AS DOUBLE) P09, round(C01, 6) C01 FROM wd")
def s03(spark, d):
    out = I.conform_wide(wide_of(spark, d).withColumnRenamed("t_index", "row"), "row", ["P01", "P09", "C01"])
    return rounded(out.withColumn("date", F.col("date").cast("string")))


META = [("P01", "PREDICTOR", "clicks", "o1", 0.9, "daily"), ("C01", "CRITERION", "purchases", "o2", 0.8, "daily")]


@query("S04_wide_to_long", f"{WIDE}, l AS (SELECT profile_id, t_index, 'P01' code, P01 v FROM wd UNION ALL SELECT profile_id, t_index, 'C01', C01 FROM wd) SELECT code, profile_id, CAST(t_index AS BIGINT) t_index, round(v, 6) AS value, CASE code WHEN 'P01' THEN 'PREDICTOR' ELSE 'CRITERION' END \"role\", CASE code WHEN 'P01' THEN 'clicks' ELSE 'purchases' END AS label, CASE code WHEN 'P01' THEN 'o1' ELSE 'o2' END ontology_id, CASE code WHEN 'P01' THEN 0.9 ELSE 0.8 END conf, 'daily' freq_hint FROM l")
def s04(spark, d):
    meta = spark.createDataFrame(META, "code string, role string, label string, ontology_id string, conf double, freq_hint string")
    wide = I.conform_wide(wide_of(spark, d).withColumnRenamed("t_index", "row"), "row", ["P01", "C01"])
    return rounded(I.wide_to_long(wide, meta, ["P01", "C01"]).drop("date"))


@query("S05_variable_roles", f"SELECT DISTINCT {S.CODE} code, CASE event_type WHEN 'click' THEN 'CRITERION' WHEN 'view' THEN 'PREDICTOR' WHEN 'signup' THEN 'PREDICTOR' ELSE 'CRITERION' END \"role\", event_type IN ('click', 'purchase') from_metadata FROM events")
def s05(spark, d):
    meta = spark.createDataFrame([("P01", "Criterion variable"), ("C01", "criterion")], "code string, role string")
    return I.variable_roles(M.raw_observations(spark, d), meta)


WIDELISTS = f"""{LISTS}, w AS (SELECT run_id, profile_id, rank, CASE WHEN rank % 3 = 0 THEN 'dup' ELSE path END path, score FROM li)"""


def wide_lists(spark, d):
    ranks = rank_lists(spark, d).withColumn("path", F.when(F.col("rank") % 3 == 0, "dup").otherwise(F.col("path")))
    return I.write_rank_lists(ranks, 10)


@query("S07_load_rank_lists", f"WITH {WIDELISTS} SELECT run_id, profile_id, path, CAST(min(rank) AS INT) AS rank, round(max(score), 4) score FROM w WHERE rank <= 8 AND rank <= 5 + profile_id % 3 GROUP BY ALL")
def s07(spark, d):
    wide = wide_lists(spark, d).withColumn("global_top_n_computed", (5 + F.col("profile_id") % 3).cast("string")).withColumn("global_001_path_lextext", F.lit("x"))
    return rounded(I.load_rank_lists(wide, 8, 200), 4)


@query("S15_write_rank_lists", f"WITH {LISTS} SELECT run_id, profile_id, " + ", ".join(f"max(path) FILTER (rank = {i}) global_{i:03d}_path_full, round(max(score) FILTER (rank = {i}), 4) global_{i:03d}_score" for i in range(1, 4)) + " FROM li GROUP BY ALL")
def s15(spark, d):
    path = I.scratch_dir(spark)
    I.write_rank_lists(rank_lists(spark, d), 3, path)
    return rounded(spark.read.parquet(path), 4)


@query("S08_load_mapping_ranks", f"""SELECT 'n' || c_nationkey profile_id, c_mktsegment part, c_name || ' / x' criterion_path, 'x' criterion_leaf, CAST(c_custkey % 9 AS INT) AS rank, c_mktsegment || ' / ' || c_nationkey predictor_path, round(CASE WHEN c_acctbal > 1 THEN least(1, c_acctbal / 1000) ELSE greatest(0, c_acctbal) END, 6) score FROM customer WHERE c_custkey % 10 <> 0""")
def s08(spark, d):
    c = table(spark, d, "customer")
    df = c.select(F.concat(F.lit("n"), "c_nationkey").alias("profile_id"), F.concat(F.lit(" "), "c_mktsegment").alias("part"), F.concat("c_name", F.lit(">x")).alias("criterion_path"), F.lit("[x]").alias("criterion_leaf"), (F.col("c_custkey") % 9).cast("string").alias("rank"),
                  F.concat("c_mktsegment", F.lit("/"), "c_nationkey").alias("predictor_path"), F.when(F.col("c_custkey") % 10 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("relevance_score"))
    return rounded(I.load_mapping_ranks(df))


@query("S09_explode_evaluations", f"WITH {SCORES_SQL} SELECT doc_id, dimension, module, feature, round(risk * 8 + 1, 6) score, concat_ws('.', dimension, module, feature) AS \"column\" FROM ris")
def s09(spark, d):
    rows = likert(spark, d)
    pack = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    a = rows.groupBy("doc_id", "dimension", "module").agg(pack("feature", "score").alias("m")).groupBy("doc_id", "dimension").agg(pack("module", "m").alias("m")).groupBy("doc_id").agg(F.to_json(pack("dimension", "m")).alias("json"))
    return rounded(I.explode_evaluations(a))


@query("S10_upsert_by_hash", """WITH h AS (SELECT sha1(c_mktsegment || '|' || c_nationkey) h, c_custkey, c_acctbal FROM customer), e AS (SELECT h, c_custkey, c_acctbal FROM h WHERE c_custkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY h ORDER BY c_custkey) = 1), n AS (SELECT * FROM h WHERE c_custkey % 3 <> 0 AND h NOT IN (SELECT h FROM e) QUALIFY row_number() OVER (PARTITION BY h ORDER BY c_custkey DESC) = 1) SELECT * FROM e UNION ALL SELECT * FROM n""")
def s10(spark, d):
    h = table(spark, d, "customer").select(C.content_hash(F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("h"), "c_custkey", "c_acctbal")
    first = h.where("c_custkey % 3 = 0").groupBy("h").agg(F.min_by(F.struct("c_custkey", "c_acctbal"), "c_custkey").alias("r")).select("h", "r.*")
    return I.upsert_by_hash(first, h.where("c_custkey % 3 != 0"), "h", "c_custkey")


@query("S11_append_history", "SELECT year(o_orderdate) run_id, o_custkey profile_id, count(*) n FROM orders GROUP BY ALL UNION ALL SELECT 1, c_custkey, 0 FROM customer")
def s11(spark, d):
    path = I.scratch_dir(spark)
    I.append_history(table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("run_id"), F.col("o_custkey").alias("profile_id")).agg(F.count(F.lit(1)).alias("n")), path)
    I.append_history(table(spark, d, "customer").select(F.lit(1).alias("run_id"), F.col("c_custkey").alias("profile_id"), F.lit(0).cast("long").alias("n")), path)
    return spark.read.parquet(path)


@query("S12_write_matrix", "SELECT l_suppkey, " + ", ".join(f"coalesce(max(l_quantity) FILTER (l_linenumber = {i}), 0) AS \"{i}\"" for i in range(1, 8)) + " FROM lineitem GROUP BY 1")
def s12(spark, d):
    path = I.scratch_dir(spark)
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", F.col("l_quantity").alias("score"))
    I.write_matrix(rows, "l_suppkey", "l_linenumber", list(range(1, 8)), path)
    return spark.read.parquet(path)


@query("S12_write_edges", "SELECT l_suppkey, l_partkey, max(l_quantity) score FROM lineitem GROUP BY ALL")
def s12e(spark, d):
    path = I.scratch_dir(spark)
    I.write_edges(table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_quantity").alias("score")), path)
    return spark.read.parquet(path)


@query("S13_scan_text_blocks", """WITH l AS (SELECT conv_id doc_id, turn, CASE WHEN role = 'user' THEN 'ID t' || turn ELSE replace(replace(regexp_replace(trim(regexp_replace(text, '^["'']+|["'']+$', '', 'g')), '[\\r\\n]+', ' ', 'g'), chr(9), ' '), chr(160), ' ') END txt, role = 'user' AS head FROM conversations), b AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY turn) block FROM l)
SELECT doc_id, CAST(block AS BIGINT) block, max(txt) FILTER (head) AS "header", md5(string_agg(trim(txt), chr(10) ORDER BY turn) FILTER (NOT head AND trim(txt) <> '')) body FROM b WHERE block > 0 GROUP BY ALL HAVING body IS NOT NULL""")
def s13(spark, d):
    flat = F.translate(F.regexp_replace(F.trim(F.regexp_replace("text", "^[\"']+|[\"']+$", "")), r"[\r\n]+", " "), "\t ", "  ")
    lines = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), F.when(F.col("role") == "user", F.concat(F.lit("ID t"), "turn")).otherwise(F.trim(flat)).alias("text"))
    return I.scan_text_blocks(lines, r"^ID t\d+$").withColumn("body", F.md5(F.col("body").cast("binary")))


def model_docs(spark, d):
    """One nested model per nation: suppliers as predictors, market segments as criteria."""
    s = table(spark, d, "supplier").groupBy(F.concat(F.lit("m"), "s_nationkey").alias("model_id")).agg(F.collect_list(F.struct(F.concat(F.lit("P"), "s_suppkey").alias("var_id"), F.lit("PREDICTOR").alias("role"), F.col("s_name").alias("label"))).alias("p"))
    c = table(spark, d, "customer").groupBy(F.concat(F.lit("m"), "c_nationkey").alias("model_id"), "c_mktsegment").agg(F.max("c_acctbal").alias("v")).groupBy("model_id").agg(F.collect_list(F.struct(F.concat(F.lit("C"), "c_mktsegment").alias("var_id"), F.lit("CRITERION").alias("role"), F.col("c_mktsegment").alias("label"))).alias("c"))
    j = s.join(c, "model_id")
    first = F.element_at(F.array_sort("c"), 1)["var_id"]
    edges = F.transform("p", lambda x: F.struct(x["var_id"].alias("source"), first.alias("target"), (F.length(x["label"]) / 100).alias("score")))
    rel = F.transform("p", lambda x: F.struct(x["var_id"].alias("predictor"), first.alias("criterion"), C.format_decimal_comma(F.length(x["var_id"]) / 7).alias("score")))
    return j.select("model_id", F.to_json(F.struct(F.concat("p", "c").alias("variables"), edges.alias("edges"), rel.alias("relevance"))).alias("json"))


MODELS = """fc AS (SELECT 'm' || c_nationkey model_id, 'C' || min(c_mktsegment) target FROM customer GROUP BY 1), sp AS (SELECT 'm' || s_nationkey model_id, 'P' || s_suppkey source, s_name FROM supplier JOIN fc ON fc.model_id = 'm' || s_nationkey)"""


@query("S14_explode_edges", f"WITH {MODELS} SELECT model_id, source, target, round(length(s_name) / 100, 6) score, 'PC' kind FROM sp JOIN fc USING (model_id)")
def s14(spark, d):
    return rounded(I.explode_models(model_docs(spark, d))["edges"])


@query("S14_explode_relevance", f"WITH {MODELS} SELECT model_id, source predictor, target criterion, round(length(source) / 7, 5) score FROM sp JOIN fc USING (model_id)")
def s14r(spark, d):
    return rounded(I.explode_models(model_docs(spark, d))["relevance"].withColumn("score", F.least(F.lit(99.0), F.col("score"))), 5)


@query("P09_validate_contract", """SELECT 'missing_column' kind, 'o_comment' name, NULL n_rows UNION ALL SELECT 'wrong_type', 'o_custkey', NULL UNION ALL SELECT 'broken_rule', 'price_cap', count(*) FROM orders WHERE NOT o_totalprice < 400000 UNION ALL SELECT 'broken_rule', 'open_recent', count(*) FROM orders WHERE NOT (o_orderstatus <> 'O' OR year(o_orderdate) >= 1996)""")
def p09(spark, d):
    return Q.validate_contract(table(spark, d, "orders"), {"o_orderkey": "bigint", "o_custkey": "string", "o_comment": "string"}, {
        "price_cap": F.col("o_totalprice") < 400000, "positive": F.col("o_totalprice") > 0, "open_recent": (F.col("o_orderstatus") != "O") | (F.year("o_orderdate") >= 1996)})


VAL = """v AS (SELECT 'm' || l_suppkey % 20 model_id, CASE WHEN l_linenumber = 7 AND l_suppkey % 20 = 3 THEN ' ' ELSE 'P' || l_linenumber END var_id, 'PREDICTOR' "role" FROM lineitem GROUP BY ALL UNION ALL SELECT 'm' || l_suppkey % 20, 'C' || l_returnflag, 'CRITERION' FROM lineitem GROUP BY ALL UNION ALL SELECT 'm5', 'P1', 'PREDICTOR'),
e AS (SELECT 'm' || l_suppkey % 20 model_id, 'P' || l_linenumber source, CASE WHEN l_suppkey % 20 = 7 AND l_linenumber = 2 THEN 'P2' ELSE 'C' || l_returnflag END target, max(l_quantity * l_discount / 4) score FROM lineitem WHERE l_linenumber <> 6 GROUP BY ALL), ds AS (SELECT 'm' || s_suppkey % 20 model_id, max(s_suppkey % 20) + 25 total_observations FROM supplier GROUP BY 1)"""


@query("P10_validate_model", f"""WITH {VAL}, k AS (SELECT model_id, count(DISTINCT var_id) k FROM v GROUP BY 1), g AS (SELECT DISTINCT a.model_id, a.var_id source, b.var_id target FROM v a JOIN v b ON a.model_id = b.model_id WHERE a."role" = 'PREDICTOR' AND b."role" = 'CRITERION')
SELECT model_id, count(*) n, 'empty_id' AS "rule" FROM v WHERE trim(var_id) = '' GROUP BY 1 UNION ALL SELECT model_id, count(*), 'duplicate_id' FROM (SELECT model_id, var_id FROM v WHERE trim(var_id) <> '' GROUP BY ALL HAVING count(*) > 1) GROUP BY 1 UNION ALL SELECT model_id, count(*), 'missing_pair' FROM (SELECT * FROM g EXCEPT SELECT model_id, source, target FROM e) GROUP BY 1
UNION ALL SELECT model_id, count(*), 'self_pair' FROM e WHERE source = target GROUP BY 1 UNION ALL SELECT model_id, count(*), 'score_range' FROM e WHERE score > 1 OR score < 0 GROUP BY 1 UNION ALL SELECT model_id, count(*), 'observations_under_3k' FROM k JOIN ds USING (model_id) WHERE total_observations < 3 * k GROUP BY 1 UNION ALL SELECT model_id, count(*), 'observations_under_5k' FROM k JOIN ds USING (model_id) WHERE total_observations < 5 * k GROUP BY 1""")
def p10(spark, d):
    li = table(spark, d, "lineitem").withColumn("g", F.col("l_suppkey") % 20).withColumn("model_id", F.concat(F.lit("m"), "g"))
    pid = F.when((F.col("l_linenumber") == 7) & (F.col("g") == 3), " ").otherwise(F.concat(F.lit("P"), "l_linenumber"))
    v = li.select("model_id", pid.alias("var_id"), F.lit("PREDICTOR").alias("role")).distinct().union(li.select("model_id", F.concat(F.lit("C"), "l_returnflag"), F.lit("CRITERION")).distinct())
    twice = v.where("model_id = 'm5' and var_id = 'P1'")
    target = F.when((F.col("g") == 7) & (F.col("l_linenumber") == 2), "P2").otherwise(F.concat(F.lit("C"), "l_returnflag"))
    e = li.where("l_linenumber != 6").groupBy("model_id", F.concat(F.lit("P"), "l_linenumber").alias("source"), target.alias("target")).agg(F.max(F.col("l_quantity") * F.col("l_discount") / 4).alias("score"))
    design = table(spark, d, "supplier").groupBy(F.concat(F.lit("m"), F.col("s_suppkey") % 20).alias("model_id")).agg((F.max(F.col("s_suppkey") % 20) + 25).alias("total_observations"))
    return I.validate_model(v.union(twice), e, design)


GRID = """v AS (SELECT DISTINCT 'm' || o_custkey % 50 model_id, 'P' || o_orderkey % 9 var_id, 'PREDICTOR' "role" FROM orders UNION SELECT 'm' || o_custkey % 50, 'C' || o_orderstatus, 'Criterion' FROM orders UNION SELECT 'm1', ' ', 'PREDICTOR'),
e AS (SELECT 'm' || o_custkey % 50 model_id, 'P' || o_orderkey % 9 source, CASE o_orderkey % 3 WHEN 0 THEN 'P' || o_custkey % 7 ELSE 'C' || o_orderstatus END target FROM orders UNION ALL SELECT 'm' || o_custkey % 50, 'C' || o_orderstatus, 'C' || substr('FOP', CAST(o_orderkey % 3 + 1 AS INT), 1) FROM orders WHERE o_custkey % 5 = 0)"""


@query("P10_model_grid", f"""WITH {GRID}, d AS (SELECT DISTINCT model_id, var_id, upper("role"[1]) r FROM v WHERE trim(var_id) <> ''), s AS (SELECT model_id, count(*) FILTER (r = 'P') p, count(*) FILTER (r = 'C') c FROM d GROUP BY 1),
k AS (SELECT e.model_id, a.r || b.r kind, count(*) n FROM (SELECT DISTINCT * FROM e WHERE source <> target) e JOIN d a ON a.model_id = e.model_id AND a.var_id = source JOIN d b ON b.model_id = e.model_id AND b.var_id = target GROUP BY ALL),
x AS (SELECT model_id, unnest(['PC', 'PP', 'CC']) kind, unnest([p * c, p * (p - 1), c * (c - 1)]) n_expected FROM s) SELECT model_id, kind, n_expected, coalesce(n, 0) n_present, n_expected - coalesce(n, 0) n_missing FROM x LEFT JOIN k USING (model_id, kind)""")
def p10g(spark, d):
    o = table(spark, d, "orders").withColumn("model_id", F.concat(F.lit("m"), F.col("o_custkey") % 50))
    p, c = F.concat(F.lit("P"), F.col("o_orderkey") % 9), F.concat(F.lit("C"), "o_orderstatus")
    blank = spark.createDataFrame([("m1", " ", "PREDICTOR")], "model_id string, var_id string, role string")
    v = o.select("model_id", p.alias("var_id"), F.lit("PREDICTOR").alias("role")).union(o.select("model_id", c, F.lit("Criterion"))).union(blank)
    to = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("P"), F.col("o_custkey") % 7)).otherwise(c)
    other = F.concat(F.lit("C"), F.element_at(F.array(*map(F.lit, "FOP")), (F.col("o_orderkey") % 3 + 1).cast("int")))
    e = o.select("model_id", p.alias("source"), to.alias("target")).union(o.where("o_custkey % 5 = 0").select("model_id", c, other))
    return I.model_grid(v, e)


@query("P13_design_coherence", """WITH b AS (SELECT c_custkey, greatest(7, c_custkey % 30) sd, greatest(1, c_custkey % 4) pp, c_custkey % 5 = 0 di, CASE WHEN c_custkey % 3 = 0 THEN 45 END mt FROM customer), c AS (SELECT *, di OR sd * pp + CASE WHEN di THEN sd ELSE 0 END < 30 d2 FROM b), e AS (SELECT *, CASE WHEN sd * pp + CASE WHEN d2 THEN sd ELSE 0 END < 30 THEN greatest(pp, ceil((30 - sd) / sd)) ELSE pp END p2 FROM c)
SELECT c_custkey, CAST(sd AS INT) study_days, CAST(p2 AS INT) prompts_per_day, d2 diary, CAST(sd * p2 AS INT) expected_prompts, CAST(CASE WHEN d2 THEN sd ELSE 0 END AS INT) expected_entries, CAST(least(sd * p2 + CASE WHEN d2 THEN sd ELSE 0 END, greatest(30, coalesce(mt, 30))) AS INT) minimum_target, CAST(sd * p2 + CASE WHEN d2 THEN sd ELSE 0 END AS INT) total_observations FROM e""")
def p13(spark, d):
    k = F.col("c_custkey")
    design = table(spark, d, "customer").select("c_custkey", (k % 30).cast("int").alias("study_days"), (k % 4).cast("int").alias("prompts_per_day"), (k % 5 == 0).alias("diary"), F.when(k % 3 == 0, 45).alias("minimum_target"))
    return I.design_coherence(design)


@query("P14_collection_schema", """WITH b AS (SELECT c_custkey, c_custkey % 5 z, c_custkey % 3 y FROM customer) SELECT c_custkey, CAST(CASE z WHEN 0 THEN 1 WHEN 1 THEN 0.5 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE -3 END AS DOUBLE) scale_min, CAST(CASE z WHEN 0 THEN 7 WHEN 1 THEN 10 WHEN 2 THEN 100 WHEN 3 THEN 9 ELSE 3 END AS DOUBLE) scale_max,
CASE WHEN y = 0 THEN 0.55 WHEN z = 0 THEN 0.65 WHEN z = 1 THEN 0.35 ELSE 0.5 END baseline, CASE WHEN z = 4 THEN 'seg' ELSE 'q' || z END question, CAST(greatest(1, y) AS INT) prompts_per_day FROM b""")
def p14(spark, d):
    k = F.col("c_custkey")
    z, y = k % 5, k % 3
    v = table(spark, d, "customer").select("c_custkey", F.when(z == 0, "1-7 Likert").when(z == 1, "10 to 0,5").when(z == 2, "percent %").when(z == 3, "").otherwise("-3 – 3").alias("response_scale"),
                                           F.when(y == 0, "predictor").otherwise("criterion").alias("role"), F.when(z == 0, "higher_is_worse").when(z == 1, "higher_is_better").otherwise("").alias("polarity"),
                                           F.when(z == 4, " ").otherwise(F.concat(F.lit("q"), z)).alias("item"), F.lit("seg").alias("label"), y.cast("int").alias("sampling_per_day"))
    return rounded(I.collection_schema(v).select("c_custkey", "scale_min", "scale_max", "baseline", "question", "prompts_per_day"))


MESSY = f"'[' || {PRIM} || '] >  ' || p_type || ' \\ *' || p_brand || '* / ' || p_name"


def messy(spark, d):
    return paths_of(spark, d).select("p_partkey", F.concat(F.lit("["), "primary", F.lit("] >  "), "secondary", F.lit(" \\ *"), "tertiary", F.lit("* / "), "p_name").alias("raw"))


@query("F01_normalize_path", f"SELECT p_partkey, concat_ws(' / ', {PRIM}, p_type, p_brand, p_name) path FROM part")
def f01(spark, d):
    return messy(spark, d).select("p_partkey", P.normalize_path(F.col("raw")).alias("path"))


@query("F02_path_parts", f"SELECT p_partkey, 4 AS depth, {PRIM} || ' / ' || p_type parent_domain, lower(concat_ws(' / ', {PRIM}, p_type, p_brand)) parent_key, lower({PRIM} || ' / ' || p_type) domain_key, p_type = 'PROMO' under_promo FROM part")
def f02(spark, d):
    raw = F.col("raw")
    under = P.is_path_prefix(F.array(F.get(P.path_segments(raw), F.lit(0)), F.lit("PROMO")), P.path_segments(raw))
    return messy(spark, d).select("p_partkey", P.path_depth(raw).alias("depth"), P.parent_domain(raw).alias("parent_domain"), P.parent_key(raw).alias("parent_key"), P.domain_key(raw).alias("domain_key"), under.alias("under_promo"))


def stem_sql(t: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({t}, '{s}') AND length({t}) >= {len(s) + 3} THEN left({t}, length({t}) - {len(s)}) || '{'y' if s == 'ies' else ''}'" for s in X.SUFFIXES) + f" ELSE {t} END"


@query("F03_tokenize", f"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 1) p FROM documents)
SELECT doc_id, len(p) n_plain, len(list_distinct(p)) n_distinct, md5(array_to_string(list_filter(list_transform(p, lambda t: {stem_sql('t')}), lambda t: length(t) > 1), ' ')) stems FROM t""")
def f03(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(X.tokenize(t)).cast("long").alias("n_plain"), F.size(X.tokenize(t, "set")).cast("long").alias("n_distinct"), F.md5(F.array_join(X.tokenize(t, "stem"), " ").cast("binary")).alias("stems"))


@query("F04_jaccard", """WITH c AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 1)) a FROM conversations), p AS (SELECT conv_id, turn, a, lag(a) OVER (PARTITION BY conv_id ORDER BY turn) b FROM c)
SELECT conv_id, turn, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0 END, 6) overlap FROM p WHERE b IS NOT NULL""")
def f04(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", X.tokenize(F.col("text"), "set").alias("a"))
    nxt = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("a").alias("b"))
    return rounded(c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", P.jaccard(F.col("a"), F.col("b")).alias("overlap")))


@query("F07_fuzzy_ratio", "SELECT p_partkey, round(1 - levenshtein(p_name, p_type || ' ' || p_brand) / greatest(length(p_name), length(p_type || ' ' || p_brand)), 6) ratio FROM part")
def f07(spark, d):
    return rounded(table(spark, d, "part").select("p_partkey", C.fuzzy_ratio(F.col("p_name"), F.concat_ws(" ", "p_type", "p_brand")).alias("ratio")))


@query("F08_norm_score", "SELECT c_custkey, round(least(1, greatest(0, CASE WHEN c_acctbal > 1 THEN c_acctbal / 1000 ELSE c_acctbal END)), 6) milli, round(least(1, greatest(0, CASE WHEN c_acctbal > 100 THEN c_acctbal / 1000 WHEN c_acctbal > 1 THEN c_acctbal / 100 ELSE c_acctbal END)), 6) mixed, replace(format('{:.2f}', c_acctbal), '.', ',') shown, round(c_acctbal, 2) parsed FROM customer")
def f08(spark, d):
    b = F.col("c_acctbal")
    shown = C.format_decimal_comma(b, 2)
    out = table(spark, d, "customer").select("c_custkey", C.norm_score(b).alias("milli"), C.norm_score(b, "mixed").alias("mixed"), shown.alias("shown"), C.parse_decimal_comma(shown).alias("parsed"))
    return rounded(out.drop("parsed")).join(out.select("c_custkey", "parsed"), "c_custkey")


@query("F11_content_hash", "SELECT source, sha1(source || '|' || min(lang)) one, sha256(string_agg(DISTINCT lang, '|' ORDER BY lang)) members FROM documents GROUP BY 1")
def f11(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.min("lang").alias("m"), F.collect_set("lang").alias("l"))
    return g.select("source", C.content_hash(F.col("source"), F.col("m")).alias("one"), C.members_hash(F.col("l")).alias("members"))


@query("F12_leaf_text", f"SELECT p_partkey, concat_ws(' / ', {PRIM}, p_type, p_brand, p_name) full_text, array_to_string(list_filter(regexp_extract_all(lower(concat_ws(' / ', {PRIM}, p_type, p_brand, p_name)), '[a-z0-9]+'), lambda t: length(t) > 1), ' ') lexical, p_name || ' | ' || p_brand || ' < ' || p_type || ' < ' || {PRIM} context FROM part")
def f12(spark, d):
    raw = F.col("raw")
    return messy(spark, d).select("p_partkey", X.leaf_text(raw).alias("full_text"), X.leaf_text(raw, "lexical").alias("lexical"), X.leaf_text(raw, "context").alias("context"))


KW = {"bio_procedure": ["bolt"], "psycho": ["ring"], "social": ["widget", "gear"], "lifestyle": ["small"], "bio_pharm": ["red"]}


@query("F14_classify_label", """WITH f AS (SELECT p_partkey, CASE WHEN p_size = 1 THEN 'bio_pharm' WHEN p_size = 2 THEN 'psycho' WHEN p_name LIKE '%bolt%' THEN 'bio_procedure' WHEN p_name LIKE '%ring%' THEN 'psycho' WHEN p_name LIKE '%widget%' OR p_name LIKE '%gear%' THEN 'social' WHEN p_name LIKE '%small%' THEN 'lifestyle' WHEN p_name LIKE '%red%' THEN 'bio_pharm' ELSE 'other' END fine FROM part)
SELECT p_partkey, fine, CASE WHEN fine LIKE 'bio%' THEN 'BIO' WHEN fine = 'psycho' THEN 'PSYCHO' WHEN fine = 'social' THEN 'SOCIAL' ELSE 'X' END "domain", CASE fine WHEN 'bio_pharm' THEN 'medication' WHEN 'bio_procedure' THEN 'biological_procedure' WHEN 'psycho' THEN 'psychotherapy' WHEN 'social' THEN 'psychosocial' ELSE 'other' END category FROM f""")
def f14(spark, d):
    c = I.classify_label(F.col("p_name"), F.col("p_size") == 1, F.col("p_size") == 2, KW)
    return table(spark, d, "part").select("p_partkey", c.alias("c")).select("p_partkey", "c.*")
