"""Queries on similarity joins, retrieval and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.catalog.registry import query, rounded
from lagweave.core.session import cut_lineage
from lagweave.functions import paths as P
from lagweave.functions.text import tokenize
from lagweave.operators import joins as J
from lagweave.operators import lexical as L
from lagweave.operators import retrieval as X
from lagweave.sources import tables as M
from lagweave.sources.tables import table

PRIM = "(['BIO', 'PSYCHO', 'SOCIAL'])[p_size % 3 + 1]"
TOK = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) > 1)"


def doc_tokens(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    return table(spark, d, name).select(key, tokenize(F.col("text"), "set").alias("tokens"))


@query("J07_jaccard_join", f"""WITH a AS (SELECT doc_id, list_distinct({TOK.format('text')}) t FROM documents), b AS (SELECT item_id, list_distinct({TOK.format('text')}) t FROM benchmark),
i AS (SELECT doc_id, item_id, len(list_intersect(a.t, b.t)) n, len(a.t) x, len(b.t) y FROM a, b) SELECT doc_id, item_id, round(n / (x + y - n), 6) similarity FROM i WHERE x > 0 AND y > 0 AND n / (x + y - n) >= 0.3""")
def j07(spark, d):
    return rounded(J.jaccard_join(doc_tokens(spark, d, "documents", "doc_id"), "doc_id", "tokens", doc_tokens(spark, d, "benchmark", "item_id").withColumnRenamed("tokens", "btokens"), "item_id", "btokens", 0.3))


SEGS = "list_transform(string_split({0}, ' > '), lambda s: lower(trim(s)))"
PTOK = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9_]+'), lambda t: length(t) > 1))"


def similarity_sql(sa: str, sb: str, ta: str, tb: str) -> str:
    """Composite path similarity from segment and token lists."""
    pre = f"list_sum(list_transform(range(1, greatest(len({sa}), len({sb})) + 1), lambda i_: CASE WHEN len({sa}) >= i_ AND len({sb}) >= i_ AND {sa}[1:i_] = {sb}[1:i_] THEN 1 ELSE 0 END))"
    sub = lambda x, y: f"(list_reduce({y}, lambda p_, e_: CASE WHEN {x}[CAST(split_part(p_, '~', 1) AS INT) + 1] = e_ THEN (CAST(split_part(p_, '~', 1) AS INT) + 1) || '~' ELSE p_ END, '0~') = len({x}) || '~')"
    inter = f"len(list_intersect({ta}, {tb}))"
    return (f"0.45 * CASE WHEN len({ta}) > 0 AND len({tb}) > 0 THEN {inter} / (len({ta}) + len({tb}) - {inter}) ELSE 0 END + 0.35 * {pre} / greatest(len({sa}), len({sb}))"
            f" + CASE WHEN {sub(sa, sb)} OR {sub(sb, sa)} THEN 0.20 ELSE 0 END")


PATHS = f"""pa AS (SELECT DISTINCT concat_ws(' > ', {PRIM}, p_type, p_brand, p_name) pa FROM part), pb AS (SELECT DISTINCT concat_ws(' > ', {PRIM}, p_brand) pb FROM part UNION SELECT DISTINCT concat_ws(' > ', p_type, p_name) FROM part),
xa AS (SELECT pa, {SEGS.format('pa')} sa, {PTOK.format('pa')} ta FROM pa), xb AS (SELECT pb, {SEGS.format('pb')} sb, {PTOK.format('pb')} tb FROM pb),
sim AS (SELECT pa, pb, {similarity_sql('sa', 'sb', 'ta', 'tb')} s FROM xa, xb)"""


def long_paths(spark, d):
    h = M.hierarchy(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("predictor_id"), "p_name"), "predictor_id")
    return h.select(F.concat_ws(" > ", "primary", "secondary", "tertiary", "p_name").alias("pa"))


def short_paths(spark, d):
    h = M.hierarchy(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("predictor_id"), "p_name"), "predictor_id")
    return h.select(F.concat_ws(" > ", "primary", "tertiary").alias("pb")).union(h.select(F.concat_ws(" > ", "secondary", "p_name")))


@query("J08_path_similarity_join", f"WITH {PATHS} SELECT pa, pb, round(s, 6) similarity FROM sim WHERE s >= 0.4")
def j08(spark, d):
    return rounded(J.path_similarity_join(long_paths(spark, d), "pa", short_paths(spark, d), "pb", 0.4))


@query("F05_path_similarity", f"""WITH r AS (SELECT p_partkey, concat_ws(' > ', {PRIM}, p_type, p_brand) a, concat_ws(' > ', {PRIM}, p_brand, p_name) b FROM part), x AS (SELECT p_partkey, {SEGS.format('a')} sa, {SEGS.format('b')} sb, {PTOK.format('a')} ta, {PTOK.format('b')} tb FROM r)
SELECT p_partkey, round({similarity_sql('sa', 'sb', 'ta', 'tb')}, 6) similarity FROM x""")
def f05(spark, d):
    h = table(spark, d, "part").join(M.hierarchy(spark, d).withColumnRenamed("predictor_id", "p_partkey"), "p_partkey")
    long, short = F.concat_ws(" > ", "primary", "secondary", "tertiary"), F.concat_ws(" > ", "primary", "tertiary", "p_name")
    return rounded(P.with_similarity(h, long, short, "similarity").select("p_partkey", "similarity"))


@query("F06_is_subsequence", f"""WITH r AS (SELECT p_partkey, [p_type, {PRIM}, p_brand] b, CASE p_partkey % 3 WHEN 0 THEN [p_type, p_brand] WHEN 1 THEN [p_brand, p_type] ELSE [{PRIM}] END a FROM part)
SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN false ELSE true END subsequence FROM r""")
def f06(spark, d):
    h = table(spark, d, "part").join(M.hierarchy(spark, d).withColumnRenamed("predictor_id", "p_partkey"), "p_partkey")
    k = F.col("p_partkey") % 3
    a = F.when(k == 0, F.array("secondary", "tertiary")).when(k == 1, F.array("tertiary", "secondary")).otherwise(F.array("primary"))
    return h.select("p_partkey", P.is_subsequence(a, F.array("secondary", "primary", "tertiary")).alias("subsequence"))


@query("J05_expand_to_leaves", f"""WITH lf AS (SELECT DISTINCT concat_ws(' / ', {PRIM}, p_type, p_brand, p_name) leaf FROM part), mp AS (SELECT DISTINCT l_returnflag flag, CASE l_linenumber % 3 WHEN 0 THEN {PRIM} WHEN 1 THEN concat_ws(' / ', {PRIM}, p_type) ELSE concat_ws(' / ', {PRIM}, p_type, p_brand) END path, l_tax + l_discount score FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT flag, lower(path) prefix, max(score) score FROM mp GROUP BY ALL), x AS (SELECT flag, leaf, prefix, len(string_split(prefix, ' / ')) depth, score FROM lf JOIN m ON starts_with(lower(leaf) || ' / ', prefix || ' / '))
SELECT flag, leaf, prefix matched_path, CAST(depth AS INT) matched_depth, round(score, 6) score FROM x QUALIFY row_number() OVER (PARTITION BY flag, leaf ORDER BY depth DESC, score DESC) = 1""")
def j05(spark, d):
    h = table(spark, d, "part").join(M.hierarchy(spark, d).withColumnRenamed("predictor_id", "p_partkey"), "p_partkey")
    leaves = h.select(F.concat_ws(" / ", "primary", "secondary", "tertiary", "p_name").alias("leaf"))
    n = F.col("l_linenumber") % 3
    path = F.when(n == 0, F.col("primary")).when(n == 1, F.concat_ws(" / ", "primary", "secondary")).otherwise(F.concat_ws(" / ", "primary", "secondary", "tertiary"))
    mapping = table(spark, d, "lineitem").join(h, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_returnflag").alias("flag"), path.alias("path"), (F.col("l_tax") + F.col("l_discount")).alias("score"))
    return rounded(J.expand_to_leaves(mapping, leaves, ["flag"]))


@query("J06_subsequence_match", f"""WITH lf AS (SELECT DISTINCT concat_ws(' / ', {PRIM}, p_type, p_brand, p_name) leaf, {PRIM} r, p_type t, p_brand b, p_name n FROM part), mp AS (SELECT DISTINCT concat_ws(' / ', {PRIM}, p_brand) path, {PRIM} r, p_brand b, NULL n FROM part UNION SELECT DISTINCT concat_ws(' / ', {PRIM}, p_name), {PRIM}, NULL, p_name FROM part)
SELECT DISTINCT path, leaf FROM lf JOIN mp ON lf.r = mp.r AND (mp.b = lf.b OR mp.n = lf.n)""")
def j06(spark, d):
    h = table(spark, d, "part").join(M.hierarchy(spark, d).withColumnRenamed("predictor_id", "p_partkey"), "p_partkey")
    mapping = h.select(F.concat_ws(" / ", "primary", "tertiary").alias("path")).union(h.select(F.concat_ws(" / ", "primary", "p_name")))
    return J.subsequence_match(mapping, h.select(F.concat_ws(" / ", "primary", "secondary", "tertiary", "p_name").alias("leaf")))


@query("J09_cosine_threshold_join", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings), p AS (SELECT x.vec_id a, y.vec_id b, list_cosine_similarity(x.e, y.e) s FROM v x JOIN v y ON x.vec_id < y.vec_id) SELECT a, b, round(s, 6) score FROM p WHERE s >= 0.3""")
def j09(spark, d):
    return rounded(X.cosine_threshold_join(table(spark, d, "embeddings"), 0.3))


@query("K01_topk_cosine", """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) e FROM embeddings), q AS (SELECT label query_id, arg_min(e, vec_id) e FROM v GROUP BY 1), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q.e, v.e), 6) score FROM q, v)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 20""")
def k01(spark, d):
    vecs = table(spark, d, "embeddings")
    queries = vecs.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return rounded(X.topk_cosine(queries, vecs, 20))


CORPUS = f"""ne AS (SELECT count(*) n FROM embeddings), emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings),
docs AS (SELECT p_partkey vec_id, lower(concat_ws(' ', {PRIM}, p_type, p_brand, p_name)) txt, e FROM part JOIN emb ON p_partkey % (SELECT n FROM ne) = emb.vec_id),
qs0 AS (SELECT p_name query_id, p_name || ' ' || min(p_type) || ' BIO' txt, (min(p_partkey) * 7) % (SELECT n FROM ne) ek FROM part GROUP BY 1), qs AS (SELECT query_id, txt, e FROM qs0 JOIN emb ON ek = vec_id),
dt AS (SELECT vec_id, {TOK.format('txt')} toks FROM docs), qt AS (SELECT query_id, {TOK.format('txt')} toks FROM qs),
st AS (SELECT count(*) n, avg(len(toks)) avgdl FROM dt), po AS (SELECT vec_id, dl, ul, term, count(*) tf FROM (SELECT vec_id, len(toks) dl, len(list_distinct(toks)) ul, unnest(toks) term FROM dt) GROUP BY ALL), dfr AS (SELECT term, count(*) df FROM po GROUP BY 1),
qe AS (SELECT query_id, ql, term, count(*) qtf FROM (SELECT query_id, len(list_distinct(toks)) ql, unnest(toks) term FROM qt) GROUP BY ALL),
lex AS (SELECT query_id, vec_id, sum(qtf * ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) bm25, count(*) / sqrt(max(ul * ql)) overlap FROM po JOIN dfr USING (term) JOIN qe USING (term), st GROUP BY ALL),
cs AS (SELECT query_id, vec_id, list_cosine_similarity(qs.e, docs.e) emb FROM qs, docs)"""


def corpus(spark, d):
    vecs = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = vecs.count()
    h = table(spark, d, "part").join(M.hierarchy(spark, d).withColumnRenamed("predictor_id", "p_partkey"), "p_partkey")
    text = F.lower(F.concat_ws(" ", "primary", "secondary", "tertiary", "p_name"))
    keyed = h.select("p_partkey", text.alias("text"), (F.col("p_partkey") % n).alias("ek"))
    docs = keyed.join(vecs, F.col("ek") == F.col("vec_id")).select(F.col("p_partkey").alias("vec_id"), "text", tokenize(F.col("text")).alias("tokens"), "embedding")
    q = h.groupBy(F.col("p_name").alias("query_id")).agg(F.concat_ws(" ", "p_name", F.min("p_type"), F.lit("BIO")).alias("text"), ((F.min("p_partkey") * 7) % n).alias("ek"))
    queries = q.join(vecs, F.col("ek") == F.col("vec_id")).select("query_id", "text", tokenize(F.col("text")).alias("tokens"), "embedding")
    return cut_lineage(queries), cut_lineage(docs)


@query("R01_bm25", f"WITH {CORPUS} SELECT query_id, vec_id, round(bm25, 6) bm25 FROM lex")
def r01(spark, d):
    return rounded(L.bm25_pairs(*corpus(spark, d)))


@query("R01_bm25_documents", f"""WITH dt AS (SELECT doc_id vec_id, {TOK.format('text')} toks FROM documents), qt AS (SELECT item_id query_id, {TOK.format('text')} toks FROM benchmark), st AS (SELECT count(*) n, avg(len(toks)) avgdl FROM dt),
po AS (SELECT vec_id, dl, term, count(*) tf FROM (SELECT vec_id, len(toks) dl, unnest(toks) term FROM dt) GROUP BY ALL), dfr AS (SELECT term, count(*) df FROM po GROUP BY 1), qe AS (SELECT query_id, term, count(*) qtf FROM (SELECT query_id, unnest(toks) term FROM qt) GROUP BY ALL),
lex AS (SELECT query_id, vec_id, sum(qtf * ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) s FROM po JOIN dfr USING (term) JOIN qe USING (term), st GROUP BY ALL)
SELECT query_id, vec_id, round(s, 4) bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM lex QUALIFY rank <= 50""")
def r01d(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), tokenize(F.col("text")).alias("tokens"))
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), tokenize(F.col("text")).alias("tokens"))
    return rounded(L.bm25(queries, docs, 50), 4)


@query("R02_overlap_cosine", f"WITH {CORPUS} SELECT query_id, vec_id, round(overlap, 6) overlap FROM lex")
def r02(spark, d):
    return rounded(L.overlap_pairs(*corpus(spark, d)))


def pool_sql(n: int) -> str:
    """The pool with lists of n rows."""
    return f"""{CORPUS}, ev AS (SELECT query_id, vec_id FROM cs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY emb DESC, vec_id) <= {n}), bl AS (SELECT query_id, vec_id, bm25 FROM lex QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, vec_id) <= {n}),
un AS (SELECT * FROM ev UNION SELECT query_id, vec_id FROM bl), kp AS (SELECT un.query_id, un.vec_id, emb FROM un JOIN cs USING (query_id, vec_id) QUALIFY row_number() OVER (PARTITION BY un.query_id ORDER BY emb DESC, un.vec_id) <= {n}),
pool0 AS (SELECT query_id, vec_id, emb, coalesce(bm25, 0) bm25, len(list_intersect(qt.toks, dt.toks)) / (len(list_distinct(qt.toks)) + len(list_distinct(dt.toks)) - len(list_intersect(qt.toks, dt.toks))) tok,
 1 - levenshtein(lower(trim(qs.txt)), docs.txt) / greatest(length(qs.txt), length(docs.txt)) fuz FROM kp LEFT JOIN bl USING (query_id, vec_id) JOIN qs USING (query_id) JOIN docs USING (vec_id) JOIN qt USING (query_id) JOIN dt USING (vec_id)),
pool AS (SELECT query_id, vec_id, round(emb, 9) emb, round(bm25, 9) bm25, round(tok, 9) tok, round(fuz, 9) fuz FROM pool0)"""


def rrf_sql(per_method: int) -> str:
    ranks = " UNION ALL ".join(f"SELECT query_id, vec_id, {w} / (60 + row_number() OVER v) s, row_number() OVER v r FROM pool {cut} WINDOW v AS (PARTITION BY query_id ORDER BY {c} DESC, vec_id)"
                               for c, w, cut in (("emb", 0.80, ""), ("bm25", 0.12, "WHERE bm25 > 0"), ("tok", 0.05, ""), ("fuz", 0.03, "")))
    return f"rr AS ({ranks}), rf AS (SELECT query_id, vec_id, sum(s) rrf FROM rr WHERE r <= {per_method} GROUP BY ALL)"


POOL, RRF = pool_sql(X.POOL), rrf_sql(X.PER_METHOD)


def pool_of(spark, d):
    return cut_lineage(rounded(X.candidate_pool(*corpus(spark, d)), 9))


@query("R03_candidate_pool", f"WITH {POOL} SELECT query_id, vec_id, round(emb, 6) emb, round(round(bm25, 9), 6) bm25, round(tok, 6) tok, round(fuz, 6) fuz FROM pool0")
def r03(spark, d):
    return rounded(X.candidate_pool(*corpus(spark, d)))


@query("R04_rrf", f"WITH {POOL}, {RRF} SELECT query_id, vec_id, round(rrf, 6) rrf FROM rf")
def r04(spark, d):
    return rounded(X.rrf(pool_of(spark, d)))


def _mm(c: str) -> str:
    return f"CASE WHEN max({c}) OVER w - min({c}) OVER w < 1e-12 THEN 0.0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"


@query("R05_scoresum", f"WITH {POOL} SELECT query_id, vec_id, round(0.80 * {_mm('emb')} + 0.12 * {_mm('bm25')} + 0.05 * {_mm('tok')} + 0.03 * {_mm('fuz')}, 6) scoresum FROM pool WINDOW w AS (PARTITION BY query_id)")
def r05(spark, d):
    return rounded(X.scoresum(pool_of(spark, d)))


@query("R06_softmax_fusion", f"""WITH {POOL}, {RRF}, ee AS (SELECT query_id, vec_id, exp((emb - max(emb) OVER w) / 0.07) a, exp((ln(1 + bm25) - max(ln(1 + bm25)) OVER w) / 1.0) b, exp((tok - max(tok) OVER w) / 0.35) c, exp((fuz - max(fuz) OVER w) / 0.35) f FROM pool WINDOW w AS (PARTITION BY query_id)),
sf AS (SELECT query_id, vec_id, 0.80 * a / (sum(a) OVER w + 1e-12) + 0.12 * b / (sum(b) OVER w + 1e-12) + 0.05 * c / (sum(c) OVER w + 1e-12) + 0.03 * f / (sum(f) OVER w + 1e-12) s FROM ee WINDOW w AS (PARTITION BY query_id))
SELECT query_id, vec_id, round(0.9 * s + 0.1 * coalesce(rrf, 0), 6) fused FROM sf LEFT JOIN rf USING (query_id, vec_id)""")
def r06(spark, d):
    return rounded(X.softmax_fusion(pool_of(spark, d)))


@query("R07_fused_rank", f"""WITH {CORPUS}, sc AS (SELECT query_id, split_part(query_id, ' ', 1) scope FROM qs), mm AS (SELECT query_id, min(emb) lo, max(emb) hi FROM cs GROUP BY 1), sm AS (SELECT scope, vec_id, sum(CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (emb - lo) / (hi - lo) END) s, 2 * count(*) n FROM cs JOIN mm USING (query_id) JOIN sc USING (query_id) GROUP BY ALL),
mx AS (SELECT query_id, max(bm25) mb, max(overlap) mo FROM lex GROUP BY 1), lx AS (SELECT scope, vec_id, sum(0.5 * bm25 / mb + 0.5 * overlap / mo) l FROM lex JOIN mx USING (query_id) JOIN sc USING (query_id) GROUP BY ALL),
tt AS (SELECT scope, vec_id, (0.8 * s + 0.2 * coalesce(l, 0)) / n f FROM sm LEFT JOIN lx USING (scope, vec_id)) SELECT scope, vec_id, round(f, 6) fused, row_number() OVER (PARTITION BY scope ORDER BY f DESC, vec_id) AS rank FROM tt QUALIFY rank <= 50""")
def r07(spark, d):
    queries, docs = corpus(spark, d)
    return rounded(X.fused_rank(queries.withColumn("scope", F.split("query_id", " ")[0]), docs, 50, "scope"))


ITEMS = f"""it AS (SELECT DISTINCT 'c' || (p_partkey % 40) cluster_id, p_name leaf, p_type ctx1, {PRIM} ctx2 FROM part WHERE p_partkey % 9 <> 0 AND p_name NOT LIKE 'red%'),
ph AS (SELECT p_partkey path_id, upper(p_name) || ' ' leaf, CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE p_type END ctx1, CASE WHEN p_partkey % 6 = 0 THEN 'y' ELSE {PRIM} END ctx2 FROM part),
hv AS (SELECT DISTINCT cluster_id, unnest([1, 2, 3, 4]) lv, unnest([lower(concat_ws('^', leaf, ctx1, ctx2)), lower(concat_ws('^', leaf, ctx2)), lower(concat_ws('^', leaf, ctx1)), lower(leaf)]) k FROM it),
wn AS (SELECT path_id, unnest([1, 2, 3, 4]) lv, unnest([lower(concat_ws('^', trim(leaf), ctx1, ctx2)), lower(concat_ws('^', trim(leaf), ctx2)), lower(concat_ws('^', trim(leaf), ctx1)), lower(trim(leaf))]) k FROM ph),
ht AS (SELECT DISTINCT path_id, lv, k FROM wn WHERE EXISTS (SELECT 1 FROM hv WHERE hv.lv = wn.lv AND hv.k = wn.k)), fs AS (SELECT path_id, min(lv) lv, arg_min(k, lv) k FROM ht GROUP BY 1),
inf AS (SELECT path_id, hv.lv AS "level", cluster_id, count(*) OVER (PARTITION BY path_id) n_candidates FROM fs JOIN hv ON fs.lv = hv.lv AND fs.k = hv.k)"""


def items_paths(spark, d):
    h = table(spark, d, "part").join(M.hierarchy(spark, d).withColumnRenamed("predictor_id", "p_partkey"), "p_partkey")
    items = h.where((F.col("p_partkey") % 9 != 0) & ~F.col("p_name").startswith("red")).select(F.concat(F.lit("c"), F.col("p_partkey") % 40).alias("cluster_id"), F.col("p_name").alias("leaf"), F.col("secondary").alias("ctx1"), F.col("primary").alias("ctx2"))
    pths = h.select(F.col("p_partkey").alias("path_id"), F.concat(F.upper("p_name"), F.lit(" ")).alias("leaf"), F.when(F.col("p_partkey") % 4 == 0, "x").otherwise(F.col("secondary")).alias("ctx1"), F.when(F.col("p_partkey") % 6 == 0, "y").otherwise(F.col("primary")).alias("ctx2"))
    return items, pths


@query("J10_infer_cluster_ids", f"""WITH {ITEMS} SELECT p.path_id, "level", cluster_id, n_candidates, coalesce(n_candidates > 1, false) ambiguous FROM ph p LEFT JOIN inf USING (path_id)""")
def j10(spark, d):
    items, pths = items_paths(spark, d)
    return J.infer_cluster_ids(pths, items)


@query("R08_rank_predictors", f"""WITH {ITEMS}, ed AS (SELECT 'c' || (l_suppkey % 40) cluster_id, l_partkey predictor, max(l_quantity * 20) score FROM lineitem GROUP BY ALL),
mg AS (SELECT p.path_id % 10 profile_id, ph.leaf criterion, predictor, max(score) score FROM (SELECT path_id, leaf FROM ph) p JOIN ph USING (path_id) JOIN inf USING (path_id) JOIN ed USING (cluster_id) GROUP BY ALL)
SELECT profile_id, criterion, predictor, score, row_number() OVER (PARTITION BY profile_id, criterion ORDER BY score DESC, predictor) AS rank FROM mg QUALIFY rank <= 10""")
def r08(spark, d):
    items, pths = items_paths(spark, d)
    edges = table(spark, d, "lineitem").groupBy(F.concat(F.lit("c"), F.col("l_suppkey") % 40).alias("cluster_id"), F.col("l_partkey").alias("predictor")).agg(F.max(F.col("l_quantity") * 20).alias("score"))
    named = pths.select((F.col("path_id") % 10).alias("profile_id"), F.col("leaf").alias("criterion"), "path_id")
    return X.rank_predictors(named, J.infer_cluster_ids(pths, items), edges, 10)


FM = """mp AS (SELECT o_custkey % 50 profile_id, o_orderstatus criterion, o_orderpriority path, avg(o_totalprice) / 1000 mapping_score FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_custkey % 3 <> 0 GROUP BY ALL),
hy AS (SELECT o_custkey % 50 profile_id, o_orderpriority path, count(*) / 10 hyde_score FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL)"""


def fuse_inputs(spark, d):
    o = table(spark, d, "orders")
    by = [(F.col("o_custkey") % 50).alias("profile_id")]
    mapping = o.where((F.col("o_orderpriority") != "1-URGENT") & (F.col("o_custkey") % 3 != 0)).groupBy(*by, F.col("o_orderstatus").alias("criterion"), F.col("o_orderpriority").alias("path")).agg((F.avg("o_totalprice") / 1000).alias("score"))
    hyde = o.where(F.col("o_orderpriority") != "5-LOW").groupBy(*by, F.col("o_orderpriority").alias("path")).agg((F.count(F.lit(1)) / 10).alias("score"))
    return mapping, hyde


@query("R09_fuse_matrix_required", f"""WITH {FM}, f AS (SELECT profile_id, criterion, path, mapping_score, hyde_score, (0.7 * mapping_score + 0.3 * coalesce(hyde_score, 0)) / 1.0 fused FROM mp LEFT JOIN hy USING (profile_id, path))
SELECT profile_id, criterion, path, round(mapping_score, 6) mapping_score, round(hyde_score, 6) hyde_score, round(fused, 6) fused, round(avg(fused) OVER (PARTITION BY profile_id, path), 6) row_mean FROM f""")
def r09(spark, d):
    return rounded(X.fuse_matrix(*fuse_inputs(spark, d), 0.7, 0.3, True, True))


@query("R09_fuse_matrix_open", f"""WITH {FM}, sp AS (SELECT profile_id, criterion, path FROM (SELECT DISTINCT profile_id, criterion FROM mp) JOIN (SELECT profile_id, path FROM mp UNION SELECT profile_id, path FROM hy) USING (profile_id)),
f AS (SELECT profile_id, criterion, path, mapping_score, hyde_score, (0.7 * coalesce(mapping_score, 0) + 0.3 * coalesce(hyde_score, 0)) / nullif(CASE WHEN mapping_score IS NULL THEN 0 ELSE 0.7 END + CASE WHEN hyde_score IS NULL THEN 0 ELSE 0.3 END, 0) fused FROM sp LEFT JOIN mp USING (profile_id, criterion, path) LEFT JOIN hy USING (profile_id, path))
SELECT profile_id, criterion, path, round(mapping_score, 6) mapping_score, round(hyde_score, 6) hyde_score, round(fused, 6) fused, round(avg(fused) OVER (PARTITION BY profile_id, path), 6) row_mean FROM f WHERE fused IS NOT NULL""")
def r09o(spark, d):
    return rounded(X.fuse_matrix(*fuse_inputs(spark, d), 0.7, 0.3, False, False))


@query("R10_query_texts", """SELECT s_suppkey, concat_ws(' | ', 's_name: ' || s_name, CASE WHEN s_acctbal > 0 THEN 'tier: paid' END, 'n_name: ' || n_name) query_text FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def r10(spark, d):
    v = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("tier", F.when(F.col("s_acctbal") > 0, "paid").otherwise(" "))
    return X.query_texts(v, ["s_name", "tier", "n_name"]).select("s_suppkey", "query_text")


@query("R10_solution_queries", """WITH s AS (SELECT c_nationkey profile_id, c_custkey solution_id, c_mktsegment predictor, unnest(['r' || (c_custkey % 5), 'r9']) criterion FROM customer), c AS (SELECT n_nationkey profile_id, 'r' || r_regionkey criterion, r_name || ' of ' || n_name AS label FROM nation, region)
SELECT profile_id, criterion, solution_id, concat_ws(' | ', predictor, coalesce(label, criterion)) query_text FROM s LEFT JOIN c USING (profile_id, criterion)""")
def r10s(spark, d):
    sol = table(spark, d, "customer").select(F.col("c_nationkey").alias("profile_id"), F.col("c_custkey").alias("solution_id"), F.col("c_mktsegment").alias("predictor"), F.array(F.concat(F.lit("r"), F.col("c_custkey") % 5), F.lit("r9")).alias("targets"))
    keys = F.explode(F.array(*[F.lit(i) for i in range(5)]))
    crit = table(spark, d, "nation").select("n_nationkey", "n_name", keys.alias("r_regionkey")).join(table(spark, d, "region"), "r_regionkey").select(
        F.col("n_nationkey").alias("profile_id"), F.concat(F.lit("r"), "r_regionkey").alias("criterion"), F.concat("r_name", F.lit(" of "), "n_name").alias("label"))
    return X.solution_queries(sol, crit).select("profile_id", "criterion", "solution_id", "query_text")


@query("J11_combine_evidence", """WITH a AS (SELECT l_partkey k, max(l_discount) s FROM lineitem GROUP BY 1), b AS (SELECT l_partkey k, max(l_tax) s FROM lineitem GROUP BY 1), c AS (SELECT p_partkey k, p_size / 50 s FROM part)
SELECT coalesce(a.k, b.k, c.k) barrier, round(coalesce(a.s, 0), 6) predictor_score, round(coalesce(b.s, 0), 6) profile_score, round(coalesce(c.s, 0), 6) context_score FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON coalesce(a.k, b.k) = c.k""")
def j11(spark, d):
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return rounded(J.combine_evidence({
        "predictor": li.select(F.col("l_partkey").alias("barrier"), F.col("l_discount").alias("score")),
        "profile": li.select(F.col("l_partkey").alias("barrier"), F.col("l_tax").alias("score")),
        "context": part.select(F.col("p_partkey").alias("barrier"), (F.col("p_size") / 50).alias("score"))}, "barrier"))


@query("J12_fuzzy_entity_match", """WITH fa AS (SELECT DISTINCT s_suppkey label_id, lower(s_name) || ' ' || s_nationkey ka FROM supplier), t AS (SELECT DISTINCT s_suppkey entity_id, lower(s_name) || ' ' || ((s_nationkey + s_suppkey) % 25) kb FROM supplier),
x AS (SELECT label_id, entity_id, ka, kb, CASE WHEN ka = kb THEN 1.0 ELSE 1 - levenshtein(ka, kb) / greatest(length(ka), length(kb)) END r FROM fa, t WHERE ka = kb OR len(list_intersect(regexp_extract_all(ka, '[a-z0-9]+'), regexp_extract_all(kb, '[a-z0-9]+'))) > 0)
SELECT label_id, entity_id, kb term, round(r, 6) ratio FROM x WHERE r >= 0.88 QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY r DESC, kb, entity_id) = 1""")
def j12(spark, d):
    s = table(spark, d, "supplier")
    labels = s.select(F.col("s_suppkey").alias("label_id"), F.concat_ws(" ", "s_name", "s_nationkey").alias("label"))
    terms = s.select(F.col("s_suppkey").alias("entity_id"), F.concat_ws(" ", "s_name", (F.col("s_nationkey") + F.col("s_suppkey")) % 25).alias("term"))
    return rounded(J.fuzzy_entity_match(labels, terms))


@query("J13_resolve_layer", f"""WITH ix AS (SELECT lower(p_name) k, min({PRIM}) lo, max({PRIM}) hi FROM part GROUP BY 1), r AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 = 0 THEN ' bio' WHEN p_partkey % 5 = 1 THEN 'other' END layer, CASE WHEN p_partkey % 7 = 0 THEN 'SOCIAL' WHEN p_partkey % 7 = 1 THEN 'zzz' END root FROM part)
SELECT p_partkey, coalesce(CASE WHEN layer = ' bio' THEN 'BIO' END, CASE WHEN root = 'SOCIAL' THEN root END, CASE WHEN lo = hi THEN lo END, 'UNKNOWN') resolved_layer, CASE WHEN layer = ' bio' THEN 'explicit' WHEN root = 'SOCIAL' THEN 'path' WHEN lo = hi THEN 'leaf' ELSE 'none' END layer_source FROM r LEFT JOIN ix ON lower(p_name) = k""")
def j13(spark, d):
    h = table(spark, d, "part").join(M.hierarchy(spark, d).withColumnRenamed("predictor_id", "p_partkey"), "p_partkey")
    k5, k7 = F.col("p_partkey") % 5, F.col("p_partkey") % 7
    rows = h.select("p_partkey", F.col("p_name").alias("label"), F.when(k5 == 0, " bio").when(k5 == 1, "other").alias("layer"), F.when(k7 == 0, "SOCIAL > a").when(k7 == 1, "zzz > b").alias("path"))
    index = h.select(F.col("p_name").alias("label"), F.col("primary").alias("layer"))
    return J.resolve_layer(rows, index, M.PRIMARY).select("p_partkey", "resolved_layer", "layer_source")


@query("J14_map_labels", f"""WITH lv AS (SELECT p_name k, min((p_partkey, {PRIM}, p_type, p_name)) m FROM part GROUP BY 1), lb AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' / none' ELSE 'nothing' END k0, p_partkey % 3 z, p_name FROM part)
SELECT p_partkey, CASE WHEN z < 2 THEN struct_extract_at(m, 2) ELSE 'UNMAPPED' END "domain", CASE WHEN z < 2 THEN struct_extract_at(m, 3) ELSE 'UNMAPPED' END parent, CASE WHEN z < 2 THEN struct_extract_at(m, 1) ELSE 10000000 END leaf_id FROM lb LEFT JOIN lv ON p_name = k""")
def j14(spark, d):
    h = table(spark, d, "part").join(M.hierarchy(spark, d).withColumnRenamed("predictor_id", "p_partkey"), "p_partkey")
    leaves = h.select(F.col("p_name").alias("leaf"), F.col("p_partkey").alias("leaf_id"), F.col("primary").alias("domain"), F.col("secondary").alias("parent"))
    z = F.col("p_partkey") % 3
    label = F.when(z == 0, F.concat(F.lit("X > "), F.upper("p_name"), F.lit(" (ID:5)"))).when(z == 1, F.concat("p_name", F.lit(" / none"))).otherwise("nothing | here")
    return J.map_labels(h.select("p_partkey", label.alias("label")), leaves).select("p_partkey", "domain", "parent", "leaf_id")


@query("P11_enforce_allowed_paths", f"""WITH {PATHS}, bs AS (SELECT pa, pb, s FROM sim WHERE s >= 0.5 QUALIFY row_number() OVER (PARTITION BY pa ORDER BY round(s, 9) DESC, replace(pb, ' > ', ' / ')) = 1) SELECT pa, replace(pb, ' > ', ' / ') mapped, round(s, 6) similarity FROM bs""")
def p11(spark, d):
    rows = long_paths(spark, d).distinct().withColumn("path", F.col("pa"))
    return rounded(J.enforce_allowed_paths(rows, short_paths(spark, d).withColumnRenamed("pb", "allowed"), 0.5).select("pa", "mapped", "similarity"))
