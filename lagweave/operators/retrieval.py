"""Vector and text retrieval with rank and score fusion.

Top lists compare vectors in cells: vectors are hashed to even blocks, query blocks are copied to each, and a cell
runs one NumPy product and keeps only its top k, so no (query, vector) pair table exists. The threshold join deals
vectors to the cells of pivots and copies them only where the angle still allows a partner. Lexical lists come from
`lagweave.operators.lexical`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lagweave.core.ranking import top_n
from lagweave.core.session import cut_lineage
from lagweave.operators import lexical as L

# Fusion weights (vector, BM25, token, fuzzy), softmax temperatures, RRF constant.
WEIGHTS = {"emb": 0.80, "bm25": 0.12, "tok": 0.05, "fuz": 0.03}
TEMPERATURES = {"emb": 0.07, "bm25": 1.0, "tok": 0.35, "fuz": 0.35}
RRF_K, PER_METHOD, ALPHA, POOL = 60, 600, 0.90, 8000
QUERY_ROWS, VECTOR_ROWS, JOIN_ROWS, PRODUCT_ROWS = 512, 16_384, 8000, 500
# Scores that a cell holds at a time, in numbers.
HELD_SCORES = 2 ** 21
PIVOTS, PIVOT_SAMPLE, ONE_TILE = 512, 4096, 20_000
# Comparisons that cost as much as one more copy of a vector, and the least rows and usual number of blocks of a cell.
COPY_COST, LEAST_ROWS, BLOCKS = 500, 500, 16


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in col])


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _cells(queries: DataFrame, vecs: DataFrame):
    """Cogrouped (vector block, query block) cells; block counts follow from row counts."""
    n_q, n_v = queries.count(), vecs.count()
    cores = vecs.sparkSession.sparkContext.defaultParallelism
    qb = max(1, math.ceil(n_q / QUERY_ROWS))
    vb = max(1, math.ceil(n_v / VECTOR_ROWS), min(cores, math.ceil(n_v / 1000)))
    v = vecs.withColumn("_vb", F.pmod(F.xxhash64("vec_id"), F.lit(vb))).withColumn("_qb", F.explode(_upto(qb)))
    q = queries.withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.lit(qb))).withColumn("_vb", F.explode(_upto(vb)))
    return q.groupBy("_vb", "_qb").cogroup(v.groupBy("_vb", "_qb"))


def _score_rows(q: np.ndarray, v: np.ndarray) -> Iterator[np.ndarray]:
    """The product of all queries with all vectors, in slices of queries that hold at most HELD_SCORES numbers."""
    step = max(1, HELD_SCORES // len(v))
    for at in range(0, len(q), step):
        yield q[at:at + step] @ v.T


def topk_cosine(queries: DataFrame, vecs: DataFrame, k: int, unit_queries: bool = True) -> DataFrame:
    """Exact top k per query, with its rank. queries(query_id, embedding), vecs(vec_id, embedding)."""
    def cell(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        qm, vm = _matrix(q["embedding"]), _unit(_matrix(v["embedding"]))
        ids, n = v["vec_id"].to_numpy(), min(k, len(v))
        at, best = np.empty((len(q), n), np.int32), np.empty((len(q), n))
        rows = (row for some in _score_rows(_unit(qm) if unit_queries else qm, vm) for row in some)
        for i, row in enumerate(rows):
            at[i] = np.lexsort((ids, -row))[:n]
            best[i] = row[at[i]]
        return pd.DataFrame({"query_id": np.repeat(q["query_id"].to_numpy(), n), "vec_id": ids[at.ravel()], "score": best.ravel()})

    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {vecs.schema['vec_id'].dataType.simpleString()}, score double"
    local = _cells(queries.select("query_id", "embedding"), vecs.select("vec_id", "embedding")).applyInPandas(cell, schema)
    return top_n(local, ["query_id"], [F.desc("score"), F.col("vec_id")], k)


def cosine_extremes(queries: DataFrame, vecs: DataFrame) -> DataFrame:
    """Smallest and largest cosine of each query over all vectors."""
    def cell(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({"query_id": [], "lo": [], "hi": []})
        ends = [(s.min(axis=1), s.max(axis=1)) for s in _score_rows(_unit(_matrix(q["embedding"])), _unit(_matrix(v["embedding"])))]
        return pd.DataFrame({"query_id": q["query_id"], "lo": np.concatenate([lo for lo, _ in ends]), "hi": np.concatenate([hi for _, hi in ends])})

    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, lo double, hi double"
    cells = _cells(queries.select("query_id", "embedding"), vecs.select("vec_id", "embedding")).applyInPandas(cell, schema)
    return cells.groupBy("query_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _pivots(vecs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash sample of at most PIVOT_SAMPLE unit vectors, and those of it that are far from each other: each next one is
    that farthest from those taken."""
    rows = vecs.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("embedding").collect()
    sample = _unit(np.array([r["embedding"] for r in rows], float))
    near, taken = sample @ sample[0], [0]
    while len(taken) < min(n, len(sample)):
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-9:
            break
        taken.append(far)
        near = np.maximum(near, sample @ sample[far])
    return sample, sample[taken]


def _block_rows(n: int) -> int:
    """Rows of a block of a large cell: many blocks for the cores, few copies of each vector."""
    return max(1, min(JOIN_ROWS, max(LEAST_ROWS, math.ceil(n / BLOCKS))))


def _cheapest(pivots: np.ndarray, sample: np.ndarray, n: int, reach: float) -> np.ndarray:
    """The first so many pivots (each prefix is far apart as well) for which the copies and comparisons, as the sample
    has them, cost least. Where no angle rules a cell out, many cells would only mean many copies."""
    every, rows, m = np.arccos(np.clip(sample @ pivots.T, -1.0, 1.0)), _block_rows(n), len(sample)
    best, fewest = None, math.inf
    for p in sorted({min(2 ** k, len(pivots)) for k in range(len(pivots).bit_length() + 1)}):
        a = every[:, :p]
        home = a.argmin(axis=1)
        own = a[np.arange(m), home]
        radii = np.array([own[home == c].max(initial=-np.inf) for c in range(p)])
        guests = _goes(a, own, home, reach, radii).sum(axis=0) * n / m
        hosts = np.bincount(home, minlength=p) * n / m
        blocks = np.ceil(hosts / rows)
        copies = (hosts * (blocks + np.ceil(guests / rows)) + guests * blocks).sum()
        cost = COPY_COST * copies + (hosts * (hosts / 2 + guests)).sum()
        if cost < fewest:
            best, fewest = p, cost
    return pivots[:best]


def _goes(a: np.ndarray, own: np.ndarray, home: np.ndarray, reach: float, radii: np.ndarray) -> np.ndarray:
    """Which earlier cells can hold a partner of each row."""
    return (a <= reach + radii + 1e-7) & (a - own[:, None] <= 2 * reach + 1e-7) & (np.arange(a.shape[1]) < home[:, None])


def pivot_cells(vecs: DataFrame, threshold: float, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, embedding, cell, at_home: each vector in the cell of its nearest pivot, and copied to those earlier cells
    that can hold a partner with a cosine of `threshold` or more. With angles as distances, a partner in a cell of
    radius r is at most the threshold's angle away, so the cell's pivot is at most that angle plus r away; and half of
    what its pivot is farther off than the own one is never more than the distance to the partner. A small table does
    without the radii, which take a pass of their own."""
    n = vecs.count()
    kind = vecs.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    schema = f"vec_id {vecs.schema['vec_id'].dataType.simpleString()}, embedding {kind}, cell int, at_home boolean"
    if not n:
        return vecs.sparkSession.createDataFrame([], schema)
    reach = math.acos(max(-1.0, min(1.0, threshold)))
    sample, base = _pivots(vecs, max(1, min(pivots, math.ceil(n / 200))))
    base = _cheapest(base, sample, n, reach)

    def angles(embedding: pd.Series) -> np.ndarray:
        return np.arccos(np.clip(_unit(_matrix(embedding)) @ base.T, -1.0, 1.0))

    def radius(batches):
        for b in batches:
            if len(b):
                a = angles(b["embedding"])
                home = a.argmin(axis=1)
                yield pd.DataFrame({"cell": home, "r": a[np.arange(len(a)), home]}).groupby("cell", as_index=False).max()

    small = n <= ONE_TILE
    radii = np.full(len(base), np.inf if small else -np.inf)
    for r in [] if small else vecs.select("embedding").mapInPandas(radius, "cell int, r double").groupBy("cell").agg(F.max("r").alias("r")).collect():
        radii[r["cell"]] = r["r"]

    def deal(batches):
        for b in batches:
            if not len(b):
                continue
            a = angles(b["embedding"])
            home = a.argmin(axis=1)
            i, c = np.nonzero(_goes(a, a[np.arange(len(a)), home], home, reach, radii))
            at = np.concatenate((np.arange(len(a)), i))
            yield pd.DataFrame({"vec_id": b["vec_id"].to_numpy()[at], "embedding": b["embedding"].to_numpy()[at],
                                "cell": np.concatenate((home, c)), "at_home": np.arange(len(at)) < len(a)})

    return vecs.select("vec_id", F.col("embedding").cast(kind).alias("embedding")).mapInPandas(deal, schema)


def cosine_threshold_join(vecs: DataFrame, threshold: float, pivots: int = PIVOTS) -> DataFrame:
    """All pairs a < b with cosine >= threshold, exactly. A pair meets in the earlier of its two home cells; large cells are
    tiled, so that a task holds JOIN_ROWS rows of each side at most and the product of PRODUCT_ROWS of them with the rest."""
    vecs = vecs.select("vec_id", "embedding")
    rows = _block_rows(vecs.count())
    dealt = cut_lineage(pivot_cells(vecs, threshold, pivots))
    sizes = dealt.groupBy("cell").agg(*[F.ceil(F.sum(F.when(c, 1).otherwise(0)) / rows).alias(name) for c, name in ((F.col("at_home"), "hosts"), (~F.col("at_home"), "guests"))])
    tiled = dealt.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.when(F.col("at_home"), F.col("hosts")).otherwise(F.col("guests"))))
    blocks = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<bigint>"))
    with_hosts = F.transform(blocks("hosts"), lambda o: F.struct(F.least("block", o).alias("left"), F.greatest("block", o).alias("right"), F.lit(True).alias("inner")))
    with_guests = F.transform(blocks("guests"), lambda o: F.struct(F.col("block").alias("left"), o.alias("right"), F.lit(False).alias("inner")))
    as_guest = F.transform(blocks("hosts"), lambda o: F.struct(o.alias("left"), F.col("block").alias("right"), F.lit(False).alias("inner")))
    tiles = tiled.withColumn("tile", F.explode(F.when(F.col("at_home"), F.concat(with_hosts, with_guests)).otherwise(as_guest))).select(
        "cell", "tile.*", "vec_id", "embedding", "at_home", "block")

    def compare(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, left, right, inner = key
        ids, units, homes, places = [], [], [], []
        for rows in batches:
            ids.append(rows["vec_id"].to_numpy())
            units.append(_unit(_matrix(rows["embedding"])))
            homes.append(rows["at_home"].to_numpy())
            places.append(rows["block"].to_numpy())
        ids, units, home, place = np.concatenate(ids), np.concatenate(units), np.concatenate(homes), np.concatenate(places)
        x, y = (place == left, place == right) if inner else (home, ~home)
        xs, ys, ux, uy = ids[x], ids[y], units[x], units[y].T
        del units
        for at in range(0, len(xs) if len(ys) else 0, PRODUCT_ROWS):
            s = ux[at:at + PRODUCT_ROWS] @ uy
            i, j = np.nonzero(s >= threshold)
            la, rb = xs[at + i], ys[j]
            ok = la < rb if inner and left == right else la != rb
            yield pd.DataFrame({"a": np.minimum(la, rb)[ok], "b": np.maximum(la, rb)[ok], "score": s[i, j][ok]})

    kind = vecs.schema["vec_id"].dataType.simpleString()
    return tiles.groupBy("cell", "left", "right", "inner").applyInPandas(compare, f"a {kind}, b {kind}, score double")


def bm25(queries: DataFrame, docs: DataFrame, k: int = POOL) -> DataFrame:
    """query_id, vec_id, bm25: the k best documents of each query. queries(query_id, tokens), docs(vec_id, tokens)."""
    return L.bm25(queries, docs, k).drop("rank")


def overlap_cosine(queries: DataFrame, docs: DataFrame, k: int = POOL) -> DataFrame:
    return L.overlap_cosine(queries, docs, k).drop("rank")


def candidate_pool(queries: DataFrame, docs: DataFrame, pool: int = POOL) -> DataFrame:
    """Union of the vector and BM25 top lists, cut to `pool` by vector score, with token and fuzzy scores.

    queries(query_id, text, tokens, embedding), docs(vec_id, text, tokens, embedding). The vector list already holds the
    `pool` best vector scores of all documents, so the cut leaves exactly that list; the BM25 list, which is as long,
    gives the scores of its members, and documents outside it have none.
    """
    from lagweave.functions.paths import jaccard
    from lagweave.functions.scores import fuzzy_ratio

    by_vec = topk_cosine(queries, docs, pool).select("query_id", "vec_id", F.col("score").alias("emb"))
    q = queries.select("query_id", F.lower(F.trim("text")).alias("qt"), F.array_distinct("tokens").alias("qs"))
    d = docs.select("vec_id", F.lower("text").alias("dt"), F.array_distinct("tokens").alias("ds"))
    scored = by_vec.join(q, "query_id").join(d, "vec_id").select(
        "query_id", "vec_id", "emb", jaccard(F.col("qs"), F.col("ds")).alias("tok"), fuzzy_ratio(F.col("qt"), F.col("dt")).alias("fuz"))
    return scored.join(bm25(queries, docs, pool), ["query_id", "vec_id"], "left").fillna(0.0, ["bm25"])


def cosine_columns(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-12) * (F.sqrt(dot(b, b)) + 1e-12))


def rrf(pool: DataFrame, weights: dict[str, float] = WEIGHTS, k: int = RRF_K, per_method: int = PER_METHOD) -> DataFrame:
    """Weighted reciprocal-rank sum over each method's best `per_method` (BM25 lists hold positive scores only)."""
    parts = None
    for m, w in weights.items():
        ranked = top_n(pool.where(F.col(m) > 0) if m == "bm25" else pool, ["query_id"], [F.desc(m), F.col("vec_id")], per_method)
        part = ranked.select("query_id", "vec_id", (F.lit(w) / (k + F.col("rank"))).alias("s"))
        parts = part if parts is None else parts.unionAll(part)
    return parts.groupBy("query_id", "vec_id").agg(F.sum("s").alias("rrf"))


def scoresum(pool: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Weighted sum of min-max scaled scores; a constant method counts zero. Pools hold at most POOL rows per query."""
    w = W.partitionBy("query_id")

    def scaled(m: str) -> Column:
        lo, hi = F.min(m).over(w), F.max(m).over(w)
        return F.when(hi - lo < 1e-12, 0.0).otherwise((F.col(m) - lo) / (hi - lo))

    return pool.select("query_id", "vec_id", sum(F.lit(x) * scaled(m) for m, x in weights.items()).alias("scoresum"))


def softmax_fusion(pool: DataFrame, weights: dict[str, float] = WEIGHTS, temps: dict[str, float] = TEMPERATURES,
                   alpha: float = ALPHA, per_method: int = PER_METHOD) -> DataFrame:
    """alpha times the weighted temperature softmax of each method (log1p on BM25) plus (1 - alpha) times RRF."""
    w = W.partitionBy("query_id")
    logged = pool.withColumn("_bm25", F.log1p(F.greatest(F.lit(0.0), F.col("bm25"))))
    cols = {m: ("_bm25" if m == "bm25" else m) for m in weights}
    expd = logged.withColumns({f"_e_{m}": F.exp((F.col(c) - F.max(c).over(w)) / temps[m]) for m, c in cols.items()})
    soft = sum(F.lit(x) * F.col(f"_e_{m}") / (F.sum(f"_e_{m}").over(w) + 1e-12) for m, x in weights.items())
    base = expd.select("query_id", "vec_id", (F.lit(alpha) * soft).alias("_s"))
    both = base.join(rrf(pool, weights, per_method=per_method), ["query_id", "vec_id"], "left")
    return both.select("query_id", "vec_id", (F.col("_s") + (1 - alpha) * F.coalesce("rrf", F.lit(0.0))).alias("fused"))


# Semantic and lexical share of the multi-query ranking, and the split inside the lexical part.
SEMANTIC, LEXICAL, LEX_BM25, LEX_OVERLAP = 0.80, 0.20, 0.5, 0.5
# How many times k the vector list of a fused ranking is long.
DEPTH = 16


def fused_rank(queries: DataFrame, docs: DataFrame, k: int, scope: str) -> DataFrame:
    """Top k docs per scope over all its query texts: min-max cosine plus scaled BM25 and overlap, divided by the
    number of texts. queries(query_id, scope, tokens, embedding), docs(vec_id, tokens, embedding)."""
    scopes, candidates = fused_candidates(queries, docs, k, scope)
    total = candidates.join(scopes.select("query_id", "c", "n_texts"), "query_id").select(
        F.col("query_id").alias(scope), "vec_id", ((SEMANTIC * (F.col("sem") - F.col("c")) + LEXICAL * F.col("lex")) / F.col("n_texts")).alias("fused"))
    return top_n(total, [scope], [F.desc("fused"), F.col("vec_id")], k)


def fused_candidates(queries: DataFrame, docs: DataFrame, k: int, scope: str) -> tuple[DataFrame, DataFrame]:
    """The scopes as queries, and (query_id, vec_id, sem, lex) of the documents that can be in a scope's top k.

    The sum of scaled cosines over a scope is one dot product with a summed vector, and the sum of its scaled lexical
    scores is one weighted sum over terms, so a scope is one query of each kind. Of the DEPTH * k best by vector, the k-th
    best fused score is a floor. A document outside them has no better vector score than the last of them, so it needs a
    lexical score that makes up for the rest; those that have it come from the lexical index by that floor. A deep
    vector list is cheap beside the product that it comes from, and few documents outside it are left to lift.
    """
    q = queries.join(cut_lineage(cosine_extremes(queries, docs)), "query_id").withColumn("range", F.col("hi") - F.col("lo"))
    q = q.withColumn("inv", F.when(F.col("range") < 1e-12, 0.0).otherwise(1 / F.col("range")))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))) + 1e-12
    dims = q.select(scope, (F.col("inv") / norm).alias("f"), F.posexplode("embedding").alias("i", "x")).groupBy(scope, "i").agg(F.sum(F.col("f") * F.col("x")).alias("x"))
    vec = dims.groupBy(scope).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
    const = q.groupBy(scope).agg(F.sum(F.col("lo") * F.col("inv")).alias("c"), (2 * F.count(F.lit(1))).alias("n_texts"))
    scopes = cut_lineage(vec.join(const, scope).withColumnRenamed(scope, "query_id"))
    sem = cut_lineage(topk_cosine(scopes, docs, DEPTH * k, unit_queries=False).withColumnRenamed("score", "sem"))

    index = L.lexical_index(docs, L.vocabulary_of(queries))
    terms = cut_lineage(L.query_terms(queries).join(queries.select("query_id", scope), "query_id"))
    best = {}
    for name, weights in (("w_bm25", L.bm25_weights(queries)), ("w_overlap", L.overlap_weights(queries))):
        best[name] = L.lexical_topk(cut_lineage(weights), index, 1).select("query_id", F.col("score").alias(f"max_{name}"))
    scaled = terms.join(best["w_bm25"], "query_id").join(best["w_overlap"], "query_id").groupBy(F.col(scope).alias("query_id"), "term").agg(
        F.sum(LEX_BM25 * F.col("qtf") / F.col("max_w_bm25")).alias("w_bm25"), F.sum(LEX_OVERLAP / (F.sqrt("q_len") * F.col("max_w_overlap"))).alias("w_overlap"))
    weights = cut_lineage(scaled)
    lex = sem.select("query_id", "vec_id").join(weights, "query_id").join(index.postings, ["vec_id", "term"]).groupBy("query_id", "vec_id").agg(
        F.sum(F.col("w_bm25") * F.col("bm25") + F.col("w_overlap") * F.col("overlap")).alias("lex"))
    head = cut_lineage(sem.join(lex, ["query_id", "vec_id"], "left").fillna(0.0, ["lex"]))
    both = head.withColumn("both", SEMANTIC * F.col("sem") + LEXICAL * F.col("lex"))
    least = top_n(both, ["query_id"], [F.desc("both"), F.col("vec_id")], k, "place").where(F.col("place") == k).select("query_id", F.col("both").alias("least"))
    last = head.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("sem").alias("last")).where(F.col("n") >= DEPTH * k)
    floors = last.join(least, "query_id").select("query_id", ((F.col("least") - SEMANTIC * F.col("last")) / LEXICAL).alias("floor"))
    lifted = L.lexical_above(weights, index, floors).withColumnRenamed("score", "lex").join(head.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, r: p.cast("double") * r.cast("double")), F.lit(0.0), lambda s, v: s + v)
    extra = lifted.join(scopes.select("query_id", F.col("embedding").alias("x")), "query_id").join(docs.select("vec_id", F.col("embedding").alias("y")), "vec_id").select(
        "query_id", "vec_id", (dot(F.col("x"), F.col("y")) / (F.sqrt(dot(F.col("y"), F.col("y"))) + 1e-12)).alias("sem"), "lex")
    return scopes, head.select("query_id", "vec_id", "sem", "lex").unionByName(extra)


def rank_predictors(paths: DataFrame, inferred: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Per (profile, criterion): candidate clusters' predictors merged by best score and re-ranked.

    paths(profile_id, criterion, path_id), inferred(path_id, cluster_id), edges(cluster_id, predictor, score). A
    predictor of the merged top k is in the top k of the cluster that gives its best score, so clusters are cut first.
    """
    once = edges.groupBy("cluster_id", "predictor").agg(F.max("score").alias("score"))
    head = top_n(once, ["cluster_id"], [F.desc("score"), F.col("predictor")], k).drop("rank")
    named = paths.join(inferred.where(F.col("cluster_id").isNotNull()).select("path_id", "cluster_id"), "path_id")
    best = named.select("profile_id", "criterion", "cluster_id").distinct().join(head, "cluster_id")
    merged = best.groupBy("profile_id", "criterion", "predictor").agg(F.max("score").alias("score"))
    return top_n(merged, ["profile_id", "criterion"], [F.desc("score"), F.col("predictor")], k)


def fuse_matrix(mapping: DataFrame, hyde: DataFrame, w_mapping: float, w_hyde: float, missing_as_zero: bool, require_mapping: bool) -> DataFrame:
    """mapping(profile_id, criterion, path, score) with hyde(profile_id, path, score): weighted mean per cell and the
    mean of a row over its criteria. Without `require_mapping`, retrieval-only paths appear under every criterion of their profile."""
    if require_mapping:
        spine = mapping.select("profile_id", "criterion", "path").distinct()
    else:
        crit = mapping.select("profile_id", "criterion").distinct()
        every = mapping.select("profile_id", "path").union(hyde.select("profile_id", "path")).distinct()
        spine = crit.join(every, "profile_id")
    j = spine.join(mapping.withColumnRenamed("score", "mapping_score"), ["profile_id", "criterion", "path"], "left").join(
        hyde.withColumnRenamed("score", "hyde_score"), ["profile_id", "path"], "left")
    m, h = F.coalesce("mapping_score", F.lit(0.0)), F.coalesce("hyde_score", F.lit(0.0))
    den = F.lit(w_mapping + w_hyde) if missing_as_zero else (
        F.when(F.col("mapping_score").isNotNull(), w_mapping).otherwise(0.0) + F.when(F.col("hyde_score").isNotNull(), w_hyde).otherwise(0.0))
    fused = j.withColumn("fused", F.when(den > 0, (w_mapping * m + w_hyde * h) / den)).where(F.col("fused").isNotNull())
    row_mean = fused.groupBy("profile_id", "path").agg(F.avg("fused").alias("row_mean"))
    return fused.join(row_mean, ["profile_id", "path"])


def query_texts(variables: DataFrame, parts: list[str]) -> DataFrame:
    """Labelled non-empty fields joined with ' | '."""
    field = lambda c: F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", F.concat(F.lit(f"{c}: "), F.trim(F.col(c).cast("string"))))
    return variables.withColumn("query_text", F.concat_ws(" | ", *[field(c) for c in parts]))


def solution_queries(solutions: DataFrame, criteria: DataFrame) -> DataFrame:
    """One text per (solution, target criterion): predictor plus the criterion's label."""
    ex = solutions.select("profile_id", "solution_id", "predictor", F.explode("targets").alias("criterion"))
    return ex.join(criteria.select("profile_id", "criterion", F.col("label").alias("criterion_label")), ["profile_id", "criterion"], "left").withColumn(
        "query_text", F.concat_ws(" | ", "predictor", F.coalesce("criterion_label", "criterion")))
