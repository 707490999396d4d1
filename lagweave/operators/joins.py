"""Similarity, prefix and cascading joins, blocked so that no frequent key pairs everything with everything.

Set joins order tokens rare first and join only the prefix that a qualifying pair must share, so frequent tokens
rarely become join keys. Path joins work on distinct paths; rows are joined back afterwards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.functions import paths as P
from lagweave.functions.scores import fuzzy_ratio


def expand_to_leaves(mapping: DataFrame, leaves: DataFrame, by: list[str]) -> DataFrame:
    """mapping(by, path, score) applied to every leaf below its path; the deepest wins, then the higher score.

    Each leaf is exploded to its own ancestor prefixes, so the join is an equi-join on the prefix.
    """
    m = mapping.withColumn("prefix", F.lower(P.normalize_path(F.col("path")))).groupBy(*by, "prefix").agg(F.max("score").alias("score"))
    segs = leaves.select("leaf").distinct().withColumn("s", P.lower_segments(F.col("leaf")))
    up = segs.select("leaf", F.explode(F.sequence(F.lit(1), F.greatest(F.size("s"), F.lit(1)))).alias("depth"), "s").select(
        "leaf", "depth", F.array_join(F.slice("s", F.lit(1), F.col("depth")), " / ").alias("prefix"))
    hit = up.join(m, "prefix")
    return hit.groupBy(*by, "leaf").agg(F.max(F.struct("depth", "score", "prefix")).alias("b")).select(
        *by, "leaf", F.col("b.prefix").alias("matched_path"), F.col("b.depth").alias("matched_depth"), F.col("b.score").alias("score"))


def _segment_table(df: DataFrame, path: str, name: str) -> DataFrame:
    return df.select(F.col(path).alias(name)).where(F.col(name).isNotNull()).distinct().withColumn(f"{name}_s", P.lower_segments(F.col(name)))


def _rarest(table: DataFrame, name: str, freq: DataFrame) -> DataFrame:
    return table.select(name, F.explode(F.array_distinct(f"{name}_s")).alias("seg")).join(freq, "seg").groupBy(name).agg(
        F.min(F.struct("n_seg", "seg"))["seg"].alias("seg"))


def subsequence_match(mapping: DataFrame, leaves: DataFrame) -> DataFrame:
    """Pairs (path, leaf) with the same root where the path's segments are a subsequence of the leaf's.

    The join key is the path's rarest segment; every superset leaf must contain it.
    """
    a, b = _segment_table(mapping, "path", "path"), _segment_table(leaves, "leaf", "leaf")
    every = b.select("leaf", "leaf_s", F.explode(F.array_distinct("leaf_s")).alias("seg"))
    freq = every.groupBy("seg").agg(F.count(F.lit(1)).alias("n_seg"))
    keyed = _rarest(a, "path", freq).join(a, "path")
    return keyed.join(every, "seg").where((F.get("path_s", F.lit(0)) == F.get("leaf_s", F.lit(0))) & P.is_subsequence(F.col("path_s"), F.col("leaf_s"))).select("path", "leaf")


def _token_prefixes(df: DataFrame, key: str, tokens: str, freq: DataFrame, min_sim: float) -> DataFrame:
    ranked = df.select(key, F.explode(tokens).alias("tok")).join(freq, "tok").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n_tok", "tok"))).alias("r"))
    need = F.greatest(F.lit(1), F.ceil(min_sim * F.size("r") - 1e-9)).cast("int")
    return ranked.select(key, F.size("r").alias("n"), F.posexplode(F.slice("r", F.lit(1), F.size("r") - need + 1)).alias("i", "t")).select(key, "n", "i", F.col("t.tok").alias("tok"))


def jaccard_candidates(a: DataFrame, ka: str, ta: str, b: DataFrame, kb: str, tb: str, min_sim: float) -> DataFrame:
    """A superset of the pairs with Jaccard >= min_sim (> 0): rare-first prefix, length and position filters. Token
    columns hold distinct tokens.

    All common tokens of a pair stand at or after its first common one, so a match at positions (i, j) leaves room for
    at most min(na - i, nb - j) common tokens; frequent tokens stand last and fail this test for most pairs.
    """
    both = a.select(F.explode(ta).alias("tok")).unionAll(b.select(F.explode(tb).alias("tok")))
    freq = both.groupBy("tok").agg(F.count(F.lit(1)).alias("n_tok"))
    pa = _token_prefixes(a, ka, ta, freq, min_sim).withColumnsRenamed({"n": "na", "i": "ia"})
    pb = _token_prefixes(b, kb, tb, freq, min_sim).withColumnsRenamed({"n": "nb", "i": "ib"})
    slack = 1 + 1e-9
    room = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    return pa.join(pb, "tok").where(room * slack >= min_sim / (1 + min_sim) * (F.col("na") + F.col("nb"))).where((F.col("nb") * slack >= min_sim * F.col("na")) & (F.col("na") * slack >= min_sim * F.col("nb"))).select(ka, kb).distinct()


def jaccard_join(a: DataFrame, ka: str, ta: str, b: DataFrame, kb: str, tb: str, min_sim: float) -> DataFrame:
    cand = jaccard_candidates(a, ka, ta, b, kb, tb, min_sim)
    full = cand.join(a.select(ka, F.col(ta).alias("_a")), ka).join(b.select(kb, F.col(tb).alias("_b")), kb)
    return full.select(ka, kb, P.jaccard(F.col("_a"), F.col("_b")).alias("similarity")).where(F.col("similarity") >= min_sim)


def path_similarity_join(a: DataFrame, pa: str, b: DataFrame, pb: str, min_sim: float) -> DataFrame:
    """(pa, pb, similarity) for all distinct path pairs with composite similarity >= min_sim > 0.

    Candidates are complete: a pair that is a subsequence shares the shorter one's rarest segment; any other pair
    shares its first two segments, or at most the first one, and then its token Jaccard is at least
    (min_sim - .175) / .45. When that bound is not positive, sharing any token or the first segment is required.
    """
    A, B = _segment_table(a, pa, pa), _segment_table(b, pb, pb)
    A, B = A.withColumn(f"{pa}_t", P.path_tokens(F.col(pa))), B.withColumn(f"{pb}_t", P.path_tokens(F.col(pb)))
    bound = (min_sim - P.PREFIX_WEIGHT / 2) / P.TOKEN_WEIGHT
    segs = lambda t, n: t.select(n, F.explode(F.array_distinct(f"{n}_s")).alias("seg"))
    freq = segs(A, pa).select("seg").unionAll(segs(B, pb).select("seg")).groupBy("seg").agg(F.count(F.lit(1)).alias("n_seg"))
    by_segment = _rarest(A, pa, freq).join(segs(B, pb), "seg").select(pa, pb).unionAll(_rarest(B, pb, freq).join(segs(A, pa), "seg").select(pa, pb))
    depth = 2 if bound > 0 else 1
    head = lambda t, n: t.where(F.size(f"{n}_s") >= depth).select(n, F.slice(f"{n}_s", 1, depth).alias("head"))
    by_head = head(A, pa).join(head(B, pb), "head").select(pa, pb)
    by_token = jaccard_candidates(A, pa, f"{pa}_t", B, pb, f"{pb}_t", max(bound, 1e-9))
    cand = by_segment.unionAll(by_head).unionAll(by_token).distinct()
    scored = cand.join(A, pa).join(B, pb).select(
        pa, pb, P.similarity_of_parts(F.col(f"{pa}_s"), F.col(f"{pb}_s"), F.col(f"{pa}_t"), F.col(f"{pb}_t")).alias("similarity"))
    return scored.where(F.col("similarity") >= min_sim)


def infer_cluster_ids(paths: DataFrame, items: DataFrame) -> DataFrame:
    """paths(path_id, leaf, ctx1, ctx2) against items(cluster_id, leaf, ctx1, ctx2).

    The first level with a hit decides: leaf+both contexts, leaf+ctx2, leaf+ctx1, leaf. One row per candidate
    cluster; `ambiguous` marks several. Paths without a hit keep one row with nulls.
    """
    norm = lambda c: F.lower(F.trim(c))

    def keyed(df: DataFrame, keep: str) -> DataFrame:
        leaf, c1, c2 = norm(F.col("leaf")), norm(F.col("ctx1")), norm(F.col("ctx2"))
        keys = [F.struct(F.lit(i).alias("level"), F.concat_ws("\u0001", *parts).alias("key")) for i, parts in enumerate(([leaf, c1, c2], [leaf, c2], [leaf, c1], [leaf]), 1)]
        return df.select(keep, F.explode(F.array(*keys)).alias("k")).select(keep, "k.*").distinct()

    have, want = keyed(items, "cluster_id"), keyed(paths, "path_id")
    sizes = have.groupBy("level", "key").agg(F.count(F.lit(1)).alias("n_candidates"))
    first = want.join(sizes, ["level", "key"]).groupBy("path_id").agg(F.min(F.struct("level", "key", "n_candidates")).alias("f")).select("path_id", "f.*")
    found = first.join(have, ["level", "key"]).select("path_id", "level", "cluster_id", "n_candidates")
    return paths.select("path_id").distinct().join(found, "path_id", "left").withColumn("ambiguous", F.coalesce(F.col("n_candidates") > 1, F.lit(False)))


def combine_evidence(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Outer union of score tables (key, score) on the key; 0 where a source has none."""
    out = None
    for name, df in sources.items():
        part = df.groupBy(key).agg(F.max("score").alias(f"{name}_score"))
        out = part if out is None else out.join(part, key, "full_outer")
    return out.fillna(0.0, [f"{name}_score" for name in sources])


SHORT_EDITS = 2


def _without(c: Column, edits: int) -> Column:
    """Hashes of the string and of all strings that come from it by dropping up to `edits` (1 or 2) characters."""
    n = F.length(c)
    span = lambda start, length: F.substr(c, start, length)
    ones = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.concat(span(F.lit(1), i - 1), span(i + 1, n))))
    out = F.concat(F.array(F.xxhash64(c)), ones)
    if edits > 1:
        twos = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(
            F.sequence(i + 1, n), lambda j: F.xxhash64(F.concat(span(F.lit(1), i - 1), span(i + 1, j - i - 1), span(j + 1, n))))))
        out = F.concat(out, twos)
    return F.array_distinct(out)


def _edits(longest: Column, min_ratio: float) -> Column:
    """Most edits at which a pair whose longer string has that length still has the ratio."""
    return F.floor((1 - min_ratio) * longest + 1e-9).cast("int")


def _grams(c: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.struct(i.alias("at"), F.substr(c, i, F.lit(size)).alias("gram")))


def edit_candidates(a: DataFrame, b: DataFrame, min_ratio: float) -> DataFrame:
    """A superset of the pairs (ka, kb), ka != kb, of distinct strings a(ka), b(kb) whose edit ratio is min_ratio (0.6 at
    least) or more.

    Two strings within two edits meet in a string that drops up to two characters of each. Longer strings may be further
    apart. There, e edits spoil at most e of e + 1 grams that do not overlap, so one of them stands in the partner, at
    most e places away; the rarest such grams are taken.
    """
    def sized(df: DataFrame, k: str) -> DataFrame:
        partner = F.floor(F.length(k) / min_ratio + 1e-9)
        return df.select(k, F.length(k).alias("n"), _edits(F.greatest(partner, F.length(k)), min_ratio).alias("e"))

    x, y = sized(a, "ka").where("e > 0"), sized(b, "kb").where("e > 0")
    # A string of at most this length has only partners within SHORT_EDITS edits, or needs the grams.
    short = math.ceil((SHORT_EDITS + 1) / (1 - min_ratio) - 1e-6) - 1

    def dropped(df: DataFrame, k: str) -> DataFrame:
        # A short table has many such strings; one task for each of its few blocks would make them all.
        few = df.where(F.col("n") <= short).repartition(4 * df.sparkSession.sparkContext.defaultParallelism, k)
        return few.select(k, F.explode(F.when(F.col("e") == 1, _without(F.col(k), 1)).otherwise(_without(F.col(k), 2))).alias("h"))

    near = dropped(x, "ka").join(dropped(y, "kb"), "h").where("ka != kb").select("ka", "kb").distinct()

    # Of this size there are always enough grams that do not overlap.
    size = 3 if min_ratio >= 0.86 else 2 if min_ratio >= 0.78 else 1
    far_x, far_y = x.where(F.col("e") > SHORT_EDITS), y.where(F.col("e") > SHORT_EDITS)
    at_b = far_y.select("kb", F.col("n").alias("nb"), F.explode(_grams(F.col("kb"), size)).alias("g")).select("kb", "nb", F.col("g.gram").alias("gram"), F.col("g.at").alias("at_b"))
    freq = at_b.groupBy("gram").agg(F.count(F.lit(1)).alias("f"))
    at_a = far_x.select("ka", "n", "e", F.explode(_grams(F.col("ka"), size)).alias("g")).select("ka", "n", "e", F.col("g.gram").alias("gram"), F.col("g.at").alias("at"))
    ranked = at_a.join(freq, "gram", "left").groupBy("ka", "n", "e").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "at", "gram"))).alias("gs"))
    none = F.array().cast("array<struct<f:bigint,at:int,gram:string>>")
    apart = F.aggregate("gs", none, lambda got, g: F.when(
        (F.size(got) <= F.col("e")) & F.forall(got, lambda o: F.abs(o["at"] - g["at"]) >= size), F.concat(got, F.array(g))).otherwise(got))
    asked = ranked.select("ka", "n", "e", F.explode(apart).alias("g")).select("ka", "n", "e", F.col("g.gram").alias("gram"), F.col("g.at").alias("at"))
    longest = F.greatest("n", "nb")
    fits = (F.abs(F.col("at") - F.col("at_b")) <= F.col("e")) & (longest > short) & (F.abs(F.col("n") - F.col("nb")) <= _edits(longest, min_ratio))
    far = asked.join(at_b, "gram").where(fits & (F.col("ka") != F.col("kb"))).select("ka", "kb").distinct()
    return near.unionByName(far)


def fuzzy_entity_match(labels: DataFrame, terms: DataFrame, min_ratio: float = 0.88) -> DataFrame:
    """labels(label_id, label) against terms(entity_id, term): equal keys win with 1.0, else the best edit ratio
    >= min_ratio among terms that share a token. Only folded keys without an equal one look for similar keys, and only
    those within reach of the ratio are paired."""
    from lagweave.functions.text import fold_label, words

    # Fold once and match distinct keys; labels and the smallest entity of a key join them afterwards.
    a = labels.select("label_id", fold_label(F.col("label")).alias("ka")).distinct()
    b = terms.select("entity_id", fold_label(F.col("term")).alias("kb")).distinct()
    held = b.groupBy("kb").agg(F.min(F.struct("entity_id"))["entity_id"].alias("entity_id"))
    exact = a.join(held, F.col("ka") == F.col("kb")).select("label_id", "entity_id", F.col("kb").alias("term"), F.lit(1.0).alias("ratio"))
    done = exact.select(F.col("label_id").alias("done")).distinct()
    rest = a.join(done, F.col("label_id").eqNullSafe(F.col("done")), "left_anti")
    pairs = edit_candidates(rest.select("ka").distinct(), held.select("kb"), min_ratio)
    scored = pairs.where(F.arrays_overlap(words(F.col("ka")), words(F.col("kb")))).select("ka", "kb", fuzzy_ratio(F.col("ka"), F.col("kb")).alias("ratio")).where(F.col("ratio") >= min_ratio)
    best_key = scored.groupBy("ka").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "kb")).alias("k")).select("ka", F.col("k.kb").alias("kb"), (-F.col("k.r")).alias("ratio"))
    near = rest.join(best_key, "ka").join(held, "kb").select("label_id", "entity_id", F.col("kb").alias("term"), "ratio")
    best = exact.unionByName(near).groupBy("label_id").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "term", "entity_id")).alias("b"))
    return best.select("label_id", F.col("b.entity_id").alias("entity_id"), F.col("b.term").alias("term"), (-F.col("b.r")).alias("ratio"))


def resolve_layer(rows: DataFrame, leaf_index: DataFrame, layers: list[str]) -> DataFrame:
    """Layer by precedence: explicit value, else the path's root, else the only layer of the leaf label, else UNKNOWN."""
    known = lambda c: F.when(F.upper(F.trim(c)).isin(layers), F.upper(F.trim(c)))
    uniq = leaf_index.groupBy(F.lower(F.trim("label")).alias("_key")).agg(F.min("layer").alias("_lo"), F.max("layer").alias("_hi"))
    j = rows.withColumn("_key", F.lower(F.trim("label"))).join(uniq, "_key", "left")
    from_path, from_leaf = known(F.get(P.path_segments(F.col("path")), F.lit(0))), F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
    out = j.withColumn("resolved_layer", F.coalesce(known(F.col("layer")), from_path, from_leaf, F.lit("UNKNOWN")))
    source = F.when(known(F.col("layer")).isNotNull(), "explicit").when(from_path.isNotNull(), "path").when(from_leaf.isNotNull(), "leaf").otherwise("none")
    return out.withColumn("layer_source", source).drop("_key", "_lo", "_hi")


def map_labels(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Last path segment of each label that names a leaf gives its domain, parent and id; else UNMAPPED."""
    key = lambda c: F.lower(F.regexp_replace(F.trim(c), r"[\s_]+", " "))
    segs = F.split(F.regexp_replace("label", r"\(ID:\s*\d+\)", ""), r"[/>|]+")
    ex = rows.select("label").distinct().select("label", F.posexplode(segs).alias("pos", "seg")).withColumn("key", key(F.col("seg"))).where("key != ''")
    meta = leaves.groupBy(key(F.col("leaf")).alias("key")).agg(F.min(F.struct("leaf_id", "domain", "parent", "leaf")).alias("m"))
    hit = ex.join(meta, "key").groupBy("label").agg(F.max_by("m", "pos").alias("m"))
    return rows.join(hit, "label", "left").select(
        *rows.columns, F.coalesce("m.domain", F.lit("UNMAPPED")).alias("domain"), F.coalesce("m.parent", F.lit("UNMAPPED")).alias("parent"), F.coalesce("m.leaf_id", F.lit(10_000_000)).alias("leaf_id"))


def enforce_allowed_paths(rows: DataFrame, allowed: DataFrame, min_sim: float, fallback: Column | None = None) -> DataFrame:
    """Replace each path by itself if allowed, else by its best allowed path, else drop it (or use `fallback`)."""
    norm = rows.withColumn("path_norm", P.normalize_path(F.col("path")))
    ok = allowed.select(P.normalize_path(F.col("allowed")).alias("allowed")).where("allowed != ''").distinct()
    known = norm.select("path_norm").distinct().where("path_norm != ''")
    exact = known.join(ok, known["path_norm"] == ok["allowed"]).select("path_norm", F.col("allowed").alias("mapped"), F.lit(1.0).alias("similarity"))
    rest = known.join(ok, known["path_norm"] == ok["allowed"], "left_anti")
    near = path_similarity_join(rest, "path_norm", ok, "allowed", min_sim).groupBy("path_norm").agg(
        F.min(F.struct((-F.round("similarity", 9)).alias("r"), "allowed", "similarity")).alias("b")).select("path_norm", F.col("b.allowed").alias("mapped"), "b.similarity")
    out = norm.join(exact.unionByName(near), "path_norm", "left")
    if fallback is None:
        return out.where(F.col("mapped").isNotNull()).drop("path_norm")
    return out.withColumn("mapped", F.coalesce("mapped", fallback)).drop("path_norm")
