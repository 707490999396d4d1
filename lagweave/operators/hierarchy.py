"""Hierarchies as path tables; no recursion over nested values beyond one level per step."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lagweave.core.ranking import number_rows, quantiles, running_total, top_n
from lagweave.core.session import cut_lineage


def flatten_hierarchy(docs: DataFrame) -> DataFrame:
    """docs(doc_id, json): one row per node with path, parent, depth and leaf flag, level by level for all documents."""
    level = docs.select("doc_id", F.array().cast("array<string>").alias("path"), F.col("json").alias("v"))
    out = None
    for depth in itertools.count(1):
        kids = F.from_json("v", "map<string,string>")
        level = level.select("doc_id", "path", F.explode(kids).alias("k", "v")).select("doc_id", F.concat("path", F.array("k")).alias("path"), "v")
        level = cut_lineage(level)
        if level.limit(1).count() == 0:
            break
        is_leaf = ~F.trim(F.coalesce("v", F.lit(""))).startswith("{") | (F.regexp_replace(F.coalesce("v", F.lit("")), r"\s", "") == "{}")
        rows = level.select("doc_id", F.array_join("path", " / ").alias("path"), F.array_join(F.slice("path", 1, depth - 1), " / ").alias("parent"), F.lit(depth).alias("depth"), is_leaf.alias("is_leaf"))
        out = rows if out is None else out.unionByName(rows)
        level = level.where(~is_leaf)
    return out


def parse_tree_lines(lines: DataFrame, indent: int = 2) -> DataFrame:
    """lines(doc_id, line_no, text): `[SECTION]` lines and indented nodes, leaves carrying `(ID:n)` -> leaves with id,
    label, section and first branch.

    The ancestor at a depth is the last category line of that depth, unless a shallower line came later. A document
    is one taxonomy listing; its lines form one ordered window.
    """
    spaces = F.length("text") - F.length(F.ltrim("text"))
    section = F.col("text").rlike(r"^\s*\[[^\]]+\]\s*$")
    name = F.trim(F.regexp_replace(F.regexp_replace("text", r"^[\s│├└─]*", ""), r"[\[\]*]|\(ID:\s*\d+\)", ""))
    leaf_id = F.nullif(F.regexp_extract("text", r"\(ID:\s*(\d+)\)", 1), F.lit("")).try_cast("int")
    depth = F.when(section, 0).otherwise((F.floor(spaces / indent) + 1).cast("int"))
    parsed = lines.withColumns({"depth": depth, "name": name, "leaf_id": leaf_id}).where("name != ''")
    w = W.partitionBy("doc_id").orderBy("line_no")
    parsed = parsed.withColumn("_no", F.row_number().over(w))
    seen = w.rowsBetween(W.unboundedPreceding, 0)
    max_depth = (parsed.agg(F.max("depth")).first()[0] or 0) + 1
    at = {f"_a{d}": F.last(F.when((F.col("depth") == d) & F.col("leaf_id").isNull(), F.struct("_no", "name")), True).over(seen) for d in range(max_depth)}
    tagged = parsed.withColumns(at).where(F.col("leaf_id").isNotNull())
    chain = []
    for d in range(max_depth):
        shallower = [F.col(f"_a{k}._no") for k in range(d)]
        fresh = F.lit(True) if not shallower else F.col(f"_a{d}._no") > F.coalesce(*([F.greatest(*shallower)] if d > 1 else shallower), F.lit(0))
        chain.append(F.when((F.col("depth") > d) & fresh, F.col(f"_a{d}.name")))
    out = tagged.withColumn("ancestors", F.array_compact(F.array(*chain[1:])))
    return out.select("doc_id", "leaf_id", F.col("name").alias("leaf"), F.coalesce(chain[0], F.lit("UNKNOWN_PRIMARY")).alias("primary"),
                      F.coalesce(F.get("ancestors", F.lit(0)), F.lit("UNKNOWN_SECONDARY")).alias("secondary"), (F.size("ancestors") + 1).alias("depth"))


def prefixes(paths: DataFrame, path: str = "path") -> DataFrame:
    """Every ancestor prefix (the node itself included) of each path given as a segment array."""
    steps = F.sequence(F.lit(1), F.size(path))
    pairs = F.transform(steps, lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(F.col(path), F.lit(1), d), " / ").alias("node")))
    return paths.select(F.array_join(path, " / ").alias("leaf"), F.size(path).alias("leaf_depth"), F.explode(pairs).alias("p")).select("leaf", "leaf_depth", "p.depth", "p.node")


def node_table(paths: DataFrame) -> DataFrame:
    """Distinct nodes of a set of paths with parent, label, depth and leaf flag."""
    p = prefixes(paths)
    nodes = p.groupBy("node", "depth").agg(F.max("leaf_depth").alias("deepest"))
    segs = F.split("node", " / ")
    return nodes.select("node", "depth", F.array_join(F.slice(segs, F.lit(1), F.size(segs) - 1), " / ").alias("parent"), F.element_at(segs, -1).alias("label"), (F.col("deepest") == F.col("depth")).alias("is_leaf"))


def nodes_at_level(paths: DataFrame, n: int) -> DataFrame:
    """Nodes at level n with their parent and a stable 0-based id in (parent, node) order.

    Ids are numbered inside a parent and shifted by the nodes of earlier parents.
    """
    at = paths.where(F.size("path") >= n).select(F.array_join(F.slice("path", 1, n - 1), " / ").alias("parent"), F.array_join(F.slice("path", 1, n), " / ").alias("node")).distinct()
    sizes = at.groupBy("parent").agg(F.count(F.lit(1)).alias("n_at"))
    shift = running_total(sizes, "parent", "n_at").select("parent", F.col("n_below").alias("_s"))
    inside = F.row_number().over(W.partitionBy("parent").orderBy("node"))
    return at.withColumn("_r", inside).join(shift, "parent").select("parent", "node", (F.col("_r") - 1 + F.col("_s")).alias("id"))


def subtree_size(nodes: DataFrame) -> DataFrame:
    """Leaves and nodes below (and including) each node of a node table."""
    p = prefixes(nodes.select(F.split("node", " / ").alias("path"), "is_leaf").select("path"))
    tagged = p.join(nodes.select(F.col("node").alias("leaf"), "is_leaf"), "leaf")
    return tagged.groupBy("node", "depth").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.col("is_leaf").cast("long")).alias("n_leaves"))


def vertical_edges(nodes: DataFrame, root: str) -> DataFrame:
    """Parent-child edges under a root node with the parent's depth relative to the root."""
    base = len([s for s in root.split(" / ") if s])
    under = nodes.where(F.col("node").startswith(root + " / ")) if root else nodes
    parent = F.when(F.col("parent") == "", "<ROOT>").otherwise(F.element_at(F.split("parent", " / "), -1))
    return under.select(parent.alias("parent"), F.col("label").alias("child"), F.col("parent").alias("parent_path"), F.col("node").alias("child_path"), (F.col("depth") - 1 - base).alias("parent_depth"), F.col("is_leaf").alias("child_is_leaf"))


def leaf_budget_partition(nodes: DataFrame, budget: int) -> DataFrame:
    """Disjoint subtrees of at most `budget` leaves: a node is taken when it fits (or is a leaf) and its parent does not."""
    sizes = subtree_size(nodes).select("node", "n_leaves")
    j = nodes.join(sizes, "node").join(sizes.select(F.col("node").alias("parent"), F.col("n_leaves").alias("above")), "parent", "left")
    fits = (F.col("n_leaves") <= budget) | F.col("is_leaf")
    return j.where(fits & (F.col("above").isNull() | (F.col("above") > budget))).select("node", "depth", "n_leaves")


def hierarchy_report(nodes: DataFrame, k: int = 10) -> DataFrame:
    """Long report (metric, item, value): totals, depths, levels, branching, deepest leaves, duplicated labels."""
    row = lambda metric, item, value: F.struct(F.lit(metric).alias("metric"), item.cast("string").alias("item"), value.cast("double").alias("value"))
    tot = nodes.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_leaf").alias("leaves"), F.count_if(F.col("depth") == 1).alias("roots"), F.max("depth").alias("mx"), F.min("depth").alias("mn"), F.avg("depth").alias("av"))
    none = F.lit(None)
    totals = tot.select(F.explode(F.array(
        row("nodes", none, F.col("n")), row("leaves", none, F.col("leaves")), row("roots", none, F.col("roots")), row("max_depth", none, F.col("mx")), row("min_depth", none, F.col("mn")),
        row("avg_depth", none, F.col("av")), row("leaf_ratio", none, F.col("leaves") / F.col("n")))).alias("r")).select("r.*")
    levels = nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))
    per_level = levels.select(row("level_nodes", F.col("depth"), F.col("n")).alias("r")).select("r.*")
    widest = levels.agg(F.max_by("depth", F.struct("n", -F.col("depth"))).alias("d"), F.max("n").alias("n")).select(row("widest_level", F.col("d"), F.col("n")).alias("r")).select("r.*")
    med = quantiles(nodes.withColumn("_g", F.lit(0)), ["_g"], "depth", {"m": 0.5}, bounded=True).select(row("median_depth", none, F.col("m")).alias("r")).select("r.*")
    kids = nodes.where("parent != ''").groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    branching = kids.agg(F.avg("n").alias("a"), F.max("n").alias("m")).select(F.explode(F.array(row("avg_branching", none, F.col("a")), row("max_branching", none, F.col("m")))).alias("r")).select("r.*")
    widest_nodes = kids.orderBy(F.desc("n"), "parent").limit(k).select(row("top_branching", F.col("parent"), F.col("n")).alias("r")).select("r.*")
    deepest = nodes.where("is_leaf").orderBy(F.desc("depth"), "node").limit(k).select(row("deepest_leaf", F.col("node"), F.col("depth")).alias("r")).select("r.*")
    dup = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("depth").alias("d")).where("n > 1")
    dups = dup.agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("d") > 1).alias("b")).select(F.explode(F.array(row("duplicate_labels", none, F.col("a")), row("duplicate_labels_over_depths", none, F.col("b")))).alias("r")).select("r.*")
    top_dups = dup.orderBy(F.desc("n"), "label").limit(k).select(row("top_duplicate", F.col("label"), F.col("n")).alias("r")).select("r.*")
    twins = nodes.groupBy("parent", F.lower("label").alias("l")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("a")).select(row("sibling_duplicates", none, F.col("a")).alias("r")).select("r.*")
    out = totals
    for part in (per_level, widest, med, branching, widest_nodes, deepest, dups, top_dups, twins):
        out = out.unionByName(part)
    return out


def clean_hierarchy(paths: DataFrame, protected: list[str], root: str | None = None) -> DataFrame:
    """Drop paths through prevalence fields, take out criteria wrappers, unwrap a root of the given name, lower-case
    all segments but the protected ones."""
    canon = lambda s: F.lower(F.regexp_replace(s, "[^A-Za-z0-9]", ""))

    def prevalence(s: Column) -> Column:
        c = canon(s)
        return c.contains("prevalence") & (c.contains("estimated") | c.contains("percent") | c.contains("rate"))

    segs = F.filter("path", lambda s: ~canon(s).contains("criteria"))
    if root is not None:
        bare = "".join(ch for ch in root.lower() if ch.isalnum())
        segs = F.when(canon(F.get(segs, F.lit(0))) == bare, F.slice(segs, F.lit(2), F.size(segs))).otherwise(segs)
    kept = paths.where(~F.exists("path", prevalence)).select(segs.alias("path"))
    low = F.transform("path", lambda s: F.when(s.isin(protected), s).otherwise(F.lower(s)))
    return kept.select(low.alias("path")).where(F.size("path") > 0).distinct()


def root_paths(parents: DataFrame) -> DataFrame:
    """parents(child, parent): path from the root to every node; a node on a cycle stops where it would repeat."""
    nodes = parents.select(F.col("child").alias("node")).union(parents.select("parent")).where("node is not null").distinct()
    one = parents.where("parent is not null").groupBy("child").agg(F.min("parent").alias("parent"))
    walk = cut_lineage(nodes.select("node", F.array("node").alias("path"), F.lit(False).alias("done")))
    while True:
        step = walk.join(one, F.get("path", F.lit(0)) == F.col("child"), "left")
        stop = F.col("done") | F.col("parent").isNull() | F.array_contains("path", F.col("parent"))
        walk = cut_lineage(step.select("node", F.when(stop, F.col("path")).otherwise(F.concat(F.array("parent"), "path")).alias("path"), stop.alias("done")))
        if walk.where(~F.col("done")).limit(1).count() == 0:
            break
    return walk.select("node", "path")


def ancestors(roots: DataFrame, depth: int) -> DataFrame:
    """Up to `depth` ancestors of each node, nearest first."""
    up = F.slice(F.reverse("path"), 2, depth)
    return roots.select("node", F.posexplode(up).alias("distance", "ancestor")).withColumn("distance", F.col("distance") + 1)


def model_delta(current: DataFrame, following: DataFrame) -> DataFrame:
    """Predictors added to and dropped from a profile's model."""
    on = ["profile_id", "predictor"]
    a, b = current.select(*on).distinct(), following.select(*on).distinct()
    return b.join(a, on, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, on, "left_anti").withColumn("change", F.lit("dropped")))


def merge_candidates(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Tables (profile_id, key, score) by rising priority: best score per key, label of the last source that has it."""
    both = None
    for i, (name, df) in enumerate(sources):
        part = df.select("profile_id", "key", "score").withColumns({"source": F.lit(name), "order": F.lit(i)})
        both = part if both is None else both.unionByName(part)
    return both.groupBy("profile_id", "key").agg(F.max("score").alias("score"), F.max_by("source", "order").alias("source"), F.count_distinct("source").alias("n_sources"))


def dedupe_names(df: DataFrame, name: str, pos: str) -> DataFrame:
    """The n-th occurrence of a name (n > 1) gets the suffix ' (n)'."""
    numbered = number_rows(df, [name], pos, "_i")
    return numbered.withColumn("unique_name", F.when(F.col("_i") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), F.col("_i") + 1, F.lit(")")))).drop("_i")


def distinct_ordered(df: DataFrame, text: str, pos: str) -> DataFrame:
    """First row per case-folded, space-collapsed text."""
    key = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    first = df.withColumn("_k", key).groupBy("_k").agg(F.min_by(F.struct(*df.columns), pos).alias("r"))
    return first.select("r.*")


def merge_hierarchies(sources: list[DataFrame]) -> DataFrame:
    """Union of leaf paths (path array, value); the later source wins at a leaf, and a leaf gives way when it is an
    inner node of another path."""
    both = None
    for i, df in enumerate(sources):
        part = df.select(F.array_join("path", " / ").alias("node"), "path", "value").withColumn("src", F.lit(i))
        both = part if both is None else both.unionByName(part)
    best = both.groupBy("node").agg(F.max_by(F.struct("path", "value", "src"), "src").alias("r")).select("node", "r.*")
    inner = prefixes(best.select("path")).where(F.col("depth") < F.col("leaf_depth")).select("node").distinct()
    return best.join(inner, "node", "left_anti").select("node", "value", "src")


def allowed_paths(sources: list[DataFrame]) -> DataFrame:
    from lagweave.functions.paths import normalize_path

    out = None
    for df in sources:
        part = df.select(normalize_path(F.col("path")).alias("path"))
        out = part if out is None else out.union(part)
    return out.where("path != ''").distinct()


def stage_report(stages: dict[str, DataFrame]) -> DataFrame:
    """Stage tables by profile joined side by side, with the share of stages each profile has reached."""
    out = None
    for name, df in stages.items():
        part = df.withColumn(f"has_{name}", F.lit(1))
        out = part if out is None else out.join(part, "profile_id", "full_outer")
    flags = [f"has_{n}" for n in stages]
    return out.fillna(0, flags).withColumn("completeness", sum(F.col(f) for f in flags) / len(flags))


def cycle_progression(counts: DataFrame) -> DataFrame:
    """counts(profile_id, cycle, n_targets, n_predictors, n_barriers): each cycle with its number, the cycles skipped since
    the one before, what its targets added, predictors so far and the profile's number of cycles. A profile's cycles are
    a short ordered list."""
    w = W.partitionBy("profile_id").orderBy("cycle")
    before = F.lag("cycle").over(w)
    return counts.select(
        "profile_id", "cycle", F.row_number().over(w).alias("cycle_number"), F.coalesce(F.col("cycle") - before - 1, F.lit(0)).alias("n_skipped"),
        "n_targets", "n_predictors", "n_barriers", (F.col("n_targets") - F.coalesce(F.lag("n_targets").over(w), F.lit(0))).alias("new_targets"),
        F.sum("n_predictors").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("predictors_so_far"), F.count(F.lit(1)).over(W.partitionBy("profile_id")).alias("n_cycles"))


def evidence_bundle(importance: DataFrame, dependence: DataFrame, relevance: DataFrame, k: int = 12, r: int = 30) -> DataFrame:
    """Best rows of each evidence table per profile as nested arrays (bounded by k and r)."""
    def top(df: DataFrame, item: str, value: str, n: int, name: str) -> DataFrame:
        kept = top_n(df, ["profile_id"], [F.desc(value), F.col(item)], n)
        return kept.groupBy("profile_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(item).alias("item"), F.col(value).alias("value")))), lambda s: F.struct(s["item"].alias("item"), s["value"].alias("value"))).alias(name))

    return top(importance, "item", "value", k, "importance").join(top(dependence, "item", "value", k, "dependence"), "profile_id", "full_outer").join(top(relevance, "item", "value", r, "relevance"), "profile_id", "full_outer")
