"""Merkle manifest of a dataset as a store of content-addressed records, and proofs by descent from the root.

A leaf is the digest of one row's fields. Leaves of a group are ordered by their key; runs of `fanout` consecutive nodes
have the digest of their digests as parent, level by level, until a group has one node, its subroot. The subroots, in
order of their groups, form a tree of the same kind up to the root. Each inner node is kept as a record digest ->
children, and equal nodes share one record.

A proof is found by descent: a leaf's rank in its group, written in base `fanout` with as many digits as the tree has
levels, tells which child to take at each record from the root on (first the digits of its group, then its own). All
requests descend together: a level holds one row for each node that any request passes, joined to its record by digest,
so no join has more rows than there are nodes. The unselected children are collected as path segments from the root
down; read backwards they are the proof from the leaf up. The last step hands each request its segment without moving
the leaves' paths: requests are gathered under their parent node, which has at most `fanout` leaves.

Ranks are exact and never sort a group in one task: rows are dealt to ranges of (group, key, leaf) and numbered inside,
and a running total over the few ranges of a group is added.

A null group comes first, then groups in the order of their UTF-8 bytes; null keys come first in their group; rows of
one key are ordered by their leaf digest, so repeated rows are leaves of their own. Null fields are written as `-`.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lagweave.core.session import cut_lineage

FANOUT = 8
ROWS_PER_RANGE = 50_000


def field(value: Column) -> Column:
    """A value as text: `-` if null, else its UTF-8 length, a colon and the value."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def ranked(df: DataFrame, group: str, key: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds idx, the 0-based rank in its group by `key` (nulls first, rows of equal keys in any order), and n, the
    group's rows. `df` is read twice."""
    ranges = max(1, -(-df.count() // rows_per_range))
    dealt = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(ranges, group, *key, "_row").withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    by_group = W.partitionBy(group)
    shift = sums.select(
        F.col(group).alias("_g"), F.col("_range").alias("_r"), F.sum("_n").over(by_group).alias("n"),
        F.coalesce(F.sum("_n").over(by_group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    inside = W.partitionBy(group, "_range").orderBy(*key, "_row")
    numbered = dealt.withColumn("_i", F.row_number().over(inside))
    return numbered.join(shift, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r"))).withColumn(
        "idx", F.col("_i") - 1 + F.col("_shift")).select(*df.columns, "idx", "n")


@dataclass
class Tree:
    """records: digest, children. tops: group, digest, height, n. `height` is the number of levels above the leaves."""

    records: DataFrame
    tops: DataFrame


def _height(n: Column, fanout: int) -> Column:
    """Levels above n leaves, in whole numbers: the first power of the fanout that is n or more."""
    powers = []
    size, level = 1, 0
    while size < 1 << 62:
        powers.append((size, level))
        size, level = size * fanout, level + 1
    return F.coalesce(*[F.when(n <= F.lit(s), F.lit(k)) for s, k in powers])


def build(nodes: DataFrame, fanout: int = FANOUT) -> Tree:
    """The tree over rows (group, idx, n, digest); every level is a table a `fanout`-th of the one below."""
    schema = "digest string, children array<string>"
    records = [nodes.sparkSession.createDataFrame([], schema)]
    tops = []
    level = nodes.select("group", "idx", "n", "digest", F.col("n").alias("left"))
    while True:
        tops.append(level.where("left = 1").select("group", "digest", "n"))
        rest = level.where("left > 1")
        above = rest.groupBy("group", F.expr(f"idx div {fanout}").alias("idx")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"]).alias("children"),
            F.first("n").alias("n"), F.expr(f"(first(left) + {fanout - 1}) div {fanout}").alias("left"))
        above = cut_lineage(above.withColumn("digest", digest(F.array_join("children", ""))))
        if not above.limit(1).count():
            break
        records.append(above.select("digest", "children"))
        level = above.select("group", "idx", "n", "digest", "left")
    made = reduce(DataFrame.union, records).groupBy("digest").agg(F.first("children").alias("children"))
    return Tree(cut_lineage(made), cut_lineage(reduce(DataFrame.union, tops).withColumn("height", _height(F.col("n"), fanout))))


def _step(children: Column, digit: Column) -> Column:
    """A path segment: the unselected children before and after the selected one."""
    return F.struct(F.slice(children, 1, digit).alias("before"), F.slice(children, digit + 2, F.greatest(F.size(children) - digit - 1, F.lit(0))).alias("after"))


SEGMENTS = "array<struct<before: array<string>, after: array<string>>>"


def descend(frontier: DataFrame, wanted: DataFrame, records: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Paths of all wanted nodes (group, idx, height). `frontier` has one row for each group: group, digest (its top),
    height, segments so far. A step joins the frontier to its records by digest and goes on with the children that a
    wanted node lies below. Returns group, idx, top, digest, segments: one row for each distinct wanted (group, idx)."""
    goals = cut_lineage(wanted.select("group", "idx", "height").distinct())
    tallest = goals.agg(F.max("height")).first()[0] or 0
    at = frontier.select("group", F.lit(0).cast("long").alias("idx"), "height", F.col("digest").alias("top"), "digest", "segments")
    done = [at.where("height = 0").drop("height")]
    at = at.where("height > 0")
    for left in range(tallest - 1, -1, -1):
        # Nodes wait until the level of their own tree is reached.
        now, later = at.where(F.col("height") == left + 1), at.where(F.col("height") < left + 1)
        met = now.join(records, "digest").select(
            "group", "idx", "top", "segments", F.col("children").alias("kin"), F.posexplode("children").alias("pos", "digest"))
        below = met.select(
            "group", (F.col("idx") * fanout + F.col("pos")).alias("idx"), F.lit(left).alias("height"), "top", "digest",
            F.concat("segments", F.array(_step(F.col("kin"), F.col("pos")))).alias("segments"))
        asked = goals.where(F.col("height") > left).select("group", F.expr(f"idx div {fanout ** left}").alias("idx")).distinct()
        below = below.join(asked.select(F.col("group").alias("_g"), F.col("idx").alias("_i")), F.col("group").eqNullSafe(F.col("_g")) & (F.col("idx") == F.col("_i")), "left_semi")
        if left == 0:
            done.append(below.drop("height"))
        else:
            at = cut_lineage(below.unionByName(later))
    return reduce(DataFrame.union, done)


def fold(leaf: Column, segments: Column) -> Column:
    """The root from a leaf and its path, which is given from the root down."""
    return F.aggregate(F.reverse(segments), leaf, lambda h, s: F.sha2(F.concat(F.array_join(s["before"], ""), h, F.array_join(s["after"], "")).cast("binary"), 256))


def proof_digest(segments: Column) -> Column:
    """Digest of all siblings on a path, from the leaf up, left to right."""
    return digest(F.array_join(F.flatten(F.transform(F.reverse(segments), lambda s: F.concat(s["before"], s["after"]))), ""))


@dataclass
class Manifest:
    """leaves: the input's chosen columns, group, leaf, idx, n, height; tree over each group and one over the groups;
    groups: group, subroot, idx, n, height of its leaves; root."""

    leaves: DataFrame
    tree: Tree
    top: Tree
    groups: DataFrame
    root: str | None
    fanout: int


def manifest(rows: DataFrame, key: str, fanout: int = FANOUT) -> Manifest:
    """The manifest of rows (group, leaf, `key` and any other columns, which go along with the leaves)."""
    leaves = ranked(cut_lineage(rows), "group", [key, "leaf"])
    leaves = cut_lineage(leaves.withColumn("height", _height(F.col("n"), fanout)))
    tree = build(leaves.select("group", "idx", "n", F.col("leaf").alias("digest")), fanout)
    subroots = tree.tops.select(F.lit(0).alias("all"), F.col("group").alias("name"), F.col("digest").alias("subroot"), "height")
    order = ranked(subroots, "all", ["name"])
    groups = cut_lineage(order.select(F.col("name").alias("group"), "subroot", F.col("height").alias("leaf_height"), "idx", "n"))
    top = build(groups.select(F.lit(0).alias("group"), "idx", "n", F.col("subroot").alias("digest")), fanout)
    found = top.tops.first()
    return Manifest(leaves, tree, top, groups, found and found["digest"], fanout)


def proofs(m: Manifest, requests: DataFrame) -> DataFrame:
    """`requests` are rows of the manifest's leaves (all or some, with all their columns). Adds subroot, segments (root
    down, those above the subroot included) and on_path: the leaf digest that the descent ended at."""
    if m.root is None:
        return requests.withColumns({"subroot": F.lit(None).cast("string"), "segments": F.lit(None).cast(SEGMENTS), "on_path": F.lit(None).cast("string")})
    width = m.fanout
    asked = requests.select(F.col("group").alias("_g")).distinct()
    wanted = m.groups.join(asked, F.col("group").eqNullSafe(F.col("_g")), "left_semi")
    start = m.top.tops.select(F.lit(0).alias("group"), "digest", "height", F.from_json(F.lit("[]"), SEGMENTS).alias("segments"))
    over = descend(start, wanted.select(F.lit(0).alias("group"), "idx", _height(F.col("n"), width).alias("height")), m.top.records, width)
    tops = over.select(F.col("idx").alias("_i"), "digest", "segments").join(wanted, F.col("idx") == F.col("_i")).select(
        "group", F.col("subroot").alias("digest"), F.col("leaf_height").alias("height"), "segments")
    tops = cut_lineage(tops)
    # The descent stops at the leaves' parents; requests wait there, at most `fanout` for each node.
    rows = requests.select("group", F.col("idx").alias("leaf_idx"), "height", F.struct(*requests.columns).alias("row"))
    alone = rows.where("height = 0").join(tops.select(F.col("group").alias("_g"), "digest", "segments"), F.col("group").eqNullSafe(F.col("_g"))).select(
        "row.*", F.col("digest").alias("subroot"), "segments", F.col("digest").alias("on_path"))
    deep = rows.where("height > 0").withColumn("up", F.expr(f"leaf_idx div {width}"))
    taller = tops.where("height > 0")
    parents = descend(taller.withColumn("height", F.col("height") - 1), deep.select("group", F.col("up").alias("idx"), (F.col("height") - 1).alias("height")), m.tree.records, width)
    waiting = deep.groupBy("group", "up").agg(F.collect_list("row").alias("rows"))
    found = parents.join(m.tree.records, "digest").select(F.col("group").alias("_g"), "idx", F.col("top").alias("subroot"), "children", "segments").join(
        waiting, F.col("_g").eqNullSafe(F.col("group")) & (F.col("idx") == F.col("up"))).select("subroot", "children", "segments", F.explode("rows").alias("row"))
    digit = F.expr(f"cast(row.idx % {width} as int)")
    return alone.unionByName(found.select(
        "row.*", "subroot", F.concat("segments", F.array(_step(F.col("children"), digit))).alias("segments"),
        F.element_at("children", digit + 1).alias("on_path")))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def verification_report(docs: DataFrame, tamper: Column, tampered_text: Column, fields: tuple[str, ...] = FIELDS, key: str = "doc_id",
                        group: str = "lang", text: str = "text", fanout: int = FANOUT) -> DataFrame:
    """Per row: key, leaf, subroot, root, proof_sha256 of the untampered data, folded_root (from the tampered leaf where
    `tamper` holds) and verified."""
    own = digest(*[field(F.col(c)) for c in fields])
    changed = digest(*[field(tampered_text if c == text else F.col(c)) for c in fields])
    rows = docs.select(F.col(key).alias("key"), F.col(group).cast("string").alias("group"), own.alias("leaf"), F.when(tamper, changed).alias("changed"))
    m = manifest(rows, "key", fanout)
    found = proofs(m, m.leaves)
    out = found.select(
        F.col("key").alias(key), F.col("on_path").alias("leaf"), "subroot", F.lit(m.root).cast("string").alias("root"), proof_digest(F.col("segments")).alias("proof_sha256"),
        fold(F.coalesce("changed", "leaf"), F.col("segments")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
