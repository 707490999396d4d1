"""Minimum-cost-flow resharding: move the fewest bytes from old shards to new ones of given capacities.

Documents are dealt to even hash blocks; Spark sums bytes (or rows) by old shard and block. The small table of old shard
sizes against new capacities is a transport problem: keeping a byte in its shard costs 0, moving it costs 1. Successive
shortest augmenting paths solve it for old x new shards, whatever the number of documents. The flow is then laid out
along the documents of each old shard (its own part first, then each transfer), in block order, through two-level
running totals, so no shard is sorted in one task. A document on a boundary goes where its middle lies; shard sizes are
off their capacity by less than the documents at their boundaries. `rewrite` rewrites the files of affected shards only.

Null texts have size 1; null ids are blocked together with the row's checksum. Equal documents may change places
freely. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 20_000


def min_cost_flow(supply: list[int], capacity: list[int]) -> list[list[int]]:
    """flow[i][j] from old shard i to new shard j; all supply is placed, moving as little as possible. A shard keeps its
    number. Successive shortest paths over the residual network of source, old shards, new shards and sink."""
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    residual: dict[tuple[int, int], int] = {}
    cost: dict[tuple[int, int], int] = {}

    def edge(a: int, b: int, room: int, price: int) -> None:
        residual[a, b], residual[b, a] = room, 0
        cost[a, b], cost[b, a] = price, -price

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, 0 if i == j else 1)
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    while True:
        far = {source: 0}
        parent: dict[int, int] = {}
        changed = True
        while changed:
            changed = False
            for (a, b), room in residual.items():
                if room > 0 and a in far and far[a] + cost[a, b] < far.get(b, 1 << 60):
                    far[b], parent[b], changed = far[a] + cost[a, b], a, True
        if sink not in far:
            break
        path, at = [], sink
        while at != source:
            path.append((parent[at], at))
            at = parent[at]
        push = min(residual[e] for e in path)
        for a, b in path:
            residual[a, b] -= push
            residual[b, a] += push
    return [[residual[n + j, i] for j in range(m)] for i in range(n)]


def even_capacities(total: int, shards: int) -> list[int]:
    return [(total * (j + 1)) // shards - (total * j) // shards for j in range(shards)]


def _offsets(df: DataFrame, keys: list[str], block: str, amount: Column, name: str) -> DataFrame:
    """Total of `amount` in the earlier blocks of the same key, for each (key, block)."""
    sums = df.groupBy(*keys, block).agg(F.sum(amount).alias("_sum"))
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    return sums.select(*keys, block, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(name))


def reshard(docs: DataFrame, old_shard: Column, shards: int, law: str = "bytes", capacities: list[int] | None = None,
            doc_id: str = "doc_id", text: str = "text", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """doc_id, size, text_crc32, old_shard (0-based), shard, slot. `law`: capacities in `bytes` or `rows`; they are even
    unless given. Given capacities must hold everything."""
    raw = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"), old_shard.cast("int").alias("old_shard"))
    weight = F.col("size") if law == "bytes" else F.lit(1).cast("long")
    by_shard = {r["old_shard"]: r for r in df.groupBy("old_shard").agg(F.sum(weight).alias("total"), F.count(F.lit(1)).alias("n")).collect()}
    old = max(by_shard, default=-1) + 1
    supply = [by_shard[i]["total"] if i in by_shard else 0 for i in range(old)]
    blocks = max(1, sum(r["n"] for r in by_shard.values()) // rows_per_block)
    flow = min_cost_flow(supply, capacities or even_capacities(sum(supply), shards))
    if sum(map(sum, flow)) < sum(supply):
        raise ValueError("the capacities are smaller than the documents")
    cuts = _cut_points(flow)
    df = df.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int"))
    before = _offsets(df, ["old_shard"], "_block", weight, "_before")
    order = W.partitionBy("old_shard", "_block").orderBy("doc_id", "text_crc32", "size")
    run = order.rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("_within", F.sum(weight).over(run)).join(before, ["old_shard", "_block"])
    middle = 2 * (F.col("_before") + F.col("_within")) - weight
    shard = F.lit(None).cast("int")
    for i, parts in enumerate(cuts):
        to = F.lit(parts[-1][1]) if parts else F.lit(0)
        for end, j in reversed(parts[:-1]):
            to = F.when(middle <= 2 * end, F.lit(j)).otherwise(to)
        shard = F.when(F.col("old_shard") == i, to).otherwise(shard)
    df = df.select("doc_id", "size", "text_crc32", "old_shard", "_block", shard.alias("shard"))
    slots = _offsets(df, ["shard"], "_block", F.lit(1), "_slot")
    number = F.row_number().over(W.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32", "old_shard"))
    return df.withColumn("_rn", number).join(slots, ["shard", "_block"]).select(
        "doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("_slot") + F.col("_rn") - 1).alias("slot"))


def _cut_points(flow: list[list[int]]) -> list[list[tuple[int, int]]]:
    """For each old shard the running ends of its parts: its own part first, then the transfers."""
    out = []
    for i, row in enumerate(flow):
        end, parts = 0, []
        for j in sorted(range(len(row)), key=lambda j: (j != i, j)):
            if row[j]:
                end += row[j]
                parts.append((end, j))
        out.append(parts)
    return out


def affected(placed: DataFrame) -> list[int]:
    """Shards whose content changes: those that lose or gain a document."""
    moved = placed.where(F.col("old_shard") != F.col("shard"))
    rows = moved.select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct().collect()
    return sorted(r["s"] for r in rows)


def rewrite(docs: DataFrame, placed: DataFrame, path: str, doc_id: str = "doc_id") -> list[int]:
    """Write the affected shards' documents as `path/shard=N`; other folders stay as they are. Document ids are unique
    here. Returns the rewritten shards (a shard that lost all its documents gets no file)."""
    shards = affected(placed)
    part = placed.where(F.col("shard").isin(shards)).select(F.col("doc_id").alias(doc_id), "shard", "slot")
    spread = docs.join(part, doc_id).repartition("shard", F.floor(F.col("slot") / ROWS_PER_BLOCK)).sortWithinPartitions("shard", "slot")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    return shards
