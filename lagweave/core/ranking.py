"""Exact ranks and quantiles that never put an unbounded group into one task.

Equal values are counted first, so ties collapse before the shuffle. For groups without a size bound the
distinct values are split into bins at approximate quantiles; a running total over the (few) bins gives each
bin its offset, and only the inside of a bin is sorted by one task. The result is exact for any split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lagweave.core.session import cut_lineage

BINS = 256


def value_positions(df: DataFrame, keys: list[str], value: str, bounded: bool = False, bins: int = BINS) -> DataFrame:
    """One row per (keys, value): n_at equal values, n_below smaller ones, n_total in the group."""
    freq = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_at"))
    if bounded:
        run = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
        return freq.select(
            *keys, value, "n_at",
            (F.sum("n_at").over(run) - F.col("n_at")).alias("n_below"),
            F.sum("n_at").over(W.partitionBy(*keys)).alias("n_total"),
        )
    freq = freq.withColumn("_all", F.lit(0))
    on = ["_all", *keys]
    probs = [i / bins for i in range(1, bins)]
    cuts = freq.groupBy(*on).agg(F.percentile_approx(value, probs, 20 * bins).alias("_cuts"))
    binned = freq.join(cuts, on).withColumn(
        "_bin", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = binned.groupBy(*on, "_bin").agg(F.sum("n_at").alias("_n"))
    run = W.partitionBy(*on).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    offsets = totals.select(
        *on, "_bin",
        (F.sum("_n").over(run) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(W.partitionBy(*on)).alias("n_total"),
    )
    inside = W.partitionBy(*on, "_bin").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return (
        binned.join(offsets, [*on, "_bin"])
        .withColumn("n_below", F.col("_offset") + F.sum("n_at").over(inside) - F.col("n_at"))
        .select(*keys, value, "n_at", "n_below", "n_total")
    )


def _at_rank(value: str, rank: Column) -> Column:
    return F.max(F.when((F.col("n_below") <= rank) & (rank < F.col("n_below") + F.col("n_at")), F.col(value)))


def running_total(df: DataFrame, order: str, amount: str, rows_per_range: int = 50_000) -> DataFrame:
    """`n_below`: total of `amount` over all rows with a smaller `order` (unique, sortable). Rows are dealt to ranges;
    one window runs over the few range totals and one inside each range."""
    n = max(1, df.count() // rows_per_range)
    ranged = cut_lineage(df.repartitionByRange(n, order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum(amount).alias("_t"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shift = totals.select("_range", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_shift"))
    inside = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return ranged.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(shift, "_range").withColumn(
        "n_below", F.col("_in") + F.col("_shift")).drop("_range", "_in", "_shift")


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], bounded: bool = False) -> DataFrame:
    """Linear-interpolated quantiles per key, named by `probs`. `bounded` groups use the built-in aggregate."""
    if bounded:
        return df.groupBy(*keys).agg(*[F.percentile(value, q).alias(n) for n, q in probs.items()])
    return quantiles_at(value_positions(df, keys, value), keys, value, probs)


def quantiles_at(pos: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    aggs = []
    for name, q in probs.items():
        at = F.lit(q) * (F.col("n_total") - 1)
        lo, hi = _at_rank(value, F.floor(at)), _at_rank(value, F.ceil(at))
        aggs.append((lo + (hi - lo) * F.max(at - F.floor(at))).alias(name))
    return pos.groupBy(*keys).agg(*aggs)


def mid_ranks(df: DataFrame, keys: list[str], value: str, bounded: bool = False) -> DataFrame:
    """One row per (keys, value) with its average rank (ties share it) and tie count."""
    return value_positions(df, keys, value, bounded).withColumn(
        "mid_rank", F.col("n_below") + (F.col("n_at") + 1) / 2)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """Best n rows per key. Catalyst limits each map task to n rows per key before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def number_rows(df: DataFrame, keys: list[str], order: str, name: str = "pos", chunk: int = 100_000, ties: list[str] | None = None) -> DataFrame:
    """0-based position of each row in its group by a non-negative integer column, without sorting a group whole:
    rows are numbered inside chunks of the order column and shifted by the rows in earlier chunks."""
    df = df.withColumns({"_all": F.lit(0), "_chunk": F.floor(F.col(order) / chunk)})
    on = ["_all", *keys]
    sizes = df.groupBy(*on, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*on).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select(*on, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = W.partitionBy(*on, "_chunk").orderBy(order, *(ties or []))
    return df.withColumn("_rn", F.row_number().over(inside)).join(shift, [*on, "_chunk"]).withColumn(
        name, F.col("_rn") - 1 + F.col("_shift")).drop("_all", "_chunk", "_rn", "_shift")
