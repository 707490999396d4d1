"""Importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Lower-cased words and word pairs are hashed into buckets. Bucket counts over all documents give the raw model; counts
over documents that labels call good give the target model (the labelled ids are a sample of at most `target_docs`
rows, taken by hash; that bound is a parameter). A document's log importance weight is the mean log ratio of its n-grams
times `grams`, the length at which texts are compared, so that long texts do not win by length alone. A Gumbel number
drawn from the document's id is added, and the `fraction` of rows with the largest sums is the sample: exactly a draw
without replacement in proportion to the weights. Without a fraction, it is the share of good rows among the labels.

The k-th largest sum is found by narrowing a histogram over all rows until few are left in its bin; rows that tie with
it are kept together. Documents without words (null, empty) get no weight and are never kept. Repeated rows draw the
same number. Without labels, target and raw models agree and the sample is uniform. An empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.core.session import cut_lineage
from lagweave.llm import kernels as K

BUCKETS, TARGET_DOCS, GRAMS, SMOOTHING = 1 << 15, 20_000, 100, 0.5
BINS, LAST_ROWS = 2048, 4096


def _buckets(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and word pair, with offsets by text."""
    starts, ends, bounds = K.word_bounds(data, offsets, K.SPACE_SEPARATED)
    h = K.word_hashes(data, starts, ends, lower=True)
    n = np.diff(bounds)
    grams = np.maximum(2 * n - 1, 0)
    out_bounds = np.concatenate(([0], np.cumsum(grams)))
    out = np.zeros(out_bounds[-1], np.int64)
    doc = K.rows_of(bounds)
    at = out_bounds[doc] + 2 * (np.arange(len(h)) - bounds[doc])
    low = np.uint64(buckets - 1)
    out[at] = (h & low).astype(np.int64)
    pair = np.flatnonzero(doc[:-1] == doc[1:]) if len(doc) else np.zeros(0, np.int64)
    mixed = K.mixed(h[pair] * np.uint64(K.STEPS[0]) + h[pair + 1] * np.uint64(K.STEPS[1]))
    out[at[pair] + 1] = (mixed & low).astype(np.int64)
    return out, out_bounds


def gram_counter(buckets: int) -> Callable:
    """Task function over (text, is_target): bucket counts of the target rows (1) and of all rows (0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for rows, data, offsets in K.text_slices(batch, "text"):
                b, bounds = _buckets(data, offsets, buckets)
                good = rows.column(1).to_numpy(zero_copy_only=False).astype(bool)
                total[0] += np.bincount(b, minlength=buckets)
                total[1] += np.bincount(b[np.repeat(good, np.diff(bounds))], minlength=buckets)
        kind, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(at), pa.array(total[kind, at])], names=["kind", "bucket", "n"])

    return run


def gram_scorer(weights: np.ndarray, grams: int) -> Callable:
    """Task function over (doc_id, text): number of n-grams and log weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in K.text_slices(batch, "text"):
                b, bounds = _buckets(data, offsets, len(weights))
                sums = np.concatenate(([0.0], np.cumsum(weights[b])))
                n = np.diff(bounds)
                mean = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(n), pa.array(np.where(n > 0, grams * mean, np.nan), mask=n == 0)], names=["doc_id", "n_grams", "log_weight"])

    return run


def fit(docs: DataFrame, labels: DataFrame, good: Column, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
        target_docs: int = TARGET_DOCS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log ratio of the target to the raw model for each bucket. Raw counts cover every document; the model's size is
    the number of buckets."""
    ids = labels.where(good).select(F.col(doc_id).alias("_good")).where("_good is not null").distinct().orderBy(F.xxhash64("_good"), "_good").limit(target_docs)
    marked = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("_id")).join(F.broadcast(ids), F.col("_id") == F.col("_good"), "left").select(
        "text", F.col("_good").isNotNull().alias("is_target"))
    total = np.zeros((2, buckets))
    for r in marked.mapInArrow(gram_counter(buckets), "kind int, bucket long, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).collect():
        total[r["kind"], r["bucket"]] = r["n"]
    if not total[1].any():
        return np.zeros(buckets)
    share = (total + smoothing) / (total.sum(axis=1, keepdims=True) + smoothing * buckets)
    return np.log(share[1]) - np.log(share[0])


def kth_largest(df: DataFrame, value: str, k: int) -> float:
    """The k-th largest value (not null) of a frame whose lineage is short, by narrowing a histogram."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    above = 0
    while True:
        here = df.where((F.col(value) >= low) & (F.col(value) <= high))
        step = (high - low) / BINS
        if step <= abs(high) * 1e-13:
            return low
        bins = {r["b"]: r for r in here.groupBy(F.least(F.floor((F.col(value) - low) / step), F.lit(BINS - 1)).alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()}
        for b in sorted(bins, reverse=True):
            if above + bins[b]["n"] >= k:
                break
            above += bins[b]["n"]
        low, high = bins[b]["lo"], bins[b]["hi"]
        if low == high:
            return low
        if bins[b]["n"] <= LAST_ROWS:
            rest = df.where((F.col(value) >= low) & (F.col(value) <= high)).select(value).collect()
            return sorted((r[0] for r in rest), reverse=True)[k - above - 1]


def resample(docs: DataFrame, labels: DataFrame, good: Column, fraction: float | None = None, doc_id: str = "doc_id", text: str = "text",
             grams: int = GRAMS, seed: int = 17, **model) -> DataFrame:
    """doc_id, n_grams, log_weight, sample_key, kept. `model`: buckets, target_docs, smoothing of `fit`."""
    if fraction is None:
        share = labels.agg(F.avg(F.coalesce(good, F.lit(False)).cast("int"))).first()[0]
        fraction = 1.0 if share is None else share
    weights = fit(docs, labels, good, doc_id, text, **model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(gram_scorer(weights, grams), f"doc_id {kind}, n_grams long, log_weight double")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    scored = cut_lineage(scored.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(u))))
    n = scored.where("sample_key is not null").count()
    k = math.ceil(fraction * n)
    if k <= 0:
        return scored.withColumn("kept", F.lit(False))
    return scored.withColumn("kept", F.coalesce(F.col("sample_key") >= kth_largest(scored, "sample_key", k), F.lit(False)))
