"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item gives windows of `n` consecutive words (a shorter item gives one window of all its words). A window
is a set of shingles of up to three words. Shingles are ordered by rarity, counted over all documents. A document that
holds a window must hold its rarest shingle, so that one token is the window's join prefix.

Windows, shingle counts and prefixes are tables made by tasks; equal texts of the benchmark are one text, whose item ids
are joined back at the end. Documents are passed twice, once to count the benchmark's shingles and once to find prefix
tokens; a bitmap of fixed size thins what leaves a task, and equi-joins decide. A document's match travels with the words
around it, so the join can check the bounds (the window's place, given by the token's offset, must lie inside the
document) and compare all words of the window. Matches are kept by the digest of their text, so copies of a document
are one match.

Null documents have no words and are clean; null items have no windows; an item without id is listed as "". Repeated
documents and items are ordinary. All input columns are kept; `n_words`, `spans`, `items` are renamed with leading
underscores where they would clash. An empty benchmark leaves everything clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagweave.core.session import cut_lineage
from lagweave.llm import kernels as K
from lagweave.llm import sketches
from lagweave.llm.common import scratch

WINDOW, SHINGLE = 10, 3
BITMAP = 1 << 23
# Documents with matches up to which the matches go to the documents as a broadcast.
BROADCAST_TEXTS = 100_000


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = K.LOWER[data]
    starts, ends, bounds = K.word_bounds(low, offsets, K.ALPHANUMERIC)
    return low, starts, ends, bounds, K.word_hashes(low, starts, ends)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on, across texts."""
    full = max(len(words) - n + 1, 0)
    total = np.zeros(full, np.uint64)
    for j in range(n):
        total += words[j:j + full] * np.uint64(K.STEPS[j % 5] + 2 * (j // 5))
    return K.mixed(total)


def _joined(low: bytes, starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> str:
    return b" ".join(low[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())).decode()


def window_maker(n: int, q: int) -> Callable:
    """Task function over (text_id, text): the distinct windows of each text with their shingles' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in K.text_slices(batch, "text"):
                low, starts, ends, bounds, h = _words(data, offsets)
                low, out = low.tobytes(), []
                for i, name in enumerate(rows.column(0).to_pylist()):
                    a, b = int(bounds[i]), int(bounds[i + 1])
                    m, seen = min(n, b - a), set()
                    for s in range(a, b - m + 1) if m else ():
                        words = _joined(low, starts, ends, s, s + m)
                        if words not in seen:
                            seen.add(words)
                            out.append((name, words, m, min(q, m), run_hashes(h[s:s + m], min(q, m)).view(np.int64).tolist()))
                columns = zip(*out) if out else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())))],
                    names=["text_id", "window", "m", "size", "shingles"])

    return run


def _bits(tokens: np.ndarray) -> np.ndarray:
    return K.mixed(tokens).astype(np.int64) & (BITMAP - 1)


def token_marker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over (token): bitmap of the tokens."""
    bits = np.zeros(BITMAP, bool)
    for b in batches:
        bits[_bits(b.column(0).to_numpy().view(np.uint64))] = True
    yield sketches.send(np.packbits(bits), TaskContext.get().partitionId())


def _bitmap(tokens: DataFrame) -> np.ndarray:
    return sketches.gather(tokens.mapInArrow(token_marker, sketches.SCHEMA), BITMAP // 8, "uint8", np.bitwise_or)


def counter(bitmap: np.ndarray, sizes: list[int]) -> Callable:
    """Task function over (text): how often each shingle that the bitmap has stands in the task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(bitmap).astype(bool)
        for batch in batches:
            for _, data, offsets in K.text_slices(batch, "text"):
                h = _words(data, offsets)[4]
                found = [g[bits[_bits(g)]] for g in (run_hashes(h, m) for m in sizes)]
                token, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])
        K.release_memory()

    return run


def finder(bitmap: np.ndarray, sizes: list[int], n: int) -> Callable:
    """Task function over (text): the places of tokens that the bitmap has, each with up to n - 1 words before it and n
    words from it on. A text that the task has met before is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(bitmap).astype(bool)
        met: set[bytes] = set()
        for batch in batches:
            for _, data, offsets in K.text_slices(batch, "text"):
                low, starts, ends, bounds, h = _words(data, offsets)
                raw, out = low.tobytes(), []
                keys: dict[int, bytes | None] = {}
                for m in sizes:
                    g = run_hashes(h, m)
                    near = np.flatnonzero(bits[_bits(g)])
                    doc = np.searchsorted(bounds, near, "right") - 1
                    inside = near + m <= bounds[doc + 1]
                    for at, d, token in zip(near[inside].tolist(), doc[inside].tolist(), g[near[inside]].view(np.int64).tolist()):
                        if d not in keys:
                            key = hashlib.md5(data[offsets[d]:offsets[d + 1]].tobytes(), usedforsecurity=False).digest()
                            keys[d] = None if key in met else key
                            met.add(key)
                        if keys[d] is not None:
                            a, b = max(int(bounds[d]), at - n + 1), min(int(bounds[d + 1]), at + n)
                            out.append((keys[d], token, at - int(bounds[d]), at - a, _joined(raw, starts, ends, a, b)))
                columns = zip(*out) if out else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.string()))],
                    names=["key", "token", "at", "left", "context"])
        K.release_memory()

    return run


def word_counter(text: str) -> Callable:
    """Task function: adds the number of words as a last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in K.text_slices(batch, text):
                n = np.diff(K.word_bounds(K.LOWER[data], offsets, K.ALPHANUMERIC)[2])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(n, pa.int64())], names=[*rows.schema.names, "words"])
        K.release_memory()

    return run


def _merged(spans: Column) -> Column:
    """Maximal runs of sorted (start, end) structs."""
    last = lambda acc: F.element_at(acc, -1)
    grown = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))))
    return F.aggregate(spans, F.slice(spans, 1, 1), lambda acc, s: F.when(s["start"] <= last(acc)["end"], grown(acc, s)).otherwise(F.concat(acc, F.array(s))))


SPANS = "array<struct<start: bigint, end: bigint>>"


def matches(texts: DataFrame, benchmark: DataFrame, n: int = WINDOW, q: int = SHINGLE) -> DataFrame | None:
    """key (MD5 of the text), spans, items of every distinct text with a window. texts(text), benchmark(id, t). None if the
    benchmark has no window."""
    named = cut_lineage(benchmark.select(F.coalesce("id", F.lit("")).alias("id"), F.sha2("t", 256).alias("text_id"), "t").distinct())
    bodies = named.groupBy("text_id").agg(F.first("t").alias("text"))
    made = cut_lineage(bodies.mapInArrow(window_maker(n, q), "text_id string, window string, m int, size int, shingles array<long>"))
    sizes = sorted(r["size"] for r in made.select("size").distinct().collect())
    if not sizes:
        return None
    windows = made.groupBy("window").agg(F.first("m").alias("m"), F.first("shingles").alias("shingles"))
    each = cut_lineage(windows.select("window", "m", F.posexplode("shingles").alias("offset", "token")))
    rows = texts.select(F.col("text").cast("string").alias("text")).where("text is not null")
    counted = rows.mapInArrow(counter(_bitmap(each.select("token")), sizes), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    ranked = each.join(counted, "token", "left").groupBy("window", "m").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("r"))
    # A window whose rarest shingle stands nowhere cannot occur.
    prefixes = cut_lineage(ranked.where("r.n > 0").select("window", "m", "r.token", "r.offset"))
    found = rows.mapInArrow(finder(_bitmap(prefixes.select("token")), sizes, n), "key binary, token long, at long, left int, context string")
    words = F.slice(F.split("context", " "), F.col("left") - F.col("offset") + 1, F.col("m"))
    hits = found.join(prefixes, "token").where(F.col("left") >= F.col("offset")).where(F.array_join(words, " ") == F.col("window")).select(
        "key", (F.col("at") - F.col("offset")).alias("start"), (F.col("at") - F.col("offset") + F.col("m")).cast("long").alias("end"), "window")
    hits = cut_lineage(hits.distinct())
    spans = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s")).select("key", _merged(F.col("s")).alias("spans"))
    items = hits.select("key", "window").distinct().join(made.select("window", "text_id"), "window").select("key", "text_id").distinct().join(
        named.select("text_id", "id"), "text_id").groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("items"))
    return cut_lineage(spans.join(items, "key"))


def added_names(docs: DataFrame) -> list[str]:
    """Names of the three columns that `find_contamination` adds to these documents."""
    return scratch(docs, "n_words", "spans", "items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                       n: int = WINDOW, q: int = SHINGLE, few: int = BROADCAST_TEXTS) -> DataFrame:
    """All rows and columns of `docs` with n_words, spans (hit words, end exclusive, merged) and items (sorted ids)."""
    n_words, spans, items = added_names(docs)
    key, found_key = scratch(docs, "_key", "_found")
    bench = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("t")).where("t is not null")
    hit = matches(docs.select(F.col(text).alias("text")), bench, n, q)
    counted = docs.mapInArrow(word_counter(text), T.StructType([*docs.schema.fields, T.StructField(n_words, T.LongType())]))
    none = {spans: F.from_json(F.lit("[]"), SPANS), items: F.array().cast("array<string>")}
    if hit is None:
        return counted.withColumns(none)
    hit = hit.select(F.col("key").alias(found_key), F.col("spans").alias(spans), F.col("items").alias(items))
    keyed = counted.withColumn(key, F.unhex(F.md5(F.col(text).cast("binary"))))
    met = keyed.join(F.broadcast(hit) if hit.count() <= few else hit, F.col(key) == F.col(found_key), "left")
    return met.select(*docs.columns, n_words, *[F.coalesce(c, v).alias(c) for c, v in none.items()])


def contamination_report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, **how)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "items")
