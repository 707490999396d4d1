"""Exact top-k lexical search of many stated items against all documents, by presence masks.

Items with equal texts are one query. Queries are taken in blocks of bounded size, chosen by a hash of their text; for a
block, one pass over the documents leaves a row per document with its length and the counts of the block's terms, and
the corpus statistics come from all of these rows. A second pass ranks.

Each task of the second pass holds a batch of documents as bitmaps, one for each term. For an item, the bitmaps of its
terms side by side are the documents' presence masks; documents with the same mask form a group. No document of a group
can score more than the sum, over the mask's terms, of the term's weight times its best tf part in the batch. Groups
are evaluated by descending bound, and a batch is finished for an item as soon as k documents are known (from this
batch or an earlier one of the task) that score more than the next bound. Ties go to the smaller id, so a bound equal to
the k-th score is still evaluated. A task sends k rows for each item at most; the k best of these are exact.

Terms are compared as strings (Arrow's index_in), never by hash alone. Null texts have no terms. A null id is the
largest, items without any known term have no rows, repeated documents are ranked each, repeated items (equal id and
text) are one. Items of one id with different texts are ranked apart and both given. An empty table on either side gives
an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.core.ranking import top_n
from lagweave.core.session import cut_lineage
from lagweave.llm import kernels as K

TOP = 20
BLOCK_BYTES = 1 << 20
BATCH_DOCS, BATCH_BITS = 16_384, 1 << 26
GROUPS_AT_ONCE = 256
# Fixed values of the score: a weight's scale, a tf part's scale, k1 and b in hundredths.
WEIGHT_SCALE, TF_SCALE, K1, B = 1000, 1_000_000_000, 12, 25


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All terms of all texts as one Arrow array, and n + 1 offsets by text."""
    low = K.LOWER[data]
    starts, ends, bounds = K.word_bounds(low, offsets, K.ALPHANUMERIC)
    body = low[K.ALPHANUMERIC[low]]
    edges = np.concatenate(([0], np.cumsum(ends - starts)))
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(body)), bounds


@dataclass
class Block:
    """A block of queries: its vocabulary, and for each query its key, terms (places in the vocabulary) and repeats."""

    keys: list[str]
    vocabulary: pa.LargeStringArray
    terms: list[np.ndarray]
    repeats: list[np.ndarray]


def make_block(rows: list[tuple[str, str]]) -> Block:
    """From (key, text) rows."""
    words, bounds = terms_of(*K.text_bytes(pa.array([t for _, t in rows], pa.large_string())))
    coded = words.dictionary_encode()
    at = coded.indices.to_numpy()
    terms, repeats = [], []
    for a, b in zip(bounds[:-1], bounds[1:]):
        t, n = np.unique(at[a:b], return_counts=True)
        terms.append(t.astype(np.int64))
        repeats.append(n.astype(np.int64))
    return Block([k for k, _ in rows], coded.dictionary, terms, repeats)


def term_counter(vocabulary: pa.LargeStringArray) -> Callable:
    """Task function over (doc_id, text): n, terms and their counts for every document that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in K.text_slices(batch, "text"):
                words, bounds = terms_of(data, offsets)
                found = pc.index_in(words, value_set=vocabulary)
                hit = found.is_valid().to_numpy(zero_copy_only=False)
                key = K.rows_of(bounds)[hit] * len(vocabulary) + found.drop_null().to_numpy().astype(np.int64)
                key, tf = np.unique(key, return_counts=True)
                ends = np.searchsorted(key, np.arange(len(bounds)) * max(len(vocabulary), 1))
                n = np.diff(bounds)
                out = pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(n), K.lists((key % max(len(vocabulary), 1)).astype(np.int32), ends, pa.int32()), K.lists(tf.astype(np.int32), ends, pa.int32())],
                    names=["doc_id", "n", "terms", "tf"])
                yield out.filter(pa.array(n > 0))

    return run


def weights_of(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Best:
    """The k best documents so far of one item: by score, then by id."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids = np.zeros(0, np.int64), pa.array([], pa.null())

    def bar(self) -> int:
        """A document must score at least this to count; scores of 0 never do."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        keep = scores >= self.bar()
        if not keep.any():
            return
        ids = ids.filter(pa.array(keep))
        scores = scores[keep]
        if len(self.scores):
            scores, ids = np.concatenate((self.scores, scores)), pa.concat_arrays([self.ids, ids])
        order = pc.sort_indices(pa.table({"s": pa.array(scores), "i": ids}), [("s", "descending"), ("i", "ascending")], null_placement="at_end")[:self.k]
        self.scores, self.ids = scores[order.to_numpy()], ids.take(order)


def presence(rows: np.ndarray, terms: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """One bitmap over the batch's documents for each term."""
    bits = np.zeros((n_terms, -(-n_docs // 8)), np.uint8)
    np.bitwise_or.at(bits, (terms, rows >> 3), (1 << (rows & 7)).astype(np.uint8))
    return bits


def rank_batch(best: list[Best], block: Block, weights: np.ndarray, ids: pa.Array, bounds: np.ndarray, terms: np.ndarray, part: np.ndarray) -> tuple[int, int]:
    """Adds a batch's documents to the items' best. `part`: the tf part of each posting, `terms` its term; `bounds`: the
    postings of each document. Returns how many (item, document) pairs with a common term there were and how many of
    them were evaluated."""
    n = len(ids)
    rows = K.rows_of(bounds)
    by_term = np.lexsort((rows, terms))
    t_rows, t_part = rows[by_term], part[by_term]
    t_ends = np.searchsorted(terms[by_term], np.arange(len(weights) + 1))
    bits = presence(rows, terms, n, len(weights))
    top = np.zeros(len(weights), np.int64)
    np.maximum.at(top, terms, part)
    pairs = evaluated = 0
    for found, own, repeats in zip(best, block.terms, block.repeats):
        here = own[(t_ends[own + 1] > t_ends[own]) & (weights[own] > 0)]
        if not len(here):
            continue
        gain = weights[here] * repeats[np.searchsorted(own, here)]
        any_term = np.bitwise_or.reduce(bits[here], axis=0)
        docs = np.flatnonzero(np.unpackbits(any_term, bitorder="little")[:n])
        pairs += len(docs)
        # Presence masks of these documents, as rows of bytes; equal masks form a group.
        masks = np.packbits(np.stack([np.unpackbits(b, bitorder="little")[docs] for b in bits[here]], 1), axis=1, bitorder="little")
        keys = np.ascontiguousarray(masks).view(f"V{masks.shape[1]}").ravel()
        order = np.argsort(keys, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = keys[order][1:] != keys[order][:-1]
        at = np.flatnonzero(first)
        ends = np.append(at[1:], len(order))
        group_bits = np.unpackbits(masks[order[at]], axis=1, bitorder="little")[:, :len(here)].astype(np.int64)
        bound = group_bits @ (gain * top[here])
        turn = np.argsort(-bound, kind="stable")
        a, step = 0, 1
        while a < len(turn):
            now = turn[a:a + step]
            a, step = a + step, min(2 * step, GROUPS_AT_ONCE)
            now = now[bound[now] >= found.bar()]
            if not len(now):
                break
            size = ends[now] - at[now]
            members = order[np.arange(size.sum()) + np.repeat(at[now] - (np.cumsum(size) - size), size)]
            members = np.sort(docs[members])
            evaluated += len(members)
            scores = np.zeros(len(members), np.int64)
            for g, t in zip(gain.tolist(), here.tolist()):
                x = t_rows[t_ends[t]:t_ends[t + 1]]
                place = np.searchsorted(members, x)
                place[place == len(members)] = 0
                same = members[place] == x
                scores[place[same]] += g * t_part[t_ends[t]:t_ends[t + 1]][same]
            found.add(scores, ids.take(pa.array(members)))
    return pairs, evaluated


def ranker(block: Block, df: np.ndarray, n_docs: int, n_terms: int, k: int) -> Callable:
    """Task function over (doc_id, n, terms, tf): the k best documents of this task for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = weights_of(df, n_docs)
        best = [Best(k) for _ in block.keys]
        size = max(64, min(BATCH_DOCS, BATCH_BITS // max([1, *map(len, block.terms)])))
        pairs = evaluated = 0
        for whole in batches:
            for start in range(0, len(whole), size):
                b = whole.slice(start, size)
                bounds = b.column(2).offsets.to_numpy().astype(np.int64)
                terms = b.column(2).flatten().to_numpy().astype(np.int64)
                bounds = bounds - bounds[0]
                tf = b.column(3).flatten().to_numpy().astype(np.int64)
                m = 100 - B + (B * b.column(1).to_numpy() * n_docs) // n_terms
                part = (TF_SCALE * tf) // (1000 * tf + K1 * m[K.rows_of(bounds)])
                x, y = rank_batch(best, block, weights, b.column(0), bounds, terms, part)
                pairs, evaluated = pairs + x, evaluated + y
        for i, (key, found) in enumerate(zip(block.keys, best)):
            if len(found.scores):
                yield pa.RecordBatch.from_arrays([
                    pa.array([key] * len(found.scores)), found.ids, pa.array(found.scores),
                    pa.array([pairs if i == 0 and j == 0 else 0 for j in range(len(found.scores))], pa.int64()),
                    pa.array([evaluated if i == 0 and j == 0 else 0 for j in range(len(found.scores))], pa.int64())],
                    names=["query", "doc_id", "score", "pairs", "evaluated"])

    return run


def rank_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    """query, doc_id, score: the candidates of all tasks for one block of queries."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = cut_lineage(docs.mapInArrow(term_counter(block.vocabulary), f"doc_id {kind}, n long, terms array<int>, tf array<int>"))
    total = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    df = np.zeros(len(block.vocabulary), np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    return counted.mapInArrow(ranker(block, df, total["docs"], total["terms"] or 1, k), f"query string, doc_id {kind}, score long, pairs long, evaluated long")


def search(documents: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.sha2(item_text, 256).alias("query"), F.col(item_text).alias("text")).where("text is not null")
    queries = cut_lineage(asked.groupBy("query").agg(F.first("text").alias("text")))
    sizes = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-sizes // block_bytes) or 1
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    schema = f"query string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
    ranks = documents.sparkSession.createDataFrame([], schema)
    for b in range(blocks):
        rows = [(r["query"], r["text"]) for r in dealt.where(F.col("block") == b).orderBy("query").collect()]
        if rows:
            found = top_n(rank_block(docs, make_block(rows), k), ["query"], [F.desc("score"), F.col("doc_id").asc_nulls_last()], k)
            ranks = ranks.union(cut_lineage(found.select("query", "doc_id", "score")))
    ranked = top_n(ranks, ["query"], [F.desc("score"), F.col("doc_id").asc_nulls_last()], k)
    return asked.select("item_id", "query").distinct().join(ranked, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
