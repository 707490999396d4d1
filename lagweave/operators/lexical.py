"""Exact lexical top lists from an index of postings with block maxima.

Documents are put into blocks of similar content: they are ordered by their rarest term, and each run of that order is
a block. A posting carries the parts of its scores that do not depend on a query, and a table of maxima has the largest
parts of each (term, block). A query's bound for a block is the weighted sum of its terms' maxima there.

A top list takes two passes. The first scores only the blocks with the best bounds, enough of them to hold k documents;
the k-th score so far is a floor. The second scores those other blocks whose bound reaches the floor. What is left out
cannot be in the list, so it is exact; (query, document) pairs exist for scored blocks only.

Short lists of long queries, whose frequent terms reach every block, are made in cells instead: the postings of an even
part of the documents meet a part of the queries, and a cell adds up each query's scores by NumPy and gives only its k
best documents, so no pair table exists.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lagweave.core.ranking import top_n
from lagweave.core.session import cut_lineage, spread

# BM25 constants.
K1, B = 1.5, 0.75
BLOCK_BITS, DOCS_PER_RANGE = 6, 50_000
SLACK, DIGITS = 1e-6, 9
# Lists up to this length are made in cells; documents, postings and queries of a cell.
SHORT_LIST, CELL_DOCS, CELL_POSTINGS, CELL_QUERIES = 1024, 8192, 2 ** 20, 512


@dataclass
class LexicalIndex:
    """postings: term, block, vec_id, bm25, overlap; maxima: term, block, n, bm25, overlap."""

    postings: DataFrame
    maxima: DataFrame


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """vec_id, dl, ul, term, tf for the terms of the vocabulary, and a row without term for each document, so that the
    texts are split once. Rows are cut to the vocabulary before anything is shuffled."""
    # Lengths travel inside the exploded array; beside it they would be derived again for every exploded token.
    terms, n_terms = F.concat("tokens", F.array(F.lit(None).cast("string"))), F.size("tokens") + 1
    carried = F.arrays_zip(terms.alias("term"), F.array_repeat(F.size("tokens"), n_terms).alias("dl"), F.array_repeat(F.size(F.array_distinct("tokens")), n_terms).alias("ul"))
    rows = docs.select("vec_id", F.posexplode_outer(carried).alias("pos", "p")).select("vec_id", "pos", F.col("p.term").alias("term"), F.col("p.dl").alias("dl"), F.col("p.ul").alias("ul"))
    known = rows.join(vocabulary.select("term", F.lit(True).alias("known")), "term", "left").where("known or pos = dl or dl is null")
    return known.groupBy("vec_id", "dl", "ul", "term").agg(F.count(F.lit(1)).alias("tf"))


def scored_postings(docs: DataFrame, vocabulary: DataFrame, k1: float = K1, b: float = B) -> tuple[DataFrame, int, int]:
    """vec_id, term, df, bm25, overlap of docs(vec_id, tokens) for the terms of vocabulary(term), and the numbers of docs
    and of these rows."""
    every = cut_lineage(term_counts(docs, vocabulary))
    of_doc = F.when(F.col("term").isNull(), F.col("tf"))
    size = every.agg(F.sum(of_doc).alias("n"), (F.sum(of_doc * F.col("dl")) / F.sum(F.when(F.col("dl").isNotNull(), of_doc))).alias("avgdl"), F.count("term").alias("rows")).first()
    n, avgdl = size["n"] or 0, float(size["avgdl"] or 1.0)
    counts = every.where("term is not null")
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
    return counts.join(df, "term").select("vec_id", "term", "df", part.alias("bm25"), (1 / F.sqrt("ul")).alias("overlap")), n, size["rows"]


def lexical_index(docs: DataFrame, vocabulary: DataFrame, k1: float = K1, b: float = B) -> LexicalIndex:
    """The index of docs(vec_id, tokens) for the terms of vocabulary(term). `vec_id` is unique."""
    parts, n, _ = scored_postings(docs, vocabulary, k1, b)
    rarest = parts.groupBy("vec_id").agg(F.min(F.struct("df", "term"))["term"].alias("rare"))
    ranges = max(1, n // DOCS_PER_RANGE)
    # Row numbers count up from a multiple of 2^33 in each range, so no block reaches over two ranges.
    placed = rarest.repartitionByRange(ranges, "rare", "vec_id").sortWithinPartitions("rare", "vec_id").select(
        "vec_id", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block"))
    postings = cut_lineage(parts.join(cut_lineage(placed), "vec_id").select("term", "block", "vec_id", "bm25", "overlap"))
    maxima = postings.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("bm25").alias("bm25"), F.max("overlap").alias("overlap"))
    return LexicalIndex(postings, cut_lineage(maxima))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, q_len (distinct terms), term, qtf of queries(query_id, tokens)."""
    return queries.select("query_id", F.size(F.array_distinct("tokens")).alias("q_len"), F.explode("tokens").alias("term")).groupBy(
        "query_id", "q_len", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _weighted(weights_bm25: str = "w_bm25", weights_overlap: str = "w_overlap") -> Column:
    return F.sum(F.col(weights_bm25) * F.col("bm25") + F.col(weights_overlap) * F.col("overlap"))


def block_bounds(weights: DataFrame, index: LexicalIndex) -> DataFrame:
    """query_id, block, bound, n (documents that are there at least). weights(query_id, term, w_bm25, w_overlap)."""
    return weights.join(index.maxima, "term").groupBy("query_id", "block").agg(_weighted().alias("bound"), F.max("n").alias("n"))


def scored_blocks(weights: DataFrame, index: LexicalIndex, blocks: DataFrame) -> DataFrame:
    """query_id, vec_id, score of every document of the chosen blocks(query_id, block) with a term of the query."""
    asked = blocks.select("query_id", "block").join(weights, "query_id")
    return asked.join(index.postings, ["term", "block"]).groupBy("query_id", "vec_id").agg(F.round(_weighted(), DIGITS).alias("score"))


def lexical_topk(weights: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    """query_id, vec_id, score, rank: the k best documents of each query; equal scores by vec_id."""
    order = [F.desc("score"), F.col("vec_id")]
    bounds = cut_lineage(block_bounds(weights, index))
    before = W.partitionBy("query_id").orderBy(F.desc("bound"), "block").rowsBetween(W.unboundedPreceding, -1)
    # Blocks of one query are few beside its documents: one for each 2^BLOCK_BITS of them.
    ranked = bounds.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)) < k)
    head = cut_lineage(top_n(scored_blocks(weights, index, ranked.where("first")), ["query_id"], order, k))
    floor = head.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = ranked.where("not first").join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") + SLACK >= F.col("floor")))
    both = head.drop("rank").unionByName(scored_blocks(weights, index, rest))
    return top_n(both, ["query_id"], order, k)


def lexical_above(weights: DataFrame, index: LexicalIndex, floors: DataFrame) -> DataFrame:
    """query_id, vec_id, score of the documents that reach the floor of floors(query_id, floor); only blocks whose bound
    reaches it are scored. Floors of 0 or less would ask for documents without a common term; they are not given."""
    bounds = block_bounds(weights, index).join(floors, "query_id").where(F.col("bound") + SLACK >= F.col("floor"))
    return scored_blocks(weights, index, bounds).join(floors, "query_id").where(F.col("score") + SLACK >= F.col("floor")).drop("floor")


def vocabulary_of(queries: DataFrame) -> DataFrame:
    return queries.select(F.explode("tokens").alias("term")).distinct()


def bm25_weights(queries: DataFrame) -> DataFrame:
    """Repeated query terms count repeatedly."""
    return query_terms(queries).select("query_id", "term", F.col("qtf").cast("double").alias("w_bm25"), F.lit(0.0).alias("w_overlap"))


def overlap_weights(queries: DataFrame) -> DataFrame:
    return query_terms(queries).select("query_id", "term", F.lit(0.0).alias("w_bm25"), (1 / F.sqrt("q_len")).alias("w_overlap"))


def every_score(queries: DataFrame, docs: DataFrame, weights: DataFrame) -> DataFrame:
    """query_id, vec_id, score of every query and document with a common term."""
    postings, _, _ = scored_postings(docs, vocabulary_of(queries))
    return weights.join(postings, "term").groupBy("query_id", "vec_id").agg(_weighted().alias("score"))


def bm25_pairs(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, vec_id, bm25 of every pair with a common term. queries(query_id, tokens), docs(vec_id, tokens)."""
    return every_score(queries, docs, bm25_weights(queries)).withColumnRenamed("score", "bm25")


def overlap_pairs(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, vec_id, overlap, |q ∩ d| / sqrt(|q| |d|), of every pair with a common term."""
    return every_score(queries, docs, overlap_weights(queries)).withColumnRenamed("score", "overlap")


def _cell_lists(q: pd.DataFrame, v: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best documents of each query in a cell of weights (query_id, term, weight) and postings (vec_id, term, value)."""
    # Documents are numbered in the order of their ids, so equal scores keep it.
    ids, doc = np.unique(v["vec_id"].to_numpy(), return_inverse=True)
    by_term = np.argsort(v["term"].to_numpy(), kind="stable")
    doc, value = doc[by_term], v["value"].to_numpy()[by_term]
    terms, first = np.unique(v["term"].to_numpy()[by_term], return_index=True)
    ends = np.append(first[1:], len(doc))
    q = q[np.isin(q["term"].to_numpy(), terms)].sort_values("term", kind="stable")
    made = []
    for query, rows in q.groupby("query_id", sort=False):
        at, weight = np.searchsorted(terms, rows["term"].to_numpy()), rows["weight"].to_numpy()
        met = np.concatenate([doc[first[t]:ends[t]] for t in at])
        score = np.bincount(met, np.concatenate([w * value[first[t]:ends[t]] for t, w in zip(at, weight)]), len(ids))
        has = np.zeros(len(ids), bool)
        has[met] = True
        found = np.flatnonzero(has)
        score = np.round(score[found], DIGITS)
        if len(found) > k:
            kept = score >= np.partition(score, len(score) - k)[len(score) - k]
            found, score = found[kept], score[kept]
        best = np.argsort(-score, kind="stable")[:k]
        made.append(pd.DataFrame({"query_id": query, "vec_id": ids[found[best]], "score": score[best]}))
    return pd.concat(made) if made else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def short_lists(queries: DataFrame, docs: DataFrame, weights: DataFrame, weight: str, value: str, k: int) -> DataFrame:
    """query_id, vec_id, score, rank: the k best documents of each query by weights(query_id, term, weight) and the
    postings' `value`; equal scores by vec_id."""
    # Cells compare numbers of terms instead of the terms.
    numbered = cut_lineage(vocabulary_of(queries).withColumn("number", F.monotonically_increasing_id()))
    postings, n, rows = scored_postings(docs, numbered)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = max(1, math.ceil(n / CELL_DOCS), math.ceil(rows / CELL_POSTINGS), min(cores, math.ceil(n / 1000)))
    q_parts = max(1, math.ceil(queries.count() / CELL_QUERIES))
    upto = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    v = postings.where("vec_id is not null").join(numbered, "term").select("vec_id", F.col("number").alias("term"), F.col(value).alias("value"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("_v"), upto(q_parts).alias("_q"))
    q = weights.where("query_id is not null").join(numbered, "term").select("query_id", F.col("number").alias("term"), F.col(weight).alias("weight"), F.pmod(F.xxhash64("query_id"), F.lit(q_parts)).alias("_q"), upto(parts).alias("_v"))

    def cell(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return _cell_lists(x, y, k)

    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {docs.schema['vec_id'].dataType.simpleString()}, score double"
    lists = spread(q, "_v", "_q").groupBy("_v", "_q").cogroup(spread(v, "_v", "_q").groupBy("_v", "_q")).applyInPandas(cell, schema)
    return top_n(lists, ["query_id"], [F.desc("score"), F.col("vec_id")], k)


def bm25(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, bm25, rank: the k best documents of each query. queries(query_id, tokens), docs(vec_id, tokens)."""
    if k <= SHORT_LIST:
        return short_lists(queries, docs, bm25_weights(queries), "w_bm25", "bm25", k).withColumnRenamed("score", "bm25")
    return lexical_topk(cut_lineage(bm25_weights(queries)), lexical_index(docs, vocabulary_of(queries)), k).withColumnRenamed("score", "bm25")


def overlap_cosine(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, overlap, rank: the k documents with the largest share of common terms, |q ∩ d| / sqrt(|q| |d|)."""
    if k <= SHORT_LIST:
        return short_lists(queries, docs, overlap_weights(queries), "w_overlap", "overlap", k).withColumnRenamed("score", "overlap")
    return lexical_topk(cut_lineage(overlap_weights(queries)), lexical_index(docs, vocabulary_of(queries)), k).withColumnRenamed("score", "overlap")
