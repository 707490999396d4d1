"""Lexical lists, the threshold join and the fused ranking against full products."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.operators import lexical as L
from lagweave.operators import retrieval as X


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(3)
    word = lambda n: [f"t{int(w)}" for w in np.minimum(rng.zipf(1.4, n), 300)]
    docs = [(i, word(int(rng.integers(1, 30)))) for i in range(600)] + [(1000 + i, ["t1", "t2", "t7"]) for i in range(50)] + [(2000, []), (2001, ["only"])]
    queries = [(f"q{k}", word(int(rng.integers(1, 6)))) for k in range(12)] + [("none", ["zz"]), ("twice", ["t5", "t5", "t9"])]
    return docs, queries


def frames(spark, texts):
    docs, queries = texts
    return spark.createDataFrame(queries, "query_id string, tokens array<string>"), spark.createDataFrame(docs, "vec_id int, tokens array<string>").repartition(4)


def full_scores(docs, queries):
    n, avgdl = len(docs), np.mean([len(t) for _, t in docs])
    df = Counter(w for _, t in docs for w in set(t))
    out = {}
    for q, qt in queries:
        for v, t in docs:
            tf = Counter(t)
            common = [w for w in qt if w in tf]
            if common:
                idf = lambda w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                out[q, v] = (sum(idf(w) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in common), len(set(common)) / math.sqrt(len(set(t)) * len(set(qt))))
    return out


@pytest.mark.parametrize("k", [1, 7, 200, 5000])
def test_lists_are_those_of_all_pairs(spark, texts, k):
    every = full_scores(*texts)
    q, d = frames(spark, texts)
    for column, made in (("bm25", L.bm25(q, d, k)), ("overlap", L.overlap_cosine(q, d, k))):
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r[column]) for r in made.collect()}
        want = {}
        for name, _ in texts[1]:
            ranked = sorted((-round(s[column == "overlap"], 9), v) for (n, v), s in every.items() if n == name)[:k]
            want |= {(name, i + 1): (v, -s) for i, (s, v) in enumerate(ranked)}
        assert got.keys() == want.keys()
        assert all(got[x][1] == pytest.approx(want[x][1], abs=1e-8) for x in got)
        assert sum(got[x][0] != want[x][0] for x in got) == 0


def test_second_pass_scores_few_blocks(spark):
    """Documents on many subjects: a query's list needs the blocks of its own subject only."""
    rng = np.random.default_rng(5)
    docs = [(i, [f"s{i % 40}w{int(x)}" for x in rng.integers(0, 12, 15)] + ["the"] * 3) for i in range(6000)]
    queries = [(f"q{s}", [f"s{s}w1", f"s{s}w2", f"s{s}w3", "the"]) for s in range(5)]
    q, d = frames(spark, (docs, queries))
    index, weights = L.lexical_index(d, L.vocabulary_of(q)), L.bm25_weights(q)
    found = L.lexical_topk(weights, index, 10)
    floors = found.where("rank = 10").select("query_id", F.col("score").alias("floor"))
    bounds = L.block_bounds(weights, index).join(floors, "query_id")
    all_blocks, needed = bounds.count(), bounds.where("bound + 1e-6 >= floor").count()
    assert found.count() == 50 and needed < all_blocks / 10


@pytest.mark.parametrize("threshold, one_tile", [(0.95, 0), (0.6, 0), (0.6, 10_000), (0.0, 0), (-0.5, 10_000)])
def test_threshold_join_is_exact(spark, threshold, one_tile, monkeypatch):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 8))
    v = np.vstack([centers[rng.integers(0, 12, 700)] + 0.15 * rng.normal(size=(700, 8)), np.zeros((2, 8)), np.repeat(centers[:1], 40, 0)])
    vecs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id int, embedding array<double>").repartition(3)
    u = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)
    s = u @ u.T
    i, j = np.nonzero(np.triu(s >= threshold, 1))
    sure = np.abs(s - threshold) > 1e-9
    monkeypatch.setattr(X, "JOIN_ROWS", 60)
    monkeypatch.setattr(X, "ONE_TILE", one_tile)
    rows = X.cosine_threshold_join(vecs, threshold, pivots=20).collect()
    got = [(r["a"], r["b"]) for r in rows]
    assert len(got) == len(set(got)) and {p for p in got if sure[p]} == {(a, b) for a, b in zip(i.tolist(), j.tolist()) if sure[a, b]}
    assert all(r["score"] == pytest.approx(s[r["a"], r["b"]]) for r in rows)


def test_clustered_vectors_are_copied_to_few_cells(spark):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(25, 16))
    v = centers[rng.integers(0, 25, 5000)] + 0.05 * rng.normal(size=(5000, 16))
    vecs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id int, embedding array<double>")
    old, X.ONE_TILE = X.ONE_TILE, 100
    cells = X.pivot_cells(vecs, 0.95).cache()
    cells.count()
    X.ONE_TILE = old
    n_cells = cells.select("cell").distinct().count()
    copies = cells.count() / 5000
    assert n_cells >= 20 and copies < n_cells / 8
    assert cells.where("at_home").count() == 5000


def test_threshold_join_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id int, embedding array<double>")
    assert X.cosine_threshold_join(none, 0.5).count() == 0


def test_fused_rank_keeps_few_candidates(spark):
    from lagweave.catalog.retrieval import corpus

    queries, docs = corpus(spark, "/root/testdata/sf0.01")
    queries = queries.withColumn("scope", F.split("query_id", " ")[0])
    _, kept = X.fused_candidates(queries, docs, 10, "scope")
    pairs = queries.select("scope").distinct().count() * docs.count()
    assert kept.groupBy("query_id", "vec_id").count().where("count > 1").count() == 0
    assert kept.count() < 0.1 * pairs


def test_vectors_without_structure_are_copied_to_few_blocks(spark, monkeypatch):
    """No angle rules a cell out at a low threshold, so the copies follow from the blocks and not from the pivots; one call
    compares a block with a block and gives its pairs in pieces."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6000, 32))
    vecs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id int, embedding array<float>")
    monkeypatch.setattr(X, "ONE_TILE", 100)
    assert X.pivot_cells(vecs, 0.1).count() < 12 * 6000
    got = X.cosine_threshold_join(vecs, 0.5)
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.triu(u @ u.T, 1)
    assert got.count() == int((s >= 0.5).sum())


@pytest.mark.parametrize("name, score", [("R01_bm25", "bm25"), ("R02_overlap_cosine", "overlap")])
def test_every_pair_with_a_common_term_is_scored(spark, tmp_path, name, score):
    """Each of 300 parts shares its colour, and half of them the kind, with the query of its name."""
    from lagweave.catalog import load


    parts = [(i, "red ring" if i % 2 else "red bolt", "Brand#1", "SMALL", 1, 1.0) for i in range(300)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(5)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = load().QUERIES[name](spark, str(tmp_path))
    assert got.columns == ["query_id", "vec_id", score] and got.count() == 2 * 300
    assert got.select("query_id", "vec_id").distinct().count() == 2 * 300


def test_fuzzy_match_finds_the_best_of_all_pairs(spark):
    """Labels of 4 to 60 characters with up to seven edits, against every term; all share a token."""
    import random

    from lagweave.operators import joins as J

    rng = random.Random(11)
    base = ["co " + "".join(rng.choice("abc 12") for _ in range(rng.randint(2, 56))) for _ in range(70)]

    def changed(t: str) -> str:
        for _ in range(rng.randint(0, 1 + len(t) // 8)):
            i = rng.randrange(3, len(t)) if len(t) > 3 else 3
            t = t[:i] + rng.choice(["", "x", t[i:i + 1] + "y"]) + t[i + 1:]
        return t

    fold = lambda t: " ".join(t.split())
    labels, terms = [(i, t) for i, t in enumerate(base)], [(100 + i, changed(t)) for i, t in enumerate(base * 3)]

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for i, a in ((i, fold(t)) for i, t in labels):
        found = [(-(1 - distance(a, b) / max(len(a), len(b))), b, j) for j, b in ((j, fold(t)) for j, t in terms)]
        if min(found)[0] <= -0.88:
            want[i] = min(found)
    got = J.fuzzy_entity_match(spark.createDataFrame(labels, "label_id long, label string"), spark.createDataFrame(terms, "entity_id long, term string")).collect()
    assert len(want) > 40 and {r.label_id: (r.term, r.entity_id) for r in got} == {i: w[1:] for i, w in want.items()}


def test_similar_keys_are_not_paired_for_a_common_word(spark):
    """400 labels of one length with a word in common: the old pairs were all of them."""
    from lagweave.operators import joins as J

    a = spark.createDataFrame([(f"supplier#{i * 7919 % 1000003:09d}",) for i in range(400)], "ka string")
    b = spark.createDataFrame([(f"supplier#{i * 104729 % 1000003:09d}",) for i in range(400)], "kb string")
    assert J.edit_candidates(a, b, 0.88).count() < 400 * 400 / 10


def test_vector_lists_hold_few_scores_at_a_time():
    rng = np.random.default_rng(3)
    q, v = rng.normal(size=(300, 4)), rng.normal(size=(X.VECTOR_ROWS, 4))
    parts = list(X._score_rows(q, v))
    assert len(parts) > 1 and all(p.size <= X.HELD_SCORES for p in parts) and np.allclose(np.concatenate(parts), q @ v.T)
    # What a cell gives: the list of each of its queries.
    assert X.QUERY_ROWS * min(X.POOL, X.VECTOR_ROWS) <= 2 ** 22


def test_short_lists_split_each_text_once_and_give_k_rows_a_cell(spark, texts, monkeypatch):
    """Several cells of documents and queries; ids that are null, repeat, or stand for two texts."""
    monkeypatch.setattr(L, "CELL_DOCS", 100)
    monkeypatch.setattr(L, "CELL_QUERIES", 5)
    docs = [*texts[0], (7, ["t1", "t3"]), (7, ["t1", "t3"]), (8, ["t2"] * 9), (None, ["t1", "t9"])]
    queries = [*texts[1], (None, ["t1"])]
    split = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def tokens(t):
        split.add(1)
        return t.split()

    q = spark.createDataFrame(queries, "query_id string, tokens array<string>")
    d = spark.createDataFrame([(v, " ".join(t)) for v, t in docs], "vec_id int, text string").repartition(3).select("vec_id", tokens("text").alias("tokens"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["bm25"]) for r in L.bm25(q, d, 6).collect()}
    assert split.value == len(docs)

    n, avgdl = len(docs), np.mean([len(t) for _, t in docs])
    postings = Counter((v, len(t), w) for v, t in docs for w in t)
    df = Counter(w for _, _, w in postings)
    want = {}
    for name, qt in queries[:-1]:
        score = Counter()
        for (v, dl, w), tf in postings.items():
            if w in qt and v is not None:
                score[v] += qt.count(w) * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
        want |= {(name, i + 1): (v, -s) for i, (s, v) in enumerate(sorted((-round(s, 9), v) for v, s in score.items())[:6])}
    assert {x: v for x, (v, _) in got.items()} == {x: v for x, (v, _) in want.items()}
    assert all(got[x][1] == pytest.approx(want[x][1], abs=1e-8) for x in got)


def test_a_cell_gives_its_best_documents_only():
    import pandas as pd

    q = pd.DataFrame({"query_id": ["a", "a", "b", "c"], "term": [1, 2, 2, 9], "weight": [1.0, 2.0, 1.0, 1.0]})
    v = pd.DataFrame({"vec_id": [5, 3, 4, 3, 6], "term": [1, 1, 2, 2, 2], "value": [2.0, 1.0, 1.0, 0.5, 1.0]})
    got = L._cell_lists(q, v, 2)
    assert got.values.tolist() == [["a", 3, 2.0], ["a", 4, 2.0], ["b", 4, 1.0], ["b", 6, 1.0]]
