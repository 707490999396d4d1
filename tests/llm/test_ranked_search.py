"""Ranked search against scoring every document for every item."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lagweave.llm import ranked_search as R
from tests.llm import brute

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"


def expected(docs: list[tuple], items: list[tuple], k: int = 20) -> list[tuple]:
    terms = [(i, TERM.findall(brute.lower(t or ""))) for i, t in docs]
    terms = [(i, Counter(t), len(t)) for i, t in terms if t]
    n_docs, total = len(terms), sum(n for *_, n in terms)
    df = Counter(w for _, t, _ in terms for w in t)
    out = []
    for item, text in sorted(set(items), key=repr):
        asked = Counter(TERM.findall(brute.lower(text or "")))
        scored = []
        for i, t, n in terms:
            m = 75 + (25 * n * n_docs) // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * t[w]) // (1000 * t[w] + 12 * m)) for w, q in asked.items() if w in t)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, "n", 4) for i, t in docs], "doc_id long, text string, n string, tf int").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({"query": F.lit("clash"), "rank": F.lit(0)})
    out = R.search(d, q, **how)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def corpus() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(11)
    docs = [(i, brute.prose(rng, rng.randrange(0, 80), 300)) for i in range(400)]
    docs += [(1000 + i, "Same w1, w2 é W3_w4") for i in range(60)] + [(2000, None), (2001, ""), (2002, " .;"), (None, "w1 w2"), (2003, "w5 " * 30_000), docs[0], docs[0]]
    items = [(k, brute.prose(rng, rng.randrange(1, 90), 300)) for k in range(12)]
    items += [(50, None), (51, ""), (52, "... --"), (53, "unseen words only zz"), (54, "w1 W1 w1 w2"), (55, "w1 W1 w1 w2"), (54, "w1 W1 w1 w2"), (54, "é"), (None, "w7")]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"block_bytes": 150}, {"k": 3}])
def test_ranks(spark, how):
    docs, items = corpus()
    assert found(spark, docs, items, **how) == expected(docs, items, how.get("k", 20))


def test_small_batches_and_groups_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(R, "BATCH_DOCS", 64)
    monkeypatch.setattr(R, "GROUPS_AT_ONCE", 1)
    docs, items = corpus()
    assert found(spark, docs, items) == expected(docs, items)


def test_masks_below_the_bar_are_left_out():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{int(x)}" for x in rng.geometric(0.08, rng.integers(20, 40))) for _ in range(4000)]
    block = R.make_block([("q", "w30 w25 w2 w1")])
    made = pa.Table.from_batches(list(R.term_counter(block.vocabulary)([pa.RecordBatch.from_pydict({"doc_id": list(range(4000)), "text": texts})])))
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in made["terms"]])))
    terms = np.concatenate([np.array(x.as_py(), np.int64) for x in made["terms"]])
    tf = np.concatenate([np.array(x.as_py(), np.int64) for x in made["tf"]])
    weights = R.weights_of(np.bincount(terms, minlength=4), 4000)
    best = [R.Best(20)]
    pairs, evaluated = R.rank_batch(best, block, weights, made["doc_id"].combine_chunks(), bounds, terms, (10**9 * tf) // (1000 * tf + 1200))
    assert len(best[0].scores) == 20 and evaluated < pairs / 2


def test_a_common_word_scores_nothing(spark):
    docs = [(i, "the") for i in range(5)]
    assert found(spark, docs, [(1, "the")]) == expected(docs, [(1, "the")])
    many = [(i, "the") for i in range(1500)]
    assert found(spark, many, [(1, "the")]) == [] == expected(many, [(1, "the")])


def test_nothing(spark):
    docs, items = corpus()
    assert found(spark, [], items) == [] == found(spark, docs, [])
