"""No depth, size or round limit drops or changes anything."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lagweave.core.ranking import running_total
from lagweave.functions.text import leaf_text
from lagweave.operators import describe, graph, hierarchy, mapping, tests


def deep(n: int) -> dict:
    out: dict = {}
    for k in range(n, 0, -1):
        out = {f"n{k}": out}
    return out


def test_sixty_levels(spark):
    docs = spark.createDataFrame([(1, json.dumps(deep(60)))], "doc_id long, json string")
    flat = hierarchy.flatten_hierarchy(docs)
    assert flat.count() == 60 and flat.where("is_leaf").first().depth == 60
    path = spark.createDataFrame([([f"N{k}" for k in range(60)],)], "path array<string>")
    assert [len(r.path) for r in hierarchy.clean_hierarchy(path, [], root="n0").collect()] == [59]
    parents = spark.createDataFrame([(f"c{k + 1}", f"c{k}") for k in range(60)], "child string, parent string")
    assert max(len(r.path) for r in hierarchy.root_paths(parents).collect()) == 61


def test_twenty_level_listing(spark):
    lines = ["[TOP]"] + ["  " * k + f"branch {k}" for k in range(20)] + ["  " * 20 + "leaf (ID:7)"]
    got = hierarchy.parse_tree_lines(spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, line_no long, text string")).collect()
    assert [(r.leaf_id, r.depth, r.primary, r.secondary) for r in got] == [(7, 21, "TOP", "branch 0")]


def test_context_of_a_long_path(spark):
    path = " / ".join(f"s{k}" for k in range(150))
    assert spark.range(1).select(leaf_text(F.lit(path), "context").alias("t")).first().t.endswith(" < s0")


def test_pairs_without_k(spark):
    raw = spark.createDataFrame([(i, j, float(i * j)) for i in range(20) for j in range(20)], "a long, b long, score double")
    assert mapping.topk_mapping(raw, "a", "b", "pairs", (0, 0)).count() == 400
    assert [r.score for r in mapping.topk_mapping(raw, "a", "b", "pairs", (0, 0), k=2).collect()] == [361.0, 342.0]


def test_normality_holds_for_large_groups(spark):
    df = spark.createDataFrame([(6000, 0.0, 0.01)], "n long, s double, k double")
    assert df.select(tests._jb_normal(F.col("n"), F.col("s"), F.col("k")).alias("ok")).first().ok


def test_hierarchy_rows_stay_whole(spark):
    edges = spark.createDataFrame([(1, 5, 2.0)], "cluster_id long, predictor_id long, score double")
    twice = spark.createDataFrame([(5, "B", "x", "a"), (5, "A", "z", "c")], "predictor_id long, primary string, secondary string, tertiary string")
    r = mapping.attach_hierarchy(edges, twice).first()
    assert (r.primary, r.secondary, r.tertiary) == ("A", "z", "c")


def test_numbered_variables_are_no_factors(spark):
    rows = spark.createDataFrame([("x", "x", "x", "x"), ("y", "y", "y", "y")], "P01 string, P10 string, C12 string, Place string")
    assert [r.column for r in describe.detect_nominal(rows, {c: "text" for c in rows.columns}).collect()] == ["Place"]


def test_communities_leave_a_two_cycle(spark):
    key = "profile_id string, time_index int, "
    und = spark.createDataFrame([("p", 0, a, b, 1.0) for a, b in (("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("b", "c"), ("c", "b"), ("d", "a"), ("a", "d"))], key + "src string, dst string, aw double")
    nodes = spark.createDataFrame([("p", 0, n) for n in "abcde"], key + "node string")
    got = {r.node: r.module for r in graph.communities(und, nodes).collect()}
    weight = {n: {} for n in "abcde"}
    for r in und.collect():
        weight[r.dst][got[r.src]] = weight[r.dst].get(got[r.src], 0) + r.aw
    for n, votes in weight.items():
        votes[got[n]] = votes.get(got[n], 0) + (1.0 if n != "e" else 0.0)
        assert votes[got[n]] == max(votes.values())
    assert got["e"] == "e"


def test_running_total_over_ranges(spark):
    df = spark.createDataFrame([(f"k{i:04d}", i % 7) for i in range(500)], "k string, n long")
    got = sorted((r.k, r.n_below) for r in running_total(df, "k", "n", rows_per_range=60).collect())
    total = 0
    for i, (_, below) in enumerate(got):
        assert below == total
        total += i % 7


def test_clique_cover_equals_one_at_a_time(spark):
    import random

    rng = random.Random(4)
    score = {(a, b): rng.random() for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.35}
    pairs = spark.createDataFrame([(a, b, s) for (a, b), s in score.items()], "a long, b long, score double")
    got = {r.id: r.group for r in graph.clique_cover(pairs, spark.range(40)).collect()}
    of = lambda a, b: score.get((min(a, b), max(a, b)))
    open_, want = set(range(40)), {}
    while open_:
        near = {u: [v for v in open_ if v != u and of(u, v) is not None] for u in open_}
        rank = {u: (len(near[u]), u) for u in open_}
        seeds = [u for u in open_ if all(rank[v] < rank[u] for v in near[u])]
        cand = {}
        for m in open_ - set(seeds):
            mine = [(of(m, s), -s) for s in seeds if of(m, s) is not None]
            if mine:
                cand.setdefault(-max(mine)[1], []).append(m)
        for s in seeds:
            members = [s]
            for m in sorted(cand.get(s, []), key=lambda m: (-of(m, s), m)):
                if all(of(m, x) is not None for x in members):
                    members.append(m)
            want |= {m: s for m in members}
            open_ -= set(members)
    assert got == want


@pytest.mark.parametrize("folded", [1000, 2])
def test_clique_cover_folds_the_candidates_of_a_seed(spark, monkeypatch, folded):
    """Seven nodes in a clique and a chain of stars: the clique is taken in one round, however many admit steps it had."""
    score = {(a, b): 1 - 0.01 * (a + b) for a in range(7) for b in range(a + 1, 7)}
    score |= {(7, 8): 0.9, (8, 9): 0.8, (9, 10): 0.7}
    monkeypatch.setattr(graph, "FOLDED", folded, raising=False)
    cuts, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    pairs = spark.createDataFrame([(a, b, s) for (a, b), s in score.items()], "a long, b long, score double")
    got = {r.id: r.group for r in graph.clique_cover(pairs, spark.range(13)).collect()}
    assert got == {**dict.fromkeys(range(7), 6), 7: 7, 8: 9, 9: 9, 10: 10, 11: 11, 12: 12}
    # A round writes its candidates, its members and the links that are left.
    assert folded == 2 or len(cuts) <= 1 + 3 * 2


@pytest.mark.parametrize("few", [0, 200, 1 << 22])
def test_clique_cover_writes_each_link_once(spark, monkeypatch, few):
    """Sixteen bytes a link, written anew only where over half are gone; ids of any kind, repeated links, null ids."""
    import random

    from pyspark.sql import functions as F

    from lagweave.operators import cover

    monkeypatch.setattr(cover, "FEW_LINKS", few)
    written, keep = [], cover.stored
    monkeypatch.setattr(cover, "stored", lambda df, *how: written.append(keep(df, *how)) or written[-1])
    rng = random.Random(8)
    score = {(a, b): rng.random() for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.3}
    rows = [(f"n{a:02d}", f"n{b:02d}", s) for (a, b), s in score.items()]
    ids = spark.createDataFrame([(f"n{i:02d}",) for i in range(60)] * 2 + [(None,)], "id string")
    out = {r.id: r.group for r in graph.clique_cover(spark.createDataFrame(rows, "a string, b string, score double"), ids).collect()}
    assert set(out) == {f"n{i:02d}" for i in range(60)} | {None} and out.pop(None) is None
    linked = {frozenset(r[:2]) for r in rows}
    assert all(x == y or out[x] != out[y] or frozenset((x, y)) in linked for x in out for y in out) and len(set(out.values())) < 40
    sizes = [w.agg(F.sum(F.octet_length("a") + F.octet_length("b") + F.octet_length("score"))).first()[0] for w in written]
    assert sizes[0] == 16 * len(rows) and all(2 * y < x for x, y in zip(sizes, sizes[1:]))
    numbers = spark.createDataFrame([(1, 2, 0.5), (1, 2, 0.5), (2, 3, 0.9), (3, 9, 1.0), (4, 4, 1.0)], "a int, b int, score double")
    assert {r.id: r.group for r in graph.clique_cover(numbers, spark.range(1, 5)).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}


def test_slots_without_a_variable_give_no_lag_row(spark):
    from lagweave.operators.network import lag_rows

    rows = [("p", c, t, float(t)) for t in range(6) for c in ("P01", "C01") if (c, t) != ("P01", 2) and (c, t) != ("C01", 3)]
    got = lag_rows(spark.createDataFrame(rows, "profile_id string, code string, t_index int, value double")).collect()
    assert sorted(r.y[0] for r in got) == [1.0, 5.0] and all(r.codes == ["C01", "P01"] for r in got)
