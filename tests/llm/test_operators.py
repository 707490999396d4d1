"""Each operator of the subpackage against a brute-force version on small documents with every odd case."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lagweave.llm import components, decontaminate, importance, kernels, license_scan, ngram_join, packing, quality_rules, resharding, suffix_dedup, url_filter
from tests.llm import brute

DOCS = brute.corpus()
SCHEMA = "doc_id long, text string"
public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def frame(spark, rows, schema=SCHEMA, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=repr)


# 1 importance resampling

def test_importance_prefers_the_target(spark):
    good = [(i, " ".join(f"fine{(i * 7 + j) % 50}" for j in range(40))) for i in range(200)]
    bad = [(1000 + i, " ".join(f"junk{(i * 5 + j) % 50}" for j in range(40))) for i in range(100)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 200, 2)] + [(1000 + i, 0) for i in range(50)], "doc_id long, q int")
    docs = frame(spark, good + bad + [(None, "x y"), (5000, None), (5001, ""), good[3]])
    got = importance.resample(docs, labels, F.col("q") == 1, fraction=0.6).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert len(got) == 304 and sum(r.kept for r in got) in (182, 183)
    assert sum(i < 1000 for i in kept if i is not None) / len(kept) > 0.97
    assert {r.doc_id: (r.kept, r.log_weight) for r in got}[5000] == (False, None)


def test_importance_kth_largest_is_exact(spark):
    values = [(float(v),) for v in np.random.default_rng(3).normal(size=30_000)] + [(2.5,)] * 7 + [(None,)]
    df = spark.createDataFrame(values, "v double").persist()
    ranked = sorted((v for v, in values if v is not None), reverse=True)
    for k in (1, 190, 15_000, 30_007):
        assert importance.kth_largest(df, "v", k) == ranked[k - 1]


def test_importance_weights_match_counts(spark):
    docs = [(1, "a b a"), (2, "c d"), (3, "A b")]
    labels = spark.createDataFrame([(1,)], "doc_id long")
    w = importance.fit(frame(spark, docs), labels, F.lit(True), buckets=1 << 15, smoothing=0.5)

    def grams(t):
        t = t.lower().split()
        return t + [f"{a} {b}" for a, b in zip(t, t[1:])]

    raw, target = Counter(g for _, t in docs for g in grams(t)), Counter(grams(docs[0][1]))
    ratio = lambda g: np.log((target[g] + .5) / (sum(target.values()) + .5 * (1 << 15))) - np.log((raw[g] + .5) / (sum(raw.values()) + .5 * (1 << 15)))
    got = importance.resample(frame(spark, docs), labels, F.lit(True), fraction=1.0, grams=100)
    for r in got.collect():
        text = dict(docs)[r.doc_id]
        assert abs(r.log_weight - 100 * np.mean([ratio(g) for g in grams(text)])) < 1e-9
    assert len(w) == 1 << 15


def test_importance_ties_and_clashing_columns(spark):
    """Equal documents have equal keys only if their ids are equal; all rows on the cut are kept."""
    docs = [(i % 3, "same words here") for i in range(30)]
    wide = spark.createDataFrame([(i, t, 1.0, "x") for i, t in docs], "doc_id long, text string, log_weight double, kept string")
    labels = spark.createDataFrame([(0,)], "doc_id long")
    got = importance.resample(wide, labels, F.lit(True), fraction=0.5).collect()
    assert len(got) == 30
    by = {i: {r.asDict().get("kept", r.asDict().get("_kept")) for r in got if r.doc_id == i} for i in range(3)}
    assert all(len(v) == 1 for v in by.values()) and any(True in v for v in by.values())


def test_importance_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, q int")
    assert importance.resample(none, labels, F.col("q") == 1).count() == 0
    assert sum(r.kept for r in importance.resample(frame(spark, DOCS), labels, F.col("q") == 1).collect()) > 60


# 2 quality rules

def test_quality_counts(spark):
    got = rows(quality_rules.quality_report(frame(spark, DOCS)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == sorted(((i, *brute.quality(t)) for i, t in DOCS), key=repr)


def test_quality_lookup_agrees_with_sorting(spark, monkeypatch):
    texts = [(i, " ".join(f"v{(i * j) % (3 + i)}" for j in range(90))) for i in range(30)]
    for few in (0, 10_000):
        monkeypatch.setattr(quality_rules, "FEW", few)
        got = {r.doc_id: r.n_repeat_words for r in quality_rules.quality_report(frame(spark, texts)).collect()}
        assert got == {i: brute.quality(t)[4] for i, t in texts}


def test_quality_cascade_keeps_what_no_rule_rejects(spark):
    wide = frame(spark, DOCS).withColumns({"kept": F.lit("mine"), "rejected_by": F.lit(1)})
    out = quality_rules.apply_rules(wide)
    assert out.columns == ["doc_id", "text", "kept", "rejected_by", "_rejected_by", "_kept"]
    kept = rows(quality_rules.keep_good(wide), "doc_id", "text")
    want = []
    for i, t in DOCS:
        n, chars, symbols, dup, repeated = brute.quality(t)
        lines = len([x for x in (t or "").split("\n") if brute.SPACED.search(x)])
        if not (n < 50 or 2 * repeated > n or 10 * symbols > n or 100 * dup > 40 * lines or not 3 * n <= chars <= 12 * n):
            want.append((i, t))
    assert kept == sorted(want, key=repr) == rows(out.where("_kept"), "doc_id", "text")
    assert quality_rules.keep_good(spark.createDataFrame([], SCHEMA)).count() == 0


def test_quality_order_follows_rejection_per_cost(spark):
    rules = (quality_rules.Rule("never", lambda c: c["n_repeat_words"] < 0), quality_rules.Rule("short", lambda c: c["n_words"] < 150))
    assert [r.name for r in quality_rules.estimate(frame(spark, DOCS), rules=rules)] == ["short", "never"]


# 3 URL filter

def test_url_rules(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("Example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("a.b", "/x", "block"), ("a.b", "/x", "allow")], "host string, path string, verdict string")
    cases = [
        ("http://EXAMPLE.org/es/1?q", "example.org", "/es/1", "example.org/es/", "block"), ("https://m.example.org/en/19#x", "m.example.org", "/en/19", "example.org/en/1", "block"),
        ("x://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"), ("http://org", "org", "", None, "allow"), ("http://a.b/xyz", "a.b", "/xyz", "a.b/x", "block"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("http://x.com\n/é/ü", "x.com\n", "/é/ü", None, "allow"), ("http://" + "a." * 300 + "org/" + "p" * 5000, "a." * 300 + "org", "/" + "p" * 5000, "org/", "allow"),
    ]
    pages = spark.createDataFrame([(k, c[0], "r", 1) for k, c in enumerate(cases)] + [(0, cases[0][0], "r", 1), (None, None, "r", 1)], "page_id long, url string, rule string, host int")
    got = rows(url_filter.judge_urls(pages, rules))
    assert got == sorted([(k, *c[1:]) for k, c in enumerate(cases)] + [(0, *cases[0][1:]), (None, "", "", None, "allow")], key=repr)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert url_filter.judge_urls(pages, rules.limit(0)).where("rule is not null").count() == 0


# 4 suffix dedup

@pytest.mark.parametrize("how", [{}, {"block_bytes": 4000, "bucket_bytes": 3000}, {"block_bytes": 4000, "bucket_bytes": 3000, "heavy_blocks": 1}])
def test_repeats(spark, how):
    docs = [(i, t if t is None or len(t) < 60_000 else t[:60_000]) for i, t in DOCS]
    assert rows(suffix_dedup.repeat_report(frame(spark, docs), **how)) == sorted(brute.repeats(docs), key=repr)


def test_repeats_cut_whole_characters_and_keep_columns(spark):
    shared = "é" * 30 + "ü" * 30
    docs = [(1, "a" + shared, "x", 7), (2, "bb" + shared + "tail", "y", 8), (3, None, "z", 9)]
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string, block string, n_bytes int")).collect()}
    assert out[1].text == "a" + shared and out[2].text == "bbtail" and out[3].text is None
    assert (out[2].block, out[2].n_bytes, out[2]._n_bytes, out[2].n_removed) == ("y", 8, 126, 120)
    assert suffix_dedup.repeat_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_suffix_sort_orders_by_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    at = rng.permutation(500)
    group = np.sort(rng.integers(0, 4, 500))
    sums = kernels.prefix_hashes(data)
    order = suffix_dedup.suffix_sort(data, sums, at, group, 50)
    raw = data.tobytes()
    keys = [(int(group[i]), raw[at[i]:at[i] + 50]) for i in order]
    assert keys == sorted(keys)
    a, b = rng.integers(0, 540, 300), rng.integers(0, 540, 300)
    assert [len(np.flatnonzero(np.cumprod(data[x:x + 50] == data[y:y + 50]))) for x, y in zip(a, b)] == suffix_dedup.common_extension(sums, a, b, 50).tolist()


def test_suffixes_of_a_frequent_anchor_are_compared_once(monkeypatch):
    """4000 windows of one group: neighbours in order are compared, not each suffix with many others."""
    rng = np.random.default_rng(2)
    data = np.concatenate([np.concatenate((rng.integers(97, 99, 6), np.full(44, 120))) for _ in range(4000)]).astype(np.uint8)
    at = np.arange(4000) * 50
    compared, extend = [], suffix_dedup.common_extension
    monkeypatch.setattr(suffix_dedup, "common_extension", lambda sums, a, b, most: compared.append(len(a)) or extend(sums, a, b, most))
    got = suffix_dedup.equal_windows(data, at, np.zeros(4000, np.int64), 50)
    assert sum(compared) < 4000
    raw = [data[x:x + 50].tobytes() for x in at]
    assert len(set(got.tolist())) == len(set(raw)) == len(set(zip(got.tolist(), raw)))


@pytest.mark.parametrize("most", [1, 3, 7, 8, 9, 16, 17, 50])
def test_suffix_sort_of_any_length_keeps_the_order_of_equals(most):
    rng = np.random.default_rng(most)
    data = rng.choice([0, 97, 255], 300).astype(np.uint8)
    at, group = rng.integers(0, 301 - most, 200), np.sort(rng.integers(0, 3, 200))
    order = suffix_dedup.suffix_sort(data, kernels.prefix_hashes(data), at, group, most)
    raw = data.tobytes()
    assert order.tolist() == sorted(range(200), key=lambda i: (group[i], raw[at[i]:at[i] + most], i))


# 5 packing

def test_odd_spaces_and_clashing_columns(spark):
    docs = [(1, "\xa0".join(["wide", "space"] * 300)), (2, None), (2, "x"), (None, "y")]
    wide = spark.createDataFrame([(i, t, 1, "s", 2, 3) for i, t in docs], "doc_id long, text string, piece int, length string, sequence_id int, _block int")
    got = packing.pack_documents(wide, VOCABULARY, capacity=64).collect()
    want = packing.pack_documents(frame(spark, docs), VOCABULARY, capacity=64).collect()
    key = lambda r: (str(r.doc_id), r.piece, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, want)) and got[0].asDict().keys() == want[0].asDict().keys()


def check_packing(placed, capacity, max_docs, max_cost):
    bins = defaultdict(list)
    for r in placed:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= capacity and len(parts) <= max_docs and sum(n * n for _, n in parts) <= max_cost
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [{}, {"max_docs": 3}, {"max_cost": 900_000}])
def test_packing_respects_every_capacity(spark, rule, limits):
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.geometric(1 / 300, 3000), 900).tolist()
    pieces = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    placed = packing.pack(pieces, 1024, pieces_per_block=400, rule=rule, **limits).collect()
    assert sorted(r.doc_id for r in placed) == list(range(3000))
    n = check_packing(placed, 1024, limits.get("max_docs", 1024), limits.get("max_cost", 1024 * 1024))
    least = max(-(-sum(lengths) // 1024), -(-3000 // limits.get("max_docs", 1024)))
    if "max_cost" not in limits:
        assert n <= (1.02 if rule == "norm" and not limits else 1.3) * least + 1


def test_packing_documents(spark):
    from tokenizers import Tokenizer

    odd = [(80, "a<|endoftext|>b ΣΑΣ don'tve 'll"), (81, "x\x85y\xa0z\x1cq"), (82, "é" * 9), (83, "ſt ﬁ İ Å \x00 \x7f")]
    docs = DOCS + odd
    t = Tokenizer.from_file(VOCABULARY)
    placed = packing.pack_documents(frame(spark, docs), VOCABULARY, capacity=512).collect()
    want = Counter()
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 512):
            part = np.array(ids[k:k + 512], "<u4")
            want[i, k // 512, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == want
    check_packing(placed, 512, 512, 512 * 512)
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), VOCABULARY).count() == 0


def test_packed_sequences_hold_the_ids(spark):
    docs = [(i, brute.prose(np.random.RandomState(i) and __import__("random").Random(i), 30 + i)) for i in range(12)]
    pieces = packing.make_pieces(frame(spark, docs), VOCABULARY, 128, with_ids=True).persist()
    got = packing.sequences(packing.pack(pieces.drop("ids"), 128), pieces).collect()
    assert sum(len(r.ids) for r in got) == sum(r.length for r in pieces.collect()) and all(len(r.ids) <= 128 for r in got)


# 6 resharding

def test_min_cost_flow_moves_the_least():
    flow = resharding.min_cost_flow([50, 30, 20], [25, 25, 25, 25])
    assert [sum(f) for f in flow] == [50, 30, 20] and [sum(f[j] for f in flow) for j in range(4)] == [25] * 4
    assert sum(n for i, f in enumerate(flow) for j, n in enumerate(f) if i != j) == 30
    assert resharding.min_cost_flow([7], [3, 2]) == [[3, 2]]


def test_min_cost_flow_against_every_flow():
    """All ways to split small shard sizes over the new capacities; none keeps more bytes in place."""
    rng = np.random.default_rng(12)

    def splits(left, caps):
        if not left:
            yield ()
            return
        def share(n, room):
            if len(room) == 1:
                if n <= room[0]:
                    yield (n,)
                return
            for x in range(min(n, room[0]) + 1):
                for rest in share(n - x, room[1:]):
                    yield (x, *rest)
        for row in share(left[0], caps):
            for more in splits(left[1:], [c - x for c, x in zip(caps, row)]):
                yield (row, *more)

    for _ in range(25):
        old = rng.integers(0, 6, rng.integers(1, 4)).tolist()
        n = int(rng.integers(1, 4))
        caps = [sum(old) // n + (j < sum(old) % n) for j in range(n)]
        flow = resharding.min_cost_flow(old, caps)
        kept = lambda f: sum(f[i][i] for i in range(min(len(old), n)))
        assert [sum(r) for r in flow] == old and [sum(r[j] for r in flow) for j in range(n)] == caps
        assert kept(flow) == max(kept(f) for f in splits(old, caps))


def test_resharding_ignores_other_columns(spark):
    wide = frame(spark, DOCS).withColumns({c: F.lit("x") for c in ("size", "shard", "slot", "old", "_n", "law")})
    got = resharding.reshard(wide, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)), 4, "rows", rows_per_block=10)
    assert got.count() == len(DOCS) and got.groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_resharding(spark, law):
    docs = frame(spark, DOCS)
    old = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3))
    got = resharding.reshard(docs, old, 4, law, rows_per_block=10).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in DOCS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for parts in by.values():
        assert sorted(r.slot for r in parts) == list(range(len(parts)))
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        total = sum(r.size for r in got)
        assert all(abs(sum(r.size for r in p) - total / 4) <= max(r.size for r in got) for p in by.values())
    assert resharding.reshard(docs.limit(0), old, 4).count() == 0


def test_rewrite_touches_affected_shards_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 9) for i in range(90)], SCHEMA)
    old = F.when(F.col("doc_id") < 30, 0).when(F.col("doc_id") < 80, 1).otherwise(2)
    placed = resharding.reshard(docs, old, 3, "rows")
    for j in range(3):
        docs.withColumn("slot", F.lit(0)).where(old == j).write.parquet(f"{tmp_path}/shard={j}")
    before = {p.name for p in (tmp_path / "shard=0").iterdir()}
    assert resharding.rewrite(docs, placed, str(tmp_path)) == [1, 2]
    assert {p.name for p in (tmp_path / "shard=0").iterdir()} == before
    assert sorted(r["count"] for r in spark.read.parquet(str(tmp_path)).groupBy("shard").count().collect()) == [30, 30, 30]


# 7 n-gram join

@pytest.mark.parametrize("seed", [5, 6])
def test_jaccard_components(spark, seed):
    docs = brute.corpus(seed)
    want = brute.components(docs)
    got = ngram_join.ngram_components(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r.doc_id
        else:
            assert r.component_id is None


def test_jaccard_large_group_and_chain(spark):
    base = [f"b{k}" for k in range(200)]
    docs = [(k, " ".join(base[:k % 180] + [f"n{k}"] + base[k % 180 + 1:])) for k in range(150)]
    chain = [(1000 + k, " ".join(f"c{j}" for j in range(6 * k, 6 * k + 240))) for k in range(12)]
    want = brute.components(docs + chain)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame(spark, docs + chain)).collect()}
    assert got == want


def test_jaccard_keep_one(spark):
    wide = frame(spark, DOCS).withColumn("n", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = ngram_join.keep_one(wide)
    want = brute.components(DOCS)
    assert got.columns == wide.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (_, c) in want.items() if i == c) and ids.count(None) == 2
    assert ngram_join.ngram_components(wide.limit(0)).count() == 0


def test_jaccard_near_copies_around_the_threshold(spark):
    """A few hundred copies with so many edits that many pairs lie below the threshold, in two drifting clusters."""
    rng = __import__("random").Random(8)
    for q, percent, edits in ((3, 90, 4), (5, 80, 5)):
        docs = []
        for cluster in range(2):
            base = [f"m{k}" for k in range(120)] if cluster == 0 else [f"m{k}" if k % 9 else f"z{k}" for k in range(120)]
            for i in range(150):
                w = list(base)
                for _ in range(rng.randrange(edits)):
                    w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
                docs.append((1000 * cluster + i, " ".join(w)))
        sets = {i: brute.shingles(t, q) for i, t in docs}
        want = brute.components_of(sets, percent)
        assert len(set(want.values())) > 4
        got = ngram_join.ngram_components(frame(spark, docs, parts=5), q=q, threshold=(percent, 100)).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_jaccard_many_ids_go_by_bitmap(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_PAIRS", 3)
    monkeypatch.setattr(components, "FEW_EDGES", 2)
    want = brute.components(DOCS)
    got = ngram_join.ngram_components(frame(spark, DOCS)).collect()
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)


def test_jaccard_one_id_with_two_texts(spark):
    texts = [f"{a} " + " ".join(f"{a}{k}" for k in range(60)) for a in "abc"]
    docs = [(5, texts[0], "x"), (5, texts[1], "y"), (5, texts[1], "z"), (7, texts[2], "x"), (9, texts[2] + " more", "x")]
    least = spark.createDataFrame(docs, "doc_id long, text string, s string").where("doc_id = 5").orderBy(F.xxhash64("text"), F.xxhash64("doc_id", "text", "s")).first()
    for parts in (1, 3, 7):
        got = ngram_join.keep_one(frame(spark, docs, "doc_id long, text string, s string", parts))
        assert rows(got) == sorted([tuple(least), docs[3]], key=repr)


# 8 license scan

def test_license_windows_found(spark):
    rng = __import__("random").Random(1)
    planted = {}
    docs = []
    for i in range(120):
        w = brute.prose(rng, rng.randrange(0, 300)).split(" ")
        if i % 3 == 0:
            name, text = license_scan.TEMPLATES[i // 3 % len(license_scan.TEMPLATES)]
            at = rng.randrange(len(w) + 1)
            w[at:at] = text.upper().split(" ") if i % 2 else text.split(" ")
            planted[i] = name
        docs.append((i, " ".join(w)))
    got = license_scan.scan(frame(spark, [*docs, (500, None), (501, ""), docs[0]])).collect()
    assert {(r.doc_id, r.license) for r in got} == set(planted.items())
    texts = dict(docs)
    for r in got:
        assert r.containment >= 0.8 and 0 <= r.byte_start < r.byte_end <= len(texts[r.doc_id].encode())
    assert sum(r.doc_id == 0 for r in got) == 2
    assert license_scan.scan(frame(spark, docs), templates=()).count() == 0 == license_scan.scan(spark.createDataFrame([], SCHEMA)).count()


def test_license_odd_input(spark):
    """A very long text, the same notice twice, equal containment of overlapping windows, clashing columns."""
    rng = __import__("random").Random(3)
    name, text = license_scan.TEMPLATES[0]
    long = brute.prose(rng, 40_000) + " " + text + " " + brute.prose(rng, 20)
    docs = [(1, long), (2, f"{text} {text}"), (2, f"{text} {text}")]
    wide = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, license string, containment int")
    got = license_scan.scan(wide).where(F.col("license") == name).collect()
    assert {r.doc_id for r in got} == {1, 2} and sum(r.doc_id == 1 for r in got) == 1
    start = len(long[:long.index(text)].encode())
    assert 0 <= start - next(r for r in got if r.doc_id == 1).byte_start < 20
    twice = [(r.byte_start, r.byte_end) for r in got if r.doc_id == 2]
    assert len(twice) % 2 == 0 and sorted(twice) == sorted([t for t in set(twice) for _ in range(2)])


def test_license_bands_find_what_brute_force_finds():
    rng = __import__("random").Random(2)
    templates = license_scan.prepare(license_scan.TEMPLATES)
    texts = []
    for _ in range(300):
        _, text = rng.choice(license_scan.TEMPLATES)
        w = text.split(" ")
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = "other"
        texts.append(brute.prose(rng, 40) + " " + " ".join(w) + " " + brute.prose(rng, 30))
    data, offsets = kernels.text_bytes(pa.array(texts))
    got = {(d, t) for d, t, *_ in license_scan.scan_texts(data, offsets, templates, 0.8)}
    _, _, bounds, h = license_scan._words(data, offsets)
    want = set()
    for t in templates:
        doc, first, end = license_scan._windows(bounds, t.m, t.q, t.stride)
        for d, a, b in zip(doc, first, end):
            g = kernels.ngram_hashes(h[a:b], np.array([0, b - a]), t.q)[0]
            if np.isin(t.shingles, g).mean() >= 0.8:
                want.add((int(d), t.number))
    assert got <= want and len(got) >= 0.99 * len(want) > 100


# 9 decontamination

ITEMS = [(1, "The quick brown fox jumps over the lazy dog again and again today"), (2, "short item"), (3, None), (4, ""), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "another short item"), (10, "quick brown fox jumps over the lazy dog again and"), (11, "w1"), (12, "... !!")]


@pytest.mark.parametrize("few", [decontaminate.BROADCAST_TEXTS, 0])
def test_contamination(spark, few):
    rng = __import__("random").Random(4)
    extra = [(200, "x THE Quick, brown fox-jumps over the lazy dog again and again tomorrow"), (201, "a short item here; another short item"), (202, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (203, "alpha beta gamma delta epsilon zeta eta theta iota"), (204, "short"), (205, "é short\x00item ü")]
    docs = DOCS + extra + [(300 + i, brute.prose(rng, 15) + " " + ITEMS[0][1]) for i in range(5)]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination_report(frame(spark, docs), bench, few=few)
    assert rows(got.drop("items")) == sorted(((i, *brute.contamination(t, ITEMS)) for i, t in docs), key=repr)


def test_one_benchmark_text_under_many_ids(spark):
    body = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(i, body) for i in range(500)] + [(1000, "twelve")], "item_id long, text string")
    docs = [(1, f"x {body} y"), (2, "nothing"), (3, "one two three four five six seven eight nine"), (4, f"{body} {body} twelve")]
    got = {r.doc_id: r for r in decontaminate.contamination_report(frame(spark, docs), bench).collect()}
    assert (got[1].n_items, got[1].n_hit) == (500, 11) and got[2].n_items == got[3].n_items == 0
    assert (got[4].n_items, got[4].n_hit) == (501, 23) and got[4].items == sorted(map(str, [*range(500), 1000]))


def test_contamination_keeps_clashing_columns(spark):
    docs = frame(spark, DOCS).withColumns({"spans": F.lit("s"), "ITEMS": F.lit(2), "n_words": F.lit(None).cast("string")})
    out = decontaminate.find_contamination(docs, spark.createDataFrame([], "item_id long, text string"))
    assert out.columns == ["doc_id", "text", "spans", "ITEMS", "n_words", "_n_words", "_spans", "_items"]
    assert out.where("size(_spans) > 0").count() == 0 and out.count() == len(DOCS)
    assert decontaminate.find_contamination(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
