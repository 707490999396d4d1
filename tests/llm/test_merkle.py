"""Merkle manifest against a plain Python tree."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lagweave.llm import merkle
from lagweave.llm.common import ascii_lower
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text) -> str:
    i, _, lang, source, n = row
    return H("".join(map(field, (i, source, lang, n, text))))


def climb(nodes: list[str], fanout: int) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """The top and, for each node, its siblings (before, after) level by level."""
    paths: list[list] = [[] for _ in nodes]
    below = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, joined = [], []
        for a in range(0, len(nodes), fanout):
            run = nodes[a:a + fanout]
            for j in range(len(run)):
                for k in below[a + j]:
                    paths[k].append((run[:j], run[j + 1:]))
            up.append(H("".join(run)))
            joined.append([k for b in below[a:a + fanout] for k in b])
        nodes, below = up, joined
    return nodes[0], paths


def expected(rows: list[tuple], fanout: int = 8) -> list[tuple]:
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    parts = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        parts[lang] = mine, *climb([leaf(r, r[1]) for r in mine], fanout)
    root, over = climb([parts[x][1] for x in langs], fanout)
    out = []
    for lang, above in zip(langs, over):
        mine, subroot, paths = parts[lang]
        for r, path in zip(mine, paths):
            path = path + above
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf(r, brute.lower(r[1]) if changed and r[1] is not None else r[1])
            for a, b in path:
                h = H("".join((*a, h, *b)))
            out.append((r[0], leaf(r, r[1]), subroot, root, H("".join("".join((*a, *b)) for a, b in path)), h, h == root))
    return sorted(out, key=repr)


def report(df, **how):
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    out = merkle.verification_report(df, tamper, ascii_lower(F.col("text")), **how)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def corpus(n: int = 150) -> list[tuple]:
    rng = random.Random(9)
    langs = ["en", "en", "en", None, "Ünë", "de", "e"]
    rows = [(i * 3, f"Text {i} " + brute.prose(rng, 4).upper(), langs[rng.randrange(7)], rng.choice(["a", None, "bé"]), rng.choice([None, i])) for i in range(n)]
    rows += [(9_000, "alone A", "fr", "s", 1), (9_001, None, "en", None, None), (9_002, "", "en", "", 0), (9_003, "L" * 200_000, "de", "x", 5)]
    return rows + [(9_004, "two", "x1", "s", 1), (9_005, "TWO", "x1", "s", 1)]


@pytest.mark.parametrize("fanout", [8, 2])
def test_proofs(spark, fanout, monkeypatch):
    monkeypatch.setattr(merkle.ranked, "__defaults__", (40,))
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("group", "leaf", "key", "idx", "n")}).repartition(5)
    assert report(df, fanout=fanout) == expected(rows, fanout)


def test_repeated_rows_and_ids(spark):
    rows = corpus(30)
    rows += [rows[0]] * 70 + [(rows[0][0], "other", "en", "s", 1), (None, "no id", "en", "s", 1), (None, "no id", "en", "s", 1), (None, None, None, None, None)]
    assert report(spark.createDataFrame(rows, SCHEMA).repartition(3)) == expected(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_one_group_of_any_size(spark, n):
    rows = [(i, f"T{i}", "en", "s", i) for i in range(n)]
    assert report(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_many_groups(spark):
    rows = [(i, f"T{i}", f"l{i % 20}", "s", i) for i in range(50)]
    assert report(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_single_requests_and_shared_records(spark):
    rows = spark.createDataFrame([("g", i % 2, merkle_leaf) for i, merkle_leaf in enumerate([H("x")] * 64 + [H("y")])], "group string, key long, leaf string")
    m = merkle.manifest(rows, "key")
    assert m.tree.records.count() < 9
    some = m.leaves.where("idx in (0, 64)")
    got = {r.idx: r for r in merkle.proofs(m, some).withColumn("root", merkle.fold(F.col("leaf"), F.col("segments"))).collect()}
    assert sorted(got) == [0, 64] and {r.root for r in got.values()} == {m.root}
    assert all(r.on_path == r.leaf for r in got.values())


def test_nothing(spark):
    assert report(spark.createDataFrame([], SCHEMA)) == []
