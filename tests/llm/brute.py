"""Plain Python versions of the operators, and small documents with every odd case."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def quality(text: str | None) -> tuple:
    text = text or ""
    w = SPACED.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def shingles(text: str | None, q: int = 3) -> frozenset:
    w = SPACED.findall(lower(text or ""))
    return frozenset(tuple(w[i:i + q]) for i in range(len(w) - q + 1)) if len(w) >= q else frozenset([tuple(w)] if w else [])


def components_of(sets: dict, percent: int) -> dict:
    """id -> smallest linked id."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def components(docs: list[tuple], percent: int = 90) -> dict:
    """doc_id -> (shingles, smallest linked id)."""
    sets = {i: shingles(t) for i, t in docs if i is not None}
    return {i: (len(sets[i]), c) for i, c in components_of(sets, percent).items()}


def repeats(docs: list[tuple], size: int = 50) -> list[tuple]:
    """(doc_id, bytes, removed, spans, digest) of each row; a null id is the largest."""
    key = lambda i: float("inf") if i is None else i
    first: dict[bytes, float] = {}
    for i, t in docs:
        t = (t or "").encode()
        for k in range(len(t) - size + 1):
            w = t[k:k + size]
            first[w] = min(first.get(w, float("inf")), key(i))
    out = []
    for i, t in docs:
        t = (t or "").encode()
        covered = bytearray(len(t))
        for k in range(len(t) - size + 1):
            if first[t[k:k + size]] < key(i):
                covered[k:k + size] = b"\1" * size
        runs = len(bytes(covered).replace(b"\0", b" ").split())
        out.append((i, len(t), sum(covered), runs, hashlib.sha256(bytes(b for b, c in zip(t, covered) if not c)).hexdigest()))
    return out


def contamination(text: str | None, items: list[tuple], n: int = 10) -> tuple:
    w = ITEM.findall(lower(text or ""))
    hit, found = set(), set()
    for item, body in items:
        b = ITEM.findall(lower(body or ""))
        m = min(n, len(b))
        windows = {tuple(b[i:i + m]) for i in range(len(b) - m + 1)} if m else set()
        for i in range(len(w) - m + 1):
            if m and tuple(w[i:i + m]) in windows:
                hit.update(range(i, i + m))
                found.add("" if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def corpus(seed: int = 5) -> list[tuple]:
    """(doc_id, text): prose with copies, near copies, shared passages, nulls, blanks, a long text and repeated rows."""
    rng = random.Random(seed)
    docs = [(i, prose(rng, rng.randrange(3, 160))) for i in range(40)]
    base = prose(rng, 120, 5000)
    for i in range(40, 60):
        w = base.split(" ")
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        docs.append((i, " ".join(w)))
    passage = "Élan — " + prose(rng, 30, 9000)
    docs += [(60 + i, prose(rng, 20) + passage + prose(rng, 5)) for i in range(6)]
    docs += [(70, None), (71, ""), (72, " \t\n"), (73, "one"), (74, "One two"), (75, "one TWO"), (76, "a b c"), (77, "ab " * 400), (78, prose(rng, 30_000, 50)), (79, docs[5][1])]
    return docs + [docs[6], docs[6], (None, None), (None, prose(rng, 40))]
