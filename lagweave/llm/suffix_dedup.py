"""Removal of long repeats, found by a hash-compared suffix sort.

Every byte covered by a string of `size` bytes that also starts in a document with a smaller id goes. The strings are
judged on the input; overlaps count; matches never cross documents.

Candidates. Each `size`-byte window has an anchor: its `GRAM`-byte gram of least hash (the leftmost of equals), so equal
windows have equal anchors at equal places, and a run of windows shares one. Documents lie in hash blocks of bounded
size. Blocks send the distinct hashes of their anchors to hash buckets, which answer with a bit each: seen in another
block or not. Blocks then send the context (all windows of the run) of repeated anchors only, one for each distinct
content, with the smallest document that has it; other documents of the block with the same content are settled there.

Sort. A bucket first merges equal contexts of different blocks. The windows of the others are suffixes of the bucket's
bytes: a radix sort by words of eight bytes orders the suffixes of each anchor and place, so that a frequent anchor costs
little more for each suffix than a rare one. Prefix polynomial hashes give the hash of any span, and a binary search over
lengths the common extension of two neighbours; those with one of `size` bytes are one class once their bytes agree (else
the bucket is sorted by its bytes). A window is removed where its class has a smaller document.

Scale. A copy group sends one context for each block and content, whatever its size. An anchor that stands in more than
`HEAVY_BLOCKS` blocks is dealt by the hash of each single window instead, so that it is spread over all buckets.
The blocks' texts are shuffled once and read three times (the exchange is reused).

Null texts are empty. A null id is larger than all others. Rows that share an id never remove each other's text. Short
texts have no window and stay whole. An empty table gives an empty result. Ids are whole numbers. `remove_repeats` keeps
all input columns; its helper columns are renamed where they would clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagweave.llm import kernels as K
from lagweave.llm.common import scratch

SIZE, GRAM = 50, 20
BLOCK_BYTES, BUCKET_BYTES, SLICE_BYTES, HEAVY_BLOCKS = 4 << 20, 2 << 20, 1 << 18, 4096
NO_ID = np.iinfo(np.int64).max


def _runs(data: np.ndarray, offsets: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """All windows as runs with one anchor: (text, first window, number of windows, anchor's place, anchor's hash)."""
    n, reach = len(data), size - gram + 1
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none, none, np.zeros(0, np.uint64)
    sums = K.prefix_hashes(data)
    at = np.arange(n - gram + 1)
    h = K.mixed(K.window_hashes(sums, gram))
    key = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    low, have = key, 1
    while 2 * have <= reach:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < reach:
        low = np.minimum(low[:len(low) - (reach - have)], low[reach - have:])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(doc)) + np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)
    anchor = anchor[start]
    new = np.ones(len(doc), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(doc)))
    # Least hashes crowd at the low end; mixed anew they spread over all buckets.
    return doc[first], start[first], many, anchor[first], K.mixed(h[anchor[first]] + np.uint64(K.STEPS[4]))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by range of the hash, so that sorted hashes lie in bucket order."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _split(sorted_hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of the buckets that have any."""
    edges = np.searchsorted(bucket_of(sorted_hashes, buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, int(edges[b]), int(edges[b + 1])


def anchor_sender(block_column: str, text: str, size: int, gram: int, buckets: int) -> Callable:
    """Task function over the dealt rows: distinct anchor hashes of each block, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for rows, data, offsets in K.text_slices(batch, text, SLICE_BYTES):
                doc, _, _, _, h = _runs(data, offsets, size, gram)
                block = rows.column(rows.schema.get_field_index(block_column)).to_numpy()[doc]
                for b in np.unique(block).tolist():
                    held.setdefault(b, []).append(K.distinct(h[block == b]))
        for block, parts in held.items():
            h = K.distinct(np.concatenate(parts))
            found = list(_split(h, buckets))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _, _ in found], pa.int32()), pa.array([block] * len(found), pa.int32()), pa.array([h[x:y].tobytes() for _, x, y in found], pa.binary())],
                names=["bucket", "block", "hashes"])
        held.clear()
        K.release_memory()

    return run


def answerer(heavy_blocks: int) -> Callable:
    """Task function over whole buckets of (bucket, block, hashes): for each row, which hashes stand in another block
    and which in very many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b, k, np.frombuffer(h, np.uint64)) for batch in batches for b, k, h in zip(*(c.to_pylist() for c in batch.columns))]
        rows.sort(key=lambda r: r[0])
        at = 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end][0] == rows[at][0]:
                end += 1
            h = np.concatenate([r[2] for r in rows[at:end]])
            _, back, many = np.unique(h, return_inverse=True, return_counts=True)
            many = many[back]
            edges = np.cumsum([0, *(len(r[2]) for r in rows[at:end])])
            bits = [[np.packbits(test[x:y]).tobytes() for x, y in zip(edges[:-1], edges[1:])] for test in (many > 1, many > heavy_blocks)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows[at:end]], pa.int32()), pa.array([r[1] for r in rows[at:end]], pa.int32()), pa.array(bits[0], pa.binary()), pa.array(bits[1], pa.binary())],
                names=["bucket", "block", "repeated", "heavy"])
            at = end

    return run


def _ordered(block: pa.Table, ids: str, text: str) -> tuple[pa.Table, np.ndarray]:
    """The block's rows in an order that only their content decides, and their ids."""
    number = block.column(ids).cast(pa.int64()).combine_chunks().fill_null(NO_ID)
    order = pc.sort_indices(pa.table({"id": number, "text": block.column(text)}), [("id", "ascending"), ("text", "ascending")])
    return block.take(order).combine_chunks(), number.take(order).to_numpy()


def _same_rows(keys: list[np.ndarray]) -> np.ndarray:
    """Order by the keys; a number for each distinct combination, in that order. Returns (order, class of ordered)."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, np.cumsum(new)


MESSAGE = "bucket int, block int, kind int, body binary"
CONTEXT = np.dtype([("h", "<u8"), ("c", "<u8"), ("id", "<i8"), ("row", "<i4"), ("start", "<i4"), ("windows", "u1"), ("place", "u1")])
COVER = np.dtype([("row", "<i4"), ("start", "<i4"), ("length", "<i4")])


def _message(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) or [(), (), (), ()]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("bucket", "block", "kind", "body"), cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))})


def _pack(made: np.ndarray, text: bytes = b"") -> bytes:
    """Rows of CONTEXT (column by column) and the bytes of their contexts, compressed."""
    body = b"".join(np.ascontiguousarray(made[n]).tobytes() for n in CONTEXT.names)
    return np.uint32(len(made)).tobytes() + zlib.compress(body + text, 1)


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    made = np.zeros(int(np.frombuffer(body, "<u4", 1)[0]), CONTEXT)
    raw, at = zlib.decompress(body[4:]), 0
    for n in CONTEXT.names:
        made[n] = np.frombuffer(raw, CONTEXT[n], len(made), at)
        at += len(made) * CONTEXT[n].itemsize
    return made, np.frombuffer(raw, np.uint8, offset=at)


def context_sender(ids: str, text: str, size: int, gram: int, buckets: int) -> Callable:
    """Group function over a block and the answers to it: contexts of repeated anchors by bucket (kind 0), and what is
    settled inside the block (kind 1)."""

    def run(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        number = key[0].as_py()
        K.release_memory()
        if not block.num_rows:
            return _message([])
        table, doc_ids = _ordered(block, ids, text)
        data, offsets = K.text_bytes(table.column(text))
        slices, parts = list(K.row_slices(np.diff(offsets), SLICE_BYTES)), []
        for a, b in slices:
            part = data[offsets[a]:offsets[b]]
            doc, start, many, place, h = _runs(part, offsets[a:b + 1] - offsets[a], size, gram)
            content = K.mixed(K.span_hashes(K.prefix_hashes(part), start, start + many + size - 1) + many.astype(np.uint64))
            parts.append((doc + a, start + offsets[a], many, place + offsets[a], h, content))
        doc, start, many, place, h, content = (np.concatenate(x) for x in zip(*parts))
        seen = K.distinct(h)
        flags = {b: (r, v) for b, r, v in zip(*(answers.column(c).to_pylist() for c in ("bucket", "repeated", "heavy")))}
        repeated, heavy = np.zeros(len(seen), bool), np.zeros(len(seen), bool)
        for b, x, y in _split(seen, buckets):
            for out, raw in zip((repeated, heavy), flags[b]):
                out[x:y] = np.unpackbits(np.frombuffer(raw, np.uint8), count=y - x).astype(bool)
        index = np.searchsorted(seen, h)
        low, high = np.full(len(seen), NO_ID), np.full(len(seen), -NO_ID)
        np.minimum.at(low, index, doc_ids[doc])
        np.maximum.at(high, index, doc_ids[doc])
        repeated |= low < high
        keep = repeated[index]
        heavy = heavy[index]
        singles = [x for a, b in slices for x in _single_windows(data[offsets[a]:offsets[b]], offsets[a], keep & heavy & (doc >= a) & (doc < b), doc, start, many, size)]
        keep &= ~heavy
        parts = [(doc[keep], start[keep], many[keep], place[keep], h[keep], content[keep]), *singles]
        doc, start, many, place, h, content = (np.concatenate(x) for x in zip(*parts))
        if not len(doc):
            return _message([])
        made = np.zeros(len(doc), CONTEXT)
        made["h"], made["c"], made["id"], made["row"] = h, content, doc_ids[doc], doc
        made["start"], made["windows"], made["place"] = start - offsets[doc], many, place - start
        order, group = _same_rows([made["h"], made["c"], made["id"], made["row"], made["start"]])
        made, start = made[order], start[order]
        first = np.ones(len(made), bool)
        first[1:] = (made["h"][1:] != made["h"][:-1]) | (made["c"][1:] != made["c"][:-1])
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        settled = made["id"] > made["id"][lead]
        rows = [(number, number, 1, _covers(made[settled], size).tobytes())] if settled.any() else []
        made, start = made[~settled], start[~settled]
        same = np.zeros(len(made), bool)
        same[1:] = (made["h"][1:] == made["h"][:-1]) & (made["c"][1:] == made["c"][:-1])
        extra = made[same]
        if len(extra):
            rows += [(b, number, 2, _pack(extra[x:y])) for b, x, y in _split(extra["h"], buckets)]
        made, start = made[~same], start[~same]
        width = made["windows"].astype(np.int64) + size - 1
        for b, x, y in _split(made["h"], buckets):
            w = width[x:y]
            at = np.repeat(start[x:y], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            rows.append((b, number, 0, _pack(made[x:y], data[at].tobytes())))
        return _message(rows)

    return run


def _single_windows(data: np.ndarray, shift: int, chosen: np.ndarray, doc: np.ndarray, start: np.ndarray, many: np.ndarray, size: int) -> list[tuple]:
    """The windows of the chosen runs, each as a run of its own whose anchor is the window itself."""
    if not chosen.any():
        return []
    n = many[chosen]
    at = np.repeat(start[chosen] - shift, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    h = K.mixed(K.span_hashes(K.prefix_hashes(data), at, at + size) + np.uint64(1))
    return [(np.repeat(doc[chosen], n), at + shift, np.ones(len(at), np.int64), at + shift, h, h)]


def _covers(made: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(made), COVER)
    out["row"], out["start"], out["length"] = made["row"], made["start"], made["windows"].astype(np.int32) + size - 1
    return out


def common_extension(sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to `most`, by binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), most)
    power = K.powers(len(sums))[1]
    pa_, pb = power[a], power[b]
    sa, sb = sums[a], sums[b]
    for _ in range(most.bit_length()):
        middle = (low + high + 1) >> 1
        same = (sums[a + middle] - sa) * pa_ == (sums[b + middle] - sb) * pb
        low = np.where(same, middle, low)
        high = np.where(same, high, middle - 1)
    return low


def _words(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The `width` bytes (eight at most) at each place as one number that orders as they do."""
    out = np.zeros((len(at), 8), np.uint8)
    out[:, :width] = np.lib.stride_tricks.sliding_window_view(data, width)[at]
    return out.view(">u8").ravel().astype(np.uint64)


def suffix_sort(data: np.ndarray, sums: np.ndarray, at: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes inside each group (groups are contiguous and ascending) by their first `most` bytes: a radix
    sort by words of eight bytes, first words first, of those suffixes only that are not alone with the words so far."""
    order, live, part = np.arange(len(at)), np.arange(len(at)), group
    width = min(8, most)
    for skip in (0, *range(width, most - width, width), most - width) if most > width else (0,):
        new = np.ones(len(live) + 1, bool)
        new[1:-1] = part[1:] != part[:-1]
        several = ~(new[:-1] & new[1:])
        live, part = live[several], np.cumsum(new[:-1])[several]
        if not len(live):
            break
        rows = order[live]
        word = _words(data, at[rows] + skip, width)
        by = np.lexsort((word, part))
        order[live], word = rows[by], word[by]
        # A new part begins with each new word; parts stay where they are, so `part` needs no reordering.
        part = part + np.cumsum(np.concatenate(([False], word[1:] != word[:-1])))
    return order


def equal_windows(data: np.ndarray, at: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    """A class number for each window: equal numbers for equal bytes (and group)."""
    sums = K.prefix_hashes(data)
    order = suffix_sort(data, sums, at, group, size)
    a, b = at[order[1:]], at[order[:-1]]
    joined = (group[order[1:]] == group[order[:-1]]) & (common_extension(sums, a, b, size) >= size)
    view = np.lib.stride_tricks.sliding_window_view(data, size)
    for x in range(0, len(a), 1 << 16):
        part = np.flatnonzero(joined[x:x + (1 << 16)]) + x
        if (view[a[part]] != view[b[part]]).any():
            rows = np.concatenate((group[:, None].astype(">i8").view(np.uint8).reshape(len(at), -1), view[at]), axis=1)
            return np.unique(rows, axis=0, return_inverse=True)[1].ravel()
    out = np.empty(len(at), np.int64)
    out[order] = np.concatenate((np.zeros(min(1, len(at)), np.int64), np.cumsum(~joined)))
    return out


def sorter(size: int) -> Callable:
    """Task function over whole buckets of messages: covered spans for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            passed = []
            for bucket, block, kind, body in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 1:
                    passed.append((block, body))
                else:
                    held.setdefault(bucket, []).append((block, kind, body))
            if passed:
                yield _cover_rows(passed)
        for bucket in list(held):
            found = _sort_bucket(held.pop(bucket), size)
            if found:
                yield _cover_rows(found)
        K.release_memory()

    return run


def _cover_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "covers"])


def _sort_bucket(messages: list[tuple[int, int, bytes]], size: int) -> list[tuple[int, bytes]]:
    made, texts, blocks, extra, extra_blocks = [], [], [], [], []
    while messages:
        block, kind, body = messages.pop()
        x, text = _unpack(body)
        if kind == 2:
            extra.append(x)
            extra_blocks.append(np.full(len(x), block))
            continue
        made.append(x)
        texts.append(text)
        blocks.append(np.full(len(x), block))
    data = np.concatenate(texts)
    del texts, text
    made, block = np.concatenate([*made, *extra]), np.concatenate([*blocks, *extra_blocks])
    width = made["windows"].astype(np.int64) + size - 1
    bare = np.zeros(len(made), bool)
    bare[len(made) - sum(map(len, extra)):] = True
    begin = np.where(bare, -1, np.cumsum(np.where(bare, 0, width)) - width)
    order = np.lexsort((bare, made["id"], made["c"], made["h"]))
    made, block, begin, width = made[order], block[order], begin[order], width[order]
    first = np.ones(len(made), bool)
    first[1:] = (made["h"][1:] != made["h"][:-1]) | (made["c"][1:] != made["c"][:-1])
    kind_of = np.cumsum(first) - 1
    lead = np.flatnonzero(first)
    out = _by_block(block, made, made["id"] > made["id"][lead][kind_of], size)
    own = np.flatnonzero(made["id"] == made["id"][lead][kind_of])
    # Windows of one context for each content; its bytes may belong to any row that sent them.
    has = np.full(len(lead), -1)
    with_bytes = np.flatnonzero(begin >= 0)
    has[kind_of[with_bytes][::-1]] = begin[with_bytes][::-1]
    m = made[lead]
    many = m["windows"].astype(np.int64)
    context = np.repeat(np.arange(len(m)), many)
    j = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    anchor = np.cumsum(np.concatenate(([False], m["h"][1:] != m["h"][:-1])))
    group = anchor[context] * 256 + (m["place"].astype(np.int64)[context] - j)
    order = np.argsort(group, kind="stable")
    group, context, j = group[order], context[order], j[order]
    alone = np.ones(len(group), bool)
    alone[1:] &= group[1:] != group[:-1]
    alone[:-1] &= group[1:] != group[:-1]
    group, context, j = group[~alone], context[~alone], j[~alone]
    if len(group):
        data, has = _needed(data, has, many + size - 1, np.unique(context))
        cls = equal_windows(data, has[context] + j, group, size)
        low = np.full(int(cls.max()) + 1, NO_ID)
        np.minimum.at(low, cls, m["id"][context])
        hit = m["id"][context] > low[cls]
        context, j = context[hit], j[hit]
        if len(context):
            # every row that shares the context's smallest id gets its windows' spans
            by = np.argsort(context, kind="stable")
            context, j = context[by], j[by]
            n_hits = np.bincount(context, minlength=len(m))
            starts_of = np.cumsum(n_hits) - n_hits
            mine = own[n_hits[kind_of[own]] > 0]
            many = n_hits[kind_of[mine]]
            row = np.repeat(mine, many)
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts_of[kind_of[mine]], many)
            spans = made[row].copy()
            spans["start"] += j[at].astype(np.int32)
            spans["windows"] = 1
            out += _by_block(block[row], spans, np.ones(len(row), bool), size)
    return out


def _needed(data: np.ndarray, begin: np.ndarray, width: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the chosen contexts only, and where each of these begins."""
    w = width[chosen]
    place = np.cumsum(w) - w
    out = np.full(len(begin), -1)
    out[chosen] = place
    at = np.arange(w.sum())
    at += np.repeat(begin[chosen] - place, w)
    return data[at], out


def _by_block(block: np.ndarray, made: np.ndarray, chosen: np.ndarray, size: int) -> list[tuple[int, bytes]]:
    block, made = block[chosen], made[chosen]
    order = np.argsort(block, kind="stable")
    block, covers = block[order], _covers(made[order], size)
    edges = np.append(np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))), len(block)) if len(block) else np.zeros(0, np.int64)
    return [(int(block[x]), covers[x:y].tobytes()) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]


def removed_spans(covers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal covered runs."""
    c = covers[np.lexsort((covers["start"], covers["row"]))]
    row, start, end = c["row"].astype(np.int64), c["start"].astype(np.int64), c["start"].astype(np.int64) + c["length"]
    if not len(c):
        return row, start, end
    shift = row * (1 << 32)
    reach = np.maximum.accumulate(shift + end)
    new = np.ones(len(c), bool)
    new[1:] = shift[1:] + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return row[first], start[first], reach[np.append(first[1:], len(c)) - 1] - shift[first]


def finisher(ids: str, text: str, block: str, names: tuple[str, ...], schema: pa.Schema, cut: bool) -> Callable:
    """Group function over a block and its covered spans: all columns with the counts, and the text without the spans
    if `cut` (whole characters only)."""

    def run(key: tuple, rows: pa.Table, covers: pa.Table) -> pa.Table:
        K.release_memory()
        if not rows.num_rows:
            return schema.empty_table()
        table, _ = _ordered(rows, ids, text)
        data, offsets = K.text_bytes(table.column(text))
        spans = removed_spans(np.concatenate([np.zeros(0, COVER), *(np.frombuffer(x, COVER) for x in covers.column("covers").to_pylist())]))
        n = table.num_rows
        n_spans = np.bincount(spans[0], minlength=n)
        n_removed = np.bincount(spans[0], weights=spans[2] - spans[1], minlength=n).astype(np.int64)
        raw = data.tobytes()
        digests, texts = [], table.column(text).to_pylist() if cut else []
        at = 0
        for i in range(n):
            a, b = int(offsets[i]), int(offsets[i + 1])
            if not n_spans[i]:
                digests.append(hashlib.sha256(raw[a:b]).hexdigest())
                continue
            kept, chars, from_, from_char = [], [], a, a
            for _ in range(int(n_spans[i])):
                x, y = a + int(spans[1][at]), a + int(spans[2][at])
                at += 1
                kept.append(raw[from_:x])
                from_ = y
                while x < y and raw[x] & 0xC0 == 0x80:
                    x += 1
                while x < y < b and raw[y] & 0xC0 == 0x80:
                    y -= 1
                chars.append(raw[from_char:x])
                from_char = y
            digests.append(hashlib.sha256(b"".join((*kept, raw[from_:b]))).hexdigest())
            if cut:
                texts[i] = b"".join((*chars, raw[from_char:b])).decode()
        made = {names[0]: pa.array(np.diff(offsets)), names[1]: pa.array(n_removed), names[2]: pa.array(n_spans.astype(np.int64)), names[3]: pa.array(digests, pa.string())}
        if cut:
            made[text] = pa.array(texts, pa.string())
        return pa.table([made[f.name] if f.name in made else table.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


def added_names(docs: DataFrame) -> list[str]:
    """Names of the block column and of the four columns that `remove_repeats` adds to these documents."""
    return scratch(docs, "block", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM, cut: bool = True,
                   block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, heavy_blocks: int = HEAVY_BLOCKS) -> DataFrame:
    """All columns of `docs` with n_bytes, n_removed, n_spans, kept_sha256 (of the exact remaining bytes). With `cut` the
    text loses the removed spans, as far as whole characters lie in them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    block, *names = added_names(docs)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    buckets = max(1, -(-(total * 8 * 2 // (size - gram + 2)) // bucket_bytes))
    parts: Column = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(blocks)).cast("int")
    dealt = docs.withColumn(block, parts).repartition(blocks, block)
    sent = dealt.mapInArrow(anchor_sender(block, text, size, gram, buckets), "bucket int, block int, hashes binary")
    answers = sent.repartition(buckets, "bucket").mapInArrow(answerer(heavy_blocks), "bucket int, block int, repeated binary, heavy binary")
    messages = dealt.groupBy(block).cogroup(answers.groupBy("block")).applyInArrow(context_sender(doc_id, text, size, gram, buckets), MESSAGE)
    covers = messages.repartition(buckets, "bucket").mapInArrow(sorter(size), "block int, covers binary")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in names[:3]], T.StructField(names[3], T.StringType())])
    arrow = to_arrow_schema(schema)
    return dealt.groupBy(block).cogroup(covers.groupBy("block")).applyInArrow(finisher(doc_id, text, block, tuple(names), arrow, cut), schema)


def repeat_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return remove_repeats(rows, cut=False, **how).drop("text")
