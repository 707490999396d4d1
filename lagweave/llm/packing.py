"""Best-fit packing of token pieces into sequences with several capacities.

A document's ids, closed by an end id, are cut into pieces of at most `capacity` tokens. A piece asks for (tokens, one
document, attention cost = tokens squared); a sequence offers capacities of all three. Pieces go, largest first, into
the open sequence that fits best under every constraint: the smallest weighted norm of what would be left, or the
largest weighted dot product of demand and residual; a new sequence opens where none fits.

Pieces of one length ask for the same vector, so the plan needs only their histogram (at most `capacity` rows): equal
sequences are handled as one class with a count, and a placement says that ranks r0... of a length go into sequences
s0... of a class. Spark numbers pieces within each length over even hash blocks and looks their rank up, so neither a
common length nor the number of documents meets in one place. The plan has at most a few placements for each length
and class, independent of the number of pieces.

Null texts are empty and still give the end id. Repeated documents are packed each. An empty table gives no sequences.
Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from lagweave.core.session import cut_lineage
from lagweave.llm import kernels as K
from lagweave.llm.chunk_encoder import ChunkEncoder
from lagweave.llm.worker import kept

CAPACITY, END_ID = 2048, 0
PIECES_PER_BLOCK = 20_000


def piece_maker(path: str, capacity: int, end_id: int, with_ids: bool) -> Callable:
    """Task function: (doc_id, text) to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("chunks", path, end_id), lambda: ChunkEncoder(path, end_id))
        for batch in batches:
            for rows, data, offsets in K.text_slices(batch, "text"):
                ids, bounds = encoder.encode(data, offsets)
                n = np.diff(bounds)
                many = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), many)
                piece = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                first = bounds[doc] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * (a + b)]) for a, b in zip(first.tolist(), length.tolist())]
                columns = [rows.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(K.lists(ids.astype(np.int64), np.append(first, bounds[-1]), pa.int64()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        K.release_memory()

    return run


def make_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of each piece."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(piece_maker(path, capacity, end_id, with_ids), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


@dataclass
class Plan:
    """Placements, sorted by (length, r0): ranks r0 + i*copies + j of a length go into sequence s0 + i at offset + j*length."""

    length: np.ndarray
    r0: np.ndarray
    copies: np.ndarray
    s0: np.ndarray
    offset: np.ndarray
    sequences: int


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None,
                  weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm") -> Plan:
    """Vector best fit, decreasing, over classes of equal sequences. Residuals are compared as shares of their capacity.
    `rule`: "norm" (smallest weighted norm of the new residual) or "dot" (largest weighted dot product)."""
    caps = np.array([capacity, max_docs or capacity, max_cost or capacity * capacity], np.int64)
    share = np.array(weights) / (caps.astype(float) ** 2)
    free = np.zeros((64, 3), np.int64)
    count, first = np.zeros(64, np.int64), np.zeros(64, np.int64)
    used, opened = 0, 0
    rows: list[tuple[int, int, int, int, int]] = []

    def add(residual: np.ndarray, n: int, s0: int) -> None:
        nonlocal free, count, first, used
        if n <= 0 or residual[0] <= 0 or residual[1] <= 0:
            return
        if used == len(count):
            gone = np.flatnonzero(count[:used] > 0)
            free[:len(gone)], count[:len(gone)], first[:len(gone)] = free[gone], count[gone], first[gone]
            used = len(gone)
            count[used:] = 0
            if used > len(count) // 2:
                free, count, first = np.vstack([free, np.zeros_like(free)]), np.append(count, np.zeros_like(count)), np.append(first, np.zeros_like(first))
        free[used], count[used], first[used] = residual, n, s0
        used += 1

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        need = np.array([length, 1, length * length], np.int64)
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens fits into no sequence")
        while left:
            fits = np.flatnonzero((count[:used] > 0) & (free[:used] >= need).all(axis=1))
            if len(fits):
                rest = free[fits]
                score = ((rest - need) ** 2 * share).sum(axis=1) if rule == "norm" else -(rest * need * share).sum(axis=1)
                k = fits[np.lexsort((first[fits], score))[0]]
                residual, n, s0 = free[k].copy(), int(count[k]), int(first[k])
            else:
                k, residual, n, s0 = -1, caps, left, opened
            each = int((residual // need).min()) if rule == "norm" or k < 0 else 1
            each = min(each, left)
            bins = min(n, left // each)
            rows.append((length, rank, each, s0, int(capacity - residual[0])))
            if k < 0:
                opened += bins
            else:
                count[k] -= bins
                first[k] += bins
            add(residual - each * need, bins, s0)
            left -= bins * each
            rank += bins * each
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(cols[0], cols[1], cols[2], cols[3], cols[4], opened)


def placer(plan: Plan) -> Callable:
    """Task function: adds sequence_id and offset from length and rank."""
    keys = (plan.length << 44) | plan.r0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b["length"].to_numpy(np.int64), b.pop("rank").to_numpy(np.int64)
            at = np.searchsorted(keys, (length << 44) | rank, "right") - 1
            i = rank - plan.r0[at] if len(at) else rank
            b["sequence_id"] = plan.s0[at] + i // plan.copies[at]
            b["offset"] = plan.offset[at] + i % plan.copies[at] * length
            yield b

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, pieces_per_block: int = PIECES_PER_BLOCK, **limits) -> DataFrame:
    """Pieces (with any columns beside doc_id, piece, length) plus sequence_id and offset. `pieces` is read twice; cut its
    lineage first if it is costly. `limits`: max_docs, max_cost, weights, rule of `plan_best_fit`."""
    totals = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_best_fit(totals, capacity, **limits)
    blocks = max(1, sum(totals.values()) // pieces_per_block)
    df = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    sums = df.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("length").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    shift = sums.select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = W.partitionBy("length", "_block").orderBy("doc_id", "piece")
    ranked = df.withColumn("_rn", F.row_number().over(inside)).join(shift, ["length", "_block"]).select(
        *pieces.columns, (F.col("_rn") - 1 + F.col("_shift")).alias("rank"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInPandas(placer(plan), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Piece table with its places. Texts are tokenized once; the pieces' lengths and digests are kept, not their ids."""
    return pack(cut_lineage(make_pieces(docs, path, capacity, end_id, False, doc_id, text)), capacity, **limits)


def sequences(placed: DataFrame, pieces_with_ids: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_starts: the packed token rows. A group holds one sequence, so at most its capacity. Needs
    unique document ids."""
    rows = placed.select("doc_id", "piece", "sequence_id", "offset").join(pieces_with_ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["offset"]).alias("doc_starts"))
