"""Fixed-size arrays of counters that all tasks fill together.

A task sends its array in compressed chunks; reducers add (or combine) chunks as they stream in, first by (chunk, part),
then by chunk, so no reducer holds more than one array and the driver gets one array of fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNKS, PARTS = 16, 32
SCHEMA = "chunk int, part int, counts binary"


def send(counts: np.ndarray, part: int) -> pa.RecordBatch:
    """A task's array as rows of SCHEMA."""
    parts = [zlib.compress(np.ascontiguousarray(c).tobytes(), 1) for c in np.split(counts, CHUNKS)]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(CHUNKS), pa.int32()), pa.array([part % PARTS] * CHUNKS, pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "part", "counts"])


def _adder(kind: str, join: Callable) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, raw in zip(b["chunk"], b["counts"]):
                x = np.frombuffer(zlib.decompress(raw), kind)
                held[chunk] = join(held[chunk], x) if chunk in held else x
        yield pd.DataFrame({"chunk": list(held), "part": 0, "counts": [zlib.compress(x.tobytes(), 1) for x in held.values()]}).astype({"chunk": "int32", "part": "int32"})

    return run


def gather(sent: DataFrame, size: int, kind: str, join: Callable = np.add) -> np.ndarray:
    """The combined array of `size` counters of numpy type `kind`."""
    add = _adder(kind, join)
    rows = sent.repartition("chunk", "part").mapInPandas(add, SCHEMA).repartition("chunk").mapInPandas(add, SCHEMA).collect()
    out = np.zeros(size, kind)
    width = size // CHUNKS
    for r in rows:
        out[r["chunk"] * width:(r["chunk"] + 1) * width] = np.frombuffer(zlib.decompress(r["counts"]), kind)
    return out
