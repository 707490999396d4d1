"""What task functions of the pipeline hold beside the rows that they are given."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from lagweave.llm import ngram_join as N
from lagweave.llm import suffix_dedup as S


def batch() -> pa.RecordBatch:
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(w)}" for w in rng.integers(0, 5000, 200)) for _ in range(3000)]
    return pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(texts), pa.array(np.zeros(3000, np.int32))], names=["doc_id", "text", "block"])


def peak_mb(run) -> float:
    tracemalloc.start()
    for _ in run():
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_tasks_hold_arrays_of_small_slices():
    rows = batch()
    assert rows.column("text").nbytes > 3 << 20
    level = np.zeros(N.COUNTERS, np.uint8)
    assert peak_mb(lambda: S.anchor_sender("block", "text", 50, 20, 4)(iter([rows]))) < 50
    assert peak_mb(lambda: N.profiler(5, level, (80, 100))(iter([rows]))) < 20


def test_sorter_reads_only_contexts_that_are_compared():
    data = np.frombuffer(b"aaabbbbccddddd", np.uint8)
    got, begin = S._needed(data, np.array([0, 3, 7, 9]), np.array([3, 4, 2, 5]), np.array([1, 3]))
    assert got.tobytes() == b"bbbbddddd" and begin.tolist() == [-1, 0, -1, 4]


def test_join_gives_back_what_the_driver_no_longer_needs(spark, monkeypatch):
    """A driver whose heap has grown past its share is collected at the join's lineage cuts."""
    from lagweave.core import session

    monkeypatch.setattr(session, "HEAP_SHARE", 0)
    jvm = spark.sparkContext._jvm
    left = jvm.java.lang.ref.WeakReference(jvm.java.util.ArrayList())
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "e f g h")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in N.ngram_components(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert left.get() is None
