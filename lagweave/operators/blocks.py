"""Pair comparisons of token sets and paths that are folded where they are made.

Where almost every pair shares some token, no prefix or block key rules pairs out, and a table of candidate pairs is far
larger than what is wanted of them: a maximum or a sum per left row. Here both sides are dealt to even blocks within
their group, each left block meets each right block in one cell, and a cell compares its rows by NumPy in slices and
gives only its folded rows. A task holds one cell, whatever the size of the tables or of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.functions import paths as P

# Rows of a left and a right block, pairs that are held at a time, tokens that are counted at a time.
LEFT_ROWS, RIGHT_ROWS, HELD_PAIRS, HELD_TOKENS = 1024, 4096, 2 ** 19, 2048


def with_parts(df: DataFrame, path: str) -> DataFrame:
    """Adds the path's lower-cased segments `segs` and its tokens `toks`."""
    return df.withColumns({"segs": P.lower_segments(F.col(path)), "toks": P.path_tokens(F.col(path))})


def _numbered(left: pd.Series, right: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Row and number of every item of both columns of lists, and how many different items there are."""
    sizes = [np.array([len(x) for x in s], int) for s in (left, right)]
    items = [x for s in (left, right) for row in s for x in row]
    _, number = np.unique(np.array(items, dtype=str) if items else np.empty(0, str), return_inverse=True)
    rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
    cut = len(rows[0])
    return rows[0], number[:cut], rows[1], number[cut:], int(number.max(initial=-1)) + 1


class Sets:
    """Sizes of intersections of the left and right lists of distinct items."""

    def __init__(self, left: pd.Series, right: pd.Series) -> None:
        self.left_row, self.left_item, self.right_row, right_item, n = _numbered(left, right)
        self.n_left, self.n_right = np.array([len(x) for x in left], int), np.array([len(x) for x in right], int)
        # Only items of both sides can be common.
        both = np.zeros((2, n), bool)
        both[0, self.left_item], both[1, right_item] = True, True
        place = np.where(both.all(0), np.cumsum(both.all(0)) - 1, -1)
        self.n_items = int(both.all(0).sum())
        self.left_item, right_item = place[self.left_item], place[right_item]
        kept = right_item >= 0
        self.right_row, self.right_item = self.right_row[kept], right_item[kept]

    def common(self, rows: slice) -> np.ndarray:
        a = (self.left_row >= rows.start) & (self.left_row < rows.stop) & (self.left_item >= 0)
        row, item = self.left_row[a] - rows.start, self.left_item[a]
        out = np.zeros((rows.stop - rows.start, len(self.n_right)), np.float32)
        for at in range(0, self.n_items, HELD_TOKENS):
            width = min(HELD_TOKENS, self.n_items - at)
            x, y = np.zeros((len(out), width), np.float32), np.zeros((width, len(self.n_right)), np.float32)
            i, j = (item >= at) & (item < at + width), (self.right_item >= at) & (self.right_item < at + width)
            x[row[i], item[i] - at], y[self.right_item[j] - at, self.right_row[j]] = 1, 1
            out += x @ y
        return out.astype(float)

    def jaccard(self, rows: slice) -> np.ndarray:
        both = self.common(rows)
        union = self.n_left[rows, None] + self.n_right[None] - both
        return np.where(both > 0, both / np.maximum(union, 1), 0.0)


def _padded(row: np.ndarray, item: np.ndarray, sizes: np.ndarray, width: int, pad: int) -> np.ndarray:
    out = np.full((len(sizes), width), pad)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = item
    return out


def _walks(a: np.ndarray, n_a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of `a` (n_a items, then padding) is a subsequence of the same row of `b`."""
    at, row = np.zeros(len(a), int), np.arange(len(a))
    for k in range(b.shape[1]):
        at += (at < n_a) & (a[row, np.minimum(at, a.shape[1] - 1)] == b[:, k])
    return (n_a > 0) & (at == n_a)


class Paths:
    """`similarity_of_parts` of the left and right rows."""

    def __init__(self, left: pd.DataFrame, right: pd.DataFrame) -> None:
        self.tokens = Sets(left["toks"], right["toks"])
        row_a, a, row_b, b, _ = _numbered(left["segs"], right["segs"])
        self.n_a, self.n_b = (np.array([len(x) for x in df["segs"]], int) for df in (left, right))
        width = max(1, self.n_a.max(initial=0), self.n_b.max(initial=0))
        self.a, self.b = _padded(row_a, a, self.n_a, width, -1), _padded(row_b, b, self.n_b, width, -2)
        distinct = lambda s: s.map(lambda x: list(dict.fromkeys(x)))
        left_set, right_set = distinct(left["segs"]), distinct(right["segs"])
        self.segments = Sets(left_set, right_set)

    def similarity(self, rows: slice) -> np.ndarray:
        a, n_a = self.a[rows], self.n_a[rows]
        same, prefix = np.ones((len(a), len(self.b)), bool), np.zeros((len(a), len(self.b)))
        for k in range(a.shape[1]):
            same &= a[:, k, None] == self.b[None, :, k]
            prefix += same
        # A subsequence needs all segments of the shorter path in the other one.
        both, subseq = self.segments.common(rows), np.zeros(prefix.shape)
        for i, j in (np.nonzero((both == self.segments.n_left[rows, None]) & (both > 0)), np.nonzero((both == self.segments.n_right[None]) & (both > 0))):
            subseq[i, j] = np.maximum(subseq[i, j], _walks(a[i], n_a[i], self.b[j]) | _walks(self.b[j], self.n_b[j], a[i]))
        longest = np.maximum(n_a[:, None], self.n_b[None])
        score = P.TOKEN_WEIGHT * self.tokens.jaccard(rows) + P.PREFIX_WEIGHT * (prefix / np.maximum(longest, 1)) + P.SUBSEQUENCE_WEIGHT * subseq
        return np.where((n_a[:, None] == 0) | (self.n_b[None] == 0), 0.0, np.clip(score, 0.0, 1.0))


Fold = Callable[[pd.DataFrame, pd.DataFrame, Iterator[tuple[slice, np.ndarray]]], pd.DataFrame]


def fold_pairs(left: DataFrame, right: DataFrame, by: str, fold: Fold, schema: str, by_path: bool) -> DataFrame:
    """All rows that fold(left rows, right rows, slices) gives for the cells of all left and right rows with the same `by`.

    A slice is a range of left rows with their similarities to all right rows of the cell: path similarities if `by_path`
    (columns segs and toks), else token similarities (column toks). A left row occurs in as many cells as its group has
    right blocks, so what is folded is folded again by the caller. Null is a group as well.
    """
    def sized(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy(F.col(by).alias(f"_{name}")).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        sizes = n_left.join(n_right, F.col("_n_left").eqNullSafe(F.col("_n_right"))).select(F.col("_n_left").alias("_k"), "n_left", "n_right")
        home: Column = F.pmod(F.xxhash64(*[c for c in df.columns if c not in (by, "segs", "toks")]), F.col(f"n_{own}"))
        met = df.join(sizes, F.col(by).eqNullSafe(F.col("_k"))).withColumn(f"_{own}", home.cast("int")).withColumn(
            f"_{other}", F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)))
        own_columns = met.select(*[F.col(c).alias(c) for c in met.columns if c not in ("_k", "n_left", "n_right")])
        # Few bytes make many pairs, so small partitions are not put together.
        return own_columns.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, by, "_left", "_right")

    n_left, n_right = sized(left, LEFT_ROWS, "n_left"), sized(right, RIGHT_ROWS, "n_right")
    names = [x.split()[0] for x in schema.split(", ")]

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=names)
        of = Paths(a, b).similarity if by_path else Sets(a["toks"], b["toks"]).jaccard
        step = max(1, HELD_PAIRS // len(b))
        return fold(a, b, ((s, of(s)) for s in (slice(at, min(at + step, len(a))) for at in range(0, len(a), step))))[names]

    keys = [by, "_left", "_right"]
    return dealt(left, "left", "right").groupBy(*keys).cogroup(dealt(right, "right", "left").groupBy(*keys)).applyInPandas(cell, schema)
