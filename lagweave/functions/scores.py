"""Score normalizers, kernel weights, hashes and text helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window as W
from pyspark.sql import functions as F


def clamp01(c: Column) -> Column:
    """Clamp to [0, 1]; null stays null (least and greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def norm_score(c: Column, mode: str = "milli") -> Column:
    """`milli`: /1000 above 1. `mixed`: /100 up to 100, /1000 above. `clamp`: clamp only."""
    v = c.cast("double")
    if mode == "milli":
        v = F.when(v > 1, v / 1000).otherwise(v)
    elif mode == "mixed":
        v = F.when(v > 100, v / 1000).when(v > 1, v / 100).otherwise(v)
    elif mode != "clamp":
        raise ValueError(mode)
    return clamp01(v)


def parse_decimal_comma(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def format_decimal_comma(c: Column, digits: int = 5) -> Column:
    return F.replace(F.format_string(f"%.{digits}f", c.cast("double")), F.lit("."), F.lit(","))


def finite(c: Column) -> Column:
    """Numeric text or number to double; NaN and infinities become null."""
    v = c.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(None)).otherwise(v)


def kernel_weight(t: Column, te: Column, bandwidth: Column) -> Column:
    bw = F.greatest(bandwidth, F.lit(1e-9))
    z = (t - te) / bw
    return F.exp(-0.5 * z * z) / (F.lit(math.sqrt(2 * math.pi)) * bw)


def sum_to_n(w: Column, by: list[str]) -> Column:
    over = W.partitionBy(*by)
    return w * F.count(w).over(over) / (F.sum(w).over(over) + 1e-12)


def effective_sample_size(w: Column) -> Column:
    """Aggregate: (sum w)^2 / sum w^2."""
    return (F.sum(w) + 1e-12) * (F.sum(w) + 1e-12) / (F.sum(w * w) + 1e-12)


def recency_weight(t: Column, half_life: float) -> Column:
    return F.exp(F.lit(-math.log(2) / max(1e-6, half_life)) * (1 - t))


def content_hash(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *parts).cast("binary"))


def members_hash(members: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(members), "|").cast("binary"), 256)


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def fraction_from_hash(*cols: Column) -> Column:
    """Reproducible pseudo-uniform number in (0, 1), a function of the columns alone.

    The last 13 hex digits of an MD5 digest give 52 bits, so any engine with MD5 gets the same number.
    """
    digits = F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary")), 20, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))


def corr(x: Column | str, y: Column | str) -> Column:
    """Aggregate: Pearson correlation of complete pairs; null (never an error) when a side is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
