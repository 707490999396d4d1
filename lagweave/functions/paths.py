"""Taxonomy path expressions: normalization, segments, tokens, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Path similarity weights (token overlap, common prefix, subsequence).
TOKEN_WEIGHT, PREFIX_WEIGHT, SUBSEQUENCE_WEIGHT = 0.45, 0.35, 0.20


def path_segments(c: Column) -> Column:
    text = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "^['\"]+|['\"]+$", "")
    text = F.regexp_replace(F.translate(text, ">\\[]*", "//"), r"\s+", " ")
    return F.filter(F.transform(F.split(text, "/"), lambda s: F.trim(s)), lambda s: s != "")


def normalize_path(c: Column) -> Column:
    return F.array_join(path_segments(c), " / ")


def path_depth(c: Column) -> Column:
    return F.size(path_segments(c))


def parent_domain(c: Column, levels: int = 2) -> Column:
    return F.array_join(F.slice(path_segments(c), 1, levels), " / ")


def parent_key(c: Column) -> Column:
    return F.lower(parent_domain(c, 3))


def domain_key(c: Column) -> Column:
    key = F.lower(parent_domain(c, 2))
    return F.when(key == "", "unknown").otherwise(key)


def is_path_prefix(a: Column, b: Column) -> Column:
    """True when the segments of `a` start those of `b`; both are segment arrays."""
    return (F.size(a) > 0) & (F.slice(b, 1, F.greatest(F.size(a), F.lit(1))) == a)


def path_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(normalize_path(c)), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two distinct-token arrays; 0 when either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def common_prefix(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_miss = F.array_position(same, F.lit(False))
    return F.when(first_miss == 0, F.size(same)).otherwise(first_miss - 1)


def is_subsequence(a: Column, b: Column) -> Column:
    walked = F.aggregate(b, F.lit(0), lambda p, x: F.when(F.get(a, p) == x, p + 1).otherwise(p))
    return (F.size(a) > 0) & (walked == F.size(a))


def similarity_of_parts(seg_a: Column, seg_b: Column, tok_a: Column, tok_b: Column) -> Column:
    """Path similarity from lower-cased segments and tokens computed once per path."""
    prefix = common_prefix(seg_a, seg_b) / F.greatest(F.size(seg_a), F.size(seg_b))
    subseq = F.when(is_subsequence(seg_a, seg_b) | is_subsequence(seg_b, seg_a), 1.0).otherwise(0.0)
    score = TOKEN_WEIGHT * jaccard(tok_a, tok_b) + PREFIX_WEIGHT * prefix + SUBSEQUENCE_WEIGHT * subseq
    return F.when((F.size(seg_a) == 0) | (F.size(seg_b) == 0), F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def lower_segments(c: Column) -> Column:
    return F.transform(path_segments(c), lambda s: F.lower(s))


def path_similarity(a: Column, b: Column) -> Column:
    return similarity_of_parts(lower_segments(a), lower_segments(b), path_tokens(a), path_tokens(b))


def with_similarity(df: DataFrame, a: Column, b: Column, name: str) -> DataFrame:
    """Adds the path similarity of two columns. Segments and tokens become columns first, by an explode of one element that
    the optimizer does not merge away, so that a row's texts are parsed once and not for every use."""
    parts = F.struct(lower_segments(a).alias("sa"), lower_segments(b).alias("sb"), path_tokens(a).alias("ta"), path_tokens(b).alias("tb"))
    at = df.withColumn("_p", F.explode(F.array(parts)))
    return at.withColumn(name, similarity_of_parts(F.col("_p.sa"), F.col("_p.sb"), F.col("_p.ta"), F.col("_p.tb"))).drop("_p")
