"""Tokenization variants and leaf texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lagweave.functions.paths import normalize_path, path_segments

# Suffixes of the light stemmer in the order they are tried; a stem keeps more than two letters.
SUFFIXES = [
    "ingly", "edly", "ably",
    "ments", "ment",
    "able", "ibly",
    "ation", "tions", "tion",
    "ness", "less", "ful",
    "ing", "ed",
    "ies", "es", "s",
    "ive", "ity", "al",
    "er", "or",
]
MIN_STEM = 3


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def stem(t: Column) -> Column:
    """Drop the first suffix of the list that leaves a stem; "ies" becomes "y"."""
    out = F
    for s in SUFFIXES:
        out = out.when(t.endswith(s) & (F.length(t) >= len(s) + MIN_STEM), F.concat(F.substr(t, F.lit(1), F.length(t) - len(s)), F.lit("y" if s == "ies" else "")))
    return out.otherwise(t)


def fold_label(c: Column) -> Column:
    """Case and dash folding for label keys."""
    text = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[_\-‐-―]+", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tokenize(c: Column, mode: str = "plain") -> Column:
    """`plain`: alphanumerics longer than one character. `stem`: plain plus suffix stripping. `set`: distinct plain."""
    kept = F.filter(words(c), lambda t: F.length(t) > 1)
    if mode == "stem":
        return F.filter(F.transform(kept, lambda t: stem(t)), lambda t: F.length(t) > 1)
    if mode == "set":
        return F.array_distinct(kept)
    if mode == "plain":
        return kept
    raise ValueError(mode)


def leaf_text(path: Column, mode: str = "full") -> Column:
    """`full`: the path. `lexical`: words of the path. `context`: leaf first, then its parents inside out."""
    segs = path_segments(path)
    if mode == "full":
        return normalize_path(path)
    if mode == "lexical":
        return F.array_join(tokenize(normalize_path(path)), " ")
    if mode == "context":
        back = F.reverse(segs)
        return F.concat_ws(" | ", F.get(back, F.lit(0)), F.array_join(F.slice(back, F.lit(2), F.size(back)), " < "))
    raise ValueError(mode)
