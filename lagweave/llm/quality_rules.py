"""Quality rules as a short-circuit cascade of column expressions.

Each rule is a rejection test over the text. On a sample its cost (time for each row, over the pass that splits the words) and its
selectivity (share rejected) are measured; rules then run in falling order of rejection per cost inside one lazy CASE,
so a row that an early rule rejects never pays for the later ones. The order never changes which rows are kept.

Nulls and empty texts have no words and fail the minimum length. A rule that gives null rejects nothing. Input columns
are untouched; `kept` and `rejected_by` may be renamed where they would clash. An empty table gives an empty result and
leaves the rules as listed.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.llm.common import let, scratch

# ASCII white space separates words; these characters are symbols.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

SAMPLE_ROWS = 2000
INDEX_BITS, FEW = 20, 16


def words(text: Column) -> Column:
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)), lambda t: F.when(t != "", F.split(t, SPACE_CLASS)).otherwise(F.array().cast("array<string>")))


def count_word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def count_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SYMBOLS}]+", "")).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def count_lines(text: Column) -> Column:
    return F.size(worded_lines(text)).cast("long")


def count_dup_lines(text: Column) -> Column:
    return let(worded_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _shifted(a: Column, by: int = 1) -> Column:
    return F.slice(a, 1 + by, 1 << 30)


def _covered(at: Column, reach: int) -> Column:
    """Positions covered by spans of length `reach` that start at the sorted positions `at`."""
    steps = F.zip_with(at, _shifted(at), lambda a, b: F.least(F.lit(reach), F.coalesce(b - a, F.lit(reach))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)


def _starts_by_lookup(h: Column, twice: Column) -> Column:
    return F.array_compact(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)))


def _starts_by_sorting(h: Column) -> Column:
    """Sorted positions of values that occur again, for texts with many of them. Values are sorted with their position in
    one long (high bits of the value, then the position). Null where different values share their high bits."""
    low = (1 << INDEX_BITS) - 1

    def neighbours(p: Column) -> Column:
        return F.zip_with(p, _shifted(p), lambda a, b: F.when(F.shiftright(a, INDEX_BITS) == F.shiftright(b, INDEX_BITS), F.struct(
            a.bitwiseAND(F.lit(low)).cast("int").alias("i"), b.bitwiseAND(F.lit(low)).cast("int").alias("j"))))

    def starts(pairs: Column) -> Column:
        at = F.sort_array(F.array_union(F.transform(pairs, lambda x: x["i"]), F.transform(pairs, lambda x: x["j"])))
        return F.when(~F.exists(pairs, lambda x: F.get(h, x["i"]) != F.get(h, x["j"])), at)

    packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    return let(packed, lambda p: let(F.array_compact(neighbours(p)), starts))


def count_repeat_words(w: Column, n: int = 3) -> Column:
    """Words inside n-word windows that occur twice or more in the text, the first occurrence included."""

    def repeats(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.array_compact(F.zip_with(s, _shifted(s), lambda a, b: F.when(a == b, a)))))

        def count(t: Column) -> Column:
            many = F.when((F.size(t) > FEW) & (F.size(h) < (1 << INDEX_BITS)), _starts_by_sorting(h))
            return F.when(F.size(t) == 0, F.lit(0).cast("long")).otherwise(
                let(F.coalesce(many, _starts_by_lookup(h, t)), lambda at: _covered(at, n)))

        return let(twice, count)

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))
    return F.when(F.size(w) <= n, F.lit(0).cast("long")).otherwise(let(windows, repeats))


@dataclass(frozen=True)
class Rule:
    """`rejects` maps the text column (and ready-made counts, by name) to a boolean. cost and rejected are estimates."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]
    cost: float = 1.0
    rejected: float = 0.0


class Counts(dict):
    """Counts of a text by name, as expressions made on demand from the text and its words; ready columns go first."""

    OF_WORDS = {
        "n_words": lambda w: F.size(w).cast("long"), "word_chars": count_word_chars, "n_repeat_words": count_repeat_words,
    }
    OF_TEXT = {"n_symbols": count_symbols, "n_lines": count_lines, "n_dup_lines": count_dup_lines}

    def __init__(self, text: Column, split: Column | None = None, have: dict[str, Column] | None = None):
        super().__init__(have or {}, text=text, words=words(text) if split is None else split)

    def __missing__(self, name: str) -> Column:
        return self.OF_TEXT[name](self["text"]) if name in self.OF_TEXT else self.OF_WORDS[name](self["words"])


MIN_WORDS, MAX_REPEAT_PCT = 50, 50
MAX_SYMBOL_PCT, MAX_DUP_LINE_PCT, WORD_CHARS = 10, 40, (3, 12)

BASE_RULES = (
    Rule("too_few_words", lambda c: c["n_words"] < MIN_WORDS),
    Rule("repeated_words", lambda c: 100 * c["n_repeat_words"] > MAX_REPEAT_PCT * c["n_words"]),
)
RULES = (
    *BASE_RULES,
    Rule("many_symbols", lambda c: 100 * c["n_symbols"] > MAX_SYMBOL_PCT * c["n_words"]),
    Rule("duplicate_lines", lambda c: 100 * c["n_dup_lines"] > MAX_DUP_LINE_PCT * c["n_lines"]),
    Rule("word_length", lambda c: (c["word_chars"] < WORD_CHARS[0] * c["n_words"]) | (c["word_chars"] > WORD_CHARS[1] * c["n_words"])),
)


def estimate(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """Rules with measured cost (microseconds a row) and share rejected, best rejection per cost first. The sample of at
    most `sample_rows` rows only decides the order in which rules run."""
    sample = df.select(F.col(text).alias("text")).limit(sample_rows).repartition(1).persist()
    try:
        n = sample.count()
        if not n:
            return tuple(rules)

        def timed(test: Column) -> tuple[float, float]:
            start = time.perf_counter()
            hits = sample.agg(F.sum(F.coalesce(test, F.lit(False)).cast("int"))).first()[0]
            return time.perf_counter() - start, hits / n

        split_only = let(words(F.col("text")), lambda w: F.size(w) < 0)
        timed(split_only)
        idle = timed(split_only)[0]
        out = []
        for rule in rules:
            took, share = timed(let(words(F.col("text")), lambda w: rule.rejects(Counts(F.col("text"), w))))
            out.append(replace(rule, cost=max(took - idle, 1e-4) * 1e6 / n, rejected=share))
    finally:
        sample.unpersist()
    return tuple(sorted(out, key=lambda r: (-r.rejected / r.cost, r.cost)))


def cascade(rules: tuple[Rule, ...], counts: Counts) -> Column:
    """Name of the first rule that rejects a row, in the given order, else null. Later rules are not evaluated then."""
    out = None
    for rule in rules:
        test = F.coalesce(rule.rejects(counts), F.lit(False))
        out = F.when(test, F.lit(rule.name)) if out is None else out.when(test, F.lit(rule.name))
    return out.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def verdict(rules: tuple[Rule, ...], text: Column) -> Column:
    """The cascade over a text whose words are split once for all rules."""
    return let(words(text), lambda w: cascade(rules, Counts(text, w)))


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All rows with `kept` (boolean) and `rejected_by` (the first rejecting rule in the measured order)."""
    kept, by = scratch(df, "kept", "rejected_by")
    out = df.withColumn(by, verdict(estimate(df, text, rules, sample_rows), F.col(text)))
    return out.withColumn(kept, F.col(by).isNull())


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with the input's columns."""
    return df.where(verdict(estimate(df, text, rules, sample_rows), F.col(text)).isNull())


def quality_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document with its counts, `base_failed`, `kept`. The counts are result columns, so each is computed
    once; the cascade reads them."""
    ordered = estimate(df, text, RULES, sample_rows)
    t = F.col(text)
    of_words = let(words(t), lambda w: F.struct(*[made(w).alias(n) for n, made in Counts.OF_WORDS.items()]))
    out = df.select(F.col(doc_id).alias("doc_id"), of_words.alias("_w"), *[made(t).alias(n) for n, made in Counts.OF_TEXT.items()])
    names = [*Counts.OF_WORDS, *Counts.OF_TEXT]
    out = out.select("doc_id", *[F.col(f"_w.{n}").alias(n) for n in Counts.OF_WORDS], *Counts.OF_TEXT)
    have = Counts(F.lit(""), have={n: F.col(n) for n in names})
    return out.withColumns({"base_failed": cascade(BASE_RULES, have).isNotNull(), "kept": cascade(ordered, have).isNull()})
