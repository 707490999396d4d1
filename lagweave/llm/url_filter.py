"""URL filter: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests.

A rule is a host and the beginning of a path; it fits that host and its subdomains. Every URL expands into each suffix
of its host with each path prefix of a length that some rule has (their few lengths are read first). Expressions meet
rules in an equi-join on the first 32 bits of their SHA-256; the full digest and the expression itself then confirm. The longest fitting rule wins, and of equal rules the
one whose verdict sorts last (block before allow). Without a fitting rule the default verdict holds.

A null URL, or one without `://`, has an empty host and path and fits nothing but an empty rule. Repeated pages each get
their row; an empty table gives an empty result. Only page id and URL are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.llm.common import ascii_lower

SHORT_BITS = 32


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host itself and every suffix of it that starts after a dot."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("/"), path), 256)


def short(full: Column) -> Column:
    return F.conv(F.substring(full, 1, SHORT_BITS // 4), 16, 10).cast("long")


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict and the matched rule's length. `rules`: host, path (with its leading slash),
    verdict."""
    host, path = url_parts(F.col("_url"))
    keyed = rules.select(
        ascii_lower(F.coalesce("host", F.lit(""))).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"),
        F.col("verdict").alias("r_verdict")).where(F.col("r_verdict").isNotNull())
    keyed = keyed.withColumn("r_digest", digest(F.col("r_host"), F.col("r_path"))).withColumn("r_short", short(F.col("r_digest")))
    lengths = [r[0] for r in keyed.select(F.length("r_path")).distinct().collect()]
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url")).select(
        "page_id", host.alias("host"), path.alias("path")).withColumn("_row", F.monotonically_increasing_id())
    cut = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths)]
    paths = F.array_compact(F.array(*cut)) if cut else F.array().cast("array<string>")
    wide = rows.select("_row", "page_id", "host", "path", F.explode_outer(suffixes(F.col("host"))).alias("_host"), paths.alias("_paths"))
    wide = wide.withColumn("_path", F.explode_outer("_paths"))
    wide = wide.withColumn("_digest", digest(F.col("_host"), F.col("_path")))
    # Rules are found by the short hash alone; what it finds is confirmed by the full digest and the expression.
    met = wide.withColumn("_short", short(F.col("_digest"))).join(keyed, F.col("_short") == F.col("r_short"), "left")
    confirmed = (F.col("_digest") == F.col("r_digest")) & (F.col("_host") == F.col("r_host")) & (F.col("_path") == F.col("r_path"))
    best = F.max(F.when(confirmed, F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"), F.col("r_verdict").alias("verdict"),
        F.concat("r_host", "r_path").alias("rule"))))
    return met.groupBy("_row").agg(
        F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("_best"),
    ).select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
