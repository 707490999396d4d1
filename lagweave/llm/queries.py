"""One registered query for each operator of this subpackage, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm import (chat_format, decontaminate, importance, license_scan, merkle, ngram_join, packing, quality_rules, ranked_search,
                          resharding, suffix_dedup, token_files, url_filter)
from lagweave.llm.common import ascii_lower, shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS v(k) GROUP BY doc_id),
lines AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
base AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM lines LEFT JOIN cov USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 40 * n_lines
       OR word_chars < 3 * n_words OR word_chars > 12 * n_words) AS kept
FROM failed"""


@query("op2_quality_rules", QUALITY_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of the measured cascade for every document."""
    return quality_rules.quality_report(table(spark, folder, "documents"))


# The rules of the contract (host, path, verdict).
URL_RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)

URL_SQL = r"""
WITH r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
p AS (SELECT page_id, translate(regexp_extract(x, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
m AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) + length(rp) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rh || rp AS rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1"""


@query("op3_url_filter", URL_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict of the longest fitting rule for every page."""
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, folder, "pages"), rules)


def _tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_best_fit_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 2048 tokens; document count and attention cost are bounded by the tokens alone."""
    return packing.pack_documents(table(spark, folder, "documents"), _tokenizer("word_bpe_49k.json"))


OLD_SHARDS, SHARDS = 6, 8


@query("op6_min_cost_resharding")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """From six shards by source (uneven, as sources are) to eight of equal bytes, moving as few bytes as possible."""
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(OLD_SHARDS))
    placed = resharding.reshard(table(spark, folder, "documents"), old, SHARDS, "bytes")
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ITEM_WORDS = rf"regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION_SQL = rf"""
WITH dw AS (SELECT doc_id, {ITEM_WORDS} AS ws FROM documents),
bw AS (SELECT item_id, ws, least(len(ws), 10) AS m FROM (SELECT item_id, {ITEM_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS w FROM bw, unnest(range(1, len(ws) - m + 2)) AS u(i)),
lens AS (SELECT DISTINCT m FROM win),
grams AS (SELECT doc_id, i, m, array_to_string(ws[i:i + m - 1], ' ') AS w FROM dw, lens, unnest(range(1, len(ws) - m + 2)) AS u(i)),
hits AS (SELECT doc_id, i, m, item_id FROM grams JOIN win USING (m, w)),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(m)) AS v(k) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN its USING (doc_id)"""


@query("op9_decontamination", DECONTAMINATION_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows found in every document."""
    return decontaminate.contamination_report(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("items")


# Fixed value: the conversation that the contract adds.
CONTROL_TEXT = r"\### Assistant: </turn> ok"

CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
x AS (SELECT *, length(replace(text, '\', '\\')) + 2 * len(regexp_extract_all(text, '###|</turn>|<\|endoftext\|>')) AS nt,
  length(replace(role, '\', '\\')) + 2 * len(regexp_extract_all(role, '###|</turn>|<\|endoftext\|>')) AS nr FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(4 + nr + 2 + nt + 9)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id"""


@query("op10_chat_formatting", CHAT_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations formatted as tokens and read back from them."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, t, r, CONTROL_TEXT) for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    path = _tokenizer("byte_bpe_50k.json")
    return chat_format.read_back(chat_format.format_turns(rows.unionByName(extra), path), path)


@query("op1_importance_resampling")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Weight and verdict of every document; the target is what labels call good and not toxic."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    found = importance.resample(table(spark, folder, "documents"), table(spark, folder, "labels"), good)
    return found.withColumns({c: F.round(c, 6) for c in ("log_weight", "sample_key")})


@query("op8_license_scan")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """License notices in every document."""
    return license_scan.scan(table(spark, folder, "documents")).withColumn("containment", F.round("containment", 6))


REPEAT_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, array_slice(b, i, i + 49) AS s FROM d, unnest(range(1, octet_length(b) - 48)) AS u(i)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
c AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id > m),
n AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true)::INT AS opens FROM c),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS e FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n) GROUP BY doc_id, k),
gaps AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 1) AS x, a - 1 AS y FROM r
  UNION ALL SELECT d.doc_id, coalesce(max(e), 1), any_value(octet_length(b)) FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT g.doc_id, string_agg(CASE WHEN y >= x THEN hex(array_slice(b, x, y)) ELSE '' END, '' ORDER BY x) AS h FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id),
sums AS (SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM r GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)"""


@query("op4_suffix_dedup", REPEAT_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that repeat 50 bytes of an earlier one."""
    return suffix_dedup.repeat_report(table(spark, folder, "documents"))


JACCARD_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)
  UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.other = l.a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id)"""


@query("op7_ngram_jaccard", JACCARD_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Shingle count and link component of every document."""
    return ngram_join.ngram_components(table(spark, folder, "documents"))


@query("op11_token_files")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids as read back from the files."""
    place = shared_folder(spark, "token-files")
    return token_files.file_digest_report(table(spark, folder, "documents"), _tokenizer("byte_bpe_50k.json"), place)


def _field_sql(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR))::VARCHAR || ':' || {column}::VARCHAR, '-')"


# DuckDB has no CRC-32; the table gives the remainder of a byte after eight steps of the polynomial.
MERKLE_SQL = rf"""
WITH RECURSIVE steps(b, i, r) AS (SELECT b, 0, b::UBIGINT FROM range(256) AS x(b)
  UNION ALL SELECT b, i + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END FROM steps WHERE i < 8),
crc_table AS (SELECT b, r FROM steps WHERE i = 8),
crc(doc_id, i, r) AS (SELECT doc_id, 0, 4294967295::UBIGINT FROM documents
  UNION ALL SELECT c.doc_id, c.i + 1, xor(c.r >> 8, t.r) FROM crc c JOIN crc_table t
    ON t.b = (xor(c.r, ascii(substr(c.doc_id::VARCHAR, c.i + 1, 1))::UBIGINT) & 255) WHERE c.i < length(c.doc_id::VARCHAR)),
tampered AS (SELECT doc_id FROM crc WHERE i = length(doc_id::VARCHAR) AND xor(r, 4294967295::UBIGINT) % 3 = 0),
head AS (SELECT doc_id, lang, text, {' || '.join(_field_sql(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} AS h FROM documents),
leaves AS (SELECT doc_id, lang, sha256(h || {_field_sql('text')}) AS leaf,
    sha256(h || {_field_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS changed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM head),
lv(lang, level, idx, n, h) AS (SELECT lang, 0, idx, n, leaf FROM leaves
  UNION ALL SELECT lang, level + 1, idx // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY idx)) FROM lv WHERE n > 1 GROUP BY lang, level, idx // 8),
subroots AS (SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM lv WHERE n = 1),
tv(level, idx, n, h) AS (SELECT 0, idx, n, subroot FROM subroots
  UNION ALL SELECT level + 1, idx // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY idx)) FROM tv WHERE n > 1 GROUP BY level, idx // 8),
root AS (SELECT h AS root FROM tv WHERE n = 1),
paths AS (
  SELECT l.doc_id, v.level, v.idx, v.h, v.idx < l.idx // (8::BIGINT ** v.level)::BIGINT AS before
  FROM leaves l JOIN lv v ON l.lang IS NOT DISTINCT FROM v.lang AND v.idx // 8 = l.idx // (8::BIGINT ** (v.level + 1))::BIGINT
    AND v.idx <> l.idx // (8::BIGINT ** v.level)::BIGINT AND v.n > 1
  UNION ALL SELECT l.doc_id, s.height + v.level, v.idx, v.h, v.idx < s.idx // (8::BIGINT ** v.level)::BIGINT
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN tv v ON v.idx // 8 = s.idx // (8::BIGINT ** (v.level + 1))::BIGINT
    AND v.idx <> s.idx // (8::BIGINT ** v.level)::BIGINT AND v.n > 1),
sides AS (SELECT doc_id, level, coalesce(string_agg(h, '' ORDER BY idx) FILTER (before), '') AS a, coalesce(string_agg(h, '' ORDER BY idx) FILTER (NOT before), '') AS b
  FROM paths GROUP BY ALL),
proofs AS (SELECT doc_id, string_agg(a || b, '' ORDER BY level) AS p FROM sides GROUP BY ALL),
heights AS (SELECT l.doc_id, s.height + (SELECT max(level) FROM tv) AS height FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang),
folds(doc_id, level, h) AS (SELECT doc_id, 0, CASE WHEN doc_id IN (SELECT doc_id FROM tampered) THEN changed ELSE leaf END FROM leaves
  UNION ALL SELECT f.doc_id, f.level + 1, sha256(coalesce(a, '') || f.h || coalesce(b, '')) FROM folds f JOIN heights USING (doc_id)
    LEFT JOIN sides s ON s.doc_id = f.doc_id AND s.level = f.level WHERE f.level < height)
SELECT l.doc_id, leaf, subroot, root, sha256(coalesce(p, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN root LEFT JOIN proofs p ON p.doc_id = l.doc_id
  JOIN heights g ON g.doc_id = l.doc_id JOIN folds f ON f.doc_id = l.doc_id AND f.level = g.height"""


@query("op12_merkle_manifest", MERKLE_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Proof of every document, and what a changed text makes of the root."""
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.verification_report(table(spark, folder, "documents"), tamper, ascii_lower(F.col("text")))


TERMS = rf"regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH_SQL = rf"""
WITH t AS (SELECT doc_id, unnest({TERMS}) AS w FROM documents),
q AS (SELECT item_id, w, count(*) AS r FROM (SELECT item_id, unnest({TERMS}) AS w FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY ALL),
lens AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
total AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM lens),
weight AS (SELECT w, floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::BIGINT AS wt FROM (SELECT w, count(*) AS df FROM tf GROUP BY w), total),
m AS (SELECT doc_id, 75 + ((25 * n * nd) // l) AS m FROM lens, total),
s AS (SELECT item_id, doc_id, sum(r * wt * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN tf USING (w) JOIN weight USING (w) JOIN m USING (doc_id) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 20"""


@query("op13_ranked_search", SEARCH_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
