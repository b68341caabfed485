"""The registered queries of the training-data operators, and the SQL that states their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontam, jaccard_join, lm_score, packing, pii, quality, sharding, substring, suffix, urlfilter
from tidewire.llm.common import documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(documents(spark, sf_dir), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_classes(documents(spark, sf_dir), 4, 85)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(documents(spark, sf_dir), tokenizer_path())
    return packing.pack(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.passes(quality.BASE) & quality.passes(quality.STRICT)
    return quality.ledger(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality.passes(quality.BASE)).alias("base_failed"), kept.alias("kept"), "fail_bits")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urlfilter.filter_urls(pages, urlfilter.page_edges(pages)).select("page_id", "host", "path", "rule", "verdict")


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.near_passages(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_decontamination": op2_decontamination,
    "op3_pii": op3_pii,
    "op4_sharding": op4_sharding,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_filters": op8_url_filters,
    "op9_suffix_array": op9_suffix_array,
    "op10_substring": op10_substring,
}

WORD = r"[^\x20\x09-\x0D]+"
LOWER_TEXT = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def shingle_list(words: str, width: int) -> str:
    return f"[array_to_string({words}[i:i + {width - 1}], ' ') for i in range(1, greatest(len({words}) - {width - 2}, 2)) if len({words}) > 0]"


OP2_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents),
ds AS (SELECT doc_id, k, {shingle_list("w", 5)} AS s FROM d),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM benchmark),
bs AS (SELECT item_id, {shingle_list("w", 5)} AS s FROM b),
bn AS (SELECT item_id, len(s) AS n, unnest(s) AS h FROM bs WHERE len(s) > 0),
bw AS (SELECT item_id, n, h, count(*) AS w FROM bn GROUP BY ALL),
p AS (SELECT doc_id, k, len(s) AS m, unnest(s) AS h, unnest(range(len(s))) AS pos FROM ds),
hit AS (SELECT doc_id, k, m, pos, p.h, item_id, n, bw.w FROM p JOIN bw USING (h)),
pair AS (SELECT x.doc_id, x.k, x.item_id, x.n, x.m, x.pos AS start, y.h, least(count(*), any_value(y.w)) AS c
  FROM hit x JOIN hit y ON x.k = y.k AND x.item_id = y.item_id AND y.pos BETWEEN x.pos AND x.pos + x.n - 1 GROUP BY ALL),
win AS (SELECT doc_id, item_id, n, start, sum(c) / (n + least(n, m - start) - sum(c))::DOUBLE AS s FROM pair GROUP BY doc_id, k, item_id, n, m, start),
best AS (SELECT doc_id, item_id, n, round(s, 6) AS s, start, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY round(s, 6) DESC, start) AS r FROM win WHERE s >= 0.8)
SELECT doc_id, item_id, start::BIGINT AS start, n::BIGINT AS n_shingles, s AS similarity FROM best WHERE r = 1
"""

OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER_TEXT}, '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct({shingle_list("w", 4)}) AS s FROM d),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
often AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS an, y.n AS bn, count(*) AS c FROM t x JOIN t y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM often WHERE 100 * c >= 85 * (an + bn - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = s.doc_id) AS component_id FROM s
"""

OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
  [l for l in string_split(coalesce(text, ''), chr(10)) if regexp_matches(l, '{WORD}')] AS lines FROM documents),
u AS (SELECT k, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
t AS (SELECT k, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM u WINDOW o AS (PARTITION BY k ORDER BY i)),
f AS (SELECT k, i, (z IS NOT NULL AND count(*) OVER (PARTITION BY k, x, y, z) > 1)::INT AS f FROM t),
g AS (SELECT k, i, greatest(f, coalesce(lag(f) OVER o, 0), coalesce(lag(f, 2) OVER o, 0)) AS g FROM f WINDOW o AS (PARTITION BY k ORDER BY i)),
r AS (SELECT k, sum(g) AS rep FROM g GROUP BY k),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
  coalesce(rep, 0)::BIGINT AS n_repeat_words, len([x for x in w if regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')]) AS alpha,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters FROM d LEFT JOIN r USING (k)),
b AS (SELECT *, n_words < 50 AS few, 100 * n_repeat_words > 50 * n_words AS rep, 100 * n_symbols > 10 * n_words AS sym, 100 * n_dup_lines > 50 * n_lines AS dup,
  10 * word_chars < 20 * n_words OR 10 * word_chars > 120 * n_words AS len, 100 * alpha < 70 * n_words AS al, 100 * up > 50 * letters AS sh, n_words > 1000000 AS many FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few OR rep AS base_failed, NOT (few OR rep OR sym OR dup OR len OR al OR sh) AS kept,
  (few::BIGINT + 2 * rep::BIGINT + 4 * sym::BIGINT + 8 * dup::BIGINT + 16 * len::BIGINT + 32 * al::BIGINT + 64 * sh::BIGINT + 128 * many::BIGINT)::BIGINT AS fail_bits FROM b
"""

OP8_SQL = r"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
h AS (SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, html, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM h),
t AS (SELECT page_id, url, coalesce(nullif(regexp_extract(html, '(?is)<link[^>]*rel\s*=\s*["'']?canonical\b[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1), ''),
    nullif(regexp_extract(html, '(?is)<link[^>]*?href\s*=\s*["'']?([^"''\s>]+)[^>]*rel\s*=\s*["'']?canonical\b', 1), ''),
    nullif(regexp_extract(html, '(?is)<meta[^>]*http-equiv\s*=\s*["'']?refresh\b[^>]*?url\s*=\s*["'']?([^"''\s>]+)', 1), '')) AS target FROM p),
w AS (SELECT page_id, url, target, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS own_host, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS own_path,
  regexp_extract(target, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS own, regexp_extract(target, '^([^?#]*)', 1) AS head, regexp_extract(target, '^[^?#]*(.*)$', 1) AS tail FROM t WHERE target IS NOT NULL),
v AS (SELECT page_id, url, CASE WHEN lower(own) IN ('http', 'https') THEN target WHEN own <> '' OR scheme = '' THEN NULL WHEN starts_with(target, '//') THEN scheme || ':' || target
  ELSE scheme || '://' || own_host || (CASE WHEN head = '' THEN own_path WHEN starts_with(head, '/') THEN head ELSE regexp_replace(CASE WHEN own_path = '' THEN '/' ELSE own_path END, '[^/]*$', '') || head END) || tail END AS dst FROM w),
e0 AS (SELECT url AS u, 1 AS side, row_number() OVER () AS k FROM v WHERE dst IS NOT NULL UNION ALL SELECT dst, 2, row_number() OVER () FROM v WHERE dst IS NOT NULL UNION ALL SELECT url, 0, page_id FROM pages),
e1 AS (SELECT u, side, k, CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) ELSE '' END AS rest FROM e0),
e2 AS (SELECT side, k, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_replace(regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1), '/+$', '') AS addr,
  array_to_string([q for q in string_split(regexp_extract(coalesce(u, ''), '^[^?#]*\?([^#]*)', 1), '&') if q <> '' and not regexp_matches(q, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')], '&') AS query FROM e1),
e3 AS (SELECT side, k, addr || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS node, regexp_extract(addr, '^([^/?#]*)', 1) AS host, regexp_extract(addr, '^[^/?#]*([^?#]*)', 1) AS path FROM e2),
e AS (SELECT DISTINCT x.node AS a, y.node AS b FROM e3 x JOIN e3 y ON x.k = y.k AND x.side = 1 AND y.side = 2 WHERE x.node <> y.node AND x.node <> '' AND y.node <> ''),
f AS (SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS v
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY page_id),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
named AS (SELECT node, arg_max(r.verdict, length(r.host || r.path)) AS v FROM (SELECT DISTINCT node, host, path FROM e3 WHERE side > 0) x JOIN rules r ON (x.host = r.host OR ends_with(x.host, '.' || r.host)) AND starts_with(x.path, r.path) GROUP BY node),
start AS (SELECT node FROM named WHERE v = 'block' UNION SELECT e3.node FROM e3 JOIN f ON e3.side = 0 AND e3.k = f.page_id WHERE f.v = 'block'),
bad(node) AS (SELECT node FROM start UNION SELECT b FROM bad JOIN both_ways ON both_ways.a = bad.node)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, CASE WHEN e3.node IN (SELECT node FROM bad) AND e3.node IN (SELECT a FROM both_ways) THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN e3 ON e3.side = 0 AND e3.k = p.page_id LEFT JOIN f ON f.page_id = p.page_id
"""

#: DuckDB SQL over the same tables. Tests hold the others against brute-force versions.
ORACLES: dict[str, str] = {"op2_decontamination": OP2_SQL, "op5_jaccard_join": OP5_SQL, "op7_quality_rules": OP7_SQL, "op8_url_filters": OP8_SQL}
