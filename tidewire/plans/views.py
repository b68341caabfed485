"""Logical tables over the star schema that the queries run on, in Spark and (as CTEs) in SQL.

`events` gives mentions: the event type is the target, the user the source. `documents` gives articles; an article's
time follows from its id. Securities are the parts' brands, entities the suppliers' nations and the like.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def type_id(column: str = "event_type") -> F.Column:
    out = F.lit(0)
    for i, t in enumerate(TYPES):
        out = F.when(F.col(column) == t, i + 1).otherwise(out)
    return out.cast("bigint")


TYPE_ID_SQL = "(CASE event_type " + " ".join(f"WHEN '{t}' THEN {i + 1}" for i, t in enumerate(TYPES)) + " ELSE 0 END)::BIGINT"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target_type, target_id, label, article_id, source_id, published_at)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("topic").alias("target_type"), type_id().alias("target_id"), F.col("event_type").alias("label"), F.col("event_id").alias("article_id"), F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("published_at"), "value")


MENTIONS_SQL = f"mentions AS (SELECT 'topic' AS target_type, {TYPE_ID_SQL} AS target_id, event_type AS label, event_id AS article_id, user_id AS source_id, ts::TIMESTAMP AS published_at, value FROM events)"
BUCKETS_SQL = f"""{MENTIONS_SQL}, buckets AS (SELECT target_type, target_id, time_bucket(INTERVAL 60 MINUTE, published_at, TIMESTAMP '1970-01-01') AS bucket,
  count(DISTINCT article_id)::BIGINT AS count, count(DISTINCT source_id)::BIGINT AS source_count FROM mentions GROUP BY ALL)"""


def rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mentions() at times of their own: hour h of each target has about twice as many as hour h / 2."""
    hour = F.floor(F.sqrt("article_id")).cast("bigint")
    return mentions(spark, sf_dir).withColumn("published_at", F.timestamp_seconds(F.lit(1704067200) + hour * 3600))


RISING_SQL = MENTIONS_SQL.replace("ts::TIMESTAMP AS published_at", "TIMESTAMP '2024-01-01' + to_hours(floor(sqrt(event_id))::INT) AS published_at")
RISING_BUCKETS_SQL = BUCKETS_SQL.replace(MENTIONS_SQL, RISING_SQL)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source, language, title, body, published_at, event_id); one article in seven has no time."""
    d = table(spark, sf_dir, "documents")
    first = F.substring(F.substring_index("text", "\n", 1), 1, 80)
    at = F.when(F.col("doc_id") % 7 != 3, F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 7919 % 2592000))
    return d.select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("language"), first.alias("title"), F.col("text").alias("body"), at.alias("published_at"), (F.col("doc_id") * 31 % 97).alias("event_id"), "n_chars")


ARTICLES_SQL = """articles AS (SELECT doc_id AS id, source, lang AS language, substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS body,
  CASE WHEN doc_id % 7 <> 3 THEN TIMESTAMP '2024-01-01' + to_seconds(doc_id * 7919 % 2592000) END AS published_at, doc_id * 31 % 97 AS event_id, n_chars FROM documents)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, entity_id, salience, count): three entities for each order line's article."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("article_id"), (F.col("l_suppkey") % 40).alias("entity_id")).agg(F.max(F.col("l_discount") * 10).alias("salience"), F.count("*").alias("count"))


LINKS_SQL = "links AS (SELECT l_orderkey AS article_id, l_suppkey % 40 AS entity_id, max(l_discount * 10) AS salience, count(*)::BIGINT AS count FROM lineitem GROUP BY ALL)"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.lit("place").alias("type"))


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, symbol, name, aliases): one for each brand."""
    p = table(spark, sf_dir, "part").select("p_brand").distinct()
    number = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("bigint")
    return p.select(number.alias("id"), F.concat(F.lit("BR"), number).alias("symbol"), F.concat(F.lit("Brand "), number, F.lit(" Holdings Inc.")).alias("name"), F.array(F.col("p_brand"), F.concat(F.lit("B"), number)).alias("aliases"))


SECURITIES_SQL = "securities AS (SELECT DISTINCT regexp_extract(p_brand, '([0-9]+)$', 1)::BIGINT AS id, 'BR' || regexp_extract(p_brand, '([0-9]+)$', 1) AS symbol FROM part)"


def crawl_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, at, ok, latency_ms, error, event_id)."""
    e = table(spark, sf_dir, "events")
    ok = F.col("event_type") != "error"
    return e.select(F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("at"), ok.alias("ok"), F.col("value").alias("latency_ms"), F.when(~ok, F.lit("timeout")).alias("error"), "event_id")


CRAWL_SQL = "crawl AS (SELECT user_id AS source_id, ts::TIMESTAMP AS at_time, event_type <> 'error' AS ok, value AS latency_ms, event_id FROM events)"
