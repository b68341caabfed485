"""Schemas of the logical tables and of the messages between streaming stages."""

from __future__ import annotations


def ddl(text: str) -> str:
    """Schemas are DDL texts, so that this module can be imported without a session."""
    return text


SOURCES = ddl("id bigint, name string, homepage_url string, feed_url string, api_kind string, fetch_method string, region string, languages array<string>, categories array<string>, bot_sensitivity smallint, politeness string, robots_url string, enabled boolean, health string, created_at timestamp, updated_at timestamp")
ARTICLES = ddl("id bigint, source_id bigint, canonical_url string, url string, title string, body string, language string, authors array<string>, published_at timestamp, fetched_at timestamp, content_hash binary, simhash bigint, word_count int, status string, event_id bigint, embedding array<float>")
ARTICLE_VERSIONS = ddl("article_id bigint, title string, body string, content_hash binary, fetched_at timestamp")
ENTITIES = ddl("id bigint, name string, type string, aliases array<string>, metadata string, embedding array<float>")
ARTICLE_ENTITIES = ddl("article_id bigint, entity_id bigint, salience double, count int, sentiment double")
KEYWORDS = ddl("id bigint, term string")
ARTICLE_KEYWORDS = ddl("article_id bigint, keyword_id bigint, weight double")
TOPICS = ddl("id bigint, slug string, label string, parent_id bigint, description string")
ARTICLE_TOPICS = ddl("article_id bigint, topic_id bigint, confidence double")
EVENTS = ddl("id bigint, title string, summary string, started_at timestamp, last_seen_at timestamp, article_count int, source_count int, language_count int, score double, centroid array<float>, metadata string")
EVENT_ARTICLES = ddl("event_id bigint, article_id bigint, similarity double, is_seed boolean")
ANALYSIS = ddl("target_type string, target_id bigint, kind string, provider string, model string, result string, tokens int, cost_usd double")
REPORTS = ddl("id bigint, query string, title string, body_md string, citations string, provider string, model string, scheduled boolean, version int")
MENTION_TIMESERIES = ddl("target_type string, target_id bigint, bucket timestamp, count bigint, source_count bigint, velocity double, zscore double")
CRAWL_LOG = ddl("source_id bigint, url string, method string, http_status int, bytes bigint, latency_ms int, ok boolean, error string, fetched_at timestamp")
SECURITIES = ddl("id bigint, symbol string, name string, exchange string, mic string, country string, asset_class string, aliases array<string>, metadata string, embedding array<float>")
ENTITY_SECURITIES = ddl("entity_id bigint, security_id bigint, confidence double")
SIGNALS = ddl("security_id bigint, as_of timestamp, horizon_hours int, score double, direction string, magnitude double, confidence double, components string, supporting_article_ids array<bigint>, supporting_event_ids array<bigint>")

#: Messages; every one carries schema_version.
RAW_DOCUMENT = ddl("schema_version int, source_id bigint, url string, canonical_url string, fetch_method string, raw_html string, raw_text string, title string, content_type string, http_status int, headers map<string,string>, published_at string, fetched_at string")
PARSED_ARTICLE = ddl("schema_version int, source_id bigint, canonical_url string, url string, title string, body string, language string, authors array<string>, published_at timestamp, fetched_at timestamp, content_hash string, simhash bigint, word_count int")
DEDUP_EVENT = ddl("schema_version int, article_id bigint, canonical_url string, is_duplicate boolean, duplicate_of array<bigint>, hamming_distance int")
ANALYZE_REQUEST = ddl("schema_version int, target_type string, target_id bigint, kind string, text string")
ANALYZE_RESULT = ddl("schema_version int, target_type string, target_id bigint, kind string, provider string, model string, result string, tokens int, cost_usd double, error string")
ISSUE_ALERT = ddl("schema_version int, target_type string, target_id bigint, label string, window_start timestamp, window_end timestamp, score double, velocity double, supporting_article_ids array<bigint>")

#: The payloads of the analysis kinds.
RESULT = {
    "summary": ddl("summary string"),
    "entities": ddl("entities array<struct<name string, type string, salience double, sentiment double, count int, aliases array<string>>>"),
    "keywords": ddl("keywords array<struct<term string, weight double>>"),
    "topics": ddl("topics array<struct<slug string, label string, confidence double>>"),
    "sentiment": ddl("polarity double, label string"),
    "embedding": ddl("vector array<float>"),
    "report": ddl("title string, body_md string, citations array<struct<type string, id bigint, url string>>"),
}

TOPIC_NAMES = ("raw.documents", "parsed.articles", "dedup.events", "analyze.requests", "analyze.results", "issues.alerts", "dead.letters")
TOPIC_PARTITIONS = 12
