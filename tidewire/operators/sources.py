"""The registry of sources, lookups, search filters, the crawl log, and the read models of the API."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.functions.text import domain_of
from tidewire.operators import relational as R
from tidewire.sources import connectors


def list_sources(sources: DataFrame, enabled: bool | None = None, region: str | None = None, category: str | None = None, limit: int = R.PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """A page of the sources that fulfil all given conditions, by id; category: a member of the list of categories."""
    if enabled is not None:
        sources = sources.filter(F.col("enabled") == enabled)
    if region is not None:
        sources = sources.filter(F.col("region") == region)
    if category is not None:
        sources = sources.filter(F.array_contains("categories", category))
    return R.page(sources, [F.asc("id")], limit, offset)


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """The rows with a value in a key column; the filter reaches the scan. No row: not found."""
    return df.filter(F.col(column) == F.lit(value))


def update_source(sources: DataFrame, key: int, changes: dict[str, object]) -> DataFrame:
    """All sources, with the given columns of one of them set; unknown columns are an error."""
    unknown = set(changes) - set(sources.columns) | {"id"} & set(changes)
    if unknown:
        raise ValueError(f"can't set {sorted(unknown)}")
    mine = F.col("id") == key
    return sources.select(*[F.when(mine, F.lit(changes[c]).cast(sources.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in sources.columns])


def enable(sources: DataFrame, key: int, on: bool = True) -> DataFrame:
    return update_source(sources, key, {"enabled": on})


def in_lists(df: DataFrame, **lists: list) -> DataFrame:
    """Rows whose columns are in the given lists; an empty list lets nothing through."""
    for column, wanted in lists.items():
        df = df.filter(F.col(column).isin(list(wanted)))
    return df


def search_filters(articles: DataFrame, now: datetime, hours: int | None = None, source: str | None = None, language: str | None = None, topics: DataFrame | None = None) -> DataFrame:
    """The filters that every kind of search shares, all of which must hold: the last hours, source, language, and a
    semi join with the articles of a topic."""
    if hours is not None:
        articles = articles.filter(F.col("published_at") >= F.lit(now) - F.expr(f"INTERVAL {int(hours)} HOURS"))
    articles = R.filter_articles(articles, source=source, language=language)
    return articles if topics is None else R.with_topic(articles, topics)


# --- crawl log and health ---------------------------------------------------------------------------------------------


def crawl_log(outcomes: DataFrame) -> DataFrame:
    """Rows of the crawl log of outcomes; columns that an outcome lacks are null."""
    kinds = dict(c.split() for c in schemas.CRAWL_LOG.split(", "))
    return outcomes.select(*[(F.col(c) if c in outcomes.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def append_log(rows: DataFrame, path: str) -> None:
    """Append to the log, by day, so a reader of some days reads no others."""
    rows.withColumn("day", F.to_date("fetched_at")).repartition("day").write.mode("append").partitionBy("day").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CRAWL_LOG).parquet(path)


HEALTH = "total bigint, fails bigint, error_rate double, last_latency_ms double, last_checked_at timestamp, last_ok_at timestamp, last_error string, last_error_at timestamp, recent array<struct<at timestamp, ok boolean, latency_ms double>>, credibility double, credibility_at timestamp"


def health_json(health: DataFrame) -> DataFrame:
    """(source_id, health) of relational.health(), as the JSON that a source keeps."""
    names = [c.split()[0] for c in HEALTH.split(", ") if not c.startswith(("credibility", "ok ", "latency_ms"))]
    return health.select("source_id", F.to_json(F.struct(*[n for n in names if n in health.columns])).alias("health"))


def merge_scores(sources: DataFrame, scores: DataFrame, at: Column) -> DataFrame:
    """sources (id, health, ...) with credibility and its time set in the health of those that scores (source_id,
    credibility) name; all other fields stay. A source without health gets one."""
    known = F.from_json(F.coalesce("health", F.lit("{}")), HEALTH)
    new = scores.select(F.col("source_id").alias("_s"), F.col("credibility").alias("_c"))
    joined = sources.join(new, F.col("id") == F.col("_s"), "left")
    merged = F.to_json(known.withField("credibility", F.col("_c")).withField("credibility_at", at))
    return joined.withColumn("health", F.when(F.col("_c").isNotNull(), merged).otherwise(F.col("health"))).drop("_s", "_c")


def collect_cycle(bodies: DataFrame, kind: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(items, outcomes) of one round over fetched bodies (source_id, body, error): a body that can't be had or parsed
    stops no other, and each source's outcome (source_id, at, ok, n_items, error) is recorded."""
    got = connectors.items(bodies.filter("error is null and body is not null"), kind)
    counts = got.groupBy("source_id").agg(F.count("*").alias("n_items"))
    outcomes = bodies.groupBy("source_id").agg(F.max("error").alias("error")).join(counts, "source_id", "left").fillna(0, ["n_items"])
    ok = F.col("error").isNull() & (F.col("n_items") > 0)
    why = F.when(~ok, F.coalesce("error", F.lit("no items")))
    return got, outcomes.select("source_id", at.alias("at"), ok.alias("ok"), "n_items", why.alias("error"))


def permitted(requests: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """requests (url, ...) that the robots files (domain, rules) let an agent make; a domain without a file lets all."""
    at = requests.withColumn("_domain", domain_of(F.col("url")))
    joined = at.join(robots.select(F.col("domain").alias("_domain"), F.col("rules").alias("_rules")), "_domain", "left")
    return joined.filter(F.col("_rules").isNull() | connectors.robots_allow("_rules", F.lit(agent), "url")).drop("_domain", "_rules")


def changed(fetched: DataFrame, seen: DataFrame) -> DataFrame:
    """fetched (url, http_status, etag, last_modified, ...) that is new: not answered 304, and of another etag, or without
    etags of another time, than seen (url, etag, last_modified) last."""
    old = seen.select(F.col("url").alias("_u"), F.col("etag").alias("_e"), F.col("last_modified").alias("_m"))
    same_tag = F.col("etag") == F.col("_e")
    same = F.coalesce(same_tag, F.col("last_modified") == F.col("_m"), F.lit(False))
    joined = fetched.filter("http_status is null or http_status <> 304").join(old, F.col("url") == F.col("_u"), "left")
    return joined.filter(~same).drop("_u", "_e", "_m")


# --- read models ------------------------------------------------------------------------------------------------------

#: The columns that each list of the API shows.
MODELS = {
    "article": "id source_id canonical_url url title language authors published_at fetched_at word_count event_id".split(),
    "event": "id title summary started_at last_seen_at article_count source_count language_count score".split(),
    "source": "id name homepage_url feed_url api_kind fetch_method region languages categories bot_sensitivity enabled".split(),
    "trend": "target_type target_id label bucket count source_count velocity zscore".split(),
    "issue": "target_type target_id label window_start window_end score velocity supporting_article_ids".split(),
    "security": "id symbol name exchange country asset_class aliases".split(),
    "signal": "security_id symbol as_of horizon_hours score direction magnitude confidence supporting_article_ids".split(),
    "report": "id title body_md citations provider model version created_at".split(),
}


def read_model(df: DataFrame, kind: str, **nested: Column) -> DataFrame:
    """The columns of a model that df has, in the model's order, and nested ones (arrays of structs) behind."""
    return df.select(*[c for c in MODELS[kind] if c in df.columns], *[v.alias(k) for k, v in nested.items()])


def newest(df: DataFrame, time: str, tie: str = "id", limit: int = R.PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """A page, newest first: reports by created_at, signals by as_of, events by last_seen_at."""
    return R.page(df, [F.desc_nulls_last(time), F.desc(tie)], limit, offset)
