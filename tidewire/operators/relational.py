"""Filters, pages, details and aggregates over articles, events, sources and the like."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_MOST, PAGE_DEFAULT = 200, 50


def page(df: DataFrame, order: list[Column], limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """A page of an ordered frame: TakeOrderedAndProject, no full sort. `order` must end in a unique column."""
    limit = max(1, min(PAGE_MOST, limit))
    out = df.orderBy(*order)
    return out.offset(offset).limit(limit) if offset else out.limit(limit)


def filter_articles(articles: DataFrame, source=None, language: str | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Optional filters, all of which must hold; bounds are inclusive. All reach the scan."""
    for column, value in (("source", source), ("language", language)):
        if value is not None:
            articles = articles.filter(F.col(column) == value)
    if since is not None:
        articles = articles.filter(F.col("published_at") >= F.lit(since))
    if until is not None:
        articles = articles.filter(F.col("published_at") <= F.lit(until))
    return articles


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("published_at"), F.desc("id")]


def contains_any_case(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows of which a column holds the text in any case; % and _ in it are wildcards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).ilike(f"%{text}%")
    return df.filter(hit)


def lookup_label(dim: DataFrame, label: str, key: str = "id", name: str = "name") -> DataFrame:
    """The smallest key whose name equals the label in any case."""
    return dim.filter(F.lower(name) == label.lower()).agg(F.min(key).alias(key))


def with_topic(articles: DataFrame, topics: DataFrame) -> DataFrame:
    return articles.join(topics, articles["id"] == topics["article_id"], "left_semi")


def event_aggregates(articles: DataFrame) -> DataFrame:
    """article, source and language counts and the time span of each event."""
    return articles.groupBy("event_id").agg(
        F.count("*").alias("article_count"), F.countDistinct("source").alias("source_count"), F.countDistinct("language").alias("language_count"),
        F.min("published_at").alias("started_at"), F.max("published_at").alias("last_seen_at"),
    )


def source_volume(articles: DataFrame, events: DataFrame) -> DataFrame:
    """Articles of each source and those in events of several sources."""
    joined = articles.join(events.select("event_id", "source_count"), "event_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("n_articles"), F.count_if(F.col("source_count") > 1).alias("n_corroborated"))


def nested(rows: DataFrame, key: str, order: list[tuple[str, bool]], fields: list[str], name: str) -> DataFrame:
    """key with an array of structs in order; (column, True) sorts it downwards."""
    sort = [(-F.col(c) if down else F.col(c)).alias(f"_{i}") for i, (c, down) in enumerate(order)]
    packed = F.array_sort(F.collect_list(F.struct(*sort, F.struct(*fields).alias("x"))))
    return rows.groupBy(key).agg(F.transform(packed, lambda s: s["x"]).alias(name))


def label_or_key(df: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """df with label: the dimension's, or else "type:id"."""
    return df.join(labels, keys, "left").withColumn("label", F.coalesce("label", F.concat_ws(":", *keys)))


def health(outcomes: DataFrame, ring: int = 20) -> DataFrame:
    """Counters, error rate and the last outcomes of each source, newest first.

    The ring is cut by rank before it is collected: WindowGroupLimit drops older rows before the shuffle.
    """
    totals = outcomes.groupBy("source_id").agg(
        F.count("*").alias("total"), F.count_if(~F.col("ok")).alias("fails"), F.max("at").alias("last_checked_at"),
        F.max(F.when(F.col("ok"), F.col("at"))).alias("last_ok_at"), F.max_by("latency_ms", "at").alias("last_latency_ms"),
        F.max(F.when(~F.col("ok"), F.col("at"))).alias("last_error_at"), F.max_by("error", F.when(~F.col("ok"), F.col("at"))).alias("last_error"),
    )
    w = Window.partitionBy("source_id").orderBy(F.desc("at"), F.desc("event_id"))
    last = outcomes.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= ring)
    recent = nested(last, "source_id", [("rn", False)], ["at", "ok", "latency_ms"], "recent")
    return totals.withColumn("error_rate", F.bround(F.col("fails") / F.col("total"), 4)).join(recent, "source_id")


def interleave(urls: DataFrame, domain: str = "domain", order: str = "pos") -> DataFrame:
    """urls with round, first_seen and place: round-robin over domains, those first seen first; within a domain by order.

    A row's place is the number of rows in earlier rounds and its rank in its own: only a row a round goes through one
    task, not all rows.
    """
    own = Window.partitionBy(domain)
    rows = urls.withColumn("round", F.row_number().over(own.orderBy(order))).withColumn("first_seen", F.min(order).over(own))
    sizes = rows.groupBy("round").agg(F.count("*").alias("n"))
    before = sizes.select("round", (F.sum("n").over(Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("round").orderBy("first_seen")))
    return rows.join(before, "round").withColumn("place", F.col("before") + F.col("rank")).drop("before", "rank")


def rank_average(df: DataFrame, column: str, name: str, keys: list[str]) -> DataFrame:
    """1-based ranks in which ties share their mean."""
    w = Window.partitionBy(*keys)
    return df.withColumn(name, F.rank().over(w.orderBy(column)) + (F.count("*").over(Window.partitionBy(*keys, column)) - 1) / 2)


def scalar_counts(**frames: DataFrame) -> DataFrame:
    """One row with the number of rows of each frame: one pass over each, then one row."""
    parts = [f.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, f in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(*[F.sum(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in frames])
