"""Queries over sources, securities, feeds, lookups, topics, the dataflow and the like."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire import tables
from tidewire.functions import language, names, scores, text
from tidewire.operators import analyze, entities, neighbours, search, series, sources, store
from tidewire.operators import relational as R
from tidewire.plans import finance, news, views
from tidewire.plans.registry import query, rounded
from tidewire.sources import connectors
from tidewire.streaming import dataflow, streams

A = f"WITH {views.ARTICLES_SQL}"

# --- sources ----------------------------------------------------------------------------------------------------------


def registry(spark, d) -> DataFrame:
    """Customers as sources."""
    c = views.table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("http://s"), k % 1200, F.lit(".example")).alias("homepage_url"), F.when(k % 3 != 0, F.concat(F.lit("http://s"), k % 1100, F.lit(".example/feed"))).alias("feed_url"),
        F.lit("rss").alias("fetch_method"), F.concat(F.lit("r"), F.col("c_nationkey") % 5).alias("region"), F.array(F.lower("c_mktsegment"), F.concat(F.lit("n"), F.col("c_nationkey") % 3)).alias("categories"),
        (k % 5).cast("smallint").alias("bot_sensitivity"), (k % 7 != 0).alias("enabled"), F.lit(None).cast("string").alias("health"),
    )


REGISTRY_SQL = """src AS (SELECT c_custkey AS id, c_name AS name, 'http://s' || (c_custkey % 1200) || '.example' AS homepage_url, CASE WHEN c_custkey % 3 <> 0 THEN 'http://s' || (c_custkey % 1100) || '.example/feed' END AS feed_url,
'r' || (c_nationkey % 5) AS region, [lower(c_mktsegment), 'n' || (c_nationkey % 3)] AS categories, c_custkey % 5 AS bot_sensitivity, c_custkey % 7 <> 0 AS enabled FROM customer)"""


@query("sources_page", f"WITH {REGISTRY_SQL} SELECT id, name, region FROM src WHERE enabled AND region = 'r2' AND list_contains(categories, 'n1') ORDER BY id LIMIT 30 OFFSET 5")
def sources_page(spark, d):
    return sources.list_sources(registry(spark, d), True, "r2", "n1", 30, 5).select("id", "name", "region")


@query("sources_in_category", f"WITH {REGISTRY_SQL} SELECT id, region FROM src WHERE list_contains(categories, 'building')")
def sources_in_category(spark, d):
    return registry(spark, d).filter(F.array_contains("categories", "building")).select("id", "region")


@query("source_by_id", f"WITH {REGISTRY_SQL} SELECT id, name, homepage_url, feed_url, region, enabled FROM src WHERE id = 17")
def source_by_id(spark, d):
    return sources.lookup(registry(spark, d), "id", 17).select("id", "name", "homepage_url", "feed_url", "region", "enabled")


@query("source_model", f"WITH {REGISTRY_SQL} SELECT id, name, homepage_url, feed_url, 'rss' AS fetch_method, region, array_to_string(categories, ',') AS categories, bot_sensitivity::INT AS bot_sensitivity, enabled FROM src")
def source_model(spark, d):
    m = sources.read_model(registry(spark, d), "source")
    return m.withColumn("categories", F.array_join("categories", ",")).withColumn("bot_sensitivity", F.col("bot_sensitivity").cast("int"))


@query("source_disable", f"WITH {REGISTRY_SQL} SELECT id, CASE WHEN id = 4 THEN false ELSE enabled END AS enabled FROM src")
def source_disable(spark, d):
    return sources.enable(registry(spark, d), 4, False).select("id", "enabled")


@query("source_upsert", f"""WITH {REGISTRY_SQL}, k AS (SELECT *, coalesce(feed_url, homepage_url) AS key FROM src), o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) = 1),
n AS (SELECT 'http://s' || (s_suppkey * 5) || '.example/feed' AS key, s_name AS name, s_suppkey FROM supplier)
SELECT coalesce(n.key, o.key) AS feed_key, coalesce(n.name, o.name) AS name, coalesce(o.enabled, true) AS enabled FROM o FULL JOIN n ON o.key = n.key""")
def source_upsert(spark, d):
    """Suppliers come as sources, some of which are known by their feed; whether a source is enabled stays."""
    key = F.coalesce("feed_url", "homepage_url")
    known = registry(spark, d).select("id", "name", "homepage_url", "feed_url", "enabled", "health", key.alias("k"))
    known = known.groupBy("k").agg(F.min_by(F.struct("id", "name", "homepage_url", "feed_url", "enabled", "health"), "id").alias("x")).select("x.*")
    s = views.table(spark, d, "supplier")
    new = s.select((-1 - F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.lit("http://new.example").alias("homepage_url"), F.concat(F.lit("http://s"), F.col("s_suppkey") * 5, F.lit(".example/feed")).alias("feed_url"), F.lit(True).alias("enabled"))
    return store.upsert_sources(known, new).select(key.alias("feed_key"), "name", "enabled")


@query("catalog_merge", """WITH RECURSIVE base AS (SELECT lower('http://f.example/' || (n_nationkey % 10)) AS f, lower('http://h.example/' || n_nationkey) AS h, lower(n_name) AS n FROM nation),
x AS (SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 4 <> 0 THEN lower('http://F.example/' || (s_suppkey * 3 % 450)) END AS f, lower('http://h.example/' || (s_suppkey * 11 % 800)) AS h, lower('Nation_' || (s_suppkey * 7 % 600)) AS n FROM supplier),
o AS (SELECT *, row_number() OVER (ORDER BY pos) AS i FROM x WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.f = x.f OR base.h = x.h OR base.n = x.n)),
r(i, pos, ok, fs, hs, ns) AS (SELECT 0::BIGINT, -1::BIGINT, false, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[] UNION ALL
  SELECT o.i, o.pos, k.ok, CASE WHEN k.ok AND o.f IS NOT NULL THEN list_append(r.fs, o.f) ELSE r.fs END, CASE WHEN k.ok THEN list_append(r.hs, o.h) ELSE r.hs END, CASE WHEN k.ok THEN list_append(r.ns, o.n) ELSE r.ns END
  FROM r JOIN o ON o.i = r.i + 1, LATERAL (SELECT NOT (coalesce(list_contains(r.fs, o.f), false) OR list_contains(r.hs, o.h) OR list_contains(r.ns, o.n)) AS ok) k)
SELECT x.n AS name FROM r JOIN x USING (pos) WHERE ok UNION ALL SELECT n FROM base""")
def catalog_merge(spark, d):
    n, s = views.table(spark, d, "nation"), views.table(spark, d, "supplier")
    base = n.select(F.col("n_name").alias("name"), F.concat(F.lit("http://f.example/"), F.col("n_nationkey") % 10).alias("feed_url"), F.concat(F.lit("http://h.example/"), "n_nationkey").alias("homepage_url"))
    k = F.col("s_suppkey")
    extra = s.select(k.alias("pos"), F.concat(F.lit("Nation_"), k * 7 % 600).alias("name"), F.when(k % 4 != 0, F.concat(F.lit("http://F.example/"), k * 3 % 450)).alias("feed_url"), F.concat(F.lit("http://h.example/"), k * 11 % 800).alias("homepage_url"))
    return store.merge_catalog(base, extra).select(F.lower("name").alias("name"))


@query("crawl_log", f"WITH {views.CRAWL_SQL} SELECT source_id, CASE WHEN ok THEN 200 ELSE 504 END AS http_status, ok, CASE WHEN NOT ok THEN 'timeout' END AS error, at_time AS fetched_at FROM crawl")
def crawl_log(spark, d):
    """What was fetched and what failed are appended one after the other, and read again."""
    c = views.crawl_outcomes(spark, d).withColumn("fetched_at", F.col("at")).withColumn("http_status", F.when(F.col("ok"), 200).otherwise(504))
    folder = tables.new_folder(spark, "crawl-log")
    for ok in (True, False):
        sources.append_log(sources.crawl_log(c.filter(F.col("ok") == ok)), folder)
    return sources.read_log(spark, folder).select("source_id", "http_status", "ok", "error", "fetched_at")


@query("source_scores", f"""WITH {views.CRAWL_SQL}, h AS (SELECT source_id, count(*)::BIGINT AS total, count_if(NOT ok)::BIGINT AS fails FROM crawl GROUP BY source_id)
SELECT source_id, total, fails, round(0.5 + source_id % 10 / 20, 4) AS credibility, '2024-02-01T00:00:00.000Z' AS credibility_at FROM h""")
def source_scores(spark, d):
    """Scores go into the health of each source; its counters stay."""
    health = sources.health_json(R.health(views.crawl_outcomes(spark, d))).withColumnRenamed("source_id", "id")
    new = health.select(F.col("id").alias("source_id"), F.round(0.5 + F.col("id") % 10 / 20, 4).alias("credibility"))
    out = sources.merge_scores(health, new, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    get = lambda k: F.get_json_object("health", f"$.{k}")
    return out.select(F.col("id").alias("source_id"), get("total").cast("bigint").alias("total"), get("fails").cast("bigint").alias("fails"), F.round(get("credibility").cast("double"), 4).alias("credibility"), get("credibility_at").alias("credibility_at"))


@query("collect_cycle", """WITH e AS (SELECT event_id, user_id AS source_id FROM events) SELECT source_id, source_id % 10 <> 3 AND source_id % 10 <> 4 AS ok, CASE WHEN source_id % 10 IN (3, 4) THEN 0 ELSE count(*) END::BIGINT AS n_items,
CASE source_id % 10 WHEN 3 THEN 'timeout' WHEN 4 THEN 'no items' END AS error FROM e GROUP BY source_id""")
def collect_cycle(spark, d):
    """One source in ten can't be had, and one sends what no parser takes."""
    e = views.table(spark, d, "events")
    item = F.format_string("<item><title>t</title><link>http://n.example/%d</link></item>", "event_id")
    bodies = e.groupBy(F.col("user_id").alias("source_id"), F.expr("event_id div 500").alias("page")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("body"))
    kind = F.col("source_id") % 10
    bodies = bodies.withColumn("body", F.when(kind == 4, F.lit("<rss><channel>")).otherwise(F.col("body"))).withColumn("error", F.when(kind == 3, F.lit("timeout")))
    return sources.collect_cycle(bodies, "rss", F.lit("2024-02-01 00:00:00").cast("timestamp"))[1].select("source_id", "ok", "n_items", "error")


@query("fetch_schedule", "SELECT c_custkey AS source_id, TIMESTAMP '2024-01-01' + to_microseconds((row_number() OVER (ORDER BY c_custkey) - 1) * 2000000) AS first_run, 3600.0::DOUBLE AS interval_seconds FROM customer")
def fetch_schedule(spark, d):
    s = views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(3600.0).alias("seconds"))
    return streams.schedule(s, F.lit("2024-01-01 00:00:00").cast("timestamp"))


@query("politeness", """SELECT c_custkey AS id, [1.0, 0.5, 0.2, 0.1][t + 1]::DOUBLE AS rps, [0.25, 0.5, 1.5, 3.0][t + 1]::DOUBLE AS jitter_s, [4, 2, 1, 1][t + 1]::INT AS max_concurrency FROM (SELECT c_custkey, least(3, greatest(0, c_custkey % 8 - 2)) AS t FROM customer)""")
def politeness(spark, d):
    c = views.table(spark, d, "customer")
    p = scores.politeness((F.col("c_custkey") % 8 - 2).cast("int"))
    return c.select(F.col("c_custkey").alias("id"), p["rps"].cast("double").alias("rps"), p["jitter_s"].cast("double").alias("jitter_s"), p["max_concurrency"].alias("max_concurrency"))


@query("robots_check", """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS path FROM pages)
SELECT page_id, CASE WHEN starts_with(path, '/en/1') THEN true WHEN starts_with(path, '/en/') OR regexp_matches(path, '^/fr/.*ref=x') THEN false ELSE true END AS allowed FROM p""")
def robots_check(spark, d):
    rules = "User-agent: *\nDisallow: /\n\nUser-agent: tidebot\nUser-agent: other\nDisallow: /en/   # all of it\nAllow: /en/1\nDisallow: /fr/*ref=x\nDisallow:\n"
    p = views.table(spark, d, "pages")
    return p.select("page_id", connectors.robots_allow(F.lit(rules), F.lit("Tidebot/1.0"), F.col("url")).alias("allowed"))


@query("conditional_fetch", """WITH r AS (SELECT c_custkey AS id, 'http://s' || (c_custkey % 9) || '.example/' || CASE WHEN c_custkey % 4 = 0 THEN 'private/' ELSE 'feed/' END || c_custkey AS url, c_custkey AS k FROM customer)
SELECT id, url FROM r WHERE NOT (k % 9 < 3 AND k % 4 = 0) AND k % 10 <> 1 AND NOT (k % 5 = 2) AND NOT (k % 5 = 3 AND k % 2 = 0)""")
def conditional_fetch(spark, d):
    """Three sites of nine shut their private folder; one answer in ten is 304; some have the tag, or the time, of last time."""
    k = F.col("c_custkey")
    folder = F.when(k % 4 == 0, "private/").otherwise("feed/")
    asked = views.table(spark, d, "customer").select(k.alias("id"), F.concat(F.lit("http://s"), k % 9, F.lit(".example/"), folder, k).alias("url"))
    robots = spark.range(3).select(F.concat(F.lit("s"), "id", F.lit(".example")).alias("domain"), F.lit("User-agent: *\nDisallow: /private/").alias("rules"))
    n = F.col("id")
    got = sources.permitted(asked, robots, "tidebot").withColumn("http_status", F.when(n % 10 == 1, 304).otherwise(200)).withColumn("etag", F.when(n % 5 != 3, F.concat(F.lit("e"), n))).withColumn("last_modified", F.timestamp_seconds(n))
    seen = asked.select("url", F.when(n % 5 == 2, F.concat(F.lit("e"), n)).when(n % 5 != 3, F.lit("old")).alias("etag"), F.when(n % 2 == 0, F.timestamp_seconds(n)).otherwise(F.timestamp_seconds(n + 1)).alias("last_modified"))
    return sources.changed(got, seen).select("id", "url")


# --- feeds ------------------------------------------------------------------------------------------------------------


@query("newsapi_items", "SELECT user_id AS source_id, 'http://a.example/' || event_id AS url, event_type AS title, CASE WHEN event_id % 2 = 0 THEN 'text ' || event_id ELSE 'about ' || event_id END AS content FROM events WHERE event_id % 10 <> 0 AND user_id % 9 <> 0")
def newsapi_items(spark, d):
    """Answers whose status isn't ok, and articles without an address, give no items."""
    e = views.table(spark, d, "events")
    k = F.col("event_id")
    art = F.struct(F.when(k % 10 != 0, F.concat(F.lit("http://a.example/"), k)).alias("url"), F.col("event_type").alias("title"), F.concat(F.lit("about "), k).alias("description"), F.when(k % 2 == 0, F.concat(F.lit("text "), k)).alias("content"), F.lit("2024-01-01T00:00:00Z").alias("publishedAt"))
    status = F.when(F.first("user_id") % 9 == 0, "error").otherwise("ok")
    bodies = e.groupBy(F.col("user_id").alias("source_id"), F.expr("event_id div 200").alias("page")).agg(F.to_json(F.struct(status.alias("status"), F.collect_list(art).alias("articles"))).alias("body"))
    return connectors.items(bodies, "newsapi").select("source_id", "url", "title", "content")


@query("sitemap_urls", """SELECT c_nationkey::BIGINT AS source_id, 'http://s.example/p/' || c_custkey AS url FROM customer WHERE c_nationkey % 2 = 0
UNION ALL SELECT c_nationkey::BIGINT, 'http://s.example/p/' || c_custkey FROM customer WHERE c_nationkey % 2 = 1 AND c_custkey % 12 < 10""")
def sitemap_urls(spark, d):
    """Even nations have one map; odd ones an index of twelve, of which ten are followed."""
    c = views.table(spark, d, "customer")
    nation, key = F.col("c_nationkey"), F.col("c_custkey")
    loc = lambda url: F.concat(F.lit("<url><loc>"), url, F.lit("</loc></url>"))
    whole = lambda rows: F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list(rows), ""), F.lit("</urlset>"))
    page = F.concat(F.lit("/p/"), key)
    own = c.filter("c_nationkey % 2 = 0").groupBy(nation.cast("bigint").alias("source_id")).agg(whole(loc(page)).alias("body")).withColumn("url", F.lit("http://s.example/sitemap.xml"))
    odd = c.filter("c_nationkey % 2 = 1")
    bodies = odd.groupBy(F.concat(F.lit("http://s.example/map/"), nation, F.lit("/"), key % 12).alias("url")).agg(whole(loc(page)).alias("body"))
    child = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.concat(F.lit("<sitemap><loc>map/"), F.col("source_id"), F.lit("/"), i, F.lit("</loc></sitemap>")))
    index = odd.select(nation.cast("bigint").alias("source_id")).distinct().select("source_id", F.lit("http://s.example/sitemap.xml").alias("url"), F.concat(F.lit("<sitemapindex>"), F.array_join(child, ""), F.lit("</sitemapindex>")).alias("body"))
    return connectors.sitemap_pages(own.unionByName(index), bodies)


@query("opml_feeds", "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'T ' || n_name ELSE n_name END AS title, 'http://f.example/' || n_nationkey AS feed_url FROM nation")
def opml_feeds(spark, d):
    n = views.table(spark, d, "nation")
    title = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('title="T '), "n_name", F.lit('" '))).otherwise("")
    row = F.concat(F.lit("<outline "), title, F.lit('text="'), "n_name", F.lit('" xmlUrl=" http://f.example/'), "n_nationkey", F.lit('"/>'))
    body = n.groupBy("n_regionkey").agg(F.concat(F.lit('<opml><body><outline text="group">'), F.array_join(F.collect_list(row), ""), F.lit("</outline></body></opml>")).alias("body"))
    return body.select(F.explode(connectors.opml("body")).alias("x")).select("x.*")


@query("listing_links", """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS base FROM pages), c AS (SELECT page_id, base || '/story/' || (page_id * 3 + k) AS url, k FROM p, (SELECT unnest(range(45)) AS k))
SELECT page_id AS source_id, k::INT AS pos, url FROM c WHERE k < 40 AND k % 2 = 0""")
def listing_links(spark, d):
    """Of a listing's 45 headlines the first 40 are followed, and every other page was fetched."""
    p = views.table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0).alias("base"))
    story = F.transform(F.sequence(F.lit(0), F.lit(44)), lambda k: F.concat(F.lit('<li><a class="x headline" href="/story/'), F.col("page_id") * 3 + k, F.lit('#top">h</a><a href="/tag/'), k, F.lit('">t</a></li>')))
    listed = p.select(F.col("page_id").alias("source_id"), "url", F.concat(F.lit('<ul id="news">'), F.array_join(story, ""), F.lit('</ul><a class="headline" href="/elsewhere">e</a>')).alias("html"))
    fetched = p.select("base", F.explode(F.transform(F.sequence(F.lit(0), F.lit(22)), lambda k: F.col("page_id") * 3 + 2 * k)).alias("n")).distinct().select(F.concat("base", F.lit("/story/"), "n").alias("url"), F.lit("<p>story</p>").alias("html"))
    rows = connectors.listing(listed, fetched, 40, "ul#news a.headline")
    return rows.filter("pos % 2 = 0").select("source_id", "pos", "url")


# --- articles ---------------------------------------------------------------------------------------------------------


@query("search_filters", f"{A}, {views.LINKS_SQL} SELECT id FROM articles WHERE published_at >= TIMESTAMP '2024-01-31' - INTERVAL 500 HOUR AND source = 'src1' AND language = 'en' AND id IN (SELECT article_id FROM links WHERE entity_id < 20)")
def search_filters(spark, d):
    topics = views.links(spark, d).filter("entity_id < 20")
    return sources.search_filters(views.articles(spark, d), datetime(2024, 1, 31), 500, "src1", "en", topics).select("id")


@query("articles_in_lists", f"{A} SELECT id, source FROM articles WHERE source IN ('src0', 'src2', 'src9') AND event_id IN (3, 5, 8, 13)")
def articles_in_lists(spark, d):
    return sources.in_lists(views.articles(spark, d), source=["src0", "src2", "src9"], event_id=[3, 5, 8, 13]).select("id", "source")


@query("article_model", f"{A} SELECT id, title, language, published_at, event_id FROM articles")
def article_model(spark, d):
    return sources.read_model(views.articles(spark, d), "article")


@query("event_by_id", f"WITH {news.EVENTS_SQL} SELECT event_id, article_count, source_count FROM ev WHERE event_id = 12")
def event_by_id(spark, d):
    return sources.lookup(news.events(spark, d), "event_id", 12).select("event_id", "article_count", "source_count")


@query("events_recent", f"WITH {news.EVENTS_SQL} SELECT event_id, article_count, source_count, language_count, last_seen_at FROM ev ORDER BY last_seen_at DESC NULLS LAST, event_id DESC LIMIT 30 OFFSET 3")
def events_recent(spark, d):
    return sources.newest(news.events(spark, d), "last_seen_at", "event_id", 30, 3).select("event_id", "article_count", "source_count", "language_count", "last_seen_at")


@query("event_model", f"WITH {news.EVENTS_SQL} SELECT event_id AS id, started_at, last_seen_at, article_count, source_count, language_count FROM ev")
def event_model(spark, d):
    return sources.read_model(news.events(spark, d).withColumnRenamed("event_id", "id"), "event")


@query("link_buckets", """WITH art AS (SELECT o_orderkey AS id, o_custkey % 50 AS source_id, o_orderdate AS published FROM orders),
l AS (SELECT 'entity' AS target_type, (l_suppkey % 40)::BIGINT AS target_id, l_orderkey AS article_id FROM lineitem UNION ALL SELECT 'topic', substr(o_orderpriority, 1, 1)::BIGINT, o_orderkey FROM orders UNION ALL SELECT 'keyword', (l_partkey % 100)::BIGINT, l_orderkey FROM lineitem)
SELECT target_type, target_id, time_bucket(INTERVAL 1440 MINUTE, published::TIMESTAMP, TIMESTAMP '1970-01-01') AS bucket, count(DISTINCT article_id)::BIGINT AS count, count(DISTINCT source_id)::BIGINT AS source_count FROM l JOIN art ON id = article_id GROUP BY ALL""")
def link_buckets(spark, d):
    """Mentions of entities, topics and keywords from their link tables."""
    o, l = views.table(spark, d, "orders"), views.table(spark, d, "lineitem")
    art = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("source_id"), F.col("o_orderdate").cast("timestamp").alias("published_at"))
    link = lambda df, target, key: df.select(target.alias("target_id"), F.col(key).alias("article_id"))
    m = series.mentions_of(art, entity=link(l, F.col("l_suppkey") % 40, "l_orderkey"), topic=link(o, F.substring("o_orderpriority", 1, 1).cast("bigint"), "o_orderkey"), keyword=link(l, F.col("l_partkey") % 100, "l_orderkey"))
    return series.mention_buckets(m, 1440)


@query("moving_average", f"""WITH {views.BUCKETS_SQL}, x AS (SELECT *, count(*) OVER k AS n, first_value(count) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, last_value(count) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, lag(count) OVER w AS a, lag(count, 2) OVER w AS b, lead(count) OVER w AS c, lead(count, 2) OVER w AS e
FROM buckets WINDOW k AS (PARTITION BY target_type, target_id), w AS (PARTITION BY target_type, target_id ORDER BY bucket))
SELECT target_type, target_id, bucket, round((coalesce(b, f) + coalesce(a, f) + count + coalesce(c, l) + coalesce(e, l)) / 5, 6) AS average FROM x""")
def moving_average(spark, d):
    b = series.mention_buckets(views.mentions(spark, d))
    return series.smoothed(b, 5).select("target_type", "target_id", "bucket", F.round("average", 6).alias("average"))


@query("languages")
def languages(spark, d):
    return views.articles(spark, d).select("id", language.detect_language("body").alias("language"))


@query("normalize_ascii", f"{A} SELECT id, trim(regexp_replace(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+', ' ', 'g')) AS body FROM articles")
def normalize_ascii(spark, d):
    return views.articles(spark, d).select("id", text.normalize_ascii(F.col("body")).alias("body"))


@query("split_authors", "SELECT c_custkey AS id, 'customer#' || c_custkey || '/' || lower(c_mktsegment) AS authors FROM customer")
def split_authors(spark, d):
    c = views.table(spark, d, "customer")
    written = F.concat(F.lit(" customer#"), "c_custkey", F.lit(" | "), F.lower("c_mktsegment"), F.lit(",; customer#"), "c_custkey")
    return c.select(F.col("c_custkey").alias("id"), F.array_join(text.split_authors(written), "/").alias("authors"))


@query("name_tokens", "SELECT p_partkey AS id, array_to_string(string_split(lower(p_name), ' '), '|') || '|und|co' AS tokens FROM part")
def name_tokens(spark, d):
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(names.tokens_of(F.concat(F.upper("p_name"), F.lit(" (Und) Co."))), "|").alias("tokens"))


@query("parsed_articles", f"""{A} SELECT id AS source_id, 'http://a.example/' || id AS canonical_url, 'Title ' || id AS title, CASE WHEN id % 7 <> 3 THEN published_at ELSE TIMESTAMP '2024-05-06 07:08:09' END AS published_at,
CASE WHEN id % 2 = 0 THEN 'A,B' ELSE 'Page Author' END AS authors, CASE WHEN id % 11 = 5 THEN 'no_content' END AS reason FROM articles""")
def parsed_articles(spark, d):
    """What a message gives stands; the page fills in what it lacks."""
    a = views.articles(spark, d)
    odd = F.col("id") % 2 == 1
    page = F.concat(F.lit('<html><head><title> Title '), "id", F.lit('</title><meta name="author" content="Page Author"><meta property="article:published_time" content="2024-05-06T07:08:09Z"><link rel="canonical" href="http://a.example/'), "id", F.lit('"></head><body><article><p>'), F.when(F.col("id") % 11 != 5, "text").otherwise(""), F.lit("</p></article></body></html>"))
    raw = a.select(F.col("id").alias("source_id"), F.concat(F.lit("http://m.example/"), "id").alias("url"), F.lit(None).cast("string").alias("canonical_url"), page.alias("raw_html"), F.when(odd, F.lit("  ")).otherwise(F.concat(F.lit("Title "), "id")).alias("title"), "published_at", F.when(odd, F.array().cast("array<string>")).otherwise(F.array(F.lit("A"), F.lit("B"))).alias("authors"), F.lit("2024-06-01 00:00:00").cast("timestamp").alias("fetched_at"))
    return connectors.parsed_articles(raw).select("source_id", "canonical_url", "title", "published_at", F.array_join("authors", ",").alias("authors"), "reason")


@query("vectors_checked", "SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 'a vector of 63 numbers, not 64' WHEN vec_id % 5 = 1 THEN 'no vector' END AS reason FROM embeddings")
def vectors_checked(spark, d):
    e = views.table(spark, d, "embeddings")
    k = F.col("vec_id") % 5
    v = e.select(F.col("vec_id").alias("id"), F.when(k == 0, F.slice("embedding", 1, 63)).when(k != 1, F.col("embedding")).alias("embedding"))
    good, bad = store.check_vectors(v, 64)
    return good.select("id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("id", "reason"))


@query("running_mean", """WITH x AS (SELECT label AS event_id, embedding[1]::DOUBLE AS v FROM embeddings) SELECT event_id, count(*)::BIGINT AS n, round(avg(v), 4) AS first FROM x GROUP BY event_id""")
def running_mean(spark, d):
    """Centroids of the first vectors, and then with the others in one batch, are those of all."""
    e = views.table(spark, d, "embeddings").select(F.col("label").alias("event_id"), "vec_id", "embedding")
    old = neighbours.centroids(e.filter("vec_id % 3 <> 0"))
    out = neighbours.add_to_events(old, e.filter("vec_id % 3 = 0"))
    return out.select("event_id", "n", F.round(F.col("centroid")[0].cast("double"), 4).alias("first"))


@query("entity_candidates", """WITH p AS (SELECT p_partkey AS id, p_name || ' ' || (p_partkey % 40) AS name, p_brand || '-' || (p_size % 5) AS al FROM part), w AS (SELECT id, unnest(string_split(lower(name), ' ')) AS w FROM p),
g AS (SELECT DISTINCT id, substr('  ' || w || ' ', i::BIGINT, 3) AS g FROM w, unnest(range(1, 40)) AS r(i) WHERE i <= length(w) + 1), n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
s AS (SELECT a.id AS q, b.id AS c, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.id % 100 = 0 GROUP BY ALL), sim AS (SELECT q, c, k / (x.n + y.n - k) AS sim FROM s JOIN n x ON x.id = q JOIN n y ON y.id = c),
any_way AS (SELECT q, c FROM sim WHERE sim > 396e-3 UNION SELECT a.id, b.id FROM p a JOIN p b ON a.id % 100 = 0 AND (split_part(lower(a.name), ' ', 1) = split_part(lower(b.name), ' ', 1) OR a.al = b.al)),
r AS (SELECT q, c, coalesce(sim, 0) AS sim, row_number() OVER (PARTITION BY q ORDER BY coalesce(sim, 0) DESC, c) AS rn FROM any_way LEFT JOIN sim USING (q, c))
SELECT q AS query_id, c AS id, round(sim, 6) AS similarity FROM r WHERE rn <= 50""")
def entity_candidates(spark, d):
    p = views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), F.col("p_partkey") % 40).alias("name"), F.lit("org").alias("type"), F.array(F.concat("p_brand", F.lit("-"), F.col("p_size") % 5)).alias("aliases"))
    return entities.candidates(p.filter("id % 100 = 0"), p).withColumn("similarity", F.round("similarity", 6))


# --- securities, signals and reports ------------------------------------------------------------------------------------


@query("securities_list", f"WITH {views.SECURITIES_SQL} SELECT id, symbol FROM securities ORDER BY symbol LIMIT 10")
def securities_list(spark, d):
    return R.page(views.securities(spark, d).select("id", "symbol"), [F.asc("symbol")], 10)


@query("security_by_symbol", f"WITH {views.SECURITIES_SQL} SELECT id, symbol FROM securities WHERE symbol = 'BR7'")
def security_by_symbol(spark, d):
    return sources.lookup(views.securities(spark, d), "symbol", "BR7").select("id", "symbol")


@query("security_upsert", f"""WITH {views.SECURITIES_SQL}, n AS (SELECT n_nationkey::BIGINT AS k, 'BR' || n_nationkey AS symbol FROM nation)
SELECT coalesce(s.symbol, n.symbol) AS symbol, CASE WHEN s.symbol IS NULL THEN 'b' || k || ',C' || k WHEN n.symbol IS NULL THEN 'Brand#' || s.id || ',B' || s.id ELSE 'Brand#' || s.id || ',B' || s.id || ',C' || k END AS aliases FROM securities s FULL JOIN n ON n.symbol = s.symbol""")
def security_upsert(spark, d):
    n = views.table(spark, d, "nation")
    k = F.col("n_nationkey")
    new = n.select(F.concat(F.lit("BR"), k).alias("symbol"), F.col("n_name").alias("name"), F.array(F.concat(F.lit(" b"), k), F.concat(F.lit("C"), k), F.concat(F.lit("c"), k)).alias("aliases"))
    return store.upsert_securities(views.securities(spark, d).drop("id"), new).select("symbol", F.array_join("aliases", ",").alias("aliases"))


@query("signals_list", f"WITH {finance.PRICES_SQL} SELECT symbol, as_of, round(score, 4) AS score FROM sig ORDER BY as_of DESC, symbol DESC LIMIT 25")
def signals_list(spark, d):
    return sources.newest(finance.score_rows(spark, d), "as_of", "symbol", 25).select("symbol", "as_of", F.round("score", 4).alias("score"))


def reports(spark, d) -> DataFrame:
    """A report a source of articles."""
    a = views.articles(spark, d)
    rows = a.groupBy("source").agg(F.count("*").alias("n"), F.max("published_at").alias("created_at"), F.array_sort(F.collect_set(F.when(F.col("event_id") == 7, F.col("id")))).alias("ids"))
    return rows.select(F.substring("source", 4, 9).cast("bigint").alias("id"), F.concat(F.lit("On "), "source").alias("title"), F.concat(F.lit("Articles: "), "n").alias("body_md"), F.transform("ids", lambda i: F.concat(F.lit("article "), i)).alias("citations"), "created_at")


REPORTS_SQL = f"{views.ARTICLES_SQL}, rep AS (SELECT substr(source, 4)::BIGINT AS id, 'On ' || source AS title, 'Articles: ' || count(*) AS body_md, max(published_at) AS created_at, list(id ORDER BY id) FILTER (event_id = 7) AS ids FROM articles GROUP BY source)"


@query("reports_list", f"WITH {REPORTS_SQL} SELECT id, title, created_at FROM rep ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 6")
def reports_list(spark, d):
    return sources.newest(sources.read_model(reports(spark, d), "report"), "created_at", "id", 6).select("id", "title", "created_at")


@query("report_by_id", f"WITH {REPORTS_SQL} SELECT id, title, body_md FROM rep WHERE id = 3")
def report_by_id(spark, d):
    return sources.lookup(reports(spark, d), "id", 3).select("id", "title", "body_md")


@query("report_markdown", f"""WITH {REPORTS_SQL} SELECT id, '# ' || title || chr(10) || chr(10) || body_md || CASE WHEN len(ids) > 0 THEN chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || array_to_string([('- article ' || i) for i in ids], chr(10)) ELSE '' END AS markdown FROM rep""")
def report_markdown(spark, d):
    return search.to_markdown(reports(spark, d))


# --- topics and streams -------------------------------------------------------------------------------------------------


@query("topic_messages", f"{A} SELECT id::VARCHAR AS key, id, title FROM articles")
def topic_messages(spark, d):
    """Messages through a topic, read back as a stream until all is read."""
    base = tables.new_folder(spark, "topics")
    connectors.create_topics(spark, base)
    sent = views.articles(spark, d).select("id", "title")
    connectors.write_topic(connectors.message(sent, "id"), f"{base}/raw.documents")
    got = connectors.read_topic(spark, f"{base}/raw.documents", "key string, value string")
    streams.run(got, f"{base}/checkpoint", ("parquet", {"path": f"{base}/got"})).awaitTermination()
    return spark.read.schema("key string, value string").parquet(f"{base}/got").select("key", F.from_json("value", "id bigint, title string").alias("v")).select("key", "v.*")


@query("harvest", f"{A} SELECT id, language, title FROM articles")
def harvest(spark, d):
    """Articles as JSON lines, and read back."""
    folder = tables.new_folder(spark, "harvest")
    views.articles(spark, d).select("id", "language", "title").write.json(folder)
    return spark.read.schema("id bigint, language string, title string").json(folder)


@query("request_metrics", """WITH r AS (SELECT event_type, user_id % 4 AS status, value / 50 AS s FROM events), b AS (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 'Infinity'::DOUBLE]) AS bound)
SELECT event_type, status, count(*)::BIGINT AS requests, round(sum(s), 4) AS seconds_sum, bound::VARCHAR AS bound, count_if(s <= bound)::BIGINT AS at_most FROM r, b GROUP BY event_type, status, bound""")
def request_metrics(spark, d):
    e = views.table(spark, d, "events").withColumn("status", F.col("user_id") % 4)
    out = dataflow.request_metrics(e, F.col("value") / 50, "event_type", "status")
    label = F.when(F.col("bound") > 1e300, "inf").otherwise(F.col("bound").cast("string"))
    return out.withColumn("seconds_sum", F.round("seconds_sum", 4)).withColumn("bound", label)


@query("dataflow", f"""{A} SELECT 'http://a.example/' || id AS canonical_url, 'Title ' || id AS title, CASE WHEN id % 11 = 5 THEN 'dead' ELSE 'analyzed' END AS status, CASE WHEN id % 11 = 5 THEN 0 ELSE 2 END::BIGINT AS results FROM articles""")
def whole_dataflow(spark, d):
    """Every stage over all articles: what was stored, with its number of results, and the dead letters."""
    base = tables.new_folder(spark, "dataflow")
    a = views.articles(spark, d)
    page = F.concat(F.lit("<html><body><article>"), F.when(F.col("id") % 11 != 5, F.concat(F.lit("Words about "), "source", F.lit(" and more"))).otherwise(""), F.lit("</article></body></html>"))
    raw = a.select(F.col("id").alias("source_id"), F.concat(F.lit("http://a.example/"), "id").alias("url"), F.lit(None).cast("string").alias("canonical_url"), page.alias("raw_html"), F.concat(F.lit("Title "), "id").alias("title"), F.array().cast("array<string>").alias("authors"), F.lit("2024-06-01 00:00:00").cast("timestamp").alias("fetched_at"))
    flow = dataflow.Dataflow(spark, base, analyze.OfflineProvider(), ("keywords", "sentiment"))
    connectors.write_topic(raw, flow.topic("raw.documents"), "url")
    flow.run_once()
    results = spark.read.parquet(flow.topic("analyze.results"))
    stored = store.analyzed(flow.articles(), results)
    n = results.filter("error is null").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("results"))
    live = stored.join(n, "id", "left").select("canonical_url", "title", "status", F.coalesce("results", F.lit(0)).cast("bigint").alias("results"))
    dead = spark.read.parquet(flow.topic("dead.letters")).select("canonical_url", "title", F.lit("dead").alias("status"), F.lit(0).cast("bigint").alias("results"))
    return live.unionByName(dead)
