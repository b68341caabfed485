"""Queries over articles, events, sources and entities."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import scores, text, vectors
from tidewire.operators import relational as R
from tidewire.plans import views
from tidewire.plans.registry import query, rounded

A = f"WITH {views.ARTICLES_SQL}"
EVENTS_SQL = f"{views.ARTICLES_SQL}, ev AS (SELECT event_id, count(*)::BIGINT AS article_count, count(DISTINCT source)::BIGINT AS source_count, count(DISTINCT language)::BIGINT AS language_count, min(published_at) AS started_at, max(published_at) AS last_seen_at FROM articles GROUP BY event_id)"


def events(spark: SparkSession, d: str) -> DataFrame:
    return R.event_aggregates(views.articles(spark, d))


@query("articles_page", f"{A} SELECT id, source, language, title, published_at FROM articles WHERE language = 'en' AND published_at >= TIMESTAMP '2024-01-03' AND published_at <= TIMESTAMP '2024-01-25' ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 50 OFFSET 10")
def articles_page(spark, d):
    a = R.filter_articles(views.articles(spark, d), language="en", since=datetime(2024, 1, 3), until=datetime(2024, 1, 25))
    return R.page(a.select("id", "source", "language", "title", "published_at"), R.newest_first(), 50, 10)


@query("articles_total", f"{A} SELECT count(*)::BIGINT AS total FROM articles WHERE source = 'src0'")
def articles_total(spark, d):
    return R.filter_articles(views.articles(spark, d), source="src0").agg(F.count("*").alias("total"))


@query("recent_feed", f"{A} SELECT id, title, published_at FROM articles ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 20")
def recent_feed(spark, d):
    return R.page(views.articles(spark, d).select("id", "title", "published_at"), R.newest_first(), 20)


@query("article_by_id", f"{A} SELECT id, title, language FROM articles WHERE id = 42")
def article_by_id(spark, d):
    return views.articles(spark, d).filter("id = 42").select("id", "title", "language")


@query("topic_semi_join", f"{A}, {views.LINKS_SQL} SELECT id, source FROM articles WHERE id IN (SELECT article_id FROM links WHERE entity_id = 7)")
def topic_semi_join(spark, d):
    return R.with_topic(views.articles(spark, d), views.links(spark, d).filter("entity_id = 7")).select("id", "source")


@query("event_aggregates", f"WITH {EVENTS_SQL} SELECT * FROM ev")
def event_aggregates(spark, d):
    return events(spark, d)


@query("events_page", f"WITH {EVENTS_SQL} SELECT event_id, article_count, last_seen_at FROM ev WHERE article_count >= 5 ORDER BY article_count DESC, event_id DESC LIMIT 20")
def events_page(spark, d):
    return R.page(events(spark, d).filter("article_count >= 5").select("event_id", "article_count", "last_seen_at"), [F.desc("article_count"), F.desc("event_id")], 20)


@query("event_detail", f"WITH {EVENTS_SQL} SELECT event_id, article_count, a.id AS article_id, a.title, row_number() OVER (PARTITION BY event_id ORDER BY n_chars DESC, a.id)::INT AS rn FROM ev JOIN articles a USING (event_id) WHERE event_id IN (3, 5)")
def event_detail(spark, d):
    w = Window.partitionBy("event_id").orderBy(F.desc("n_chars"), "id")
    rows = events(spark, d).select("event_id", "article_count").join(views.articles(spark, d), "event_id").filter(F.col("event_id").isin(3, 5))
    return rows.withColumn("rn", F.row_number().over(w)).select("event_id", "article_count", F.col("id").alias("article_id"), "title", "rn")


@query("source_volume", f"WITH {EVENTS_SQL} SELECT source, count(*)::BIGINT AS n_articles, count_if(source_count > 1)::BIGINT AS n_corroborated FROM articles LEFT JOIN ev USING (event_id) GROUP BY source")
def source_volume(spark, d):
    return R.source_volume(views.articles(spark, d), events(spark, d))


@query("dashboard_stats", f"WITH {EVENTS_SQL} SELECT (SELECT count(*) FROM articles)::BIGINT AS articles, (SELECT count(*) FROM ev)::BIGINT AS events, (SELECT count(*) FROM nation)::BIGINT AS entities, (SELECT count(*) FROM lineitem)::BIGINT AS links")
def dashboard_stats(spark, d):
    return R.scalar_counts(articles=views.articles(spark, d), events=events(spark, d), entities=views.entities(spark, d), links=views.table(spark, d, "lineitem"))


@query("entity_detail", f"WITH {views.LINKS_SQL} SELECT article_id, n_name AS name, round(salience, 6) AS salience, row_number() OVER (PARTITION BY article_id ORDER BY salience DESC, entity_id)::INT AS rn FROM links JOIN nation ON n_nationkey = entity_id")
def entity_detail(spark, d):
    rows = views.links(spark, d).join(F.broadcast(views.entities(spark, d)), F.col("entity_id") == F.col("id"))
    w = Window.partitionBy("article_id").orderBy(F.desc("salience"), "entity_id")
    return rows.withColumn("rn", F.row_number().over(w)).select("article_id", "name", F.round("salience", 6).alias("salience"), "rn")


@query("label_lookup", f"WITH {views.LINKS_SQL}, t AS (SELECT entity_id, count(*)::BIGINT AS n FROM links GROUP BY ALL) SELECT 'entity' AS target_type, entity_id AS target_id, n, coalesce(n_name, 'entity:' || entity_id) AS label FROM t LEFT JOIN nation ON n_nationkey = entity_id")
def label_lookup(spark, d):
    t = views.links(spark, d).groupBy(F.lit("entity").alias("target_type"), F.col("entity_id").alias("target_id")).agg(F.count("*").alias("n"))
    dim = views.entities(spark, d).select(F.lit("entity").alias("target_type"), F.col("id").alias("target_id"), F.col("name").alias("label"))
    return R.label_or_key(t, F.broadcast(dim), ["target_type", "target_id"])


@query("resolve_label", "SELECT min(n_nationkey)::BIGINT AS id FROM nation WHERE lower(n_name) = 'nation_7'")
def resolve_label(spark, d):
    return R.lookup_label(views.entities(spark, d), "Nation_7")


@query("securities_search", f"WITH {views.SECURITIES_SQL} SELECT id, symbol FROM securities WHERE symbol ILIKE '%r1%' ORDER BY symbol")
def securities_search(spark, d):
    return R.contains_any_case(views.securities(spark, d), "r1", "symbol", "name").select("id", "symbol").orderBy("symbol")


@query("nested_entities", f"WITH {views.LINKS_SQL} SELECT article_id, list(entity_id ORDER BY salience DESC, entity_id) AS entity_ids FROM links GROUP BY article_id")
def nested_entities(spark, d):
    rows = views.links(spark, d)
    out = R.nested(rows, "article_id", [("salience", True), ("entity_id", False)], ["entity_id"], "entities")
    return out.select("article_id", F.transform("entities", lambda e: e["entity_id"]).alias("entity_ids"))


@query("crawl_report", f"WITH {views.CRAWL_SQL} SELECT source_id % 3 AS method, count(*)::BIGINT AS total, count_if(ok)::BIGINT AS ok, count(DISTINCT CASE WHEN ok THEN source_id END)::BIGINT AS regions_ok, round(count_if(ok) * 1e2 / count(*), 4) AS pct_ok FROM crawl GROUP BY ALL")
def crawl_report(spark, d):
    c = views.crawl_outcomes(spark, d)
    return c.groupBy((F.col("source_id") % 3).alias("method")).agg(F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.countDistinct(F.when(F.col("ok"), F.col("source_id"))).alias("regions_ok"), F.round(F.count_if("ok") * 100.0 / F.count("*"), 4).alias("pct_ok"))


@query("source_health", f"""WITH {views.CRAWL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY at_time DESC, event_id DESC) AS rn FROM crawl)
SELECT source_id, count(*)::BIGINT AS total, count_if(NOT ok)::BIGINT AS fails, max(at_time) AS last_checked_at, max(CASE WHEN ok THEN at_time END) AS last_ok_at, round_even(count_if(NOT ok) / count(*), 4) AS error_rate, array_to_string(list(epoch_us(at_time)::VARCHAR ORDER BY rn) FILTER (rn <= 20), ',') AS recent_at FROM r GROUP BY source_id""")
def source_health(spark, d):
    h = R.health(views.crawl_outcomes(spark, d))
    return h.select("source_id", "total", "fails", "last_checked_at", "last_ok_at", "error_rate", F.array_join(F.transform("recent", lambda r: F.unix_micros(r["at"]).cast("string")), ",").alias("recent_at"))


@query("interleave_domains", """WITH u AS (SELECT page_id AS pos, regexp_extract(url, '://([^/:?#]+)', 1) AS domain, url FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY pos) AS round, min(pos) OVER (PARTITION BY domain) AS first_seen FROM u)
SELECT pos, url, row_number() OVER (ORDER BY round, first_seen)::BIGINT AS place FROM r""")
def interleave_domains(spark, d):
    u = views.table(spark, d, "pages").select(F.col("page_id").alias("pos"), text.domain_of(F.col("url")).alias("domain"), "url")
    return R.interleave(u).select("pos", "url", "place")


@query("language_report", f"{A} SELECT language, count(*)::BIGINT AS n, sum(len(regexp_extract_all(body, '\\S+')))::BIGINT // count(*) AS mean_words FROM articles GROUP BY language")
def language_report(spark, d):
    a = views.articles(spark, d).select("language", text.word_count(F.col("body")).alias("w"))
    return a.groupBy("language").agg(F.count("*").alias("n"), F.expr("sum(w) div count(*)").alias("mean_words")).orderBy(F.desc("n"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, least(1e0, greatest(0e0, CAST(json_extract(props, '$.k') AS DOUBLE) / 50)) AS clamped FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90")
def json_props(spark, d):
    e = views.table(spark, d, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return e.filter("k >= 90").select("event_id", "k", scores.clip(F.col("k") / 50.0).alias("clamped"))


@query("exact_duplicates", f"{A}, n AS (SELECT id, sha256(trim(regexp_replace(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+', ' ', 'g'))) AS h FROM articles) SELECT h AS content_hash, count(*)::BIGINT AS n, min(id) AS first_id FROM n GROUP BY h HAVING count(*) > 1")
def exact_duplicates(spark, d):
    a = views.articles(spark, d).select("id", text.content_hash(text.normalize_ascii(F.col("body"))).alias("content_hash"))
    return a.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


@query("content_hash", f"{A} SELECT id, sha256(trim(regexp_replace(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+', ' ', 'g'))) AS content_hash, len(regexp_extract_all(body, '[^ \\t-\\r]+'))::INT AS word_count FROM articles")
def content_hash(spark, d):
    return views.articles(spark, d).select("id", text.content_hash(text.normalize_ascii(F.col("body"))).alias("content_hash"), text.word_count(F.col("body")).alias("word_count"))


@query("text_functions", """SELECT page_id, lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS domain, regexp_replace(lower(trim(url)), '\\s+', '-', 'g') AS slug, list_distinct([x for x in string_split(replace(url, '.', '/'), '/') if x <> '']).len()::INT AS n_parts FROM pages""")
def text_functions(spark, d):
    p = views.table(spark, d, "pages")
    parts = text.clean_list(F.split(F.replace("url", F.lit("."), F.lit("/")), "/"))
    return p.select("page_id", text.domain_of(F.col("url")).alias("domain"), text.slugify(F.col("url")).alias("slug"), F.size(parts).alias("n_parts"))


@query("knn_cosine", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 3) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q WHERE vec_id <> 3 ORDER BY score DESC, vec_id LIMIT 10""")
def knn_cosine(spark, d):
    e = views.table(spark, d, "embeddings")
    q = e.filter("vec_id = 3").select(F.col("embedding").alias("q"))  # the query vector: one row
    near = e.filter("vec_id <> 3").join(F.broadcast(q)).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return near.orderBy(F.desc("score"), "vec_id").limit(10)


# --- scores -------------------------------------------------------------------------------------------------------


@query("recency_decay", "SELECT event_id, round(pow(2e0, -greatest(event_id % 200 - 5, 0) / 24e0), 8) AS decay FROM events")
def recency_decay(spark, d):
    return views.table(spark, d, "events").select("event_id", F.round(scores.decay((F.col("event_id") % 200 - 5).cast("double")), 8).alias("decay"))


IMPACT_SQL = """i AS (SELECT event_id, event_type, (value - 60) / 50 AS sent, user_id / 100 AS mag, event_id % 11 / 8 AS nov, event_id % 13 / 10 AS cred, event_id % 90 - 3 AS age FROM events),
s AS (SELECT *, least(1e0, greatest(0e0, mag)) * (25e-2 + 75e-2 * least(1e0, greatest(0e0, nov))) * (4e-1 + 6e-1 * least(1e0, greatest(0e0, cred))) AS strength, pow(2e0, -greatest(age, 0) / 24e0) AS fade FROM i),
p AS (SELECT event_id, event_type, least(1e0, greatest(-1e0, least(1e0, greatest(-1e0, sent)) * strength * fade)) AS score, least(1e0, greatest(0e0, strength * fade)) AS weight FROM s)"""


def impacts(spark, d):
    e = views.table(spark, d, "events")
    p = scores.article_impact((F.col("value") - 60) / 50, F.col("user_id") / 100, F.col("event_id") % 11 / 8, F.col("event_id") % 13 / 10, (F.col("event_id") % 90 - 3).cast("double"))
    return e.select("event_id", "event_type", p["score"].alias("score"), p["confidence"].alias("weight"))


@query("article_impact", f"WITH {IMPACT_SQL} SELECT event_id, round(score + 33e-10, 6) AS score, round(weight + 33e-10, 6) AS confidence, CASE WHEN score > 1e-9 THEN 'bullish' WHEN score < -1e-9 THEN 'bearish' ELSE 'neutral' END AS direction FROM p")
def article_impact(spark, d):
    return impacts(spark, d).select("event_id", rounded("score"), rounded("weight", "confidence"), scores.direction(F.col("score")).alias("direction"))


@query("event_impact", f"WITH {IMPACT_SQL} SELECT event_type, count(*)::BIGINT AS n_articles, round(sum(weight), 4) AS total_weight, round(sum(weight * score) / sum(weight), 6) AS score, round(abs(sum(weight * score)) / sum(weight * abs(score)), 6) AS agreement, round(1 - exp(-sum(weight) / 2), 6) AS vol_confidence FROM p GROUP BY event_type")
def event_impact(spark, d):
    from tidewire.operators import signals

    out = signals.event_impact(impacts(spark, d), "event_type")
    return out.select("event_type", "n_articles", *[F.round(c, n).alias(c) for c, n in (("total_weight", 4), ("score", 6), ("agreement", 6), ("vol_confidence", 6))])


@query("source_credibility", f"""WITH {EVENTS_SQL}, v AS (SELECT source, count(*) AS n, count_if(source_count > 1) AS c FROM articles LEFT JOIN ev USING (event_id) GROUP BY source),
h AS (SELECT 'src' || source_id % 20 AS source, count_if(NOT ok) / count(*) AS err FROM (SELECT user_id AS source_id, event_type <> 'error' AS ok FROM events) GROUP BY 1)
SELECT source, round(3e-1 * (1 - err) + 25e-2 * (c / n) + 2e-1 * (1 - exp(-n / 73e1)) + 15e-2 * least(1e0, ln(1 + n) / ln(401)) + 1e-1 * (1 - err), 6) AS credibility FROM v JOIN h USING (source)""")
def source_credibility(spark, d):
    v = R.source_volume(views.articles(spark, d), events(spark, d))
    h = views.crawl_outcomes(spark, d).groupBy(F.concat(F.lit("src"), F.col("source_id") % 20).alias("source")).agg((F.count_if(~F.col("ok")) / F.count("*")).alias("err"))
    p = scores.source_parts(1 - F.col("err"), F.col("err"), F.col("n_articles").cast("double"), F.col("n_articles"), F.col("n_corroborated") / F.col("n_articles"))
    return v.join(h, "source").select("source", F.round(scores.source_credibility(p), 6).alias("credibility"))


LENGTH_SQL = """CASE WHEN n <= 30 THEN 15e-2 * least(1e0, n / 30) WHEN n < 600 THEN 15e-2 + 85e-2 * (5e-1 * least(1e0, greatest(0e0, (n - 30) / 90)) + 5e-1 * least(1e0, greatest(0e0, (n - 120) / 480)))
 WHEN n <= 1500 THEN 1e0 WHEN n <= 4000 THEN 1 - 15e-2 * ((n - 1500) / 2500) ELSE greatest(15e-2, 85e-2 - 7e-1 * least(1e0, (n - 4000) / 8000)) END"""
TITLE_SQL = """CASE WHEN length(t) = 0 THEN 0e0 ELSE (CASE WHEN length(t) < 30 THEN least(1e0, greatest(0e0, (length(t) - 15) / 15)) WHEN length(t) <= 90 THEN 1e0 ELSE 1 - least(1e0, (length(t) - 90) / 70) END)
 * (5e-1 + 5e-1 * (CASE WHEN letters > 0 THEN 1 - least(1e0, greatest(0e0, (upper_n / letters - 35e-2) / 5e-1)) ELSE 1e0 END)) * (5e-1 + 5e-1 * (1 - least(1e0, marks / 3))) END"""
TITLES_SQL = f"{views.ARTICLES_SQL}, x AS (SELECT id, trim(title) AS t, len(regexp_extract_all(body, '[^ \\t-\\r]+')) AS n, len(regexp_extract_all(title, '\\p{{L}}')) AS letters, len(regexp_extract_all(title, '\\p{{Lu}}')) AS upper_n, len(regexp_extract_all(title, '[!?]')) AS marks, published_at IS NOT NULL AS timed FROM articles)"


@query("article_quality", f"WITH {TITLES_SQL}, q AS (SELECT id, {LENGTH_SQL} AS len_score, {TITLE_SQL} AS title_score, timed FROM x) SELECT id, round(len_score + 33e-10, 6) AS length_score, round(title_score + 33e-10, 6) AS title_quality, round(33e-10 + 25e-2 * len_score + 22e-2 * 5e-1 + 13e-2 * timed::INT + 13e-2 * title_score + 12e-2 * 7e-1 + 1e-1 * (id % 2) + 5e-2, 6) AS quality FROM q")
def article_quality(spark, d):
    a = views.articles(spark, d).withColumn("n", text.word_count(F.col("body")))
    p = scores.article_parts(F.col("n"), F.col("id") % 2 == 1, F.col("published_at").isNotNull(), F.lit(0.7), F.col("title"), F.lit(0.0), F.lit(None).cast("double"))
    return a.select("id", rounded(p["length"], "length_score"), rounded(p["title_quality"], "title_quality"), rounded(scores.article_quality(p), "quality"))


def marker_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(set(words))) + ")"


@query("subjectivity", f"""WITH t AS (SELECT p_partkey AS id, regexp_extract_all(lower(p_name || ' clearly ' || p_type || (CASE WHEN p_partkey % 3 = 0 THEN ' may be AMAZING' ELSE ' it is' END)), '\\w+') AS w FROM part)
SELECT id, round(h / (h + 6e-2), 6) AS subjectivity FROM (SELECT id, len([x for x in w if x IN {marker_list([*scores.SUBJECTIVE, *scores.HEDGING])}]) / len(w) AS h FROM t)""")
def subjectivity(spark, d):
    p = views.table(spark, d, "part")
    phrase = F.concat("p_name", F.lit(" clearly "), "p_type", F.when(F.col("p_partkey") % 3 == 0, " may be AMAZING").otherwise(" it is"))
    words = p.select(F.col("p_partkey").alias("id"), scores.tokens(phrase).alias("w"))
    return words.select("id", F.round(scores.subjectivity(F.col("w")), 6).alias("subjectivity"))


@query("sensationalism", f"""WITH t AS (SELECT p_partkey AS id, p_name || (CASE WHEN p_partkey % 4 = 0 THEN ' SHOCKING!! worst ever?' ELSE ' Of The Day' END) AS t FROM part),
x AS (SELECT id, len(regexp_extract_all(t, '\\p{{Lu}}')) / len(regexp_extract_all(t, '\\p{{L}}')) AS caps, len(regexp_extract_all(t, '[!?]')) / greatest(1, len(regexp_extract_all(t, '\\b\\p{{L}}{{2,}}\\b'))) AS m, regexp_extract_all(lower(t), '\\w+') AS w FROM t),
y AS (SELECT *, len([z for z in w if z IN {marker_list(scores.SUPERLATIVE)}]) / len(w) AS s FROM x)
SELECT id, round((caps + m / (m + 34e-2) + s / (s + 15e-2)) / 3, 6) AS sensationalism FROM y""")
def sensationalism(spark, d):
    p = views.table(spark, d, "part")
    title = F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, " SHOCKING!! worst ever?").otherwise(" Of The Day"))
    t = p.select(F.col("p_partkey").alias("id"), title.alias("t")).withColumn("w", scores.tokens(F.col("t")))
    return t.select("id", F.round(scores.sensationalism(F.col("t"), F.col("w")), 6).alias("sensationalism"))


@query("fetch_cadence", """SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 900 WHEN c_mktsegment = 'BUILDING' THEN 300 ELSE 3600 END::DOUBLE * (CASE c_custkey % 5 WHEN 1 THEN 15e-1 WHEN 2 THEN 3e0 WHEN 3 THEN 6e0 ELSE 1e0 END) AS seconds, (CASE least(3, c_custkey % 5) WHEN 0 THEN 1e0 WHEN 1 THEN 5e-1 WHEN 2 THEN 2e-1 ELSE 1e-1 END) AS rps FROM customer""")
def fetch_cadence(spark, d):
    c = views.table(spark, d, "customer")
    cats = F.array(F.when(F.col("c_mktsegment") == "MACHINERY", "Tech").when(F.col("c_mktsegment") == "BUILDING", "Markets").otherwise("niche"))
    tier = (F.col("c_custkey") % 5).cast("int")
    return c.select(F.col("c_custkey").alias("id"), scores.cadence_seconds(cats, tier).cast("double").alias("seconds"), scores.politeness(tier)["rps"].alias("rps"))


@query("model_costs", "SELECT p_brand, round(sum(CASE WHEN p_type LIKE 'ECONOMY%' THEN p_size * 1e-6 + p_retailprice * 5e-6 WHEN p_type LIKE 'STANDARD%' THEN p_size * 3e-6 + p_retailprice * 15e-6 ELSE 0e0 END) + 33e-10, 6) AS cost_usd FROM part GROUP BY p_brand")
def model_costs(spark, d):
    p = views.table(spark, d, "part")
    model = F.when(F.col("p_type").like("ECONOMY%"), "claude-haiku-x").when(F.col("p_type").like("STANDARD%"), "claude-sonnet-x").otherwise("other")
    return p.groupBy("p_brand").agg(rounded(F.sum(scores.cost_usd(model, F.col("p_size"), F.col("p_retailprice"))), "cost_usd"))
