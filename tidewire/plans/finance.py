"""Queries over securities, signals and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import scores
from tidewire.operators import relational, signals
from tidewire.plans import views
from tidewire.plans.registry import query, rounded

ES_SQL = "es AS (SELECT DISTINCT e AS entity_id, security_id, (1 + e % 4) / 4 AS confidence FROM (SELECT security_id, unnest([security_id % 40, (security_id * 7 + 3) % 40]) AS e FROM (SELECT regexp_extract(p_brand, '([0-9]+)$', 1)::BIGINT AS security_id FROM part)))"
BEST_SQL = f"""{views.LINKS_SQL}, {ES_SQL}, b AS (SELECT security_id, article_id, entity_id, least(1e0, greatest(0e0, salience * confidence)) AS magnitude FROM links JOIN es USING (entity_id)),
best AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY security_id, article_id ORDER BY magnitude DESC, entity_id) = 1)"""


def entity_securities(spark, d) -> DataFrame:
    """Two entities a brand."""
    brand = views.table(spark, d, "part").select(F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("bigint").alias("security_id")).distinct()
    both = brand.select("security_id", F.explode(F.array(F.col("security_id") % 40, (F.col("security_id") * 7 + 3) % 40)).alias("entity_id"))
    return both.select("entity_id", "security_id", ((1 + F.col("entity_id") % 4) / 4).alias("confidence")).distinct()


def best(spark, d) -> DataFrame:
    return signals.best_links(views.links(spark, d), entity_securities(spark, d))


@query("best_links", f"WITH {BEST_SQL} SELECT security_id, article_id, entity_id, round(magnitude, 6) AS magnitude FROM best")
def best_links(spark, d):
    return best(spark, d).withColumn("magnitude", F.round("magnitude", 6))


SIGNALS_SQL = f"""{BEST_SQL}, art AS (SELECT o_orderkey AS article_id, TIMESTAMP '2024-01-10' - to_seconds(o_orderkey * 60 % 400000) AS t, o_custkey % 50 AS event_id, (o_totalprice % 200 - 100) / 100 AS sent, o_custkey % 5 / 4 AS nov, o_orderkey % 7 / 6 AS cred FROM orders),
m AS (SELECT security_id, article_id, event_id, magnitude, sent, nov, cred, greatest(0e0, epoch_us(TIMESTAMP '2024-01-10' - t) / 36e8) AS age FROM best JOIN art USING (article_id) WHERE t <= TIMESTAMP '2024-01-10' AND t >= TIMESTAMP '2024-01-10' - INTERVAL 72 HOUR),
s AS (SELECT *, magnitude * (25e-2 + 75e-2 * nov) * (4e-1 + 6e-1 * cred) * pow(2e0, -age / 24e0) AS w FROM m),
c AS (SELECT security_id, article_id, event_id, least(1e0, greatest(-1e0, sent)) * w AS score, w FROM s)"""


def contributions(spark, d) -> DataFrame:
    o = views.table(spark, d, "orders")
    at = F.timestamp_seconds(F.lit(1704844800) - F.col("o_orderkey") * 60 % 400000)
    art = o.select(F.col("o_orderkey").alias("article_id"), at.alias("published_at"), (F.col("o_custkey") % 50).alias("event_id"), ((F.col("o_totalprice") % 200 - 100) / 100).alias("sentiment"), (F.col("o_custkey") % 5 / 4).alias("novelty"), (F.col("o_orderkey") % 7 / 6).alias("credibility"))
    return signals.contributions(best(spark, d), art, F.lit("2024-01-10 00:00:00").cast("timestamp"))


@query("signals", f"""WITH {SIGNALS_SQL} SELECT security_id, round(sum(w * score) / sum(w), 6) AS score, CASE WHEN sum(w * score) / sum(w) > 1e-9 THEN 'bullish' WHEN sum(w * score) / sum(w) < -1e-9 THEN 'bearish' ELSE 'neutral' END AS direction,
round(abs(sum(w * score)) / nullif(sum(w * abs(score)), 0) * (1 - exp(-sum(w) / 2)), 6) AS confidence, count(*)::BIGINT AS n_articles, list(DISTINCT event_id ORDER BY event_id) AS supporting_event_ids, list(article_id ORDER BY article_id)[1:5] AS first_articles FROM c GROUP BY security_id HAVING sum(w) > 0""")
def make_signals(spark, d):
    out = signals.generate_signals(contributions(spark, d), F.lit("2024-01-10 00:00:00").cast("timestamp"))
    return out.select("security_id", F.round("score", 6).alias("score"), "direction", F.round("confidence", 6).alias("confidence"), "components.n_articles", "supporting_event_ids", F.slice("supporting_article_ids", 1, 5).alias("first_articles"))


@query("top_signals", f"WITH {SIGNALS_SQL}, g AS (SELECT security_id, abs(sum(w * score) / sum(w)) AS magnitude FROM c GROUP BY security_id HAVING sum(w) > 0) SELECT security_id, round(magnitude + 33e-10, 6) AS magnitude FROM g WHERE magnitude >= 1e-5 ORDER BY round(g.magnitude + 33e-10, 6) DESC, security_id LIMIT 5")
def top_signals(spark, d):
    out = signals.event_impact(contributions(spark, d), "security_id").filter("abs(score) >= 0.00001").select("security_id", rounded(F.abs("score"), "magnitude"))
    return relational.page(out, [F.desc("magnitude"), F.col("security_id")], 5)


@query("latest_sentiment", "SELECT user_id AS target_id, least(1e0, greatest(-1e0, arg_max(CAST(json_extract(props, '$.k') AS DOUBLE), event_id) / 1e0)) AS value FROM events WHERE event_type = 'view' GROUP BY user_id")
def latest_sentiment(spark, d):
    e = views.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("target_id"), F.col("event_type").alias("kind"), F.col("props").alias("result"))
    return signals.latest_analysis(e, "view", "k")


PRICES_SQL = "prices AS (SELECT event_type AS symbol, time_bucket(INTERVAL 60 MINUTE, ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS ts, round(avg(value) + 10 + 33e-10, 4) AS price FROM events GROUP BY ALL), sig AS (SELECT event_type AS symbol, time_bucket(INTERVAL 60 MINUTE, ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS as_of, max(event_id) % 21 / 10 - 1 AS score FROM events GROUP BY ALL)"
HORIZONS = [1, 6, 24]


def prices(spark, d) -> DataFrame:
    e = views.table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("symbol"), F.window(F.col("ts").cast("timestamp"), "60 minutes").alias("w")).agg(rounded(F.avg("value") + 10, "price", 4)).select("symbol", F.col("w.start").alias("ts"), "price")


def score_rows(spark, d) -> DataFrame:
    e = views.table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("symbol"), F.window(F.col("ts").cast("timestamp"), "60 minutes").alias("w")).agg((F.max("event_id") % 21 / 10 - 1).alias("score")).select("symbol", F.col("w.start").alias("as_of"), "score")


RETURNS_SQL = f"{PRICES_SQL}, h AS (SELECT unnest([1, 6, 24]) AS horizon), r AS (SELECT s.symbol, s.as_of, s.score, h.horizon, b.price / a.price - 1 AS ret FROM sig s, h JOIN prices a ON a.symbol = s.symbol AND a.ts = s.as_of JOIN prices b ON b.symbol = s.symbol AND b.ts = s.as_of + to_hours(h.horizon))"


@query("forward_returns", f"WITH {RETURNS_SQL} SELECT symbol, as_of, horizon, score, round(ret, 6) AS ret FROM r")
def forward_returns(spark, d):
    return signals.forward_returns(score_rows(spark, d), prices(spark, d), HORIZONS).select("symbol", "as_of", "horizon", "score", F.round("ret", 6).alias("ret"))


@query("backtest", f"""WITH {RETURNS_SQL}, k AS (SELECT *, rank() OVER (PARTITION BY horizon ORDER BY score) + (count(*) OVER (PARTITION BY horizon, score) - 1) / 2 AS rx, rank() OVER (PARTITION BY horizon ORDER BY ret) + (count(*) OVER (PARTITION BY horizon, ret) - 1) / 2 AS ry FROM r)
SELECT horizon, count(*)::BIGINT AS n, round(corr(rx, ry), 6) AS ic, round(avg(CASE WHEN abs(score) > 1e-9 AND abs(ret) > 1e-12 THEN (sign(score) = sign(ret))::INT END), 6) AS hit_rate, round(avg(ret), 6) AS mean_return FROM k GROUP BY horizon""")
def backtest(spark, d):
    out = signals.backtest(signals.forward_returns(score_rows(spark, d), prices(spark, d), HORIZONS), HORIZONS)
    return out.select("horizon", "n", *[F.round(c, 6).alias(c) for c in ("ic", "hit_rate", "mean_return")])


@query("car_curve", f"""WITH {PRICES_SQL}, h AS (SELECT unnest([0, 1, 6]) AS lo, unnest([1, 6, 24]) AS horizon), x AS (SELECT symbol, horizon, as_of + to_hours(lo) AS t0, as_of + to_hours(horizon) AS t1 FROM sig, h), r AS (SELECT x.horizon, b.price / a.price - 1 AS ret FROM x JOIN prices a ON a.symbol = x.symbol AND a.ts = x.t0 JOIN prices b ON b.symbol = x.symbol AND b.ts = x.t1),
m AS (SELECT horizon, avg(ret) AS aar FROM r GROUP BY horizon) SELECT horizon, round(aar, 6) AS aar, round(sum(aar) OVER (ORDER BY horizon), 6) AS car FROM m""")
def car_curve(spark, d):
    out = signals.car_curve(signals.step_returns(score_rows(spark, d), prices(spark, d), HORIZONS), HORIZONS)
    return out.select("horizon", F.round("aar", 6).alias("aar"), F.round("car", 6).alias("car"))


@query("as_of_prices", f"WITH {PRICES_SQL}, x AS (SELECT event_id, event_type AS symbol, ts::TIMESTAMP AS t FROM events) SELECT event_id, x.symbol, price FROM x ASOF LEFT JOIN prices ON x.symbol = prices.symbol AND x.t >= prices.ts")
def as_of_prices(spark, d):
    x = views.table(spark, d, "events").select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("at"))
    return signals.as_of_join(x, prices(spark, d), ["symbol"], "at", "ts", "price").select("event_id", "symbol", "price")


@query("security_by_score", "SELECT regexp_extract(p_brand, '([0-9]+)$', 1)::BIGINT AS id, CASE WHEN avg(p_size) > 25 THEN 'bullish' WHEN avg(p_size) < 25 THEN 'bearish' ELSE 'neutral' END AS direction FROM part GROUP BY ALL")
def security_by_score(spark, d):
    p = views.table(spark, d, "part")
    return p.groupBy(F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("bigint").alias("id")).agg(scores.direction(F.avg("p_size") - 25).alias("direction"))
