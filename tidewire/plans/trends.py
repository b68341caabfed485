"""Queries over mention series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import emerging, series
from tidewire.plans import views
from tidewire.plans.registry import query, rounded

B = f"WITH {views.BUCKETS_SQL}"
#: The scored series, one row of the recursion a bucket.
EWMA_SQL = f"""RECURSIVE {views.BUCKETS_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY target_type, target_id ORDER BY bucket) AS i FROM buckets),
fold AS (SELECT target_type, target_id, bucket, count, source_count, i, count::DOUBLE AS m, 0e0 AS v, 0e0 AS z FROM numbered WHERE i = 1
  UNION ALL SELECT n.target_type, n.target_id, n.bucket, n.count, n.source_count, n.i, f.m + 3e-1 * (n.count - f.m), 7e-1 * (f.v + 3e-1 * (n.count - f.m) * (n.count - f.m)),
  CASE WHEN n.i > 3 THEN (n.count - f.m) / greatest(sqrt(f.v), sqrt(greatest(f.m, 0e0)), 1e0) ELSE 0e0 END
  FROM fold f JOIN numbered n ON n.target_type = f.target_type AND n.target_id = f.target_id AND n.i = f.i + 1),
scored AS (SELECT target_type, target_id, bucket, count, source_count, z AS zscore FROM fold)"""
LATEST_SQL = "latest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY target_type, target_id ORDER BY bucket DESC) = 1)"


def buckets(spark: SparkSession, d: str) -> DataFrame:
    return series.mention_buckets(views.mentions(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return series.ewma_scores(buckets(spark, d))


@query("mention_buckets", f"{B} SELECT * FROM buckets")
def mention_buckets(spark, d):
    return buckets(spark, d)


@query("velocity", f"""{B} SELECT *, round(coalesce((count - lag(count) OVER w) / greatest(epoch_us(bucket - lag(bucket) OVER w) / 60e6, 60e0), 0e0), 6) AS velocity
FROM buckets WINDOW w AS (PARTITION BY target_type, target_id ORDER BY bucket)""")
def velocity(spark, d):
    return series.velocity_per_minute(buckets(spark, d)).withColumn("velocity", F.round("velocity", 6))


@query("ewma_zscore", f"WITH {EWMA_SQL} SELECT target_type, target_id, bucket, count, source_count, round(zscore, 6) AS zscore FROM scored")
def ewma_zscore(spark, d):
    return scored(spark, d).withColumn("zscore", F.round("zscore", 6))


@query("latest_buckets", f"{B} SELECT * FROM buckets QUALIFY row_number() OVER (PARTITION BY target_type, target_id ORDER BY bucket DESC) = 1")
def latest_buckets(spark, d):
    return series.latest(buckets(spark, d))


@query("top_trends", f"WITH {EWMA_SQL}, {LATEST_SQL} SELECT target_type, target_id, bucket, count, source_count, round(zscore, 6) AS zscore FROM latest ORDER BY latest.zscore DESC, target_type, target_id LIMIT 3")
def top_trends(spark, d):
    return emerging.top_trends(scored(spark, d), "zscore", None, 3).withColumn("zscore", F.round("zscore", 6))


@query("top_trends_velocity", f"""{B}, v AS (SELECT *, coalesce((count - lag(count) OVER w) / greatest(epoch_us(bucket - lag(bucket) OVER w) / 60e6, 60e0), 0e0) AS velocity
FROM buckets WINDOW w AS (PARTITION BY target_type, target_id ORDER BY bucket)), l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY target_type, target_id ORDER BY bucket DESC) = 1)
SELECT target_type, target_id, bucket, count, source_count, round(velocity, 6) AS velocity FROM l WHERE target_type = 'topic' ORDER BY l.velocity DESC, target_type, target_id LIMIT 3""")
def top_trends_velocity(spark, d):
    return emerging.top_trends(series.velocity_per_minute(buckets(spark, d)), "velocity", "topic", 3).withColumn("velocity", F.round("velocity", 6))


@query("issues_zscore", f"WITH {EWMA_SQL}, {LATEST_SQL} SELECT target_type, target_id, bucket, count, source_count, round(zscore, 6) AS zscore FROM latest WHERE latest.zscore >= 0e0")
def issues_zscore(spark, d):
    return emerging.issues_by_z(scored(spark, d), 0.0).withColumn("zscore", F.round("zscore", 6))


@query("issue_history", f"WITH {EWMA_SQL} SELECT target_type, target_id, bucket, count, source_count, round(zscore, 6) AS zscore FROM scored WHERE target_type = 'topic' AND target_id = 3 AND scored.zscore >= 15e-1 ORDER BY bucket DESC LIMIT 50")
def issue_history(spark, d):
    return emerging.issue_history(scored(spark, d), "topic:3", 1.5).withColumn("zscore", F.round("zscore", 6))


@query("trend_series", f"{B} SELECT bucket, count, source_count FROM buckets WHERE target_type = 'topic' AND target_id = 1 AND bucket >= (SELECT max(ts) FROM events)::TIMESTAMP - INTERVAL 168 HOUR")
def trend_series(spark, d):
    m = views.mentions(spark, d)
    end = m.agg(F.max("published_at").alias("end"))
    b = buckets(spark, d).filter("target_type = 'topic' and target_id = 1").crossJoin(F.broadcast(end))
    return b.filter(F.col("bucket") >= F.col("end") - F.expr("INTERVAL 168 HOURS")).select("bucket", "count", "source_count").orderBy("bucket")


SEASONAL_SQL = f"""{views.BUCKETS_SQL}, s AS (SELECT *, count(*) OVER k AS n, avg(count) OVER k AS mean, count(*) OVER slot AS k_slot, avg(count) OVER slot AS m_slot FROM buckets
  WINDOW k AS (PARTITION BY target_type, target_id), slot AS (PARTITION BY target_type, target_id, dayofweek(bucket), hour(bucket))),
i AS (SELECT *, CASE WHEN k_slot >= 2 AND mean > 0 THEN m_slot / mean ELSE 1e0 END AS idx FROM s),
j AS (SELECT *, avg(idx) OVER (PARTITION BY target_type, target_id) AS norm FROM i),
base AS (SELECT target_type, target_id, bucket, count, source_count, CASE WHEN n >= 2 * 168 AND mean > 0 AND norm > 0 THEN mean * idx / norm ELSE mean END AS expected, n >= 2 * 168 AND mean > 0 AS seasonal FROM j),
r AS (SELECT *, count - expected AS residual, median(count - expected) OVER (PARTITION BY target_type, target_id) AS centre FROM base),
q AS (SELECT *, median(abs(residual - centre)) OVER (PARTITION BY target_type, target_id) AS mad FROM r)"""


@query("seasonal_profile", f"WITH {SEASONAL_SQL} SELECT target_type, target_id, bucket, count, source_count, round(expected, 6) AS expected, seasonal FROM base")
def seasonal_profile(spark, d):
    return series.seasonal_baseline(buckets(spark, d)).withColumn("expected", F.round("expected", 6))


@query("robust_z", f"WITH {SEASONAL_SQL} SELECT target_type, target_id, bucket, round((residual - centre) / greatest(mad / 6745e-4, 1e-9) + 33e-10, 6) AS robust_z FROM q")
def robust_z(spark, d):
    return series.robust_scores(buckets(spark, d)).select("target_type", "target_id", "bucket", rounded("robust_z"))


@query("accel", f"""{B}, x AS (SELECT *, (count - lag(count) OVER w)::DOUBLE AS d, row_number() OVER w AS n FROM buckets WINDOW w AS (PARTITION BY target_type, target_id ORDER BY bucket)),
y AS (SELECT *, lag(d) OVER w AS d1, lag(d, 2) OVER w AS d3 FROM x WINDOW w AS (PARTITION BY target_type, target_id ORDER BY bucket)),
l AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY target_type, target_id ORDER BY bucket DESC) = 1)
SELECT target_type, target_id, n, round(CASE WHEN n >= 4 THEN (d1 + 2 * d) / 3 WHEN n = 3 THEN (d1 + d) / 2 WHEN n = 2 THEN d ELSE 0e0 END, 6) AS velocity,
  round(CASE WHEN n >= 4 THEN (d - d3) / 3 WHEN n = 3 THEN (d - d1) / 2 WHEN n = 2 THEN d ELSE 0e0 END, 6) AS acceleration FROM l""")
def accel(spark, d):
    return series.smooth_velocity_columns(buckets(spark, d)).withColumn("velocity", F.round("velocity", 6)).withColumn("acceleration", F.round("acceleration", 6))


@query("cusum", f"""WITH RECURSIVE {views.BUCKETS_SQL}, x AS (SELECT target_type, target_id, bucket, count::DOUBLE AS c, row_number() OVER w AS i, (count - lag(count) OVER w)::DOUBLE AS d FROM buckets WINDOW w AS (PARTITION BY target_type, target_id ORDER BY bucket)),
mid AS (SELECT target_type, target_id, median(d) AS m FROM x GROUP BY ALL),
sd AS (SELECT target_type, target_id, greatest(median(abs(d - m)) / (6745e-4 * sqrt(2)), 1e-9) AS sigma FROM x JOIN mid USING (target_type, target_id) GROUP BY ALL),
f AS (SELECT x.target_type, x.target_id, x.bucket, x.i, x.c AS mu, 0e0 AS su, 0e0 AS sd, 0e0 AS up, 0e0 AS down, false AS alarm FROM x WHERE i = 1
  UNION ALL SELECT x.target_type, x.target_id, x.bucket, x.i, CASE WHEN greatest(a.h, a.l) > 8e0 THEN x.c ELSE f.mu + 1e-1 * (x.c - f.mu) END,
    CASE WHEN greatest(a.h, a.l) > 8e0 THEN 0e0 ELSE a.h END, CASE WHEN greatest(a.h, a.l) > 8e0 THEN 0e0 ELSE a.l END, a.h, a.l, greatest(a.h, a.l) > 8e0
  FROM f JOIN x ON x.target_type = f.target_type AND x.target_id = f.target_id AND x.i = f.i + 1 JOIN sd ON sd.target_type = x.target_type AND sd.target_id = x.target_id,
  LATERAL (SELECT greatest(0e0, f.su + (x.c - f.mu) / sd.sigma - 5e-1) AS h, greatest(0e0, f.sd - (x.c - f.mu) / sd.sigma - 5e-1) AS l) a)
SELECT target_type, target_id, bucket, round(up, 5) AS s_up, round(down, 5) AS s_down, alarm FROM f""")
def cusum(spark, d):
    return series.changepoints(buckets(spark, d)).select("target_type", "target_id", "bucket", F.round("s_up", 5).alias("s_up"), F.round("s_down", 5).alias("s_down"), "alarm")


#: Run lengths' log masses as lists, one step of the recursion a bucket.
BOCPD_SQL = f"""WITH RECURSIVE {views.BUCKETS_SQL}, x AS (SELECT target_type, target_id, bucket, count::DOUBLE AS c, row_number() OVER w AS i, sum(count) OVER w AS s FROM buckets WINDOW w AS (PARTITION BY target_type, target_id ORDER BY bucket)),
a AS (SELECT target_type, target_id, greatest(var_pop(c), 1e-9) AS var, avg(c) AS prior, least(256, count(*) + 1) AS size, list_prepend(0e0, list(s::DOUBLE ORDER BY i)) AS sums FROM x GROUP BY ALL),
f AS (SELECT target_type, target_id, bucket, i, [ln(1 / 5e1), ln(1 - 1 / 5e1)] AS m FROM x WHERE i = 1
  UNION ALL SELECT x.target_type, x.target_id, x.bucket, x.i, [v - t.lse FOR v IN g.grown]
  FROM f JOIN x ON x.target_type = f.target_type AND x.target_id = f.target_id AND x.i = f.i + 1 JOIN a ON a.target_type = x.target_type AND a.target_id = x.target_id,
  LATERAL (SELECT list_transform(range(len(f.m)), lambda r: f.m[r + 1] - pow(x.c - (a.sums[x.i] - a.sums[x.i - least(r + 1, x.i - 1)]) / least(r + 1, x.i - 1), 2) / (2 * a.var)) AS joint) j,
  LATERAL (SELECT list_prepend(list_max(j.joint) + ln(list_sum([exp(v - list_max(j.joint)) FOR v IN j.joint])) + ln(1 / 5e1), [v + ln(1 - 1 / 5e1) FOR v IN j.joint[1:(a.size - 1)::BIGINT]]) AS grown) g,
  LATERAL (SELECT list_max(g.grown) + ln(list_sum([exp(v - list_max(g.grown)) FOR v IN g.grown])) AS lse) t)
SELECT target_type, target_id, bucket, round(least(1e0, exp(m[1]) + exp(m[2])), 6) AS reset_prob FROM f"""


@query("bocpd", BOCPD_SQL)
def bocpd(spark, d):
    return series.changepoints(buckets(spark, d)).select("target_type", "target_id", "bucket", F.round("reset_prob", 6).alias("reset_prob"))


def levels_sql(source: str) -> str:
    """CTEs up to `path` (target_type, target_id, i, bucket, level, gain): the least path through the levels, forth and back."""
    return f"""RECURSIVE {source}, x AS (SELECT target_type, target_id, bucket, count::DOUBLE AS c, row_number() OVER (PARTITION BY target_type, target_id ORDER BY bucket) AS i FROM buckets),
p AS (SELECT target_type, target_id, count(*) AS n, avg(c) AS base, ln(greatest(count(*), 2)) AS tau, least(greatest(1 + ceil(log2(count(*))), 2), 16)::INT AS k FROM x GROUP BY ALL),
e AS (SELECT x.*, p.n, p.tau, p.k, list_transform(range(p.k), lambda j: greatest(p.base * pow(2, j), 1e-9) - x.c * ln(greatest(p.base * pow(2, j), 1e-9))) AS emit FROM x JOIN p USING (target_type, target_id)),
f AS (SELECT target_type, target_id, i, list_transform(range(k), lambda j: emit[j + 1] + j * tau) AS cost, []::BIGINT[] AS back FROM e WHERE i = 1
  UNION ALL SELECT e.target_type, e.target_id, e.i, list_transform(range(e.k), lambda j: list_min(t.through[j + 1]) + e.emit[j + 1]), list_transform(t.through, lambda y: list_position(y, list_min(y))::BIGINT - 1)
  FROM f JOIN e ON e.target_type = f.target_type AND e.target_id = f.target_id AND e.i = f.i + 1,
  LATERAL (SELECT list_transform(range(e.k), lambda j: list_transform(range(e.k), lambda q: f.cost[q + 1] + e.tau * greatest(j - q, 0))) AS through) t),
g AS (SELECT f.target_type, f.target_id, f.i, list_position(cost, list_min(cost))::BIGINT - 1 AS level, back FROM f JOIN p ON p.target_type = f.target_type AND p.target_id = f.target_id AND p.n = f.i
  UNION ALL SELECT f.target_type, f.target_id, f.i, g.back[g.level + 1], f.back FROM g JOIN f ON f.target_type = g.target_type AND f.target_id = g.target_id AND f.i = g.i - 1),
path AS (SELECT e.target_type, e.target_id, e.i, e.bucket, g.level, e.emit[1] - e.emit[g.level + 1] AS gain FROM g JOIN e ON e.target_type = g.target_type AND e.target_id = g.target_id AND e.i = g.i)"""


def rising(spark, d) -> DataFrame:
    return series.mention_buckets(views.rising(spark, d))


@query("burst_levels", f"WITH {levels_sql(views.BUCKETS_SQL)} SELECT target_type, target_id, bucket, level::INT AS level FROM path")
def burst_levels(spark, d):
    return series.burst_levels(buckets(spark, d))


@query("burst_intervals", f"""WITH {levels_sql(views.RISING_BUCKETS_SQL)}, h AS (SELECT *, i - row_number() OVER (PARTITION BY target_type, target_id ORDER BY i) AS run FROM path WHERE level > 0)
SELECT target_type, target_id, min(bucket) AS first_bucket, max(bucket) AS last_bucket, max(level)::INT AS level, round(sum(gain), 4) AS weight FROM h GROUP BY target_type, target_id, run""")
def burst_intervals(spark, d):
    return series.burst_intervals(rising(spark, d)).withColumn("weight", F.round("weight", 4))


def emerging_sql(source: str) -> str:
    """CTEs up to `ranked`: the features of each target's last bucket and their blend."""
    seasonal = SEASONAL_SQL.replace(views.BUCKETS_SQL + ", s AS", "s AS")
    return f"""{levels_sql(source)}, {seasonal.replace(" p AS", " pp AS")},
rz AS (SELECT *, (residual - centre) / greatest(mad / 6745e-4, 1e-9) AS robust_z FROM q QUALIFY row_number() OVER (PARTITION BY target_type, target_id ORDER BY bucket DESC) = 1),
d1 AS (SELECT *, (count - lag(count) OVER w)::DOUBLE AS d, row_number() OVER w AS nn FROM buckets WINDOW w AS (PARTITION BY target_type, target_id ORDER BY bucket)),
d2 AS (SELECT *, lag(d) OVER w AS db, lag(d, 2) OVER w AS dc FROM d1 WINDOW w AS (PARTITION BY target_type, target_id ORDER BY bucket)),
va AS (SELECT target_type, target_id, CASE WHEN nn >= 4 THEN (db + 2 * d) / 3 WHEN nn = 3 THEN (db + d) / 2 WHEN nn = 2 THEN d ELSE 0e0 END AS velocity, CASE WHEN nn >= 4 THEN (d - dc) / 3 WHEN nn = 3 THEN (d - db) / 2 WHEN nn = 2 THEN d ELSE 0e0 END AS acceleration FROM d2 QUALIFY row_number() OVER (PARTITION BY target_type, target_id ORDER BY bucket DESC) = 1),
bl AS (SELECT target_type, target_id, arg_max(level, i)::INT AS burst_level, max(level)::INT AS max_burst_level FROM path GROUP BY ALL),
co AS (SELECT *, CASE WHEN robust_z >= 3 THEN 1 / (1 + exp(3 - robust_z)) ELSE exp(robust_z - 3) / (1 + exp(robust_z - 3)) END AS cz, greatest(0e0, tanh(acceleration / 2)) AS ca, CASE WHEN max_burst_level > 0 THEN burst_level / max_burst_level ELSE 0e0 END AS cb, source_count / (source_count + 5e0) AS cs FROM rz JOIN va USING (target_type, target_id) JOIN bl USING (target_type, target_id)),
ranked AS (SELECT *, round(4e-1 * cz + 25e-2 * ca + 2e-1 * cb + 15e-2 * cs, 6) AS score FROM co)"""


@query("emergingness", f"WITH {emerging_sql(views.BUCKETS_SQL)} SELECT target_type, target_id, bucket, count, source_count, round(robust_z, 4) AS robust_z, round(velocity, 4) AS velocity, round(acceleration, 4) AS acceleration, burst_level, max_burst_level, round(score, 4) AS score FROM ranked")
def emergingness(spark, d):
    out = emerging.rank(buckets(spark, d))
    return out.select("target_type", "target_id", "bucket", "count", "source_count", *[F.round(c, 4).alias(c) for c in ("robust_z", "velocity", "acceleration")], "burst_level", "max_burst_level", F.round("score", 4).alias("score"))


ALERTS_SQL = f"sup AS (SELECT target_type, target_id, array_to_string(list(article_id ORDER BY published_at DESC, article_id DESC)[1:20], ',') AS ids FROM mentions GROUP BY ALL), lab AS (SELECT DISTINCT target_type, target_id, label FROM mentions)"
ALERTS_SELECT = "SELECT target_id, coalesce(label, target_type || ':' || target_id) AS label, bucket AS window_start, bucket + INTERVAL 60 MINUTE AS window_end, round(score, 4) AS score, ids AS supporting_article_ids FROM ranked JOIN sup USING (target_type, target_id) LEFT JOIN lab USING (target_type, target_id)"


def alert_rows(alerts: DataFrame) -> DataFrame:
    return alerts.select("target_id", "label", "window_start", "window_end", F.round("score", 4).alias("score"), F.array_join(F.col("supporting_article_ids").cast("array<string>"), ",").alias("supporting_article_ids"))


@query("alert_history", f"WITH {emerging_sql(views.BUCKETS_SQL)}, {ALERTS_SQL} {ALERTS_SELECT}")
def alert_history(spark, d):
    m = views.mentions(spark, d)
    return alert_rows(emerging.alerts(m, m.select(*series.KEYS, "label").distinct(), 0.0))


@query("emerging_parts", """WITH x AS (SELECT event_id, value / 50 AS z, (value - 100) / 40 AS a, event_id % 7 AS lv, event_id % 3 * 3 AS top, user_id % 20 AS src FROM events),
y AS (SELECT event_id, 1 / (1 + exp(-(z - 3))) AS cz, greatest(0e0, tanh(a / 2)) AS ca, CASE WHEN top > 0 THEN greatest(0e0, least(1e0, lv / top)) ELSE 0e0 END AS cb, src / (src + 5) AS cs FROM x)
SELECT event_id, round(cz, 6) AS c_z, round(ca, 6) AS c_a, round(cb, 6) AS c_b, round(cs, 6) AS c_s, round(4e-1 * cz + 25e-2 * ca + 2e-1 * cb + 15e-2 * cs, 6) AS score FROM y""")
def emerging_parts(spark, d):
    e = views.table(spark, d, "events")
    p = emerging.components(F.col("value") / 50, (F.col("value") - 100) / 40, F.col("event_id") % 7, F.col("event_id") % 3 * 3, F.col("user_id") % 20)
    out = [F.round(p[k], 6).alias(n) for k, n in (("robust_z", "c_z"), ("acceleration", "c_a"), ("burst_level", "c_b"), ("source_diversity", "c_s"))]
    return e.select("event_id", *out, F.round(emerging.emergingness(p), 6).alias("score"))


def label_dim(spark, d):
    return views.mentions(spark, d).filter("target_id <> 2").select("target_type", "target_id", "label").distinct()


@query("issues_emerging", f"WITH {emerging_sql(views.RISING_BUCKETS_SQL)}, {ALERTS_SQL.replace('FROM mentions)', 'FROM mentions WHERE target_id <> 2)')} {ALERTS_SELECT} WHERE ranked.score >= 3e-1")
def issues_emerging(spark, d):
    return alert_rows(emerging.alerts(views.rising(spark, d), label_dim(spark, d), 0.3))


@query("emerging_now", f"WITH {EWMA_SQL}, {LATEST_SQL}, lab AS (SELECT DISTINCT target_type, target_id, label FROM mentions WHERE target_id <> 2) SELECT latest.target_type, latest.target_id, coalesce(label, latest.target_type || ':' || latest.target_id) AS label, bucket, count, source_count, round(latest.zscore, 6) AS zscore FROM latest LEFT JOIN lab USING (target_type, target_id)")
def emerging_now(spark, d):
    out = series.latest(scored(spark, d)).join(F.broadcast(label_dim(spark, d)), series.KEYS, "left")
    return out.select("target_type", "target_id", F.coalesce("label", F.concat_ws(":", "target_type", "target_id")).alias("label"), "bucket", "count", "source_count", F.round("zscore", 6).alias("zscore")).orderBy(F.desc("zscore"), "target_id")


@query("supporting_topk", f"WITH {views.MENTIONS_SQL} SELECT target_type, target_id, article_id, row_number() OVER (PARTITION BY target_type, target_id ORDER BY published_at DESC, article_id DESC)::INT AS rn FROM mentions QUALIFY rn <= 20")
def supporting_topk(spark, d):
    return emerging.supporting(views.mentions(spark, d)).select("target_type", "target_id", "article_id", "rn")


@query("dense_buckets", f"""{B}, s AS (SELECT target_type, target_id, min(bucket) AS a, max(bucket) AS b FROM buckets GROUP BY ALL),
e AS (SELECT target_type, target_id, unnest(generate_series(a, b, INTERVAL 60 MINUTE)) AS bucket FROM s)
SELECT e.target_type, e.target_id, e.bucket, coalesce(count, 0) AS count, coalesce(source_count, 0) AS source_count FROM e LEFT JOIN buckets USING (target_type, target_id, bucket)""")
def dense_buckets(spark, d):
    return series.densify(buckets(spark, d))
