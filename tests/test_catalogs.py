"""Registry, catalog, selectors, robots, topics, the dataflow, alerts and metrics."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.operators import analyze, graph, neighbours, series, signals, sources, store
from tidewire.sources import connectors, html, robots
from tidewire.streaming import dataflow, streams

T0 = datetime(2026, 1, 1)


def test_catalog_merge_is_sequential(spark):
    rng = random.Random(2)
    pick = lambda kind, n: rng.choice([None, f"{kind}{rng.randrange(n)}", f"{kind.upper()}{rng.randrange(n)}"])
    base = [(f"n{k}", f"f{k}", f"h{k}") for k in range(6)]
    extra = [(k, pick("n", 40), pick("f", 40), pick("h", 40)) for k in range(90)]
    seen = [{x.lower() for x in column} for column in zip(*base, strict=True)]
    want = []
    for pos, *keys in extra:
        low = [k and k.lower() for k in keys]
        if not any(k in s for k, s in zip(low, seen, strict=True) if k):
            want.append(pos)
            for k, s in zip(low, seen, strict=True):
                s.add(k)
    b = spark.createDataFrame(base, "name string, feed_url string, homepage_url string").withColumn("pos", F.lit(None).cast("bigint"))
    e = spark.createDataFrame(extra, "pos bigint, name string, feed_url string, homepage_url string")
    got = store.merge_catalog(b, e).filter("pos is not null").select("pos").collect()
    assert sorted(r["pos"] for r in got) == want and len(want) > 10


def test_corrections_and_updates(spark):
    c = spark.createDataFrame([(1, "A", "x", True), (2, "B", "y", False)], "id bigint, name string, feed_url string, enabled boolean")
    fixed = store.apply_corrections(c, spark.createDataFrame([("a", "z")], "name string, feed_url string"))
    assert sorted(map(tuple, fixed.collect())) == [(1, "A", "z", True), (2, "B", "y", False)]
    assert [r["enabled"] for r in sources.enable(c, 2).orderBy("id").collect()] == [True, True]
    with pytest.raises(ValueError):
        sources.update_source(c, 1, {"nothing": 1})
    assert sources.lookup(c, "id", 9).isEmpty() and sources.in_lists(c, id=[]).isEmpty()


def test_selectors_and_robots():
    page = '<div id="top"><ul class="a b"><li><a class="headline" href="/1">x</a></li></ul></div><p><a data-k="v" href="/2#f">y</a></p><a href="mailto:x">m</a>'
    links = lambda s: html.article_links(page, "http://h.example/", selector=s)
    assert links(None) == ["http://h.example/1", "http://h.example/2"]
    assert links("a.headline") == links("#top a") == links("div .b a.headline") == links("ul.a.b a") == ["http://h.example/1"]
    assert links("[data-k=v]") == links("p a") == ["http://h.example/2"] and links("p a, #top a") == links(None) and links("ol a") == []
    text = "User-agent: one\nUser-agent: two\nDisallow: /a\nAllow: /a/b$\n\nUser-agent: *\nDisallow: /\n"
    ok = lambda agent, path: robots.allowed(text, agent, f"http://h.example{path}")
    assert ok("One/2.0", "/b") and not ok("two", "/a/x") and ok("two", "/a/b") and not ok("two", "/a/bc") and not ok("three", "/") and ok("three", "/robots.txt")
    assert robots.allowed(None, "x", "http://h.example/a")
    assert html.feed_like("http://h.example/x/RSS.xml") and html.feed_like("http://h.example/feed/") and not html.feed_like("http://h.example/newsfeed") and not html.feed_like("http://h.example/rss/about")


def test_as_of_over_spans_equals_a_loop(spark):
    rng = random.Random(7)
    left = [(k, rng.choice("ab"), T0 + timedelta(minutes=rng.randrange(9000))) for k in range(200)]
    right = [(rng.choice("ab"), T0 + timedelta(minutes=7 * rng.randrange(1200)), float(k)) for k in range(40)]
    right = list({(s, t): (s, t, v) for s, t, v in right}.values())
    got = signals.as_of_join(spark.createDataFrame(left, "id bigint, symbol string, at timestamp"), spark.createDataFrame(right, "symbol string, ts timestamp, price double"), ["symbol"], "at", "ts", "price", 3600)
    want = {k: max(((t, v) for r, t, v in right if r == s and t <= at), default=(None, None))[1] for k, s, at in left}
    assert {r["id"]: r["price"] for r in got.collect()} == want


def test_components_of_a_long_path(spark):
    path = [(k, k + 1) for k in range(150)] + [(1000, 1001), (5, 5)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(path, "src bigint, dst bigint")).collect()}
    assert got == {**dict.fromkeys(range(151), 0), 1000: 1000, 1001: 1000}


def test_running_means_equal_the_mean_of_all(spark):
    rows = [(k % 3, [float(k), float(k * k % 7)]) for k in range(20)]
    df = spark.createDataFrame(rows, "event_id bigint, embedding array<double>")
    both = neighbours.add_to_events(neighbours.centroids(spark.createDataFrame(rows[:9], df.schema)), spark.createDataFrame(rows[9:], df.schema))
    want = {r["event_id"]: (r["n"], r["centroid"]) for r in neighbours.centroids(df).collect()}
    for r in both.collect():
        assert r["n"] == want[r["event_id"]][0] and r["centroid"] == pytest.approx(want[r["event_id"]][1], rel=1e-5)


def test_link_tables_make_mentions(spark):
    a = spark.createDataFrame([(1, 7, T0), (2, 8, T0 + timedelta(minutes=5)), (3, 7, None)], "id bigint, source_id bigint, published_at timestamp")
    e = spark.createDataFrame([(5, 1), (5, 2), (5, 2), (6, 3)], "target_id bigint, article_id bigint")
    t = spark.createDataFrame([(5, 1)], "target_id bigint, article_id bigint")
    got = sorted((r["target_type"], r["target_id"], r["count"], r["source_count"]) for r in series.mention_buckets(series.mentions_of(a, entity=e, topic=t)).collect())
    assert got == [("entity", 5, 2, 2), ("topic", 5, 1, 1)]


def raw(spark, rows):
    return spark.createDataFrame([(k, f"http://a.example/{k}", None, page, f"T{k}", None, [], T0 + timedelta(hours=h)) for k, page, h in rows], dataflow.RAW)


def test_dataflow_takes_revisions_and_replays(spark, tmp_path):
    flow = dataflow.Dataflow(spark, str(tmp_path), analyze.OfflineProvider(), ("keywords", "entities", "embedding"))
    connectors.create_topics(spark, str(tmp_path))
    assert set(schemas.TOPIC_NAMES) <= set(connectors.list_topics(spark, str(tmp_path)))
    connectors.write_topic(raw(spark, [(1, "<p>first words here</p>", 0), (2, "<p>other words there</p>", 0), (3, "", 0)]), flow.topic("raw.documents"), "url")
    flow.run_once()
    first = {r["url"][-1]: r["body"] for r in flow.articles().collect()}
    assert first == {"1": "first words here", "2": "other words there"}
    assert [r["reason"] for r in spark.read.parquet(flow.topic("dead.letters")).collect()] == ["no_content"]
    # The same article again, a revision, and a new one.
    connectors.write_topic(raw(spark, [(1, "<p>first words here</p>", 1), (2, "<p>changed words there</p>", 1), (4, "<p>new words</p>", 1)]), flow.topic("raw.documents"), "url")
    flow.run_once()
    assert {r["url"][-1]: r["body"] for r in flow.articles().collect()} == {"1": "first words here", "2": "changed words there", "4": "new words"}
    assert [r["body"] for r in flow.table("article_versions").collect()] == ["other words there"]
    results = spark.read.parquet(flow.topic("analyze.results"))
    assert results.groupBy("target_id").count().filter("count = 6").count() == 1 and results.count() == 12
    terms = flow.table("article_keywords").join(flow.table("keywords").select("keyword_id", "term").distinct(), "keyword_id")
    assert {"first", "changed", "other"} <= {r["term"] for r in terms.collect()}
    assert flow.table("embeddings").count() == 4 and flow.table("failed").isEmpty()
    flow.run_once()  # nothing new: nothing changes
    assert flow.articles().count() == 3 and spark.read.parquet(flow.topic("analyze.results")).count() == 12
    mentions = spark.createDataFrame([("topic", 1, k, k % 4, T0 + timedelta(minutes=50 * k)) for k in range(30)], "target_type string, target_id bigint, article_id bigint, source_id bigint, published_at timestamp")
    flow.detect(mentions, mentions.select(*series.KEYS).distinct().withColumn("label", F.lit("one")), 0.0)
    assert [r["label"] for r in spark.read.parquet(flow.topic("issues.alerts")).collect()] == ["one"]


def test_seen_articles_pass_once(spark, tmp_path):
    schema = "canonical_url string, content_hash string, fetched_at timestamp"
    for k, rows in enumerate([[("u", "h", T0), ("u", "h", T0), ("v", "h", T0)], [("u", "h", T0 + timedelta(hours=1)), ("u", "g", T0 + timedelta(hours=1))]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        streams.run(streams.seen_once(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/c", ("parquet", {"path": f"{tmp_path}/out"})).awaitTermination()
    assert sorted((r[0], r[1]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("u", "g"), ("u", "h"), ("v", "h")]


def test_token_buckets_in_state_equal_the_batch(spark, tmp_path):
    schema = "domain string, at timestamp, url string"
    rows = [(f"d{k % 2}", T0 + timedelta(seconds=k * k % 37), f"u{k}") for k in range(24)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = streams.run(streams.limit_rate(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/c", ("parquet", {"path": f"{tmp_path}/out"}), once=False, every="1 second")
        end = time.time() + 60
        while not any(p["numInputRows"] for p in q.recentProgress) and q.isActive and time.time() < end:
            time.sleep(0.3)
        q.stop()
    finally:
        spark.conf.unset(key)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("domain", "url", "allowed").collect()))
    assert got == sorted(map(tuple, streams.limit_rate_batch(spark.createDataFrame(rows, schema)).collect())) and {a for *_, a in got} == {True, False}


def test_alert_readers_get_what_comes_later(spark, tmp_path):
    alert = lambda k: spark.createDataFrame([(1, "topic", k, "l", T0, T0, 0.9, 0.1, [k])], schemas.ISSUE_ALERT)
    alert(1).write.mode("append").parquet(f"{tmp_path}/alerts")
    got: list[int] = []
    q = dataflow.alert_reader(spark, f"{tmp_path}/alerts", "me", f"{tmp_path}/c", lambda df: got.extend(r["target_id"] for r in df.collect()))
    q.processAllAvailable()
    alert(2).write.mode("append").parquet(f"{tmp_path}/alerts")
    q.processAllAvailable()
    q.stop()
    assert got == [2]


def test_periodic_work_and_query_metrics(spark, tmp_path):
    seen: list[int] = []
    listener = dataflow.QueryMetrics()
    spark.streams.addListener(listener)
    q = dataflow.periodic(spark, seen.append, f"{tmp_path}/c", "200 milliseconds")
    end = time.time() + 30
    while (len(seen) < 3 or not listener.batches) and time.time() < end:
        time.sleep(0.2)
    q.stop()
    spark.streams.removeListener(listener)
    assert seen[:3] == [0, 1, 2] and sum(listener.batches.values()) >= 1 and not listener.failed
    assert dataflow.every(60) == "60 minutes" and dataflow.every(0) == "1 minutes"


def test_request_metrics_and_their_text(spark):
    df = spark.createDataFrame([("GET", 0.004), ("GET", 0.3), ("GET", 99.0)], "method string, s double")
    rows = [r.asDict() for r in dataflow.request_metrics(df, F.col("s"), "method", bounds=(0.01, 1.0)).orderBy("bound").collect()]
    assert [(r["bound"], r["at_most"]) for r in rows] == [(0.01, 1), (1.0, 2), (float("inf"), 3)]
    text = dataflow.exposition("http", rows, ["method"])
    assert 'http_seconds_bucket{method="GET",le="+Inf"} 3' in text and 'http_seconds_count{method="GET"} 3' in text
