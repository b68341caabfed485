from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.operators import analyze, neighbours, relational, search, signals, store
from tidewire.sources import connectors, feeds, html
from tidewire.streaming import streams

RSS = """<rss version="2.0"><channel><item><title>One</title><link>http://a.org/1</link><guid>http://a.org/c1</guid><description>d</description>
<pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate><author>Ann</author></item><item><title>No link</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Two</title><link href="http://a.org/2"/><id>urn:2</id><summary>s</summary><content>longer content</content><updated>2026-01-05T10:00:00Z</updated><author><name>Bob</name></author></entry></feed>"""
ARTICLE = """<html><head><title>T</title><meta property="og:title" content="Real title"><meta name="author" content="Jane Doe; John Roe"><meta property="article:published_time" content="2026-01-05T10:00:00Z">
<link rel="canonical" href="http://a.org/c"></head><body><nav>menu menu menu menu menu menu</nav><article><p>First.</p><p>Second part.</p><script>x()</script></article><footer>foot</footer></body></html>"""


def test_feeds():
    (r,), (a,) = feeds.parse_feed(RSS), feeds.parse_feed(ATOM)
    assert (r["url"], r["canonical_url"], r["content"], r["authors"]) == ("http://a.org/1", "http://a.org/c1", "d", ["Ann"])
    assert (a["url"], a["canonical_url"], a["content"], a["published"], a["authors"]) == ("http://a.org/2", None, "longer content", "2026-01-05T10:00:00Z", ["Bob"])
    assert feeds.parse_feed("not xml") == feeds.parse_feed(None) == []
    assert feeds.parse_feed('<!DOCTYPE x [<!ENTITY a "b">]><rss/>') == []
    g = feeds.parse_gdelt('{"articles": [{"url": "http://g/1", "title": " t ", "language": "en"}, {"title": "x"}]}')
    assert len(g) == 1 and g[0]["title"] == "t" and g[0]["headers"] == {"x-gdelt-language": "en"}
    assert feeds.gdelt_params({"max_records": 999})["maxrecords"] == "250" and feeds.parse_newsapi('{"status": "error"}') == []
    assert feeds.parse_sitemap('<urlset xmlns="s"><url><loc>/a</loc></url><url><loc>/a</loc></url></urlset>', "http://h/")["urls"] == ["http://h/a"]
    assert feeds.parse_sitemap("<sitemapindex><sitemap><loc>http://h/s.xml</loc></sitemap></sitemapindex>")["kind"] == "index"
    assert feeds.parse_opml('<opml><body><outline text="g"><outline text="x" xmlUrl="http://f"/></outline></body></opml>') == [{"title": "x", "feed_url": "http://f"}]


def test_pages():
    x = html.extract_article(ARTICLE, "http://a.org/x")
    assert x == {"title": "Real title", "body": "First.\nSecond part.", "authors": ["Jane Doe", "John Roe"], "published": "2026-01-05T10:00:00Z", "canonical_url": "http://a.org/c"}
    assert html.extract_article("", "u")["body"] == ""
    page = '<a href="/a#x">A</a><a href="/a">A</a><a href="mailto:x@y">m</a><a href="http://other.org/b">b</a><a href="#top">t</a><a href="/rss.xml">feed</a>'
    assert html.article_links(page, "http://h.org/") == ["http://h.org/a", "http://h.org/rss.xml"]
    found = html.feed_links('<link rel="alternate" type="application/rss+xml" href="/f" title="F"><link rel="stylesheet" href="/c">' + page, "http://h.org/")
    assert [f["url"] for f in found] == ["http://h.org/f", "http://h.org/rss.xml"] and found[0]["source"] == "link-alternate"


def test_raw_to_parsed_and_dead_letters(spark, tmp_path):
    bodies = spark.createDataFrame([(1, RSS), (2, ATOM), (3, None)], "source_id bigint, body string")
    raw = connectors.raw_documents(connectors.items(bodies, "rss"), "rss")
    parsed = {r["source_id"]: r for r in connectors.parsed_articles(raw).collect()}
    assert parsed[1]["canonical_url"] == "http://a.org/c1" and parsed[1]["published_at"] == datetime(2026, 1, 5, 10) and parsed[1]["reason"] is None
    page = raw.limit(1).withColumn("raw_html", F.lit(None).cast("string"))
    assert connectors.parsed_articles(page).first()["reason"] == "no_content"
    with pytest.raises(ValueError, match="no connector"):
        connectors.items(bodies, "nothing")
    (tmp_path / "one.xml").write_text(RSS)
    connectors.register(spark)
    assert spark.read.format("feed_files").option("kind", "rss").load(f"{tmp_path}/*.xml").select("path", "title").collect()[0] == ("one.xml", "One")
    sink = streams.to_folders(f"{tmp_path}/good", f"{tmp_path}/dead")
    both = connectors.parsed_articles(raw).unionByName(connectors.parsed_articles(page))
    sink(both, 0)
    sink(both, 0)  # a batch that runs again
    assert spark.read.parquet(f"{tmp_path}/good").count() == 2 and spark.read.parquet(f"{tmp_path}/dead").count() == 1


def test_article_upsert(spark):
    cols = "canonical_url string, title string, body string, language string, published_at timestamp, content_hash string, fetched_at timestamp"
    t = datetime(2026, 1, 1)
    old = spark.createDataFrame([("a", "A", "x", "en", t, "h1", t), ("b", "B", "x", "en", t, "h2", t)], cols)
    new = spark.createDataFrame([("a", "A2", "y", None, None, "h9", t + timedelta(1)), ("b", "B!", "x", "de", t, "h2", t), ("c", "C", "z", None, None, "h3", t)], cols)
    articles, versions, changes = store.upsert_articles(old, new)
    got = {r["canonical_url"]: r for r in articles.collect()}
    assert (got["a"]["title"], got["a"]["language"], got["a"]["published_at"]) == ("A2", "en", t) and got["b"]["title"] == "B" and len(got) == 3
    assert [(r["canonical_url"], r["content_hash"]) for r in versions.collect()] == [("a", "h1")]
    assert dict(map(tuple, changes.collect())) == {"a": "revise", "b": "same", "c": "insert"}
    again = store.upsert_articles(articles, new)[2]
    assert dict(map(tuple, again.collect())) == {"a": "same", "b": "same", "c": "same"}


def test_source_and_security_upserts(spark):
    s = "feed_url string, homepage_url string, name string, enabled boolean, health string"
    out = store.upsert_sources(spark.createDataFrame([("f", "h", "old", False, "{}")], s), spark.createDataFrame([("f", "h", "new", True, None), (None, "h2", "n2", True, None)], s))
    got = {r["homepage_url"]: r for r in out.collect()}
    assert (got["h"]["name"], got["h"]["enabled"], got["h"]["health"]) == ("new", False, "{}") and len(got) == 2
    c = "symbol string, name string, aliases array<string>"
    u = store.upsert_securities(spark.createDataFrame([("A", "Old", ["x", "Y"])], c), spark.createDataFrame([("A", "New", ["y", "z"])], c)).first()
    assert (u["name"], u["aliases"]) == ("New", ["x", "Y", "z"])
    b = spark.createDataFrame([("f1", "h1", "n1")], "feed_url string, homepage_url string, name string")
    e = spark.createDataFrame([(1, "F1", "q", "q"), (2, "f2", "h2", "n2"), (3, "f2", "h3", "n3"), (4, None, "h4", "n4")], "pos int, feed_url string, homepage_url string, name string")
    assert sorted(r["name"] for r in store.merge_catalog(b, e).collect()) == ["n1", "n2", "n4"]


def test_analysis_isolates_failures(spark):
    class Broken(analyze.OfflineProvider):
        def sentiment(self, text, words):
            raise RuntimeError("down")

        def topics(self, text, words):
            return {"topics": [{"slug": "x", "label": "x", "confidence": 7}]}

    a = spark.createDataFrame([(1, "T", "good words here and More Names here")], "id bigint, title string, body string")
    out = {r["kind"]: r for r in analyze.analyze(analyze.requests(a), Broken()).collect()}
    assert "down" in out["sentiment"]["error"] and "confidence" in out["topics"]["error"] and out["keywords"]["error"] is None and out["keywords"]["tokens"] > 0


def test_near_duplicates_lose_none(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    base = rng.integers(-(2**62), 2**62, 20)
    hashes = [int(b) ^ sum(1 << int(k) for k in rng.choice(62, n, replace=False)) for b in base for n in (0, 1, 2, 3, 4)]
    df = spark.createDataFrame(list(enumerate(hashes)), "id bigint, simhash bigint")
    got = {(r["a"], r["b"]) for r in neighbours.near_duplicates(df).collect()}
    want = {(i, j) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if ((hashes[i] ^ hashes[j]) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want


def test_search_syntax(spark):
    assert search.parse_query('a "b c" or -d e') == [[(True, ("a",)), (True, ("b", "c"))], [(False, ("d",)), (True, ("e",))]]
    rows = [(1, "alpha beta", "gamma"), (2, "beta alpha", "delta"), (3, "", "alpha")]
    a = spark.createDataFrame([(i, t, b, None) for i, t, b in rows], "id bigint, title string, body string, published_at timestamp")
    ids = lambda q: sorted(r["id"] for r in search.full_text(a, q).collect())
    assert ids('"alpha beta"') == [1] and ids("alpha -delta") == [1, 3] and ids("gamma or delta") == [1, 2] and ids("") == []


def test_backtest(spark):
    day = datetime(2026, 5, 1)
    sig = [("S", day + timedelta(days=k), -1 + 2 * k / 9) for k in range(10)]
    price = [("S", t + timedelta(hours=h), 100.0 * (1 + 0.05 * s * (h > 0))) for _, t, s in sig for h in (0, 23)]
    s = spark.createDataFrame(sig, "symbol string, as_of timestamp, score double")
    p = spark.createDataFrame(price, "symbol string, ts timestamp, price double")
    r = {x["horizon"]: x for x in signals.backtest(signals.forward_returns(s, p, [23, 48]), [23, 48]).collect()}
    assert r[23]["n"] == 10 and r[23]["ic"] == pytest.approx(1) and r[23]["hit_rate"] == 1
    curve = {x["horizon"]: x["car"] for x in signals.car_curve(signals.step_returns(s, p, [23]), [23]).collect()}
    assert curve[23] == pytest.approx(0, abs=1e-9)
    empty = signals.backtest(signals.forward_returns(s, p.limit(0), [23]), [23]).first()
    assert (empty["n"], empty["ic"], empty["hit_rate"]) == (0, 0.0, 0.0)


def test_pages_and_interleaving(spark):
    df = spark.createDataFrame([(k, f"d{k % 3 if k < 6 else 0}") for k in range(8)], "pos bigint, domain string")
    assert [r["pos"] for r in relational.interleave(df).orderBy("place").collect()] == [0, 1, 2, 3, 4, 5, 6, 7]
    assert [r["id"] for r in relational.page(spark.range(500), [F.desc("id")], 9999, 10).limit(2).collect()] == [489, 488]
    assert relational.page(spark.range(500), [F.asc("id")], 9999).count() == 200


def test_streams_equal_batch(spark, tmp_path):
    t = datetime(2026, 1, 1)
    rows = [("topic", k % 2, k // 2, k % 5, t + timedelta(minutes=13 * k)) for k in range(60)]
    schema = "target_type string, target_id bigint, article_id bigint, source_id bigint, published_at timestamp"
    spark.createDataFrame(rows + rows[:10], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")

    def keep(df, batch):
        df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch}")

    streams.run(streams.mention_stream(stream), f"{tmp_path}/check", keep, "update").awaitTermination()
    from tidewire.operators import series

    got = sorted((r["target_id"], r["bucket"], r["count"]) for r in spark.read.parquet(f"{tmp_path}/out").groupBy("target_id", "bucket").agg(F.max("count").alias("count")).collect())
    want = sorted((r["target_id"], r["bucket"], r["count"]) for r in series.mention_buckets(spark.createDataFrame(rows, schema)).collect())
    assert got == want


def test_token_buckets():
    ok, tokens, last = streams.take([0, 100_000, 200_000, 2_200_000, 10_000_000], 0.5, 2.0)
    assert ok == [True, True, False, True, True] and last == 10_000_000
    assert streams.take([3_000_000], 0.5, 2.0, tokens, last)[0] == [True] and streams.time_to_live(0.5, 2) == 5


def test_page_titles_equal_their_sql(spark, tmp_path):
    import duckdb

    from tidewire import plans

    pages = ["<title> a \u00a0</title>", "<title>say &quot;x</title>", "<title>\nb</title>", ARTICLE, "", None, "<h1>no title</h1>", "<title></title>", '<title>"c"</title><svg><title>d</title></svg>']
    spark.createDataFrame([(i, "http://a.org/", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.sql(plans.ORACLES["page_titles"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    got = plans.QUERIES["page_titles"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 7
    assert html.extract_article(pages[1], "")["title"] == 'say "x'
