"""Connectors as Spark data sources and table functions, and the columns of raw documents and parsed articles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewire import schemas
from tidewire.functions import text as X
from tidewire.functions.language import detect_language
from tidewire.sources import feeds, html, robots

ITEMS = "url string, canonical_url string, title string, summary string, content string, published string, authors array<string>, headers map<string,string>"
PARSERS: dict[str, Callable[[str | None], list[dict]]] = {"rss": feeds.parse_feed, "gdelt": feeds.parse_gdelt, "newsapi": feeds.parse_newsapi}


def register_parser(kind: str, parse: Callable[[str | None], list[dict]]) -> None:
    """A new kind of source; parse: body -> items."""
    PARSERS[kind] = parse


def items(bodies: DataFrame, kind: str) -> DataFrame:
    """ITEMS of rows (source_id, body); a body that doesn't parse gives none. Unknown kinds are an error."""
    if kind not in PARSERS:
        raise ValueError(f"no connector for {kind!r}")
    parse = PARSERS[kind]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(s, *(i[k] for k in feeds.ITEM_FIELDS)) for s, b in zip(f["source_id"], f["body"], strict=True) for i in parse(b)]
            yield pd.DataFrame(rows, columns=["source_id", *feeds.ITEM_FIELDS])

    return bodies.select("source_id", "body").mapInPandas(run, f"source_id bigint, {ITEMS}")


class FeedFiles(DataSource):
    """spark.read.format("feed_files").option("kind", "rss").load(folder): items of a local folder's files, one partition
    a file. On a cluster, where files lie in a store that Spark alone reads, use read_feeds()."""

    @classmethod
    def name(cls) -> str:
        return "feed_files"

    def schema(self) -> str:
        return f"path string, {ITEMS}"

    def reader(self, schema) -> DataSourceReader:
        return FeedFilesReader(self.options)


class FeedFilesReader(DataSourceReader):
    def __init__(self, options):
        self.kind, self.path = options.get("kind", "rss"), options["path"]

    def partitions(self):
        return [InputPartition(str(p)) for p in sorted(Path("/").glob(self.path.lstrip("/")))]

    def read(self, partition):
        for i in PARSERS[self.kind](Path(partition.value).read_text("utf-8", "replace")):
            yield (Path(partition.value).name, *(i[k] for k in feeds.ITEM_FIELDS))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedFiles)


def read_feeds(spark: SparkSession, path: str, kind: str = "rss") -> DataFrame:
    """Items of feed files anywhere that Spark reads; source_id is a number of the file's path."""
    files = spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("source_id"), F.col("value").alias("body"))
    return items(files, kind)


def listing(listed: DataFrame, store: DataFrame, most: int = 40, selector: str | None = None) -> DataFrame:
    """Items of listing pages (source_id, url, html): the first `most` links of the same host, joined with the fetched
    pages (url, html); a link that wasn't fetched gives none. As items with the page as content."""
    each = listed.select("source_id", F.posexplode(F.slice(links("html", "url", F.lit(selector or "")), 1, most)).alias("pos", "url"))
    return each.join(store.select("url", F.col("html").alias("content")), "url").select("source_id", "pos", "url", "content")


def single(pages: DataFrame) -> DataFrame:
    """Items of pages (source_id, url, html) that are articles themselves."""
    return pages.select("source_id", F.lit(0).alias("pos"), "url", F.col("html").alias("content"))


def sitemap_pages(maps: DataFrame, bodies: DataFrame, most_children: int = 10) -> DataFrame:
    """(source_id, url) of the sitemaps (source_id, url, body): their own addresses, or those of the first children of an
    index that bodies (url, body) has; each address once a source."""
    read = maps.select("source_id", sitemap("body", "url").alias("m"))
    own = read.filter("m.kind = 'urlset'").select("source_id", F.explode("m.urls").alias("url"))
    children = read.filter("m.kind = 'index'").select("source_id", F.explode(F.slice("m.urls", 1, most_children)).alias("url"))
    inner = children.join(bodies, "url").select("source_id", sitemap("body", "url").alias("m")).filter("m.kind = 'urlset'")
    return own.unionByName(inner.select("source_id", F.explode("m.urls").alias("url"))).distinct()


def raw_documents(rows: DataFrame, method: str, fetched_at=None) -> DataFrame:
    """Raw documents of items (source_id, ITEMS): content, else summary, as the page; keyed by canonical address."""
    at = F.current_timestamp() if fetched_at is None else fetched_at
    return rows.filter("url is not null and trim(url) <> ''").select(
        F.coalesce("canonical_url", "url").alias("key"), F.lit(1).alias("schema_version"), "source_id", "url", "canonical_url", F.lit(method).alias("fetch_method"),
        F.coalesce("content", "summary").alias("raw_html"), "title", X.coerce_time(F.col("published")).alias("published_at"), "authors", "headers", at.alias("fetched_at"),
    )


def lazy_udf(ddl: str):
    """A pandas UDF whose DDL is parsed at the first call: there is no session yet when a module is imported."""

    def wrap(f):
        made: list = []

        def call(*columns):
            if not made:
                made.append(F.pandas_udf(f, ddl))
            return made[0](*columns)

        call.__doc__ = f.__doc__
        return call

    return wrap


PAGE = "title string, body string, authors array<string>, published string, canonical_url string"


@lazy_udf(PAGE)
def extract(page: pd.Series, url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([html.extract_article(h, u) for h, u in zip(page, url, strict=True)], columns=["title", "body", "authors", "published", "canonical_url"])


@lazy_udf("array<string>")
def links(page: pd.Series, url: pd.Series, selector: pd.Series) -> pd.Series:
    return pd.Series([html.article_links(h, u or "", selector=s or None) for h, u, s in zip(page, url, selector, strict=True)])


@lazy_udf("boolean")
def robots_allow(rules: pd.Series, agent: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([robots.allowed(r, a or "*", u or "") for r, a, u in zip(rules, agent, url, strict=True)])


@lazy_udf("array<struct<url string, title string, type string, source string>>")
def feed_candidates(page: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([html.feed_links(h, u or "") for h, u in zip(page, url, strict=True)])


@lazy_udf("struct<kind string, urls array<string>>")
def sitemap(body: pd.Series, base: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([feeds.parse_sitemap(b, u or "") for b, u in zip(body, base, strict=True)], columns=["kind", "urls"])


@lazy_udf("array<struct<title string, feed_url string>>")
def opml(body: pd.Series) -> pd.Series:
    return pd.Series([feeds.parse_opml(b) for b in body])


def parsed_articles(raw: DataFrame) -> DataFrame:
    """Parsed articles of raw documents; `reason` says why a row has no article (it belongs to the dead letters)."""
    page = raw.withColumn("x", F.when(F.col("raw_html").isNotNull(), extract("raw_html", "url")))
    pick = lambda a, b: F.coalesce(F.nullif(F.trim(a), F.lit("")), b)
    body = F.coalesce("x.body", F.lit(""))
    out = page.select(
        "source_id", pick(F.col("canonical_url"), pick(F.col("x.canonical_url"), F.col("url"))).alias("canonical_url"), "url", pick(F.col("title"), F.col("x.title")).alias("title"), body.alias("body"),
        F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.coalesce("x.authors", F.array().cast("array<string>"))).alias("authors"),
        F.coalesce("published_at", X.coerce_time(F.col("x.published"))).alias("published_at"), "fetched_at",
    )
    out = out.withColumn("language", detect_language("body")).withColumn("content_hash", X.content_hash(X.normalize("body"))).withColumn("simhash", X.simhash64("body")).withColumn("word_count", X.word_count(F.col("body")))
    return out.withColumn("reason", F.when(F.trim("body") == "", "no_content"))


def create_topics(spark: SparkSession, base: str, names=schemas.TOPIC_NAMES) -> None:
    """A folder for each topic; those that exist stay as they are."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def list_topics(spark: SparkSession, base: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().getName() for f in found if f.isDirectory())


def write_topic(df: DataFrame, path: str, key: str = "key", partitions: int = schemas.TOPIC_PARTITIONS) -> None:
    """Append messages as JSON lines, those of one key in one file: what a message broker's topic would hold."""
    df.repartition(partitions, key).write.mode("append").json(path)


def read_topic(spark: SparkSession, path: str, schema) -> DataFrame:
    """The stream of a topic's messages; files are the offsets."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 200).json(path)


def message(df: DataFrame, key: str) -> DataFrame:
    """(key, value) as a message broker's sink takes them."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))
