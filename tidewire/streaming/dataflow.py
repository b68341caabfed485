"""The stages as one dataflow over topics in a folder: raw documents -> parsed articles -> stored articles and requests ->
results -> tables -> alerts. Each stage is a query of its own with its own checkpoint; what a batch writes is overwritten
when that batch is run again, so at-least-once delivery doubles nothing.

    base/raw.documents          messages of the collectors                (write_topic)
    base/parsed.articles        parse stage; what has no content: base/dead.letters
    base/tables/articles        stored articles, a version of the whole table a batch
    base/analyze.requests       one an article and kind, of new and revised articles
    base/analyze.results        analyze stage
    base/tables/<kind>          projections of the results
    base/issues.alerts          detector, in batches
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidewire import schemas
from tidewire.operators import analyze, emerging, store
from tidewire.streaming import streams

RAW = "source_id bigint, url string, canonical_url string, raw_html string, title string, published_at timestamp, authors array<string>, fetched_at timestamp"
PARSED = "source_id bigint, canonical_url string, url string, title string, body string, authors array<string>, published_at timestamp, fetched_at timestamp, language string, content_hash string, simhash bigint, word_count int"
REQUEST = "target_type string, target_id bigint, kind string, text string"


@dataclass
class Dataflow:
    """The stages over one base folder, which all executors see."""

    spark: SparkSession
    base: str
    provider: analyze.Provider
    kinds: tuple[str, ...] = analyze.KINDS
    lateness: str = streams.LATENESS

    def topic(self, name: str) -> str:
        return f"{self.base}/{name}"

    def stream(self, name: str, schema: str, kind: str = "parquet") -> DataFrame:
        reader = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 200)
        return reader.json(self.topic(name)) if kind == "json" else reader.parquet(f"{self.topic(name)}/batch=*")

    def start(self, name: str, df: DataFrame, sink: Callable[[DataFrame, int], None], once: bool) -> StreamingQuery:
        return streams.run(df, f"{self.base}/checkpoints/{name}", sink, once=once)

    # --- stages -------------------------------------------------------------------------------------------------------

    def parse(self, once: bool = True) -> StreamingQuery:
        """raw -> parsed; a document without content is a dead letter."""
        parsed = streams.parse_stage(self.stream("raw.documents", RAW, "json"))
        return self.start("parse", parsed, streams.to_folders(self.topic("parsed.articles"), self.topic("dead.letters")), once)

    def persist(self, once: bool = True) -> StreamingQuery:
        """parsed -> stored, with versions of what was revised, and requests for what is new or revised."""
        seen = streams.seen_once(self.stream("parsed.articles", PARSED), self.lateness)

        def sink(df: DataFrame, batch: int) -> None:
            df = df.withColumn("id", store.text_id(F.col("canonical_url"))).withColumn("status", F.lit("parsed"))
            stored = self.articles(before=batch)
            stored = self.spark.createDataFrame([], df.schema) if stored is None else stored
            now, versions, changes = store.upsert_articles(stored, df)
            now.write.mode("overwrite").parquet(f"{self.topic('tables/articles')}/batch={batch}")
            versions.write.mode("overwrite").parquet(f"{self.topic('tables/article_versions')}/batch={batch}")
            fresh = self.spark.read.parquet(f"{self.topic('tables/articles')}/batch={batch}").join(changes.filter("change in ('insert', 'revise')"), "canonical_url", "left_semi")
            streams.fan_out(fresh, self.kinds).write.mode("overwrite").parquet(f"{self.topic('analyze.requests')}/batch={batch}")

        return self.start("persist", seen, sink, once)

    def analyze(self, once: bool = True) -> StreamingQuery:
        """requests -> results; a kind that fails carries its error and stops no other."""
        results = analyze.analyze(self.stream("analyze.requests", REQUEST), self.provider)
        return self.start("analyze", results, lambda df, batch: df.write.mode("overwrite").parquet(f"{self.topic('analyze.results')}/batch={batch}"), once)

    def project(self, once: bool = True) -> StreamingQuery:
        """results -> tables of each kind."""

        def sink(df: DataFrame, batch: int) -> None:
            df = df.persist()
            put = lambda rows, name: rows.write.mode("overwrite").parquet(f"{self.topic('tables/' + name)}/batch={batch}")
            for kind, make in (("entities", store.project_entities), ("keywords", store.project_keywords), ("topics", store.project_topics)):
                dim, links = make(df)
                put(dim, kind)
                put(links, f"article_{kind}")
            good, bad = store.project_vectors(df, analyze.DIM)
            put(good, "embeddings")
            put(df.filter("error is not null").select("target_id", "kind", F.col("error").alias("reason")).unionByName(bad.select(F.col("article_id").alias("target_id"), F.lit("embedding").alias("kind"), "reason")), "failed")
            df.unpersist()

        return self.start("project", self.stream("analyze.results", analyze.RESULTS), sink, once)

    def detect(self, mentions: DataFrame, labels: DataFrame, threshold: float = 0.6, minutes: int = 60) -> DataFrame:
        """One cycle of the detector over all mentions there are: alerts, appended to their topic."""
        found = emerging.alerts(mentions, labels, threshold, minutes)
        found.write.mode("append").parquet(self.topic("issues.alerts"))
        return found

    def run_once(self) -> None:
        """Every stage over all that its topic holds, one after another: a batch by streams."""
        for stage in (self.parse, self.persist, self.analyze, self.project):
            stage(once=True).awaitTermination()

    def start_all(self) -> list[StreamingQuery]:
        return [stage(once=False) for stage in (self.parse, self.persist, self.analyze, self.project)]

    # --- tables -------------------------------------------------------------------------------------------------------

    def batches(self, name: str) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.topic('tables/' + name)}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        return sorted(int(f.getPath().getName().split("=")[1]) for f in files.listStatus(path) if "=" in f.getPath().getName())

    def articles(self, before: int | None = None) -> DataFrame | None:
        """The stored articles after the last batch, or the last one before a number."""
        known = [b for b in self.batches("articles") if before is None or b < before]
        return self.spark.read.parquet(f"{self.topic('tables/articles')}/batch={known[-1]}") if known else None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.topic(f"tables/{name}"))


def every(interval_minutes: int) -> str:
    """The trigger of periodic detection: the window, and a minute at least."""
    return f"{max(1, interval_minutes)} minutes"


def periodic(spark: SparkSession, work: Callable[[int], None], checkpoint: str, interval: str) -> StreamingQuery:
    """work(batch number) again and again: the detector, or statistics every 5 seconds. One query, so runs never overlap."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(lambda _, batch: work(batch)).start()


def alert_reader(spark: SparkSession, folder: str, client: str, checkpoints: str, deliver: Callable[[DataFrame], None], schema: str = schemas.ISSUE_ALERT, interval: str = "1 second") -> StreamingQuery:
    """The alerts that come after a client was first seen, in its own group (checkpoint): the first batch of a new client
    holds those that were there, and is passed over. deliver() also gets empty batches, as heartbeats do."""

    def sink(df: DataFrame, batch: int) -> None:
        if batch:
            deliver(df)

    alerts = spark.readStream.schema(schema).parquet(folder)
    return alerts.writeStream.option("checkpointLocation", f"{checkpoints}/{client}").trigger(processingTime=interval).foreachBatch(sink).start()


# --- metrics ----------------------------------------------------------------------------------------------------------

#: Upper bounds of the buckets of seconds.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def request_metrics(requests: DataFrame, seconds: Column, *keys: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """(keys, requests, seconds_sum, bound, at_most): counters and the cumulative histogram, one row a bound; the last
    bound is infinity. One aggregation on the map side."""
    cuts = [*bounds, float("inf")]
    each = [F.count_if(seconds <= b).alias(f"b{i}") for i, b in enumerate(cuts)]
    by = requests.groupBy(*keys).agg(F.count("*").alias("requests"), F.sum(seconds).alias("seconds_sum"), *each)
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("bound"), F.col(f"b{i}").alias("at_most")) for i, b in enumerate(cuts)])).alias("x")
    return by.select(*keys, "requests", "seconds_sum", rows).select(*keys, "requests", "seconds_sum", "x.*")


def exposition(name: str, rows: list[dict], keys: list[str]) -> str:
    """The lines of request_metrics() in the text format that scrapers read."""
    lines = [f"# TYPE {name}_seconds histogram"]
    for r in rows:
        own = ",".join(f'{k}="{r[k]}"' for k in keys)
        bound = "+Inf" if r["bound"] == float("inf") else f"{r['bound']:g}"
        lines.append(f'{name}_seconds_bucket{{{own},le="{bound}"}} {r["at_most"]}')
        if bound == "+Inf":
            lines += [f"{name}_seconds_sum{{{own}}} {r['seconds_sum']:g}", f"{name}_seconds_count{{{own}}} {r['requests']}"]
    return "\n".join(lines) + "\n"


class QueryMetrics(StreamingQueryListener):
    """Counters and gauges of all streaming queries: batches and rows in so far, rows a second, failures."""

    def __init__(self) -> None:
        self.batches: dict[str, int] = {}
        self.rows: dict[str, int] = {}
        self.rate: dict[str, float] = {}
        self.failed: dict[str, str] = {}
        self.running: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.running.add(str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        key = p.name or str(p.id)
        self.batches[key] = self.batches.get(key, 0) + 1
        self.rows[key] = self.rows.get(key, 0) + p.numInputRows
        self.rate[key] = p.processedRowsPerSecond

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.running.discard(str(event.id))
        if event.exception:
            self.failed[str(event.id)] = event.exception
