"""Streaming stages: mention buckets, deduplication, dead letters, fan-out, token buckets, and their sinks.

Every stage takes and returns frames, so batch and stream share it; run() gives a query its checkpoint.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewire.operators import analyze, series
from tidewire.sources import connectors

LATENESS = "7 days"


def mention_stream(mentions: DataFrame, minutes: int = 60, lateness: str = LATENESS) -> DataFrame:
    """Hourly counts of distinct articles: a pair of target and article counts once within the watermark.

    Distinct counts aren't to be had in a stream, so pairs are deduplicated first. Sources are counted approximately.
    """
    once = mentions.withWatermark("published_at", lateness).dropDuplicatesWithinWatermark([*series.KEYS, "article_id"])
    out = once.groupBy(*series.KEYS, F.window("published_at", f"{minutes} minutes")).agg(F.count("*").alias("count"), F.approx_count_distinct("source_id").alias("source_count"))
    return out.select(*series.KEYS, F.col("window.start").alias("bucket"), "count", "source_count")


def sliding_counts(mentions: DataFrame, window: str = "3 hours", slide: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    return mentions.withWatermark("published_at", lateness).groupBy(*series.KEYS, F.window("published_at", window, slide)).agg(F.count("*").alias("count")).select(*series.KEYS, F.col("window.start").alias("bucket"), "count")


def sessions(mentions: DataFrame, gap: str = "2 hours", lateness: str = LATENESS) -> DataFrame:
    """Runs of mentions of a target with no gap longer than `gap`."""
    return mentions.withWatermark("published_at", lateness).groupBy(*series.KEYS, F.session_window("published_at", gap)).agg(F.count("*").alias("count")).select(*series.KEYS, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last"), "count")


def seen_once(articles: DataFrame, lateness: str = LATENESS, time: str = "fetched_at") -> DataFrame:
    """Articles whose address and content weren't seen within the watermark."""
    return articles.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["canonical_url", "content_hash"])


def parse_stage(raw: DataFrame) -> DataFrame:
    """Raw documents -> parsed articles with the reason why one is a dead letter."""
    return connectors.parsed_articles(raw)


def fan_out(articles: DataFrame, kinds: tuple[str, ...] = analyze.KINDS) -> DataFrame:
    """Analysis requests, one an article and kind."""
    return analyze.requests(articles, kinds)


def split_dead(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(reason).isNull()).drop(reason), df.filter(F.col(reason).isNotNull())


def to_folders(good: str, dead: str, reason: str = "reason") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: rows without a reason to one folder, dead letters to another. Each batch writes folders of
    its own number, so a batch that is run again overwrites what it wrote and nothing is doubled."""

    def write(df: DataFrame, batch: int) -> None:
        df = df.persist()
        live, failed = split_dead(df, reason)
        live.write.mode("overwrite").parquet(f"{good}/batch={batch}")
        failed.write.mode("overwrite").parquet(f"{dead}/batch={batch}")
        df.unpersist()

    return write


def run(df: DataFrame, checkpoint: str, sink, mode: str = "append", once: bool = True, every: str = "60 minutes"):
    """Start a query. sink: a foreachBatch function, or (format, options). once: all that is there, then end."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.foreachBatch(sink).start() if callable(sink) else writer.format(sink[0]).options(**sink[1]).start()


# --- token buckets ------------------------------------------------------------------------------------------------


def refill(tokens: float, seconds: float, rate: float, capacity: float) -> float:
    return min(capacity, tokens + max(0.0, seconds) * rate)


def micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def take(times: list[int], rate: float, capacity: float, tokens: float | None = None, last: int | None = None) -> tuple[list[bool], float, int]:
    """(allowed for each request in order of time, tokens left, last time); times in microseconds."""
    tokens = capacity if tokens is None else tokens
    out = []
    for t in times:
        tokens = refill(tokens, (t - last) / 1e6 if last is not None else 0.0, rate, capacity)
        last = t if last is None else max(last, t)
        ok = tokens >= 1
        tokens -= ok
        out.append(ok)
    return out, tokens, last if last is not None else 0


def time_to_live(rate: float, capacity: float) -> int:
    return math.ceil(capacity / rate) + 1


class TokenBucket(StatefulProcessor):
    """Requests (domain, at, url) of each domain are allowed at a rate, with bursts up to a capacity; idle state expires."""

    rate, capacity = 0.5, 2.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens double, last bigint", ttlDurationMs=1000 * time_to_live(self.rate, self.capacity))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows)).sort_values("at")
        tokens, last = self.state.get() if self.state.exists() else (None, None)
        times = micros(f["at"])
        ok, tokens, last = take(times, self.rate, self.capacity, tokens, last)
        self.state.update((tokens, last))
        yield pd.DataFrame({"domain": key[0], "url": f["url"].to_numpy(), "allowed": ok})

    def close(self) -> None:
        pass


def limit_rate(requests: DataFrame) -> DataFrame:
    """(domain, url, allowed) of a stream of requests (domain, at, url). State expires by the clock, so a query over it goes
    on without new rows: start it with run(once=False)."""
    return requests.groupBy("domain").transformWithStateInPandas(TokenBucket(), outputStructType="domain string, url string, allowed boolean", outputMode="append", timeMode="ProcessingTime")


def limit_rate_batch(requests: DataFrame, rate: float = 0.5, capacity: float = 2.0) -> DataFrame:
    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["at", "url"])
        return pd.DataFrame({"domain": f["domain"], "url": f["url"], "allowed": take(micros(f["at"]), rate, capacity)[0]})

    return requests.select("domain", "at", "url").groupBy("domain").applyInPandas(one, "domain string, url string, allowed boolean")


def schedule(sources: DataFrame, start, stagger_seconds: float = 2.0) -> DataFrame:
    """(source_id, first_run, interval_seconds): sources (id, seconds) start one after another."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("id")) - 1  # the registry of sources is small
    return sources.select(F.col("id").alias("source_id"), F.timestamp_micros(F.unix_micros(start) + (place * stagger_seconds * 1e6).cast("bigint")).alias("first_run"), F.col("seconds").alias("interval_seconds"))
