"""Full-text, vector and hybrid search, and reports over what they find.

Query syntax: words (all must occur), "phrases", `or` between alternatives, `-` before a word or phrase that must not
occur. Rank: BM25 (k1 = 1.2, b = 0.75) over the positive words, with counts from the searched articles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import scores, vectors
from tidewire.tables import written

K1, B, RRF_K = 1.2, 0.75, 60


def parse_query(text: str) -> list[list[tuple[bool, tuple[str, ...]]]]:
    """Alternatives of conjunctions of (positive, words of a phrase)."""
    out: list[list[tuple[bool, tuple[str, ...]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word.lower() == "or" and not minus:
            if out[-1]:
                out.append([])
            continue
        found = tuple(re.findall(r"\w+", (phrase or word).lower()))
        if found:
            out[-1].append((not minus, found))
    return [c for c in out if c]


def holds(tokens: str, phrase: tuple[str, ...]) -> Column:
    """Whether an array column holds the words one after another."""
    if len(phrase) == 1:
        return F.array_contains(tokens, phrase[0])
    at = F.exists(F.sequence(F.lit(0), F.size(tokens) - len(phrase)), lambda i: F.slice(F.col(tokens), i + 1, len(phrase)) == F.array(*map(F.lit, phrase)))
    return F.when(F.size(tokens) >= len(phrase), F.forall(F.array(*map(F.lit, phrase)), lambda w: F.array_contains(F.col(tokens), w)) & at).otherwise(False)


def matches(tokens: str, query: str) -> Column:
    parsed = parse_query(query)
    if not parsed:
        return F.lit(False)
    either = F.lit(False)
    for conjunction in parsed:
        every = F.lit(True)
        for positive, phrase in conjunction:
            hit = holds(tokens, phrase)
            every = every & (hit if positive else ~hit)
        either = either | every
    return either


def occurrences(tokens: str, word: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == word))


def full_text(articles: DataFrame, query: str) -> DataFrame:
    """Matching articles with their rank; articles (id, title, body, published_at, ...), each id once."""
    words = sorted({w for c in parse_query(query) for positive, p in c if positive for w in p})
    rows = articles.withColumn("tokens", scores.tokens(F.concat_ws(" ", "title", "body"))).withColumn("len", F.size("tokens"))
    tf = [occurrences("tokens", w).alias(f"tf{i}") for i, w in enumerate(words)]
    # One pass over the texts; only numbers are kept of them.
    rows = written(rows.select("id", "len", *tf, matches("tokens", query).alias("hit")), "matches")
    stats = rows.agg(F.count("*").alias("N"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    rank = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log(1 + (F.col("N") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        rank = rank + idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    found = rows.filter("hit").join(F.broadcast(stats)).select("id", rank.alias("rank"))  # one row of counts
    return articles.join(found, "id").select(*articles.columns, "rank")


def nearest(articles: DataFrame, vector: list[float], limit: int) -> DataFrame:
    """The limit articles nearest to a vector by cosine; rows without a vector are left out."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    scored = articles.filter("embedding is not null").withColumn("score", vectors.cosine(F.col("embedding"), q))
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def ranked(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """(id, rank from 1) of the first `limit` rows."""
    rows = df.orderBy(*order).limit(limit)
    return rows.withColumn("r", F.row_number().over(Window.orderBy(*order))).select("id", "r")  # at most `limit` rows


def reciprocal_rank(*lists: DataFrame) -> DataFrame:
    """(id, score): the sum of 1 / (60 + rank) over ranked lists (id, r)."""
    both = lists[0]
    for other in lists[1:]:
        both = both.unionByName(other)
    return both.groupBy("id").agg(F.sum(1 / (RRF_K + F.col("r"))).alias("score"))


def hybrid(articles: DataFrame, query: str, vector: list[float], limit: int = 20) -> DataFrame:
    """Words and vectors merged by reciprocal rank; ties by time. Each list is overscanned to min(3 * limit, 100)."""
    over = min(3 * limit, 100)
    words = ranked(full_text(articles, query), [F.desc("rank"), F.desc_nulls_last("published_at"), F.asc("id")], over)
    near = ranked(nearest(articles, vector, over), [F.desc("score"), F.asc("id")], over)
    merged = reciprocal_rank(words, near)
    out = articles.join(F.broadcast(merged), "id").withColumn("score", F.round("score", 6))
    return out.orderBy(F.desc("score"), F.desc_nulls_last("published_at"), F.desc("id")).limit(limit)


# --- reports ------------------------------------------------------------------------------------------------------


def report_title(keywords: list[str], hours: int | None = None) -> str:
    subject = ", ".join(keywords) if keywords else "All topics"
    return f"{subject}: last {hours} h" if hours else subject


def context_text(articles: DataFrame, title_chars: int = 300, body_chars: int = 1200) -> DataFrame:
    """(id, context): the cut title and body of each article, as a report's source."""
    return articles.select("id", F.concat_ws("\n", F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), F.substring("title", 1, title_chars)), F.substring("body", 1, body_chars)).alias("context"))


def gather(events: DataFrame, articles: DataFrame, max_events: int = 10, per_event: int = 5) -> DataFrame:
    """The most recent articles of the top events, at most max_events * per_event."""
    top = F.broadcast(events.orderBy(F.desc("score"), F.desc("event_id")).limit(max_events).select("event_id", "score"))
    return articles.join(top, "event_id").orderBy(F.desc_nulls_last("published_at"), F.desc("id")).limit(max(1, max_events * per_event))


def report(events: DataFrame, articles: DataFrame, title: str, max_events: int = 10, per_event: int = 5) -> DataFrame:
    """(title, body_md, citations): one report; its articles were limited before they are gathered."""
    rows = gather(events, articles, max_events, per_event)
    item = F.struct((-F.unix_micros(F.coalesce("published_at", F.lit("1970-01-01").cast("timestamp")))).alias("t"), (-F.col("id")).alias("o"), F.col("id"), F.substring("title", 1, 300).alias("title"))
    packed = rows.agg(F.array_sort(F.collect_list(item)).alias("x"))
    lines = F.transform("x", lambda s: F.concat(F.lit("- "), F.coalesce(s["title"], F.lit("")), F.lit(" ["), s["id"].cast("string"), F.lit("]")))
    return packed.select(F.lit(title).alias("title"), F.concat_ws("\n", F.lit(f"# {title}"), F.lit(""), F.array_join(lines, "\n")).alias("body_md"), F.transform("x", lambda s: s["id"]).alias("citations"))


def to_markdown(reports: DataFrame) -> DataFrame:
    """(id, markdown) of reports (id, title, body_md, citations array<string>)."""
    cited = F.when(F.size("citations") > 0, F.concat(F.lit("\n\n## Sources\n\n"), F.array_join(F.transform("citations", lambda c: F.concat(F.lit("- "), c)), "\n"))).otherwise("")
    return reports.select("id", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("body_md"), cited).alias("markdown"))
