"""Signals of securities from their articles, and the backtest of signals against prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import scores
from tidewire.operators.relational import rank_average


def best_links(entity_links: DataFrame, entity_securities: DataFrame) -> DataFrame:
    """(security_id, article_id, entity_id, magnitude): of an article's entities of one security the strongest."""
    both = entity_links.join(entity_securities, "entity_id").withColumn("magnitude", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("salience") * F.col("confidence"))))
    best = both.groupBy("security_id", "article_id").agg(F.max(F.struct("magnitude", (-F.col("entity_id")).alias("back"))).alias("x"))
    return best.select("security_id", "article_id", (-F.col("x.back")).alias("entity_id"), F.col("x.magnitude").alias("magnitude"))


def latest_analysis(analysis: DataFrame, kind: str, field: str, number: str = "id") -> DataFrame:
    """(target_id, value) of the last analysis of a kind, from its JSON, within [-1, 1]."""
    last = analysis.filter(F.col("kind") == kind).groupBy("target_id").agg(F.max_by("result", number).alias("result"))
    value = F.get_json_object("result", f"$.{field}").try_cast("double")
    return last.select("target_id", scores.clip(value, -1.0).alias("value"))


def contributions(links: DataFrame, articles: DataFrame, as_of: Column, window_hours: int = 72, half_life: float = 24.0) -> DataFrame:
    """One row a security and article in the window: impact score and weight.

    articles: (article_id, published_at, event_id, sentiment, novelty, credibility); the time filter reaches its scan.
    """
    recent = articles.filter((F.col("published_at") <= as_of) & (F.col("published_at") >= as_of - F.expr(f"INTERVAL {window_hours} HOURS")))
    rows = links.join(recent, "article_id")
    part = scores.article_impact(F.coalesce("sentiment", F.lit(0.0)), F.col("magnitude"), F.coalesce("novelty", F.lit(1.0)), F.coalesce("credibility", F.lit(0.5)), scores.age_hours(F.col("published_at"), as_of), half_life)
    return rows.withColumn("score", part["score"]).withColumn("weight", part["confidence"])


def event_impact(members: DataFrame, *keys: str) -> DataFrame:
    """Weighted mean score, agreement and saturating confidence of each group's (score, weight)."""
    w, s = F.col("weight"), F.col("score")
    out = members.groupBy(*keys).agg(F.sum(w).alias("total_weight"), F.sum(w * s).alias("ws"), F.sum(w * F.abs(s)).alias("wa"), F.count("*").alias("n_articles"))
    out = out.filter(F.col("total_weight") > 0)
    score = scores.clip(F.col("ws") / F.col("total_weight"), -1.0)
    agreement = F.coalesce(F.abs(F.col("ws")) / F.nullif(F.col("wa"), F.lit(0.0)), F.lit(0.0))
    volume = 1 - F.exp(-F.col("total_weight") / 2)
    return out.select(*keys, "n_articles", "total_weight", score.alias("score"), agreement.alias("agreement"), volume.alias("vol_confidence"), (agreement * volume).alias("confidence"))


def generate_signals(members: DataFrame, as_of: Column, horizon_hours: int = 24) -> DataFrame:
    """A signal a security, with its sorted supporting articles and events and their contributions."""
    part = event_impact(members, "security_id")
    lists = members.groupBy("security_id").agg(
        F.array_sort(F.collect_set("article_id")).alias("supporting_article_ids"),
        F.array_sort(F.collect_set("event_id")).alias("supporting_event_ids"),
        F.array_sort(F.collect_list(F.struct("article_id", F.round("score", 6).alias("score"), F.round("weight", 6).alias("weight")))).alias("contributions"),
    )
    out = part.join(lists, "security_id")
    return out.select(
        "security_id", as_of.alias("as_of"), F.lit(horizon_hours).alias("horizon_hours"), "score", scores.direction(F.col("score")).alias("direction"), F.abs("score").alias("magnitude"), "confidence",
        F.struct("n_articles", "total_weight", "vol_confidence", "agreement", "contributions").alias("components"), "supporting_article_ids", "supporting_event_ids",
    )


# --- backtest -----------------------------------------------------------------------------------------------------


def returns_between(signals: DataFrame, prices: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
    """(symbol, as_of, score, horizon, ret) for each span (from, to) of hours after as_of; both prices must exist."""
    hour = F.lit(3_600_000_000)
    pick = F.explode(F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("horizon")) for a, b in spans]))
    s = signals.withColumn("_s", pick).select("*", "_s.low", "_s.horizon").drop("_s")
    s = s.withColumn("t0", F.timestamp_micros(F.unix_micros("as_of") + F.col("low") * hour)).withColumn("t1", F.timestamp_micros(F.unix_micros("as_of") + F.col("horizon") * hour))
    out = s.join(prices.select("symbol", F.col("ts").alias("t0"), F.col("price").alias("p0")), ["symbol", "t0"])
    out = out.join(prices.select("symbol", F.col("ts").alias("t1"), F.col("price").alias("p1")), ["symbol", "t1"]).filter(F.col("p0") > 0)
    return out.withColumn("ret", F.col("p1") / F.col("p0") - 1).select("symbol", "as_of", "score", "horizon", "t0", "t1", "ret")


def forward_returns(signals: DataFrame, prices: DataFrame, horizons: list[int]) -> DataFrame:
    return returns_between(signals, prices, [(0, h) for h in horizons]).drop("t0", "t1")


def step_returns(signals: DataFrame, prices: DataFrame, horizons: list[int], market: DataFrame | None = None) -> DataFrame:
    """Returns from each grid point to the next, less the market's (symbol, ts, price) where it has both prices."""
    out = returns_between(signals, prices, list(zip([0, *horizons], horizons, strict=False)))
    if market is not None:
        m = returns_between(signals, market, list(zip([0, *horizons], horizons, strict=False))).select("symbol", "as_of", "horizon", F.col("ret").alias("m")).distinct()
        out = out.join(m, ["symbol", "as_of", "horizon"], "left").withColumn("ret", F.col("ret") - F.coalesce("m", F.lit(0.0))).drop("m")
    return out.drop("t0", "t1")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, span_seconds: int = 86_400) -> DataFrame:
    """Each left row with the last right value at or before its time: one union and one window, no range join.

    A key's rows are dealt by key and `span_seconds` of time, so a hot key is many tasks. What a span hands on to the next
    is one row, and those rows alone are carried along a key.
    """
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    both = a.unionByName(b).withColumn("_span", F.floor(F.unix_micros(F.col("_t").cast("timestamp")) / (span_seconds * 1_000_000)))
    ends = both.groupBy(*keys, "_span").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_t"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_span").alias("_s"), F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    w = Window.partitionBy(*keys, "_span").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_now", F.last("_v", ignorenulls=True).over(w)).filter(F.col("_side") == 1)
    same = F.col("_span").eqNullSafe(F.col("_s"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(ends, same).select("_row.*", F.coalesce("_now", "_before").alias(value))


def backtest(returns: DataFrame, horizons: list[int]) -> DataFrame:
    """n, information coefficient (Spearman), hit rate and mean return by horizon; zeros where there are no rows."""
    r = rank_average(rank_average(returns, "score", "rx", ["horizon"]), "ret", "ry", ["horizon"])
    flat = (F.abs("score") <= 1e-9) | (F.abs("ret") <= 1e-12)
    sd = (F.stddev_pop("rx") < 1e-12) | (F.stddev_pop("ry") < 1e-12)
    by = r.groupBy("horizon").agg(
        F.count("*").alias("n"), F.when(sd, 0.0).otherwise(scores.clip(F.covar_pop("rx", "ry") / (F.stddev_pop("rx") * F.stddev_pop("ry")), -1.0)).alias("ic"),
        F.coalesce(F.avg(F.when(~flat, (F.signum("score") == F.signum("ret")).cast("int"))), F.lit(0.0)).alias("hit_rate"), F.avg("ret").alias("mean_return"),
    )
    every = returns.sparkSession.createDataFrame([(h,) for h in horizons], "horizon int")
    return every.join(by, "horizon", "left").fillna(0, ["n"]).fillna(0.0, ["ic", "hit_rate", "mean_return"])


def car_curve(steps: DataFrame, horizons: list[int]) -> DataFrame:
    """(horizon, aar, car): the mean abnormal return of each step and its running sum over the grid."""
    mean = steps.groupBy("horizon").agg(F.avg("ret").alias("aar"))
    every = steps.sparkSession.createDataFrame([(h,) for h in horizons], "horizon int").join(mean, "horizon", "left").fillna(0.0, ["aar"])
    return every.withColumn("car", F.sum("aar").over(Window.orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)))  # a row a horizon
