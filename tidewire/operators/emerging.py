"""What is emerging: features of a series' end, their blend, ranking, alerts and issue lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators import series as S

#: Fixed values of the blend.
WEIGHTS = {"robust_z": 0.40, "acceleration": 0.25, "burst_level": 0.20, "source_diversity": 0.15}
Z_CENTER, Z_SCALE, ACCEL_SCALE, SOURCE_K = 3.0, 1.0, 2.0, 5.0


def components(z: Column, accel: Column, level: Column, top: Column, sources: Column) -> dict[str, Column]:
    """The four signals, each squashed into [0, 1]."""
    x = (z - Z_CENTER) / Z_SCALE
    logistic = F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(F.least(x, F.lit(0.0))) / (1 + F.exp(F.least(x, F.lit(0.0)))))
    some = F.greatest(sources, F.lit(0)).cast("double")
    return {
        "robust_z": logistic,
        "acceleration": F.greatest(F.lit(0.0), F.tanh(accel / ACCEL_SCALE)),
        "burst_level": F.when(top > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), level / top))).otherwise(0.0),
        "source_diversity": some / (some + SOURCE_K),
    }


def emergingness(parts: dict[str, Column]) -> Column:
    return sum((WEIGHTS[k] * v for k, v in parts.items()), F.lit(0.0))


def features(series: DataFrame, period: int = 168) -> DataFrame:
    """(keys, bucket, count, source_count, robust_z, acceleration, velocity, burst_level, max_burst_level) at each series' end."""
    scored = S.latest(S.robust_scores(series, period)).select(*S.KEYS, "bucket", "count", "source_count", "robust_z")

    def tail(f: pd.DataFrame) -> pd.DataFrame:
        x = f["count"].to_numpy(float)
        levels = S.bursts(x)[0]
        v, a = S.smooth_velocity(x), S.acceleration(x)
        return pd.DataFrame({"velocity": [float(v[-1])], "acceleration": [float(a[-1])], "burst_level": [int(levels[-1])], "max_burst_level": [int(np.max(levels))]})

    return scored.join(S.per_target(series, tail, "velocity double, acceleration double, burst_level int, max_burst_level int"), S.KEYS)


def rank(series: DataFrame, period: int = 168) -> DataFrame:
    """Targets by score, then robust z, then sources."""
    f = features(series, period)
    parts = components(F.col("robust_z"), F.col("acceleration"), F.col("burst_level"), F.col("max_burst_level"), F.col("source_count"))
    return f.select("*", F.round(emergingness(parts), 6).alias("score"), *[F.round(v, 6).alias(f"c_{k}") for k, v in parts.items()]).orderBy(F.desc("score"), F.desc("robust_z"), F.desc("source_count"), *S.KEYS)


def supporting(mentions: DataFrame, k: int = 20, bucket_minutes: int | None = None) -> DataFrame:
    """The k most recent articles of each target; Spark limits each group before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*S.KEYS).orderBy(F.desc("published_at"), F.desc("article_id"))
    return mentions.filter(F.col("published_at").isNotNull()).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def alerts(mentions: DataFrame, labels: DataFrame, threshold: float = 0.6, minutes: int = 60, period: int = 168) -> DataFrame:
    """Targets at or over the threshold, with label, window and supporting articles."""
    ranked = rank(S.mention_buckets(mentions, minutes), period).filter(F.col("score") >= threshold)
    articles = supporting(mentions).groupBy(*S.KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "article_id"))), lambda x: x["article_id"]).alias("supporting_article_ids"))
    named = ranked.join(F.broadcast(labels), S.KEYS, "left")
    label = F.coalesce("label", F.concat_ws(":", *S.KEYS))
    end = F.col("bucket") + F.expr(f"INTERVAL {minutes} MINUTES")
    return named.join(articles, S.KEYS, "left").select(*S.KEYS, label.alias("label"), F.col("bucket").alias("window_start"), end.alias("window_end"), "score", F.bround("velocity", 4).alias("velocity"), "supporting_article_ids").orderBy(F.desc("score"), *S.KEYS)


def issues_by_z(scored: DataFrame, threshold: float = 3.0, limit: int = 50) -> DataFrame:
    """Targets whose last bucket is at or over the z threshold."""
    return S.latest(scored).filter(F.col("zscore") >= threshold).orderBy(F.desc("zscore"), *S.KEYS).limit(limit)


def issue_history(scored: DataFrame, target: str, threshold: float = 3.0, limit: int = 50) -> DataFrame:
    """All spikes of one "type:id" target, newest first."""
    kind, number = parse_target(target)
    return scored.filter((F.col("target_type") == kind) & (F.col("target_id") == number) & (F.col("zscore") >= threshold)).orderBy(F.desc("bucket")).limit(limit)


def parse_target(target: str) -> tuple[str, int]:
    kind, colon, number = target.partition(":")
    if not kind or not colon or not number.strip().lstrip("-").isdigit():
        raise ValueError(f"a target is type:id, not {target!r}")
    return kind, int(number)


def top_trends(scored: DataFrame, metric: str = "zscore", target_type: str | None = None, limit: int = 20) -> DataFrame:
    if metric not in ("zscore", "velocity"):
        raise ValueError(metric)
    rows = S.latest(scored)
    if target_type is not None:
        rows = rows.filter(F.col("target_type") == target_type)
    return rows.orderBy(F.desc(metric), *S.KEYS).limit(limit)
