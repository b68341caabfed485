"""Quality, credibility and impact scores as Columns; weights and curves are fixed values of the product."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def ramp(x: Column, low: float, high: float) -> Column:
    return clip((x - low) / (high - low))


def saturate(x: Column, mid: float) -> Column:
    v = F.greatest(x, F.lit(0.0))
    return v / (v + mid)


# --- recency and impact -------------------------------------------------------------------------------------------


def age_hours(at: Column, as_of: Column) -> Column:
    """Hours from at to as_of; null and future times are 0."""
    return F.coalesce(F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(at)) / 3.6e9), F.lit(0.0))


def decay(age: Column, half_life: float = 24.0) -> Column:
    return F.pow(F.lit(2.0), -F.greatest(age, F.lit(0.0)) / half_life) if half_life > 0 else F.lit(1.0)


def article_impact(sentiment: Column, magnitude: Column, novelty: Column, credibility: Column, age: Column, half_life: float = 24.0) -> dict[str, Column]:
    """score in [-1, 1] and confidence in [0, 1]; inputs are clamped."""
    gates = (0.25 + 0.75 * clip(novelty)) * (0.40 + 0.60 * clip(credibility))
    strength = clip(magnitude) * gates
    fade = decay(age, half_life)
    return {"score": clip(clip(sentiment, -1.0) * strength * fade, -1.0), "confidence": clip(strength * fade), "strength": strength, "decay": fade}


def direction(score: Column, dead: float = 1e-9) -> Column:
    return F.when(score > dead, "bullish").when(score < -dead, "bearish").otherwise("neutral")


# --- sources ------------------------------------------------------------------------------------------------------

#: Fixed values.
SOURCE_WEIGHTS = {"success_rate": 0.30, "corroboration": 0.25, "longevity": 0.20, "volume": 0.15, "error_penalty": 0.10}
VOLUME_HALF, LONGEVITY_DAYS = 200.0, 730.0


def source_parts(success: Column, error: Column, age_days: Column, articles: Column, corroborated: Column) -> dict[str, Column]:
    return {
        "success_rate": clip(success),
        "corroboration": clip(corroborated),
        "longevity": 1 - F.exp(-F.greatest(age_days, F.lit(0.0)) / LONGEVITY_DAYS),
        "volume": F.least(F.lit(1.0), F.log1p(F.greatest(articles, F.lit(0)).cast("double")) / F.log1p(F.lit(2 * VOLUME_HALF))),
        "error_penalty": 1 - clip(error),
    }


def source_credibility(parts: dict[str, Column]) -> Column:
    return clip(sum((SOURCE_WEIGHTS[k] * v for k, v in parts.items()), F.lit(0.0)))


# --- articles -----------------------------------------------------------------------------------------------------

#: Fixed values.
ARTICLE_WEIGHTS = {"length": 0.25, "source_credibility": 0.22, "has_published_at": 0.13, "title_quality": 0.13, "language_confidence": 0.12, "has_author": 0.10, "duplicate_penalty": 0.05}
LENGTH_FLOOR = 0.15


def length_score(n: Column) -> Column:
    """Full from 600 to 1,500 words, little under 120, falling from 4,000 to a floor at 12,000."""
    n = F.greatest(n, F.lit(0)).cast("double")
    rising = LENGTH_FLOOR + (1 - LENGTH_FLOOR) * (0.5 * ramp(n, 30, 120) + 0.5 * ramp(n, 120, 600))
    falling = F.greatest(F.lit(LENGTH_FLOOR), 0.85 - (0.85 - LENGTH_FLOOR) * ramp(n, 4000, 12000))
    return F.when(n <= 30, LENGTH_FLOOR * ramp(n, 0, 30)).when(n < 600, rising).when(n <= 1500, 1.0).when(n <= 4000, 1 - 0.15 * ramp(n, 1500, 4000)).otherwise(falling)


LETTER, UPPER = r"\p{L}", r"\p{Lu}"


def caps_ratio(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(LETTER))
    return F.when(letters > 0, F.regexp_count(text, F.lit(UPPER)) / letters).otherwise(0.0)


def title_quality(title: Column) -> Column:
    """Length of 30 to 90 characters, few capitals, few marks."""
    t = F.trim(F.coalesce(title, F.lit("")))
    n = F.char_length(t)
    length = F.when(n < 30, ramp(n, 15, 30)).when(n <= 90, 1.0).otherwise(1 - ramp(n, 90, 160))
    caps = F.when(F.regexp_count(t, F.lit(LETTER)) > 0, 1 - ramp(caps_ratio(t), 0.35, 0.85)).otherwise(1.0)
    marks = 1 - F.least(F.lit(1.0), F.regexp_count(t, F.lit("[!?]")) / 3.0)
    return F.when(n == 0, 0.0).otherwise(length * (0.5 + 0.5 * caps) * (0.5 + 0.5 * marks))


def article_parts(words: Column, author: Column, published: Column, language: Column, title: Column, near_duplicate: Column, credibility: Column) -> dict[str, Column]:
    return {
        "length": length_score(words),
        "source_credibility": clip(F.coalesce(credibility, F.lit(0.5))),
        "has_published_at": F.when(published, 1.0).otherwise(0.0),
        "title_quality": title_quality(title),
        "language_confidence": clip(language),
        "has_author": F.when(author, 1.0).otherwise(0.0),
        "duplicate_penalty": 1 - clip(near_duplicate),
    }


def article_quality(parts: dict[str, Column]) -> Column:
    return clip(sum((ARTICLE_WEIGHTS[k] * v for k, v in parts.items()), F.lit(0.0)))


# --- bias ---------------------------------------------------------------------------------------------------------

#: The marker words.
SUBJECTIVE = (
    "amazing appalling astonishing awful best brilliant catastrophe catastrophic chaos crazy devastating disaster disgrace disgraceful dreadful "
    "extraordinary fabulous fantastic frightening horrible horrific incredible insane outrage outrageous perfect ridiculous scandal scandalous shameful "
    "shocking spectacular stunning terrible terrifying tragedy tragic unbelievable wonderful worst "
    "clearly obviously undeniably surely frankly honestly absurd blatant must should shameless"
).split()
HEDGING = (
    "allegedly apparently arguably could likely may maybe might perhaps possibly presumably probably purportedly reportedly seemingly supposedly "
    "claim claims claimed rumored rumoured speculation unconfirmed"
).split()
SUPERLATIVE = (
    "best worst biggest smallest greatest largest huge massive ultimate epic insane unbelievable shocking ever never always must everyone nobody secret "
    "exposed revealed destroyed slammed explosive"
).split()


def tokens(text: Column) -> Column:
    """Unicode word tokens of the lower-cased text (NFKC matters for compatibility forms only; see functions.text)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1))


def share_in(words: Column, markers: list[str]) -> Column:
    n = F.size(words)
    return F.when(n > 0, F.size(F.filter(words, lambda w: w.isin(markers))) / n).otherwise(0.0)


def subjectivity(words: Column) -> Column:
    """Density of opinion and hedging words, saturating at 6 %. `words` should be a column of tokens()."""
    return saturate(share_in(words, sorted({*SUBJECTIVE, *HEDGING})), 0.06)


def sensationalism(title: Column, words: Column) -> Column:
    """Mean of capitals, marks by word and superlatives."""
    t = F.trim(F.coalesce(title, F.lit("")))
    n = F.greatest(F.lit(1), F.regexp_count(t, F.lit(r"(?U)\b\p{L}{2,}\b")))
    marks = saturate(F.regexp_count(t, F.lit("[!?]")) / n, 0.34)
    return F.when(t == "", 0.0).otherwise((caps_ratio(t) + marks + saturate(share_in(words, SUPERLATIVE), 0.15)) / 3)


# --- crawling -----------------------------------------------------------------------------------------------------

#: Fixed values.
FAST = ("markets", "finance", "economy", "business", "general", "breaking", "world")
MEDIUM = ("technology", "tech", "politics", "sports", "health", "energy")
BOT_FACTOR = {0: 1.0, 1: 1.5, 2: 3.0, 3: 6.0}
POLITENESS = {0: (1.0, 0.25, 4, True), 1: (0.5, 0.5, 2, True), 2: (0.2, 1.5, 1, True), 3: (0.1, 3.0, 1, True)}
PRICING = {"claude-opus": (5.0e-6, 25.0e-6), "claude-sonnet": (3.0e-6, 15.0e-6), "claude-haiku": (1.0e-6, 5.0e-6)}


def cadence_seconds(categories: Column, bot_sensitivity: Column) -> Column:
    low = F.transform(F.coalesce(categories, F.array().cast("array<string>")), lambda c: F.lower(c))
    base = F.when(F.arrays_overlap(low, F.array(*map(F.lit, FAST))), 300).when(F.arrays_overlap(low, F.array(*map(F.lit, MEDIUM))), 900).otherwise(3600)
    factor = F.lit(1.0)
    for tier, f in BOT_FACTOR.items():
        factor = F.when(F.coalesce(bot_sensitivity, F.lit(0)) == tier, f).otherwise(factor)
    return F.floor(base * factor).cast("int")


def politeness(bot_sensitivity: Column) -> Column:
    """struct<rps, jitter_s, max_concurrency, respect_robots> of a tier, clamped to 0..3."""
    tier = F.greatest(F.lit(0), F.least(F.lit(3), bot_sensitivity))
    def of(t: int) -> Column:
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(("rps", "jitter_s", "max_concurrency", "respect_robots"), POLITENESS[t], strict=True)])

    out = of(3)
    for t in (2, 1, 0):
        out = F.when(tier == t, of(t)).otherwise(out)
    return out


def cost_usd(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    out = F.lit(0.0)
    for prefix, (a, b) in reversed(PRICING.items()):
        out = F.when(model.startswith(prefix), tokens_in * a + tokens_out * b).otherwise(out)
    return out
