"""Upserts and projections: what a stage writes, computed as whole frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.functions import scores, text
from tidewire.tables import written


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: one aggregation, no window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def upsert_articles(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles, versions, changes) after incoming rows, keyed by canonical_url.

    New addresses are inserted; an equal content hash changes nothing; another one revises the row, keeps the old one as
    a version, and keeps language and time where the revision has none.
    """
    new = last_of(incoming, ["canonical_url"], "fetched_at").select(*[F.col(c).alias(f"n_{c}") for c in incoming.columns])
    both = stored.join(new, stored["canonical_url"] == new["n_canonical_url"], "full_outer")
    known, given = F.col("canonical_url").isNotNull(), F.col("n_canonical_url").isNotNull()
    revised = known & given & ~F.col("content_hash").eqNullSafe(F.col("n_content_hash"))
    both = both.withColumn("change", F.when(~known, "insert").when(revised, "revise").when(given, "same").otherwise("keep"))
    take = F.col("change").isin("insert", "revise")
    cols = []
    for c in stored.columns:
        if c not in incoming.columns:
            cols.append(F.col(c))
        elif c in ("language", "published_at"):
            cols.append(F.when(take, F.coalesce(f"n_{c}", c)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.when(take, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c))
    versions = both.filter("change = 'revise'").select("canonical_url", "title", "body", "content_hash", "fetched_at")
    changes = both.filter("change <> 'keep'").select(F.coalesce("n_canonical_url", "canonical_url").alias("canonical_url"), "change")
    return both.select(*cols), versions, changes


def upsert_sources(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Sources keyed by feed_url, else homepage_url; enabled and health stay as they were."""
    key = F.coalesce("feed_url", "homepage_url")
    old, new = stored.withColumn("_k", key), incoming.withColumn("_k", key).dropDuplicates(["_k"])
    kept = {"enabled", "health", "id", "created_at"}
    both = old.alias("o").join(new.alias("n"), "_k", "full_outer")
    cols = []
    for c in stored.columns:
        if c not in incoming.columns:
            cols.append(F.col(f"o.{c}").alias(c))
        elif c in kept:
            cols.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
        else:
            cols.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
    return both.select(*cols)


def upsert_securities(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Securities keyed by symbol; aliases are united, equal ones in any case kept once."""
    both = stored.alias("o").join(incoming.alias("n"), "symbol", "full_outer")
    aliases = text.clean_list_any_case(F.concat(F.coalesce("o.aliases", F.array().cast("array<string>")), F.coalesce("n.aliases", F.array().cast("array<string>"))))
    rest = [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in stored.columns if c not in ("symbol", "aliases") and c in incoming.columns]
    return both.select("symbol", *rest, aliases.alias("aliases"))


KEYS_OF_SOURCES = ("feed_url", "homepage_url", "name")


def apply_corrections(catalog: DataFrame, corrections: DataFrame) -> DataFrame:
    """catalog with the columns that corrections (name, ...) give for a name; null gives nothing."""
    new = corrections.select(*[F.col(c).alias(f"_{c}") for c in corrections.columns])
    both = catalog.join(new, F.lower("name") == F.lower("_name"), "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in corrections.columns and c != "name" else F.col(c) for c in catalog.columns])


def merge_catalog(base: DataFrame, extra: DataFrame) -> DataFrame:
    """base plus the extra rows (pos, name, feed_url, homepage_url), taken in order of pos, that share no feed, address or
    name, in any case, with a row before them that was taken.

    Rows that share a key with the base go at once. Of the others, a row that comes first under all its keys is taken,
    what shares a key with it goes, and so on: the sequential rule, in as many rounds as rows wait for one another.
    """
    def keys(df: DataFrame, *columns: str) -> DataFrame:
        each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lower(k).alias("value")) for k in KEYS_OF_SOURCES])
        return df.select(*columns, F.explode(each).alias("k")).select(*columns, "k.*").filter("value is not null")

    key = ["kind", "value"]
    known = keys(extra, "pos").join(keys(base).distinct(), key, "left_semi").select("pos").distinct()
    waiting = written(keys(extra, "pos").join(known, "pos", "left_anti"), "waiting")
    taken = extra.filter(F.greatest(*[F.col(k).isNotNull() for k in KEYS_OF_SOURCES]) == F.lit(False)).select("pos")
    while True:
        first = waiting.groupBy(*key).agg(F.min("pos").alias("first"))
        won = waiting.join(first, key).groupBy("pos").agg(F.min(F.col("first") == F.col("pos")).alias("won")).filter("won").select("pos")
        won = written(won, "taken")
        if won.isEmpty():
            break
        taken = taken.unionByName(won)
        shut = waiting.join(won, "pos", "left_semi").select(*key).distinct()
        gone = waiting.join(shut, key, "left_semi").select("pos").distinct()
        waiting = written(waiting.join(gone, "pos", "left_anti"), "waiting")
    return base.unionByName(extra.join(taken, "pos", "left_semi").select(*base.columns), allowMissingColumns=True)


# --- analysis results -----------------------------------------------------------------------------------------------


def payloads(results: DataFrame, kind: str) -> DataFrame:
    """Rows of a kind with their parsed payload p; rows whose JSON doesn't parse have p null."""
    return results.filter((F.col("kind") == kind) & F.col("error").isNull()).withColumn("p", F.from_json("result", schemas.RESULT[kind]))


def text_id(value: Column) -> Column:
    """A number for a dimension's text: the same in every run and partition, without a counter."""
    return F.xxhash64(value).bitwiseAND(F.lit((1 << 62) - 1))


def project_entities(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, article_entities); of an entity named twice in one article the higher salience stays."""
    rows = payloads(results, "entities").select(F.col("target_id").alias("article_id"), F.explode("p.entities").alias("e")).select("article_id", "e.*").filter("trim(name) <> ''")
    rows = rows.withColumn("type", F.coalesce("type", F.lit("other"))).withColumn("entity_id", text_id(F.concat_ws("\x1f", "type", F.trim(F.col("name")))))
    dim = rows.groupBy("entity_id").agg(F.first(F.trim(F.col("name"))).alias("name"), F.first("type").alias("type"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("aliases"))
    links = rows.groupBy("article_id", "entity_id").agg(F.max(scores.clip(F.coalesce("salience", F.lit(0.0)))).alias("salience"), F.sum(F.coalesce("count", F.lit(1))).alias("count"), F.avg("sentiment").alias("sentiment"))
    return dim, links


def project_keywords(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = payloads(results, "keywords").select(F.col("target_id").alias("article_id"), F.explode("p.keywords").alias("k")).select("article_id", F.trim("k.term").alias("term"), F.coalesce("k.weight", F.lit(0.0)).alias("weight")).filter("term <> ''")
    rows = rows.withColumn("keyword_id", text_id(F.col("term")))
    return rows.select("keyword_id", "term").distinct(), rows.groupBy("article_id", "keyword_id").agg(F.max("weight").alias("weight"))


def project_topics(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = payloads(results, "topics").select(F.col("target_id").alias("article_id"), F.explode("p.topics").alias("t")).select("article_id", "t.*")
    rows = rows.withColumn("slug", text.slugify(F.coalesce("slug", "label"))).filter("slug <> ''").withColumn("topic_id", text_id(F.col("slug")))
    return rows.groupBy("topic_id", "slug").agg(F.max(F.coalesce("label", "slug")).alias("label")), rows.groupBy("article_id", "topic_id").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def latest_results(results: DataFrame) -> DataFrame:
    """One row a (target, kind, provider): the last writer wins, so a replay changes nothing."""
    return last_of(results, ["target_type", "target_id", "kind", "provider"], "seq")


def project_vectors(results: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """((article_id, embedding), rows of another length with the reason) of embedding results."""
    return check_vectors(payloads(results, "embedding").select(F.col("target_id").alias("article_id"), F.col("p.vector").alias("embedding")), dim)


def check_vectors(df: DataFrame, dim: int, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows whose vector has dim numbers, the others with the reason)."""
    n = F.size(column)
    reason = F.when(F.col(column).isNull(), "no vector").when(n != dim, F.format_string("a vector of %d numbers, not " + str(dim), n))
    marked = df.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def analyzed(articles: DataFrame, results: DataFrame) -> DataFrame:
    """articles with status analyzed where any kind has a result."""
    done = results.filter("error is null and target_type = 'article'").select(F.col("target_id").alias("_done")).distinct()
    return articles.join(done, F.col("id") == F.col("_done"), "left").withColumn("status", F.when(F.col("_done").isNotNull(), "analyzed").otherwise(F.col("status"))).drop("_done")
