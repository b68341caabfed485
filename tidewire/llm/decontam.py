"""Benchmark decontamination over item-sized windows, in DataFrame operations only.

A document leaks an item when one of its windows of as many shingles as the item has (the document's rest, at its end)
is at least `threshold` similar to the item. Similarity is exact: over shingles of five words, weighted by how often
each occurs, the sum of least weights by the sum of greatest weights.

1. A window that similar shares a shingle with the item. Shifting it to begin at its first shared shingle takes no shared
   shingle out, so the windows that begin at a shared shingle are enough. Shared shingles come from one pass over the
   documents joined with the items' shingles; the texts aren't shuffled.
2. Each of these windows is scored exactly by running sums over the hits in order, so the work is linear in the hits: a
   hit counts for the windows that begin after the hit of its shingle as many times before as the item has the shingle,
   and not before the hit less the item's size. The best window of a document and item (the first among equals) leaks if
   it reaches the threshold.
3. The leaking windows and their items get a 128-bit SimHash; the distance is reported and decides nothing: a fingerprint
   can't propose windows without losing some (figures in the README), so the shared shingles propose and the exact
   similarity decides.

Null or empty texts leak nothing. A text of fewer than five words is one shingle. Repeated rows give one row. Items that
repeat are each reported. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import bounded_broadcast, materialize

WIDTH, BLOCKS, BLOCK_BITS = 5, 8, 16
#: Rows up to which the items' shingles (three numbers each) are broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000
SPACE = " \t\n\x0b\f\r"


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """df with _w, the lower-cased words, in place of the text.

    Each step is a column of its own that the next names more than once: the optimizer then keeps it, where a repeated
    expression would be computed again for every use.
    """
    df = df.withColumn("_flat", F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(SPACE)))
    return df.withColumn("_w", F.when(F.col("_flat") == "", F.array().cast("array<string>")).otherwise(F.split("_flat", r"[ \t-\r]+"))).drop(text, "_flat")


def with_shingles(df: DataFrame, text: str = "text") -> DataFrame:
    """df with sh, the hashes of its shingles, in place of the text: for few rows, as lambdas are interpreted."""
    w, n = F.col("_w"), F.size("_w")
    at_each = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WIDTH)]))
    sh = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.slice(at_each, F.lit(1), F.greatest(n - (WIDTH - 1), F.lit(1))))
    return with_words(df, text).withColumn("sh", sh).drop("_w")


def each_shingle(df: DataFrame, text: str = "text") -> DataFrame:
    """A row a shingle: m (the shingles of the text), pos, h. Hashes are computed in generated code.

    A text of fewer than five words has one shingle; hashing passes over the words that it lacks. The outer explode is
    meant: for the inner one the optimizer would copy all of the expressions below it into a filter.
    """
    df = with_words(df, text)
    n = F.size("_w")
    df = df.withColumn("m", F.greatest(n - (WIDTH - 1), F.lit(1))).withColumn("_z", F.arrays_zip(*[F.col("_w") if not k else F.slice("_w", F.lit(k + 1), F.greatest(n, F.lit(1))) for k in range(WIDTH)])).drop("_w")
    df = df.select(*[c for c in df.columns if c != "_z"], F.posexplode_outer("_z").alias("pos", "s"))
    names = [f.name for f in df.schema["s"].dataType]
    fields = [F.col("s").getField(f) for f in names]
    return df.filter(fields[-1].isNotNull() | ((F.col("pos") == 0) & (F.col("m") == 1))).withColumn("h", F.xxhash64(*fields)).drop("s")


def fingerprints(df: DataFrame, name: str) -> DataFrame:
    """df with fp: BLOCKS numbers of BLOCK_BITS bits for the shingle hashes `sh`; each bit is the majority of its bit.

    The hashes are written first: an expression that the optimizer inlines would compute them again for every bit.
    """
    df = materialize(df.withColumn("sh2", F.transform("sh", lambda h: F.xxhash64(h, F.lit(1)))), f"{name}-shingles")
    half = BLOCKS // 2

    def bit(hashes: str, j: Column) -> Column:
        votes = F.aggregate(F.col(hashes), F.lit(0), lambda s, h: s + F.getbit(h, j) * 2 - 1)
        return F.when(votes > 0, 1).otherwise(0)

    def block(hashes: str, k: int) -> Column:
        places = F.sequence(F.lit(k * BLOCK_BITS), F.lit((k + 1) * BLOCK_BITS - 1))
        return F.aggregate(places, F.lit(0), lambda s, j: s * 2 + bit(hashes, j))

    fp = F.array(*[block("sh" if k < half else "sh2", k % half) for k in range(BLOCKS)])
    return materialize(df.withColumn("fp", fp).drop("sh", "sh2"), name)


def window_weights(hits: DataFrame) -> DataFrame:
    """(doc_id, th, item_id, n, m, start, common) of the windows of n shingles that begin at a hit (doc_id, th, item_id, n, m,
    pos, h, w): the sum over shingles of the least of w and the shingle's hits in the window."""
    pair = ["doc_id", "th", "item_id"]
    of = Window.partitionBy(*pair)
    placed = hits.withColumn("k", F.row_number().over(Window.partitionBy(*pair, "h").orderBy("pos")))
    # The position of the w-th hit of the shingle before, which the window must begin behind.
    earlier = placed.select(*[F.col(c).alias(f"_{c}") for c in (*pair, "h")], (F.col("k") + F.col("w")).alias("_k"), F.col("pos").alias("q"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*pair, "h", "k")]
    placed = placed.join(earlier, reduce(lambda x, y: x & y, same), "left")
    low = F.greatest(F.coalesce("q", F.lit(-1)), F.col("pos") - F.col("n")) + 1
    event = lambda at, add, start: F.struct(at.cast("bigint").alias("at"), F.lit(add).alias("add"), F.lit(start).alias("is_start"))
    events = placed.select(*pair, "n", "m", F.explode(F.array(event(low, 1, False), event(F.col("pos") + 1, -1, False), event(F.col("pos"), 0, True))).alias("e")).select(*pair, "n", "m", "e.*")
    running = of.orderBy("at", "is_start").rowsBetween(Window.unboundedPreceding, 0)
    summed = events.withColumn("common", F.sum("add").over(running)).filter("is_start")
    return summed.select(*pair, "n", "m", F.col("at").alias("start"), "common")


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, th, item_id, start, n_shingles, similarity, hamming): the best window of each document and item.

    th is the hash of the text, which tells apart rows that share an id.
    """
    share = F.lit(float(threshold))
    item = with_shingles(items.select("item_id", "text")).withColumn("n", F.size("sh")).filter("n > 0")
    item = materialize(item, "items")
    weights = materialize(item.select("item_id", "n", F.explode("sh").alias("h")).groupBy("item_id", "n", "h").agg(F.count("*").alias("w")), "item-shingles")
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    each = each_shingle(source.withColumn("th", F.xxhash64("text")))
    hits = materialize(each.join(bounded_broadcast(weights, weights.count(), BROADCAST_ROWS), "h"), "hits")
    pair = ["doc_id", "th", "item_id"]
    enough = hits.groupBy(*pair).agg(F.count("*").alias("k"), F.first("n").alias("n")).filter(F.col("k") >= share * F.col("n")).select(*[F.col(c).alias(f"_{c}") for c in pair])
    hits = hits.join(enough, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("th") == F.col("_th")) & F.col("item_id").eqNullSafe(F.col("_item_id")), "left_semi").distinct()
    scored = window_weights(hits)
    scored = scored.withColumn("size", F.least("n", F.col("m") - F.col("start"))).withColumn("similarity", F.col("common") / (F.col("n") + F.col("size") - F.col("common"))).filter(F.col("similarity") >= share)
    best = scored.groupBy("doc_id", "th", "item_id", "n").agg(F.max(F.struct(F.round("similarity", 6).alias("s"), (-F.col("start")).alias("back"), "similarity")).alias("x"))
    best = materialize(best.select("doc_id", "th", "item_id", "n", (-F.col("x.back")).alias("start"), F.col("x.similarity").alias("similarity")), "windows")
    # Fingerprints of the windows; the documents' shingles are computed again for these documents only.
    windows = best.select("doc_id", "th", "start", "n").distinct().withColumn("d", F.coalesce("doc_id", F.lit(-1)))
    count = windows.count()
    texts = source.select(F.coalesce("doc_id", F.lit(-1)).alias("d"), F.xxhash64("text").alias("th"), "text")
    cut = texts.join(bounded_broadcast(windows, count, BROADCAST_ROWS), ["d", "th"]).dropDuplicates(["d", "th", "start", "n"])
    cut = with_shingles(cut).select("d", "th", "start", "n", F.slice("sh", F.col("start") + 1, F.col("n")).alias("sh"))
    prints = fingerprints(cut, "window-prints")
    index = fingerprints(item, "item-prints").withColumnRenamed("fp", "ifp")
    distance = F.aggregate(F.zip_with("fp", "ifp", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    found = best.withColumn("d", F.coalesce("doc_id", F.lit(-1))).join(prints.select("d", "th", "start", "n", "fp"), ["d", "th", "start", "n"]).join(index.select("item_id", "n", "ifp").dropDuplicates(["item_id", "n"]), ["item_id", "n"])
    return found.select("doc_id", "th", "item_id", "start", F.col("n").alias("n_shingles"), "similarity", distance.alias("hamming"))


def contamination(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, start, n_shingles, similarity): one row a document id and item it leaks."""
    found = leaks(docs, items, threshold)
    best = found.groupBy("doc_id", "item_id", "n_shingles").agg(F.max(F.struct(F.round("similarity", 6).alias("s"), (-F.col("start")).alias("back"))).alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.back")).cast("bigint").alias("start"), F.col("n_shingles").cast("bigint").alias("n_shingles"), F.col("x.s").alias("similarity"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs without the rows that leak an item."""
    bad = materialize(leaks(docs, items, threshold).select(F.col("doc_id").alias("_leak_id"), F.col("th").alias("_leak_th")).distinct(), "leaks")
    bad = bounded_broadcast(bad, bad.count(), BROADCAST_ROWS)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_leak_id"]) & (F.xxhash64(docs["text"]) == bad["_leak_th"]), "left_anti")
