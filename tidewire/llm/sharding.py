"""Sharding by sampled splitters, in DataFrame operations only.

Records are ordered by (hash of the text, id, row number), so copies of a text lie together and one hot text can still
be divided. Splitters are quantiles of a sample in which a record's chance follows its size; the ranges between them are
counted, and a range that holds more than twice its share is divided again. Within each range a window gives running
bytes; with the totals of the ranges before it, that is the record's place on the whole line of bytes, and the shard is
the place's share of the line. So shard sizes differ by about one record, whatever the sample was like.

Null text: size 8. Empty table: no rows. Repeated rows: each is a record of its own. Only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import materialize

#: Ranges a shard, and sampled keys a range. 24 shards make 960 ranges and about 15,000 keys of 40 bytes on the driver.
RANGES, KEYS = 40, 16
#: Bytes of records in a range beyond which more ranges are made, so a task's sort stays small at any input.
RANGE_BYTES = 4 << 30


def literal_keys(keys: list) -> F.Column:
    """An array of (h, id, n) structs."""
    rows = ", ".join(f"named_struct('h', {h}L, 'i', {i}L, 'n', {n}L)" for h, i, n in keys)
    return F.expr(f"array({rows})".replace("-9223372036854775808L", "bigint('-9223372036854775808')"))


def at_most(keys: F.Column) -> F.Column:
    return F.size(F.filter(keys, lambda k: k <= F.col("key")))


def range_of(keys: list) -> F.Column:
    """The number of splitters at or below a row's key, by two steps of about the square root of their number."""
    if not keys:
        return F.lit(0)
    wide = max(1, round(len(keys) ** 0.5))
    blocks = [keys[i : i + wide] for i in range(0, len(keys), wide)]
    coarse = at_most(literal_keys([b[0] for b in blocks]))
    fine = F.array(*[literal_keys(b) for b in blocks])
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * wide + at_most(F.element_at(fine, F.greatest(coarse, F.lit(1)))))


def sample_keys(rows: DataFrame, size: F.Column, total: int, want: int, seed: int) -> list:
    """About `want` keys; a row's chance is its share of the bytes, by a hash of its number: a rerun draws the same."""
    draw = (F.xxhash64("n", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)))
    return sorted((r.h, r.i, r.n) for r in rows.filter(draw < size * F.lit(want / max(total, 1))).select("h", "i", "n").collect())


def quantiles(keys: list, ranges: int) -> list:
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): ranges of the key order of near-equal bytes; slots run from 0 without gaps."""
    text = F.col(text_column).cast("binary")
    rows = docs.select(
        F.col(id_column).cast("bigint").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("crc"),
        F.xxhash64(text).alias("h"),
    ).select("*", F.coalesce("id", F.lit(-(1 << 62))).alias("i"), F.monotonically_increasing_id().alias("n"))
    rows = materialize(rows, "shard-rows")  # narrow, and from here on each row keeps its number
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return rows.select(F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    ranges = shards * max(RANGES, -(-total // (shards * RANGE_BYTES)))
    ranges = min(ranges, max(1, n // 4))
    cuts = quantiles(sample_keys(rows, F.col("size"), total, ranges * KEYS, 1), ranges)
    keyed = rows.withColumn("key", F.struct("h", "i", "n"))
    for seed in range(2, 6):  # subdivide what the sample left overfull; a single record can't be divided
        placed = keyed.withColumn("r", range_of(cuts))
        full = {r.r: r for r in placed.groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("c")).filter((F.col("b") > 2 * total / ranges) & (F.col("c") > 1)).collect()}
        if not full:
            break
        more = sample_keys(placed.filter(F.col("r").isin(list(full))), F.col("size"), total, ranges * KEYS * 4, seed)
        new = set(quantiles(more, 2 * len(full) + 1)) - set(cuts)
        if not new:
            break
        cuts = sorted({*cuts, *new})
    placed = keyed.withColumn("r", range_of(cuts)).select("id", "size", "crc", "key", "r")
    totals = placed.groupBy("r").agg(F.sum("size").alias("rb"), F.count("*").alias("rc"))
    line = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges, some thousands at most
    before = totals.select("r", F.coalesce(F.sum("rb").over(line), F.lit(0)).alias("b0"), F.coalesce(F.sum("rc").over(line), F.lit(0)).alias("c0"))
    inside = Window.partitionBy("r").orderBy("key")
    run = placed.select("*", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("b"), F.row_number().over(inside).alias("c"))
    run = run.join(F.broadcast(before), "r")
    run = run.withColumn("shard", F.least(F.expr(f"int((b0 + b - size div 2) * {shards} div {total})"), F.lit(shards - 1)))
    run = materialize(run.select("id", "size", "crc", "shard", (F.col("c0") + F.col("c") - 1).alias("place")), "shard-places")
    first = run.groupBy("shard").agg(F.min("place").alias("p0"))  # one row a shard
    return run.join(F.broadcast(first), "shard").select(F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("p0")).alias("slot"))
