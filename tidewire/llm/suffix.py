"""Exact substring removal: every byte that lies in a 100-byte string which also starts earlier.

Prefix doubling ranks positions by ever longer prefixes. Ranking every byte would shuffle each of them in every round, which
a large corpus can't afford (figures in the README). So this is not doubling but winnowing with two fixed ranks: of
positions that the text itself samples, a k-gram (k = 32) that is least by hash in some window of 100 - k + 1 positions,
first by the k-gram and then by the whole context. Equal 100-byte strings hold the same sampled positions, so none is
lost, and about one position in 35 is ranked.

1. Equal texts are grouped by hash; all but the first are repeats whole (if they have 100 bytes).
2. Sampled positions are ranked by their k-gram; Spark sorts (rank, rank of the context) pairs, where a context is
   all bytes that a 100-byte string around the position can hold: up to 68 before and 100 after. Positions of a unique
   k-gram are past. Of those with equal contexts the later repeat whole contexts.
3. What remains are k-grams with differing contexts, at the edges of repeats and at edits: every 100-byte string around
   them is ranked, and all but the first of equal ones are repeats. K-grams with more contexts than a task takes go
   through an aggregation by Spark instead; both ways give the same strings.
4. Each document's repeats are united, and its other bytes are what it keeps.

Order of occurrences: doc_id, then start; rows that share a doc_id are told apart by the hash of their text. Null text is
empty. Repeated rows (same id and text) are one document. Texts under 100 bytes keep everything. Strings are compared by
128 bits of hash: the k-gram's and the string's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import byte_texts, map_rows, materialize, schema_of, small_batches, values

WIDTH, GRAM = 100, 32
#: Sampled positions that a task sorts before it sends on the first of equal ones.
CHUNK = 600_000
#: Contexts of one k-gram that a task ranks by itself.
HOT = 20_000

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
M1, M2, S32 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD), np.uint64(32)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> S32)) * M1
    h = (h ^ (h >> S32)) * M2
    return h ^ (h >> S32)


class Powers:
    """Powers of the base and of its inverse, up to the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up), 1 << 12)
            with np.errstate(over="ignore"):
                steps = np.full(size, BASE, np.uint64)
                back = np.full(size, INVERSE, np.uint64)
                steps[0] = back[0] = 1
                self.up, self.down = np.multiply.accumulate(steps), np.multiply.accumulate(back)
        return self.up, self.down


BYTE = mixed(np.arange(1, 257, dtype=np.uint64))  # bytes as random numbers, so that sums of few don't clash


class Hashes:
    """Hashes of any range of one text, from sums of its prefixes."""

    def __init__(self, text: bytes, powers: Powers):
        self.n = len(text)
        up, self.down = powers.to(self.n)
        with np.errstate(over="ignore"):
            self.sums = np.empty(self.n + 1, np.uint64)
            self.sums[0] = 0
            np.cumsum(BYTE[np.frombuffer(text, np.uint8)] * up[: self.n], out=self.sums[1:])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[high] - self.sums[low]) * self.down[low] + (high - low).astype(np.uint64))

    def grams(self) -> np.ndarray:
        m = self.n - GRAM + 1
        with np.errstate(over="ignore"):
            return mixed((self.sums[GRAM:] - self.sums[:m]) * self.down[:m] + np.uint64(GRAM))


def slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (greatest) of each window, by windows of doubling widths."""
    pick = np.minimum if least else np.maximum
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def sampled(h: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(positions, k-gram hashes): those least in some window of WIDTH - GRAM + 1 positions, ties all counted."""
    if h.n < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = h.grams()
    window = WIDTH - GRAM + 1
    least = slide(grams, window, True)
    pad = np.zeros(window - 1, np.uint64)
    top = slide(np.concatenate([pad, least, pad]), window, False)
    at = np.flatnonzero(grams == top)
    return at, grams[at]


def context(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(at - (WIDTH - GRAM), 0), np.minimum(at + WIDTH, n)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def starts_of_runs(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


POSITION = "gram bigint, ctx bigint, doc_id bigint, th bigint, at int, low int, high int, repeat boolean"


def positions(docs: DataFrame) -> DataFrame:
    """POSITION rows of distinct texts (doc_id, th, text). repeat: an equal context came before in the same task."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cols = [np.concatenate([h[k] for h in held]) for k in range(7)]
            held.clear()
            gram, ctx, doc, th, at, low, high = cols
            order = np.lexsort((at, th, doc, ctx, gram))
            gram, ctx, doc, th, at, low, high = (c[order] for c in cols)
            repeat = ~starts_of_runs(gram, ctx)
            names = [f.split()[0] for f in POSITION.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (signed(gram), signed(ctx), doc, th, at.astype(np.int32), low.astype(np.int32), high.astype(np.int32), repeat)], names=names)

        for batch in batches:
            for doc, th, text in zip(values(batch, "doc_id"), values(batch, "th"), byte_texts(batch), strict=True):
                h = Hashes(text, powers)
                at, gram = sampled(h)
                if len(at):
                    low, high = context(at, h.n)
                    # How far before the position the context begins is part of it.
                    with np.errstate(over="ignore"):
                        ctx = h.of(low, high) ^ mixed((at - low).astype(np.uint64) + np.uint64(1))
                    held.append((gram, ctx, np.full(len(at), doc, np.int64), np.full(len(at), th, np.int64), at, low, high))
                    size += len(at)
                if size >= CHUNK:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.select("doc_id", "th", "text").mapInArrow(run, schema_of(POSITION))


def ranked(rows: DataFrame) -> DataFrame:
    """POSITION rows, those of one k-gram together and sorted by k-gram, context and place -> (doc_id, th, at, low, high, gram, kind).

    kind 1: a context that came before. kind 2: the first of its context, of a k-gram with several contexts.
    """
    schema = schema_of("doc_id bigint, th bigint, at int, low int, high int, gram bigint, kind int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_gram = last_ctx = None  # of the row before this batch
        waiting: pa.Table | None = None  # the first row of the last k-gram, while only one context of it is known

        def judge(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal last_gram, last_ctx, waiting
            gram, ctx = table["gram"].to_numpy(), table["ctx"].to_numpy()
            new_gram, new_ctx = starts_of_runs(gram), starts_of_runs(gram, ctx)
            if last_gram is not None and gram[0] == last_gram:
                new_gram[0] = False
                new_ctx[0] = ctx[0] != last_ctx
            run_of = np.cumsum(new_gram) - 1  # -1: goes on from the batch before
            contexts = np.bincount(run_of + 1, new_ctx, minlength=run_of[-1] + 2)  # per run, slot 0 for the one going on
            kind = np.where(~new_ctx, 1, 0)
            many = contexts >= 2
            many[0] = contexts[0] >= 1  # one more than what was seen before
            kind[new_ctx & many[run_of + 1]] = 2
            if waiting is not None and contexts[0] >= 1:
                yield from emit(waiting, np.array([2]))
                waiting = None
            tail = run_of[-1]
            if tail >= 0:  # another k-gram is open now
                waiting = None
                if contexts[tail + 1] == 1:
                    waiting = table.slice(int(np.flatnonzero(new_gram)[-1]), 1)
            last_gram, last_ctx = gram[-1], ctx[-1]
            yield from emit(table, kind)

        def emit(table: pa.Table, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
            keep = np.flatnonzero(kind > 0)
            if len(keep):
                out = table.take(pa.array(keep)).select(["doc_id", "th", "at", "low", "high", "gram"]).append_column("kind", pa.array(kind[keep], pa.int32()))
                yield from out.to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            again = table["repeat"].to_numpy()
            if again.any():
                yield from emit(table, again.astype(int))
                table = table.filter(pa.array(~again))
            if table.num_rows:
                yield from judge(table)

    return rows.mapInArrow(run, schema)


EDGE = "gram bigint, string bigint, doc_id bigint, th bigint, start int"


def strings_at(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """EDGE rows: the 100-byte strings around each edge position (doc_id, th, places array<struct<gram, at>>)."""
    rows = docs.join(edges, ["doc_id", "th"]).select("doc_id", "th", "text", "places")
    schema = schema_of("gram bigint, doc_id bigint, th bigint, first int, around binary")

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc, th, text, places in zip(values(batch, "doc_id"), values(batch, "th"), byte_texts(batch), values(batch, "places"), strict=True):
                for p in places:
                    low = max(p["at"] - (WIDTH - GRAM), 0)
                    for k, v in (("gram", p["gram"]), ("doc_id", doc), ("th", th), ("first", low), ("around", text[low : p["at"] + WIDTH])):
                        out[k].append(v)
            return out

        return step

    return map_rows(rows, ["doc_id", "th", "text", "places"], make, schema)


def unpack(rows: tuple[list, list, list, list, list], powers: Powers) -> tuple[np.ndarray, ...]:
    """(gram, string, doc_id, th, start) of all 100-byte strings of the contexts."""
    gram, doc, th, first, around = rows
    lengths = np.fromiter(map(len, around), np.int64, len(around))
    sizes = lengths - WIDTH + 1
    step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = step + np.repeat(np.cumsum(lengths) - lengths, sizes)
    strings = signed(Hashes(b"".join(around), powers).of(place, place + WIDTH))
    start = step + np.repeat(np.array(first, np.int64), sizes)
    return np.repeat(np.array(gram, np.int64), sizes), strings, np.repeat(np.array(doc, np.int64), sizes), np.repeat(np.array(th, np.int64), sizes), start


def intervals(doc: np.ndarray, th: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Consecutive starts of one text as (doc, th, low, high)."""
    order = np.lexsort((start, th, doc))
    doc, th, start = doc[order], th[order], start[order]
    new = starts_of_runs(doc, th)
    new[1:] |= start[1:] > start[:-1] + WIDTH
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1 if len(first) else first
    return doc[first], th[first], start[first], start[last] + WIDTH


SPANS = "doc_id bigint, th bigint, low int, high int"


def span_batch(doc: np.ndarray, th: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(start):
        d, t, low, high = intervals(doc, th, start)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["doc_id", "th", "low", "high"])


def repeated_strings(rows: DataFrame) -> DataFrame:
    """SPANS of all but the first of equal strings, within partitions that hold each k-gram's rows together, sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        held: list[list] = [[], [], [], [], []]

        def flush(n: int) -> Iterator[pa.RecordBatch]:
            part = tuple(h[:n] for h in held)
            for h in held:
                del h[:n]
            if n:
                gram, string, doc, th, start = unpack(part, powers)
                order = np.lexsort((start, th, doc, string, gram))
                gram, string, doc, th, start = (x[order] for x in (gram, string, doc, th, start))
                new = starts_of_runs(gram, string)
                first = np.flatnonzero(new)[np.cumsum(new) - 1]
                # Two positions of one k-gram may lie in one string: that is the same occurrence.
                again = (doc != doc[first]) | (th != th[first]) | (start != start[first])
                yield from span_batch(doc[again], th[again], start[again])

        for batch in batches:
            for h, c in zip(held, ("gram", "doc_id", "th", "first", "around"), strict=True):
                h += values(batch, c)
            if len(held[0]) > HOT:  # up to the last k-gram's beginning
                n = len(held[0])
                while n and held[0][n - 1] == held[0][-1]:
                    n -= 1
                yield from flush(n)
        yield from flush(len(held[0]))

    return rows.mapInArrow(run, schema_of(SPANS))


def hot_strings(rows: DataFrame) -> DataFrame:
    """The same for k-grams of very many contexts: Spark aggregates the strings."""
    schema = schema_of(EDGE)

    def make():
        powers = Powers()

        def step(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            gram, string, doc, th, start = unpack(tuple(values(batch, c) for c in ("gram", "doc_id", "th", "first", "around")), powers)
            return {"gram": gram, "string": string, "doc_id": doc, "th": th, "start": start}

        return step

    each = map_rows(rows, ["gram", "doc_id", "th", "first", "around"], make, schema)
    first = each.groupBy("gram", "string").agg(F.min(F.struct("doc_id", "th", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("gram", "string", "first")
    again = each.join(first, ["gram", "string"]).filter(F.struct("doc_id", "th", "start") != F.col("first"))
    return again.select("doc_id", "th", F.col("start").alias("low"), (F.col("start") + WIDTH).alias("high"))


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(firsts, spans): for docs (doc_id, th, text) the first document of each text, and SPANS in those documents."""
    keys = materialize(docs.groupBy("th", "doc_id").agg(F.count("*").alias("n")), "text-keys")
    firsts = keys.groupBy("th").agg(F.min("doc_id").alias("first"))
    # An anti join would shuffle the texts; nearly all texts are first, so copies are looked up instead.
    copies = materialize(keys.join(firsts, "th").filter("doc_id <> first").select("doc_id", "th"), "copies")
    n = copies.count()
    distinct = docs.join(F.broadcast(copies) if n <= 500_000 else copies, ["doc_id", "th"], "left_anti") if n else docs
    if not keys.filter("n > 1").isEmpty():  # repeated rows are one document
        distinct = distinct.dropDuplicates(["doc_id", "th"])
    at = positions(distinct)
    # Rows known to be repeats need no neighbours: they are dealt evenly, so a hot context doesn't meet in one task.
    key = F.when(F.col("repeat"), F.xxhash64("doc_id", "th", "at")).otherwise(F.col("gram"))
    dealt = at.withColumn("key", key).repartition("key").drop("key").sortWithinPartitions("repeat", "gram", "ctx", "doc_id", "th", "at")
    found = materialize(ranked(dealt), "ranked")
    whole = found.filter("kind = 1").select("doc_id", "th", "low", "high")
    edges = found.filter("kind = 2").select("doc_id", "th", "gram", "at").distinct()
    hot = materialize(edges.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("gram"), "hot-grams")
    places = edges.groupBy("doc_id", "th").agg(F.collect_list(F.struct("gram", "at")).alias("places"))  # a text's own, bounded by it
    strings = materialize(strings_at(distinct, places), "edge-strings")
    spans = whole
    cold = strings.join(F.broadcast(hot), "gram", "left_anti").repartition("gram").sortWithinPartitions("gram")
    spans = spans.unionByName(repeated_strings(cold))
    if not hot.isEmpty():
        spans = spans.unionByName(hot_strings(strings.join(F.broadcast(hot), "gram", "left_semi")))
    return copies, materialize(spans, "spans")


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) of every row."""
    docs = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    keyed = docs.select(F.coalesce("doc_id", F.lit(-(1 << 62))).alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    copies, spans = repeats(keyed)
    marks = spans.select("doc_id", "th", "low", "high").unionByName(copies.select("doc_id", "th", F.lit(0).alias("low"), F.lit((1 << 31) - 1).alias("high")))
    marks = marks.groupBy("doc_id", "th").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    rows = keyed.join(marks, ["doc_id", "th"], "left")
    schema = schema_of("doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else ""))

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc, text, found in zip(values(batch, "doc_id"), byte_texts(batch), values(batch, "spans"), strict=True):
                n = len(text)
                cut = unite([(s["low"], min(s["high"], n)) for s in found or []]) if n >= WIDTH else []
                parts, at = [], 0
                for low, high in cut:
                    parts.append(text[at:low])
                    at = high
                kept = b"".join([*parts, text[at:]])
                row = {"doc_id": None if doc == -(1 << 62) else doc, "n_bytes": n, "n_removed": n - len(kept), "n_spans": len(cut), "kept_sha256": hashlib.sha256(kept).hexdigest()}
                for k, v in (row | ({"kept": kept} if with_text else {})).items():
                    out[k].append(v)
            return out

        return step

    return map_rows(rows, ["doc_id", "text", "spans"], make, schema)
