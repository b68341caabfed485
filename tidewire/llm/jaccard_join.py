"""Exact set-similarity join on word n-grams with set-relation skipping, and the classes that its links make.

Two documents link when the Jaccard similarity of their shingle sets is at least `percent` / 100. The join never emits
all pairs of a group of copies:

1. Equal sets are one node.
2. A set of n shingles needs only its first n - ceil(t n) + l shingles, in one order that all sets share, in the index:
   two sets that link have min(l, l') of these in common. l grows with n, so sets that share a passage only are no
   candidates. Shingles that a sample of documents shows to be frequent come last in that order (this moves work, never
   results).
   Lists of more than LONG_LIST sets are passed over, by all sets that have so few of their indexed shingles in long
   lists that they must share one in a short list with any set they link with.
3. Index lists are cut into blocks by set size. In each block every set is compared with one pivot set only, the one that
   has the least of its own before the shared shingle, so the original of many altered copies. Verified links make
   classes, and only pairs of sets of different classes are of interest from here on.
4. Short lists: their sets meet in pairs, at most LONG_LIST a row.
5. Long lists: the answers of a set x follow from those of its list's pivot p. With D(x) the shingles that only one of x and
   p has, the symmetric difference of x and y is that of D(x) and D(y), so x and y link exactly if D(x) and D(y) differ in
   few enough shingles. Sets that both link with p are connected already. Otherwise D(x) and D(y) have more than
   (|D(x)| + s (|p| - |x|)) / 2 shingles in common, s = (1 - t) / (1 + t), so the first of them, those that p lacks before those
   that x lacks, make a new, finer index under p. Sets too far from p for such a partner stay in a list with another pivot.
   The sets of short new lists meet in pairs, those that their sketches don't rule out; long ones are treated alike,
   level by level. Sets meet in pairs where lists get no shorter, and after LEVELS levels.
   No link between different classes is lost at any step.

Shingles are 64-bit hashes; sets are recomputed from the texts where they are needed instead of being stored.
Null text and text without words: the empty set, which links with nothing. Fewer words than n: the whole sequence is one
shingle. Equal rows share a set. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import Scratch, bounded_broadcast, byte_texts, map_rows, schema_of, shuffles_dropped, values
from tidewire.operators.graph import connected_components

#: Documents that the order's sample holds, and the frequent shingles that it yields (8 bytes each in every task).
SAMPLE_DOCS, FREQUENT, FREQUENT_IN = 50_000, 500_000, 3
#: Sets in an index list beyond which the list is passed over for sets that share enough other shingles.
LONG_LIST = 16
#: Levels of finer lists under pivots, and the sets in such a list beyond which it gets a pivot of its own.
LEVELS, LONG_FINER = 6, 128
#: Rows below which a table of ids is broadcast.
BROADCAST_ROWS = 300_000

MIX = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 400_000:
            self[word] = h
        return h


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> S33)) * M1
    h = (h ^ (h >> S33)) * M2
    return h ^ (h >> S33)


def shingle_hashes(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """The hash of the shingle at each position; of the whole sequence if it has fewer words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(width, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, width, np.uint64)
        for k in range(width):
            out = out * MIX + codes[k : n - width + 1 + k]
            out ^= out >> np.uint64(29)
        return finish(out)


def shingle_set(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    return np.unique(shingle_hashes(text.lower().split(), width, hashes))


def shingles_of(texts: list[bytes], width: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, number): the shingles of all texts in one array, and where each text's begin and how many there are.

    As shingle_hashes(), with one pass over all words; a text of fewer words than `width` has none here.
    """
    words = [t.lower().split() for t in texts]
    count = np.fromiter(map(len, words), np.int64, len(words))
    total = int(count.sum())
    codes = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, total)
    first = np.cumsum(count) - count
    if total < width:
        return np.zeros(0, np.uint64), first, np.zeros(len(words), np.int64)
    with np.errstate(over="ignore"):
        out = np.full(total - width + 1, width, np.uint64)
        for k in range(width):
            out = out * MIX + codes[k : total - width + 1 + k]
            out ^= out >> np.uint64(29)
        return finish(out), first, np.maximum(count - width + 1, 0)


def shingle_sets(texts: list[bytes], width: int, hashes: WordHashes) -> list[np.ndarray]:
    """shingle_set() of each text."""
    h, first, number = shingles_of(texts, width, hashes)
    return [np.unique(h[a : a + n]) if n else shingle_set(t, width, hashes) for t, a, n in zip(texts, first.tolist(), number.tolist(), strict=True)]


def fingerprint(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


#: l = 1 + n // SHARE.
SHARE = 32


def prefix_size(n: int, percent: int) -> int:
    return min(n, n - (percent * n + 99) // 100 + 1 + n // SHARE) if n else 0


def needed(n: Column, m: Column) -> Column:
    """Indexed shingles that linked sets of n and m have in common at least."""
    return F.floor(F.least(n, m) / SHARE) + 1


def left_needed(n: str, m: str, k: str, j: str) -> Column:
    """needed() in short lists: less the shared shingles that may lie in long lists."""
    return F.greatest(F.lit(1), needed(F.col(n), F.col(m)) - F.least(k, j))


def frequent_shingles(docs: DataFrame, width: int, text_column: str) -> np.ndarray:
    """Shingles that many texts of a bounded sample hold, the least frequent first."""
    n = docs.count()
    part = docs.filter(F.pmod(F.xxhash64(text_column), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE_DOCS / max(n, 1)) * (1 << 30)))).select(text_column).distinct()

    def make():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            sets = shingle_sets(byte_texts(batch, text_column), width, hashes)
            found, times = np.unique(np.concatenate(sets), return_counts=True)
            return {"h": found.view(np.int64), "n": times}

        return step

    counts = map_rows(part, [text_column], make, schema_of("h bigint, n bigint")).groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT_IN)
    rows = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    return rows.sort_values(["n", "h"])["h"].to_numpy(np.int64).view(np.uint64)


def signatures(docs: DataFrame, width: int, percent: int, order: np.ndarray, id_column: str, text_column: str) -> DataFrame:
    """(id, n, fp, tokens): the set's size, its fingerprint, and its first shingles in the shared order."""
    schema = T.StructType([docs.schema[id_column], *schema_of("n bigint, fp binary, tokens array<bigint>")])
    rank_of = np.argsort(order)
    known = order[rank_of]

    def make():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            sets = shingle_sets(byte_texts(batch, text_column), width, hashes)
            tokens = []
            for s in sets:
                if len(known) and len(s):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = known[at] == s
                    s = np.concatenate([s[~often], s[often][np.argsort(rank_of[at[often]])]])
                tokens.append(s[: prefix_size(len(s), percent)].view(np.int64))
            return {id_column: values(batch, id_column), "n": [len(s) for s in sets], "fp": [fingerprint(s) for s in sets], "tokens": tokens}

        return step

    return map_rows(docs, [id_column, text_column], make, schema)


def sets_of(docs: DataFrame, nodes: DataFrame, width: int, id_column: str, text_column: str) -> DataFrame:
    """(nid, shingles) of the nodes (nid, rep, fp), computed anew from the text of a document that has the set."""
    rows = docs.select(F.col(id_column).alias("rep"), F.col(text_column).alias("text")).join(bounded_broadcast(nodes, nodes.count(), BROADCAST_ROWS), "rep")

    def make():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            sets = shingle_sets(byte_texts(batch), width, hashes)
            found = [(n, s.tobytes()) for s, n, fp in zip(sets, values(batch, "nid"), values(batch, "fp"), strict=True) if fingerprint(s) == fp]
            return {"nid": [n for n, _ in found], "shingles": [s for _, s in found]}

        return step

    return map_rows(rows, ["text", "nid", "fp"], make, schema_of("nid bigint, shingles binary"))


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return pairs.join(sets.select(F.col("nid").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("nid").alias("b"), F.col("shingles").alias("sb")), "b")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, total) of the pairs (a, b): the sizes of the sets' intersection and union."""

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            common, total = [], []
            for x, y in zip(values(batch, "sa"), values(batch, "sb"), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                common.append(both)
                total.append(len(x) + len(y) - both)
            return {"a": values(batch, "a"), "b": values(batch, "b"), "common": common, "total": total}

        return step

    return map_rows(with_sets(pairs, sets), ["a", "b", "sa", "sb"], make, schema_of("a bigint, b bigint, common bigint, total bigint"))


def delta_prefixes(common: int, size: int, pivot: int, percent: int) -> tuple[int, int]:
    """How many shingles of D(x) a partner of x shares one of: a partner that doesn't link with the pivot; any partner."""
    d = size + pivot - 2 * common
    # More than (d + s (pivot - size)) / 2 in common with a set that doesn't link with the pivot.
    least = (d * (100 + percent) + (100 - percent) * (pivot - size)) // (2 * (100 + percent)) + 1
    return d - least + 1, min(d, farthest(size, percent) + 1)


SKETCH = 256


def sketch(s: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each of SKETCH cells, as bits: two sets' sketches differ in no more bits than
    the sets differ in shingles."""
    return np.packbits((np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64)


def farthest(size: int, percent: int) -> int:
    """The greatest symmetric difference of a set of this size and one that it links with."""
    return (100 - percent) * size // percent


def relate(pairs: DataFrame, sets: DataFrame, percent: int, order: np.ndarray) -> DataFrame:
    """For pivots a and sets b: (a, b, m, n, d, linked, deep, short, tokens). m, n: sizes of a and b; d: the size of D(b); deep:
    all sets that b links with have half of their shingles or more in common with a; tokens: the first of D(b), of which
    `short` are enough where the partner doesn't link with a; null where b itself has less than half in common with a; sk: b's
    sketch. In the order of D, shingles that few sets are likely to have there come first: those of b's own that are rare,
    and those that b lacks that are frequent."""
    by_hash = np.argsort(order)
    known, rank = order[by_hash], by_hash + 1

    def often(s: np.ndarray) -> np.ndarray:
        """0 for a rare shingle, else its place among the frequent ones, the least frequent first."""
        if not len(known):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        return np.where(known[at] == s, rank[at], 0)

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("m", "n", "d", "linked", "deep", "short", "tokens", "sk")}
            for p, x in zip(values(batch, "sa"), values(batch, "sb"), strict=True):
                p, x = np.frombuffer(p, np.uint64), np.frombuffer(x, np.uint64)
                own, lacked = np.setdiff1d(x, p, assume_unique=True), np.setdiff1d(p, x, assume_unique=True)
                d, common = len(own) + len(lacked), len(x) - len(own)
                short, whole = delta_prefixes(common, len(x), len(p), percent)
                linked = common * 100 >= (len(own) + len(p)) * percent
                tokens = None
                if 3 * d <= len(x) + len(p):
                    weight = np.concatenate([often(own), len(order) + 1 - often(lacked)])
                    tokens = np.concatenate([own, lacked])[np.argsort(weight, kind="stable")][: short if linked else max(short, whole)].view(np.int64)
                deep = 300 * (d + farthest(len(x), percent)) < percent * len(x) + 100 * len(p)
                for k, v in zip(out, (len(p), len(x), d, linked, deep, short, tokens, sketch(x)), strict=True):
                    out[k].append(v)
            return {"a": values(batch, "a"), "b": values(batch, "b")} | out

        return step

    schema = schema_of("a bigint, b bigint, m bigint, n bigint, d bigint, linked boolean, deep boolean, short int, tokens array<bigint>, sk array<bigint>")
    return map_rows(with_sets(pairs, sets), ["a", "b", "sa", "sb"], make, schema)


class Corpus:
    """Documents, their distinct sets as nodes, and the tables of one computation."""

    def __init__(self, docs: DataFrame, width: int, percent: int, id_column: str, text_column: str):
        self.docs, self.width, self.percent, self.id_column, self.text_column = docs, width, percent, id_column, text_column
        self.tables = Scratch()
        self.nodes: DataFrame | None = None

    def sets(self, pairs: DataFrame, name: str) -> DataFrame:
        """The sets of the nodes a and b of pairs that were written down."""
        ends = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid"))).distinct()
        ends = self.tables(self.nodes.select("nid", "rep", "fp").join(ends, "nid", "left_semi"), f"{name}-ends")
        return self.tables(sets_of(self.docs, ends, self.width, self.id_column, self.text_column), f"{name}-sets")

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b) of nodes that link."""
        inner = self.tables.inner()
        pairs = inner.add(self.tables(pairs, f"{name}-pairs"))
        sets = inner.add(self.sets(pairs, name))
        checked = self.tables(verify(pairs, sets).filter(F.col("common") * 100 >= F.col("total") * self.percent).select("a", "b"), f"{name}-links")
        inner.drop()
        return checked


def similarity_classes(docs: DataFrame, width: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): the smallest id that a document reaches by links, itself included.

    Null text and text without words: 0 shingles, its own component. Repeated rows and equal texts come back row by row with
    one component. Columns other than the id and the text are not read.
    """
    with shuffles_dropped(docs.sparkSession):
        signed, of_class = classes_of_sets(docs, width, percent, id_column, text_column)
    return signed.join(of_class, "fp", "left").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def classes_of_sets(docs: DataFrame, width: int, percent: int, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """(id, n, fp, tokens) of the documents, and (fp, least): the smallest id of each set's class."""
    order = frequent_shingles(docs, width, text_column)
    docs = docs.select(id_column, text_column)
    corpus = Corpus(docs, width, percent, id_column, text_column)
    tables = corpus.tables
    signed = tables(signatures(docs, width, percent, order, id_column, text_column).withColumnRenamed(id_column, "id"), "signatures")
    if not signed.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").isEmpty():
        corpus.docs = docs.dropDuplicates([id_column, text_column])  # so a set is computed anew once
    nodes = signed.filter("n > 0").groupBy("fp").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    corpus.nodes = nodes = tables(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    postings = nodes.select("nid", "n", block.alias("block"), F.posexplode("tokens").alias("pos", "token"))
    shared = postings.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1")
    lists = tables(postings.join(shared, "token"), "lists")  # from here on, only shingles that two sets or more share
    pivots = lists.groupBy("token", "block").agg(F.min(F.struct("pos", "nid", "n")).alias("p"))
    stars = lists.join(pivots, ["token", "block"]).filter("nid <> p.nid").groupBy(F.col("p.nid").alias("a"), F.col("nid").alias("b")).agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("p.n").alias("m"))
    links = corpus.links(stars.filter(F.col("c") >= needed(F.col("n"), F.col("m"))).select("a", "b"), "stars")
    classes = tables(connected_components(links, "a", "b").select(F.col("node").alias("nid"), F.col("component").alias("centre")), "classes")
    links = links.unionByName(cross_links(corpus, lists, classes, order))
    linked = tables(connected_components(links, "a", "b").select(F.col("node").alias("nid"), F.col("component").alias("label")), "linked")
    named = nodes.select("fp", "nid", "rep").join(linked, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    least = named.groupBy("label").agg(F.min("rep").alias("least"))
    of_class = tables(named.join(least, "label").select("fp", "least"), "least")
    tables.drop_others(signed, of_class)
    return signed, of_class


def cross_links(corpus: Corpus, lists: DataFrame, classes: DataFrame, order: np.ndarray) -> DataFrame:
    """The links (a, b) between sets of different classes."""
    tables, percent = corpus.tables, corpus.percent
    long = F.col("c") > LONG_LIST
    in_long = lists.filter(long).groupBy("nid", "n").agg(F.count("*").alias("k"))
    # Sets as small as a partner may be need this many in common; a set with as many in long lists keeps those lists.
    in_long = in_long.select("nid", "k", (F.col("k") >= F.floor(F.col("n") * percent / 100 / SHARE) + 1).alias("hot"))
    placed = lists.select("token", "nid", "n", "pos", "c").join(classes, "nid", "left").withColumn("centre", F.coalesce("centre", "nid")).join(in_long, "nid", "left").fillna(0, ["k"]).fillna(False, ["hot"])
    placed = tables(placed.filter(~long | F.col("hot")), "placed")
    side = lambda p: placed.filter(~long).select("token", *(F.col(c).alias(p + c) for c in ("nid", "n", "pos", "k", "centre")))
    # Of two sets no more can be common than what lies before a shared shingle in both and what comes from there on.
    places = (F.least("xpos", "ypos") + F.least(F.col("xn") - F.col("xpos"), F.col("yn") - F.col("ypos"))) * (100 + percent) >= (F.col("xn") + F.col("yn")) * percent
    pairs = side("x").join(side("y"), "token").filter((F.col("xnid") < F.col("ynid")) & (F.col("xcentre") != F.col("ycentre")) & fitting(percent))
    pairs = pairs.groupBy(F.col("xnid").alias("a"), F.col("ynid").alias("b")).agg(F.count("*").alias("c"), F.min(places).alias("fits"), F.min("xn").alias("n"), F.min("yn").alias("m"), F.min("xk").alias("k"), F.min("yk").alias("j"))
    pairs = [tables(pairs.filter(F.col("fits") & (F.col("c") >= left_needed("n", "m", "k", "j"))).select("a", "b"), "short-pairs")]
    links: list[DataFrame] = []
    # Pivots by one rank for all lists, those with most of their shingles in long lists first, so that lists share pivots.
    level = placed.filter(long).select(F.col("token").alias("key"), "nid", "n", "centre", F.floor(1e6 * (1 - F.col("k") / F.col("n"))).alias("rank"), F.lit(False).alias("linked"), F.lit(True).alias("short"), F.lit(None).cast("bigint").alias("d"), F.lit(None).cast("array<bigint>").alias("sk"))
    before, last = None, LEVELS == 0
    for depth in range(LEVELS + 1):
        level, n = meet(corpus, level, depth, last, pairs)
        if not n:
            break
        # Lists of sets that have nothing but these shingles in common don't get shorter: their sketches part them.
        last = depth + 1 == LEVELS or (before is not None and n > 0.8 * before)
        before = n
        level = finer(corpus, level, depth, order, links)
    found = corpus.links(pairs[0] if len(pairs) == 1 else union(pairs).distinct(), "cross")
    return union([found, *links])


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def fitting(percent: int) -> Column:
    """Sizes xn and yn that allow a link."""
    return (F.col("xn") * 100 >= F.col("yn") * percent) & (F.col("yn") * 100 >= F.col("xn") * percent)


def meet(corpus: Corpus, level: DataFrame, depth: int, last: bool, pairs: list[DataFrame]) -> tuple[DataFrame, int]:
    """Adds to `pairs` the pairs of short lists; the rows of long ones and their number.

    In a list, the short unlinked rows meet one another, and linked rows meet unlinked ones.
    """
    tables, percent = corpus.tables, corpus.percent
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sizes = level.groupBy("key").agg(count(~F.col("linked") & F.col("short")).alias("su"), count(F.col("linked")).alias("sl"), count(~F.col("linked")).alias("u"))
    work = F.col("su") * (F.col("su") - 1) / 2 + F.col("sl") * F.col("u")
    sizes = sizes.filter(work > 0).withColumn("long", (work > (LONG_FINER if depth else LONG_LIST) * (F.col("u") + F.col("sl")) / 2) & F.lit(not last))
    rows = tables(level.join(sizes, "key").filter(F.col("short") | (F.col("sl") > 0)), "level")
    side = lambda p, rows: rows.select("key", *(F.col(c).alias(p + c) for c in ("nid", "n", "centre", "d", "sk")))
    direct = rows.filter(~F.col("long"))
    one, two = direct.filter(~F.col("linked") & F.col("short")), direct.filter(~F.col("linked"))
    # D(x) and D(y) differ in their sizes' difference at least, and the sets in as many shingles as their sketches in bits.
    room = (F.col("xn") + F.col("yn")) * (100 - percent)
    bits = sum((F.bit_count(F.col("xsk")[i].bitwiseXOR(F.col("ysk")[i])) for i in range(SKETCH // 64)), F.lit(0))
    apart = F.coalesce(F.abs(F.col("xd") - F.col("yd")) * (100 + percent) <= room, F.lit(True)) & F.coalesce(bits * (100 + percent) <= room, F.lit(True)) & (F.col("xcentre") != F.col("ycentre")) & fitting(percent)
    among = side("x", one).join(side("y", one), "key").filter((F.col("xnid") < F.col("ynid")) & apart)
    between = side("x", direct.filter("linked")).join(side("y", two), "key").filter((F.col("xnid") != F.col("ynid")) & apart)
    both = among.unionByName(between).select(F.least("xnid", "ynid").alias("a"), F.greatest("xnid", "ynid").alias("b")).distinct()
    pairs.append(tables(both, "level-pairs"))
    rest = rows.filter("long")
    return rest, rest.count()


def finer(corpus: Corpus, level: DataFrame, depth: int, order: np.ndarray, links: list[DataFrame]) -> DataFrame:
    """The lists of the next level; adds the links with pivots to `links`."""
    tables, inner = corpus.tables, corpus.tables.inner()
    pivots = level.groupBy("key").agg(F.min(F.struct("rank", "nid")).alias("p")).select("key", F.col("p.nid").alias("pivot"))
    rows = inner.add(tables(level.join(pivots, "key").filter("nid <> pivot"), "under-pivots"))
    about = inner.add(tables(rows.groupBy(F.col("pivot").alias("a"), F.col("nid").alias("b")).agg(F.min("centre").alias("centre")), "pivot-pairs"))
    sets = inner.add(corpus.sets(about, "pivot"))
    related = tables(relate(about.select("a", "b"), sets, corpus.percent, order), "related")
    links.append(related.filter("linked").select("a", "b"))
    of = related.join(about, ["a", "b"])
    near = of.filter("tokens is not null").select("a", F.col("b").alias("nid"), "n", "centre", "linked", "short", "d", "sk", F.posexplode("tokens").alias("pos", "token"))
    near = near.select(F.xxhash64("a", "token", F.lit(depth)).alias("key"), "nid", "n", "centre", F.col("d").alias("rank"), "linked", (F.col("linked") | (F.col("pos") < F.col("short"))).alias("short"), "d", "sk")
    shallow = related.filter(~F.col("deep")).select(F.col("a").alias("pivot"), F.col("b").alias("nid"), F.col("sk").alias("_sk"))
    far = rows.join(shallow, ["pivot", "nid"])
    far = far.select(F.xxhash64("key", F.lit("far"), F.lit(depth)).alias("key"), "nid", "n", "centre", "rank", F.lit(False).alias("linked"), F.lit(True).alias("short"), F.lit(None).cast("bigint").alias("d"), F.col("_sk").alias("sk"))
    out = tables(near.unionByName(far), "finer")
    inner.drop()
    return out
