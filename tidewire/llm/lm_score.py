"""Scoring by a hashed maximum-entropy language model.

P(word | history) = P(class of word | history) * P(word | its class, word before).

* Classes come from the spelling of a word's end: endings fall into buckets, and buckets whose successors are alike
  join one class. So every word, seen or not, has a class, and the class of a history tells much about its language.
* The class stage is a softmax over hashed features of the history: the last word, the last two together (n-grams), the
  second last alone (skip), the last two classes. Every training text is used once: in each round,
  partitions train by minibatch gradients from the last round's weights, and a round's weights are their mean, each row
  by the gradients that the partitions saw for it.
* The word stage is a softmax inside a class with one weight a word and one for each word and preceding class, fitted
  by gradient steps on counts of the whole corpus. Its outcomes are the most frequent words and one for the rest of the
  class; the rest are divided by their counts, with the share of unseen words that words seen once indicate.

The probabilities of all words and of an unseen word of each class add up to one, so scores compare with a baseline that
keeps one place for unseen words. Counts of all words are aggregated by Spark and never leave it: only the head of the
vocabulary (`head`, a parameter) is broadcast; counts of rarer words meet the texts in a join.

* The word before, if it is in the head, adds a weight for each pair of words to the word stage: the optimum on the pairs'
  counts under pseudo-observations of the stage without it, their number chosen by what foretells training tokens left out.
  Pairs are dealt by their first word into groups, which count, fit and score them; the DENSE most frequent first words have
  a table that is broadcast.

What grows with the corpus: the counts of all words, which decide the words' probabilities, and the pairs of words, in as many
groups as there are PAIRS tokens (2^15 at most, then groups grow). What doesn't: the hashed table of the class stage (2^16
rows) and the head of the vocabulary (2^17 words); skip features and pairs together tell classes apart, not the words of a
class, and a word outside the head is known to the next one by its class alone.

Null and empty texts: the end token alone. Repeated rows are scored one by one. Words of equal counts enter the head in
order of their bytes. Columns other than the id and the text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import arrow_type, byte_texts, materialize, schema_of, values

END = b"\n"  # no word holds it
HEAD, CLASSES, BUCKETS, FEATURE_BITS = 1 << 17, 16, 256, 16  # features fit 16 bits, which numpy sorts in linear time
FEATURES = 1 << FEATURE_BITS
ROUNDS, BATCH, RATE = 2, 8192, 0.15
SMOOTH = 0.1
#: Words whose pairs with the next word are counted by every task, as one group of pairs could not hold them.
DENSE = 32
#: Pairs of a group, and of what a task holds before it deals them.
PAIRS = 1 << 19
PRIORS = np.array([4, 16, 64, 256, 1024, 4096, 1 << 16, 1 << 24], np.float32)
#: Different words that a task counts before it sends them on.
COUNTED = 400_000


def is_training(doc_id: object) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 10 != 0


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
MARK = np.zeros(256, bool)
MARK[list(b".,;:!?\"')")] = True


def endings(words: pa.Array) -> np.ndarray:
    """The bucket of each word's spelling: its last three bytes before marks, and whether a mark follows them; the end token
    has its own."""
    n = len(words)
    bounds = np.frombuffer(words.buffers()[1], np.int32, n + 1, words.offset * 4).astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    low, high = bounds[:-1], bounds[1:].copy()
    left = np.flatnonzero(high > low)
    while len(left):
        left = left[MARK[data[high[left] - 1]]]
        high[left] -= 1
        left = left[high[left] > low[left]]
    code = (high < bounds[1:]).astype(np.uint64) << np.uint64(24)
    for k in range(1, 4):
        has = np.flatnonzero(high - k >= low)
        code[has] |= data[high[has] - k].astype(np.uint64) << np.uint64(8 * (k - 1))
    out = (1 + ((code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(BUCKETS - 1)).astype(np.int64)
    ends = np.flatnonzero(bounds[1:] - low == 1)
    out[ends[data[low[ends]] == END[0]]] = 0
    return out


def split_texts(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, the number of each text's words), as bytes.split does it after lower-casing A-Z."""
    bytes_of = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    blank = SPACE[bytes_of]
    edges = np.flatnonzero(np.diff(blank, prepend=True))
    starts, stops = edges[::2], edges[1::2]
    bounds = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(bytes_of[~blank])])
    text_ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    return words, np.diff(np.searchsorted(starts, text_ends), prepend=0)


def with_ends(codes: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes with one of `end` after each text, where each text begins, places of the words)."""
    places = np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths)
    out = np.full(len(codes) + len(lengths), end, np.int64)
    out[places] = codes
    return out, np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]), places


def parts_of(texts: list[bytes], most: int = 2 << 20) -> Iterator[slice]:
    """Stretches of texts of bounded size."""
    low = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(low, k)
            low, size = k, 0
        size += len(t) + 1
    if low < len(texts):
        yield slice(low, len(texts))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, bucket, n) over the training texts, n summed for each task's share; bucket pairs come as words that begin
    with a blank, which no word does."""
    names = ["word", "bucket", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        pairs = np.zeros(BUCKETS * BUCKETS, np.int64)

        def merge() -> pa.Table:
            out = pa.concat_tables(held).group_by(["word", "bucket"]).aggregate([("n", "sum")]).rename_columns(names).combine_chunks()
            held[:] = [out]
            return out

        def flush() -> Iterator[pa.RecordBatch]:
            yield from merge().to_batches(max_chunksize=100_000)
            held.clear()

        for batch in batches:
            texts = [t for doc, t in zip(values(batch, "doc_id"), byte_texts(batch), strict=True) if is_training(doc)]
            for part in parts_of(texts):
                words, lengths = split_texts(texts[part])
                coded = words.dictionary_encode()
                distinct = coded.dictionary
                at, end = coded.indices.to_numpy(), len(distinct)
                buckets = np.append(endings(distinct), 0)
                codes, starts, _ = with_ends(buckets[at], lengths, 0)
                both = codes[:-1] * BUCKETS + codes[1:]
                # The last token of a text and the first of the next are no pair.
                pairs += np.bincount(np.delete(both, starts[1:] - 1), minlength=len(pairs))
                word = pa.concat_arrays([distinct, pa.array([END], pa.binary())])
                n = np.append(np.bincount(at, minlength=end), len(lengths))
                held.append(pa.table([word, pa.array(buckets, pa.int32()), pa.array(n, pa.int64())], names=names))
                if sum(map(len, held)) > 2 * COUNTED and len(merge()) > COUNTED:
                    yield from flush()
        if held:
            yield from flush()
        pa.default_memory_pool().release_unused()
        seen = np.flatnonzero(pairs)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array([b" %d" % k for k in seen], pa.binary()), pa.array(np.full(len(seen), -1, np.int32)), pa.array(pairs[seen])], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema_of("word binary, bucket int, n bigint")).groupBy("word", "bucket").agg(F.sum("n").alias("n"))


def cluster(pairs: np.ndarray, weight: np.ndarray, classes: int, steps: int = 12) -> np.ndarray:
    """bucket -> class: k-means (by divergence) of the buckets' successor distributions; class 0 is the end token."""
    after = pairs + 0.01
    after /= after.sum(axis=1, keepdims=True)
    order = np.argsort(-weight[1:], kind="stable") + 1
    centres = after[order[: classes - 1]].copy()
    which = np.zeros(len(weight), np.int64)
    for _ in range(steps):
        cost = -after @ np.log(centres).T
        which = 1 + np.argmin(cost, axis=1)
        for k in range(classes - 1):
            own = np.flatnonzero(which == k + 1)
            own = own[own > 0]
            if len(own) and weight[own].sum() > 0:
                mean = (after[own] * weight[own, None]).sum(axis=0) + 1e-6
                centres[k] = mean / mean.sum()
    which[0] = 0
    return which


@dataclass
class Model:
    """What tasks need: bounded by the head's size, the classes and the hashed features, not by the corpus."""

    words: list[bytes]  # the head; word i has id i, every other word of class c the id len(words) + c
    counts: np.ndarray  # of the head
    class_of_bucket: np.ndarray
    train_tokens: int
    vocabulary: int
    weights: np.ndarray | None = None  # features x classes
    in_class: np.ndarray | None = None  # preceding class x (head + classes): log10 P(word or rest | class, preceding class)
    dense: np.ndarray | None = None  # most frequent words x (head + classes): what the word before adds to in_class

    def __post_init__(self):
        self.head = len(self.words)
        self.class_of_id = np.concatenate([self.class_of_bucket[endings(pa.array(self.words, pa.binary()))].astype(np.int64), np.arange(CLASSES)])


class Ids:
    """Texts to ids; words outside the head go to the rest of their class."""

    def __init__(self, model: Model):
        self.model, self.set = model, pa.array(model.words, pa.binary())
        self.end = model.words.index(END)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """(ids of all tokens, where each text begins, the words outside the head, their places)."""
        m = self.model
        words, lengths = split_texts(texts)
        found = pc.index_in(words, value_set=self.set)
        ids = found.fill_null(-1).to_numpy().astype(np.int64)
        at = np.flatnonzero(ids < 0)
        rare = words.take(pa.array(at))
        ids[at] = m.head + m.class_of_bucket[endings(rare)]
        out, starts, places = with_ends(ids, lengths, self.end)
        return out, starts, rare, places[at]


def shifted(codes: np.ndarray, starts: np.ndarray, by: int, fill: int) -> np.ndarray:
    """What stands `by` places before each token in its text."""
    out = np.empty_like(codes)
    out[by:] = codes[:-by]
    for k in range(by):
        at = starts + k
        at = at[at < np.append(starts[1:], len(codes))] if k else at
        out[at] = fill
    return out


def features(ids: np.ndarray, classes: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Hashed features of the history of each token of texts that begin at `starts`, one row a feature template."""
    n = len(ids)
    starts = np.zeros(1, np.int64) if starts is None else starts
    one, two = (shifted(ids, starts, k, -1).view(np.uint64) for k in (1, 2))
    kind, kind_two = (shifted(classes, starts, k, CLASSES).view(np.uint64) for k in (1, 2))
    mix = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        two_mixed = two * mix
        rows = [one * np.uint64(4), (one * mix ^ two_mixed >> np.uint64(7)) | np.uint64(1), two_mixed ^ np.uint64(2), (kind * np.uint64(64) + kind_two) * np.uint64(4) + np.uint64(3)]
        out = np.empty((len(rows), n), np.uint16)
        for k, r in enumerate(rows):
            r = (r ^ (r >> np.uint64(31))) * mix
            out[k] = r >> np.uint64(64 - FEATURE_BITS)
    return out


def logits_of(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    logits = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        logits += weights.take(r, axis=0)
    if len(logits) and np.abs(logits).max() > 60:  # exp would leave the range of its type
        logits -= logits.max(axis=1, keepdims=True)
    return logits


def row_sums(values: np.ndarray) -> np.ndarray:
    return values @ np.ones((values.shape[1], 1), values.dtype)


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    logits = logits_of(weights, rows)
    return logits - np.log(row_sums(np.exp(logits)))


def add_rows(into: np.ndarray, at: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, their sums): a sparse scatter-add by sorting."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.add.reduceat(what[order], first, axis=0)


def train_round(docs: DataFrame, model: Model, number: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean weights, counts of words by preceding class and by frequent word before) of one round over its share of the training texts."""
    import pickle

    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    rows_each = 1024  # weight rows in one output row

    def run(batches):
        m: Model = pickle.loads(shared.value)
        ids_of = Ids(m)
        weights = m.weights.copy()
        scale = np.full((FEATURES, 1), 1e-2, np.float32)
        wide = m.head + CLASSES
        counts = np.zeros((CLASSES + DENSE) * wide, np.int32)
        tokens = uncounted = 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        cells: list[np.ndarray] = []
        size = 0

        def count():
            nonlocal uncounted
            at, n = np.unique(np.concatenate(cells), return_counts=True)
            counts[at] += n.astype(np.int32)
            cells.clear()
            uncounted = 0

        def update():
            nonlocal held, size
            rows = np.concatenate([h[0] for h in held], axis=1)
            target = np.concatenate([h[1] for h in held])
            held, size = [], 0
            for low in range(0, len(target), BATCH):
                part, want = rows[:, low : low + BATCH], target[low : low + BATCH]
                grad = np.exp(logits_of(weights, part))
                grad /= row_sums(grad)
                grad[np.arange(len(want)), want] -= 1
                for r in part:
                    at, g = add_rows(weights, r, grad)
                    scale[at] += (g * g).mean(axis=1, keepdims=True)
                    weights[at] -= RATE * g / np.sqrt(scale[at])

        for batch in batches:
            texts = [t for doc, t in zip(values(batch, "doc_id"), byte_texts(batch), strict=True) if is_training(doc) and zlib.crc32(b"round" + str(doc).encode()) % rounds == number]
            for part in parts_of(texts):
                ids, starts, _, _ = ids_of(texts[part])
                kinds = m.class_of_id[ids]
                before = shifted(ids, starts, 1, ids_of.end)
                cells.append(m.class_of_id[before] * wide + ids)
                dense = np.flatnonzero(before < DENSE)
                cells.append((CLASSES + before[dense]) * wide + ids[dense])
                uncounted += len(ids)
                if uncounted > 1 << 20:
                    count()
                tokens += len(ids)
                held.append((features(ids, kinds, starts), kinds))
                size += len(ids)
                if size >= 16 * BATCH:
                    update()
        if held:
            update()
        if cells:
            count()
        if tokens:
            chunks = FEATURES // rows_each
            # A row of weights counts by the gradients that it saw: what a task has never met doesn't dilute the mean.
            sums = np.concatenate([weights * scale, scale], axis=1).astype(np.float32).reshape(chunks, -1)
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(chunks), pa.int32()), "at": pa.array([None] * chunks, pa.binary()), "what": pa.array([r.tobytes() for r in sums], pa.binary())})
            seen = np.flatnonzero(counts)
            block = 1 << 16
            for low in range(0, len(seen), 200_000):
                s = seen[low : low + 200_000]
                cuts = np.flatnonzero(np.diff(s // block)) + 1
                pieces = np.split(s, cuts)
                yield pa.RecordBatch.from_pydict({"part": pa.array([-1 - int(p[0] // block) for p in pieces], pa.int32()), "at": pa.array([(p % block).astype(np.uint16).tobytes() for p in pieces], pa.binary()), "what": pa.array([counts[p].astype(np.float32).tobytes() for p in pieces], pa.binary())})

    schema = schema_of("part int, at binary, what binary")
    out = docs.select("doc_id", "text").mapInArrow(run, schema)

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        if part >= 0:
            return pd.DataFrame({"part": [part], "at": [None], "what": [np.sum([np.frombuffer(b, np.float32) for b in frame["what"]], axis=0, dtype=np.float64).astype(np.float32).tobytes()]})
        at = np.frombuffer(b"".join(frame["at"]), np.uint16)
        n = np.bincount(at, np.frombuffer(b"".join(frame["what"]), np.float32))
        where = np.flatnonzero(n)
        return pd.DataFrame({"part": [part], "at": [where.astype(np.uint16).tobytes()], "what": [n[where].astype(np.float32).tobytes()]})

    # Each part holds 1024 rows of weights, or 65,536 cells of counts, from each task; folded by twos of levels.
    folded = out.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(16)))
    folded = folded.groupBy("part", "slot").applyInPandas(lambda k, f: combine(f), schema).groupBy("part").applyInPandas(lambda k, f: combine(f), schema)
    weights = np.zeros((FEATURES // rows_each, rows_each * (CLASSES + 1)), np.float32)
    counts = np.zeros((CLASSES + DENSE) * (model.head + CLASSES), np.float32)
    for row in materialize(folded, "lm-round").toLocalIterator():
        if row["part"] >= 0:
            weights[row["part"]] = np.frombuffer(row["what"], np.float32)
        else:
            counts[np.frombuffer(row["at"], np.uint16).astype(np.int64) + ((-1 - row["part"]) << 16)] += np.frombuffer(row["what"], np.float32)
    shared.unpersist()
    weights = weights.reshape(FEATURES, CLASSES + 1)
    return weights[:, :CLASSES] / np.maximum(weights[:, CLASSES:], 1e-9), counts.reshape(CLASSES + DENSE, -1)


def fit_in_class(counts: np.ndarray, class_of_id: np.ndarray, steps: int = 30, prior: float = 20.0) -> np.ndarray:
    """log10 P(id | class of id, preceding class) as a table; gradient steps on the counts from the corpus.

    logit = w[id] + u[preceding class, id]. w starts at the log of the smoothed counts, where its own gradient is zero;
    u is pulled to zero by `prior` pseudo-observations, so it follows the counts only where there are enough.
    """
    total = counts.sum(axis=0)
    out = np.zeros_like(counts)
    for c in range(CLASSES):
        own = np.flatnonzero(class_of_id == c)
        n = counts[:, own]
        w = np.log(total[own] + 0.5)
        u = np.zeros_like(n)
        base = np.exp(w - w.max())
        base /= base.sum()
        seen = n.sum(axis=1, keepdims=True)
        aim = n + prior * base[None, :]
        for _ in range(steps):
            logit = w[None, :] + u
            logit -= logit.max(axis=1, keepdims=True)
            p = np.exp(logit)
            p /= p.sum(axis=1, keepdims=True)
            expected = (seen + prior) * p
            u += np.clip((aim - expected) / (np.maximum(aim, expected) + 1e-9), -1, 1) * 0.7
        logit = w[None, :] + u
        logit -= logit.max(axis=1, keepdims=True)
        logit -= np.log(np.exp(logit).sum(axis=1, keepdims=True))
        out[:, own] = logit / np.log(10)
    return out


def fit_priors(n: np.ndarray, total: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Pseudo-observations of `base` for each pair's context: of PRIORS, what foretells a training token best from the others,
    for contexts of like totals. It depends on the context alone, so probabilities still add up to one."""
    band = np.frexp(total.astype(np.float32))[1] // 2
    fits = []
    for prior in PRIORS:
        p = (np.maximum(n - 1, 0) + prior * base) / (np.maximum(total - 1, 0) + prior)
        fits.append(np.bincount(band, n * np.log(p, dtype=np.float32), minlength=64))
    return PRIORS[np.argmax(fits, axis=0)][band]


def gains(n: np.ndarray, total: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """log10 of what a weight for the word before and the word adds; n: of the pair, total: of the word before and the class.

    One weight a pair is a saturated softmax, whose optimum under pseudo-observations is known without steps."""
    n, total, base = n.astype(np.float32), total.astype(np.float32), np.power(10, inside, dtype=np.float32)
    base = np.maximum(base, np.float32(1e-30))
    prior = fit_priors(n, total, base)
    return np.log10((n + prior * base) / (total + prior)) - np.log10(base)


def fit_dense(counts: np.ndarray, model: Model) -> np.ndarray:
    """The gains of the words after the most frequent words, by the counts of all training texts."""
    out = np.zeros((DENSE, model.head + CLASSES), np.float32)
    for p in range(min(DENSE, model.head)):
        total = np.bincount(model.class_of_id, counts[p], minlength=CLASSES)
        out[p] = gains(counts[p], total[model.class_of_id], model.in_class[model.class_of_id[p]])
    return out


def name_of(doc: object, text: bytes) -> bytes:
    """A text's name in two plans over the same rows, which may come in another order."""
    return hashlib.blake2b(str(doc).encode() + b" " + text, digest_size=16).digest()


def two_longs(names: bytes) -> np.ndarray:
    return np.frombuffer(names, np.int64).reshape(-1, 2)


def pair_gains(docs: DataFrame, model: Model, tokens: int) -> DataFrame:
    """(name_a, name_b, gain): what pairs of words add to the score of each text, frequent first words aside, which `dense` has.

    Pairs are dealt by their first word into as many groups as the corpus asks for, each with all tokens after its words; a
    group counts its pairs, fits them and scores its tokens. A row holds the pairs of many texts in packed arrays."""
    import pickle

    # Tasks of pairs need no weights of the class stage, so they don't hold them.
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(replace(model, weights=None, dense=None)))
    groups = int(min(1 << 15, 1 + tokens // PAIRS))
    wide = model.head + CLASSES
    read: list[Model] = []  # filled by each worker

    def deal(batches):
        from pyspark import TaskContext

        m: Model = pickle.loads(shared.value)
        ids_of = Ids(m)
        number = 0
        pairs: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        names: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            block = b"%d %d" % (TaskContext.get().partitionId(), number)
            key, owner = np.concatenate(pairs), np.concatenate(owners)
            group = ((key // wide).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(groups)
            group = group.astype(np.uint16)
            order = np.argsort(group, kind="stable")
            key, owner, group = key[order], owner[order], group[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)
            rows = [(int(group[a]), key[a:b].astype(np.uint32).tobytes(), (key[a:b] >> 32).astype(np.uint8).tobytes(), owner[a:b].tobytes(), None) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            rows.append((number % groups, None, None, None, b"".join(names)))
            number, size = number + 1, 0
            for held in (pairs, owners, names):
                held.clear()
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array([block] * len(rows), pa.binary()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["pairs", "block", "low", "high", "owner", "names"])

        for batch in batches:
            ids_here, texts = values(batch, "doc_id"), byte_texts(batch)
            for part in parts_of(texts):
                ids, starts, _, _ = ids_of(texts[part])
                before = shifted(ids, starts, 1, ids_of.end)
                at = np.flatnonzero((before >= DENSE) & (before < m.head))
                training = np.array([is_training(d) for d in ids_here[part]], bool)
                if len(names) + len(training) > 1 << 15:
                    yield flush()
                owner = ((len(names) + np.arange(len(training))) * 2 + training).astype(np.uint16)
                owners.append(np.repeat(owner, np.diff(np.append(starts, len(ids))))[at])
                pairs.append(before[at] * wide + ids[at])
                names += map(name_of, ids_here[part], texts[part])
                size += len(at)
                if size > PAIRS:
                    yield flush()
        if names:
            yield flush()

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        passed = frame[frame["names"].notna()][["block", "names"]].assign(owner=None, gain=None)
        frame = frame[frame["names"].isna()]
        if not len(frame):
            return passed[["block", "owner", "gain", "names"]]
        if not read:
            read.append(pickle.loads(shared.value))
        m: Model = read[0]
        key = np.frombuffer(b"".join(frame["low"]), np.uint32).astype(np.int64)
        key |= np.frombuffer(b"".join(frame["high"]), np.uint8).astype(np.int64) << 32
        owner = np.frombuffer(b"".join(frame["owner"]), np.uint16)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.add.reduceat((owner[order] & 1).astype(np.int64), first)
        word, before = key[first] % wide, key[first] // wide
        context = np.cumsum(np.diff(before, prepend=before[0]) != 0)  # the keys are in order
        context = context * CLASSES + m.class_of_id[word]
        total = np.bincount(context, n)[context]
        gain = gains(n, total, m.in_class[m.class_of_id[before], word])
        each = np.empty(len(key), np.float32)
        each[order] = np.repeat(gain, np.diff(np.append(first, len(key))))
        row = np.repeat(np.arange(len(frame)), frame["owner"].map(len) // 2)
        text = row << 16 | owner
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        sums = np.add.reduceat(each, first, dtype=np.float64).astype(np.float32)
        cuts = np.searchsorted(row[first], np.arange(1, len(frame)))
        out = pd.DataFrame({"block": frame["block"], "owner": [o.tobytes() for o in np.split(owner[first], cuts)], "gain": [g.tobytes() for g in np.split(sums, cuts)], "names": None})
        return pd.concat([out, passed[["block", "owner", "gain", "names"]].astype(object)]) if len(passed) else out

    def collect(frame: pd.DataFrame) -> pd.DataFrame:
        names = next(b for b in frame["names"] if b is not None)
        frame = frame[frame["owner"].notna()]
        owner = np.frombuffer(b"".join(frame["owner"]), np.uint16) >> 1
        sums = np.bincount(owner, np.frombuffer(b"".join(frame["gain"]), np.float32), minlength=len(names) // 16)
        return pd.DataFrame({"name_a": two_longs(names)[:, 0], "name_b": two_longs(names)[:, 1], "gain": sums})

    dealt = docs.select("doc_id", "text").mapInArrow(deal, schema_of("pairs int, block binary, low binary, high binary, owner binary, names binary"))
    scored = dealt.groupBy("pairs").applyInPandas(score, schema_of("block binary, owner binary, gain binary, names binary"))
    gained = scored.groupBy("block").applyInPandas(collect, schema_of("name_a bigint, name_b bigint, gain double")).groupBy("name_a", "name_b").agg(F.max("gain").alias("gain"))
    gained = materialize(gained, "lm-gains")  # before the texts' scores, so tasks of both don't share an executor's memory
    shared.unpersist()
    return gained


SCORES = "uid bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, model double, word binary, times bigint, cls int, name_a bigint, name_b bigint"


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """A row a text with what the head gives, and a row for each rarer word in it; uid names the text within this plan."""
    import pickle

    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = schema_of(SCORES)

    def run(batches):
        from pyspark import TaskContext

        m: Model = pickle.loads(shared.value)
        ids_of = Ids(m)
        uid = TaskContext.get().partitionId() << 40
        bottom = m.train_tokens + SMOOTH * (m.vocabulary + 1)
        base_of = np.concatenate([np.log10((m.counts + SMOOTH) / bottom), np.zeros(CLASSES)])
        known_of = np.concatenate([m.counts > 0, np.zeros(CLASSES, bool)])
        names = [f.name for f in schema]
        types = [arrow_type(f.dataType) for f in schema]

        def rows(n: int, **given) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names=names)

        for batch in batches:
            ids_here, texts = values(batch, "doc_id"), byte_texts(batch)
            for part in parts_of(texts):
                ids, starts, rare, at = ids_of(texts[part])
                kinds = m.class_of_id[ids]
                model = np.empty(len(ids))
                hashed = features(ids, kinds, starts)
                for low in range(0, len(ids), BATCH):
                    k = kinds[low : low + BATCH]
                    logits = logits_of(m.weights, hashed[:, low : low + BATCH])
                    model[low : low + BATCH] = logits[np.arange(len(k)), k] - np.log(row_sums(np.exp(logits))[:, 0])
                model /= np.log(10)
                before = shifted(ids, starts, 1, ids_of.end)
                model += m.in_class[m.class_of_id[before], ids]
                dense = np.flatnonzero(before < DENSE)
                model[dense] += m.dense[before[dense], ids[dense]]
                n = len(starts)
                docs_here = ids_here[part]
                names_here = two_longs(b"".join(map(name_of, docs_here, texts[part])))
                uids = uid + np.arange(n)
                owner = np.repeat(np.arange(n), np.diff(np.append(starts, len(ids))))[at]
                yield rows(
                    n, uid=uids, doc_id=docs_here, held_out=[not is_training(d) for d in docs_here], n_tokens=np.diff(np.append(starts, len(ids))),
                    known=np.add.reduceat(known_of[ids].astype(np.int64), starts), base=np.add.reduceat(base_of[ids], starts), model=np.add.reduceat(model, starts),
                    word=[b" %d" % k for k in uids], times=np.zeros(n, np.int64), cls=np.full(n, -1, np.int32), name_a=names_here[:, 0], name_b=names_here[:, 1],
                )
                if len(at):
                    yield rows(len(at), uid=uids[owner], word=rare, times=np.ones(len(at), np.int64), cls=(ids[at] - m.head).astype(np.int32))
                uid += n

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def lm_scores(docs: DataFrame, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text; log10."""
    from tidewire.llm.common import small_batches

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    small_batches(docs.sparkSession)
    counted = materialize(count_words(docs), "lm-counts")
    words = counted.filter("bucket >= 0")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    pairs = np.zeros(BUCKETS * BUCKETS)
    for row in counted.filter("bucket < 0").select(F.col("word").cast("string").alias("k"), "n").toLocalIterator():  # at most BUCKETS squared
        pairs[int(row["k"])] = row["n"]
    pairs = pairs.reshape(BUCKETS, BUCKETS)
    class_of_bucket = cluster(pairs, pairs.sum(axis=0) + pairs.sum(axis=1), CLASSES)
    top = words.orderBy(F.desc("n"), "word").limit(head).select("word", "n").toArrow()
    head_words, times = top["word"].to_pylist(), top["n"].to_numpy().astype(float)
    floor = (head_words[-1], int(times[-1])) if len(head_words) == head else None
    if END not in head_words:
        head_words, times = [END, *head_words[: head - 1]], np.append(0, times[: head - 1])
    model = Model(head_words, times, class_of_bucket, n, v, np.zeros((FEATURES, CLASSES), np.float32))
    del top
    counts = np.zeros((CLASSES + DENSE, model.head + CLASSES), np.float32)
    for k in range(rounds):
        weights, seen = train_round(docs, model, k, rounds)
        if seen.sum():
            model.weights = weights
            counts += seen
        del weights, seen
    model.in_class = fit_in_class(counts[:CLASSES].astype(float), model.class_of_id).astype(np.float32)
    model.dense = fit_dense(counts[CLASSES:], model)
    # What is left of each class after the head, and how much of it words seen once foretell for unseen words.
    spark = docs.sparkSession
    classes = spark.createDataFrame([(b, int(c)) for b, c in enumerate(class_of_bucket)], "bucket int, cls int")
    tail = words if floor is None else words.filter((F.col("n") < floor[1]) | ((F.col("n") == floor[1]) & (F.col("word") > F.lit(bytes(floor[0])))))
    if floor is None:
        tail = words.limit(0)
    rest = tail.join(F.broadcast(classes), "bucket").groupBy("cls").agg(F.sum("n").alias("rest_n"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"), F.count("*").alias("rest_v"))
    off = F.greatest(F.lit(0.05), F.least(F.lit(0.95), (F.col("once") + 1) / (F.col("once") + 2 * F.col("twice") + 2)))
    rest = F.broadcast(rest.select("cls", "rest_n", "rest_v", off.alias("off")))
    gained = pair_gains(docs, model, n)
    scored = score_texts(docs, model)
    # The head's words are never looked up here, so no key of this join is a frequent word.
    joined = scored.join(words.select("word", F.col("n").alias("c")), "word", "left").join(rest, "cls", "left")
    bottom = n + SMOOTH * (v + 1)
    times = F.col("times")
    base = F.when(F.col("cls") >= 0, times * F.log10((F.coalesce("c", F.lit(0)) + F.lit(SMOOTH)) / F.lit(float(bottom))))
    # An unseen word of a class whose words are all in the head has the class's rest to itself.
    share = F.when(F.col("rest_n").isNull(), F.lit(1.0)).when(F.col("c").isNull(), F.col("off") * F.col("rest_v") / F.col("rest_n")).otherwise((F.col("c") - F.col("off")) / F.col("rest_n"))
    inside = F.when(F.col("cls") >= 0, times * F.log10(share))
    out = joined.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("known") + F.coalesce(F.sum(F.when((F.col("cls") >= 0) & F.col("c").isNotNull(), times)), F.lit(0))).alias("n_known"),
        (F.max("base") + F.coalesce(F.sum(base), F.lit(0.0))).alias("base_score"),
        (F.max("model") + F.coalesce(F.sum(inside), F.lit(0.0))).alias("score"), F.max("name_a").alias("name_a"), F.max("name_b").alias("name_b"),
    )
    out = out.join(gained, ["name_a", "name_b"], "left").withColumn("score", F.col("score") + F.coalesce("gain", F.lit(0.0)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
