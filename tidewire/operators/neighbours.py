"""Near duplicates by SimHash, nearest neighbours, and clustering of articles into events."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.tables import written


def block_keys(hash_column: str, most: int) -> Column:
    """array<struct<choice, key>>: of most + 3 parts of a hash every choice of three, as one key each.

    Hashes at most `most` bits apart differ in `most` parts at most, so three parts are equal: one choice has equal keys.
    """
    parts = most + 3
    edge = [64 * i // parts for i in range(parts + 1)]
    part = [F.shiftrightunsigned(F.col(hash_column), edge[i]).bitwiseAND(F.lit((1 << (edge[i + 1] - edge[i])) - 1)) for i in range(parts)]
    return F.array(*[F.struct(F.lit(n).alias("choice"), F.xxhash64(*[part[i] for i in c]).alias("key")) for n, c in enumerate(combinations(range(parts), 3))])


def near_duplicates(hashes: DataFrame, most: int = 3) -> DataFrame:
    """(a, b, distance) of rows (id, simhash) at most `most` bits apart, a < b.

    An equi-join over choices of three parts of the hash, some 32 bits for most = 3, loses none. Equal hashes meet as
    one row, so a group of copies isn't paired all with all: its members are linked to their first. Rows without a hash
    have no pairs.
    """
    hashes = written(hashes.filter("simhash is not null").select("id", "simhash"), "hashes")
    groups = hashes.groupBy("simhash").agg(F.min("id").alias("first"))
    # Sizes are guessed from the written file, which is smaller by far than its rows' keys in memory: no side is broadcast.
    copies = hashes.join(groups.hint("merge"), "simhash").filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"))
    keyed = groups.select("first", "simhash", F.explode(block_keys("simhash", most)).alias("x")).select("first", "simhash", "x.choice", "x.key")
    other = keyed.select(F.col("first").alias("b"), F.col("simhash").alias("h"), "choice", "key")
    near = (F.col("first") < F.col("b")) & (text.hamming(F.col("simhash"), F.col("h")) <= most)
    pairs = keyed.join(other.hint("merge"), ["choice", "key"]).filter(near).select(F.col("first").alias("a"), "b", text.hamming(F.col("simhash"), F.col("h")).alias("distance")).distinct()
    return pairs.unionByName(copies)


def duplicate_of(query: DataFrame, recent: DataFrame, most: int = 3, window: int = 500) -> DataFrame:
    """For each query (id, simhash) the ids among the last `window` articles within `most` bits, nearest first, newer first."""
    last = F.broadcast(recent.filter("simhash is not null").orderBy(F.desc("id")).limit(window).select(F.col("id").alias("other"), F.col("simhash").alias("h")))
    pairs = query.join(last, F.col("id") != F.col("other")).withColumn("distance", text.hamming(F.col("simhash"), F.col("h"))).filter(F.col("distance") <= most)
    return pairs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", (-F.col("other")).alias("o")))).alias("x")).select("id", F.transform("x", lambda s: -s["o"]).alias("duplicates"), F.element_at("x", 1)["distance"].alias("hamming_distance"))


#: Bytes of centroids that one pass over the articles takes.
PASS_BYTES = 64 << 20


def nearest_event(articles: DataFrame, events: DataFrame, threshold: float = 0.82, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(id, event_id, similarity) of each article's nearest centroid, if near enough; ties take the smaller event.

    Every article meets every centroid, as matrix products. Centroids go to the tasks in blocks of `pass_bytes`, one pass
    over the articles a block, and the best of all passes stays: the same results at every size. Vectors of another
    length than the first centroid's, and zero vectors, have similarity 0.
    """
    a = articles.filter("embedding is not null").select("id", "embedding")
    c = events.filter("centroid is not null").select("event_id", "centroid")
    size = c.agg(F.count("*").alias("n"), F.max(F.size("centroid")).alias("dim")).first()
    dim = size["dim"] or 1
    per_pass = max(1, pass_bytes // (8 * dim))
    passes = max(1, -(-size["n"] // per_pass))
    if passes > 1:
        c = written(c, "centroids")
    best = None
    for k in range(passes):
        block = c if passes == 1 else c.filter(F.pmod(F.xxhash64("event_id"), F.lit(passes)) == k)
        rows = [r for r in block.orderBy("event_id").collect() if len(r["centroid"]) == dim]  # about pass_bytes
        matrix = np.array([r["centroid"] for r in rows], np.float64).reshape(len(rows), dim)
        length = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix, ids = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0), np.array([r["event_id"] for r in rows], np.int64)
        found = nearest_of(a, ids, matrix)
        best = found if best is None else best.unionByName(found)
    if passes > 1:
        best = best.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("event_id")).alias("e"))).alias("x")).select("id", (-F.col("x.e")).alias("event_id"), F.col("x.similarity").alias("similarity"))
    return best.withColumn("event_id", F.col("event_id").cast(events.schema["event_id"].dataType)).filter(F.col("similarity") >= threshold)


def nearest_of(articles: DataFrame, ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """(id, event_id, similarity): the nearest row of a matrix of unit vectors for each article."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dim = matrix.shape[1]
        for f in frames:
            fits = f["embedding"].map(len) == dim
            x = np.zeros((len(f), dim))
            if fits.any():
                x[fits.to_numpy()] = np.stack(f["embedding"][fits].to_list())
            length = np.linalg.norm(x, axis=1, keepdims=True)
            s = np.divide(x, length, out=np.zeros_like(x), where=length > 0) @ matrix.T
            if len(ids):
                at = np.argmax(s, axis=1)
                yield pd.DataFrame({"id": f["id"], "event_id": ids[at], "similarity": s[np.arange(len(f)), at]})

    return articles.mapInPandas(run, f"id {articles.schema['id'].dataType.simpleString()}, event_id bigint, similarity double")


def leader_clusters(articles: DataFrame, threshold: float = 0.82) -> DataFrame:
    """(id, event_id, similarity, is_seed): each article, in order of id, joins the nearest running mean or seeds an event.

    Each step depends on all before it: the means move with every article. So this is one task by its nature, as exact
    parity; nearest_event() with fixed centroids is what scales, and add_to_events() the step on stored events.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", ignore_index=True)
        vectors_ = np.stack(frame["embedding"].to_list()).astype(float) if len(frame) else np.zeros((0, 1))
        n = len(frame)
        mean, count, ids = np.zeros_like(vectors_), np.zeros(n), np.zeros(n, np.int64)
        k = 0
        event, sim, seed = np.zeros(n, np.int64), np.ones(n), np.zeros(n, bool)
        for i, v in enumerate(vectors_):
            length = np.linalg.norm(v)
            s = mean[:k] @ v / np.maximum(np.linalg.norm(mean[:k], axis=1) * length, 1e-300) if k and length else np.zeros(0)
            j = int(np.argmax(s)) if len(s) else -1
            if j >= 0 and s[j] >= threshold:
                mean[j] = (mean[j] * count[j] + v) / (count[j] + 1)
                count[j] += 1
                event[i], sim[i] = ids[j], s[j]
            else:
                mean[k], count[k], ids[k] = v, 1, frame["id"].iloc[i]
                event[i], seed[i] = ids[k], True
                k += 1
        return pd.DataFrame({"id": frame["id"], "event_id": event, "similarity": sim, "is_seed": seed})

    rows = articles.filter("embedding is not null").select("id", "embedding", F.lit(0).alias("all"))
    return rows.groupBy("all").applyInPandas(run, "id bigint, event_id bigint, similarity double, is_seed boolean")


def centroids(members: DataFrame) -> DataFrame:
    """(event_id, n, centroid) of rows (event_id, embedding): the mean of each dimension, by partial aggregation."""
    each = members.select("event_id", F.posexplode("embedding").alias("k", "x"))
    means = each.groupBy("event_id", "k").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return means.groupBy("event_id").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"].cast("float")).alias("centroid"))


def add_to_events(events: DataFrame, assigned: DataFrame) -> DataFrame:
    """events (event_id, n, centroid) after the articles (event_id, embedding) of one batch joined them: running means."""
    new = centroids(assigned).select("event_id", F.col("n").alias("k"), F.col("centroid").alias("c"))
    both = events.withColumnRenamed("n", "_n").join(new, "event_id", "full_outer")
    n, k = F.coalesce("_n", F.lit(0)), F.coalesce("k", F.lit(0))
    mean = F.zip_with("centroid", "c", lambda x, y: ((x * n + y * k) / (n + k)).cast("float"))
    return both.select("event_id", (n + k).alias("n"), F.when(F.col("centroid").isNull(), F.col("c")).when(F.col("c").isNull(), F.col("centroid")).otherwise(mean).alias("centroid"))
