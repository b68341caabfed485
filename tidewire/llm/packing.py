"""Best-fit packing under several capacities.

A document is its token ids and then one end id; only documents longer than a sequence are cut. A sequence has three
capacities: tokens, documents and attention cost (the sum of squared lengths). Pieces are taken by falling length; each
goes to the open sequence that can hold it under every capacity and scores best: least weighted norm of what is left
(`norm`), or greatest weighted dot product of piece and residual (`dot`).

By default the cost capacity is that of one full piece, the least that lets every piece in; tokens are then what binds.
A smaller one bounds the attention work of a sequence, and pieces over it get sequences of their own.

Packing runs in groups of a bounded number of pieces, dealt by hash, so a task's memory and time don't grow with the
input. Sequences that a group leaves less than full are opened again and their pieces are packed anew in groups of
their own, up to REPACK times, so what the division costs is a part of one sequence in thousands. Every piece comes out
once: what is not packed again stays as it was packed.

Null or empty text: the end id alone. Repeated rows are packed one by one. Ties: the sequence opened first. Columns other
than the id and the text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import byte_texts, map_rows, materialize, schema_of, values

CAPACITY, END_ID = 4096, 1
#: Pieces that one packing task takes.
GROUP = 6000
#: A sequence with more of its tokens free than this is packed again, at most REPACK times.
OPEN_SHARE, REPACK = 0.02, 3
#: Words that a Python worker remembers, and the longest it does.
CACHE_WORDS, CACHE_BYTES = 1_200_000, 48

_tokenizers: dict[str, tuple] = {}


def word_encoder(path: str) -> Callable[[list[bytes]], list[bytes]]:
    """texts -> their ids as little-endian unsigned 32-bit numbers.

    The vocabulary's rules never join characters across white space (NFC doesn't compose over it and the pre-tokenizer
    drops it), so a text's ids are those of its words one after another, and the ids of a word are computed once.
    """
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = (Tokenizer.from_file(path), {})
    tokenizer, cache = _tokenizers[path]

    def encode(texts: list[bytes]) -> list[bytes]:
        # The vocabulary lower-cases words, but for its special tokens: "The" and "the" are one entry.
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(cache) > CACHE_WORDS:
            cache.clear()
        missing = list({w for words in split for w in words if w not in cache})
        long: list[bytes] = []
        for i in range(0, len(missing), 4096):
            part = missing[i : i + 4096]
            # All as one text, a word a line; a token belongs to the line in which it begins.
            lines = [w.decode("utf-8", "replace") for w in part]
            made = tokenizer.encode("\n".join(lines), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
            begins = np.fromiter((o[0] for o in made.offsets), np.int64, len(made.ids))
            raw, low = np.array(made.ids, "<u4").tobytes(), 0
            for word, high in zip(part, (4 * np.searchsorted(begins, ends)).tolist(), strict=True):
                cache[word] = raw[low:high]
                low = high
                if len(word) > CACHE_BYTES:
                    long.append(word)
        get = cache.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for word in long:
            del cache[word]
        return out

    return encode


PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every piece of every document."""
    extra = [T.StructField("ids", T.BinaryType())] if with_ids else []
    schema = T.StructType([docs.schema[id_column], *schema_of(PIECE), *extra])
    end = np.array([end_id], "<u4").tobytes()

    def make():
        encode = word_encoder(tokenizer_path)

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {f.name: [] for f in schema}
            texts = byte_texts(batch, text_column)
            ids_of = values(batch, id_column)
            for low in range(0, len(texts), 128):
                for doc, ids in zip(ids_of[low : low + 128], encode(texts[low : low + 128]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        row = (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part)
                        for f, v in zip(schema, row, strict=False):
                            out[f.name].append(v)
            return out

        return step

    return map_rows(docs, [id_column, text_column], make, schema)


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: int, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Every capacity holds for every bin; a piece over a capacity by itself has its own bin."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    whole = np.array([capacity, max_docs, max_cost], float)
    w = np.array(weights)
    left = np.zeros((n, 3))  # residuals of the open bins, in the first `m` rows
    ids = np.zeros(n, np.int64)
    m = made = 0
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if n else 0
    for i in order:
        size = float(lengths[i])
        need = np.array([size, 1.0, size * size])
        after = (left[:m] - need) / whole
        fits = (after >= 0).all(axis=1) if m else np.zeros(0, bool)
        if fits.any():
            score = (after * after) @ w if rule == "norm" else -((left[:m] / whole) @ (w * need / whole))
            score[~fits] = np.inf
            k = int(np.argmin(score))
        else:
            k, m = m, m + 1
            left[k], ids[k] = whole, made
            made += 1
        bins[i], offsets[i] = ids[k], capacity - left[k, 0]
        left[k] -= need
        if left[k, 0] < least or left[k, 1] < 1 or left[k, 2] < least * least:  # nothing goes in any more
            m -= 1
            left[k], ids[k] = left[m], ids[m]
    return bins, offsets


def pack_groups(rows: DataFrame, n: int, salt: int, capacity: int, max_docs: int, max_cost: int, rule: str) -> DataFrame:
    """rows with group, bin, offset and free (tokens left in the bin)."""
    groups = max(1, round(n / GROUP))
    schema = T.StructType([*rows.schema, *schema_of("grp bigint, bin bigint, offset bigint, free bigint")])
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(groups)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        lengths = frame["length"].to_numpy(np.int64)
        b, o = best_fit(lengths, capacity, max_docs, max_cost, rule=rule)
        free = capacity - np.bincount(b, lengths).astype(np.int64)
        return frame.assign(bin=b, offset=o, free=free[b])[schema.names]

    return dealt.groupBy("grp").applyInPandas(run, schema)


def pack(parts: DataFrame, capacity: int = CAPACITY, max_docs: int = 1024, max_cost: int | None = None, rule: str = "norm") -> DataFrame:
    """parts (with `length`) plus sequence_id and offset. max_cost None: the cost of one full piece, the least that packs all."""
    max_cost = capacity * capacity if max_cost is None else max_cost
    own = parts.columns
    rows = materialize(parts.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    n = rows.filter(F.col("length") < capacity).count()
    full = rows.filter(F.col("length") >= capacity).select(*own, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    level, out, salt = rows.filter(F.col("length") < capacity), full, 0
    while True:
        packed = materialize(pack_groups(level, n, salt, capacity, max_docs, max_cost, rule), "packed")
        again = packed.filter(F.col("free") > int(capacity * OPEN_SHARE))
        rest = again.count() if n > GROUP and salt < REPACK else 0
        if rest >= n:  # not one sequence is full: packing the same pieces again gains nothing, so they stay as they are
            rest = 0
        done = packed if not rest else packed.filter(F.col("free") <= int(capacity * OPEN_SHARE))
        sequence = F.lit(salt << 60) + F.col("grp") * (1 << 32) + F.col("bin")
        out = out.unionByName(done.select(*own, sequence.cast("bigint").alias("sequence_id"), "offset"))
        if not rest:
            break
        level, n, salt = again.select(*rows.columns), rest, salt + 1
    return out
