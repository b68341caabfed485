"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger holds the measurements and one failure bit a rule. Policies
are versioned masks over these bits, so another policy or an ablation reads the ledger and not the texts.

Null or empty text: no words, so the word-count rule fails. Repeated rows are judged one by one. An empty table gives an
empty ledger. Columns other than those asked for are carried by the caller, not read here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import byte_texts, map_rows, schema_of, values

#: A letter of ASCII, or any character beyond it.
LETTER = re.compile(rb"[A-Za-z\x80-\xff]").search
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_alpha_words", "n_upper", "n_letters")
#: Rule -> the bit that its failure sets. Bits are never given anew: a policy of an old version keeps its meaning.
BITS = {"few_words": 0, "repeated_windows": 1, "symbols": 2, "dup_lines": 3, "word_length": 4, "alpha_words": 5, "shouting": 6, "many_words": 7}


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules; a document passes if none of them failed."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BITS[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STRICT = Policy("strict", 2, ("few_words", "repeated_windows", "symbols", "dup_lines", "word_length", "alpha_words", "shouting"))


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    words = text.split()  # bytes.split() parts at \x20 and \x09-\x0D only
    joined = b"".join(words)
    flat = np.frombuffer(joined, np.uint8)
    chars = len(joined) - int(np.count_nonzero((flat & 0xC0) == 0x80))
    symbols = len(joined) - len(joined.translate(None, b"#*$%&|<>"))
    seen: set[bytes] = set()
    lines = again = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            again += line in seen
            seen.add(line)
    upper = int(np.count_nonzero((flat >= 65) & (flat <= 90)))
    lower = int(np.count_nonzero((flat >= 97) & (flat <= 122)))
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    alpha = np.fromiter((LETTER(w) is not None for w in ids), bool, len(ids))
    return len(words), chars, symbols, lines, again, repeat_words(codes, len(ids)), int(alpha[codes].sum()), upper, upper + lower


def repeat_words(codes: np.ndarray, distinct: int) -> int:
    """Words that lie in a 3-word window which the text holds twice or more."""
    if len(codes) < 3:
        return 0
    pair = codes[:-1] * distinct + codes[1:]
    if distinct >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * distinct + codes[2:]
    order = np.sort(window)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(window, np.unique(twice))
    cover = np.zeros(len(codes), bool)
    for k in range(3):
        cover[k : k + len(hit)] |= hit
    return int(cover.sum())


def rules() -> dict[str, Column]:
    """Rule -> the Column that is true where it fails; integers only, so every engine agrees."""
    c = F.col
    return {
        "few_words": c("n_words") < 50,
        "repeated_windows": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 100 * c("n_symbols") > 10 * c("n_words"),
        "dup_lines": 100 * c("n_dup_lines") > 50 * c("n_lines"),
        "word_length": (10 * c("word_chars") < 20 * c("n_words")) | (10 * c("word_chars") > 120 * c("n_words")),
        "alpha_words": 100 * c("n_alpha_words") < 70 * c("n_words"),
        "shouting": 100 * c("n_upper") > 50 * c("n_letters"),
        "many_words": c("n_words") > 1_000_000,
    }


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, `keep` columns, measurements, fail_bits) of every document; one pass, no shuffle."""
    names = [id_column, *keep]
    fields = [docs.schema[n] for n in names]

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            found = [measure(t) for t in byte_texts(batch, text_column)]
            return {n: values(batch, n) for n in names} | {m: [f[i] for f in found] for i, m in enumerate(MEASURES)}

        return step

    schema = T.StructType([*fields, *schema_of(", ".join(f"{m} bigint" for m in MEASURES))])
    out = map_rows(docs, dict.fromkeys([*names, text_column]), make, schema)
    bits = sum((F.when(failed, F.lit(1 << BITS[rule])).otherwise(F.lit(0)) for rule, failed in rules().items()), F.lit(0))
    return out.withColumn("fail_bits", bits.cast("bigint"))


def passes(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(ledger_df: DataFrame, policy: Policy) -> DataFrame:
    """A row a rule: documents that fail it, that only it rejects, and that the policy without it keeps; one aggregation."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    sums = [F.count("*").alias("n_docs"), F.count_if(failed == 0).alias("n_kept"), F.bit_or(failed).alias("any_bits"), F.bit_and(failed).alias("all_bits")]
    for rule in policy.rules:
        bit = 1 << BITS[rule]
        sums += [F.count_if(failed.bitwiseAND(F.lit(bit)) != 0).alias(f"fail_{rule}"), F.count_if(failed == bit).alias(f"only_{rule}")]
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).cast("bigint").alias("bit"), F.col(f"fail_{r}").alias("n_fail"), F.col(f"only_{r}").alias("n_only")) for r in policy.rules])
    return ledger_df.agg(*sums).select(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "n_docs", "n_kept", F.explode(rows).alias("r")).select("policy", "version", "n_docs", "n_kept", "r.*", (F.col("n_kept") + F.col("r.n_only")).alias("n_kept_without"))


def filter_documents(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The documents that pass, with their own columns. The text is carried through the measuring pass, so no join is needed."""
    own = docs.columns
    made = {c: f"__own_{i}" for i, c in enumerate(own)}
    packed = docs.select(*[F.col(f"`{c}`").alias(made[c]) for c in own])
    marked = ledger(packed, made["doc_id"], made["text"], tuple(made[c] for c in own if c != "doc_id"))
    return marked.filter(passes(policy)).select(*[F.col(made[c]).alias(c) for c in own])
