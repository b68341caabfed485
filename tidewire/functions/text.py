"""Text functions: Catalyst expressions where they suffice, Arrow functions where Unicode needs Python."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"\w+")


def normalize_text(text: str | None) -> str:
    """NFKC, lower case, white space collapsed."""
    return " ".join(unicodedata.normalize("NFKC", text or "").lower().split())


def simhash_of(text: str | None, hasher=lambda t: int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "big")) -> int:
    """64-bit SimHash of the word tokens as a signed number; 0 without tokens."""
    votes = [0] * 64
    found = WORD.findall(normalize_text(text))
    for t in found:
        h = hasher(t.encode())
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    value = sum(1 << b for b in range(64) if votes[b] > 0)
    return value - (1 << 64) if value >> 63 else value


FNV_BASIS, FNV_PRIME = 14695981039346656037, 1099511628211


def fnv1a(token: bytes, basis: int = FNV_BASIS) -> int:
    h = basis
    for b in token:
        h = (h ^ b) * FNV_PRIME & (1 << 64) - 1
    return h


@F.pandas_udf(T.StringType())
def normalize(text: pd.Series) -> pd.Series:
    return text.map(normalize_text)


@F.pandas_udf(T.LongType())
def simhash64(text: pd.Series) -> pd.Series:
    """Votes of all tokens of a text at once, in numpy; tokens are hashed once a batch."""
    import numpy as np

    known: dict[str, int] = {}
    out = []
    for t in text:
        found = WORD.findall(normalize_text(t))
        if not found:
            out.append(0)
            continue
        for w in found:
            if w not in known:
                known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        bits = np.unpackbits(np.array([known[w] for w in found], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits = np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(found), bitorder="little")
        out.append(int(bits.view("<i8")[0]))
    return pd.Series(out)


def simhash_little(text: str | None) -> int:
    return simhash_of(text, lambda t: int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little"))


def normalize_ascii(text: Column) -> Column:
    """Lower case of A-Z and white space collapsed, inside generated code."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.btrim(F.regexp_replace(low, r"[ \t-\r]+", " "))


def content_hash(normalized: Column) -> Column:
    return F.sha2(normalized.cast("binary"), 256)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_table(query: Column, others: Column) -> Column:
    return F.transform(others, lambda h: F.bit_count(h.bitwiseXOR(query)))


def nearest_hash(query: Column, others: Column) -> Column:
    """struct<distance, idx> of the first nearest hash; (64, -1) of none."""
    each = F.transform(others, lambda h, i: F.struct(F.bit_count(h.bitwiseXOR(query)).alias("distance"), i.alias("idx")))
    return F.coalesce(F.array_min(each), F.struct(F.lit(64).alias("distance"), F.lit(-1).alias("idx")))


#: Space separators of Unicode, which SQL's trim() removes; line breaks and tabs are none.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def title_element(html: Column) -> Column:
    """The markup inside a page's first plain title element, '' without one; inside generated code."""
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", "-")


def domain_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def split_authors(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[|,;]"), lambda a: F.trim(a)), lambda a: a != ""))


def clean_list(items: Column) -> Column:
    """Stripped, without empty ones, the first of equal ones."""
    return F.array_distinct(F.filter(F.transform(items, lambda a: F.trim(a)), lambda a: a.isNotNull() & (a != "")))


def clean_list_any_case(items: Column) -> Column:
    """As clean_list(), but equal without regard to case; the first spelling stays."""
    flat = F.filter(F.transform(items, lambda a: F.trim(a)), lambda a: a.isNotNull() & (a != ""))
    low = F.transform(flat, lambda a: F.lower(a))
    return F.filter(flat, lambda a, i: F.array_position(low, F.lower(a)) == i + 1)


DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd'T'HHmmss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy")


def coerce_time(text: Column) -> Column:
    """The first format that fits, in UTC where none is named; null if none does. A leading weekday is dropped."""
    flat = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", ""), r"(GMT|UTC)$", "+0000")
    return F.coalesce(*[F.try_to_timestamp(flat, F.lit(f)) for f in DATE_FORMATS])


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of each lower-cased word, padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w]+"), lambda w: w != "")
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))
    return F.array_distinct(grams)


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of trigrams."""
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(0.0)
