"""Small corpora with planted cases, and brute-force helpers."""

from __future__ import annotations

import random
import re

import pandas as pd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}x" for _ in range(n))


def corpus(seed: int = 7) -> list[tuple[int, str | None]]:
    """Clean texts, copies, near copies, a shared passage, nulls, empty and short texts, repeated rows."""
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.randint(60, 160)) for _ in range(24)]
    base = prose(rng, 150)
    for k in range(6):  # near copies: few words changed
        w = base.split()
        for _ in range(k % 3):
            w[rng.randrange(len(w))] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0], texts[1]]
    shared = prose(rng, 70)
    texts += [f"{prose(rng, 40)} {shared} {prose(rng, 30)}" for _ in range(4)]
    texts += [None, "", "  \n ", "One", "two words here", "a b c d", "ab" * 400, "Ünï cödé tèxt " * 12, prose(rng, 3000)]
    return list(enumerate(texts)) + [(5, texts[5])]


def frame(spark, rows=None):
    rows = corpus() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], SCHEMA)


def pandas(df) -> pd.DataFrame:
    return df.toPandas()
