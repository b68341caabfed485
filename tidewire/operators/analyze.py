"""Analysis by kind through pluggable providers, with an offline provider that needs no model."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("summary", "entities", "keywords", "topics", "sentiment", "embedding")
DIM = 64
POSITIVE = frozenset("good great gain gains growth win wins up rise rises strong best success profit".split())
NEGATIVE = frozenset("bad loss losses fall falls down weak worst fail fails crisis fraud war decline".split())


class Provider(Protocol):
    """What a provider does: the payload of one kind for one text, and what it used."""

    name: str
    model: str

    def extract(self, kind: str, text: str) -> tuple[dict, int]: ...


class OfflineProvider:
    """Rules alone: leading sentences, capitalized runs, frequent words, marker words, hashed words."""

    name, model = "offline", "rules-1"

    def extract(self, kind: str, text: str) -> tuple[dict, int]:
        words = re.findall(r"\w+", text.lower())
        made = getattr(self, kind)(text, words)
        return made, len(words)

    def summary(self, text: str, words: list[str]) -> dict:
        return {"summary": " ".join(re.split(r"(?<=[.!?])\s+", text.strip())[:3])[:600]}

    def entities(self, text: str, words: list[str]) -> dict:
        found = Counter(re.findall(r"(?<=[a-zà-ÿ,;] )[A-ZÀ-Ý]\w+(?: [A-ZÀ-Ý]\w+)*", text))
        top = found.most_common(20)
        return {"entities": [{"name": n, "type": "other", "salience": round(c / top[0][1], 4), "count": c, "aliases": []} for n, c in top]}

    def keywords(self, text: str, words: list[str]) -> dict:
        found = Counter(w for w in words if len(w) > 3)
        top = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:10]
        return {"keywords": [{"term": w, "weight": round(c / len(words), 9)} for w, c in top]}

    def topics(self, text: str, words: list[str]) -> dict:
        top = self.keywords(text, words)["keywords"][:3]
        return {"topics": [{"slug": k["term"], "label": k["term"], "confidence": min(1.0, 10 * k["weight"])} for k in top]}

    def sentiment(self, text: str, words: list[str]) -> dict:
        up, down = sum(w in POSITIVE for w in words), sum(w in NEGATIVE for w in words)
        p = (up - down) / (up + down) if up + down else 0.0
        return {"polarity": p, "label": "positive" if p > 0 else "negative" if p < 0 else "neutral"}

    def embedding(self, text: str, words: list[str]) -> dict:
        import zlib

        v = [0.0] * DIM
        for w in words:
            h = zlib.crc32(w.encode())
            v[h % DIM] += 1 if h >> 16 & 1 else -1
        n = sum(x * x for x in v) ** 0.5
        return {"vector": [round(x / n, 6) if n else 0.0 for x in v]}


def valid(kind: str, made: dict) -> str | None:
    """What is wrong with a payload, if anything; values out of range fail the kind."""
    unit = lambda x, low=0.0: isinstance(x, int | float) and low <= x <= 1
    if kind == "entities" and not all(e.get("name") and unit(e.get("salience", 0)) for e in made["entities"]):
        return "an entity without a name or with salience out of [0, 1]"
    if kind == "keywords" and not all(k.get("term") and unit(k.get("weight", 0)) for k in made["keywords"]):
        return "a keyword without a term or with weight out of [0, 1]"
    if kind == "topics" and not all(unit(t.get("confidence", 0)) for t in made["topics"]):
        return "a topic with confidence out of [0, 1]"
    if kind == "sentiment" and not unit(made["polarity"], -1.0):
        return "polarity out of [-1, 1]"
    if kind == "embedding" and len(made["vector"]) != DIM:
        return f"a vector of {len(made['vector'])} numbers, not {DIM}"
    return None


RESULTS = "target_type string, target_id bigint, kind string, provider string, model string, result string, tokens int, cost_usd double, error string"


def requests(articles: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """A row an article and kind."""
    return articles.select(F.lit("article").alias("target_type"), F.col("id").alias("target_id"), F.explode(F.array(*map(F.lit, kinds))).alias("kind"), F.concat_ws("\n", "title", "body").alias("text"))


def analyze(rows: DataFrame, provider: Provider) -> DataFrame:
    """RESULTS of requests; a kind that fails carries its error and stops no other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                result, used, error = None, 0, None
                try:
                    made, used = provider.extract(r.kind, r.text or "")
                    error = valid(r.kind, made)
                    result = json.dumps(made, ensure_ascii=False) if error is None else None
                except Exception as e:  # a provider's failure is the request's, not the job's
                    error = f"{type(e).__name__}: {e}"
                out.append((r.target_type, r.target_id, r.kind, provider.name, provider.model, result, used, 0.0, error))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULTS.split(", ")])

    return rows.select("target_type", "target_id", "kind", "text").mapInPandas(run, RESULTS)
