"""Nulls, empty and very long texts, ties and repeated rows, empty tables, and extra columns with clashing names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, frame, prose
from tidewire.llm import decontam, jaccard_join, lm_score, packing, pii, quality, queries, sharding, substring, suffix, urlfilter

#: Names that the operators use for columns of their own.
CLASHES = "n fp tokens nid token centre th start sig salt l r uid grp bin offset free piece length size shard slot kind spans h w pos m item_id verdict rule node component a b u v".split()


def long_text(seed: int) -> str:
    return prose(random.Random(seed), 30_000, 3000)


def rows():
    rng = random.Random(1)
    text = prose(rng, 120)
    return [(1, text), (2, text), (2, text), (None, text), (3, None), (4, ""), (5, " \n\t "), (6, long_text(3)), (7, long_text(3)), (8, "word"), (None, None), (9, prose(rng, 80) + " " + text)]


OPERATORS = {
    "lm": lambda df: lm_score.lm_scores(df).select("doc_id", "n_tokens", F.round("base_score", 6)),
    "leaks": lambda df: decontam.contamination(df, df.sparkSession.createDataFrame([(1, rows()[0][1]), (2, None), (3, "")], "item_id bigint, text string")),
    "pii": lambda df: pii.digests(df),
    "shards": lambda df: sharding.shard_by_bytes(df, 3).select("doc_id", "size", "text_crc32"),
    "classes": lambda df: jaccard_join.similarity_classes(df),
    "packing": lambda df: packing.pack(packing.pieces(df, queries.tokenizer_path())).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "quality": lambda df: quality.ledger(df).select("doc_id", "n_words", "fail_bits"),
    "suffix": lambda df: suffix.remove_repeats(df),
    "passages": lambda df: substring.near_passages(df),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_and_clashing_columns(spark, name):
    run = OPERATORS[name]
    key = lambda out: sorted(map(repr, out.collect()))
    plain = frame(spark, rows())
    clash = plain.select("*", *[F.lit(f"x{c}").alias(c) for c in CLASHES])
    got = key(run(plain))
    assert got == key(run(clash))
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
    if name in ("lm", "pii", "shards", "classes", "quality", "suffix"):
        assert len(got) == len(rows())
    if name == "classes":
        of = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(plain).collect() if r["doc_id"] is not None}
        assert of[1] == of[2] and of[6] == of[7] and of[6][0] > 20_000 and of[3] == (0, 3) and of[4] == (0, 4) and of[8] == (1, 8)
    if name == "passages":
        assert any("doc_id=7" in r and "end_word=30000" in r for r in got)
    if name == "packing":
        assert sum("doc_id=6," in r for r in got) == sum("doc_id=7," in r for r in got) > 5


def test_pages_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/1", None), (1, "http://a.com/en/1", None), (2, None, "x"), (3, "http://b.org/", '<link rel="canonical" href="http://a.com/en/1">')], "page_id bigint, url string, html string")
    run = lambda df: sorted(map(repr, urlfilter.filter_urls(df, urlfilter.page_edges(df)).select("page_id", "host", "path", "rule", "verdict").collect()))
    assert run(pages) == run(pages.select("*", *[F.lit("x").alias(c) for c in ("fit", "host", "path", "node", "component", "alias_block", "u", "t", "src", "dst", "rule", "verdict")]))


def test_a_long_item_in_a_long_text(spark):
    """Windows of thousands of shingles, with a shingle that repeats."""
    rng = random.Random(4)
    item = prose(rng, 3000, 100_000) + " so so so so so so so so so so " + prose(rng, 2000, 100_000)
    text = f"{prose(rng, 500, 100_000)} {item} {prose(rng, 500, 100_000)}"
    docs = spark.createDataFrame([(1, text), (2, prose(rng, 6000, 100_000))], "doc_id bigint, text string")
    out = decontam.contamination(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["start"], r["similarity"]) for r in out] == [(1, 7, 500, 1.0)]
