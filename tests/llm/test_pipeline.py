from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tests.llm.helpers import corpus, prose, words
from tests.llm.test_duplicates import classes, leaks
from tests.llm.test_pii import base
from tidewire.llm import pii, quality

pytestmark = pytest.mark.skipif(not __import__("importlib.util").util.find_spec("public_tokenizers"), reason="no vocabulary files")


def test_each_stage_takes_effect(spark, tmp_path):
    rng = random.Random(2)
    items = [(k, prose(rng, 40)) for k in range(3)]
    rows = [(i, t) for i, t in dict(corpus()).items()]
    rows += [(500, f"{prose(rng, 50)} {items[0][1]} {prose(rng, 20)}"), (501, f"{prose(rng, 60)} write to ann@example.org today {prose(rng, 20)}"), (502, "LOUD!! " * 80)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, [dict(rows)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}-{name}")
        docs = spark.read.parquet(f"{tmp_path}/{k}-{name}")
        if k < 4:
            assert docs.columns == columns
            seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    first = {d: t for d, t in seen[0].items() if keeps(t)}
    assert seen[1] == first and 502 not in first
    assert sorted(seen[2]) == sorted(d for d, _, c in classes(sorted(first.items()), 5, 80) if c == d)
    bad = {d for d, _ in leaks(sorted(seen[2].items()), items)}
    assert bad == {500} and sorted(seen[3]) == sorted(set(seen[2]) - bad)
    assert seen[4] == {d: pii.redact_text(t, pii.find(t, pii.automaton())) for d, t in seen[3].items()}
    assert not any(base(t) for t in seen[4].values()) and "<EMAIL>" in seen[4][501]
    assert {r["doc_id"] for r in docs.collect()} == set(seen[4])
    ran = {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ran == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in docs.collect()}


def test_near_duplicates_go_by_id_and_text(spark):
    rng = random.Random(9)
    a, b, c, d, e = (prose(rng, 80) for _ in range(5))
    near = lambda t: f"{t} more"
    rows = [(1, a), (2, near(a)), (2, b), (2, b), (3, c), (3, near(c)), (4, d), (None, near(d)), (None, e), (None, near(e)), (None, prose(rng, 80)), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == len(set(got)) == 8 and {(1, a), (2, b), (4, d), (None, rows[10][1]), (5, None), (6, "")} <= set(got)
    assert len({(3, c), (3, near(c))} & set(got)) == 1 and len({(None, e), (None, near(e))} & set(got)) == 1


def keeps(text):
    n, chars, symbols, lines, again, repeat, alpha, upper, letters = quality.measure((text or "").encode())
    return not (n < 50 or 100 * repeat > 50 * n or 100 * symbols > 10 * n or 100 * again > 50 * lines or 10 * chars < 20 * n or 10 * chars > 120 * n or 100 * alpha < 70 * n or 100 * upper > 50 * letters) and bool(words(text))
