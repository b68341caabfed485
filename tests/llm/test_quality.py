from __future__ import annotations

import re
from collections import Counter

from tests.llm.helpers import WORD, corpus, frame
from tidewire.llm import quality


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


EXTRA = [(900, "a b c a b c a b c"), (901, "| # x\n\n| # x\r\n| # x\n"), (902, "SHOUT!! " * 60), (903, "tab\tnbsp joined   wide\vx\fy")]


def test_measures_equal_brute_force(spark):
    rows = corpus() + EXTRA
    got = sorted(map(tuple, quality.ledger(frame(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()))
    assert got == sorted((i, *brute(t)) for i, t in rows)


def test_policies_and_ablations_read_the_ledger(spark):
    led = quality.ledger(frame(spark, corpus() + EXTRA)).cache()
    kept = led.filter(quality.passes(quality.STRICT)).count()
    by_rule = {r["rule"]: r for r in quality.ablations(led, quality.STRICT).collect()}
    assert set(by_rule) == set(quality.STRICT.rules) and all(r["n_kept"] == kept for r in by_rule.values())
    for rule in quality.STRICT.rules:
        without = quality.Policy("x", 9, tuple(r for r in quality.STRICT.rules if r != rule))
        assert led.filter(quality.passes(without)).count() == by_rule[rule]["n_kept_without"]
    assert led.filter("doc_id = 902").first()["fail_bits"] & 1 << quality.BITS["shouting"]


def test_filter_keeps_columns_with_clashing_names(spark):
    docs = frame(spark).selectExpr("*", "1 as n_words", "2 as fail_bits")
    out = quality.filter_documents(docs)
    assert out.columns == docs.columns and out.count() == quality.ledger(frame(spark)).filter(quality.passes(quality.STRICT)).count()
    assert quality.filter_documents(docs.limit(0)).count() == 0
