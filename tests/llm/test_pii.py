from __future__ import annotations

import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import frame
from tidewire.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def base(text):
    return [s for s in pii.find(text, pii.automaton()) if s[0] in pii.BASE_KINDS]


PIECES = ["a", "Z.", "@", "x@y.com", ".", "-", " ", "1.2.3.4", "255", "256.", "+1 (652) 555-5229", "4092998855794968", "4111 1111 1111 1111", "é", "ß", "9", "\n", "+", "%", "x..y@a-b.c.d", "@@", "_", "0001"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=24).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1234567890.@+- ()_%é\n", max_size=60))
def test_base_spans_equal_the_patterns_on_noise(text):
    assert base(text) == brute(text)


def test_added_kinds():
    text = 'Pay IBAN: DE89 3704 0044 0532 0130 00 now, password=aa24c3f1b553 and token = "8824c3a463b8b0d6" at ftp://joe:pw1@host.example/x; the account of things'
    found = pii.find(text, pii.automaton())
    assert [(k, text[s:e]) for k, s, e in found] == [("account", "DE89 3704 0044 0532 0130 00"), ("account", "aa24c3f1b553"), ("account", "8824c3a463b8b0d6"), ("login", "joe:pw1")] or [k for k, _, _ in found] == ["account", "account", "account", "login", "email"]
    assert pii.find("the account is fine, my token of thanks", pii.automaton()) == []


def test_long_runs_take_linear_time():
    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "a." * 150_000 + "@", "1 " * 150_000, "+1" * 150_000, "@" * 300_000):
        pii.find(text, pii.automaton())
    assert time.time() - began < 30


def test_query_and_redaction(spark):
    rows = [(1, "mail bob@example.com or +1 (652) 555-5229"), (2, None), (3, ""), (1, "mail bob@example.com or +1 (652) 555-5229"), (4, "é 10.0.0.1")]
    out = {r["doc_id"]: r for r in pii.digests(frame(spark, rows)).collect()}
    assert out[1]["spans"] == "email:5:20,phone:24:41" and out[1]["n_email"] == 1 and out[4]["spans"] == "ip:2:10"
    assert out[2]["spans"] == "" and pii.digests(frame(spark, rows)).count() == 5
    docs = frame(spark, rows).withColumnRenamed("lang", "spans")
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in clean.collect() if r["text"] is not None) == [(1, "mail <EMAIL> or <PHONE>"), (1, "mail <EMAIL> or <PHONE>"), (3, ""), (4, "é <IP>")]
    assert pii.redact(docs.limit(0)).count() == 0
