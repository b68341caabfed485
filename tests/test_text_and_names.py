from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.functions import language, names, scores, text
from tidewire.operators import entities, neighbours


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_simhash_udf_equals_the_definition(spark):
    texts = ["The quick brown fox jumps over the lazy dog", "the QUICK brown fox", "", None, "ﬁne Straße", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(text.simhash64("t")).collect()]
    assert got == [text.simhash_little(t) for t in texts] and got[2] == got[3] == 0
    base = "the quick brown fox jumps over the lazy dog and runs far away from here"
    a, b, c = (text.simhash_little(t) for t in (base, base + "s", "completely different words about another matter entirely"))
    assert (a ^ b).bit_count() < (a ^ c).bit_count()


def test_hamming_and_nearest(spark):
    assert one(spark, text.hamming(F.lit(-1).cast("bigint"), F.lit(1).cast("bigint"))) == 63
    row = one(spark, text.nearest_hash(F.lit(0).cast("bigint"), F.array(F.lit(3), F.lit(1), F.lit(2)).cast("array<bigint>")))
    assert (row["distance"], row["idx"]) == (1, 1)
    empty = one(spark, text.nearest_hash(F.lit(0).cast("bigint"), F.array().cast("array<bigint>")))
    assert (empty["distance"], empty["idx"]) == (64, -1)
    assert text.fnv1a(b"") == text.FNV_BASIS and text.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_text_columns(spark):
    assert one(spark, text.split_authors(F.lit("Jane Doe; John Roe|Jane Doe, "))) == ["Jane Doe", "John Roe"]
    assert one(spark, text.clean_list_any_case(F.array(F.lit(" AAPL"), F.lit("aapl"), F.lit(""), F.lit("Apple")))) == ["AAPL", "Apple"]
    assert one(spark, text.slugify(F.lit("  Two  Words "))) == "two-words"
    assert one(spark, text.domain_of(F.lit("HTTP://WWW.X.org:80/a"))) == "www.x.org"
    assert one(spark, language.detect_language(F.lit("der Hund und die Katze"))) == "de" and one(spark, language.detect_language(F.lit("ab"))) is None
    assert str(one(spark, text.coerce_time(F.lit("Mon, 05 Jan 2026 10:00:00 GMT")))) == "2026-01-05 10:00:00"
    assert str(one(spark, text.coerce_time(F.lit("20260105T100000Z")))) == "2026-01-05 10:00:00" and one(spark, text.coerce_time(F.lit("soon"))) is None
    assert one(spark, text.word_count(F.lit(" a  b\nc "))) == 3
    assert one(spark, text.trigram_similarity(text.trigrams(F.lit("word")), text.trigrams(F.lit("two words")))) == pytest.approx(4 / 11)


@pytest.mark.parametrize(("name", "kind", "key"), [
    ("Apple Inc.", "org", "apple"), ("APPLE, Incorporated", "company", "apple"), ("Foo Co., Ltd.", "org", "foo"), ("José Mourinho", "person", "jose mourinho"), ("삼성전자 주식회사", "org", "삼성전자"),
    ("Ｆｕｌｌ Ｗｉｄｔｈ", "person", "full width"), ("Inc", "org", "inc"), ("", "org", ""), ("Straße", "place", "strasse"),
])
def test_normalized_names(name, kind, key):
    assert names.normalize_name(name, kind) == key


def test_match_scores():
    side = lambda n, t="org", a=(), e=None: {"name": n, "type": t, "aliases": list(a), "embedding": e}
    assert names.match_score(side("JPMorgan Chase"), side("JP Morgan")) >= 0.75
    assert names.match_score(side("Apple"), side("Apple", "product")) == 0
    assert names.match_score(side("Apple Inc."), side("Apple")) == pytest.approx(1)
    assert names.match_score(side("삼성전자", e=[1, 0.05, 0]), side("Samsung Electronics", e=[1, 0.06, 0])) >= 0.88
    assert names.match_score(side("BofA"), side("Bank of America", a=["BofA"])) > names.match_score(side("BofA"), side("Bank of America"))


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_similarities_are_symmetric_and_bounded(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    assert names.lcs(a, b) == rows[-1][-1]
    for f in (names.ratio, names.token_sort_ratio, names.weighted_ratio):
        assert 0 <= f(a, b) <= 100 and f(a, b) == pytest.approx(f(b, a))
    assert 0 <= names.jaro_winkler(a, b) <= 1


def test_jaro_winkler_known_values():
    assert names.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert names.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.8133, abs=1e-4)


def test_linking_takes_the_best_tier(spark):
    s = spark.createDataFrame([(1, "AAPL", "Apple Inc.", ["Apple"]), (2, "7203.T", "Toyota Motor Corporation", ["Toyota"]), (3, "JPM", "JPMorgan Chase & Co.", ["JP Morgan"])], "id bigint, symbol string, name string, aliases array<string>")
    e = spark.createDataFrame([(10, "aapl", []), (11, "Toyota", []), (12, "JPMorgan Chase", ["nothing"]), (13, "Toyota Motors", []), (14, "Unrelated", None)], "id bigint, name string, aliases array<string>")
    got = {r["entity_id"]: (r["security_id"], round(r["confidence"], 2)) for r in entities.link_securities(e, s).collect()}
    assert got[10] == (1, 1.0) and got[11] == (2, 0.97) and got[12] == (3, 0.97) and got[13][0] == 2 and 14 not in got


def test_resolution_grows_a_catalog():
    f = pd.DataFrame([(1, "Acme Inc.", "org"), (2, "ACME", "org"), (3, "Acme Corp", "org"), (4, "Zenith", "org")], columns=["id", "name", "type"])
    assert entities.resolve_block(f, 0.88)["entity_id"].tolist() == [1, 1, 1, 4]


def test_score_properties(spark):
    n = spark.range(0, 15000, 10).select(scores.length_score(F.col("id")).alias("s"), "id").toPandas()
    up, down = n[n["id"] <= 600]["s"], n[n["id"] >= 1500]["s"]
    assert up.is_monotonic_increasing and down.is_monotonic_decreasing and n["s"].between(0, 1).all()
    assert sum(scores.ARTICLE_WEIGHTS.values()) == pytest.approx(1) and sum(scores.SOURCE_WEIGHTS.values()) == pytest.approx(1)
    good = scores.source_parts(F.lit(0.99), F.lit(0.01), F.lit(2000.0), F.lit(5000), F.lit(0.9))
    bad = scores.source_parts(F.lit(0.2), F.lit(0.8), F.lit(3.0), F.lit(2), F.lit(0.0))
    assert one(spark, scores.source_credibility(good)) > 0.9 > 0.3 > one(spark, scores.source_credibility(bad))
    assert one(spark, scores.title_quality(F.lit("Markets rise as central banks hold rates steady"))) == 1.0
    assert one(spark, scores.title_quality(F.lit("SHOCKING NEWS YOU MUST SEE NOW!!!"))) < 0.5
    assert one(spark, scores.decay(F.lit(24.0))) == 0.5 and one(spark, scores.decay(F.lit(-3.0))) == 1.0
    assert one(spark, scores.direction(F.lit(0.0))) == "neutral"
    assert one(spark, scores.cadence_seconds(F.array(F.lit("Markets")), F.lit(2))) == 900


@pytest.mark.parametrize("pass_bytes", [64 << 20, 8 * 16 * 7])
def test_nearest_event_is_exact_at_every_size(spark, pass_bytes):
    rng = np.random.default_rng(4)
    a, c = rng.normal(size=(80, 16)), rng.normal(size=(60, 16))
    articles = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id bigint, embedding array<double>")
    events = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "event_id bigint, centroid array<double>")
    s = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
    want = {i: (int(s[i].argmax()), round(float(s[i].max()), 9)) for i in range(80) if s[i].max() >= 0.5}
    got = neighbours.nearest_event(articles, events, 0.5, pass_bytes).collect()
    assert {r["id"]: (r["event_id"], round(r["similarity"], 9)) for r in got} == want and len(want) > 20


def test_resolution_over_components_equals_the_sequential_rule(spark):
    import itertools
    import random

    rng = random.Random(3)
    words = "acme zenith nordic steel alpine harbor summit orient pacific valley".split()
    rows = []
    for k in range(140):
        name = " ".join(rng.sample(words, 2)) + rng.choice(["", " Inc.", " Co., Ltd.", " Group"])
        if rng.random() < 0.3:
            at = rng.randrange(len(name))
            name = name[:at] + rng.choice("aeiou") + name[at + 1 :]
        rows.append((k, rng.choice([name, name.upper(), name.title()]), rng.choice(["org", "org", "place"])))
    found: list[dict] = []
    want = {}
    for k, name, kind in rows:  # every mention against every entity whose keys meet, in order
        side = {"name": name, "type": kind, "aliases": []}
        known = next((want[j] for j, n, t in rows[:k] if (n, t) == (name, kind)), None)
        if known is not None:
            want[k] = known
            continue
        best, at = 0.0, None
        for i, e in enumerate(found):
            s = names.match_score(side, e)
            if s > best:
                best, at = s, i
        if at is None or best < 0.88:
            found.append({"id": k, "name": name, "type": kind, "aliases": []})
            at = len(found) - 1
        elif names.normalize_name(name, kind) not in {names.normalize_name(x, kind) for x in (found[at]["name"], *found[at]["aliases"])}:
            found[at]["aliases"].append(name)
        want[k] = found[at]["id"]
    got = {r["id"]: r["entity_id"] for r in entities.resolve(spark.createDataFrame(rows, "id bigint, name string, type string")).collect()}
    apart = [k for k in want if want[k] != got[k]]
    # Only names that share no blocking key may differ.
    for k in apart:
        mine = set(names.block_keys(rows[k][1], rows[k][2]))
        assert not all(mine & set(names.block_keys(rows[j][1], rows[j][2])) for j in {want[k], got[k]}), rows[k]
    assert len(apart) <= 2 and len(set(want.values())) > 20
    assert list(itertools.islice(got, 1)) and entities.resolve(spark.createDataFrame([], "id bigint, name string, type string")).count() == 0


def test_score_bound_drops_no_match(spark):
    import random

    rng = random.Random(5)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randrange(3)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abcde "))
        rows.append((" ".join(a.split()), "org", " ".join("".join(b).split()), rng.choice(["org", "place", ""])))
    df = spark.createDataFrame(rows, "a string, ta string, b string, tb string")
    for r in df.withColumn("s", names.scores_over(0.8)("a", "ta", "b", "tb")).collect():
        s = names.string_score(r["a"], r["b"]) if names.types_match(r["ta"], r["tb"]) else 0.0
        assert r["s"] == (pytest.approx(s) if s >= 0.8 else None)


def test_languages(spark):
    texts = {"en": "The council voted on Tuesday to build a new bridge", "de": "Der Rat hat am Dienstag beschlossen, eine neue Brücke zu bauen", "fr": "Le conseil a voté mardi la construction d'un nouveau pont", "es": "El consejo votó el martes construir un nuevo puente", "it": "Il consiglio ha votato martedì per costruire un nuovo ponte", "pt": "O conselho votou na terça-feira pela construção de uma nova ponte", "nl": "De raad stemde dinsdag voor de bouw van een nieuwe brug", "sv": "Rådet röstade på tisdagen för att bygga en ny bro", "ja": "評議会は新しい橋を建設する", "ru": "Совет решил построить новый мост", "ko": "의회는 새 다리를 건설하기로 했다", "zh": "议会决定建造新桥"}
    assert {k: language.language_of(t) for k, t in texts.items()} == {k: k for k in texts}
    assert [language.language_of(t) for t in (None, "", "ab", "12 345")] == [None] * 4
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(trim(text)) >= 20")
    right = df.select((language.detect_language("text") == F.col("lang")).alias("ok")).agg(F.avg(F.col("ok").cast("int"))).first()[0]
    assert right >= 0.97


CATALOG = "id bigint, name string, type string, aliases array<string>"


def copied_catalog(n: int, seed: int) -> list[tuple]:
    """Rows of few names, with types, aliases and nulls."""
    import random

    rng = random.Random(seed)
    base = ["Acme Steel Inc.", "Acme Steel", "acme stel", "Zenith Harbor Co., Ltd.", "Zenith Harbour", "Nordic Pacific", "Pacific Nordic", "ab", "", None, "--"]
    return [(k, rng.choice(base), rng.choice(["org", "org", "place", "", None]), rng.choice([None, [], ["AS"], ["AS", "Acme"], ["Nordic Pacific"]])) for k in range(n)]


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_pairs_of_copied_names_meet_once_and_without_a_shuffle_of_all_pairs(spark):
    rows = copied_catalog(120, 1)
    df = spark.createDataFrame(rows, CATALOG)
    keys = {k: set(names.block_keys(n, t)) for k, n, t, _ in rows}
    want = {(a, b) for a in keys for b in keys if a % 10 == 0 and keys[a] & keys[b]}
    out = entities.candidate_pairs(df.filter("id % 10 = 0"), df)
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want) > 100
    assert "Aggregate" not in plan_of(out) and "BroadcastHashJoin" not in plan_of(out)
    again = entities.candidate_pairs(df.filter("id % 10 = 0").unionByName(df.filter("id = 0")), df).collect()
    assert sorted(map(tuple, again)) == sorted(want)


def test_each_pair_of_sides_is_scored_once(spark, monkeypatch):
    rows = copied_catalog(150, 2)
    df = spark.createDataFrame(rows, CATALOG)
    side = lambda r: {"name": r[1], "type": r[2], "aliases": r[3]}
    keys = {r[0]: set(names.block_keys(r[1], r[2])) for r in rows}
    want = {}
    for a in rows[::10]:
        found = [(names.match_score(side(a), side(b)), -b[0]) for b in rows if keys[a[0]] & keys[b[0]]]
        if found and max(found)[0] >= 0.8:
            want[a[0]] = (-max(found)[1], pytest.approx(max(found)[0]))
    asked, real = [], entities.candidate_pairs
    monkeypatch.setattr(entities, "candidate_pairs", lambda l, r: (asked.append((l.count(), r.count())), real(l, r))[1])
    got = entities.match(df.filter("id % 10 = 0"), df, 0.8).collect()
    assert {r["left_id"]: (r["right_id"], r["score"]) for r in got} == want and len(want) > 5
    distinct = len({(n or "", t or "", tuple(a or ())) for _, n, t, a in rows})
    assert asked[0][1] == distinct < len(rows)


def test_candidates_of_copied_rows_are_the_best_rows(spark, monkeypatch):
    rows = copied_catalog(200, 3)
    df = spark.createDataFrame(rows, CATALOG)
    grams = {r["id"]: set(r["g"]) for r in df.select("id", text.trigrams(F.col("name")).alias("g")).collect()}
    first = lambda n: ((n or "").strip().lower().split() or [""])[0]
    want = {}
    for q, qn, qt, qa in rows[::10]:
        found = []
        for c, cn, ct, ca in rows:
            either = grams[q] | grams[c]
            s = len(grams[q] & grams[c]) / len(either) if either else 0.0
            fits = (qt is not None and qt == ct) or qt in ("", "unknown") or ct in ("", "unknown")
            if fits and (s > 0.396 or qn in (ca or []) and qn is not None or first(qn) and first(qn) == first(cn) or set(qa or []) & set(ca or [])):
                found.append((-s, c))
        want |= {(q, c): pytest.approx(-s) for s, c in sorted(found)[:7]}
    out, plans = [], []
    real = entities.written
    monkeypatch.setattr(entities, "written", lambda d, n: (plans.append(plan_of(d)), real(d, n))[1])
    out = entities.candidates(df.filter("id % 10 = 0"), df, most=7)
    got = {(r["query_id"], r["id"]): r["similarity"] for r in out.collect()}
    assert got == want and len(want) > 60
    assert not any("BroadcastHashJoin" in p for p in [*plans, plan_of(out)])


def test_near_duplicates_broadcast_no_exploded_keys(spark):
    rows = [(k, (k * 0x9E3779B97F4A7C15 & (1 << 62) - 1) ^ (1 if k % 2 else 0)) for k in range(40)] + [(40 + k, 7 << k % 3) for k in range(6)]
    out = neighbours.near_duplicates(spark.createDataFrame(rows, "id bigint, simhash bigint"))
    first = {}
    for k, h in rows:
        first.setdefault(h, k)
    want = {(first[h], k, 0) for k, h in rows if first[h] != k} | {(a, b, (x ^ y).bit_count()) for x, a in first.items() for y, b in first.items() if a < b and (x ^ y).bit_count() <= 3}
    assert sorted(map(tuple, out.collect())) == sorted(want) and want
    assert "BroadcastHashJoin" not in plan_of(out)


def test_candidates_meet_by_name_whatever_the_aliases(spark, monkeypatch):
    """400 rows of 8 names, an alias a row: 8 names meet, not 400 rows, and no other way is asked where 7 rows are similar."""
    rows = [(k, f"red ring {k % 8}", "org", [f"alias {k}"]) for k in range(400)]
    df = spark.createDataFrame(rows, CATALOG)
    met, real = [], entities.candidates_by_trigram
    monkeypatch.setattr(entities, "candidates_by_trigram", lambda q, c, *x: (met.append((q.count(), c.count())), real(q, c, *x))[1])
    monkeypatch.setattr(entities, "rows_by_alias", None)
    got = {}
    for r in entities.candidates(df.filter("id % 10 = 0"), df, most=7).collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert {k: sorted(v) for k, v in got.items()} == {k: [k % 8 + 8 * i for i in range(7)] for k in range(0, 400, 10)}
    assert met == [(4, 8)]
