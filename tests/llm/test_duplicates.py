from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import corpus, frame, prose, words
from tidewire.llm import decontam, jaccard_join, substring, suffix


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    ids = [rows[i][0] for i in range(len(rows))]
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [(ids[i], len(sets[i]), least[find(i)]) for i in range(len(rows))]


def chain(seed):
    """Copies of copies: neighbours link, ends don't; so classes need links between sets of different pivots."""
    rng = random.Random(seed)
    w = prose(rng, 120).split()
    out = []
    for k in range(14):
        w = list(w)
        w[(k * 8) % len(w)] = f"new{k}"
        out.append((3000 + k, " ".join(w)))
    return out


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_classes_equal_all_pairs(spark, k, percent):
    rows = corpus() + chain(1) + [(9000 + i, prose(random.Random(i // 3), 8)) for i in range(9)]
    got = sorted(map(tuple, jaccard_join.similarity_classes(frame(spark, rows), k, percent).collect()))
    assert got == sorted(classes(rows, k, percent))


def test_classes_without_a_frequency_order_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT_IN", 2)
    rows = corpus(11) + chain(2)
    got = sorted(map(tuple, jaccard_join.similarity_classes(frame(spark, rows), 4, 85).collect()))
    assert got == sorted(classes(rows, 4, 85))


def altered(seed):
    """Copies with words replaced, dropped and added, cuts of all lengths, and texts around a long common passage."""
    rng = random.Random(seed)
    base = prose(rng, 150, 3000).split()
    out = []
    for _ in range(45):
        w = list(base)
        for _ in range(rng.randint(1, 7)):
            at = rng.randrange(len(w))
            kind = rng.randrange(4)
            w[at : at + (kind != 1)] = [] if kind == 0 else [f"new{rng.randrange(60)}"]
        out.append(" ".join(w))
    out += [" ".join(base[: rng.randint(70, 150)]) for _ in range(25)]
    passage = prose(rng, 60, 3000)
    out += [f"{passage} {prose(rng, rng.randint(3, 14), 3000)}" for _ in range(20)]
    return [(4000 + i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("k", "percent", "long_list", "levels"), [(4, 85, 2, 6), (5, 80, 2, 6), (4, 85, 4, 1), (5, 80, 3, 2), (4, 85, 2, 0)])
def test_classes_with_long_lists_equal_all_pairs(spark, monkeypatch, k, percent, long_list, levels):
    monkeypatch.setattr(jaccard_join, "LONG_LIST", long_list)
    monkeypatch.setattr(jaccard_join, "LEVELS", levels)
    monkeypatch.setattr(jaccard_join, "LONG_FINER", long_list)
    rows = altered(long_list) + chain(3)
    got = sorted(map(tuple, jaccard_join.similarity_classes(frame(spark, rows), k, percent).collect()))
    assert got == sorted(classes(rows, k, percent))


@pytest.mark.parametrize("percent", [80, 85])
def test_partners_share_first_shingles_of_their_differences(percent):
    """Sets that link, not both with the pivot, share one of so many first shingles of what sets them apart from it."""
    rng = random.Random(percent)
    seen = 0
    for _ in range(3000):
        pivot = set(range(rng.randint(20, 60)))
        x = {v for v in pivot if rng.random() > 0.2} | {rng.randrange(100, 112) for _ in range(rng.randrange(12))}
        y = {v for v in x if rng.random() > 0.08} | {rng.randrange(100, 130) for _ in range(rng.randrange(3))}
        linked = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
        if not linked(x, y) or linked(x, pivot) and linked(y, pivot) or x == pivot or y == pivot:
            continue
        seen += 1
        firsts = []
        for s, other in ((x, y), (y, x)):
            short, whole = jaccard_join.delta_prefixes(len(s & pivot), len(s), len(pivot), percent)
            order = sorted(s - pivot) + sorted(pivot - s)
            firsts.append(set(order[: short if not linked(other, pivot) else max(short, whole)]))
            assert linked(other, pivot) or not linked(s, pivot) or len(order[:short]) == min(short, len(order))
        assert firsts[0] & firsts[1]
    assert seen > 300


@pytest.mark.parametrize("sampled", ["none", "backwards"])
def test_classes_do_not_depend_on_the_sample(spark, monkeypatch, sampled):
    rows = corpus(7) + chain(4)
    found = jaccard_join.frequent_shingles
    monkeypatch.setattr(jaccard_join, "frequent_shingles", lambda *a: found(*a)[:0] if sampled == "none" else found(*a)[::-1].copy())
    got = sorted(map(tuple, jaccard_join.similarity_classes(frame(spark, rows), 5, 80).collect()))
    assert got == sorted(classes(rows, 5, 80))


def test_classes_of_no_rows(spark):
    assert jaccard_join.similarity_classes(frame(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard_join.similarity_classes(frame(spark, [(1, None), (2, "")])).orderBy("doc_id").collect()] == [(1, 0, 1), (2, 0, 2)]


def leaks(rows, items):
    out = set()
    for doc, text in rows:
        w = (text or "").lower().split()
        s = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        for item, t in items:
            v = t.lower().split()
            b = [tuple(v[i : i + 5]) for i in range(max(1, len(v) - 4))] if v else []
            for i in range(len(s)):
                win = s[i : i + len(b)]
                both = sum(min(win.count(x), b.count(x)) for x in set(b))
                if b and both >= 0.8 * (len(win) + len(b) - both):
                    out.add((doc, item))
    return out


def test_leaks_equal_all_windows(spark):
    rng = random.Random(5)
    items = [(k, prose(rng, rng.randint(20, 60))) for k in range(6)] + [(6, "few words"), (7, "tick tock " * 12)]
    rows = [(k, prose(rng, 90)) for k in range(8)]
    for k, (_, t) in enumerate(items):
        w = t.split()
        edit = list(w)
        edit[len(w) // 2] = "changed"
        inserted = w[: len(w) // 3] + ["extra"] + w[len(w) // 3 :]
        for n, v in enumerate((w, edit, inserted, w[: len(w) // 2], w[2:])):
            rows.append((100 * (k + 1) + n, f"{prose(rng, 30)} {' '.join(v)} {prose(rng, 20 if n != 4 else 0)}"))
    rows += [(990, None), (991, ""), (992, "few words"), (100, rows[8][1]), (993, items[0][1].upper())]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontam.contamination(frame(spark, rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == leaks(rows, items)
    kept = decontam.decontaminate(frame(spark, rows).withColumnRenamed("lang", "h"), bench)
    bad = {d for d, _ in leaks(rows, items)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in rows if d not in bad) and "h" in kept.columns
    assert decontam.contamination(frame(spark, []), bench).count() == 0
    assert decontam.contamination(frame(spark, rows), bench.limit(0)).count() == 0


def test_a_leak_behind_a_window_with_more_in_common_is_found(spark):
    rng = random.Random(6)
    w = [f"item{k}" for k in range(54)]  # 50 shingles
    lead = prose(rng, 30)
    rows = [(1, " ".join([lead, *w[45:50], "x1 x2 x3", *w[:45]])), (2, " ".join([lead, *w[:5], "x1 x2 x3", *w[:45]])), (3, " ".join([lead, *w[:44]]))]
    items = [(0, " ".join(w))]
    found = {r["doc_id"]: r for r in decontam.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert {(d, 0) for d in found} == leaks(rows, items) == {(1, 0), (2, 0), (3, 0)}
    assert [(found[d]["start"], found[d]["similarity"]) for d in (1, 2, 3)] == [(38, 0.82), (38, 0.82), (30, 0.8)]


def removed(rows):
    seen, out = set(), {}
    for doc, text in sorted(dict.fromkeys(rows), key=lambda r: r[0]):
        b = (text or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - 99):
            s = b[i : i + 100]
            if s in seen:
                mark[i : i + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(x for x, y in zip(b, mark, strict=True) if not y)
        runs = sum(1 for i in range(len(mark)) if mark[i] and (not i or not mark[i - 1]))
        out[doc] = (len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats_equal_all_strings(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(8)
    rows = [(i, t) for i, t in corpus()]
    passage = prose(rng, 60)
    rows += [(500 + k, f"{prose(rng, k * 3)} {passage[k * 7 :]} {prose(rng, 10)}") for k in range(12)]
    rows += [(600, "z" * 350), (601, "xy" * 130), (602, "zz" + "z" * 99), (603, passage[:99]), (604, passage[:100]), (605, ("|" * 7 + " ") * 60)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(frame(spark, rows)).collect()}
    assert got == removed(rows)
    assert suffix.remove_repeats(frame(spark, rows)).count() == len(rows)
    assert suffix.remove_repeats(frame(spark, [])).count() == 0


def windows_by_recursion(h, least):
    out = []

    def go(low, high):
        if high - low >= least:
            c = min(range(low, high), key=lambda i: (h[i], i))
            out.append((low, c, high))
            go(low, c)
            go(c + 1, high)

    go(0, len(h))
    return sorted(out)


def test_compact_windows_equal_the_recursion():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (0, 5, 9, 10, 60, 400):
        for top in (6, 1 << 60):
            h = rng.integers(0, top, n).astype(np.uint64)
            got = sorted(zip(*(x.tolist() for x in substring.compact_windows(h, 10)), strict=True))
            assert got == windows_by_recursion(h.tolist(), 10)


def test_planted_passages_are_found_and_clean_texts_left_alone(spark, monkeypatch):
    monkeypatch.setattr(substring, "FREQUENT_IN", 3)
    rng = random.Random(21)
    passage = prose(rng, 80, 5000).split()
    rows = [(k, prose(rng, 150, 5000)) for k in range(20)]
    spans = {}
    for k in range(10):
        p = list(passage)
        if k:
            p[7 * k] = f"edit{k}"  # five of 76 shingles
        lead = rng.randint(10, 60)
        rows.append((100 + k, " ".join([prose(rng, lead, 5000), *p, prose(rng, 30, 5000)])))
        spans[100 + k] = (lead, lead + 80)
    rows += [(200, rows[3][1]), (201, " ".join(passage[:49])), (202, None), (203, ""), (204, rows[25][1])]
    out = substring.near_passages(frame(spark, rows)).collect()
    assert {r["doc_id"] for r in out} == {*range(101, 110), 200, 204}
    assert all(r["source_doc_id"] < r["doc_id"] and r["similarity"] >= 0.8 for r in out)
    for r in out:
        if r["doc_id"] in spans:
            low, high = spans[r["doc_id"]]
            assert low <= r["start_word"] and r["end_word"] <= high and r["end_word"] - r["start_word"] >= 50
    exact = [r for r in out if r["doc_id"] == 200]
    assert [(r["start_word"], r["end_word"], r["source_doc_id"]) for r in exact] == [(0, 150, 3)]
    assert substring.near_passages(frame(spark, [])).count() == 0


def test_salted_and_plain_signatures_agree(spark, monkeypatch):
    rng = random.Random(4)
    shared = prose(rng, 90, 5000)
    rows = [(k, f"{prose(rng, 20 + k, 5000)} {shared} {prose(rng, 20, 5000)}") for k in range(12)]

    def found():
        """The passages of each document that lie in no other one."""
        spans = {(r["doc_id"], r["start_word"], r["end_word"]) for r in substring.near_passages(frame(spark, rows)).collect() if r["source_doc_id"] < r["doc_id"]}
        return sorted(x for x in spans if not any(x != y and x[0] == y[0] and y[1] <= x[1] and x[2] <= y[2] for y in spans))

    plain = found()
    monkeypatch.setattr(substring, "FREQUENT_IN", 2)
    assert found() == plain and len(plain) == 11
    assert frame(spark, rows).filter(F.col("text").isNull()).count() == 0


def test_passages_of_either_length_and_order_are_found():
    import numpy as np

    fresh = iter(range(1, 1 << 20))
    new = lambda n: [next(fresh) for _ in range(n)]

    def shingles(words):
        return np.array([hash(tuple(words[i : i + 5])) & (2**63 - 1) for i in range(len(words) - 4)], np.uint64)

    def found(a, b):
        a, b = shingles(a), shingles(b)
        return substring.passages(a, b, 0, len(b), 46, 0.8)

    p, q = new(100), new(100)
    short = new(50)
    inserted = short[:25] + new(2) + short[25:]  # 42 common shingles of 46 and 48
    got = found(new(30) + short + new(30), new(20) + inserted + new(20))
    assert [(s, e, x, y) for s, e, x, y, _ in got] == [(20, 68, 30, 76)] and got[0][4] == 42 / 52
    for a in (new(20) + p + new(300) + q + new(20), new(20) + q + p + new(20), new(20) + q + new(7) + p):
        got = found(a, new(15) + p + q + new(15))
        mark = np.zeros(226, bool)
        for s, e, _, _, similarity in got:
            mark[s:e] = True
            assert similarity >= 0.8
        assert mark[15:111].all() and mark[115:211].all() and not mark[:15].any() and not mark[215:].any()
    # A dense passage whose scattered surroundings match too.
    a = p + q
    b = p + [w for k in range(10) for w in [*q[10 * k : 10 * k + 6], *new(2)]]
    assert any(s <= 2 and e >= 94 for s, e, *_ in found(a, b))


@pytest.mark.parametrize(("salt", "batch"), [(-1, 1000), (-1, 2), (5, 2)])
def test_all_windows_of_a_first_document_bound_where_to_look(spark, salt, batch):
    rows = [(7, salt, 1, 11, 0, 60), (7, salt, 1, 11, 190, 276), (7, salt, 1, 11, 290, 340), (7, salt, 2, 22, 5, 66), (8, salt, 2, 22, 0, 50), (8, salt, 3, 33, 1, 51)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    dealt = spark.createDataFrame([(*x, 0) for x in rows], substring.WINDOWS).coalesce(1).sortWithinPartitions("sig", "salt", "doc_id", "th", "l")
    found = substring.stars(dealt).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    others = [(r["sig"], r["a_doc"], r["al"], r["ar"], r["b_doc"], r["l"], r["r"]) for r in found if r["a_doc"] != r["b_doc"]]
    assert sorted(others) == [(7, 1, 0, 340, 2, 5, 66), (8, 2, 0, 50, 3, 1, 51)]
    own = [(r["l"], r["r"]) for r in found if r["a_doc"] == r["b_doc"]]
    assert sorted(own) == ([(0, 50), (0, 60), (190, 276), (290, 340)] if salt >= 0 else [])


@pytest.mark.parametrize("batch", [1000, 2])
def test_windows_meet_those_with_the_same_surroundings(spark, batch):
    """Documents 3 and 5 share what lies before, 4 and 6 what lies behind; the first of the signature is another one."""
    sides = {1: (0, 0), 3: (5, 1), 4: (2, 9), 5: (5, 3), 6: (4, 9), 7: (0, 8)}
    rows = [(7, -1, d, 10 * d, d, 50 + d, s << 16 | z) for d, (s, z) in sides.items()] + [(8, -1, 6, 60, 0, 60, 5 << 16 | 9)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    found = substring.stars(spark.createDataFrame(rows, substring.WINDOWS).coalesce(1).sortWithinPartitions("sig", "salt", "doc_id", "th", "l")).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r["a_doc"], r["b_doc"], r["al"], r["l"]) for r in found) == [(1, 3, 1, 3), (1, 4, 1, 4), (1, 5, 1, 5), (1, 6, 1, 6), (1, 7, 1, 7), (3, 5, 3, 5), (4, 6, 4, 6)]


def test_passages_are_found_whose_parts_were_known_before(spark):
    """Texts that hold one half each come first; the whole is held by two later texts."""
    rng = random.Random(9)
    rows, want = [], set()
    for k in range(40):
        one, two = prose(rng, 40, 5000), prose(rng, 40, 5000)
        around = lambda t: f"{prose(rng, 25, 5000)} {t} {prose(rng, 25, 5000)}"
        rows += [(4 * k, around(one)), (4 * k + 1, around(two)), (4 * k + 2, around(f"{one} {two}")), (4 * k + 3, around(f"{one} {two}"))]
        want.add((4 * k + 3, 4 * k + 2))
    found = {(r["doc_id"], r["source_doc_id"]) for r in substring.near_passages(frame(spark, rows)).collect()}
    assert len(found & want) >= 38


def test_recall_of_passages_at_every_similarity(spark):
    """Against the exact similarity of planted passages: of those at 0.8 or more nearly all are found, none below."""
    rng = random.Random(12)
    rows, planted = [], {}
    for k in range(120):
        p = prose(rng, 120, 5000).split()
        q = list(p)
        for _ in range(rng.randint(0, 4)):
            q[rng.randrange(len(q))] = f"new{k}x{rng.randrange(99)}"
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (p, q)]
        planted[k] = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        rows += [(2 * k, f"{prose(rng, 30, 5000)} {' '.join(p)} {prose(rng, 9, 5000)}"), (2 * k + 1, f"{prose(rng, 12, 5000)} {' '.join(q)} {prose(rng, 40, 5000)}")]
    found = {r["doc_id"] // 2 for r in substring.near_passages(frame(spark, rows)).collect()}
    near = {k for k, s in planted.items() if s >= 0.8}
    assert len(near) > 60 and len(near & found) >= 0.98 * len(near)


@pytest.mark.parametrize("long", [32, 2])
def test_passages_are_found_whose_signatures_others_held_before(spark, monkeypatch, long):
    """Passages of phrases that earlier texts hold one by one, with surroundings of their own: no first of a signature is near."""
    monkeypatch.setattr(substring, "LONG", long)
    rng = random.Random(31)
    rows, want = [], set()
    for k in range(30):
        parts = [prose(rng, 30, 5000).split() for _ in range(3)]
        around = lambda t: f"{prose(rng, 25, 5000)} {t} {prose(rng, 25, 5000)}"
        # Each of these holds two neighbouring phrases' words around their meeting, and less than 50 words of the passage.
        known = [parts[0], parts[1], parts[2], parts[0][15:] + parts[1][:15], parts[1][15:] + parts[2][:15]]
        rows += [(10 * k + i, around(" ".join(x))) for i, x in enumerate(known)]
        rows += [(10 * k + i, around(" ".join(sum(parts, [])))) for i in (8, 9)]
        want.add((10 * k + 9, 10 * k + 8))
    found = {(r["doc_id"], r["source_doc_id"]) for r in substring.near_passages(frame(spark, rows)).collect()}
    assert want <= found


def test_long_lists_leave_no_words_out():
    """Every word that a comparison with any stretch before covers is covered by those that long_list() names."""
    import numpy as np

    rng = np.random.default_rng(3)
    phrases = [rng.integers(1, 1 << 60, 30).astype(np.uint64) for _ in range(8)]
    tokens = []
    for _ in range(40):
        x = np.concatenate([phrases[i] for i in rng.choice(8, 3, replace=False)])
        x[rng.integers(0, 90, 6)] = rng.integers(1, 1 << 60, 6)
        tokens.append(x)

    def words(pairs):
        return {(b, w) for a, b in pairs for s, e, *_ in substring.passages(tokens[a], tokens[b], 0, 90, 46, 0.8) for w in range(s, e)}

    named = [(int(a), int(b)) for x, y in substring.long_list(tokens, 46, 0.8) for a, b in zip(x, y, strict=True)]
    shared = lambda pairs: {(b, w) for b, w in words(pairs) if sum(tokens[b][w] in t for t in tokens) > 1}
    every = [(a, b) for b in range(40) for a in range(b)]
    assert shared(named) == shared(every) and 0 < len(named) < len(every) / 4


def test_texts_meet_all_with_all_on_two_signatures(spark):
    """Three texts with other tokens around: stars() gives no pair of the second and third."""
    boxes = [(sig, -1, d, 10 * d, 0, (60 + d) << 32, 30, 0, 7 * d) for d in (1, 2, 3) for sig in (8, 17)] + [(24, -1, 2, 20, 0, 60 << 32, 30, 0, 5)]
    kept = substring.shared(spark.createDataFrame(boxes, substring.BOXES).coalesce(1).sortWithinPartitions("sig", "salt"))
    met = substring.meetings(kept.sortWithinPartitions("doc_id", "th", "l"), 46)
    found = substring.pairs_of(met.sortWithinPartitions("sigs", "body", "doc_id", "th")).collect()
    assert sorted((r["a_doc"], r["b_doc"]) for r in found) == [(1, 2), (1, 3), (2, 3)]
    windows = spark.createDataFrame([(8, -1, d, 10 * d, 0, 60 + d, d << 16 | d) for d in (1, 2, 3)], substring.WINDOWS)
    assert (2, 3) not in {(r["a_doc"], r["b_doc"]) for r in substring.stars(windows.coalesce(1).sortWithinPartitions("sig", "salt", "doc_id", "th", "l")).collect()}


def test_copies_in_many_long_lists_are_compared_once(spark):
    """40 copies share 10 pairs of signatures: one list, not 10; its stretches bound those of all."""
    met = [(sigs, d, 10 * d, (3 + k) << 32, (90 - k) << 32, 7 * d + sigs) for k, sigs in enumerate(range(100, 110)) for d in range(1, 41)]
    met += [(200, d, 10 * d, 5000 << 32, 5060 << 32, d) for d in range(1, 41)]  # elsewhere in the same texts
    found = substring.pairs_of(spark.createDataFrame(met, substring.MEETINGS).coalesce(1).sortWithinPartitions("sigs", "body", "doc_id", "th"))
    own = found.filter("a_doc = b_doc").groupBy("sigs").agg(F.countDistinct("b_doc").alias("n"), F.min(F.shiftright("low", 32)).alias("low"), F.max(F.shiftright("high", 32)).alias("high"))
    assert sorted((r["n"], r["low"], r["high"]) for r in own.collect()) == [(40, 3, 90), (40, 5000, 5060)]


def test_parts_of_a_long_list_name_what_the_whole_does():
    import numpy as np

    rng = np.random.default_rng(5)
    one, two = (rng.integers(1, 1 << 60, 70).astype(np.uint64) for _ in range(2))
    tokens = []
    for k in range(60):
        x = np.concatenate([one, two] if k % 2 else [two, rng.integers(1, 1 << 60, 20).astype(np.uint64)])
        x[rng.integers(0, len(x), 4)] = rng.integers(1, 1 << 60, 4)
        tokens.append(x)
    tokens += [np.concatenate([one[:9], rng.integers(1, 1 << 60, 60).astype(np.uint64)]) for _ in range(30)]  # around a phrase
    alive = substring.with_partners([np.unique(t) for t in tokens], 37)[0]
    assert alive.tolist() == [k < 60 for k in range(90)]
    named = lambda *part: {(a, b) for x, y in substring.long_list(tokens, 46, 0.8, *part) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert named() == named(0, 3) | named(1, 3) | named(2, 3) and len(named()) >= 59


def test_copies_with_too_many_other_words_are_not_compared(monkeypatch):
    """Passages with a token left over are only where aligned_cover() says, also with words put in or out and repeats; and copies
    of which 85 of 100 tokens match, spread evenly, are left alone though one text's tokens could be few enough."""
    import numpy as np

    rng = np.random.default_rng(11)
    new = lambda n: rng.integers(1, 1 << 60, n).astype(np.uint64)
    asked, found = 0, 0
    for k in range(400):
        a = new(140)
        if k % 3 == 0:
            a[rng.integers(0, 140, 4)] = a[7]
        b = a.copy()
        changed = rng.choice(140, rng.integers(5, 35), replace=False)
        b[changed] = new(len(changed))
        if k % 4 == 0:
            b = np.delete(np.insert(b, rng.integers(0, 140, 2), new(2)), rng.integers(0, 130, rng.integers(0, 6)))
        order = np.argsort(a, kind="stable")
        at = np.minimum(np.searchsorted(a[order], b), 139)
        match, off = a[order][at] == b, order[at] - np.arange(len(b))
        left = np.zeros(len(b), bool)
        left[rng.integers(0, len(b), 3)] = True
        repeats = 140 - len(np.unique(a)) + len(b) - len(np.unique(b))
        may = substring.aligned_cover(match, off, substring.may_cover(match, 46, 0.8), left, repeats, 46, 0.8)
        reported = any(left[s:e].any() for s, e, *_ in substring.passages(a, b, 0, len(b), 46, 0.8))
        assert may or not reported
        asked, found = asked + may, found + reported
    assert 20 < found <= asked < 360
    base = new(100)
    copies = []
    for k in range(20):
        copies.append(base.copy())
        copies[-1][np.arange(k % 7, 100, 7)] = new(len(range(k % 7, 100, 7)))
    calls, real = [], substring.passages
    monkeypatch.setattr(substring, "passages", lambda *x: calls.append(1) or real(*x))
    for b in range(1, 7):  # each with those before: 6 of 7 tokens are its own and the other has none more
        list(substring.long_list([copies[0], copies[b]], 46, 0.8))
    assert len(calls) == 0 and not any(real(copies[0], copies[b], 0, 100, 46, 0.8) for b in range(1, 7))


def test_parts_of_a_long_list_are_bounded(spark, monkeypatch):
    """Each part has all rows of its list, so their number must not grow with the square of a group of copies."""
    monkeypatch.setattr(substring, "PART", 2)
    rng = random.Random(3)
    base = prose(rng, 90, 5000)
    rows = [(7, k, 10 * k, 0, 0, f"{base} own{k}".encode()) for k in range(60)]
    members = spark.createDataFrame(rows, "sigs bigint, doc_id bigint, th bigint, low bigint, high bigint, text binary").coalesce(1)
    dealt = substring.dealt_stretches(members, 46, 0.8)
    assert dealt.count() == 60 * substring.PARTS and {r["parts"] for r in dealt.select("parts").distinct().collect()} == {substring.PARTS}


def test_tables_of_the_join_leave_no_shuffle_files(spark, monkeypatch):
    name, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before, write = spark.conf.get(name, "false"), jaccard_join.Scratch.__call__
    monkeypatch.setattr(jaccard_join.Scratch, "__call__", lambda *x: seen.append(spark.conf.get(name, "false")) or write(*x))
    assert jaccard_join.similarity_classes(frame(spark, [(1, "a b c d e"), (2, "a b c d e")])).count() == 2
    assert set(seen) == {"true"} and spark.conf.get(name, "false") == before
