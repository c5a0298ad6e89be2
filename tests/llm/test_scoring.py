"""Decontamination, toxicity and pseudonyms against brute force, round trips and held-out labels."""

import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pigeonhole.llm import decontaminate, pii, toxicity
from pigeonhole.llm.automaton import LexiconAutomaton, tolerance

WORDS = [f"v{i}" for i in range(900)]


def test_overlaps_equal_containment(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(docs, items).collect()}
    assert got == {(d.doc_id, b.item_id) for d in docs.collect() for b in items.collect() if b.text.lower() in d.text.lower()}


def test_overlaps_bear_substitutions(spark):
    rng = random.Random(3)
    prose = lambda n: [rng.choice(WORDS) for _ in range(n)]
    item, short, tiny = prose(40), prose(11), prose(4)
    changed = [w if i % 9 != 4 else "x" for i, w in enumerate(item)]
    items = [(1, " ".join(item)), (2, " ".join(item)), (3, " ".join(short)), (4, " ".join(tiny)), (5, None), (6, ""), (None, " ".join(prose(20)))]
    docs = {10: prose(30) + item + prose(30), 11: prose(30) + changed, 12: [w.upper() + "." for w in short], 13: prose(5) + tiny + prose(5), 14: item[:11] + prose(20), 15: item[20:34], 16: prose(60)}
    rows = [(d, " ".join(t), "a") for d, t in docs.items()] + [(17, None, "a"), (None, " ".join(item), "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_overlaps(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(10, 1), (11, 1), (12, 3), (13, 4), (15, 1)}
    assert (got[10, 1].doc_start, got[10, 1].words, got[10, 1].agreeing, got[10, 1].same_items) == (30, 40, 40, 2)
    assert 31 <= got[11, 1].agreeing <= sum(a == b for a, b in zip(item, changed))  # ends that a substitution outweighs are left off
    assert decontaminate.drop_contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).count() == 4
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_overlaps(frame, none).count() == 0
    assert decontaminate.find_overlaps(frame.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_short_items_bear_substitutions_anywhere(spark):
    rng = random.Random(9)
    word = lambda: f"v{rng.randrange(10**6)}"
    items, docs, due = [], [], set()
    for n in range(150):
        item = [word() for _ in range(rng.randrange(12, 25))]
        copy = list(item)
        for i in rng.sample(range(len(item)), rng.randrange(1, 4)):
            copy[i] = word()
        same = [a == b for a, b in zip(item, copy)]
        spans = [same[i:j] for i in range(len(same)) for j in range(i + 1, len(same) + 1)]
        most = max([sum(x) for x in spans if sum(x) > 4 * (len(x) - sum(x))], default=0)
        seen = any(all(same[k + i] for i, c in enumerate(mask) if c == "1") for mask in decontaminate.MASKS.values() for k in range(len(same) - 10))
        if most >= 12 and seen:
            due.add((n, n, most))
        items.append((n, " ".join(item)))
        docs.append((n, " ".join([word() for _ in range(30)] + copy + [word() for _ in range(30)])))
    assert len(due) > 60
    got = decontaminate.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.agreeing) for r in got.collect()} == due


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abcd", min_size=3, max_size=10), st.booleans()), min_size=1, max_size=5, unique_by=lambda t: t[0]), st.text("abcdx", max_size=13))
def test_automaton_equals_edit_distance(terms, word):
    best = {}
    for k, (term, stem) in enumerate(terms):
        away = min(distance(term, word[:n]) for n in range(len(word) + 1)) if stem else distance(term, word)
        if away <= tolerance(term):
            best[k] = away
    fewest = min(best.values(), default=0)
    close = [k for k in best if best[k] == fewest]
    longest = max((len(terms[k][0]) for k in close), default=0)
    assert sorted(LexiconAutomaton(terms).matches(word)) == sorted((k, fewest) for k in close if len(terms[k][0]) == longest)


def labelled(spark, n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(40)]
        if bad := i % 4 == 0:
            words[rng.randrange(40)] = rng.choice(["wretched", "wretchedly", "buffoon"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, 0, int(bad)))
    return rows, labels


def test_scores_held_out_and_misspelled(spark):
    rows, labels = labelled(spark)
    clean = " ".join(WORDS[:20])
    rows += [(1000, f"{clean} buffoon {clean}", "x"), (1001, f'{clean} "what a buffoon" he wrote {clean}', "x"), (1002, "", "x"), (1003, None, "x"), (None, "buffoon", "x"), (1000, "again", "x")]
    labels += [(None, 1, 1), (5, 1, None), (7777, 1, 1)]
    frame, known = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [(r.doc_id, r.held_out, r.score, r.predicted) for r in toxicity.score_documents(frame, known).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, _, s, _ in got)
    by = {d: (s, p) for d, _, s, p in got if d is not None and d != 1000}
    assert all(by[i][1] == int(i % 4 == 0) for i in range(400))
    assert by[1001][1] == 0 and by[1002][1] == by[1003][1] == 0
    assert {p for d, _, _, p in got if d == 1000} == {0, 1} and [p for d, _, _, p in got if d is None] == [1]
    kept = toxicity.drop_toxic(frame, known)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i in range(400) if i % 4} | {1000, 1001, 1002, 1003}
    none = toxicity.score_documents(frame, known.limit(0)).collect()
    assert {r.predicted for r in none} == {0} and toxicity.score_documents(frame.limit(0), known).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    rows, labels = labelled(spark)
    import zlib
    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
    frame = spark.createDataFrame(rows, "doc_id long, text string, x string")
    score = lambda ls: sorted((r.doc_id, r.score) for r in toxicity.score_documents(frame, spark.createDataFrame(ls, "doc_id long, quality int, toxic int")).collect())
    assert score(labels) == score(turned)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 300))
def test_feistel_is_a_permutation(size):
    network = pii.Feistel(b"key")
    images = [network.permute("x", v, size) for v in range(size)]
    assert sorted(images) == list(range(size)) and [network.permute("x", v, size, back=True) for v in images] == list(range(size))


def card(rng):
    head = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return head + pii.luhn_digit(head)


def test_pseudonyms_keep_formats_and_links(spark):
    rng = random.Random(6)
    number, when, spaced = card(rng), "2023-02-28", "4111 1111 1111 1111"
    values = [("card", number), ("card", spaced), ("phone", "+1 (988) 555-2485"), ("phone", "+49 170 1234567"), ("ssn", "123-45-6789"), ("ip", "70.123.182.155"), ("date", when), ("date", "31.12.1999"), ("date", "12/31/1999"), ("iban", "DE89 3704 0044 0532 0130 00"), ("email", "bosbt.42@mail8.example.com")]
    names = pii.Pseudonyms(b"k")
    for kind, value in values:
        text = f"von {value}, und"
        new, found = names.rewrite(text)
        assert found == [(kind, 4, 4 + len(value))], (kind, value, found)
        again, same = names.rewrite(new)
        assert new != text and [k for k, *_ in same] == [kind]
        assert names.rewrite(new, back=True)[0] == text
        assert names.rewrite(f"x {value} y {value}")[0].count(new[4:-5]) == 2
    bad = ["4111111111111112", "2023-02-30", "300.1.1.1", "000-12-3456", "1.2.3.4.5", "v1.2", "12345", "2024-13-01", "DE88 3704 0044 0532 0130 00"]
    for text in bad:
        assert names.rewrite(text) == (text, []), text
    day = names.date("2023-02-28")
    assert datetime.date.fromisoformat(day) and pii.Pseudonyms(b"other").date("2023-02-28") != day

    rows = [(1, f"a {number}", 9), (2, f"b {number} {when}", 9), (3, None, 9), (4, "", 9), (None, "plain text", 9), (1, f"a {number}", 9)]
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, replaced int"), "k").collect()
    texts = {r.doc_id: r.text for r in got}
    assert len(got) == 6 and texts[3] is None and texts[4] == "" and texts[None] == "plain text"
    assert texts[1].split()[1] == texts[2].split()[1] != number
    back = pii.pseudonymise(spark.createDataFrame([(r.doc_id, r.text) for r in got], "doc_id long, text string"), "k", back=True).collect()
    assert sorted([(r.doc_id, r.text) for r in back], key=repr) == sorted([(d, t) for d, t, _ in rows], key=repr)


@settings(max_examples=200, deadline=None)
@given(st.text("0123456789 .-/@aZ()+", max_size=60))
def test_replaced_spans_are_in_order_and_apart(text):
    new, found = pii.Pseudonyms(b"k").rewrite(text)
    assert all(a < b for _, a, b in found) and all(x[2] <= y[1] for x, y in zip(found, found[1:]))
    assert found or new == text


def test_no_letter_of_a_long_name_stays(spark):
    """Every letter of a name of 200 letters changes as often as chance has it, in either half."""
    names = pii.Pseudonyms(b"k")
    rng = random.Random(1)
    for length in (100, 150, 200, 400):
        kept = [0] * length
        for _ in range(30):
            name = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(length))
            new = names.email(name, "@x.org").removesuffix("@x.org")
            assert len(new) == length and names.email(new, "@x.org", back=True) == name + "@x.org"
            for i, (a, b) in enumerate(zip(name, new)):
                kept[i] += a == b
        assert max(kept) <= 10 and sum(kept) < 30 * length / 10


def test_long_texts_are_rewritten_in_one_pass(spark):
    import time

    names = pii.Pseudonyms(b"k")
    line = "write to someone.else@mail.example.com or call 415-555-0123, not a1@b.co; born 2001-02-03. "
    start = time.time()
    new, found = names.rewrite(line * 20_000)
    assert time.time() - start < 60 and len(found) == 80_000 and names.rewrite(new, back=True)[0] == line * 20_000
    empty = pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), "k")
    assert empty.count() == 0


def test_addresses_and_numbers_do_not_meet():
    names = pii.Pseudonyms(b"k")
    for text in ("4111111111111111@x.org 4111111111111111", "a@1.2.3.4.com 1.2.3.4", "x@y.org,2001-02-03 z@y.org", "2001-02-03@y.org"):
        new, found = names.rewrite(text)
        spans = sorted((a, b) for _, a, b in found)
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:])) and names.rewrite(new, back=True)[0] == text
