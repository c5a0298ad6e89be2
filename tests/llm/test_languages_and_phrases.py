"""Collocations, language identification and importance resampling against brute force and held-out labels."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pigeonhole.llm import importance, langid, phrases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string"


# Phrases


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW))]


def plain_collocations(rows, most, least, top):
    counts = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for words in pieces(text):
            for n in range(1, most + 1):
                for i in range(len(words) - n + 1):
                    counts[lang or "und"][tuple(words[i:i + n])] += 1
    out = set()
    for lang, f in counts.items():
        all_words = sum(v for p, v in f.items() if len(p) == 1)
        candidates = {p: v for p, v in f.items() if len(p) > 1 and v >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * v >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, v in candidates.items()):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, all_words, -score))
    return out


def some_texts(seed, n, words="a b c d e ä Å x-y".split(), marks=(" ", " ", " ", "\t", ". ", "\n", ",")):
    r = random.Random(seed)
    return ["".join(r.choice(words) + r.choice(marks) for _ in range(r.choice((0, 1, 5, 40)))) for _ in range(n)]


@pytest.mark.parametrize("most", [2, 3, 4])
def test_collocations_equal_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 300)
    rows = [(i, t, (None, "en", "de")[i % 3]) for i, t in enumerate(some_texts(most, 120))] + [(None, None, "en"), (1, "", "fr"), (1, "a b. a b", "fr")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as f", "2 as phrase", "3 as rank").repartition(3)
    got = {tuple(r) for r in phrases.collocations(docs, most, 4, 25).collect()}
    assert got == plain_collocations([(t, lang) for _, t, lang in rows], most, 4, 25) and len(got) > 20


def test_no_texts_have_no_phrases(spark):
    empty = spark.createDataFrame([], DOCS)
    assert phrases.collocations(empty).count() == 0 and phrases.collocations(spark.createDataFrame([(1, "one", None), (2, None, "x")], DOCS)).count() == 0


def test_a_very_long_text_is_one_of_many(spark):
    long = "the cat sat. " * 40_000
    got = {r.phrase: (r.a, r.l, r.r, r.n) for r in phrases.collocations(spark.createDataFrame([(1, long, "en"), (2, "the cat", "en")], DOCS)).collect()}
    assert got == {"the cat sat": (40_000, 40_001, 40_000, 120_002)}  # "the cat" and "cat sat" lie inside it


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.integers(2, 4), st.randoms())
def test_intervals_grow_on_both_sides(ids, depth, r):
    ids = np.array([0, *ids, 0])
    index = phrases.WordIndex(ids, 5, depth)
    found = index.words()
    for n in range(2, depth + 1):
        found = index.grow(*found, r.random() < 0.5)
        want = collections.Counter(tuple(ids[i:i + n]) for i in range(len(ids) - n + 1) if ids[i:i + n].all())
        assert dict(zip(map(tuple, found[0].tolist()), found[3].tolist())) == want


def test_words_never_join_across_texts_and_pieces():
    words, ids = phrases.word_sequence(pa.array(["", "x", "One  one\ttwo.one", "x", None, "", "one\n\ntwo "]).fill_null(""))
    assert [words[i - 1] if i else "|" for i in ids] == "| x | one one two | one | x | one | two |".split()


def test_words_take_little_memory_beside_their_text():
    texts = pa.array(["The quick brown fox, it jumps\tover. A lazy dog sleeps!\n" * 2000] * 20)
    tracemalloc.start()
    phrases.word_sequence(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(texts[0].as_py()) * len(texts)


def test_texts_reach_the_index_in_small_batches(spark, monkeypatch):
    before, real, seen = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), phrases.frequent_phrases, []

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    def watched(docs, *rest):
        seen.extend(r.n for r in docs.mapInArrow(sizes, "n long").collect())
        return real(docs, *rest)

    monkeypatch.setattr(phrases, "frequent_phrases", watched)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('one two three, four five. ', 400) as text", "'en' as lang")
    assert phrases.collocations(docs).count()
    assert sum(seen) > 30_000_000 and max(seen) < 8_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


# Languages


def test_held_out_languages(spark):
    rows = langid.identify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    sure = [r for r in rows if r.certain]
    assert len(sure) >= 0.9 * len(rows) and sum(r.lang == r.lang_pred for r in sure) >= 0.99 * len(sure)


def test_odd_texts_and_labels(spark):
    texts = {"en": "the quick dog and the cat were in the house with a friend", "de": "der schnelle hund und die katze waren in dem haus mit einem freund"}
    rows = [(i, texts[lang] + f" {i}", lang) for i, lang in enumerate(["en", "de"] * 20)] + [(100, None, "en"), (101, "", "en"), (102, "12 .. ²½ !", "de"), (103, "THE HOUSE WITH THE DOG " * 20_000, None), (None, "das haus und die katze mit dem hund", "xx"), (104, "der hund und die katze", None), (104, "the dog and the cat", None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as lang_pred", "2 as score", "3 as held_out")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r.lang_pred)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert by_id[100] == by_id[101] == by_id[102] == ["und"] and by_id[103] == ["en"] and by_id[None] == ["de"] and sorted(by_id[104]) == ["de", "en"]
    assert {r.lang_pred for r in langid.rejected_as_unknown(langid.identify(docs)).where("not certain").collect()} == {"und"}


def test_no_languages_and_no_rows(spark):
    assert {(r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame([(1, "some words", None)], DOCS)).collect()} == {("und", 0.0)}
    assert langid.identify(spark.createDataFrame([], DOCS)).count() == 0


def test_held_out_labels_are_never_learned(spark):
    out = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "eins zwei drei", "a") for i in range(400) if i not in out] + [(i, "vier fünf sechs", "b") for i in out]
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame(rows, DOCS)).collect()} == {"a"}


# Importance


@settings(deadline=None, max_examples=40)
@given(st.lists(st.tuples(st.binary(min_size=1, max_size=90), st.binary(min_size=1, max_size=90)), min_size=1, max_size=8))
def test_pair_checksums(pairs):
    words = [w for p in pairs for w in p]
    own = np.array([zlib.crc32(w) for w in words], np.uint32)
    first, second = np.arange(0, len(words), 2), np.arange(1, len(words), 2)
    assert importance.pair_checksums(words, own, first, second).tolist() == [zlib.crc32(a + b" " + b) for a, b in pairs]


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_resample(docs, target, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *plain_features(t)) for i, t in docs]
    s = collections.Counter(bucket(f) for _, _, fs in own for f in fs)
    t = collections.Counter(bucket(f) for x in target for f in plain_features(x)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for i, n, fs in own:
        gain = [math.floor(1000 * math.log((t[bucket(f)] + 1) * all_s / ((s[bucket(f)] + 1) * all_t))) for f in fs]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = [(*r, k + 1) for k, r in enumerate(able[:percent * len(able) // 100])]
    return sorted([(*r[:4], r[5]) for r in drawn] + [(*r[:4], None) for r in able[len(drawn):]] + [(*r[:4], None) for r in rows if r[4] < least], key=repr)


def test_resampling_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(importance, "ROWS_A_TASK", 40)
    texts = some_texts(5, 200, "alpha Beta gamma über 12 x1".split(), (" ", "-", "_", ". ", "", "\n"))
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, "alpha beta " * 30, None), (None, None, None), (5, texts[5], None), (500, "", None), (501, "ßü " * 50_000, None)]
    target = ["alpha beta gamma", "12 alpha alpha beta", None, ""]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as weight", "2 as rank", "3 as part").repartition(5)
    items = spark.createDataFrame(list(enumerate(target)), "item_id bigint, text string")
    got = importance.resample(docs, items, 50, 25, 10).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == plain_resample([(i, t) for i, t, _ in rows], target, 50, 25, 10)


def test_resampling_without_rows(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id bigint, text string")
    assert importance.resample(none, items).count() == 0
    some = spark.createDataFrame([(i, "one two three four five", None) for i in range(8)], DOCS)
    assert sorted(r.rank for r in importance.resample(some, items, least_words=5).where("rank is not null").collect()) == [1, 2]
