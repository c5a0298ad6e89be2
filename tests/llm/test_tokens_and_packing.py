"""Token coding, token files and packing against the library and plain loops."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pigeonhole.llm import packing, tokenfiles, wordcode

ALPHABET = "aB cé\n\t'.,0１  　ΣσİÌ́<|>Ω中文 \x1c\x85 "
ROWS = [(5, "the word\nThe  word, said", "x"), (2, None, "x"), (9, "", None), (7, "a " * 5000, "y"), (3, "<|endoftext|> it's", "y"), (7, "tie", "y"), (None, "no id", None)]
SCHEMA = "doc_id long, text string, ids string"


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_coder_equals_library(name, spaced):
    coder = wordcode.WordCoder(wordcode.vocabulary(name), spaced, limit=40)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet=ALPHABET, max_size=25), max_size=4))
    def check(texts):
        got = [ids[p[i]:p[i + 1]].tobytes() for ids, p in coder.encode(pa.array(texts, pa.string())) for i in range(len(p) - 1)]
        assert got == [coder.whole(t) + wordcode.END for t in texts]

    check()


def encoded(name, text):
    return np.array([*np.frombuffer(wordcode.WordCoder(wordcode.vocabulary(name), True).whole(text or ""), "<u4"), 0], "<u4")


def test_token_files(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = tokenfiles.encode_round_trip(docs).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 2, 3, 5, 7, 7, 9]
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows])[:-1])
    want = sorted(zlib.crc32(encoded("byte_bpe_50k.json", t).tobytes()) for _, t, _ in ROWS)
    assert sorted(r.ids_crc32 for r in rows) == want


def test_shards_are_mapped(spark):
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(50)], "doc_id long, text string")
    folder = tokenfiles.new_folder(spark, "shards")
    shards = tokenfiles.write_token_files(docs, folder, wordcode.vocabulary("byte_bpe_50k.json"), shard_bytes=100).orderBy("shard").collect()
    assert len(shards) > 2 and [s.base for s in shards] == list(np.cumsum([0] + [s.tokens for s in shards])[:-1])
    shard = tokenfiles.Shard(shards[0].path, shards[0].width)
    assert isinstance(shard.ids, np.memmap) and shard.ids.dtype == np.uint16 and shard.offsets.dtype == np.uint64
    assert list(shard[0]) == list(encoded("byte_bpe_50k.json", "word 0"))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert tokenfiles.encode_round_trip(docs).count() == 0
    assert packing.pack(docs).count() == 0


def check_packed(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for parts in by.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(by)


def test_packing_places_every_piece(spark):
    docs = spark.createDataFrame(ROWS + [(100 + i, "word " * (i % 60), None) for i in range(400)], SCHEMA)
    rows = packing.pack(docs, max_tokens=64, with_ids=True).collect()
    used = check_packed(rows, 64)
    coder = wordcode.WordCoder(wordcode.vocabulary("word_bpe_49k.json"), False)
    texts = [t for _, t, _ in ROWS] + ["word " * (i % 60) for i in range(400)]
    assert sum(r.length for r in rows) == sum(len(coder.whole(t or "")) // 4 + 1 for t in texts)
    assert used <= 1.1 * sum(r.length for r in rows) / 64
    long = sorted((r for r in rows if r.doc_id == 7), key=lambda r: (r.length < 64, r.piece))
    assert [r.start for r in long if r.length == 64] == [64 * r.piece for r in long if r.length == 64]
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length for r in rows)
    whole = packing.sequences(packing.pack(docs, max_tokens=64, with_ids=True))
    assert whole.selectExpr("sum(octet_length(ids))").first()[0] == 4 * sum(r.length for r in rows)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(1, 9))
def test_plan_holds_each_piece_once(lengths, grain):
    histogram = np.bincount(lengths, minlength=41)
    groups = packing.plan_groups(histogram, grain=grain)
    seen = np.zeros(41, int)
    for parts, n in groups:
        assert sum(parts) <= 40
        for p in parts:
            seen[p] += n
    assert (seen == histogram).all()


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(3)
    histogram = np.bincount(rng.integers(1, 2049, 20_000), minlength=2049)
    groups = packing.plan_groups(histogram)
    assert sum(n for _, n in groups) <= 1.015 * (histogram * np.arange(2049)).sum() / 2048


def test_least_squares_is_optimal():
    rng = np.random.default_rng(1)
    columns = packing.patterns(24, 3)
    wanted = np.append(0, rng.integers(0, 50, 24)).astype(float)
    x = packing.fit_repeats(columns, wanted, 400)
    dense = np.array([np.bincount(c, minlength=25) for c in columns], float).T
    dense[0] = 0
    gradient = dense.T @ (dense @ x - wanted)
    assert (x >= 0).all() and gradient.min() > -1e-3 and abs(gradient @ x) < 1e-3 * max(1, x.sum())


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_special_strings_are_as_the_library_has_them(name, spaced):
    """The contract's call of the plain library, special tokens of the file left as it reads them."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(wordcode.vocabulary(name))
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "word", " ", "\n", ".", "<|", "endoftext|>", "é", "x<|endoftext|>y"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(8))) for _ in range(600)]
    coder = wordcode.WordCoder(wordcode.vocabulary(name), spaced, limit=50)
    got = [ids[a:b].tolist() for ids, at in coder.encode(pa.array(texts)) for a, b in zip(at, at[1:])]
    assert got == [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    text = wordcode.WordCoder(wordcode.vocabulary(name), spaced, special_as_text=True)
    library.encode_special_tokens = True
    got = [ids[a:b].tolist() for ids, at in text.encode(pa.array(texts)) for a, b in zip(at, at[1:])]
    assert got == [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_words_in_flat_arrays(monkeypatch):
    monkeypatch.setattr(wordcode.CodeTable, "RECENT", 7)
    table, want = wordcode.CodeTable(), {}
    rng = np.random.default_rng(2)
    for step in range(20):
        words = [f"w{step}-{i}" for i in range(5)]
        sizes = rng.integers(-1, 4, 5).astype(np.int32)
        ids = rng.integers(0, 99, int(np.maximum(sizes, 0).sum())).astype("<u4")
        table.add(*wordcode.digests(words), sizes, ids)
        ends = np.cumsum(np.maximum(sizes, 0))
        want.update({w: (int(n), ids[e - max(n, 0):e].tolist()) for w, n, e in zip(words, sizes, ends)})
    names = [*want, "missing"]
    known, start, size = table.find(*wordcode.digests(names))
    assert known.tolist() == [True] * len(want) + [False]
    assert all((int(n), table.ids[s:s + max(n, 0)].tolist()) == want[w] for w, s, n in zip(want, start, size))
