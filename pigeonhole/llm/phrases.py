"""Phrase collocations from an FM-index per shard over word ids.

A shard is a bounded run of texts of one language in a task. Its words become ids, and two word indexes (of the sequence and
of its reverse, sorted as deep as the longest phrase) let intervals of phrases grow by a word on either side: the symbols
before an interval's rows and their numbers are the extensions with their counts. The counts of all shards are summed by
phrase. One pass over the corpus is made for each phrase length; words and shorter phrases that are too rare to be part of a
candidate are left out of later passes by a bit map of fixed size, which may let some rare ones through but never stops a
frequent one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, row_chunks, small_batches
from .shingles import ODD, mixed

SHARD_BYTES = 6 << 20  # of text
MAP_BITS = 25  # a bit map of 4 MB, whatever the corpus
SALTS = 64
LEAST_SHARE = 50  # percent of a phrase's occurrences inside a longer one from which the longer one stands for it
BYTES = np.arange(256, dtype=np.uint8)
BYTES[65:91] += 32
BYTES[9] = 32
for _mark in b".,;:!?\n\x0b\x0c\r":
    BYTES[_mark] = 10  # a piece ends


def word_sequence(texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Distinct words (the n-th has id n + 1) and the ids of all words in order; 0 stands between pieces and at both ends."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = BYTES[np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    # Nothing that has a place for each byte is wider than a byte; numbers are made for words only.
    framed = np.zeros(len(raw) + 2, bool)
    inside = framed[1:-1]
    np.not_equal(raw, 32, out=inside)
    inside &= raw != 10
    begins, ends = np.flatnonzero(framed[1:] & ~framed[:-1]), np.flatnonzero(framed[:-1] & ~framed[1:])
    # A text that ends in a word may be followed by one that begins with a word: cut there.
    joints = np.unique(offsets[1:-1] - offsets[0])
    joints = joints[(joints > 0) & (joints < len(raw))]
    joints = joints[inside[joints] & inside[joints - 1]]
    begins, ends = np.sort(np.concatenate([begins, joints])), np.sort(np.concatenate([ends, joints]))
    if not len(begins):
        return [], np.zeros(1, np.int64)
    lengths = np.concatenate([[0], np.cumsum(ends - begins)])
    words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(lengths.astype(np.int64)), pa.py_buffer(raw[inside])).dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(raw == 10), begins)
    text = np.searchsorted(offsets - offsets[0], begins, "right")
    ids = words.indices.to_numpy().astype(np.int64) + 1
    broken = np.flatnonzero((np.diff(piece) != 0) | (np.diff(text) != 0)) + 1
    return words.dictionary.to_pylist(), np.concatenate([[0], np.insert(ids, broken, 0), [0]])


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Places of the keys (not below 0) in ascending order, equal ones as they stand: key and place are sorted as one number where they fit."""
    bits = max(len(keys) - 1, 1).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + bits > 63:
        return np.argsort(keys, kind="stable")
    both = keys << bits | np.arange(len(keys))
    both.sort()
    return both & ((1 << bits) - 1)


class Half:
    """One direction of the index: rows are the places of the sequence, sorted by the ``depth`` symbols from there on.

    For phrases up to that depth the intervals are those of the whole order, whichever way equal rows are sorted. ``before``
    is the symbol before each row (the transform), ``lf`` the row of that symbol.
    """

    def __init__(self, ids: np.ndarray, symbols: int, depth: int):
        self.symbols = symbols
        key, width = ids.copy(), symbols
        for d in range(1, depth):
            if width > 2**62 // symbols:
                values, key = np.unique(key, return_inverse=True)
                width = len(values)
            key *= symbols
            key += np.roll(ids, -d)
            width *= symbols
        self.before = ids[np.argsort(key) - 1]
        del key
        self.lf = np.empty(len(ids), np.int64)
        self.lf[stable_order(self.before)] = np.arange(len(ids))

    def extend(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Every symbol before the rows of every interval: the interval it extends, the symbol, the new interval's first row,
        its rows, and how many rows of the old interval have a smaller symbol."""
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(owner)) + np.repeat(low - begin, size)
        key = owner * self.symbols + self.before[rows]
        order = stable_order(key)
        key = key[order]
        fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(rows) else np.zeros(0, np.int64)
        count = np.diff(np.append(fresh, len(rows)))
        of, symbol = key[fresh] // self.symbols, key[fresh] % self.symbols
        return of, symbol, self.lf[rows[order[fresh]]], count, fresh - begin[of]


class WordIndex:
    """Bidirectional index of a sequence of word ids (0 is no word)."""

    def __init__(self, ids: np.ndarray, symbols: int, depth: int):
        self.ids, self.symbols, self.depth = ids, symbols, depth

    @cached_property
    def ahead(self) -> Half:
        return Half(self.ids, self.symbols, self.depth)

    @cached_property
    def back(self) -> Half:
        return Half(self.ids[::-1], self.symbols, self.depth)

    def words(self) -> tuple[np.ndarray, ...]:
        """Phrases of one word: ids as a column, rows in either order (equal for one symbol), counts."""
        counts = np.bincount(self.ids, minlength=self.symbols)
        found = np.flatnonzero(counts[1:]) + 1
        low = (np.cumsum(counts) - counts)[found]
        return found[:, None], low, low, counts[found]

    def grow(self, phrases: np.ndarray, low: np.ndarray, low_back: np.ndarray, count: np.ndarray, left: bool) -> tuple[np.ndarray, ...]:
        """All extensions by one word on the left (or right) of the given phrases, with both intervals kept in step."""
        half, own, other = (self.ahead, low, low_back) if left else (self.back, low_back, low)
        of, symbol, first, n, smaller = half.extend(own, count)
        kept = symbol > 0
        of, symbol, first, n, smaller = of[kept], symbol[kept], first[kept], n[kept], smaller[kept]
        other = other[of] + smaller
        grown = np.hstack([symbol[:, None], phrases[of]] if left else [phrases[of], symbol[:, None]])
        return (grown, first, other, n) if left else (grown, other, first, n)


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of words, after that of id 0."""
    return np.array([0, *(xxhash.xxh3_64_intdigest(w) for w in words)], np.uint64)


def phrase_hashes(words: np.ndarray, lang: str) -> np.ndarray:
    """Hashes of phrases from those of their words, one phrase a row."""
    total = np.full(len(words), xxhash.xxh3_64_intdigest(lang), np.uint64)
    for k in range(words.shape[1]):
        total += words[:, k] * ODD[k]
    return mixed(total + ODD[60 - words.shape[1]])


def allowed(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64((1 << MAP_BITS) - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def shard_phrases(texts: pa.Array, lang: str, length: int, maps: list[np.ndarray]) -> tuple[pa.Array, np.ndarray, int]:
    """Phrases of ``length`` words in one shard whose shorter parts may all be frequent: text and count; and the shard's words."""
    words, ids = word_sequence(texts)
    own = word_hashes(words)
    names, all_words = pa.array(words, pa.string()), int(np.count_nonzero(ids))
    if length > 1 and len(words):
        good = np.concatenate([[False], allowed(phrase_hashes(own[1:, None], lang), maps[0])])
        ids = np.where(good[ids], ids, 0)
        ids = ids[(ids > 0) | np.concatenate([[True], ids[1:] != ids[:-1]])]  # one 0 for any number
    index = WordIndex(ids, len(words) + 1, length)
    found = index.words()
    for n in range(2, length + 1):
        left = n % 2 == 0
        found = index.grow(*found, left)
        rest = found[0][:, :-1] if left else found[0][:, 1:]  # the other part that is one word shorter; the grown one was tested before
        kept = allowed(phrase_hashes(own[rest], lang), maps[n - 2])
        if n < length:
            kept &= allowed(phrase_hashes(own[found[0]], lang), maps[n - 1])
        found = tuple(x[kept] for x in found)
    phrases = found[0]
    columns = [names.take(pa.array(phrases[:, k] - 1)) for k in range(length)]
    texts_of = pc.binary_join_element_wise(*columns, " ") if length > 1 else columns[0]
    return texts_of, found[3], all_words


COUNTS = "lang string, phrase string, f long"


def phrase_counts(docs: DataFrame, length: int, maps: list[np.ndarray]) -> DataFrame:
    """Counts of phrases of ``length`` words over all shards; with length 1 also, as a null phrase, the words of each language."""
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0

        def index() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                phrases, counts, words = shard_phrases(pa.chunked_array(texts), lang, length, maps)
                if length == 1 and words:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.string()), pa.array([words])], ["lang", "phrase", "f"])
                for lo in range(0, len(phrases), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    p = phrases[part]
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(p)), p.cast(pa.string()), pa.array(counts[part])], ["lang", "phrase", "f"])

        for batch in batches:
            at = 0
            for part in row_chunks(batch["text"]):
                langs = batch["lang"].slice(at, len(part))
                at += len(part)
                for lang in pc.unique(langs).to_pylist():
                    held.setdefault(lang, []).append(part.filter(pc.equal(langs, lang)))
                size += pc.sum(pc.binary_length(part)).as_py() or 0
                if size >= SHARD_BYTES:
                    yield from index()
                    held, size = {}, 0
        yield from index()

    return docs.mapInArrow(convert, COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def bit_map(frequent: DataFrame, length: int) -> np.ndarray:
    """One bit for each phrase of ``length`` words, gathered as at most 2 ** MAP_BITS / 64 words of 64 bits."""
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for lang in pc.unique(batch["lang"]).to_pylist():
                words = pc.split_pattern(batch["phrase"].filter(pc.equal(batch["lang"], lang)), " ").flatten().dictionary_encode()
                hashes = word_hashes(words.dictionary.to_pylist())[1:][words.indices.to_numpy()]
                places.append(phrase_hashes(hashes.reshape(-1, length), lang) & np.uint64((1 << MAP_BITS) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *places]).astype(np.int64))], ["place"])

    places = frequent.select("lang", "phrase").mapInArrow(convert, "place long")
    rows = places.groupBy(F.expr("cast(shiftright(place, 6) as int)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("w"))
    out, got = np.zeros((1 << MAP_BITS) // 64, "<i8"), rows.toArrow()
    out[got["at"].to_numpy()] = got["w"].to_numpy()
    return out.view(np.uint8)


def frequent_phrases(docs: DataFrame, most_words: int, least_count: int) -> list[DataFrame]:
    """Of each length the phrases with at least ``least_count`` occurrences, and of length 1 the languages' totals (null phrase)."""
    found, maps = [], []
    for length in range(1, most_words + 1):
        rows = cut(phrase_counts(docs, length, maps).where((F.col("f") >= least_count) | F.col("phrase").isNull()), f"phrases-{length}")
        found.append(rows)
        if length < most_words:
            maps.append(bit_map(rows.where("phrase is not null"), length))
    return found


def collocations(docs: DataFrame, most_words: int = 3, least_count: int = 10, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The strongest collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Words are lower-cased (A-Z) and separated by spaces and tabs; phrases of 2 to ``most_words`` words lie inside pieces, which
    punctuation and line ends close. ``a`` occurrences (at least ``least_count``) are set against those of the two parts at the
    cut that scores lowest, the first such cut. A phrase that half of the time lies in one longer candidate is left out. A
    null language is ``und``, a null text empty; texts without two words add to ``n`` only; repeated rows count each time. Ties
    go to the larger ``a``, then to the smaller phrase by bytes. No rows give no rows. Other columns are not read.
    """
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with small_batches(docs.sparkSession):
        by_length = frequent_phrases(docs, most_words, least_count)
    totals = by_length[0].where("phrase is null").select("lang", F.col("f").alias("n"))
    sized = [t.where("phrase is not null").select("lang", "phrase", "f", F.lit(k).alias("words")) for k, t in enumerate(by_length, 1)]
    every = reduce(DataFrame.unionByName, sized)
    candidates = reduce(DataFrame.unionByName, sized[1:])

    # The most that one longer phrase takes of a shorter one inside it.
    parts = F.expr(f"flatten(transform(sequence(2, {most_words}), s -> transform(sequence(1, greatest(words - s + 1, 1)), i -> struct(s as size, i as first))))")
    inner = F.expr("array_join(slice(split(longer, ' '), part.first, part.size), ' ')")
    longer = (candidates.withColumnRenamed("phrase", "longer").select("lang", "longer", "f", "words", F.explode(parts).alias("part")).where("part.size < words")
              .groupBy("lang", inner.alias("phrase")).agg(F.max("f").alias("within")))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("within") < LEAST_SHARE * F.col("f"), F.lit(True))).drop("within")

    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")})
    part = lambda name, count: every.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt", "rank")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
