"""Benchmark decontamination by spaced-seed hashing.

Fixed masks hash some of the words in a window and ignore the others, so a replaced word leaves seeds intact. Documents keep
only the hits that pass a filter of fixed size (three bits of a bit map for each seed of the benchmark); a join by hash decides which are
seeds, and the words along each diagonal of a hit are then compared, substitutions allowed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, strings
from .shingles import WordHashes, runs

MASKS = {1: "11010011011", 2: "10110110101", 3: "11101000111"}  # windows of 11 words, of which 7 count; the first and last always do
SPAN = 11
LEAST_WORDS, SUBSTITUTION = 12, 4  # words that must agree (all of a shorter passage); what a replaced word costs against one that agrees
MAP_BITS = 22
PROBES = (np.uint64(0), np.uint64(21), np.uint64(42))  # three probes of the bit map
EDGES = "\"'“”„«»‘’`.,:;!?()[]{}<>*_-–—…"


class PlainWords(WordHashes):
    """Case and punctuation around a word don't count."""

    def key(self, word):
        return word.strip(EDGES) or word


def plain_words(text: str) -> list[str]:
    return text.lower().split()


def seeds_of(words: np.ndarray, short: list[int]) -> list[tuple[int, np.ndarray]]:
    """(mask, hash at every position); masks 100 + n read n words in a row, for passages of fewer words than a mask."""
    found = [(m, runs(words, [i for i, c in enumerate(mask) if c == "1"])) for m, mask in MASKS.items()]
    return found + [(100 + n, runs(words, list(range(n)))) for n in short]


def marks(hashes: np.ndarray, mask: int) -> list[np.ndarray]:
    turned = hashes + np.uint64(mask)
    return [(turned >> p & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64) for p in PROBES]


def passages(benchmark: DataFrame) -> DataFrame:
    """One row per different passage: its smallest item id, its word hashes and how many items hold it."""
    def convert(batches):
        hashes = PlainWords()
        for batch in batches:
            own = [hashes.of(plain_words(t)).view(np.int64) for t in strings(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(own, pa.list_(pa.int64()))], ["item_id", "item_words"])

    rows = id_and_text(benchmark, "item_id").mapInArrow(convert, "item_id long, item_words array<long>").where(F.size("item_words") > 0)
    return rows.groupBy("item_words").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("same_items"))


def benchmark_seeds(items: DataFrame, short: list[int]) -> DataFrame:
    def convert(batches):
        for batch in batches:
            for item, words in zip(batch["item_id"].to_pylist(), batch["item_words"].to_pylist()):
                words = np.array(words, np.int64).view(np.uint64)
                for mask, seeds in seeds_of(words, [n for n in short if n == len(words)]):
                    n = len(seeds)
                    yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array([mask] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(seeds.view(np.int64))], ["item_id", "mask", "item_at", "seed"])

    return items.mapInArrow(convert, "item_id long, mask int, item_at int, seed long")


def bit_words(bits: DataFrame) -> np.ndarray:
    """A bit map of the column ``bit``, gathered as at most 65,536 words of 64 bits whatever the table holds."""
    words = np.zeros(1 << MAP_BITS - 6, np.int64)
    marked = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    for r in marked.collect():
        words[r["word"]] = r["bits"]
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def bit_map(seeds: DataFrame) -> np.ndarray:
    """The filter for hits: three bits for each seed."""
    turned = F.col("seed") + F.col("mask").cast("long")
    probes = F.explode(F.array(*(F.shiftrightunsigned(turned, int(p)).bitwiseAND(F.lit((1 << MAP_BITS) - 1)) for p in PROBES)))
    return bit_words(seeds.select(probes.alias("bit")))


def hit_documents(docs: DataFrame, there: np.ndarray, short: list[int]) -> DataFrame:
    """Documents with hits in the filter: all their word hashes, and (mask, place, hash) of each hit."""
    hit = pa.struct([("mask", pa.int32()), ("at", pa.int32()), ("seed", pa.int64())])

    def convert(batches):
        hashes = PlainWords()
        for batch in batches:
            ids, words, hits = [], [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), strings(batch["text"])):
                own, found = hashes.of(plain_words(text)), []
                for mask, seeds in seeds_of(own, short):
                    a, b, c = marks(seeds, mask)
                    at = np.flatnonzero(there[a])
                    at = at[there[b[at]] & there[c[at]]]
                    found += [{"mask": mask, "at": int(i), "seed": int(s)} for i, s in zip(at, seeds[at].view(np.int64))]
                if found:
                    ids.append(doc)
                    words.append(own.view(np.int64))
                    hits.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(hits, pa.list_(hit))], ["doc_id", "words", "hits"])

    return docs.mapInArrow(convert, "doc_id long, words array<long>, hits array<struct<mask:int,at:int,seed:long>>")


def widest_stretch(same: np.ndarray, worth: np.ndarray) -> tuple[int, int]:
    """Start and end of the stretch of most worth (sums up to each word) in which agreement outweighs substitutions; both its
    end words agree, and of several the shortest is given. Start and end are 0 if no word agrees."""
    gain = np.concatenate([[0], np.cumsum(np.where(same, 1, -SUBSTITUTION))])
    starts = np.flatnonzero(same)
    if not len(starts):
        return 0, 0
    # The first start that lies lower than an end: the lowest values so far fall, so it is found by halving.
    first = starts[np.searchsorted(-np.minimum.accumulate(gain[starts]), -gain[starts + 1], side="right")]
    best = np.lexsort((starts - first, worth[first] - worth[starts + 1]))[0]
    return int(first[best]), int(starts[best]) + 1


OVERLAP = "doc_id long, item_id long, doc_start long, words long, agreeing long, item_words long, same_items long"


def find_overlaps(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per document and benchmark passage it holds: where, over how many words, and how many of those agree.

    A passage is held where at least ``least_words`` of its words (all of a shorter one) agree along one diagonal, more than
    four for each substitution between them, and one of the masks meets no substitution somewhere along it (of passages of 14
    words with two substitutions 5 % have no such place, of 15 or 16 with three 6 to 7 %). The place of a pair where most words agree is given. Items of the same words are one
    passage, named by the smallest id, with their number. Null and empty texts, null ids and empty tables hold nothing; a
    passage shorter than a mask is sought by all its words, so without substitutions. Rows that repeat an id are one document.
    """
    items = cut(passages(benchmark.where("item_id is not null")), "passages")
    short = [r[0] for r in items.select(F.size("item_words")).where(F.size("item_words") < SPAN).distinct().collect()]  # fewer than SPAN values
    seeds = cut(benchmark_seeds(items, short), "seeds")
    found = cut(hit_documents(id_and_text(docs).where("doc_id is not null"), bit_map(seeds), short), "hits")
    hits = found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", F.col("h.mask").alias("mask"), F.col("h.at").alias("at"), F.col("h.seed").alias("seed"))
    diagonals = hits.join(seeds, ["seed", "mask"]).select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    lined = diagonals.join(items, "item_id").join(found.select("doc_id", "words"), "doc_id").select(
        "doc_id", "item_id", "same_items", "item_words", "diagonal",
        F.slice("words", F.greatest("diagonal", F.lit(0)) + 1, F.greatest(F.lit(0), F.size("item_words") + F.least("diagonal", F.lit(0)))).alias("part"))

    def compare(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                item, part, skip = np.array(r["item_words"]), np.array(r["part"], np.int64), max(0, -r["diagonal"])
                same = np.zeros(len(item), bool)
                same[skip:skip + len(part)] = item[skip:skip + len(part)] == part
                held = np.concatenate([[0], np.cumsum(same)])
                start, end = widest_stretch(same, held)
                agreeing = int(held[end] - held[start])
                if agreeing >= min(least_words, len(item)):
                    rows.append((r["doc_id"], r["item_id"], r["diagonal"] + start, end - start, agreeing, len(item), r["same_items"]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(7)], ["doc_id", "item_id", "doc_start", "words", "agreeing", "item_words", "same_items"])

    places = lined.mapInArrow(compare, OVERLAP)
    best = places.groupBy("doc_id", "item_id", "item_words", "same_items").agg(F.max(F.struct("agreeing", (-F.col("doc_start")).alias("early"), "words")).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.early")).alias("doc_start"), F.col("best.words").alias("words"), F.col("best.agreeing").alias("agreeing"), "item_words", "same_items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with all their columns; rows that repeat an id stay or go
    together, rows with a null id or text stay. An empty benchmark drops nothing."""
    held = find_overlaps(docs, benchmark).select(F.col("doc_id").alias("__held")).distinct()
    return docs.join(held, docs["doc_id"] == held["__held"], "left_anti")
