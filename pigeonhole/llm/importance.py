"""Importance resampling towards a target corpus: hashed n-gram gains and Gumbel keys, in Arrow kernels.

A batch of texts is lower-cased, split by a pattern, flattened and dictionary-encoded once. Neighbouring dictionary indices
form the word pairs; the checksum of each distinct pair comes from those of its two words, and the gains of a document's
features are taken by index and reduced over its segment. Only the counts of the buckets (a fixed number) pass the driver.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_and_text, row_chunks, spread

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing, words are what lies between
ROWS_A_TASK = 250_000
LONG = 64  # bytes of a word from which its pairs are checked as whole texts


@lru_cache(1)
def zeros_after() -> np.ndarray:
    """For every length up to that of a long word and a space: four tables of 256, what each byte of a checksum turns into once
    so many more bytes follow."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    out = [np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)]
    for _ in range(LONG + 1):
        out.append((out[-1] >> np.uint32(8)) ^ table[out[-1] & np.uint32(255)])
    return np.stack(out)


def pair_checksums(words: list[bytes], own: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """crc32 of ``first + b' ' + second`` for indices into ``words``, whose own checksums are given."""
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in words), np.uint32, len(words))
    length = np.fromiter((min(len(w), LONG) + 1 for w in words), np.int64, len(words))
    tables, c, n = zeros_after(), own[first], length[second]
    out = spaced[second].copy()
    for k in range(4):
        out ^= tables[n, k, c >> np.uint32(8 * k) & np.uint32(255)]
    for i in np.flatnonzero(n > LONG):
        out[i] = zlib.crc32(words[first[i]] + b" " + words[second[i]])
    return out


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one run of texts: the bucket of every word and where the texts' words begin (and the last ends), and the same of their pairs."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BREAKS)
    coded = pc.list_flatten(lists).dictionary_encode()
    index, sizes = coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    words = [w.encode() for w in coded.dictionary.to_pylist()]
    text_of = np.repeat(np.arange(len(texts)), sizes)
    filled = np.fromiter(map(len, words), np.int64, len(words))[index] > 0
    index, text_of = index[filled], text_of[filled]
    own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    starts = np.concatenate([[0], np.cumsum(np.bincount(text_of, minlength=len(texts)))])
    inside = text_of[1:] == text_of[:-1]
    pairs = pa.array(index[:-1][inside].astype(np.int64) * len(words) + index[1:][inside]).dictionary_encode()
    distinct = pairs.dictionary.to_numpy()
    of_pair = pair_checksums(words, own, distinct // max(len(words), 1), distinct % max(len(words), 1)) % np.uint32(buckets)
    ends = np.concatenate([[0], np.cumsum(np.bincount(text_of[1:][inside], minlength=len(texts)))])
    return (own % np.uint32(buckets))[index], starts, of_pair[pairs.indices.to_numpy()], ends


def bucket_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """``bucket, n`` over all features of all texts; a task hands over its non-zero buckets only."""
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in row_chunks(batch["text"]):
                words, _, pairs, _ = features(part, buckets)
                total += np.bincount(words, minlength=buckets) + np.bincount(pairs, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "n"])

    return docs.select("text").mapInArrow(convert, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """What a feature of each bucket tells for the target, in thousandths; both tables have at most ``buckets`` rows."""
    s, t = (np.zeros(buckets, np.int64) for _ in range(2))
    for counts, rows in ((s, raw), (t, target)):
        for r in rows.collect():
            counts[r.bucket] = r.n
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * all_s / ((float(x) + 1) * all_t))) for x, y in zip(s, t)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def score_documents(docs: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    buckets = len(gain)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in row_chunks(batch["text"]):
                ids = batch["doc_id"].slice(at, len(part))
                at += len(part)
                words, starts, pairs, ends = features(part, buckets)
                total = np.zeros(len(part), np.int64)
                for found, edges in ((words, starts), (pairs, ends)):
                    running = np.concatenate([[0], np.cumsum(gain[found])])
                    total += running[edges[1:]] - running[edges[:-1]]
                n = np.diff(starts) + np.diff(ends)
                weight = total // np.maximum(n, 1)
                score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (np.diff(starts), n, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.mapInArrow(convert, SCORED)


def ranked(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with their place by score descending and doc_id: sorted over all tasks, numbered inside each, shifted by the tasks before."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at + 1, at + n + 1))], [*batch.schema.names, "part", "place"])
            at += n

    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    dealt = rows.repartitionByRange(spread(size, ROWS_A_TASK), *order).sortWithinPartitions(*order)
    placed = cut(dealt.mapInArrow(number, SCORED + ", part int, place long"), "importance-places")
    parts = placed.groupBy("part").agg(F.max("place").alias("last"))
    parts = parts.select("part", F.coalesce(F.sum("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row per task
    return placed.join(parts, "part").withColumn("rank", F.col("place") + F.col("before")).drop("part", "place", "before")


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7, target_id: str = "item_id") -> DataFrame:
    """Every document with its weight and, where it is drawn, its rank.

    Features are words and pairs of neighbouring words, hashed into ``buckets``. A document's weight is the floored mean of
    its features' gains, its score the weight plus Gumbel noise from its id: drawing the highest scores draws without
    replacement in proportion to the weights' exponentials. Of the documents with at least ``least_words`` words,
    ``percent`` of a hundred are drawn (rounded down), ties to the smaller id, null ids last. Null and empty texts have no
    features and weight 0. Repeated rows count and are ranked one by one, in any order among rows alike in id and score. An
    empty target gives gains against its smoothing alone; no documents give no rows. Other columns are not read.
    """
    docs = id_and_text(docs)
    gain = gains(bucket_counts(docs, buckets), bucket_counts(id_and_text(target, target_id), buckets), buckets)
    scored = cut(score_documents(docs, gain, seed), "importance-scores")
    able = F.col("n_words") >= least_words
    size = scored.where(able).count()
    out = ranked(scored.where(able), size).withColumn("rank", F.when(F.col("rank") <= size * percent // 100, F.col("rank")))
    return out.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
