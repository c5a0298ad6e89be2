"""Pattern packing: few-document length patterns, repeat counts by non-negative least squares, residuals by best fit.

Lengths are at most ``max_tokens``, so their histogram is bounded whatever the corpus holds; the plan is made from it on the
driver and names, for every length, which pieces (by their rank within the length) go to which sequence and offset. Ranks are
numbered inside salted blocks and shifted by block counts, so a length that most pieces share is no single task's work.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_and_text, salt_of, spread
from .wordcode import coder_of, vocabulary

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
KNOWN_WORDS = 1_500_000  # a worker remembers, twice at most
BLOCK = 100_000  # pieces of a salted block, on average


def patterns(bins: int, most: int) -> np.ndarray:
    """Multisets of at most ``most`` lengths (in bins) that fill a sequence; unused places are 0."""
    rows = [(bins,)]
    for n in range(2, most + 1):
        for head in combinations_with_replacement(range(1, bins // n + 1), n - 2):
            low, left = head[-1] if head else 1, bins - sum(head)
            rows += [(*head, a, left - a) for a in range(low, left // 2 + 1)]
    return np.array([(*r, *[0] * (most - len(r))) for r in rows])


def fit_repeats(columns: np.ndarray, wanted: np.ndarray, rounds: int) -> np.ndarray:
    """Active-set non-negative least squares: repeats of each pattern so that their places meet ``wanted`` per bin."""
    dense = np.zeros((len(wanted), 0))
    active, x = [], np.zeros(0)
    for _ in range(rounds):
        left = wanted - dense @ x
        left[0] = 0
        gain = left[columns].sum(1)
        gain[active] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= 1e-6 * max(1.0, wanted.max()):
            break
        column = np.bincount(columns[best], minlength=len(wanted)).astype(float)
        column[0] = 0
        active, dense, x = [*active, best], np.column_stack([dense, column]), np.append(x, 0.0)
        while True:
            goal = np.linalg.solve(dense.T @ dense + 1e-9 * np.eye(dense.shape[1]), dense.T @ wanted)
            if (goal > 1e-9).all():
                x = goal
                break
            falling = goal <= 1e-9
            step = (x[falling] / np.maximum(x[falling] - goal[falling], 1e-12)).min()
            x = x + step * (goal - x)
            stay = x > 1e-9
            active, dense, x = [a for a, s in zip(active, stay) if s], dense[:, stay], x[stay]
            if not len(x):
                break
    full = np.zeros(len(columns))
    full[active] = x
    return full


def plan_groups(histogram: np.ndarray, grain: int = 8, most: int = 4, rounds: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that hold every piece of the histogram exactly once."""
    longest = len(histogram) - 1
    grain = max(1, min(grain, longest))
    bins = longest // grain
    binned = np.zeros(bins + 1)
    of_bin: list[list[list[int]]] = [[] for _ in range(bins + 1)]
    for length in range(longest, 0, -1):
        b = -(-length // grain)
        if histogram[length] and b <= bins:  # a length above the last whole bin is left to best fit
            binned[b] += histogram[length]
            of_bin[b].append([length, int(histogram[length])])
    left = histogram.astype(np.int64).copy()
    columns = patterns(bins, min(most, bins))
    repeats = np.floor(fit_repeats(columns, binned, rounds) + 1e-6).astype(np.int64)
    opened: dict[int, list[list]] = {}
    for k in np.flatnonzero(repeats):
        groups = [((), int(repeats[k]))]
        for b in columns[k][columns[k] > 0]:
            grown = []
            for lengths, n in groups:
                while n and of_bin[b]:
                    length, there = of_bin[b][0]
                    took = min(n, there)
                    grown.append(((*lengths, length), took))
                    left[length] -= took
                    of_bin[b][0][1] -= took
                    n -= took
                    if took == there:
                        of_bin[b].pop(0)
                if n:
                    grown.append((lengths, n))
            groups = grown
        for lengths, n in groups:
            if lengths:
                opened.setdefault(longest - sum(lengths), []).append([lengths, n])
    rooms = sorted(opened)
    for length in range(longest, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = longest // length
                for per, sequences in ((each, n // each), (n % each, 1)):
                    if per and sequences:
                        put(opened, rooms, longest - per * length, (length,) * per, sequences)
                break
            room = rooms[at]
            lengths, there = opened[room][-1]
            took = min(n, there)
            if took == there:
                opened[room].pop()
                if not opened[room]:
                    del opened[room], rooms[at]
            else:
                opened[room][-1][1] -= took
            put(opened, rooms, room - length, (*lengths, length), took)
            n -= took
    merged: dict[tuple[int, ...], int] = {}
    for groups in opened.values():
        for lengths, n in groups:
            merged[lengths] = merged.get(lengths, 0) + n
    return sorted(merged.items(), reverse=True)


def put(opened: dict, rooms: list[int], room: int, lengths: tuple[int, ...], n: int) -> None:
    if room not in opened:
        opened[room] = []
        insort(rooms, room)
    opened[room].append([lengths, n])


def slots_of(groups: list[tuple[tuple[int, ...], int]], longest: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) in order; a row holds until the next of its length."""
    rank, rows, sequence = [0] * (longest + 1), [], 0
    for lengths, n in groups:
        offset = 0
        for length in lengths:
            rows.append((length, rank[length], sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 4)


def cut_pieces(docs: DataFrame, vocab: str, max_tokens: int, with_ids: bool = False) -> DataFrame:
    """Encoded documents, each closed by id 0, whole if they fit and else in pieces of ``max_tokens``."""
    def convert(batches):
        coder = coder_of(vocab, False, KNOWN_WORDS)
        for batch in batches:
            at = 0
            for ids, places in coder.encode(batch["text"]):
                docs_of, length = batch["doc_id"].slice(at, len(places) - 1), np.diff(places)
                at += len(places) - 1
                count = -(-length // max_tokens)
                row = np.repeat(np.arange(len(length)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * max_tokens
                own = np.minimum(length[row] - start, max_tokens)
                begin = places[row] + start
                parts = [ids[b:b + n].tobytes() for b, n in zip(begin, own)]
                cols = [docs_of.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(own), pa.array(map(zlib.crc32, parts), pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(parts, pa.binary())] * with_ids], ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return id_and_text(docs).mapInArrow(convert, PIECES + ", ids binary" * with_ids)


def pack(docs: DataFrame, vocab: str = "word_bpe_49k.json", max_tokens: int = 2048, with_ids: bool = False) -> DataFrame:
    """Each piece of each document with its sequence and place: no gaps, at most ``max_tokens`` a sequence.

    A null text is empty and still one piece (its end id). Repeated rows and null ids are packed like any other row. No rows
    give no pieces. With ``with_ids`` the ids (32-bit little-endian) stay with the pieces; see ``sequences``.
    """
    pieces = cut(cut_pieces(docs, vocabulary(vocab), max_tokens, with_ids), "pieces")
    counted = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most max_tokens rows
    histogram = np.zeros(max_tokens + 1, np.int64)
    for length, n in counted.items():
        histogram[length] = n
    slots = slots_of(plan_groups(histogram), max_tokens)
    key = slots[:, 0] << 40 | slots[:, 1]

    salted = pieces.withColumn("salt", salt_of("doc_id", "piece", salts=spread(int(histogram.sum()), BLOCK, 16)))
    blocks = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("own", own).join(blocks, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("salt", "own", "before")

    def place(batches):
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            row = slots[np.searchsorted(key, length << 40 | rank, "right") - 1] if len(slots) else np.zeros((0, 4), np.int64)
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in kept), pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])], [*kept, "sequence_id", "offset"])

    columns = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long").select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces that carry their ids: one row of at most ``max_tokens`` ids each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"), F.expr("transform(parts, p -> p.length)").alias("lengths"))
