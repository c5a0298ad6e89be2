"""Substring deduplication by collinear chaining: shared k-mer seeds, chains with gap costs, alignment of what they span.

Seeds are minimisers of word k-mers, so any run of ``K + WINDOW - 1`` equal words shares one. Every occurrence of a seed is
matched with its first one and the one before it (by document and place), so a passage in a third of all documents costs two
matches each. Runs of 2 and 4 shared seeds are seeds too: where the parts of a passage come from different documents, they
lead to those that hold the parts together. The matches of a document with one source are chained by a Fenwick tree over the source's places, and the words that a chain
spans are compared with those of the source, from where the passages of at least ``least_words`` words are cut.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, row_chunks, spread, strings
from .decontaminate import EDGES, MAP_BITS, PlainWords, bit_words, widest_stretch  # noqa: F401  (PlainWords: for the tests)
from .shingles import ODD, runs

K, WINDOW = 6, 14
RUN_SEEDS = (2, 4)  # runs of shared seeds that are seeds too
SEEDS_A_TASK = 1_000_000
WORD_CHUNK = 4 << 20  # bytes of text whose words are coded together
MATCHES_TOGETHER = 100_000
GAP_COST = 0.1  # score that each word between two seeds takes, on either side; a seed gives K
MOST_GAP, REACH = 120, 128  # words between seeds of one chain; words compared beyond a chain's ends
LEAST_WORDS, SUBSTITUTION = 50, 4  # of a passage; what a differing word costs against one that agrees
BAND = 24  # drift that an alignment follows beyond that of its chain
COMPARED = 1 << 18  # words compared together
ALIGN_CELLS, HELD_CELLS = 16 << 20, 64 << 20  # of bands aligned together, a byte each; of those whose words wait for it
OUTSIDE, SMALL_OUTSIDE = 1 << 28, 1 << 14  # what a place outside a band costs, with costs of 32 and of 16 bits


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``PlainWords`` of the words of all texts, one after another, and the number of each text's. Only different words are hashed."""
    lists = pc.utf8_split_whitespace(pa.array([t.lower().strip() or None for t in strings(texts)], pa.string()))
    coded = lists.flatten().dictionary_encode()
    size = pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64)
    if not len(coded):
        return np.zeros(0, np.uint64), size
    bare = pc.utf8_trim(coded.dictionary, EDGES)
    bare = pc.if_else(pc.equal(pc.binary_length(bare), 0), coded.dictionary, bare)
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(bare)], bare), "\n")[0].as_buffer().to_pybytes()  # one value is read faster than many
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, joined.split(b"\n")), np.uint64, len(bare))
    return hashes[coded.indices.to_numpy()], size


def told_apart(words: np.ndarray, at: np.ndarray, found: np.ndarray) -> np.ndarray:
    """In runs of few different words, the n-th seed of one hash in a document meets the n-th of another document, so that
    repetitions can be chained. Seeds of one document that occur once each stay as they are."""
    if len(np.unique(found)) == len(found):
        return found
    grams = np.sort(words[at[:, None] + np.arange(K)], axis=1)
    poor = np.flatnonzero((np.diff(grams, axis=1) != 0).sum(1) < K // 2)
    if len(poor):
        order = poor[np.argsort(found[poor], kind="stable")]
        fresh = np.concatenate([[True], found[order][1:] != found[order][:-1]])
        turn = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        found = found.copy()
        found[order] = found[order] * np.uint64(2 * 7919 + 1) + turn.astype(np.uint64)
    return found


def seeds_of_all(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents (by number), places and hashes of the smallest k-mer of every window, for documents whose words stand one after another."""
    # With gaps as wide as a window between the documents, no window meets two, and those of a short document hold all it has.
    begins = np.cumsum(size + WINDOW - 1) - (size + WINDOW - 1)
    apart = np.zeros(int((size + WINDOW - 1).sum()) + WINDOW + K, np.uint64)
    if len(words):
        apart[np.arange(len(words)) + np.repeat(np.arange(len(size)) * (WINDOW - 1), size)] = words
    seeds, place = runs(apart, list(range(K))), np.arange(len(apart) - K + 1)
    many = np.maximum(size - K + 1, 0)
    row = np.repeat(np.arange(len(size)), many)
    own = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    inside = np.zeros(len(seeds), bool)
    inside[begins[row] + own] = True
    seeds = np.where(inside, seeds[:len(inside)], np.iinfo(np.uint64).max)
    lowest, value, wide = place[:len(seeds)], seeds, 1
    while wide < WINDOW:  # the first of the smallest in windows twice as wide, in the end in two that overlap
        step = min(wide, WINDOW - wide)
        later = value[step:] < value[:-step]
        lowest, value = np.where(later, lowest[step:], lowest[:-step]), np.where(later, value[step:], value[:-step])
        wide += step
    windows = own < np.maximum(many - WINDOW, 0)[row] + 1
    at, row = lowest[begins[row[windows]] + own[windows]], row[windows]
    fresh = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
    at, row = at[fresh], row[fresh]
    found, at = seeds[at], at - begins[row]
    marks = found ^ row.astype(np.uint64) * ODD[0]
    order = np.argsort(marks)
    starts = np.cumsum(size) - size
    for r in np.unique(row[order[1:][marks[order[1:]] == marks[order[:-1]]]]):  # may hold one seed twice
        lo, hi = np.searchsorted(row, [r, r + 1])
        found[lo:hi] = told_apart(words[starts[r]:starts[r] + size[r]], at[lo:hi], found[lo:hi])
    return row, at, found


def minimisers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the smallest k-mer of every window of one document."""
    return seeds_of_all(words, np.array([len(words)]))[1:]


def seed_table(docs: DataFrame) -> DataFrame:
    def convert(batches):
        for batch in batches:
            at = 0
            for part in row_chunks(batch["text"], WORD_CHUNK):
                ids = batch["doc_id"].slice(at, len(part)).to_numpy()
                at += len(part)
                rows, places, seeds = seeds_of_all(*words_of(part))
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(ids[rows]), pa.array(places.astype(np.int32))], ["seed", "doc_id", "at"])

    return docs.mapInArrow(convert, "seed long, doc_id long, at int")


def chain(at: np.ndarray, there: np.ndarray) -> list[np.ndarray]:
    """Chains of matches (sorted by place): rows whose places rise on both sides, best first, every match in one at most.

    A match's score is K plus the best of the matches before it less the gap cost on both sides. With the cost linear in
    the places, that best is a prefix maximum over the source's places, kept in a Fenwick tree.
    """
    n = len(at)
    if (np.diff(at) > 0).all() and (np.diff(there) > 0).all():  # in order already: each match follows the one before it, or begins anew
        costs, starts, score = (GAP_COST * (np.diff(at) + np.diff(there))).tolist(), [0], float(K)
        for j, cost in enumerate(costs, 1):
            if score > cost:
                score += K - cost
            else:
                starts.append(j)
                score = float(K)
        return np.split(np.arange(n), starts[1:])
    ranks = np.unique(there, return_inverse=True)[1] + 1
    top, tree = int(ranks.max()), [(-np.inf, -1)] * (int(ranks.max()) + 1)
    score, back = np.zeros(n), np.full(n, -1)
    lifted = GAP_COST * (at + there)
    i = 0
    while i < n:
        j = i
        while j < n and at[j] == at[i]:  # matches of one place can't follow each other
            best, r = (-np.inf, -1), int(ranks[j]) - 1
            while r > 0:
                best = max(best, tree[r])
                r &= r - 1
            gain = best[0] - lifted[j]
            if gain > 0:
                back[j] = best[1]
            score[j] = K + max(gain, 0.0)
            j += 1
        for m in range(i, j):
            r, entry = int(ranks[m]), (score[m] + lifted[m], m)
            while r <= top:
                if tree[r] < entry:
                    tree[r] = entry
                r += r & -r
        i = j
    used, found = np.zeros(n, bool), []
    for end in np.argsort(-score, kind="stable"):
        rows, m = [], int(end)
        while m >= 0 and not used[m]:
            used[m] = True
            rows.append(m)
            m = int(back[m])
        if rows:
            found.append(np.array(rows[::-1]))
    return found


def parts_in_order(pair: np.ndarray, at: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a part of a chain begins at each match, for all pairs of documents at once (``pair``: their numbers, rising), and
    whether that holds: where the matches of a pair are out of order or rounding decides, ``chain`` has to.

    Of matches in order, each follows the one before it or begins anew: a score that is a sum of steps, and begins anew
    where the sum is no higher than it ever was.
    """
    fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
    mine, theirs = (np.concatenate([[0], np.diff(x)]) for x in (at, there))
    step = np.where(fresh, 0, round(K / GAP_COST) - mine - theirs)
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(pair)))
    total = np.cumsum(step)
    total -= np.repeat(total[first], count)
    lifted = total - np.repeat(np.arange(len(first)), count) * (total.max() - total.min() + 1)  # below all of the pairs before
    lowest = np.concatenate([[0], np.minimum.accumulate(lifted)[:-1]])
    odd = ~fresh & ((mine <= 0) | (theirs <= 0) | (lifted == lowest))
    begins = fresh | (lifted < lowest) | (mine > MOST_GAP) | (theirs > MOST_GAP)
    return begins, np.repeat(~np.logical_or.reduceat(odd, first), count)


def parts_of(rows: np.ndarray, at: np.ndarray, there: np.ndarray) -> Iterator[np.ndarray]:
    """A chain cut where its seeds lie far apart on either side."""
    far = np.flatnonzero((np.diff(at[rows]) > MOST_GAP) | (np.diff(there[rows]) > MOST_GAP))
    yield from np.split(rows, far + 1)


def whole_documents(batches, least: int) -> Iterator[dict[str, np.ndarray]]:
    """Rows of whole documents, from batches sorted by them, about ``least`` at a time or those of one document."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch[n].to_numpy() for n in batch.schema.names}
        ends = np.flatnonzero(np.diff(cols["doc_id"]))
        if held and cols["doc_id"][0] != held[-1]["doc_id"][-1]:
            ends = np.append(-1, ends)
        if rows + batch.num_rows > least and len(ends):
            yield {n: np.concatenate([*(h[n] for h in held), c[:ends[-1] + 1]]) for n, c in cols.items()}
            cols, held, rows = {n: c[ends[-1] + 1:] for n, c in cols.items()}, [], 0
        held.append(cols)
        rows += len(cols["doc_id"])
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def group_runs(batches, keys: tuple[str, str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Rows of each pair of keys, from batches sorted by them; only one pair is held at a time."""
    held, own = [], None
    for batch in batches:
        cols = {n: batch[n].to_numpy() for n in batch.schema.names}
        if not batch.num_rows:
            continue
        a, b = (cols[k] for k in keys)
        edges = [0, *(np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            key = (a[lo], b[lo])
            if key != own and held:
                yield own, {n: np.concatenate([h[n] for h in held]) for n in held[0]}
                held = []
            own = key
            held.append({n: c[lo:hi] for n, c in cols.items()})
    if held:
        yield own, {n: np.concatenate([h[n] for h in held]) for n in held[0]}


LINKS = "doc_id long, at int, seed long, first_id long, first_at int, last_id long, last_at int, part int, opening int"


def link_table(seeds: DataFrame) -> DataFrame:
    """Each occurrence of a seed that occurs more than once, with the first one and the one before it (its own values: it is the first).

    Occurrences are sorted over all tasks, so a seed of many documents lies in many of them. A task leaves open what its
    first seed has met in the tasks before; its last seed is told by a row whose ``opening`` is 2 or, if it is the first too, 3.
    """
    def convert(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if not held:
            return
        seed, doc, at = (np.concatenate([b[c].to_numpy() for b in held]) for c in ("seed", "doc_id", "at"))
        fresh = np.concatenate([[True], (np.diff(seed) != 0) | (np.diff(doc) != 0) | (np.diff(at) != 0)])  # rows that repeat an id
        seed, doc, at = seed[fresh], doc[fresh], at[fresh]
        n = np.arange(len(seed))
        begins = np.concatenate([[True], seed[1:] != seed[:-1]])
        first, last = np.maximum.accumulate(np.where(begins, n, 0)), np.where(begins, n, n - 1)
        opening, closing = seed == seed[0], seed == seed[-1]
        many = np.concatenate([seed[1:] == seed[:-1], [False]]) | ~begins
        rows = np.flatnonzero(many | opening | closing)
        kind = opening[rows].astype(np.int32)
        kind = np.append(kind, np.int32(3 if opening[-1] else 2))
        rows = np.append(rows, n[-1])
        for lo in range(0, len(rows), 1 << 16):
            r = rows[lo:lo + (1 << 16)]
            cols = (doc[r], at[r], seed[r], doc[first[r]], at[first[r]], doc[last[r]], at[last[r]], np.full(len(r), part, np.int32), kind[lo:lo + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [f.split()[0] for f in LINKS.split(", ")])

    size = seeds.count()
    dealt = seeds.repartitionByRange(spread(size, SEEDS_A_TASK), "seed", "doc_id", "at").sortWithinPartitions("seed", "doc_id", "at")
    links = cut(dealt.mapInArrow(convert, LINKS), "links")
    # What the seed that opens a task has met before: one row of each task decides it.
    ends = links.where("opening > 1").select("part", "opening", "seed", "doc_id", "at", "first_id", "first_at").orderBy("part").collect()
    carried, before = {}, None
    for e in ends:
        if before:
            carried[e["part"]] = before
        whole = e["opening"] == 3 and before and before[0] == e["seed"]
        before = (e["seed"], *(before[1:3] if whole else (e["first_id"], e["first_at"])), e["doc_id"], e["at"])

    def settle(batches):
        for batch in batches:
            cols = {c: batch[c].to_numpy().copy() for c in batch.schema.names}
            for p in np.unique(cols["part"][cols["opening"] == 1]):
                c = carried.get(int(p))
                if c:
                    here = (cols["part"] == p) & (cols["opening"] == 1) & (cols["seed"] == c[0])
                    head = here & (cols["doc_id"] == cols["first_id"]) & (cols["at"] == cols["first_at"])
                    cols["first_id"][here], cols["first_at"][here] = c[1], c[2]
                    cols["last_id"][head], cols["last_at"][head] = c[3], c[4]
            kept = cols["opening"] < 2
            yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in cols.values()], list(cols))

    return links.mapInArrow(settle, LINKS)


def run_table(links: DataFrame) -> DataFrame:
    """Runs of 2 and 4 shared seeds of a document, none of them further from the next than a window, as seeds at their first place."""
    def convert(batches):
        for _, cols in group_runs(batches, ("doc_id", "doc_id")):
            at, seed = cols["at"], cols["seed"].view(np.uint64)
            for n in RUN_SEEDS:
                if len(at) < n:
                    continue
                size = len(at) - n + 1
                near = np.concatenate([[0], np.cumsum(np.diff(at) > WINDOW)])
                hashes = np.full(size, n, np.uint64)
                for k in range(n):  # with the words between them
                    hashes = (hashes * np.uint64(0x9E3779B97F4A7C15) ^ seed[k:k + size]) * np.uint64(0xD6E8FEB86659FD93)
                    hashes ^= (hashes >> np.uint64(32)) + (at[k:k + size] - at[:size]).astype(np.uint64)
                rows = np.flatnonzero(near[n - 1:] == near[:size])
                for lo in range(0, len(rows), 1 << 16):
                    r = rows[lo:lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[r].view(np.int64)), pa.array(cols["doc_id"][r]), pa.array(at[r])], ["seed", "doc_id", "at"])

    dealt = links.select("doc_id", "at", "seed").repartition("doc_id").sortWithinPartitions("doc_id", "at")
    return dealt.mapInArrow(convert, "seed long, doc_id long, at int")


def match_table(links: DataFrame) -> DataFrame:
    """Matches with the first occurrence and the one before, each once."""
    earlier = F.array(F.struct(F.col("first_id").alias("source_id"), F.col("first_at").alias("source_at")), F.struct(F.col("last_id").alias("source_id"), F.col("last_at").alias("source_at")))
    pairs = links.where("doc_id <> first_id or at <> first_at").select("doc_id", "at", F.explode(F.array_distinct(earlier)).alias("s"))
    return pairs.select("doc_id", "s.source_id", "at", "s.source_at")


CHAINS = "doc_id long, source_id long, lo int, hi int, source_lo int, source_hi int, drift int"


def joined(pair: np.ndarray, lo: np.ndarray, hi: np.ndarray, source_lo: np.ndarray, source_hi: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, ...]:
    """Parts of pairs of documents, those of one pair and diagonal made one where the words compared around them meet."""
    order = np.lexsort((lo, lo - source_lo, drift > 0, pair))
    pair, lo, hi, source_lo, source_hi, drift = (x[order] for x in (pair, lo, hi, source_lo, source_hi, drift))
    diagonal = lo - source_lo
    other = np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(diagonal) != 0)]) | (drift > 0)
    lift = np.cumsum(other) * (hi.max() + 1)  # above all of the diagonals before
    reached = np.concatenate([[0], np.maximum.accumulate(hi + lift)[:-1]]) - lift
    first = np.flatnonzero(other | (lo - reached > 2 * REACH))
    return pair[first], lo[first], np.maximum.reduceat(hi, first), source_lo[first], np.maximum.reduceat(source_hi, first), drift[first]


def chain_table(matches: DataFrame) -> DataFrame:
    def convert(batches):
        for cols in whole_documents(batches, MATCHES_TOGETHER):
            doc, source, at, there = (cols[c].astype(np.int64) for c in ("doc_id", "source_id", "at", "source_at"))
            changed = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(source) != 0)])
            fresh = changed | np.concatenate([[True], (np.diff(at) != 0) | (np.diff(there) != 0)])
            pair, changed = np.cumsum(changed)[fresh] - 1, np.flatnonzero(changed)
            doc, source, at, there = doc[changed], source[changed], at[fresh], there[fresh]
            begins, plain = parts_in_order(pair, at, there)
            first = np.flatnonzero(begins[plain])
            rows, sizes = np.flatnonzero(plain), np.diff(np.append(first, np.count_nonzero(plain)))
            edges = np.flatnonzero(~plain & np.concatenate([[True], pair[1:] != pair[:-1]]))
            pieces = [p + lo for lo, hi in zip(edges, np.searchsorted(pair, pair[edges], "right")) for whole in chain(at[lo:hi], there[lo:hi]) for p in parts_of(whole, at[lo:hi], there[lo:hi])]
            rows = np.concatenate([rows, *pieces])
            first = np.cumsum(sizes := np.append(sizes, [len(p) for p in pieces]).astype(np.int64)) - sizes
            last, a, b = rows[first + sizes - 1], at[rows], there[rows]
            drift = np.maximum.reduceat(a - b, first) - np.minimum.reduceat(a - b, first)
            own, *parts = joined(pair[rows[first]], a[first], at[last] + K, b[first], there[last] + K, drift)
            yield pa.RecordBatch.from_arrays([pa.array(doc[own]), pa.array(source[own]), *(pa.array(p.astype(np.int32)) for p in parts)], ["doc_id", "source_id", "lo", "hi", "source_lo", "source_hi", "drift"])

    dealt = matches.repartition("doc_id").sortWithinPartitions("doc_id", "source_id", "at", "source_at")
    return dealt.mapInArrow(convert, CHAINS)


def word_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """32-bit word hashes of the wanted documents; of others only those that a bit map of fixed size lets through, which join with no chain."""
    there = bit_words(wanted.select(F.pmod(F.col("doc_id"), F.lit(1 << MAP_BITS)).alias("bit")))

    def convert(batches):
        for batch in batches:
            own, at = batch.filter(pa.array(there[batch["doc_id"].to_numpy() % (1 << MAP_BITS)])), 0
            for part in row_chunks(own["text"], WORD_CHUNK):
                words, size = words_of(part)
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([own["doc_id"].slice(at, len(part)), pa.ListArray.from_arrays(ends, words.astype(np.uint32).view(np.int32))], ["doc_id", "words"])
                at += len(part)

    return docs.mapInArrow(convert, "doc_id long, words array<int>")


def align(a: list[np.ndarray], b: list[np.ndarray], shift: list[int], band: list[int]) -> list[np.ndarray]:
    """For each word of each ``a`` the place of the word of its ``b`` it is matched with (-1: none), by edit distance inside a band.

    ``shift``: b's place less a's of the band's middle. Pairs of like widths are aligned together, one vector step for the n-th words of all.
    """
    size, width = np.array([len(x) for x in a], np.int64), 2 * np.array(band, np.int64) + 1
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(a)
    group, kind, wide = [], 0, 0
    for r in sorted(range(len(a)), key=lambda r: (int(width[r]).bit_length(), -size[r])):
        wide = max(wide, int(width[r]))
        if group and (int(width[r]).bit_length() != kind or (len(group) + 1) * size[group[0]] * wide > ALIGN_CELLS):
            align_group(group, a, b, shift, band, out)
            group, wide = [], int(width[r])
        group.append(r)
        kind = int(width[r]).bit_length()
    if group:
        align_group(group, a, b, shift, band, out)
    return out


def align_group(group: list[int], a: list[np.ndarray], b: list[np.ndarray], shift: list[int], band: list[int], out: list[np.ndarray]) -> None:
    """Alignments of the pairs of a group, whose ``a`` get no longer."""
    size, width = np.array([len(a[r]) for r in group]), np.array([2 * band[r] + 1 for r in group])
    most, wide = int(size[0]), int(width.max())
    kind, outside = (np.int16, SMALL_OUTSIDE) if 2 * most + wide < SMALL_OUTSIDE - 4 else (np.int32, OUTSIDE)
    left, right = np.zeros((len(group), most), np.int32), np.full((len(group), most + wide), unused([a[r] for r in group]), np.int32)
    first = np.array([shift[r] - band[r] for r in group])  # of b, in the band of the first word
    for k, r in enumerate(group):
        left[k, :len(a[r])] = a[r]
        lo, hi = max(0, -first[k]), max(0, min(most + wide, len(b[r]) - first[k]))
        if lo < hi:
            right[k, lo:hi] = b[r][lo + first[k]:hi + first[k]]
    # Costs are held less their place in the band and less 2 for each word: what a word of b or of a on nothing adds to them is then 0.
    spread = np.arange(wide + 1, dtype=kind)
    beyond = spread >= width[:, None]
    least = np.where(beyond, outside - spread, -outside - spread).astype(kind)
    cost = np.where(beyond, outside, 0).astype(kind) - spread  # free start
    uneven = len(group) > 1 and int(width.min()) < wide
    steps = np.zeros((most, len(group), wide), np.int8)
    running = np.searchsorted(-size, -np.arange(most), "left").tolist()  # pairs that have an n-th word
    opposite = np.lib.stride_tricks.sliding_window_view(right, wide, axis=1).transpose(1, 0, 2)
    i = 0
    while i < most:
        n, some = running[i], slice(i, min(most, i + max(1, COMPARED // (running[i] * wide))))
        differs = np.empty((some.stop - i, n, wide), bool)
        np.not_equal(opposite[some, :n], left.T[some, :n, None], out=differs)
        stays, skipped, passed = differs.astype(kind) - kind(2), np.empty_like(differs), np.empty_like(differs)
        for k, n in enumerate(running[some]):
            stay, skip = cost[:n, :-1] + stays[k, :n], cost[:n, 1:]  # a[i] on b[j], a[i] on nothing
            new = np.minimum(stay, skip)
            np.greater(stay, skip, out=skipped[k, :n])
            run = np.minimum.accumulate(new, axis=1, out=cost[:n, :-1])  # words of b on nothing
            np.less(run, new, out=passed[k, :n])
            if uneven:
                np.maximum(cost[:n], least[:n], out=cost[:n])
        steps[some, :running[i]] = skipped.view(np.int8) + 2 * passed.view(np.int8)
        i = some.stop
    w, rows = np.where(beyond, np.iinfo(np.int32).max, cost.astype(np.int32) + spread).argmin(1), np.arange(len(group))
    at, kinds = np.zeros((most, len(group)), np.int64), np.ones((most, len(group)), np.int8)
    for i in range(most - 1, -1, -1):
        n = running[i]
        mine, own = rows[:n], w[:n]
        step = steps[i][mine, own]
        while step.max() > 1:
            own -= step > 1
            step = steps[i][mine, own]
        at[i, :n], kinds[i, :n] = own, step
        own += step
    for k, r in enumerate(group):
        j = at[:len(a[r]), k] + np.arange(len(a[r]))
        out[r] = np.where((kinds[:len(j), k] == 0) & (right[k, j] == a[r]), first[k] + j, -1)


def unused(words: list[np.ndarray]) -> int:
    """A 32-bit value that is none of the words, for places beyond the ends of a text."""
    taken = np.unique(np.concatenate(words)).astype(np.int64)
    low = np.iinfo(np.int32).min
    return low if not len(taken) or taken[0] > low else int(taken[(np.diff(taken, append=1 << 32) > 1).argmax()]) + 1


def stretches(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of at least ``least`` words in which agreement outweighs differences, none in another: where any is, one is found that meets it."""
    found, todo = [], [(0, len(same))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least or np.count_nonzero(same[lo:hi]) * (SUBSTITUTION + 1) <= least * SUBSTITUTION:  # too few agree, in whatever order
            continue
        gain = np.concatenate([[0], np.cumsum(np.where(same[lo:hi], 1, -SUBSTITUTION))])
        low = np.minimum.accumulate(gain)
        end = int((gain - low).argmax())
        start = int(np.flatnonzero(gain[:end + 1] == low[end])[-1])
        if end - start < least:  # a longer one may gain less, with words that differ near its ends
            start, end = widest_stretch(same[lo:hi], np.arange(hi - lo + 1))
            if end - start < least:
                continue
        found.append((lo + start, lo + end))
        todo += [(lo, lo + start), (lo + end, hi)]
    return sorted(found)


PASSAGES = "doc_id long, source_id long, start int, words int, source_start int, source_words int, agreeing int"


def compared(own: tuple, source: tuple, shift: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row, whether its words (values and their bounds) equal those of its source ``shift`` further on; rows are dealt
    out by their words, and given as their numbers with flat words from the bounds of the first one on."""
    size = np.diff(own[1])
    low, high = np.maximum(-shift, 0), np.maximum(np.minimum(size, np.diff(source[1]) - shift), 0)
    for rows in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // COMPARED)) + 1):
        same = np.zeros(int(size[rows].sum()), bool)
        count = np.maximum(high - low, 0)[rows]
        word = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        mine, theirs = (word + np.repeat(x[rows], count) for x in (own[1][:-1] + low, source[1][:-1] + low + shift))
        same[mine - own[1][rows[:1]]] = own[0][mine] == source[0][theirs]
        yield rows, same


def align_chains(lined: DataFrame, least_words: int) -> DataFrame:
    names = ("doc_id", "source_id", "lo", "source_lo", "from", "source_from", "drift")

    def passages(r, places, found):
        doc, source, _, _, start, source_start, _ = r
        for s, e in found:
            on = places[s:e][places[s:e] >= 0]
            yield doc, source, start + s, e - s, source_start + int(on[0]), int(on[-1] - on[0]) + 1, len(on)

    def aligned(drifting):
        """Words were put in or left out between seeds: the alignment counts where more words are in its passages."""
        for (r, _, _, shift, _, same, found), gapped in zip(drifting, align(*([d[i] for d in drifting] for i in (1, 2, 3, 4)))):
            more = stretches(gapped >= 0, least_words)
            if sum(e - s for s, e in more) > sum(e - s for s, e in found):
                yield from passages(r, gapped, more)
            else:
                yield from passages(r, np.where(same, np.arange(len(same)) + shift, -1), found)

    def packed(rows):
        kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 5)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], ["doc_id", "source_id", "start", "words", "source_start", "source_words", "agreeing"])

    def convert(batches):
        drifting, cells = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            own, source = ((batch[c].flatten().to_numpy(), (batch[c].offsets.to_numpy() - batch[c].offsets[0].as_py()).astype(np.int64)) for c in ("part", "source_part"))
            cols = [batch[c].to_numpy().astype(np.int64) for c in names]
            _, _, lo, source_lo, begin, source_begin, drift = cols
            shifts = source_lo - source_begin - (lo - begin)
            for some, flat in compared(own, source, shifts):
                bounds = own[1][some[0]:some[-1] + 2] - own[1][some[0]]
                sums = np.concatenate([[0], np.cumsum(flat)])[bounds]
                enough = np.diff(sums) * (SUBSTITUTION + 1) > least_words * SUBSTITUTION
                for k in np.flatnonzero(enough | (drift[some] > 0)).tolist():
                    i = int(some[k])
                    r, same, shift = [int(c[i]) for c in cols], flat[bounds[k]:bounds[k + 1]], int(shifts[i])
                    found = stretches(same, least_words)
                    if r[-1]:
                        a, b = (x[at[i]:at[i + 1]].copy() for x, at in (own, source))
                        drifting.append((r, a, b, shift, BAND + r[-1], same.copy(), found))
                        cells += len(a) * (2 * (BAND + r[-1]) + 1)
                    elif found:
                        rows += passages(r, np.where(same, np.arange(len(same)) + shift, -1), found)
            if cells > HELD_CELLS:
                rows += aligned(drifting)
                drifting, cells = [], 0
            yield packed(rows)
        if drifting:
            yield packed(list(aligned(drifting)))

    return lined.mapInArrow(convert, PASSAGES)


def earliest(found: DataFrame) -> DataFrame:
    """Passages without those that lie inside a passage that the same document shares with an earlier source."""
    def convert(batches):
        for (doc, _), cols in group_runs(batches, ("doc_id", "doc_id")):
            starts, ends, kept = [], [], []  # of the passages with earlier sources, none inside another: both rise
            own = list(zip(cols["source_id"].tolist(), cols["start"].tolist(), (cols["start"] + cols["words"]).tolist()))
            for _, rows in groupby(own, key=lambda r: r[0]):
                rows = list(rows)
                inside = [(k := bisect_right(starts, s)) > 0 and ends[k - 1] >= e for _, s, e in rows]
                kept += [not x for x in inside]
                for (_, s, e), x in zip(rows, inside):
                    k = bisect_right(starts, s)
                    if x or k and ends[k - 1] >= e:
                        continue
                    k, stop = bisect_left(starts, s), bisect_right(ends, e)
                    starts[k:max(k, stop)], ends[k:max(k, stop)] = [s], [e]
            kept = np.array(kept)
            yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in cols.values()], list(cols))

    return found.repartition("doc_id").sortWithinPartitions("doc_id", "source_id", F.desc("words"), "start").mapInArrow(convert, PASSAGES)


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Passages of ``doc_id`` (start and length in words) that repeat one of ``source_id``, which comes earlier by id or place.

    Added or missing words are followed where equal words of a seed's length lie on both sides of them.
    A passage is only found by a seed of six equal words in a row (see the README for the recall by density of replaced words).
    It has at least ``least_words`` words, of which each one that differs (or is missing or added) is outweighed by
    four that agree; ``agreeing`` counts those that do. Case and punctuation around words don't count. A passage of many
    documents is listed once for each but its first; another source is listed too where its passage reaches further. A document that repeats itself is its own source. Null and empty texts
    and null ids have no passages; rows that repeat an id are one document. Two passages of one place and source are one.
    """
    docs = id_and_text(docs).where("doc_id is not null")
    seeds = cut(seed_table(docs), "seeds")
    links = link_table(seeds)
    runs_of = link_table(cut(run_table(links), "runs"))
    # A passage as long as is asked for holds two seeds or, edited, one and what lies around it.
    chains = cut(chain_table(match_table(links).unionByName(match_table(runs_of))), "chains")
    wanted = chains.select(F.explode(F.array("doc_id", "source_id")).alias("doc_id"))
    words = cut(word_table(docs, wanted), "words").dropDuplicates(["doc_id"])
    slice_of = lambda c, lo, hi: F.slice(c, F.col(lo) + 1, F.greatest(F.col(hi) - F.col(lo), F.lit(0)))
    near = chains.withColumns({"from": F.greatest(F.col("lo") - REACH, F.lit(0)), "to": F.col("hi") + REACH,
                               "source_from": F.greatest(F.col("source_lo") - REACH - 32, F.lit(0)), "source_to": F.col("source_hi") + REACH + 32})
    mine = near.join(words, "doc_id").withColumn("part", slice_of("words", "from", "to")).drop("words")
    lined = mine.join(words.withColumnRenamed("doc_id", "source_id"), "source_id").withColumn("source_part", slice_of("words", "source_from", "source_to")).drop("words")
    found = align_chains(lined, least_words)
    found = found.groupBy("doc_id", "source_id", "start").agg(F.max(F.struct("words", "agreeing", "source_start", "source_words")).alias("p")).select(
        "doc_id", "source_id", "start", "p.words", "p.source_start", "p.source_words", "p.agreeing")
    return earliest(found)
