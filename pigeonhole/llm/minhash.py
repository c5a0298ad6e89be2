"""Near-duplicates by circulant MinHash, banding, and exact Jaccard on whole shingle sets.

Signature: a first permutation scatters the shingles over a circle of ``CIRCLE`` places; a second one, shifted by 0..127
places, gives all 128 coordinates, so a shingle reads one run of a table instead of 128 hashes. 32 bands of 4 coordinates
miss a pair at similarity 0.8 with a probability under 1e-7; a pair is dropped before the exact test only where 4-bit
coordinates agree in fewer than 84 of 128 places (4.5 standard deviations below those of 0.8).

No bucket emits all its pairs. Texts of equal sets become one class; each bucket first compares its members with one pivot of
its own. Only members that are then not yet in the component of most of their bucket are compared with the others, blocks of
which stay in a task while they pass, so that no pair but a link is ever a row, and no link between components is lost.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, strings
from .decontaminate import MAP_BITS, bit_words
from .graph import components
from .shingles import ODD, WordHashes, ascii_words, mixed, shingle_set

CIRCLE, COORDINATES, ROWS = 1 << 20, 128, 4
SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, bits array<long>"
AGREE = 84
BLOCK = 1 << 16  # shingles of a block held in a task


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    first, second = rng.permutation(CIRCLE).astype(np.int64), rng.permutation(CIRCLE).astype(np.uint32)
    circle = np.concatenate([second, second[:COORDINATES]])
    return first, np.lib.stride_tricks.sliding_window_view(circle, COORDINATES)


def signature(shingles: np.ndarray) -> np.ndarray:
    first, shifted = tables()
    at, low = first[(shingles >> np.uint64(44)).astype(np.int64)], np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(at), 2048):
        low = np.minimum(low, shifted[at[i:i + 2048]].min(0))
    return low


def sketch(docs: DataFrame, k: int) -> DataFrame:
    def convert(batches):
        hashes = WordHashes()
        for batch in batches:
            sizes, sets, bands, bits = [], [], [], []
            for text in strings(batch["text"]):
                own = shingle_set(hashes.of(ascii_words(text)), k)
                sizes.append(len(own))
                sets.append([(own * ODD[40]).sum(dtype=np.uint64), mixed(own ^ ODD[41]).sum(dtype=np.uint64)])
                sig = signature(own)
                grouped = sig.reshape(-1, ROWS).astype(np.uint64)
                bands.append(mixed((grouped * ODD[:ROWS]).sum(1, dtype=np.uint64) + ODD[20] * np.arange(len(grouped), dtype=np.uint64)))
                nibbles = (sig & 15).astype(np.uint64).reshape(-1, 16)
                bits.append((nibbles << np.arange(0, 64, 4, dtype=np.uint64)).sum(1, dtype=np.uint64))
            sets = np.array(sets, np.uint64).reshape(-1, 2).view(np.int64)
            lists = [pa.FixedSizeListArray.from_arrays(np.array(x, np.uint64).reshape(-1).view(np.int64), w).cast(pa.list_(pa.int64())) for x, w in ((bands, COORDINATES // ROWS), (bits, COORDINATES // 16))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(sets[:, 0]), pa.array(sets[:, 1]), *lists], ["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits"])

    return docs.mapInArrow(convert, SKETCH)


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Shingle sets of the wanted documents; a bit map of fixed size leaves most others out before they are shuffled."""
    there = bit_words(wanted.select(F.pmod(F.col("doc_id"), F.lit(1 << MAP_BITS)).alias("bit")))

    def convert(batches):
        hashes = WordHashes()
        for batch in batches:
            own = batch.filter(pc.fill_null(pa.array(there[batch["doc_id"].fill_null(0).to_numpy() % (1 << MAP_BITS)]), False))
            sets = [shingle_set(hashes.of(ascii_words(text)), k).view(np.int64) for text in strings(own["text"])]
            yield pa.RecordBatch.from_arrays([own["doc_id"], pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return cut(docs.mapInArrow(convert, "doc_id long, shingles array<long>").join(wanted, "doc_id", "left_semi"), "sets").dropDuplicates(["doc_id"])


def agreeing(x: str, y: str) -> F.Column:
    """Of 128 coordinates of 4 bits, how many are the same."""
    def differ(i: int):
        bits = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        for shift in (1, 2):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, shift))
        return F.bit_count(bits.bitwiseAND(F.lit(0x1111111111111111)))

    return F.lit(COORDINATES) - sum((differ(i) for i in range(1, COORDINATES // 16)), differ(0))


def similar_sizes(x: str, y: str, percent: int) -> F.Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def linked(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets are similar enough."""
    pairs = cut(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = full_sets(docs, cut(ends, "ends"), k)
    of = lambda end: sets.select(F.col("doc_id").alias(end), F.col("shingles").alias(f"s{end}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("shared") * 100 >= (F.size("sa") + F.size("sb") - F.col("shared")) * percent).select("a", "b")


def linked_in_blocks(divided: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links ``a, b`` between components that meet in a bucket: its members are dealt to blocks of about ``BLOCK`` shingles,
    and those outside its main component are sent to each block. A task holds one block and streams the others past it;
    a member is reported with one partner of each component and block, so what comes out grows with the members only.
    """
    sets = full_sets(docs, cut(divided.select("doc_id").distinct(), "ends"), k)
    blocks = divided.groupBy("bucket").agg(F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("blocks"))
    rows = divided.join(blocks, "bucket")
    columns = ["bucket", "block", "probe", "doc_id", "component"]
    members = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")).withColumn("probe", F.lit(False)).select(columns)
    probes = rows.where("component <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("probe", F.lit(True)).select(columns)
    dealt = members.union(probes).join(sets, "doc_id").repartition("bucket", "block").sortWithinPartitions("bucket", "block", "probe", "doc_id")

    def convert(batches):
        key, held, index = None, [], None
        for batch in batches:
            values, at = batch["shingles"].flatten().to_numpy(), batch["shingles"].offsets.to_numpy() - batch["shingles"].offsets[0].as_py()
            found = []
            for i, (bucket, block, probe, doc, component) in enumerate(zip(*(batch[c].to_pylist() for c in columns))):
                if (bucket, block) != key:
                    key, held, index = (bucket, block), [], None
                own = values[at[i]:at[i + 1]]
                if not probe:
                    held.append((doc, component, own))
                    continue
                if not held:
                    continue
                if index is None:
                    sizes = np.array([len(h[2]) for h in held])
                    joined = np.concatenate([h[2] for h in held])
                    order = np.argsort(joined, kind="stable")
                    index = joined[order], np.repeat(np.arange(len(held)), sizes)[order], sizes, np.array([h[1] for h in held])
                shingles, owner, sizes, parts = index
                lo, hi = np.searchsorted(shingles, own), np.searchsorted(shingles, own, "right")
                hit = owner[np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
                shared = np.bincount(hit, minlength=len(held))
                near = np.flatnonzero((shared * 100 >= (sizes + len(own) - shared) * percent) & (parts != component))
                found += [(min(doc, held[j][0]), max(doc, held[j][0])) for j in near[np.unique(parts[near], return_index=True)[1]]]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(convert, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per document: n_shingles, component_id (the smallest id reachable over links, its own included) and kept.

    Links join documents whose sets of k-word shingles share at least ``percent`` of their union. Fewer than k words are one
    shingle; a null or empty text or one of white space has none and is linked with nothing. ``doc_id`` names a document: rows
    that repeat one are returned each, in one component. A null id is never linked: its component is null and it is kept.
    """
    docs = id_and_text(docs)
    sketched = cut(sketch(docs, k), "sketches")
    filled = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = cut(filled.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("least")), "classes")
    heads = cut(filled.join(classes.withColumnRenamed("least", "doc_id"), ["set_a", "set_b", "n_shingles", "doc_id"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "bands", "bits"), "heads")

    banded = heads.select("doc_id", F.explode("bands").alias("bucket"))
    pivots = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min_by("doc_id", F.xxhash64("doc_id", "bucket")).alias("pivot")).where("n > 1")
    crowded = cut(banded.join(pivots.select("bucket", "pivot"), "bucket"), "buckets")
    traits = lambda end: heads.select(F.col("doc_id").alias(end), F.col("n_shingles").alias(f"n{end}"), F.col("bits").alias(f"bits{end}"))
    near = lambda pairs: pairs.where(similar_sizes("na", "nb", percent)).where(agreeing("bitsa", "bitsb") >= AGREE).select("a", "b")

    starred = crowded.where("doc_id <> pivot").select(F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b")).distinct()
    first = cut(linked(near(starred.join(traits("a"), "a").join(traits("b"), "b")), docs, k, percent), "links")
    roots = components(first)

    # What most of a bucket is linked with is known; members elsewhere meet every member of another component, in blocks.
    placed = crowded.drop("pivot").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    main = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    divided = cut(placed.join(main.select("bucket", "main"), "bucket").join(heads.select("doc_id", "n_shingles"), "doc_id"), "divided")
    second = cut(linked_in_blocks(divided, docs, k, percent), "links") if not divided.isEmpty() else first.limit(0)
    joined = components(first.union(second)) if not second.isEmpty() else roots

    members = sketched.join(classes, ["set_a", "set_b", "n_shingles"], "left").withColumn("least", F.coalesce("least", "doc_id"))
    found = members.join(joined, members["least"] == joined["node"], "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")))).alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each group, that with the smallest id.

    Rows that repeat an id stay or go together. Null and empty texts are linked with nothing and stay; rows with a null id are
    one document. No rows give none.
    """
    kept = near_duplicates(docs, k, percent).where("kept").select(F.col("doc_id").alias("__kept"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi")
