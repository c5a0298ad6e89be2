"""Token files: flat unsigned integers with 64-bit document offsets, written and memory-mapped by tasks.

A shard is three flat files: ``.ids`` (unsigned 16-bit where the vocabulary allows, else 32-bit, every document closed by id
0), ``.offsets`` (unsigned 64-bit, where each document begins in the shard, one entry more at the end) and ``.docs`` (signed
64-bit document ids). Documents ascend by id within and across shards. The manifest, a Parquet table with one row per shard,
names the files of the attempts that Spark committed and the ids before each shard, so files of repeated or lost attempts
are never read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_and_text, new_folder, open_store, spread
from .wordcode import coder_of, vocabulary

KNOWN_WORDS = 1_500_000  # a worker remembers, twice at most
NO_ID = -(2**63)  # stands for a null document id in .docs
MANIFEST = "shard int, path string, width int, documents long, tokens long"
LOADED = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, folder: str, vocab: str, spaced: bool = True, shard_bytes: int = 16 << 20) -> DataFrame:
    """Encode every document and write its shards to ``folder``; returns the manifest with the base of each shard.

    Null texts are empty: such a document is its end id alone. Documents with a null id come first. Repeated rows are kept
    one by one; the order among rows of one id is not defined. No rows give an empty manifest. One shard holds one range of
    ids of about ``shard_bytes`` of text, so a task never holds more than a batch of it.
    """
    rows = id_and_text(docs)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranged = rows.repartitionByRange(spread(size, shard_bytes), "doc_id").sortWithinPartitions("doc_id")

    def write(batches):
        coder, store, at = coder_of(vocab, spaced, KNOWN_WORDS), None, None
        kind = np.dtype("<u2" if coder.library.get_vocab_size() <= 1 << 16 else "<u4")
        offsets, ids_of, total, out = [np.zeros(1, np.int64)], [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store, at = open_store(folder)
                path = f"{at}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                out = store.open_output_stream(f"{path}.ids")
            ids_of.append(batch["doc_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8"))
            for ids, places in coder.encode(batch["text"]):
                out.write(ids.astype(kind).tobytes())
                offsets.append(places[1:] + total)
                total += int(places[-1])
        if out is None:
            return
        out.close()
        for end, values in ((".offsets", np.concatenate(offsets).astype("<u8")), (".docs", np.concatenate(ids_of))):
            with store.open_output_stream(path + end) as side:
                side.write(values.tobytes())
        name = f"{folder}/{path.rpartition('/')[2]}"
        yield pa.RecordBatch.from_pylist([{"shard": TaskContext.get().partitionId(), "path": name, "width": kind.itemsize, "documents": sum(map(len, ids_of)), "tokens": total}],
                                         pa.schema([("shard", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    store, at = open_store(folder)
    store.create_dir(at)
    manifest = cut(ranged.mapInArrow(write, MANIFEST), "token-manifest")
    return manifest.withColumn("base", F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["base"])  # one row per shard


class Shard:
    """One shard, memory-mapped where its files are local: ``shard[i]`` are the ids of its i-th document."""

    def __init__(self, path: str, width: int):
        self.ids, self.offsets, self.docs = self.load(f"{path}.ids", f"<u{width}"), self.load(f"{path}.offsets", "<u8"), self.load(f"{path}.docs", "<i8")

    @staticmethod
    def load(path: str, kind: str) -> np.ndarray:
        store, at = open_store(path)
        if store.type_name == "local":
            return np.memmap(at, kind, "r") if store.get_file_info(at).size else np.empty(0, kind)
        with store.open_input_file(at) as file:
            return np.frombuffer(file.read(), kind)

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[int(self.offsets[i]):int(self.offsets[i + 1])]


def read_token_files(manifest: DataFrame, tasks: int) -> DataFrame:
    """Per document, from the files: its id, the ids before it in the whole corpus, its ids and their checksum as 32-bit."""
    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"], row["width"])
                for i in range(0, len(shard), 8192):
                    part = range(i, min(i + 8192, len(shard)))
                    docs = [int(x) for x in shard.docs[i:i + 8192]]
                    start = shard.offsets[i:part.stop].astype("i8") + row["base"]
                    length = np.diff(shard.offsets[i:part.stop + 1].astype("i8"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([None if x == NO_ID else x for x in docs], pa.int64()), pa.array(start), pa.array(length),
                         pa.array([zlib.crc32(shard[k].astype("<u4").tobytes()) for k in part], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("path", "width", "base", "shard").repartition(tasks, "shard").mapInArrow(read, LOADED)


def encode_round_trip(docs: DataFrame, vocab: str = "byte_bpe_50k.json") -> DataFrame:
    """Write the token files of all documents to the shared folder and read every document back."""
    spark = docs.sparkSession
    manifest = cut(write_token_files(docs, new_folder(spark, "tokens"), vocabulary(vocab)), "token-bases")
    return read_token_files(manifest, spread(manifest.count(), 2))
