"""Source folders: hashed files, supported formats, and folders that an earlier build wrote."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pigeonhole import constants as k
from pigeonhole.session import listing_in_shares

LARGE, PIECE = 1 << 28, 1 << 23  # bytes from which a file is read in pieces, and of a piece

# How a generated tree is recognised.
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
SUMMARY_NAME = rf"(?i)^build-summary-{UUID}\.md\z"
SUMMARY_HEADER = rf"(?i)^# Local build summary\n\nRun: ({UUID})(?:\n|\z)"


def scan_source_folder(spark: SparkSession, path: str, large: int = LARGE) -> DataFrame:
    """Every file below ``path``: relative path, content hash, length, content. Unused columns cost nothing; the bytes
    are read only when the hash or the content is asked for.

    A file of more than ``large`` bytes is never a value: its content is null and it is hashed in pieces. Spark's listing
    leaves empty files out.
    """
    with listing_in_shares(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = F.lit(path.rstrip("/").removeprefix("file:") + "/")
    place = F.replace(F.regexp_replace(F.col("path"), "^file:/+", "/"), root, F.lit("")).alias("path")
    whole = files.filter(F.col("length") <= large).select(place, F.sha2("content", 256).alias("fingerprint"), "length", "content")
    pieces = hash_in_pieces(files.filter(F.col("length") > large).select("path", "length"))
    return whole.unionByName(pieces.select(place, "fingerprint", "length", F.lit(None).cast("binary").alias("content")))


def _store(name: str):
    """File system and path of a file or folder on it."""
    from pyarrow import fs

    if name.startswith("/") or name.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", name)
    return fs.FileSystem.from_uri(name)


def write_texts(lines: DataFrame, folder: str, order: list[str]) -> None:
    """One file for each ``path`` below ``folder``: the ``value`` of its rows as lines, in the given order.

    The tasks write the files themselves, a batch of lines at a time: without its native library, Spark's own writer starts
    several processes for each file on a local disk. A file gets its name when it is whole, so a repeated task leaves the same.
    """
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, stream, started = None, None, None

        def close() -> None:
            if stream:
                stream.close()
                store.move(*started)

        for batch in batches:
            paths, values = batch["path"].to_pylist(), batch["value"].to_pylist()
            edges = [0, *(i for i in range(1, len(paths)) if paths[i] != paths[i - 1]), len(paths)]
            for lo, hi in zip(edges, edges[1:]):
                if lo < hi and paths[lo] != own:
                    close()
                    own = paths[lo]
                    store, at = _store(f"{folder}/{own}")
                    parent, name = at.rsplit("/", 1)
                    store.create_dir(parent, recursive=True)
                    started = (f"{parent}/.{name}-{uuid.uuid4().hex}", at)  # hidden from listings
                    stream = store.open_output_stream(started[0])
                if lo < hi:
                    stream.write(b"".join((v or b"") + b"\n" for v in values[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])
        close()

    rows = lines.select("path", F.col("value").cast("binary").alias("value"), *order).repartition("path").sortWithinPartitions("path", *order)
    rows.select("path", "value").mapInArrow(convert, "n long").agg(F.sum("n")).collect()


def hash_in_pieces(files: DataFrame) -> DataFrame:
    """Adds the content hash of files named by ``path`` (with its scheme): a task reads one file at a time, a piece at a time."""
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for name in batch["path"].to_pylist():
                store, at = _store(name)
                digest = hashlib.sha256()
                with store.open_input_stream(at) as stream:
                    while piece := stream.read(PIECE):
                        digest.update(piece)
                hashes.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.string())], [*batch.schema.names, "fingerprint"])

    dealt = files.repartition("path").sortWithinPartitions(F.desc("length"))  # each large file is a task's work of its own
    return dealt.mapInArrow(convert, StructType([*files.schema.fields, StructField("fingerprint", StringType())]))


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def route_by_format(files: DataFrame) -> DataFrame:
    """Adds ``format`` (text after the last dot, or the whole name) and ``code`` for unsupported ones."""
    form = F.lower(F.substring_index(filename(F.col("path")), ".", -1))
    return files.withColumn("format", form).withColumn("code", F.when(~F.col("format").isin(k.SUPPORTED_FORMATS), "E_UNSUPPORTED_FORMAT"))


def discover_generated_trees(files: DataFrame) -> DataFrame:
    """Folders holding a build summary: the file name and the start of its text must both match.

    ``files``: path, content. The header is ASCII, so the bytes are read one to one: text in any encoding, or a letter cut
    in half by the end of the part that is read, can't stop the job.
    """
    head = F.decode(F.substring(F.col("content"), 1, 256), "ISO-8859-1")
    rows = files.filter(filename(F.col("path")).rlike(SUMMARY_NAME)).withColumn("run_id", F.regexp_extract(head, SUMMARY_HEADER, 1)).filter("run_id <> ''")
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    return rows.select(folder.alias("path"), "run_id", F.col("path").alias("summary_path"))


def selection_findings(chosen: DataFrame, trees: DataFrame) -> DataFrame:
    """Chosen exclusions that are the root or were not detected."""
    bad = chosen.filter("path = ''").unionByName(chosen.filter("path <> ''").join(trees.select("path"), "path", "left_anti"))
    return bad.select("path", F.lit("E_LOCAL_GENERATED_TREE_SELECTION").alias("code"))


def exclude_generated_trees(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """Files outside the chosen folders. A file's parent folders are joined by equality, so no path is compared with
    every tree. ``path`` is unique."""
    parts = F.split("path", "/")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inside = files.filter(F.size(parts) > 1).select("path", F.explode(parents).alias("_tree")).join(
        chosen.select(F.col("path").alias("_tree")), "_tree", "left_semi").select("path").distinct()
    return files.join(inside, "path", "left_anti")
