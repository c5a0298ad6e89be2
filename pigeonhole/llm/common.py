"""What the corpus operators share: column selection, the normal forms of text, shard files and Arrow loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pigeonhole.session import cut, new_folder  # noqa: F401  (used by the operators)

SPACE = "[\\x20\\x09-\\x0D]+"  # ASCII white space, as in the contracts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under its own names; other columns can't clash. A null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def spread(rows: int, per_task: int, least: int = 1) -> int:
    """Partitions so that none holds more than per_task rows (or bytes) on average."""
    return max(least, -(-rows // per_task))


def arrow_map(df: DataFrame, schema: str, convert: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    return df.mapInArrow(convert, schema)


def salt_of(*cols: str | Column, salts: int) -> Column:
    """A salt that depends on the row's own values only, so a repeated task deals its rows out alike."""
    return F.pmod(F.xxhash64(*cols, F.lit(17)), F.lit(salts)).cast("int")


def open_store(folder: str):
    """File system and path of a folder, for tasks that write or read shard files: local, hdfs, s3 and the like."""
    from pyarrow import fs

    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder.removeprefix("file:")


def strings(column: pa.Array) -> list[str]:
    """The texts of a column; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


CHUNK = 2 << 20


def row_chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[pa.Array]:
    """Runs of texts of about ``size`` bytes together, so that the words of a whole batch never exist at once."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // size
    for at in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
        if len(at):
            yield texts.slice(at[0], len(at))


BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Inside it, tasks hand rows to Python in batches of about 4 MB, however long the texts are. Spark's own batches of 10,000
    rows stand several times outside the heap while their buffers are doubled."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)
