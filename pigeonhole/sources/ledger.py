"""Append-only ledgers kept as parquet, in ranges of runs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import StructType

from pigeonhole.functions.checks import BlockerError
from pigeonhole.session import cut

LEDGERS = ["runs", "documents", "calls", "events", "checkpoints", "artifacts", "batches", "recoveries"]


def load_ledger(spark: SparkSession, folder: str, name: str, run_ids: list[str] | None = None) -> DataFrame:
    """One ledger; naming runs opens only the row groups whose range of runs holds them."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}")
    return df if run_ids is None else df.filter(F.col("run_id").isin(run_ids))


def save_ledger(df: DataFrame, folder: str, name: str) -> None:
    """One ledger for ``load_ledger``."""
    in_run_order(df, []).write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/{name}")


def in_run_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt and sorted by run and keys: files grow with the rows and not with the runs, and their footers tell which
    runs they hold. Without a run only the keys count."""
    order = list(dict.fromkeys(["run_id", *keys] if "run_id" in df.columns else keys))
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


COMMIT = "folder string, least array<string>, most array<string>"


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system of a place, for the driver's own small files."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, path: str) -> list[Row]:
    """The appends that count, in order: folder, and the least and the largest value of every key as text."""
    pattern, store = file_system(spark, f"{path}/commits/*.json")
    there = len(store.globStatus(pattern) or [])
    if not there:
        return []
    log = spark.read.schema(COMMIT).json(f"{path}/commits").filter("folder is not null").select("*", F.regexp_extract("_metadata.file_name", "^[0-9]+", 0).alias("number"))
    found = sorted(log.collect(), key=lambda c: int(c.number))
    if len(found) < there:
        raise BlockerError(f"E_ARTIFACT_LOG: a commit of {path} is still being written")
    return found


def commit(spark: SparkSession, path: str, number: int, entry: dict) -> bool:
    """Create commit ``number``; false where another writer has it. The store creates a file that isn't there yet in one step."""
    jpath, store = file_system(spark, f"{path}/commits/{number:08d}.json")
    try:
        out = store.create(jpath, False)
    except Exception as error:
        if "AlreadyExists" in str(error):
            return False
        raise
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    return True


def read_committed(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """All rows of committed appends; what a lost or refused writer left behind is never seen."""
    return read_appends(spark, path, commits(spark, path), schema)


def read_appends(spark: SparkSession, path: str, log: list[Row], schema: StructType | None = None) -> DataFrame:
    reader = spark.read.option("basePath", f"{path}/appends")
    return (reader if schema is None else reader.schema(schema)).parquet(*[f"{path}/{c.folder}" for c in log]).drop("append")


def append_immutable(df: DataFrame, path: str, keys: list[str], receipts: str | None = None) -> None:
    """Create-only append: a key that exists in its run, or occurs twice, stops it and leaves no visible row.

    Rows are written aside and count once a numbered commit file names them, which only one writer can create; a writer that
    comes second looks at what the first has committed and tries the next number. Only appends whose ranges of keys meet the
    new ones are opened. The input is evaluated once. With ``receipts`` the
    intent (``writing``) is recorded first and ``complete`` after the commit, so a lost job leaves a visible trace. Read with
    ``read_committed``.
    """
    df = cut(df, "append")
    spark, own = df.sparkSession, df.select(*keys)
    by_run = ["run_id"] if "run_id" in df.columns else []
    ranged = list(dict.fromkeys([*keys, *by_run]))

    def refuse(rows: DataFrame, what: str) -> None:
        found = rows.take(1)
        if found:
            raise BlockerError(f"E_ARTIFACT_EXISTS: {what} {found[0].asDict()}")

    def receipt(state: str) -> None:
        if receipts:
            own.select("*", F.lit(state).alias("state"), F.current_timestamp().alias("written_at")).write.mode("append").parquet(receipts)

    def check(log: list[Row]) -> None:
        near = meeting(log, least, most)
        if near:
            stored = read_appends(spark, path, near, df.schema)
            if by_run:  # only the runs that the new rows belong to
                stored = stored.join(df.select("run_id").distinct(), "run_id", "left_semi")
            refuse(own.join(stored.select(*keys), keys, "left_semi"), "taken key")

    refuse(own.groupBy(*keys).count().filter("count > 1"), "repeated key")
    edges = df.agg(*[f(F.col(c).cast("string")) for f in (F.min, F.max) for c in ranged]).first()
    least, most = list(edges[:len(ranged)]), list(edges[len(ranged):])
    log = commits(spark, path)
    check(log)
    receipt("writing")
    folder = f"appends/append={uuid.uuid4().hex}"
    in_run_order(df, keys).write.parquet(f"{path}/{folder}")
    try:
        number = int(log[-1].number) + 1 if log else 0
        while not commit(spark, path, number, {"folder": folder, "least": least, "most": most}):
            log = [c for c in commits(spark, path) if int(c.number) >= number]
            check(log)
            number = int(log[-1].number) + 1
    except BlockerError:
        jpath, store = file_system(spark, f"{path}/{folder}")
        store.delete(jpath, True)
        raise
    receipt("complete")


def meeting(log: list[Row], least: list[str | None], most: list[str | None]) -> list[Row]:
    """The appends whose range of every key meets the given one."""
    apart = lambda c: any(None in (a, b, x, y) or b < x or y < a for a, b, x, y in zip(c.least, c.most, least, most))
    return [c for c in log if not apart(c)]


def artifact_states(receipts: DataFrame, keys: list[str]) -> DataFrame:
    """Current state per key: complete once it has been, else still writing."""
    return receipts.groupBy(*keys).agg(F.min("state").alias("state"))


def save_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int) -> None:
    """Document-keyed table stored in buckets: later joins on the same keys (text with verdicts, states with
    requests) read matching buckets side by side and move no text."""
    df.write.mode("errorifexists").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def write_manifest(entries: DataFrame, headers: DataFrame, path: str) -> None:
    """Immutable manifest: entry rows as JSON lines per run, and one header row per run; an existing one is an error."""
    headers.write.mode("errorifexists").partitionBy("run_id").json(f"{path}/headers")
    entries.write.mode("errorifexists").partitionBy("run_id").json(f"{path}/entries")
