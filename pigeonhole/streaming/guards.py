"""Live guards over the append-only ledgers.

The same questions as the batch operators, asked of streams. Keys that have been seen, running sums and the outcomes of a
block of time are keyed state of Spark's own streaming aggregates, so a micro-batch does work in its own rows and not in
what came before. Aggregates are combined per task before the shuffle, so a run with a third of all rows stays cheap.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pigeonhole import constants as k
from pigeonhole.functions.money import NANO, nano
from pigeonhole.operators import attempts, budgets, correlation
from pigeonhole.operators.models import code_by_role
from pigeonhole.sources.ledger import exists


KEEP_EPOCHS = 16  # epochs of updates after which their newest rows are written as one snapshot
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
DEFAULT_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_arrivals(rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Streaming state of the first row that has arrived for each key (update mode).

    The first row is that of the earliest micro-batch and, inside it, the first by ``order`` (all other columns where none
    is named). ``_first`` holds its other columns, ``_since`` and ``_last`` the times of the first and the newest micro-batch
    that had the key: they are equal for the keys that are new.
    """
    value = [c for c in rows.columns if c not in keys]
    timed = rows.withColumn("_at", F.current_timestamp())  # one time a micro-batch, the same one if it is repeated
    first = F.min_by(F.struct(F.lit(True).alias("_seen"), *value), F.struct("_at", *(value if order is None else order)))
    return timed.groupBy(*keys).agg(first.alias("_first"), F.min("_at").alias("_since"), F.max("_at").alias("_last"))


def write_epoch(rows: DataFrame, folder: str) -> None:
    """Store one micro-batch. An epoch whose write has ended stays as it is when the micro-batch is repeated, so its readers
    see neither other nor further files; its state is computed again all the same."""
    if exists(rows.sparkSession, f"{folder}/_SUCCESS"):
        rows.write.format("noop").mode("overwrite").save()
    else:
        rows.write.mode("overwrite").parquet(folder)


def admission_writer(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that appends the keys that are new in this micro-batch to ``path/epoch=N``."""
    def admit(batch: DataFrame, epoch: int) -> None:
        keys = [c for c in batch.columns if not c.startswith("_")]
        write_epoch(batch.filter("_since = _last").select(*keys, "_first.*").drop("_seen"), f"{path}/epoch={epoch}")
    return admit


def admit_once(rows: DataFrame, path: str, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Admit each key once, however late it or its replay arrives, and return everything admitted so far.

    Keys are state in the store of the session (RocksDB where it names none): a micro-batch looks up its own keys and reads
    neither the ledger nor other keys. There is no watermark. ``keys`` are never null.
    """
    run_batches(first_arrivals(rows, keys, order), path, admission_writer(f"{path}/ledger"), "update")
    spark, schema = rows.sparkSession, rows.select(*keys, *[c for c in rows.columns if c not in keys]).schema
    return admitted(spark, f"{path}/ledger") if exists(spark, f"{path}/ledger") else spark.createDataFrame([], schema)


def admitted(spark: SparkSession, path: str) -> DataFrame:
    """Everything admitted so far."""
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def running(once: DataFrame, path: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates over the ledger that ``admit_once`` keeps in ``path``, as running sums: only what was admitted since the
    last call is read, only the groups it belongs to are written."""
    spark = once.sparkSession
    if exists(spark, f"{path}/ledger"):
        arrived = spark.readStream.schema(once.schema).option("recursiveFileLookup", "true").parquet(f"{path}/ledger")
        run_batches(arrived.groupBy(*keys).agg(*aggregates), f"{path}/running", update_writer(f"{path}/running/rows"), "update")
    rows = newest(spark, f"{path}/running/rows", keys)
    return once.groupBy(*keys).agg(*aggregates).limit(0) if rows is None else rows


def stream_charge_once(calls: DataFrame, path: str, order: list[str] | None = None) -> DataFrame:
    """One row per attempt id of everything that has arrived; a replay or a call far behind the newest one is neither
    charged twice nor lost. Of rows that differ the first that arrived counts (``first_arrivals``). ``path`` keeps the
    ledger and the place in the stream from run to run."""
    return admit_once(calls, path, ["attempt_id"], order)


def stream_live_spend(calls: DataFrame, runs: DataFrame, path: str) -> DataFrame:
    """Spend per run of everything that has arrived, each attempt once, with the admission verdict.

    ``calls`` need an attempt_id. ``runs`` (static): run_id, spend_policy, budget_mode, limit_blended, limit_openai,
    limit_typesafe (decimals).
    """
    once = stream_charge_once(calls, path)
    inference = F.col("role") != k.METADATA
    cost, zero = nano(F.col("cost_nano")), F.lit(0).cast(NANO)
    of = lambda name: [r for r, s in k.SCOPE_OF_ROLE.items() if s == name]
    sums = [F.coalesce(F.sum(F.when(F.col("role").isin(of(n)), cost)), zero).cast(NANO).alias(n) for n in ("openai", "typesafe")]
    spend = running(once, path, ["run_id"], *sums, F.count_if(inference & F.col("cost_nano").isNull()).alias("unknown_calls"))
    spend = spend.withColumn("blended", (F.col("openai") + F.col("typesafe")).cast(NANO))
    return budgets.live_budget_failures(budgets.check_spend_admission(spend.join(runs, "run_id")))


def stream_cooldowns(calls: DataFrame) -> DataFrame:
    """Winning pause per provider with the attempt it came from (update mode); an equal or earlier deadline never
    replaces one that is recorded."""
    until = attempts.retry_after_deadline(F.col("retry_after"), F.col("created_ms"))
    rows = (calls.filter((F.col("status") == 429) & F.col("retry_after").isNotNull())
            .select(code_by_role(k.SCOPE_OF_ROLE, F.col("role")).alias("scope"), until.alias("until"), "created_ms", "attempt_id").filter("until is not null"))
    best = F.min(F.struct((-F.col("until")).alias("u"), F.col("created_ms").alias("c"), F.col("attempt_id").alias("a")))
    return rows.groupBy("scope").agg(best.alias("b")).select("scope", (-F.col("b.u")).alias("until"), F.col("b.a").alias("source_attempt_id"), F.col("b.c").alias("observed_at"))


def stream_run_progress(completions: DataFrame, runs: DataFrame, path: str) -> DataFrame:
    """Completed documents per run of everything that has arrived; ``complete`` turns true with the row that reaches the
    expected count, however late it is.

    Repeated completions of one document count once. ``runs`` (static): run_id, expected_count.
    """
    once = admit_once(completions, path, ["run_id", "fingerprint"])
    return (running(once, path, ["run_id"], F.count(F.lit(1)).alias("completed")).join(runs.select("run_id", "expected_count"), "run_id")
            .withColumn("complete", F.col("completed") == F.col("expected_count")))


def stream_first_halt(events: DataFrame, recoveries: DataFrame) -> DataFrame:
    """The first halt of the current generation per run and how many were only observed later (update mode).

    ``recoveries`` (static): run_id, recovered_at (ms); halts before it belong to a superseded generation.
    """
    halts = (events.filter("stage = 'run' and kind in ('halted', 'halt_observed')").join(recoveries.select("run_id", "recovered_at"), "run_id", "left")
             .filter("recovered_at is null or created_at >= recovered_at"))
    first = F.min(F.struct("created_at", "event_seq", "details_json"))
    return (halts.groupBy("run_id").agg(first.alias("f"), F.count(F.lit(1)).alias("n"))
            .select("run_id", F.col("f.created_at").alias("halted_at"), F.get_json_object("f.details_json", "$.code").alias("code"), (F.col("n") - 1).alias("observed")))


SUMMARY = "struct<n:bigint,lead:bigint,tail:bigint,longest:bigint,reset:boolean>"


def summary(n: Column, lead: Column, tail: Column, longest: Column, reset: Column) -> Column:
    return F.struct(n.alias("n"), lead.alias("lead"), tail.alias("tail"), longest.alias("longest"), reset.alias("reset")).cast(SUMMARY)


def nothing() -> Column:
    return summary(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(False))


def joined(a: Column, b: Column) -> Column:
    """Summary of the outcomes of ``a`` followed by those of ``b``: how many, failures at the beginning and at the end, the
    longest row of failures, whether one was no failure. It is associative, so blocks can be joined in any grouping."""
    return summary(a.n + b.n, F.when(a.reset, a.lead).otherwise(a.n + b.lead), F.when(b.reset, b.tail).otherwise(a.tail + b.n),
                   F.greatest(a.longest, b.longest, a.tail + b.lead), a.reset | b.reset)


def one_outcome(row: Column) -> Column:
    failed = row.exhausted.cast("bigint")
    return summary(F.lit(1), failed, failed, failed, ~row.exhausted)


def circuit_blocks(outcomes: DataFrame, block_ms: int) -> DataFrame:
    """Streaming summary of each (run, vendor, block of time), update mode: a late outcome finds its place in its own block."""
    place = F.struct("created_ms", "outcome_id", "exhausted")
    held = outcomes.groupBy("run_id", "vendor", F.floor(F.col("created_ms") / block_ms).alias("block")).agg(F.collect_set(place).alias("held"))
    return held.select("run_id", "vendor", "block", F.aggregate(F.array_sort("held"), nothing(), lambda a, row: joined(a, one_outcome(row))).alias("s"))


def stream_circuit_breaker(outcomes: DataFrame, path: str, limit: int = k.CIRCUIT_LIMIT, block_ms: int = 60_000) -> DataFrame:
    """Failure counters per (run, vendor) of everything that has arrived: failures, longest, tripped.

    Outcomes count in the order of (created_ms, outcome_id) whatever micro-batch they come in; one that is delivered twice
    counts once. The outcomes of a block of ``block_ms`` are state, a micro-batch writes the summaries of the blocks it
    touches, and the blocks of a run are joined when the counters are asked for.
    """
    run_batches(circuit_blocks(outcomes, block_ms), path, update_writer(f"{path}/blocks"), "update")
    spark = outcomes.sparkSession
    blocks = newest(spark, f"{path}/blocks", ["run_id", "vendor", "block"])
    if blocks is None:
        return outcomes.sparkSession.createDataFrame([], "run_id string, vendor string, failures bigint, longest bigint, tripped boolean")
    return circuit_counters(blocks, limit)


def circuit_counters(blocks: DataFrame, limit: int = k.CIRCUIT_LIMIT, days: int = 1_440) -> DataFrame:
    """Counters from block summaries, joined in two levels so that no array holds more than the blocks of ``days`` blocks."""
    fold = lambda: F.aggregate(F.array_sort(F.collect_list(F.struct("block", "s"))), nothing(), lambda a, b: joined(a, b.s)).alias("s")
    larger = blocks.groupBy("run_id", "vendor", F.floor(F.col("block") / days).alias("block")).agg(fold())
    whole = larger.groupBy("run_id", "vendor").agg(fold())
    return whole.select("run_id", "vendor", F.col("s.tail").alias("failures"), F.col("s.longest").alias("longest"), (F.col("s.longest") >= limit).alias("tripped"))


def result_stager(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that stores arriving result lines unchanged and numbered, one folder per epoch."""
    def stage(batch: DataFrame, epoch: int) -> None:
        numbered = batch.withColumn("row_order", F.monotonically_increasing_id())
        numbered.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return stage


def read_result_stream(spark: SparkSession, folder: str, files_per_batch: int = 1_000) -> DataFrame:
    """Result files arriving in ``folder``: file, place and text of each line."""
    lines = (spark.readStream.format("text").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
             .option("lineSep", "\n").load(folder))
    return lines.select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block_start"), F.col("value").alias("line"))


def stream_correlation(staged: DataFrame, expected: DataFrame, batches: DataFrame, path: str) -> DataFrame:
    """Correlation of staged lines as they arrive; only terminal batches give outcomes.

    Each line is parsed once, in the micro-batch that brings it; what the lines of a request say together is keyed state in
    ``path``. An outcome needs these rows and the expected requests, no line. ``staged``: batch_id, file_id, row_order, line.
    """
    parsed = correlation.parse_result_lines(staged.withColumnRenamed("row_order", "line_number"))
    run_batches(correlation.request_lines(parsed), path, update_writer(f"{path}/requests"), "update")
    seen = newest(staged.sparkSession, f"{path}/requests", ["batch_id", "custom_id"])
    if seen is None:
        seen = staged.sparkSession.createDataFrame([], "batch_id bigint, custom_id string, _n bigint, _good boolean, _ref struct<file_id:string,line_number:bigint>")
    return correlation.resolve_requests(seen, expected, batches.filter(F.col("status").isin(k.BATCH_TERMINAL)))


def correlate_staged(staged: DataFrame, expected: DataFrame, batches: DataFrame) -> DataFrame:
    """Correlation over everything staged so far; only terminal batches give outcomes."""
    parsed = correlation.parse_result_lines(staged.withColumnRenamed("row_order", "line_number"))
    return correlation.correlate_batch(parsed, expected, batches.filter(F.col("status").isin(k.BATCH_TERMINAL)))


def update_writer(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that stores the updated rows of a micro-batch in ``path/epoch=N``."""
    def store(batch: DataFrame, epoch: int) -> None:
        write_epoch(batch, f"{path}/epoch={epoch}")
    return store


def epochs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete epochs in ``path``, ascending."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch=*/_SUCCESS")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob)
    return sorted(int(f.getPath().getParent().getName().removeprefix("epoch=")) for f in found or [])


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """The newest row of each key of an update stream; null before the first.

    Whoever reads more than ``KEEP_EPOCHS`` epochs leaves their newest rows as a snapshot for the next reader.
    """
    whole, there = f"{path}-whole", epochs(spark, path)
    if not there:
        return None
    base = max((e for e in epochs(spark, whole) if e <= there[-1]), default=-1)
    fresh = [e for e in there if e > base]
    parts = [spark.read.option("basePath", path).parquet(*[f"{path}/epoch={e}" for e in fresh])] if fresh else []
    if base >= 0:
        parts.append(spark.read.parquet(f"{whole}/epoch={base}").withColumn("epoch", F.lit(base)))
    rows = reduce(DataFrame.unionByName, parts)
    value = [c for c in rows.columns if c not in (*keys, "epoch")]
    rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*value), "epoch").alias("_v")).select(*keys, "_v.*")
    if len(fresh) < KEEP_EPOCHS:
        return rows
    rows.write.mode("overwrite").parquet(f"{whole}/epoch={there[-1]}")
    return spark.read.parquet(f"{whole}/epoch={there[-1]}")


def run_available(df: DataFrame, path: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Process everything that has arrived, then return the result as a table.

    Append streams go to a parquet sink. Update streams are stored per epoch and the newest row of each key is kept.
    """
    spark = df.sparkSession
    if mode == "append":
        (df.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode)
         .format("parquet").option("path", f"{path}/rows").start().awaitTermination())
        return spark.read.schema(df.schema).parquet(f"{path}/rows")
    run_batches(df, path, update_writer(f"{path}/rows"), mode)
    rows = newest(spark, f"{path}/rows", keys)
    return spark.createDataFrame([], df.schema) if rows is None else rows


def run_batches(df: DataFrame, path: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process everything that has arrived with a ``foreachBatch`` function."""
    spark = df.sparkSession
    if spark.conf.get(STATE_STORE, DEFAULT_STORE) == DEFAULT_STORE:  # keys on disk instead of in memory
        spark.conf.set(STATE_STORE, ROCKSDB)
    query = df.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).foreachBatch(handle).start()
    query.awaitTermination()
    return query
