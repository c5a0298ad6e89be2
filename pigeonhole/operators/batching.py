"""Size-bounded request groups, batch input checks, run mode and run estimates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pigeonhole import constants as k
from pigeonhole.session import cut


def group_findings(requests: DataFrame) -> DataFrame:
    """Blockers of a group plan: missing or repeated documents, impossible or oversized requests."""
    rows = requests.groupBy("run_id", "fingerprint").agg(F.count(F.lit(1)).alias("_n"), F.min("bytes").alias("_lo"), F.max("bytes").alias("_hi"))
    code = (F.when(F.coalesce(F.length("fingerprint") == 0, F.lit(True)) | (F.col("_n") > 1), "E_BATCH_GROUP")
            .when(F.coalesce(F.col("_lo") < 1, F.lit(True)), "E_BATCH_GROUP").when(F.col("_hi") > k.SINGLE_BYTES, "E_BATCH_GROUP_MEMORY"))
    return rows.select("run_id", "fingerprint", code.alias("code")).filter("code is not null").withColumn("kind", F.lit("blocker"))


def _next_starts(sizes: np.ndarray, limit: int, rows: int) -> np.ndarray:
    """For a group that starts at each row, the row the following group starts at (may be the row count)."""
    n = len(sizes)
    before = np.concatenate(([0], np.cumsum(sizes)))
    full = np.searchsorted(before[1:], before[:-1] + limit, side="right")
    found = np.minimum(full, np.arange(n) + rows)
    # a request above the limit is a group of its own
    return np.where(sizes > limit, np.arange(n) + 1, found).clip(max=n)


TABLE = "run_id string, node bigint, start bigint, before bigint, block_bytes bigint, block_rows bigint, out_bytes bigint, out_rows bigint, opened bigint"
NUMBERS = ["start", "before", "block_bytes", "block_rows", "out_bytes", "out_rows", "opened"]
FAN = 8  # blocks joined at once


class BlockTable:
    """What a run of rows makes of the group that is open before it.

    Entry i tells, if its first i rows still join that group, how the rows end: bytes and rows of the group then open, and how
    many groups were begun. There is an entry for every i that the limits allow, so no table has more than a group's rows.
    """

    def __init__(self, before, block_bytes, block_rows, out_bytes, out_rows, opened):
        self.before, self.bytes, self.rows = before, int(block_bytes), int(block_rows)
        self.out_bytes, self.out_rows, self.opened = out_bytes, out_rows, opened

    @classmethod
    def of_rows(cls, sizes: np.ndarray, limit: int, rows: int) -> BlockTable:
        n, nxt = len(sizes), _next_starts(sizes, limit, rows)
        total = np.concatenate(([0], np.cumsum(sizes)))
        last = min(int(np.searchsorted(total[1:], limit, side="right")), rows, n)
        at = np.arange(last + 1)
        begin, opened = at.copy(), np.zeros(last + 1, np.int64)
        while (live := np.flatnonzero(at < n)).size:  # one step a group, for all starts at once
            begin[live] = at[live]
            at[live] = nxt[at[live]]
            opened[live] += 1
        ends = np.minimum(begin, n - 1)
        closed = (begin >= n) | (sizes[ends] > limit)
        return cls(total[:last + 1], total[n], n, np.where(closed, 0, total[n] - total[ends]), np.where(closed, 0, n - ends), opened)

    def after(self, held: np.ndarray, count: np.ndarray, limit: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes and rows of the open group after these rows, and the groups begun, for open groups of ``held`` bytes and ``count`` rows."""
        start = np.minimum(np.searchsorted(self.before[1:], limit - held, side="right"), np.minimum(rows - count, self.rows))
        start = np.where(count == 0, 0, start)
        whole, at = start >= self.rows, np.minimum(start, len(self.before) - 1)
        return (np.where(whole, held + self.bytes, self.out_bytes[at]), np.where(whole, count + self.rows, self.out_rows[at]), np.where(whole, 0, self.opened[at]))

    def then(self, other: BlockTable, limit: int, rows: int) -> BlockTable:
        """The table of these rows followed by the other ones."""
        n = min(len(self.before), self.rows)
        out_bytes, out_rows, more = other.after(self.out_bytes[:n], self.out_rows[:n], limit, rows)
        parts = [(self.before[:n], out_bytes, out_rows, self.opened[:n] + more)]
        if len(self.before) > self.rows:  # all rows may join the group before them, and more of the next
            fits = (self.bytes + other.before <= limit) & (self.rows + np.arange(len(other.before)) <= rows)
            parts.append(tuple(x[fits] for x in (self.bytes + other.before, other.out_bytes, other.out_rows, other.opened)))
        before, out_bytes, out_rows, opened = (np.concatenate(x) for x in zip(*parts))
        return BlockTable(before, self.bytes + other.bytes, self.rows + other.rows, out_bytes, out_rows, opened)

    def to_arrow(self, run: str, node: int) -> pa.Table:
        n = len(self.before)
        columns = (np.arange(n), self.before, np.full(n, self.bytes), np.full(n, self.rows), self.out_bytes, self.out_rows, self.opened)
        return pa.table({"run_id": pa.array([run] * n), "node": pa.array(np.full(n, node)), **{c: pa.array(v, pa.int64()) for c, v in zip(NUMBERS, columns)}})

    @classmethod
    def all_in(cls, table: pa.Table) -> Iterator[tuple[int, BlockTable]]:
        """The tables of one run by node, ascending."""
        table = table.select(["node", *NUMBERS]).sort_by([("node", "ascending"), ("start", "ascending")])
        cols = {c: table[c].to_numpy() for c in table.column_names}
        edges = [0, *(np.flatnonzero(np.diff(cols["node"])) + 1), len(cols["node"])]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                yield int(cols["node"][lo]), cls(cols["before"][lo:hi], cols["block_bytes"][lo], cols["block_rows"][lo], *(cols[c][lo:hi] for c in ("out_bytes", "out_rows", "opened")))


def plan_batch_groups(requests: DataFrame, block_rows: int = 50_000, limit: int = k.GROUP_BYTES, rows: int = k.BATCH_MAX_REQUESTS) -> DataFrame:
    """``group_index`` per request: greedy packing in fingerprint order per run.

    A group closes on the request that would pass the byte or row limit. The packing is sequential, but not the work: all
    requests are ordered over tasks in blocks of about ``block_rows``, so a run has as many blocks as its size asks for.
    Each block tells how it ends for every way the group before it may end (``BlockTable``). Neighbouring tables are joined, eight
    at a time, until one is left; going down again each block learns the group that is open where it begins, and all blocks
    are packed at once. No task holds more than a block of rows or eight tables.
    """
    keyed = requests.select("run_id", "fingerprint", F.col("bytes").cast("bigint").alias("bytes"))
    blocks = max(1, -(-keyed.count() // block_rows))
    keyed = cut(keyed.repartitionByRange(blocks, "run_id", "fingerprint").withColumn("node", F.spark_partition_id().cast("bigint")), "requests")

    def table_of(key: tuple, rows_of: pa.Table) -> pa.Table:
        sizes = rows_of.sort_by("fingerprint")["bytes"].to_numpy()
        return BlockTable.of_rows(sizes, limit, rows).to_arrow(key[0].as_py(), key[1].as_py())

    def joined(key: tuple, tables: pa.Table) -> pa.Table:
        whole = reduce(lambda a, b: a.then(b, limit, rows), (t for _, t in BlockTable.all_in(tables)))
        return whole.to_arrow(key[0].as_py(), key[1].as_py())

    def walk(key: tuple, states: pa.Table, tables: pa.Table) -> pa.Table:
        held, count, groups = (int(states[c][0].as_py()) for c in ("in_bytes", "in_rows", "in_groups"))
        out = []
        for node, t in BlockTable.all_in(tables):
            out.append((key[0].as_py(), node, held, count, groups))
            (held,), (count,), (more,) = t.after(np.array([held]), np.array([count]), limit, rows)
            held, count, groups = int(held), int(count), groups + int(more)
        return pa.table({c: pa.array(v, pa.string() if c == "run_id" else pa.int64()) for c, v in zip(("run_id", "node", "in_bytes", "in_rows", "in_groups"), zip(*out))})

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("fingerprint")
        sizes, n = table["bytes"].to_numpy(), table.num_rows
        held, count, base = (int(table[c][0].as_py()) for c in ("in_bytes", "in_rows", "in_groups"))
        nxt, at = _next_starts(sizes, limit, rows), 0
        group = np.empty(n, np.int64)
        if count:
            at = min(int(np.searchsorted(np.cumsum(sizes), limit - held, side="right")), max(rows - count, 0), n)
            group[:at] = base - 1
        while at < n:
            group[at:nxt[at]] = base
            base, at = base + 1, nxt[at]
        return pa.table({"run_id": table["run_id"], "fingerprint": table["fingerprint"], "bytes": sizes, "group_index": group})

    above = F.floor(F.col("node") / FAN).cast("bigint")
    levels, width = [cut(keyed.groupBy("run_id", "node").applyInArrow(table_of, TABLE), "block-tables")], blocks
    while width > FAN:
        levels.append(cut(levels[-1].groupBy("run_id", above.alias("parent")).applyInArrow(joined, TABLE), "block-tables"))
        width = -(-width // FAN)
    zero = F.lit(0).cast("bigint")
    states = keyed.select("run_id").distinct().select("run_id", zero.alias("node"), zero.alias("in_bytes"), zero.alias("in_rows"), zero.alias("in_groups"))
    for tables in reversed(levels):
        by_parent = tables.withColumn("parent", above).groupBy("run_id", "parent")
        states = states.withColumnRenamed("node", "parent").groupBy("run_id", "parent").cogroup(by_parent).applyInArrow(
            walk, "run_id string, node bigint, in_bytes bigint, in_rows bigint, in_groups bigint")
    return keyed.join(states, ["run_id", "node"]).groupBy("run_id", "node").applyInArrow(
        pack, "run_id string, fingerprint string, bytes bigint, group_index bigint")


def group_summary(planned: DataFrame) -> DataFrame:
    return planned.groupBy("run_id", "group_index").agg(F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"),
                                                        F.min("fingerprint").alias("first_fingerprint"), F.max("fingerprint").alias("last_fingerprint"))


def validate_batch_input(entries: DataFrame, max_bytes: int = k.BATCH_MAX_BYTES, max_requests: int = k.BATCH_MAX_REQUESTS) -> DataFrame:
    """Counts and first problem of each batch. ``entries``: batch_id, custom_id, line, role, model, model_policy, pin, pin_policy.

    Repeats are counted per (batch, id) first, so one repeated id is combined before it meets its batch.
    """
    wrong = (F.col("role") != k.READER) | (F.col("model") != F.col("pin")) | (F.col("model_policy") != F.col("pin_policy"))
    per_id = entries.groupBy("batch_id", "custom_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length("line").cast("bigint") + 1).alias("_b"), F.bool_or(wrong).alias("_w"))
    rows = per_id.groupBy("batch_id").agg(F.sum("_n").alias("requests"), F.sum("_b").alias("input_bytes"), F.max("_n").alias("_most"),
                                          F.bool_or("_w").alias("_w"), F.bool_or(F.coalesce(F.length("custom_id") == 0, F.lit(True))).alias("_blank"))
    code = (F.when(F.col("requests") > max_requests, "E_BATCH_INPUT_LIMIT").when((F.col("_most") > 1) | F.col("_blank"), "E_BATCH_INPUT")
            .when(F.col("_w"), "E_BATCH_MODEL").when(F.col("input_bytes") > max_bytes, "E_BATCH_INPUT_LIMIT"))
    return rows.select("batch_id", "requests", "input_bytes", code.alias("code"))


def suggest_run_mode(runs: DataFrame) -> DataFrame:
    """Adds ``mode``: the explicit choice, else batch from the cutoff on, else the default; unusable settings raise.

    Columns: choice, document_count, default_mode, batch_cutoff.
    """
    usable = F.col("default_mode").isin("interactive", "batch") & (F.col("batch_cutoff") >= 1) & F.coalesce(F.col("document_count") >= 0, F.lit(True))
    mode = F.coalesce("choice", F.when(F.col("document_count") >= F.col("batch_cutoff"), "batch"), "default_mode")
    return runs.withColumn("mode", F.when(F.coalesce(usable, F.lit(False)), mode).otherwise(F.raise_error(F.lit("Run mode settings are not usable"))))


def estimate_run(docs: DataFrame, packs: DataFrame, pack_key: str) -> DataFrame:
    """Shortest interactive time at the published limits per run, and whether the batch allowance is exceeded.

    ``docs``: pack key, failed, reader_input_tokens. ``packs``: pack key, mode, reader_max_output_tokens, confidence_rpm,
    reader_rpm, reader_tpm, batch_allowance. Failed documents are left out; one unknown count makes the time unknown.
    """
    active = ~F.col("failed")
    tokens = F.col("reader_input_tokens")
    rows = docs.groupBy(pack_key).agg(
        F.count_if(active).alias("documents"), F.coalesce(F.bool_and(F.when(active, tokens.isNotNull())), F.lit(True)).alias("known"),
        F.coalesce(F.sum(F.when(active, tokens)), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.bool_or(F.when(active, tokens < 0)), F.lit(False)).alias("_bad")).join(packs, pack_key)
    n = F.col("documents").cast("double")
    total = F.col("input_tokens") + F.col("documents") * F.col("reader_max_output_tokens")
    slowest = F.greatest(n / F.col("confidence_rpm"), n / F.col("reader_rpm"), total / F.col("reader_tpm"))
    limits = F.col("confidence_rpm").isNotNull() & F.col("reader_rpm").isNotNull() & F.col("reader_tpm").isNotNull()
    seconds = F.when(F.col("known"), F.when(F.col("documents") == 0, F.lit(0)).when(limits, F.ceil(slowest * 60)))
    code = (F.when(F.col("known") & F.col("_bad"), "E_TOKEN_COUNT")
            .when(F.col("known") & (F.col("mode") == "batch") & (F.col("input_tokens") > F.col("batch_allowance")), "E_BATCH_CAPACITY"))
    return rows.select(pack_key, "documents", seconds.cast("bigint").alias("interactive_seconds"), F.lit(24).alias("batch_hours"), code.alias("code"))
