"""Run figures kept up to date from the commits of a ledger.

A refresh reads only what was appended since the last one, folds it to one row per key and adds that to a log of its own;
figures are these rows merged by key. So a question about all calls costs their runs, not their calls.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from pigeonhole import constants as k
from pigeonhole.functions.money import NANO, nano
from pigeonhole.sources import ledger as store

KEEP_PARTS = 16  # refreshes after which their rows are written as one


class Figure(NamedTuple):
    of_rows: Column
    of_parts: Callable[[Column], Column]


def add_part(spark: SparkSession, path: str, number: int, rows: DataFrame, kind: str, upto: str) -> bool:
    """Write rows aside and commit them; false, and nothing left, where another refresh has taken the number."""
    folder = f"appends/append={uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    if store.commit(spark, path, number, {"folder": folder, "least": [kind], "most": [upto]}):
        return True
    place, files = store.file_system(spark, f"{path}/{folder}")
    files.delete(place, True)
    return False


def parts_in_use(log: list[Row]) -> list[Row]:
    """The newest whole and what was added after it."""
    wholes = [i for i, c in enumerate(log) if c.least[0] == "whole"]
    return log[wholes[-1] if wholes else 0:]


def refresh(spark: SparkSession, ledger: str, path: str, keys: list[str], figures: dict[str, Figure]) -> DataFrame | None:
    """Figures per key over all committed appends of ``ledger``; ``path`` keeps what earlier refreshes have folded.

    Refreshes may run at once: each adds its part under the next number, and whoever comes second looks again. Null before
    the first append.
    """
    while True:
        log = store.commits(spark, path)
        upto = int(log[-1].most[0]) if log else -1
        new = [c for c in store.commits(spark, ledger) if int(c.number) > upto]
        if not new:
            break
        folded = store.read_appends(spark, ledger, new).groupBy(*keys).agg(*[f.of_rows.alias(n) for n, f in figures.items()])
        if add_part(spark, path, len(log), folded, "part", new[-1].number):
            log = store.commits(spark, path)
            break
    if not log:
        return None
    used = parts_in_use(log)
    merged = store.read_appends(spark, path, used).groupBy(*keys).agg(*[f.of_parts(F.col(n)).alias(n) for n, f in figures.items()])
    if len(used) > KEEP_PARTS:
        add_part(spark, path, len(log), merged, "whole", log[-1].most[0])
    return merged


def call_figures() -> dict[str, Figure]:
    """What ``vendor_spend``, ``unaccounted_calls`` and ``vendor_health`` say about the calls of a run."""
    inference, cost, zero = F.col("role") != k.METADATA, nano(F.col("cost_nano")), F.lit(0).cast(NANO)
    known = F.coalesce(F.col("role").isin(*k.SCOPE_OF_ROLE) | ((F.col("role") == k.METADATA) & (cost == 0)), F.lit(False)) | cost.isNull()
    checked = F.when(known, cost).otherwise(F.raise_error(F.lit("A recorded cost has an unknown role")))
    total = lambda c: F.coalesce(F.sum(c), zero).cast(NANO)
    spent = {scope: Figure(total(F.when(F.col("role").isin([r for r, s in k.SCOPE_OF_ROLE.items() if s == scope]), checked)), total) for scope in ("openai", "typesafe")}
    return {**spent, "other": Figure(total(F.when(~inference, checked)), total), "unaccounted": Figure(F.count_if(inference & F.col("cost_nano").isNull()), F.sum),
            "latest": Figure(F.max(F.when(inference, F.struct("created_at", "attempt_id", "role", "status"))), F.max)}


def run_calls(spark: SparkSession, ledger: str, path: str) -> DataFrame | None:
    """Spend by provider, unknown costs and the latest call of each run, refreshed from the call ledger."""
    rows = refresh(spark, ledger, path, ["run_id"], call_figures())
    if rows is None:
        return None
    latest = F.col("latest")
    status = (F.when(latest.isNull(), "not_contacted").when(latest["status"].isNull(), "no_response")
              .when(latest["status"].between(200, 299), "response_received").otherwise("response_failed"))
    return rows.select("run_id", (F.col("openai") + F.col("typesafe")).cast(NANO).alias("blended"), "openai", "typesafe", "unaccounted", status.alias("status"),
                       latest["role"].alias("latest_role"), latest["status"].alias("latest_status"), latest["created_at"].alias("latest_at"))
