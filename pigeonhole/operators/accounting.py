"""Who has been charged: unknown, pending and batch charges, each request once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pigeonhole import constants as k
from pigeonhole.functions.json import is_object, json_token, let, parse, present
from pigeonhole.operators import costs
from pigeonhole.operators.models import model_accepted

HTTP_STEP = "^(confidence|reader|recovery)-http-"


def unaccounted_calls(calls: DataFrame) -> DataFrame:
    """Calls without a known cost per run, metadata reads excluded."""
    return (calls.filter((F.col("role") != k.METADATA) & F.col("cost_nano").isNull())
            .groupBy("run_id").agg(F.count(F.lit(1)).alias("unaccounted")))


def http_steps_without_call(checkpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """Request checkpoints whose call never reached the ledger (anti join on the attempt id)."""
    steps = checkpoints.filter(F.col("name").rlike(HTTP_STEP)).withColumn("attempt_id", F.concat_ws(
        "-", "run_id", "fingerprint", F.regexp_replace("name", "-http-", "-")))
    return steps.join(calls.select("attempt_id"), "attempt_id", "left_anti")


def pending_accounting(batches: DataFrame, events: DataFrame, checkpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """Submitted batches not yet reconciled plus unfinished requests without a ledger row, per run."""
    reconciled = (events.filter((F.col("stage") == "batch_accounting") & (F.col("kind") == "reconciled"))
                  .select("run_id", F.get_json_object("details_json", "$.batchKey").alias("batch_key")))
    open_batches = (batches.filter("remote_batch_id is not null")
                    .join(reconciled, ["run_id", "batch_key"], "left_anti").select("run_id"))
    open_steps = http_steps_without_call(checkpoints.filter(F.col("status") != "complete"), calls).select("run_id")
    return open_batches.unionByName(open_steps).groupBy("run_id").agg(F.count(F.lit(1)).alias("pending"))


def staged_charges(staged: DataFrame, rate: Column) -> DataFrame:
    """Accounting view of every staged result line.

    ``staged``: accounting_id, run_id, file_id, line_number, status_code (null without a response), has_error,
    body (JSON text), pin, pin_policy. Adds disposition, cost_nano and usage_code.
    """
    facts = lambda v: F.struct((is_object(v) & present(v, "$.usage")).alias("has_usage"), json_token(v, "$.usage").alias("usage"),
                               F.try_variant_get(v, "$.model", "string").alias("model"))
    parsed = staged.withColumn("_b", let(parse(F.col("body")), facts))
    b, status = F.col("_b"), F.col("status_code")
    unsuccessful = F.coalesce((status.isNull() & F.col("has_error")) | (status < 200) | (status >= 300), F.lit(False))
    trusted = unsuccessful | F.coalesce(model_accepted(b["model"], F.col("pin"), F.col("pin_policy")), F.lit(False))
    rows = parsed.withColumns({
        "usage_json": b["usage"], "cache_policy": F.lit("disabled"), "_trusted": trusted,
        "disposition": F.when(F.coalesce(b["has_usage"], F.lit(False)), "reported_usage").when(unsuccessful, "unsuccessful_no_usage").otherwise("unaccounted_success")})
    priced = costs.actual_usage_cost(rows, rate)
    return (priced.withColumn("cost_nano", F.when(F.col("_trusted") & (F.col("disposition") == "reported_usage"), F.col("cost_nano")))
            .drop("_b", "_trusted", "usage_json", "cache_policy"))


def charge_once(charged: DataFrame) -> DataFrame:
    """The first line per accounting id carries its charge; later lines stay in the staged table only.

    A minimum instead of a numbering window: replays of one id are combined before the shuffle.
    """
    first = F.struct("file_id", "line_number")
    payload = F.struct("run_id", "disposition", "cost_nano", "usage_code", "file_id", "line_number")
    return (charged.groupBy("accounting_id").agg(F.min_by(payload, first).alias("c"), F.count(F.lit(1)).alias("lines"))
            .select("accounting_id", "c.*", "lines"))


def charge_first(staged: DataFrame, rate: Column) -> DataFrame:
    """``charge_once`` of staged lines that are not priced yet: the first line of each id is chosen by its place, and only
    those are read and priced."""
    rest = [c for c in staged.columns if c != "accounting_id"]
    first = (staged.groupBy("accounting_id").agg(F.min_by(F.struct(*rest), F.struct("file_id", "line_number")).alias("c"), F.count(F.lit(1)).alias("lines"))
             .select("accounting_id", "c.*", "lines"))
    return staged_charges(first, rate).select("accounting_id", "run_id", "disposition", "cost_nano", "usage_code", "file_id", "line_number", "lines")


def mark_charged(staged: DataFrame, charges: DataFrame) -> DataFrame:
    """All lines, flagged when they carry the charge. The join key includes the line, so no id is hot."""
    won = charges.select("accounting_id", "file_id", "line_number", F.lit(True).alias("_won"), F.col("cost_nano").alias("_cost"))
    return (staged.join(won, ["accounting_id", "file_id", "line_number"], "left")
            .withColumn("charged", F.coalesce(F.col("_won") & F.col("_cost").isNotNull(), F.lit(False))).drop("_won", "_cost"))


def batch_cost_failure(staged: DataFrame, calls: DataFrame, runs: DataFrame) -> DataFrame:
    """What a retained batch result means for its document, first match; only under the isolating spend policy.

    ``staged``: accounting_id, run_id, status_code, body, pin, pin_policy. ``runs``: run_id, spend_policy, budget_mode.
    """
    ledger = calls.select(F.col("attempt_id").alias("accounting_id"), "cost_nano", F.lit(True).alias("_logged"))
    rows = (staged.join(ledger, "accounting_id", "left")
            .join(runs.select("run_id", "spend_policy", "budget_mode"), "run_id", "left")
            .withColumn("_b", parse(F.col("body"))))
    error = lambda name: F.try_variant_get(F.col("_b"), f"$.error.{name}", "string")
    model = F.try_variant_get(F.col("_b"), "$.model", "string")
    drift = present(F.col("_b"), "$.model") & ~F.coalesce(
        model_accepted(model, F.col("pin"), F.col("pin_policy")), F.lit(False))
    status = F.col("status_code")
    code = (F.when(F.coalesce("spend_policy", F.lit(k.SPEND_HALT)) != k.SPEND_ISOLATE, None)
            .when(drift, F.when(model.isNull() | (F.length(model) == 0), k.SCHEMA_CODE[k.READER]).otherwise(k.DRIFT_CODE[k.READER]))
            .when(status.isin(401, 403), "E_VENDOR_AUTH")
            .when((status == 404) | (error("code") == "model_not_found") | (error("param") == "model"), "E_MODEL_REJECTED")
            .when((status == 429) & error("code").isin(k.QUOTA_CODES), "E_OPENAI_QUOTA")
            .when(F.col("_logged").isNull(), "E_VENDOR_LOG")
            .when(F.col("cost_nano").isNotNull(), None)
            .when(F.col("budget_mode") != "unlimited", "E_SPEND_UNACCOUNTED")
            .otherwise("E_VENDOR_COST_UNKNOWN"))
    return (rows.withColumn("code", code)
            .withColumn("kind", F.when(F.col("code").isin("E_VENDOR_COST_UNKNOWN", "E_READER_SCHEMA"), "document").when(F.col("code").isNotNull(), "blocker"))
            .drop("_b", "_logged"))


def batch_accounting_complete(correlated: DataFrame, batches: DataFrame) -> DataFrame:
    """Every request the provider completed must have a retained line, else the batch is incomplete."""
    retained = correlated.groupBy("batch_id").agg(F.count("reference").alias("retained"))
    return (batches.select("batch_id", "completed").join(retained, "batch_id", "left")
            .withColumn("retained", F.coalesce("retained", F.lit(0)))
            .withColumn("code", F.when(F.col("retained") < F.col("completed"), "E_BATCH_ACCOUNTING_INCOMPLETE")))
