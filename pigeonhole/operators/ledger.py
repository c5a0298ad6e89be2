"""Analytics over the run, event, call and artifact ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pigeonhole import constants as k
from pigeonhole.functions.json import parse
from pigeonhole.operators.accounting import http_steps_without_call, pending_accounting, unaccounted_calls


def vendor_health(calls: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """State of the latest inference call by (created_at, attempt_id), and how many costs are unknown."""
    scope = scope or []
    inference = F.col("role") != k.METADATA
    order = F.when(inference, F.struct("created_at", "attempt_id"))
    latest = F.max_by(F.struct("role", "status", "created_at"), order)
    rows = calls.groupBy(*scope).agg(latest.alias("l"), F.count_if(inference & F.col("cost_nano").isNull()).alias("unknown_spend"))
    status = (F.when(F.col("l").isNull(), "not_contacted").when(F.col("l.status").isNull(), "no_response")
              .when(F.col("l.status").between(200, 299), "response_received").otherwise("response_failed"))
    return rows.select(*scope, status.alias("status"), F.col("l.role").alias("latest_role"),
                       F.col("l.status").alias("latest_status"), F.col("l.created_at").alias("latest_at"), "unknown_spend")


def latest_generation(recoveries: DataFrame) -> DataFrame:
    """The current recovery plan of each run."""
    return recoveries.groupBy("run_id").agg(
        F.max("generation").alias("generation"), F.max_by("recovery_id", "generation").alias("recovery_id"),
        F.max_by("created_at", "generation").alias("recovered_at"))


def recovery_progress(recoveries: DataFrame, recovery_documents: DataFrame) -> DataFrame:
    """Documents of the current plan, and how many have not been started."""
    counts = recovery_documents.groupBy("recovery_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") != "started").alias("pending"))
    return (latest_generation(recoveries).join(counts, "recovery_id", "left")
            .select("run_id", "recovery_id", "generation", F.coalesce("total", F.lit(0)).alias("total"),
                    F.coalesce("pending", F.lit(0)).alias("pending")))


def stop_reason(runs: DataFrame, events: DataFrame, recoveries: DataFrame, calls: DataFrame) -> DataFrame:
    """Why each halted run stopped: its first halt at or after the latest recovery, else the stored reason.

    Spend codes name the first call of unknown cost; ``stop_diagnosis`` says more about it.
    """
    since = recoveries.groupBy("run_id").agg(F.max("created_at").alias("_since"))
    halted = runs.filter("status = 'halted'").select("run_id", "halt_json")
    first = (events.filter("stage = 'run' and kind = 'halted'").join(since, "run_id", "left")
             .filter("_since is null or created_at >= _since").groupBy("run_id")
             .agg(F.min_by(F.struct("created_at", "details_json"), F.struct("created_at", "event_seq")).alias("_h")))
    unknown = (calls.filter((F.col("role") != k.METADATA) & F.col("cost_nano").isNull()).groupBy("run_id")
               .agg(F.min_by(F.struct("attempt_id", "role", "status"), F.struct("created_at", "attempt_id")).alias("_c")))
    details = F.coalesce(F.col("_h.details_json"), F.col("halt_json"), F.lit("{}"))
    spend = F.col("code").isin("E_SPEND_UNACCOUNTED", "E_RAW_PERSIST")
    return (halted.join(first, "run_id", "left").join(unknown, "run_id", "left")
            .withColumn("code", F.coalesce(F.get_json_object(details, "$.code"), F.lit("E_RUN_HALTED")))
            .select("run_id", "code", F.get_json_object(details, "$.message").alias("message"),
                    F.col("_h.created_at").alias("first_observed"),
                    F.when(spend, F.col("_c.attempt_id")).alias("attempt_id"), F.when(spend, F.col("_c.role")).alias("role"),
                    F.when(spend, F.col("_c.status")).alias("http_status")))


def stop_diagnosis(stopped: DataFrame, calls: DataFrame, docs: DataFrame, raw_responses: DataFrame) -> DataFrame:
    """Adds what is known about the named call: ``document, retained, oversize, headline, finding_code``.

    ``calls``: attempt_id, fingerprint, raw_key. ``docs``: run_id, fingerprint, original_filename. ``raw_responses``: raw_key,
    envelope_status, raw. A stored response is only looked at where it can tell something: whether the answer to a call that could not be
    kept was kept after all (its status must agree), and whether a refused confidence call was too large. A key outside
    the document's own folder is ``E_ARTIFACT_SCOPE``, a key without a stored value ``E_ARTIFACT_INVALID``. ``headline`` names the
    text that a pack shows: the reset of the runtime, the retained response, the size, or the general one.
    """
    named = (stopped.join(calls.select("attempt_id", "fingerprint", "raw_key"), "attempt_id", "left")
             .join(docs.select("run_id", "fingerprint", F.col("original_filename").alias("document")), ["run_id", "fingerprint"], "left")
             .join(raw_responses.select("raw_key", "envelope_status", "raw", F.lit(True).alias("_stored")), "raw_key", "left"))
    persist = (F.col("code") == "E_RAW_PERSIST") & F.col("attempt_id").isNotNull()
    refused = F.coalesce((F.col("role") == k.CONFIDENCE) & (F.col("http_status") == 400), F.lit(False))
    own = F.startswith("raw_key", F.concat_ws("/", "run_id", "fingerprint", F.lit("raw/")))
    code = F.when(persist | refused, F.when(~F.coalesce(own, F.lit(False)), "E_ARTIFACT_SCOPE").when(F.col("_stored").isNull(), "E_ARTIFACT_INVALID"))
    found = named.withColumn("finding_code", code)
    good = F.col("finding_code").isNull()
    too_large = F.coalesce(F.try_variant_get(parse(F.col("raw")), "$.error_type", "string") == "max_tokens_exceeded", F.lit(False))
    found = found.withColumns({
        "retained": good & persist & F.col("envelope_status").eqNullSafe(F.col("http_status")) & F.col("raw").isNotNull(),
        "oversize": F.when(good & refused, too_large).otherwise(F.lit(False))})
    reset = (F.col("code") == "E_INTERNAL") & F.coalesce(F.col("message").isin(LIFECYCLE_MESSAGES), F.lit(False))
    headline = F.when(F.col("oversize"), "size_unknown_usage").when(F.col("retained"), "retained_response").when(reset, "runtime_reset").otherwise("halted")
    return found.select(*stopped.columns, "document", "retained", "oversize", headline.alias("headline"), "finding_code")


# Halt codes and messages that mean infrastructure stopped the run.
LIFECYCLE_MESSAGES = [
    "Durable Object reset because its code was updated.",
    "Connection closed: this Durable Object instance is no longer active. Reconnect or retry the request.",
]
TERMINAL_WORKFLOWS = ["complete", "errored", "terminated"]


def recovery_refusals(runs: DataFrame, docs: DataFrame, recoveries: DataFrame, recovery_documents: DataFrame,
                      checkpoints: DataFrame, artifacts: DataFrame, batches: DataFrame, events: DataFrame,
                      calls: DataFrame, workflows: DataFrame) -> DataFrame:
    """Every reason a run must not be continued, one row each, from semi and anti joins."""
    reason = lambda df, text: df.select("run_id", F.lit(text).alias("reason"))
    distinct = lambda df, text: reason(df.select("run_id").distinct(), text)
    halt = F.get_json_object("halt_json", "$.code")
    message = F.coalesce(F.get_json_object("halt_json", "$.message"), F.get_json_object("halt_json", "$.detail"))
    infra = F.coalesce((halt == "E_WORKFLOW_INTERRUPTED") | ((halt == "E_INTERNAL") & message.isin(LIFECYCLE_MESSAGES)), F.lit(False))
    counted = runs.join(docs.groupBy("run_id").agg(F.count(F.lit(1)).alias("_docs")), "run_id", "left")
    plan = latest_generation(recoveries).select("run_id", "recovery_id")
    reserved = (recovery_documents.join(plan, "recovery_id")
                .select("run_id", "fingerprint", "new_workflow_id", F.col("state").alias("_state")))
    with_plan = (docs.join(reserved, ["run_id", "fingerprint"], "left")
                 .join(workflows.select("workflow_id", F.col("status").alias("_workflow")), "workflow_id", "left"))
    kept = artifacts.filter("deleted_at is null").select(F.col("key").alias("input_key"))
    open_docs = docs.filter(F.col("status") != "complete")
    parts = [
        reason(runs.filter(F.col("status") != "halted"), "not_halted"),
        reason(runs.filter((F.col("status") == "halted") & ~infra), "needs_review"),
        reason(counted.filter(~F.col("text_held") | (F.coalesce("_docs", F.lit(0)) != F.col("expected_count"))), "inputs_unavailable"),
        reason(unaccounted_calls(calls), "unaccounted_calls"),
        reason(pending_accounting(batches, events, checkpoints, calls), "pending_accounting"),
        distinct(checkpoints.filter(F.col("status") != "complete"), "open_checkpoint"),
        distinct(artifacts.filter(F.col("state") != "complete"), "open_artifact"),
        distinct(batches, "batch_submitted"),
        distinct(http_steps_without_call(checkpoints, calls), "request_without_call"),
        distinct(with_plan.filter(F.col("new_workflow_id").isNotNull() & ~F.col("new_workflow_id").eqNullSafe(F.col("workflow_id"))),
                 "plan_mismatch"),
        distinct(with_plan.filter(F.col("workflow_id").isNotNull() & ~F.coalesce(F.col("_state") == "pending", F.lit(False))
                                  & ~F.coalesce(F.col("_workflow").isin(TERMINAL_WORKFLOWS), F.lit(False))), "workflow_not_stopped"),
        distinct(open_docs.filter(F.col("failure_json").isNotNull() | F.col("input_key").isNull()), "failed_document"),
        distinct(open_docs.filter("input_key is not null").join(kept, "input_key", "left_anti"), "input_missing"),
    ]
    return reduce(DataFrame.unionByName, parts)


def recovery_eligibility(runs: DataFrame, refusals: DataFrame) -> DataFrame:
    """Runs with their refusal reasons (a fixed, short list); none means the run may continue."""
    found = refusals.groupBy("run_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return (runs.select("run_id").join(found, "run_id", "left")
            .select("run_id", F.coalesce("reasons", F.array()).alias("reasons"))
            .withColumn("eligible", F.size("reasons") == 0))


def retention_set(artifacts: DataFrame, runs: DataFrame) -> DataFrame:
    """Text-bearing artifacts still present for runs that are closing."""
    closing = runs.filter("status = 'closing'").select("run_id")
    return artifacts.filter("contains_text and deleted_at is null").join(closing, "run_id", "left_semi")


def runs_holding_text(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count_if("text_held").alias("runs_holding_text"))


def provider_waits(events: DataFrame, runs: DataFrame, now_ms: int | Column) -> DataFrame:
    """Pauses still ahead for running runs: the latest well-formed deadline per provider."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    details = parse(F.col("details_json"))
    scopes = sorted(set(k.SCOPE_OF_ROLE.values()))
    until = F.when(F.to_json(F.try_variant_get(details, "$.until", "variant")).rlike("^[0-9]{1,16}$"),
                   F.try_variant_get(details, "$.until", "bigint"))
    waiting = (events.filter("stage = 'provider_cooldown' and kind = 'waiting'")
               .select("run_id", F.try_variant_get(details, "$.scope", "string").alias("scope"), until.alias("until"))
               .filter(F.col("scope").isin(scopes) & (F.col("until") <= k.MAX_SAFE_INTEGER)))
    return (waiting.groupBy("run_id", "scope").agg(F.max("until").alias("until")).filter(F.col("until") > now)
            .join(runs.filter("status = 'running'").select("run_id"), "run_id", "left_semi"))


def consecutive_failures(outcomes: DataFrame, keys: list[str], block: Column) -> DataFrame:
    """Failures in a row at each outcome, reset by any other outcome.

    Ordered by (created_ms, outcome_id). Windows stay inside time blocks; what a block hands on is its trailing
    failures, combined over one row per block, so a single busy run is spread over its blocks.
    """
    rows = outcomes.withColumns({"_block": block, "_reset": (~F.col("exhausted")).cast("int")})
    inside = W.partitionBy(*keys, "_block").orderBy("created_ms", "outcome_id")
    rows = rows.withColumn("_resets", F.sum("_reset").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    streak = W.partitionBy(*keys, "_block", "_resets").orderBy("created_ms", "outcome_id").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_streak", F.sum(F.col("exhausted").cast("int")).over(streak))
    blocks = rows.groupBy(*keys, "_block").agg(
        F.max("_resets").alias("_r"), F.max_by("_streak", F.struct("created_ms", "outcome_id")).alias("_tail"))
    by_block = W.partitionBy(*keys).orderBy("_block")
    blocks = blocks.withColumn("_g", F.sum((F.col("_r") > 0).cast("int")).over(by_block.rowsBetween(W.unboundedPreceding, 0)))
    run_on = W.partitionBy(*keys, "_g").orderBy("_block").rowsBetween(W.unboundedPreceding, 0)
    blocks = blocks.withColumn("_out", F.sum("_tail").over(run_on))
    blocks = blocks.select(*keys, "_block", F.coalesce(F.lag("_out").over(by_block), F.lit(0)).alias("_in"))
    return (rows.join(blocks, [*keys, "_block"])
            .withColumn("consecutive", F.col("_streak") + F.when(F.col("_resets") == 0, F.col("_in")).otherwise(F.lit(0)))
            .drop("_block", "_reset", "_resets", "_streak", "_in"))


def circuit_state(outcomes: DataFrame, limit: int = k.CIRCUIT_LIMIT, block_ms: int = 3_600_000) -> DataFrame:
    """Current count, longest count and whether the limit was ever met, per run and vendor."""
    counted = consecutive_failures(outcomes, ["run_id", "vendor"], F.floor(F.col("created_ms") / block_ms))
    return (counted.groupBy("run_id", "vendor").agg(
        F.max_by("consecutive", F.struct("created_ms", "outcome_id")).alias("failures"),
        F.max("consecutive").alias("longest"))
        .withColumn("code", F.when(F.col("longest") >= limit, "E_VENDOR_CIRCUIT")))


def lineage_check(runs: DataFrame, links: DataFrame, references: DataFrame) -> DataFrame:
    """Whether each comparison run may use its reference.

    ``links``: run_id, reference_id. ``references``: reference_id, source_run_id, definition_revision_id, confirmed_by.
    """
    run = runs.select("run_id", F.col("actor"), "status", F.col("definition_revision_id").alias("_revision"))
    return (links.join(references, "reference_id", "left").join(run, "run_id", "left")
            .withColumn("finding", F.when(F.col("source_run_id").isNull(), "reference_missing")
                        .when(~F.col("confirmed_by").eqNullSafe(F.col("actor")), "different_owner")
                        .when(F.col("run_id") == F.col("source_run_id"), "same_run")
                        .when(F.col("status") != "uploading", "already_started")
                        .when(~F.col("definition_revision_id").eqNullSafe(F.col("_revision")), "different_definition"))
            .select("run_id", "reference_id", "finding"))
