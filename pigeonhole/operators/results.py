"""Manifests, result lists and run summaries built from decided documents and the call ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pigeonhole import constants as k
from pigeonhole.functions.money import money_text
from pigeonhole.operators import accounting, budgets

# Display texts are parameters; these defaults only fill a call that names none.
DEFAULT_REASONS = {
    "stage_failed": "A processing stage failed.",
    "document_notes": "The document carries notes that need a person.",
    "agreement_at_threshold": "Both opinions agree at the required certainty.",
    "low_certainty": "Both opinions agree below the required certainty.",
    "straddles_types": "The reader saw more than one type.",
    "possible_new_type": "Neither opinion found a defined type.",
    "systems_disagree": "The two opinions disagree.",
}
DEFAULT_LABELS = {
    "filed": "Filed", "failed": "Could not process", "review": "Human review", "running": "In progress",
    "uploaded": "Uploaded", "queued": "Waiting", "unavailable": "No outcome recorded",
    "details": "Details unavailable", "priority": "Review first",
}


def text_map(texts: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])


def manifest_readiness(runs: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per run: ready, or the reason a manifest must not be produced yet."""
    decided = docs.groupBy("run_id").agg(F.count("rule_id").alias("decided"))
    return (runs.select("run_id", "status", "expected_count").join(decided, "run_id", "left")
            .withColumn("decided", F.coalesce("decided", F.lit(0)))
            .withColumn("ready", F.col("status").isin("complete", "closed") & (F.col("decided") == F.col("expected_count")))
            .withColumn("code", F.when(~F.col("ready"), "E_MANIFEST_INCOMPLETE")))


def manifest_entries(decided: DataFrame, confidence: DataFrame, reader: DataFrame,
                     reasons: dict[str, str] | None = None) -> DataFrame:
    """One nested row per document. A run's manifest is this table filtered by run plus its header row;
    it is never gathered into a single value."""
    check = confidence.select("run_id", "fingerprint", F.struct("choice", "certainty", "noul").alias("confidence_check"))
    verdicts = reader.select("run_id", "fingerprint", F.col("verdicts").alias("reader"))
    return (decided.join(check, ["run_id", "fingerprint"], "left").join(verdicts, ["run_id", "fingerprint"], "left")
            .select("run_id", "fingerprint", "original_filename", "tag", "destination_folder",
                    F.col("rule_id").alias("rule"), text_map(reasons or DEFAULT_REASONS)[F.col("reason_code")].alias("reasoning_note"),
                    "notes", F.array_contains("notes", "N_OUTLINE_RECOVERED").alias("outline_recovered"),
                    "failures", "confidence_check", "reader"))


def manifest_headers(runs: DataFrame, calls: DataFrame, batches: DataFrame, events: DataFrame,
                     checkpoints: DataFrame) -> DataFrame:
    """Run-level manifest fields: frozen policies and what is known, unknown and pending in spending."""
    spend = budgets.vendor_spend(calls)
    unknown = accounting.unaccounted_calls(calls)
    pending = accounting.pending_accounting(batches, events, checkpoints, calls)
    return (runs.join(spend, "run_id", "left").join(unknown, "run_id", "left").join(pending, "run_id", "left")
            .select("run_id", "threshold", "mode",
                    money_text(F.coalesce("blended", F.lit(0))).alias("known_subtotal"),
                    F.coalesce("unaccounted", F.lit(0)).alias("unresolved_calls"),
                    F.coalesce("pending", F.lit(0)).alias("pending_accounting")))


def present_results(docs: DataFrame, labels: dict[str, str] | None = None,
                    reasons: dict[str, str] | None = None) -> DataFrame:
    """Display rows per document; ``first`` and ``position`` carry the order (disagreements lead, then input order).

    Input: run_id, fingerprint, original_filename, status, rule_id, reason_code, destination_folder,
    failure_code, failure_message, failures, notes, position.
    """
    text = {**DEFAULT_LABELS, **(labels or {})}
    known = F.coalesce(F.col("rule_id").isin("R0", "R0n", "R1", "R2", "R3", "R4", "R5"), F.lit(False))
    tone = F.when(~known, "").when(F.col("rule_id") == "R1", "filed").when(F.col("rule_id") == "R0", "failed").otherwise("review")
    waiting = F.coalesce(text_map({s: text[s] for s in ("running", "uploaded", "queued")})[F.col("status")],
                         F.lit(text["unavailable"]))
    outcome = F.when(known, text_map({s: text[s] for s in ("filed", "failed", "review")})[F.col("tone")]).otherwise(waiting)
    reason = F.when(known, F.coalesce(text_map(reasons or DEFAULT_REASONS)[F.col("reason_code")], F.lit(text["details"])))
    failure = F.when(F.col("failure_code").isNotNull() | F.col("failure_message").isNotNull(), F.concat_ws(
        ": ", F.nullif(F.col("failure_code"), F.lit("")), F.nullif(F.col("failure_message"), F.lit(""))))
    parts = F.concat(F.array(reason, failure), F.coalesce("failures", F.array()), F.coalesce("notes", F.array()))
    details = F.array_distinct(F.filter(parts, lambda p: F.length(p) > 0))
    disagree = known & (F.col("rule_id") == "R5")
    return docs.withColumn("tone", tone).select(
        "run_id", "fingerprint", "position",
        F.coalesce(F.nullif("original_filename", F.lit("")), "fingerprint").alias("filename"),
        outcome.alias("outcome"), "tone", F.array_join(details, " ").alias("reason"),
        F.when(known, F.coalesce("destination_folder", F.lit(""))).otherwise("").alias("destination"),
        F.when(disagree, text["priority"]).otherwise("").alias("priority"),
        F.when(known, F.col("rule_id")).otherwise("").alias("rule"), F.coalesce(disagree, F.lit(False)).alias("first"))


def in_display_order(results: DataFrame) -> DataFrame:
    return results.orderBy("run_id", F.desc("first"), "position")


def completed_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("run_id").agg(F.count_if(F.col("status") == "complete").alias("completed"))


def finalize_runs(runs: DataFrame, docs: DataFrame) -> DataFrame:
    """A running run completes exactly when its completed documents reach the expected count."""
    done = F.coalesce("completed", F.lit(0)) == F.col("expected_count")
    return (runs.join(completed_counts(docs), "run_id", "left")
            .withColumn("status", F.when((F.col("status") == "running") & done, "complete").otherwise(F.col("status")))
            .drop("completed"))


def run_summary(runs: DataFrame, docs: DataFrame, calls: DataFrame, batches: DataFrame, events: DataFrame,
                checkpoints: DataFrame) -> DataFrame:
    """Progress, spend by provider, unknown and pending accounting, one row per run in no order (``newest_runs`` picks a page).
    Every input is reduced to one row per run (map-side first) before the joins."""
    return (runs.join(completed_counts(docs), "run_id", "left")
            .join(budgets.vendor_spend(calls), "run_id", "left")
            .join(accounting.unaccounted_calls(calls), "run_id", "left")
            .join(accounting.pending_accounting(batches, events, checkpoints, calls), "run_id", "left")
            .select("run_id", "status", "created_at", F.col("expected_count").alias("total"),
                    F.coalesce("completed", F.lit(0)).alias("completed"),
                    money_text(F.coalesce("blended", F.lit(0))).alias("blended"),
                    money_text(F.coalesce("openai", F.lit(0))).alias("openai"),
                    money_text(F.coalesce("typesafe", F.lit(0))).alias("typesafe"),
                    F.coalesce("unaccounted", F.lit(0)).alias("unaccounted"),
                    F.coalesce("pending", F.lit(0)).alias("pending"), "text_held", "mode"))


def newest_runs(summary: DataFrame, limit: int) -> DataFrame:
    """The newest runs first; each task keeps ``limit`` of its own, so no sort spans all runs."""
    return summary.orderBy(F.desc("created_at"), "run_id").limit(limit)


def document_evidence(docs: DataFrame, confidence: DataFrame, reader: DataFrame) -> DataFrame:
    """Decision, failure, notes and validated outputs per document.

    A document without a key keeps null; a key whose stored value is missing is ``E_ARTIFACT_INVALID``.
    """
    conf = confidence.select(F.col("key").alias("confidence_key"), F.col("value").alias("confidence"))
    read = reader.select(F.col("key").alias("reader_key"), F.col("value").alias("reader"))
    lost = ((F.col("confidence_key").isNotNull() & F.col("confidence").isNull())
            | (F.col("reader_key").isNotNull() & F.col("reader").isNull()))
    return (docs.join(conf, "confidence_key", "left").join(read, "reader_key", "left")
            .withColumn("code", F.when(lost, "E_ARTIFACT_INVALID")))
