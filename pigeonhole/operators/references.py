"""Confirmed labels from a correction, and a follow-up run measured against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pigeonhole.functions.arrays import has_duplicates

STATUSES = ["label", "ambiguous", "excluded"]
REASONS = ["missing", "pending", "failures", "ambiguous", "excluded", "unconfirmed", "sourceFailures"]


def build_reference(source: DataFrame, reviewed: DataFrame, decisions: DataFrame, folder_labels: DataFrame,
                    ignored: DataFrame, corrections: DataFrame) -> DataFrame:
    """One reference entry per source document.

    ``source``: correction_id, fingerprint, destination_folder, rule. ``reviewed`` (checked confirmations and moves):
    correction_id, fingerprint, folder. ``decisions``: correction_id, fingerprint, status, labels. ``folder_labels``:
    correction_id, folder, type_id. ``ignored``: correction_id, folder. ``corrections``: correction_id, type_ids.
    Explicit decisions win; failures stay failures.
    """
    keys = ["correction_id", "fingerprint"]
    # folders resolve to labels once per folder, not once per document
    folders = (reviewed.select("correction_id", "folder").distinct()
               .join(folder_labels, ["correction_id", "folder"], "left")
               .join(ignored.select("correction_id", "folder", F.lit(True).alias("_ignored")).distinct(), ["correction_id", "folder"], "left")
               .join(corrections.select("correction_id", "type_ids"), "correction_id")
               .withColumn("_label", F.coalesce("type_id", "folder"))
               .select("correction_id", F.col("folder").alias("corrected_folder"), F.coalesce("_ignored", F.lit(False)).alias("_ignored"),
                       F.when(F.array_contains("type_ids", F.col("_label")), F.col("_label")).alias("_label")))
    checked = reviewed.select(*keys, F.col("folder").alias("corrected_folder")).join(folders, ["correction_id", "corrected_folder"])
    override = decisions.select(*keys, F.col("status").alias("_status"), F.col("labels").alias("_labels"))
    rows = source.join(checked, keys, "left").join(override, keys, "left")
    failed = F.col("rule") == "R0"
    status = (F.when(failed, "failure").when(F.col("_status").isNotNull(), F.col("_status"))
              .when(F.col("_ignored"), "excluded").when(F.col("_label").isNotNull(), "label").otherwise("unconfirmed"))
    labels = (F.when(failed, F.array().cast("array<string>")).when(F.col("_status").isNotNull(), F.col("_labels"))
              .when(F.col("_ignored"), F.array().cast("array<string>"))
              .when(F.col("_label").isNotNull(), F.array("_label")).otherwise(F.array().cast("array<string>")))
    return rows.select(*keys, F.col("destination_folder").alias("previous_folder"), F.col("rule").alias("previous_rule"), "corrected_folder",
                       F.coalesce(F.col("corrected_folder") != F.col("destination_folder"), F.lit(False)).alias("moved"),
                       status.alias("status"), labels.alias("labels"))


def label_decision_findings(decisions: DataFrame, source: DataFrame, corrections: DataFrame) -> DataFrame:
    """Decisions that may not be stored: wrong number of labels, undefined types, foreign or failed documents."""
    keys = ["correction_id", "fingerprint"]
    n = F.size("labels")
    fits = (((F.col("status") == "label") & (n == 1)) | ((F.col("status") == "ambiguous") & (n >= 2)) | ((F.col("status") == "excluded") & (n == 0)))
    count = decisions.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = (decisions.join(count, keys).join(source.select(*keys, "rule"), keys, "left").join(corrections.select("correction_id", "type_ids"), "correction_id"))
    problem = (F.when(F.col("_n") > 1, "repeated_fingerprint").when(F.col("rule").isNull(), "not_in_source_run")
               .when(~F.col("status").isin(STATUSES) | has_duplicates(F.col("labels")) | (F.size(F.array_except("labels", "type_ids")) > 0) | ~fits, "invalid_labels")
               .when(F.col("rule") == "R0", "failure_override"))
    return rows.select(*keys, problem.alias("problem")).filter("problem is not null")


def comparison_details(reference: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Reference entries joined with the follow-up run by content fingerprint, with the first reason not to compare."""
    following = documents.select(*keys, F.col("rule").alias("actual_rule"), F.col("destination_folder").alias("actual_folder"), F.lit(True).alias("_present"))
    rows = reference.join(following, keys, "left")
    present = F.col("_present").isNotNull()
    reason = (F.when(F.col("status") == "failure", "sourceFailures").when(F.col("status") != "label", F.col("status"))
              .when(~present, "missing").when(F.col("actual_rule").isNull(), "pending").when(F.col("actual_rule") == "R0", "failures"))
    state = F.when(~present, "missing").when(F.col("actual_rule").isNull(), "pending").when(F.col("actual_rule") == "R0", "failures")
    rows = rows.withColumns({"reason": reason, "next_state": state})
    comparable = F.col("reason").isNull()
    return rows.withColumns({
        "matches": F.coalesce(comparable & (F.col("actual_folder") == F.try_element_at("labels", F.lit(1))), F.lit(False)),
        "same": F.coalesce(comparable & (F.col("actual_rule") == "R1") & (F.col("actual_folder") == F.col("previous_folder")), F.lit(False)),
    }).drop("_present")


def compare_reference(details: DataFrame, reference: DataFrame, documents: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """All counts of a comparison per ``group``: two denominators with every reason beside them, and totals."""
    sides = {"moved": F.col("moved"), "filed": F.col("previous_rule") == "R1"}
    counts = [F.count(F.lit(1)).alias("source_total")]
    for name, inside in sides.items():
        counts += [F.count_if(inside).alias(f"{name}_total"), F.count_if(inside & F.col("reason").isNull()).alias(f"{name}_comparable"),
                   F.count_if(inside & F.col("matches")).alias(f"{name}_matched")]
        counts += [F.count_if(inside & (F.col("reason") == r)).alias(f"{name}_{r}") for r in REASONS]
    counts.append(F.count_if(sides["filed"] & F.col("same")).alias("filed_same"))
    counts += [F.count_if(F.col("next_state") == s).alias(s) for s in ("missing", "pending", "failures")]
    counts += [F.count_if(F.col("status") == s).alias(n) for s, n in (("ambiguous", "ambiguous"), ("excluded", "excluded"), ("unconfirmed", "unconfirmed"), ("failure", "source_failures"))]
    totals = details.groupBy(*group).agg(*counts)
    following = documents.groupBy(*group).agg(F.count(F.lit(1)).alias("next_total"))
    new = documents.join(reference.select(*keys), keys, "left_anti").groupBy(*group).agg(F.count(F.lit(1)).alias("new_documents"))
    return (totals.join(following, group, "left").join(new, group, "left")
            .withColumns({"next_total": F.coalesce("next_total", F.lit(0)), "new_documents": F.coalesce("new_documents", F.lit(0))}))


def apply_findings(applications: DataFrame, proposals: DataFrame, corrections: DataFrame) -> DataFrame:
    """Threshold applications: only the exact stored proposal, and only under the definition it was made for.

    ``applications``: correction_id, direction, threshold, active_revision_id. ``proposals``: correction_id, direction,
    threshold. ``corrections``: correction_id, definition_revision_id.
    """
    stored = proposals.select("correction_id", "direction", F.col("threshold").alias("_stored"))
    rows = applications.join(stored, ["correction_id", "direction"], "left").join(corrections.select("correction_id", "definition_revision_id"), "correction_id", "left")
    return rows.withColumn("finding", F.when(F.col("definition_revision_id").isNull(), "no_such_correction")
                           .when(F.col("active_revision_id") != F.col("definition_revision_id"), "different_definition")
                           .when(~F.col("_stored").eqNullSafe(F.col("threshold")), "not_the_stored_proposal")).drop("_stored")


def threshold_in_force(history: DataFrame, initial: float, scope: list[str], at: Column | None = None) -> DataFrame:
    """Threshold and its justification per scope, optionally as of a time."""
    rows = history if at is None else history.filter(F.col("created_at") <= at)
    latest = F.max_by(F.struct("threshold", F.col("correction_id").cast("string").alias("justification")), F.struct("created_at", "history_id"))
    found = rows.groupBy(*scope).agg(latest.alias("l"))
    return (history.select(*scope).distinct().join(found, scope, "left")
            .select(*scope, F.coalesce("l.threshold", F.lit(initial)).alias("threshold"),
                    F.coalesce("l.justification", F.lit("initial_design_threshold")).alias("justification")))
