"""Inspectable proposals from a correction. Nothing here is applied; every output is a table to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pigeonhole import constants as k
from pigeonhole.functions import checks

# Fixed value: the suggested exclusion sentence (from name, to name, definition of the target).
NOT_FOR = 'Do not use "%s" when "%s" is the closer fit under this definition: "%s".'


def folder_decision_findings(decisions: DataFrame, folders: DataFrame) -> DataFrame:
    """Decisions about folders that are not open questions, repeated ones, or with an unknown action."""
    unknown = decisions.join(folders.select("correction_id", "folder"), ["correction_id", "folder"], "left_anti").select("correction_id", "folder", F.lit("not_unknown").alias("problem"))
    action = decisions.filter(~F.col("action").isin("ignore", "new_type")).select("correction_id", "folder", F.lit("action").alias("problem"))
    twice = decisions.groupBy("correction_id", "folder").count().filter("count > 1").select("correction_id", "folder", F.lit("repeated").alias("problem"))
    return unknown.unionByName(action).unionByName(twice)


def apply_folder_decisions(diff: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds ``action`` and ``included``: files in an undecided or ignored unknown folder do not count."""
    rows = diff.join(decisions.select("correction_id", "folder", "action"), ["correction_id", "folder"], "left")
    return rows.withColumn("included", F.coalesce("folder_known", F.lit(True)) | F.coalesce(F.col("action") == "new_type", F.lit(False)))


def unresolved_folders(folders: DataFrame, decisions: DataFrame) -> DataFrame:
    return folders.join(decisions.select("correction_id", "folder"), ["correction_id", "folder"], "left_anti")


def with_evidence(decided: DataFrame, evidence: DataFrame) -> DataFrame:
    """Confirmations and moves that count, with the recorded certainty, agreed type and context of their document."""
    kept = decided.filter(F.col("included") & F.col("facet").isin("confirmation", "move"))
    facts = evidence.select("run_id", F.col("tag").alias("entry_tag"), "certainty", "agreed_type", "title", F.lit(True).alias("has_evidence"))
    return kept.join(facts, ["run_id", "entry_tag"], "left")


def evidence_findings(labelled: DataFrame, corrections: DataFrame) -> DataFrame:
    """Documents whose evidence is missing or cannot support a threshold."""
    types = corrections.select("correction_id", "type_ids")
    filed = F.col("rule") == "R1"
    label = _is_review_label()
    problem = (F.when(F.col("has_evidence").isNull(), "missing")
               .when(F.col("certainty").isNotNull() & ~checks.unit(F.col("certainty")), "certainty")
               .when(F.col("agreed_type").isNotNull() & ~F.array_contains("type_ids", F.col("agreed_type")), "agreed_type")
               .when((filed | label) & F.col("certainty").isNull(), "certainty_required")
               .when(label & F.col("agreed_type").isNull(), "agreed_type_required"))
    return labelled.join(types, "correction_id").select("correction_id", "entry_tag", problem.alias("problem")).filter("problem is not null")


def _is_review_label() -> Column:
    """A person moved a low-certainty review document into a type or an accepted new type."""
    into_type = F.col("kind").eqNullSafe("human_label") | F.coalesce(F.col("action") == "new_type", F.lit(False))
    return (F.col("facet") == "move") & (F.col("rule") == "R2") & (F.col("destination_folder") == k.REVIEW_FOLDER) & into_type


def filed_check(labelled: DataFrame, corrections: DataFrame) -> DataFrame:
    """Automatically filed documents that were checked: how many, how many wrong, and what that supports.

    ``corrections``: correction_id, threshold, minimum_filed. One grouped pass, partial sums before the shuffle.
    """
    wrong = F.col("facet") == "move"
    counted = labelled.filter("rule = 'R1'").groupBy("correction_id").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(wrong).alias("wrong"), F.count_if(~wrong).alias("correct"),
        F.max(F.when(wrong, F.col("certainty"))).alias("max_wrong"), F.min(F.when(~wrong, F.col("certainty"))).alias("min_correct"))
    rows = corrections.select("correction_id", "threshold", "minimum_filed").join(counted, "correction_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    enough = F.coalesce("checked", F.lit(0)) >= F.col("minimum_filed")
    separable = (F.col("max_wrong") < F.col("min_correct")) & (F.col("min_correct") > F.col("threshold"))
    status = (F.when(~enough, "insufficient_sample").when(F.coalesce("wrong", F.lit(0)) == 0, "no_errors")
              .when(separable, "raise_proposed").otherwise("cannot_separate"))
    return rows.select("correction_id", "threshold", n("checked"), n("wrong"), n("correct"), "max_wrong", "min_correct", enough.alias("enough"), status.alias("status"))


def propose_raise(check: DataFrame) -> DataFrame:
    """The higher threshold that separates every wrong document from every correct one."""
    return check.filter("status = 'raise_proposed'").select(
        "correction_id", F.lit("raise").alias("direction"), F.col("min_correct").alias("threshold"),
        F.col("wrong").alias("wrong_sent_to_review"), F.lit(0).cast("bigint").alias("correct_sent_to_review"))


def propose_lower(labelled: DataFrame, check: DataFrame) -> DataFrame:
    """The lowest certainty of an agreeing label that no disagreeing label reaches.

    Zero errors at or above a threshold means it lies above the highest disagreeing certainty, so two grouped
    aggregates replace an ordered sweep and no correction has to sit in one window.
    """
    labels = labelled.filter(_is_review_label()).select("correction_id", "certainty", (F.col("folder") == F.col("agreed_type")).alias("agrees"))
    current = check.filter("enough").select("correction_id", F.col("threshold").alias("current"))
    worst = labels.groupBy("correction_id").agg(F.max(F.when(~F.col("agrees"), F.col("certainty"))).alias("worst"))
    bounds = current.join(worst, "correction_id")
    usable = labels.join(bounds, "correction_id").filter((F.col("certainty") < F.col("current")) & (F.col("worst").isNull() | (F.col("certainty") > F.col("worst"))))
    # every usable row agrees: a disagreeing one can not lie above the highest disagreeing certainty
    return usable.groupBy("correction_id").agg(F.min("certainty").alias("threshold"), F.count(F.lit(1)).alias("additional_automatic_labels")).select(
        "correction_id", F.lit("lower").alias("direction"), "threshold", "additional_automatic_labels", F.lit(0).cast("bigint").alias("observed_errors"))


def threshold_evidence(labelled: DataFrame) -> DataFrame:
    """The tags behind the proposals, one row each: ``raise`` from filed documents, ``lower`` from review labels."""
    return labelled.select("correction_id", "entry_tag", F.explode(F.array_compact(F.array(
        F.when(F.col("rule") == "R1", "raise"), F.when(_is_review_label(), "lower")))).alias("direction"))


def candidate_examples(labelled: DataFrame, corrections: DataFrame) -> DataFrame:
    """Confirmed or moved documents now in a defined type. A document has one file, so each tag occurs once."""
    types = corrections.select("correction_id", "type_ids")
    return (labelled.join(types, "correction_id").filter(F.array_contains("type_ids", F.col("folder")))
            .select("correction_id", "entry_tag", F.col("folder").alias("type_id"), "title"))


def candidate_exclusions(decided: DataFrame, types: DataFrame, corrections: DataFrame, sentence: str = NOT_FOR) -> DataFrame:
    """Ordered type pairs people moved documents between, with the rendered sentence.

    ``types``: type_version, id, name, what, not_for. ``corrections``: correction_id, type_version.
    """
    pairs = (decided.filter(F.col("included") & (F.col("facet") == "move") & (F.col("folder") != F.col("destination_folder")))
             .groupBy("correction_id", F.col("destination_folder").alias("from_type"), F.col("folder").alias("to_type"))
             .agg(F.count(F.lit(1)).alias("moves")))
    side = lambda name: types.select("type_version", F.col("id").alias(f"{name}_type"), *[F.col(c).alias(f"{name}_{c}") for c in ("name", "what", "not_for")])
    return (pairs.join(corrections.select("correction_id", "type_version"), "correction_id")
            .join(side("from"), ["type_version", "from_type"]).join(side("to"), ["type_version", "to_type"])
            .withColumn("candidate", F.format_string(sentence, "from_name", "to_name", "to_what")))


def exclusion_evidence(decided: DataFrame) -> DataFrame:
    """The documents behind each pair, one row each."""
    return decided.filter(F.col("included") & (F.col("facet") == "move")).select(
        "correction_id", F.col("destination_folder").alias("from_type"), F.col("folder").alias("to_type"), "entry_tag")


def proposed_id(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def new_type_stubs(folders: DataFrame, decisions: DataFrame, corrections: DataFrame) -> DataFrame:
    """Undefined type stubs for accepted folders; the id is null when it is invalid, taken, reserved or shared."""
    accepted = (folders.join(decisions.filter("action = 'new_type'").select("correction_id", "folder"), ["correction_id", "folder"])
                .withColumn("_id", proposed_id(F.col("folder"))))
    shared = accepted.groupBy("correction_id", "_id").agg(F.count(F.lit(1)).alias("_same"))
    valid = (F.col("_id").rlike(k.TYPE_ID_PATTERN) & ~F.col("_id").isin(k.RESERVED_IDS)
             & ~F.array_contains("type_ids", F.col("_id")) & (F.col("_same") == 1))
    return (accepted.join(shared, ["correction_id", "_id"]).join(corrections.select("correction_id", "type_ids"), "correction_id")
            .select("correction_id", "folder", F.when(valid, F.col("_id")).alias("id"), F.col("folder").alias("name"), "files",
                    F.lit("proposed_type_not_yet_defined").alias("status")))


def new_type_examples(decided: DataFrame, evidence: DataFrame) -> DataFrame:
    """One example row per file in an accepted folder: with its document when it has moved there, else only its name."""
    rows = decided.filter(F.col("folder_known").eqNullSafe(False) & (F.col("action") == "new_type"))
    facts = evidence.select("run_id", F.col("tag").alias("entry_tag"), "title")
    moved = rows.filter("facet = 'move'").join(facts, ["run_id", "entry_tag"], "left").select("correction_id", "folder", F.col("entry_tag").alias("tag"), "title")
    other = rows.filter("facet <> 'move'").select("correction_id", "folder", F.lit(None).cast("string").alias("tag"), F.col("filename").alias("title"))
    return moved.unionByName(other)


def proposal_evidence(docs: DataFrame, confidence: DataFrame, artifacts: DataFrame, digests: DataFrame) -> DataFrame:
    """What a correction may show about each document.

    ``docs``: run_id, tag, fingerprint, original_filename, rule, digest_key. ``confidence``: run_id, fingerprint,
    choice, certainty. ``artifacts``: key, deleted, contains_text. ``digests``: key, policy, title, lines.
    Only retained artifacts without source text are read; an unknown digest policy raises.
    """
    retained = artifacts.filter("not deleted and not contains_text").select(F.col("key").alias("digest_key"), F.lit(True).alias("_kept"))
    old = F.when(F.col("policy").isNull() | F.col("policy").isin(*k.FULL_TEXT_POLICIES), F.lit(False)).when(
        F.col("policy") == k.DIGEST_V1, F.lit(True)).otherwise(F.raise_error(F.lit("Unknown retained state policy")))
    rows = (docs.join(confidence, ["run_id", "fingerprint"], "left").join(retained, "digest_key", "left")
            .join(digests.withColumnRenamed("key", "digest_key"), "digest_key", "left"))
    usable = F.coalesce("_kept", F.lit(False)) & old
    return rows.select("run_id", "tag", "certainty", F.when(F.col("rule") == "R2", F.col("choice")).alias("agreed_type"),
                       F.when(usable, F.col("title")).otherwise(F.col("original_filename")).alias("title"),
                       F.when(usable, F.col("lines")).otherwise(F.array().cast("array<string>")).alias("lines"),
                       (~usable).alias("unavailable"), F.lit(True).alias("full_context_unavailable"))


def ready_evidence(evidence: DataFrame) -> DataFrame:
    """Documents whose context is not available, as the note attached to a proposal."""
    return evidence.filter("unavailable").select("run_id", "tag", F.lit("source_text_not_retained").alias("reason"))
