"""First-match filing rules, their input checks, tags and upload admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pigeonhole import constants as k
from pigeonhole.functions import checks
from pigeonhole.functions.arrays import block_positions, has_duplicates, same_set


def reader_yes(verdicts: Column) -> Column:
    """Types the reader answered yes to."""
    return F.transform(F.filter(verdicts, lambda v: v["is_type"]), lambda v: v["type_id"])


def note_policy(c: Column) -> Column:
    known = F.coalesce(c, F.lit(k.NOTES_ALL))
    return F.when(known.isin(k.NOTES_ALL, k.NOTES_STRUCTURAL_INFO), known).otherwise(
        F.raise_error(F.concat(F.lit("Unknown note policy: "), known)))


def _blocking_notes() -> Column:
    info = F.array(*[F.lit(n) for n in k.STRUCTURAL_NOTES])
    return (F.when(note_policy(F.col("note_policy")) == k.NOTES_ALL, F.size("notes") > 0)
            .otherwise(F.exists("notes", lambda n: ~F.array_contains(info, n))))


def _needs_outputs() -> Column:
    """Model outputs only matter past the failure and note rules."""
    return (F.size("failures") == 0) & ~_blocking_notes()


def decide(docs: DataFrame) -> DataFrame:
    """First matching rule per document, as one ``when`` chain.

    Input: ``type_ids, threshold, failures, notes, note_policy, choice, certainty, noul, reader_yes``.
    """
    score = F.try_element_at("noul", "choice")
    yes_count = F.size("reader_yes")
    agrees = F.coalesce(
        (F.col("choice") != k.NONE_OPTION) & (score >= 0.5) & (yes_count == 1)
        & (F.try_element_at("reader_yes", F.lit(1)) == F.col("choice")), F.lit(False))
    all_low = F.forall(F.map_values("noul"), lambda v: v < 0.5)
    rule = (F.when(F.size("failures") > 0, "R0")
            .when(_blocking_notes(), "R0n")
            .when(agrees & (F.col("certainty") >= F.col("threshold")), "R1")
            .when(agrees, "R2")
            .when(yes_count >= 2, "R3")
            .when((yes_count == 0) & (F.col("choice") == k.NONE_OPTION) & all_low, "R4")
            .otherwise("R5"))
    with_rule = docs.withColumn("rule_id", rule)
    r = F.col("rule_id")
    by_rule = F.create_map(*[F.lit(x) for x in (
        "R0", "stage_failed", "R0n", "document_notes", "R1", "agreement_at_threshold", "R2", "low_certainty",
        "R3", "straddles_types", "R4", "possible_new_type", "R5", "systems_disagree")])
    filed = F.when(r == "R1", F.col("choice"))
    return with_rule.withColumns({
        "outcome": F.when(r == "R0", k.FAILED_FOLDER).when(r == "R1", "filed").otherwise("review"),
        "reason_code": by_rule[r],
        "type_id": filed,
        "priority": F.when(r == "R5", F.lit(1)),
        "destination_folder": F.when(r == "R0", F.lit(k.FAILED_FOLDER)).otherwise(
            F.coalesce(filed, F.lit(k.REVIEW_FOLDER))),
    })


def validate_decision_inputs(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Blocker rows for unusable rule input. Output checks stay silent where an earlier rule already decides."""
    ids, code = F.col("type_ids"), "E_DECISION_INPUT"
    plain = [
        ("types must be defined", F.size(ids) > 0),
        ("types must be unique", ~has_duplicates(ids)),
        ("types must be safe identifiers",
         F.forall(ids, lambda i: i.rlike(k.TYPE_ID_PATTERN) & ~i.isin(k.RESERVED_IDS))),
        ("threshold must be between zero and one", checks.unit(F.col("threshold"))),
        ("failures must be nonempty codes", F.forall("failures", lambda x: F.length(x) > 0)),
        ("notes must be nonempty codes", F.forall("notes", lambda x: F.length(x) > 0)),
        ("note policy must be known", F.coalesce(F.col("note_policy"), F.lit(k.NOTES_ALL)).isin(
            k.NOTES_ALL, k.NOTES_STRUCTURAL_INFO)),
        ("informational notes need a full-text state", ~F.coalesce(
            F.col("note_policy") == k.NOTES_STRUCTURAL_INFO, F.lit(False))
         | F.coalesce(F.col("state_policy").isin(k.FULL_TEXT_POLICIES), F.lit(False))),
    ]
    outputs = [
        ("choice must be a defined option", F.array_contains(ids, F.col("choice")) | (F.col("choice") == k.NONE_OPTION)),
        ("certainty must be between zero and one", checks.unit(F.col("certainty"))),
        ("scores must cover exactly the types", same_set(F.map_keys("noul"), ids)),
        ("scores must be between zero and one", F.forall(F.map_values("noul"), checks.unit)),
        ("reader answers must be defined types", F.size(F.array_except("reader_yes", ids)) == 0),
        ("reader answers must not repeat", ~has_duplicates(F.col("reader_yes"))),
    ]
    usable = F.col("note_policy").isNull() | F.col("note_policy").isin(k.NOTES_ALL, k.NOTES_STRUCTURAL_INFO)
    needed = F.when(usable, _needs_outputs()).otherwise(F.lit(False))
    rules = [(code, checks.BLOCKER, d, p) for d, p in plain]
    rules += [(code, checks.BLOCKER, d, ~needed | p) for d, p in outputs]
    first = checks.first_finding(rules)
    return (docs.select(*keys, first.alias("_f")).filter("_f is not null")
            .select(*keys, "_f.code", "_f.kind", "_f.detail"))


def tag_text(run_id: Column, number: Column) -> Column:
    digits = number.cast("string")
    return F.concat(F.lit("r"), F.substring(run_id, 1, 8), F.lit("-"),
                    F.when(number < 10_000, F.lpad(digits, 4, "0")).otherwise(digits))


def assign_tags(docs: DataFrame, order: str = "preflight_order", block_size: int = 65_536) -> DataFrame:
    """Tags in preflight order. Numbers come from blocks of the order key, so one huge run still spreads."""
    numbered = block_positions(docs, ["run_id"], F.floor(F.col(order) / block_size), [order], "tag_number")
    return numbered.withColumn("tag", tag_text(F.col("run_id"), F.col("tag_number")))


def admit_uploads(uploads: DataFrame, preflight: DataFrame) -> DataFrame:
    """One verdict per uploaded (run, fingerprint); repeats are combined before the shuffle.

    ``uploads``: run_id, fingerprint, input_hash, original_filename, failure_code (null when extraction worked).
    ``preflight``: run_id, fingerprint, original_filename, failed.
    """
    seen = uploads.groupBy("run_id", "fingerprint").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("input_hash").alias("_h1"), F.max("input_hash").alias("_h2"),
        F.min("original_filename").alias("_n1"), F.max("original_filename").alias("_n2"),
        F.max("failure_code").alias("failure_code"))
    quoted = preflight.select("run_id", "fingerprint", F.col("original_filename").alias("_quoted"),
                              F.col("failed").alias("_failed"))
    status = (F.when(F.col("_quoted").isNull(), "not_in_preflight")
              .when((F.col("_n1") != F.col("_quoted")) | (F.col("_n2") != F.col("_quoted")), "filename_differs")
              .when(F.col("_h1") != F.col("_h2"), "conflict")
              .when(F.col("failure_code").isNotNull() != F.col("_failed"), "preflight_differs")
              .when(F.col("failure_code").isNotNull(), "failed_locally")
              .otherwise("uploaded"))
    return (seen.join(quoted, ["run_id", "fingerprint"], "left").withColumn("status", status)
            .withColumn("rule_id", F.when(F.col("status") == "failed_locally", "R0"))
            .select("run_id", "fingerprint", "copies", "status", "failure_code", "rule_id"))
