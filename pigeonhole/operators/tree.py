"""Folder plans, what is already there, review notes, and follow-up attempts for failed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pigeonhole import constants as k
from pigeonhole.functions.text import utf16_len
from pigeonhole.operators.requests import json_string

UNSAFE = r'[<>:"/\\|?*\x00-\x1f]'
DEVICE = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\.|$)"

# Labels inside review notes; files written earlier carry them, and a different text is a conflict.
NOTE_LABELS = {
    "title": "Document decision", "original_filename": "Original filename", "tag": "Tag", "fingerprint": "Fingerprint",
    "rule": "Decision rule", "reasoning": "Reasoning note", "failure": "Reported failure", "confidence": "Confidence check",
    "reader": "Reader", "decision": "What to decide",
    "missing": "No validated output is available. See the reasoning note.",
    "review_decision": "Choose the appropriate type folder and move this document there, or leave it for further review.",
    "failure_decision": "Resolve the reported problem, then explicitly start a new run for this document if needed.",
}


def unsafe_name(c: Column) -> Column:
    return F.coalesce((F.length(c) == 0) | c.isin(".", "..") | c.rlike(UNSAFE) | c.rlike(r"[. ]\z") | c.rlike(DEVICE), F.lit(True))


def extension(c: Column) -> Column:
    """From the last dot on, unless the name starts with it or has none."""
    dot = F.length(c) - F.length(F.substring_index(c, ".", -1))
    return F.when(dot > 1, F.substring(c, dot, F.length(c))).otherwise("")


def plan_tree(manifest: DataFrame, naming: str, destination_prefix: str, max_path: int, max_component: int) -> DataFrame:
    """Target path, sidecar path, and the first error or warning of each entry."""
    if not destination_prefix.strip() or max_path < 1 or max_component < 1 or naming not in ("original", "short"):
        raise ValueError("A destination and positive path limits are required")
    name = (F.concat("tag", extension(F.col("original_filename"))) if naming == "short" else F.concat_ws("--", "tag", "original_filename"))
    path = F.concat_ws("/", "destination_folder", name)
    rows = manifest.withColumn("path", path).withColumn("sidecar_path", F.when(
        F.col("destination_folder").isin(k.RESERVED_FOLDERS), F.concat("path", F.lit(".md"))))
    longest = F.coalesce("sidecar_path", "path")
    error = (F.when(unsafe_name(F.col("destination_folder")) | unsafe_name(F.col("original_filename")) | unsafe_name(F.col("tag")), "unsafe_name")
             .when(~F.coalesce(F.col("fingerprint").rlike(k.FINGERPRINT_PATTERN), F.lit(False)), "fingerprint"))
    long = ((utf16_len(longest) + len(destination_prefix) + 1 > max_path)
            | F.exists(F.split(longest, "/"), lambda p: utf16_len(p) > max_component))
    return rows.withColumns({"error": error, "warning": F.when(long, "long_path")})


def duplicate_tags(manifest: DataFrame) -> DataFrame:
    """Tags used twice in a run, letter case aside."""
    return (manifest.groupBy("run_id", F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("entries")).filter("entries > 1"))


def match_sources(plan: DataFrame, files: DataFrame) -> DataFrame:
    """The first path (byte order) that holds each planned document; null when there is none."""
    first = files.groupBy("fingerprint").agg(F.min("path").alias("source_path"))
    return plan.join(first, "fingerprint", "left")


def reconcile_tree(planned: DataFrame, sources: DataFrame, destination: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Status of each planned entry against the files that exist now.

    ``planned``: output of ``match_sources``. ``sources``: path, current_fingerprint. ``destination``: path, fingerprint.
    ``notes``: run_id, tag, note (sidecar text); a different text at the sidecar path is a conflict.
    """
    there = destination.select("path", F.col("fingerprint").alias("_there"))
    now = sources.select(F.col("path").alias("source_path"), F.col("current_fingerprint").alias("_now"))
    status = (F.when(F.col("_there") == F.col("fingerprint"), "already_present").when(F.col("_there").isNotNull(), "destination_conflict")
              .when(F.col("source_path").isNull(), "not_found").when(~F.col("_now").eqNullSafe(F.col("fingerprint")), "source_changed").otherwise("copied"))
    rows = planned.join(there, "path", "left").join(now, "source_path", "left").withColumn("status", status)
    if notes is not None:
        old = destination.select(F.col("path").alias("sidecar_path"), F.col("fingerprint").alias("_old"))
        rows = (rows.join(old, "sidecar_path", "left").join(notes.select("run_id", "tag", F.sha2("note", 256).alias("_new")), ["run_id", "tag"], "left")
                .withColumn("status", F.when(F.col("status").isin("copied", "already_present") & F.col("_old").isNotNull() & (F.col("_old") != F.col("_new")), "sidecar_conflict")
                            .otherwise(F.col("status"))).drop("_old", "_new"))
    return rows.drop("_there", "_now")


def build_summary(reconciled: DataFrame) -> DataFrame:
    """Counts by status per run, and whether every entry is in place."""
    done = F.col("status").isin("copied", "already_present")
    whole = reconciled.groupBy("run_id").agg(F.bool_and(done).alias("complete"))
    return reconciled.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("entries")).join(whole, "run_id")


def markdown(c: Column) -> Column:
    escaped = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(escaped, r"([\\`*_\[\]{}|])", r"\\$1")


def js_number(c: Column) -> Column:
    """A double as JavaScript prints it, for values between zero and one (and whole numbers)."""
    s = c.cast("string")
    plain = F.regexp_replace(s, r"\.0$", "")
    exact = F.regexp_replace(F.regexp_replace(s.try_cast("decimal(38,25)").cast("string"), "0+$", ""), r"\.$", "")
    tiny = F.lower(F.regexp_replace(s, r"\.0E", "E"))
    return F.when(~s.contains("E"), plain).when(F.abs(c) >= 1e-6, exact).otherwise(tiny)


def _block(lines: Column) -> Column:
    """Indented lines: an indented block cannot be closed by text inside it."""
    return F.array_join(F.transform(lines, lambda l: F.concat(F.lit("    "), l)), "\n")


def _pair(name: str, value: Column, indent: int, last: bool = False) -> Column:
    return F.concat(F.lit(" " * indent + f'"{name}": '), value, F.lit("" if last else ","))


def _string_or_null(c: Column) -> Column:
    return F.coalesce(json_string(c), F.lit("null"))


def _listed(items: Column, indent: int, name: str, last: bool = False) -> Column:
    """Lines of ``"name": [ ... ]`` for an array of JSON texts; empty arrays stay on one line."""
    end = "" if last else ","
    body = F.transform(items, lambda v, i: F.concat(F.lit(" " * (indent + 2)), v, F.when(i + 1 < F.size(items), ",").otherwise("")))
    return F.when(F.size(items) == 0, F.array(F.lit(" " * indent + f'"{name}": []{end}'))).otherwise(
        F.concat(F.array(F.lit(" " * indent + f'"{name}": [')), body, F.array(F.lit(" " * indent + f"]{end}"))))


def render_review_notes(manifest: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Adds ``note``: the Markdown text placed beside documents in the two reserved folders.

    Columns: original_filename, tag, fingerprint, rule, reasoning_note, destination_folder, failure struct(code, message)
    or null, confidence_check struct(choice, certainty, noul map) or null, reader array of structs or null.
    """
    text = {**NOTE_LABELS, **(labels or {})}
    line = lambda label, value: F.concat(F.lit(f"{text[label]}: "), value)
    failure = _block(F.array(F.lit("{"), _pair("code", json_string(F.col("failure.code")), 2), _pair("message", json_string(F.col("failure.message")), 2, True), F.lit("}")))
    check = F.col("confidence_check")
    names = F.map_keys(check["noul"])
    scores = F.transform(names, lambda n, i: F.concat(F.lit("    "), json_string(n), F.lit(": "), js_number(F.try_element_at(check["noul"], n)),
                                                      F.when(i + 1 < F.size(names), ",").otherwise("")))
    confidence = _block(F.concat(F.array(F.lit("{"), _pair("choice", json_string(check["choice"]), 2), _pair("certainty", js_number(check["certainty"]), 2), F.lit('  "noul": {')),
                                 scores, F.array(F.lit("  }"), F.lit("}"))))
    size = F.size("reader")
    verdict = lambda v, i: F.concat(
        F.array(F.lit("  {"), _pair("typeId", json_string(v["type_id"]), 4), _pair("isType", v["is_type"].cast("string"), 4), _pair("rationale", json_string(v["rationale"]), 4)),
        _listed(F.transform(v["evidence"], json_string), 4, "evidence"),
        F.array(_pair("closestAlternative", _string_or_null(v["closest_alternative"]), 4, True), F.concat(F.lit("  }"), F.when(i + 1 < size, ",").otherwise(""))))
    reader = F.when(size == 0, F.lit("    []")).otherwise(_block(F.concat(F.array(F.lit("[")), F.flatten(F.transform("reader", verdict)), F.array(F.lit("]")))))
    decision = F.when(F.col("destination_folder") == k.FAILED_FOLDER, text["failure_decision"]).otherwise(text["review_decision"])
    blank = F.lit("")
    head = F.array(F.lit(f"# {text['title']}"), blank, line("original_filename", markdown(F.col("original_filename"))), line("tag", markdown(F.col("tag"))),
                   line("fingerprint", F.col("fingerprint")), line("rule", markdown(F.col("rule"))), blank, F.lit(f"## {text['reasoning']}"), blank, markdown(F.col("reasoning_note")))
    failed = F.when(F.col("failure").isNotNull(), F.array(blank, F.lit(f"## {text['failure']}"), blank, failure)).otherwise(F.array().cast("array<string>"))
    tail = F.array(blank, F.lit(f"## {text['confidence']}"), blank, F.when(check.isNull(), text["missing"]).otherwise(confidence),
                   blank, F.lit(f"## {text['reader']}"), blank, F.when(F.col("reader").isNull(), text["missing"]).otherwise(reader),
                   blank, F.lit(f"## {text['decision']}"), blank, decision, blank)
    return manifest.withColumn("note", F.array_join(F.concat(head, failed, tail), "\n"))


def retry_candidates(docs: DataFrame) -> DataFrame:
    """Documents a follow-up run may try again: failures only. The new run keeps its parent."""
    return docs.filter((F.col("rule") == "R0") & (F.col("destination_folder") == k.FAILED_FOLDER)).select(
        F.col("run_id").alias("parent_run_id"), "fingerprint", "original_filename")


def retry_session_findings(sessions: DataFrame, documents: DataFrame) -> DataFrame:
    """Unusable retry sessions: ``session_id, problem``. ``sessions``: session_id, run_id, parent_run_id, created_at."""
    counted = documents.groupBy("session_id", "fingerprint").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(F.coalesce(F.length("original_filename") == 0, F.lit(True))).alias("_blank"))
    per = counted.groupBy("session_id").agg(
        F.max("_n").alias("_n"), F.bool_or("_blank").alias("_blank"), F.bool_and(F.coalesce(F.col("fingerprint").rlike(k.FINGERPRINT_PATTERN), F.lit(False))).alias("_hex"))
    problem = (F.when(F.coalesce(F.length("run_id") == 0, F.lit(True)) | F.coalesce(F.length("parent_run_id") == 0, F.lit(True)) | (F.col("run_id") == F.col("parent_run_id")), "run")
               .when(F.try_to_timestamp("created_at").isNull(), "time").when(F.col("_n").isNull(), "empty")
               .when(F.col("_blank") | ~F.col("_hex"), "document").when(F.col("_n") > 1, "repeated"))
    return sessions.join(per, "session_id", "left").select("session_id", problem.alias("problem")).filter("problem is not null")


def match_retry_sources(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Facets of a retry: matched (first path per document), missing documents, excluded files.

    ``documents``: session_id, fingerprint. ``files``: session_id, path, fingerprint. The first path is a minimum, and
    the other copies are found by joining on the full (document, path) key, so many copies of one file do no harm.
    """
    keys = ["session_id", "fingerprint"]
    needed = documents.select(*keys).distinct()
    first = files.groupBy(*keys).agg(F.min("path").alias("path"))
    matched = first.join(needed, keys, "left_semi").withColumn("facet", F.lit("matched"))
    missing = needed.join(first, keys, "left_anti").withColumns({"path": F.lit(None).cast("string"), "facet": F.lit("missing")})
    excluded = files.join(matched.select(*keys, "path"), [*keys, "path"], "left_anti").withColumn("facet", F.lit("excluded"))
    columns = [*keys, "path", "facet"]
    return matched.select(*columns).unionByName(missing.select(*columns)).unionByName(excluded.select(*columns))


def retry_completeness(documents: DataFrame, records: DataFrame) -> DataFrame:
    """Differences between what a retry session needs and what it has: repeated, foreign and missing documents."""
    keys = ["session_id", "fingerprint"]
    rows = lambda df, problem: df.select(*keys).withColumn("problem", F.lit(problem))
    counted = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (rows(counted.filter("_n > 1"), "repeated").unionByName(rows(counted.join(documents, keys, "left_anti"), "foreign"))
            .unionByName(rows(documents.select(*keys).distinct().join(counted, keys, "left_anti"), "missing")))


def resume_action(files: DataFrame, state: DataFrame) -> DataFrame:
    """What to do with each source file on resume. ``files``/``state``: run_id, path, fingerprint (+ state)."""
    known = state.select("run_id", "path", F.col("fingerprint").alias("_known"), "state")
    action = (F.when(F.col("_known").isNull(), "extract").when(F.col("_known") != F.col("fingerprint"), "source_changed")
              .when(F.col("state") == "uploaded", "skip").when(F.col("state") == "extracted", "upload")
              .when(F.col("state") == k.FAILED_FOLDER, "failed").otherwise("extract"))
    return files.join(known, ["run_id", "path"], "left").withColumn("action", action).drop("_known")


def validate_transitions(history: DataFrame) -> DataFrame:
    """Illegal steps of local documents. ``history``: run_id, path, step, fingerprint, state, document_fingerprint.

    One window per (run, file): a file has a handful of states.
    """
    before = W.partitionBy("run_id", "path").orderBy("step")
    rows = history.withColumns({"_state": F.lag("state").over(before), "_fp": F.lag("fingerprint").over(before)})
    now = F.col("state")
    allowed = (F.when(F.col("_state") == "not started", now.isin("not started", "extracted", k.FAILED_FOLDER))
               .when(F.col("_state") == "extracted", now.isin("extracted", "uploaded")).otherwise(now == F.col("_state")))
    problem = (F.when(~F.coalesce(F.col("fingerprint").rlike(k.FINGERPRINT_PATTERN), F.lit(False)), "identity")
               .when(F.col("document_fingerprint") != F.col("fingerprint"), "document_fingerprint")
               .when(F.col("_state").isNull(), None).when(F.col("_fp") != F.col("fingerprint"), "identity_changed")
               .when(~allowed, "transition"))
    return rows.withColumn("problem", problem).filter("problem is not null").drop("_state", "_fp")
