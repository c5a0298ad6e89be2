"""A corrected tree against the manifest it came from, for many corrections at once.

Results are rows with a ``facet``; a folder or a correction that holds a third of all files never becomes one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pigeonhole import constants as k

FILE = ["correction_id", "run_id", "folder", "filename", "tag", "fingerprint"]


def bad_path(c: Column) -> Column:
    """Backslash, NUL, colon, or an empty, ``.`` or ``..`` part."""
    return F.coalesce((F.length(c) == 0) | c.rlike(r"[\\\x00:]") | F.exists(F.split(c, "/"), lambda p: p.isin("", ".", "..")), F.lit(True))


def full_path() -> Column:
    return F.when(F.length("folder") > 0, F.concat_ws("/", "folder", "filename")).otherwise(F.col("filename"))


def check_listing(listing: DataFrame, corrections: DataFrame, manifest: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Rows ``correction_id, code, value`` for everything that makes a listing unusable.

    ``corrections``: correction_id, run_id, type_ids, checked_folders. ``sidecars``: correction_id, path.
    """
    path_code, run_of = "E_CORRECTION_PATH", corrections.select("correction_id", "run_id")
    row = lambda df, code, value: df.select("correction_id", F.lit(code).alias("code"), value.alias("value"))
    folder_bad = (F.length("folder") > 0) & bad_path(F.col("folder"))
    name_bad = bad_path(F.col("filename")) | F.contains("filename", F.lit("/"))
    checked = corrections.select("correction_id", F.explode("checked_folders").alias("v"))
    named = checked.filter("v <> ''").unionByName(corrections.select("correction_id", F.explode("type_ids").alias("v"))).unionByName(
        sidecars.select("correction_id", F.col("path").alias("v")))
    parts = [
        row(listing.filter(folder_bad | name_bad), path_code, full_path()),
        row(listing.withColumn("_p", full_path()).groupBy("correction_id", "_p").count().filter("count > 1"),
            "E_CORRECTION_DUPLICATE_PATH", F.col("_p")),
        row(checked.filter("v = ''"), "E_CORRECTION_ROOT_FOLDER", F.col("v")),
        row(named.filter(bad_path(F.col("v"))), path_code, F.col("v")),
        row(manifest.filter(bad_path(F.col("destination_folder"))).join(run_of, "run_id"), path_code, F.col("destination_folder")),
    ]
    for key in ("tag", "fingerprint"):
        repeated = manifest.groupBy("run_id", key).count().filter(F.col("count").cast("int").isNotNull() & ((F.col("count") > 1) | F.col(key).isNull() | (F.col(key) == "")))
        parts.append(row(repeated.join(run_of, "run_id"), "E_CORRECTION_MANIFEST_IDENTITY", F.col(key)))
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def mark_ignored(listing: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Adds ``path`` and ``ignored``: junk names, anything under ``__MACOSX``, and exact sidecar paths only."""
    known = sidecars.select("correction_id", "path", F.lit(True).alias("_sidecar")).distinct()
    junk = F.col("filename").isin(k.JUNK_FILENAMES) | F.array_contains(F.split("folder", "/"), "__MACOSX")
    return (listing.withColumn("path", full_path()).join(known, ["correction_id", "path"], "left")
            .withColumn("ignored", junk | F.coalesce("_sidecar", F.lit(False))).drop("_sidecar"))


def match_listing(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each file with its manifest entry: by tag when one is given, by fingerprint only when none is.

    A given but unknown tag (the empty one too) never falls back. One equi join on a combined key; files without any
    identity skip it, so no null key gathers them in one task. Adds entry_tag, entry_fingerprint,
    destination_folder, rule, matched_by.
    """
    entry = F.struct(F.col("tag").alias("entry_tag"), F.col("fingerprint").alias("entry_fingerprint"), "destination_folder", "rule")
    keyed_manifest = manifest.select("run_id", F.explode(F.array(
        F.struct(F.concat(F.lit("t:"), "tag").alias("_key"), entry.alias("_e")),
        F.struct(F.concat(F.lit("f:"), "fingerprint").alias("_key"), entry.alias("_e")))).alias("m")).select("run_id", "m.*")
    key = F.when(F.col("tag").isNotNull(), F.concat(F.lit("t:"), "tag")).when(F.col("fingerprint").isNotNull(), F.concat(F.lit("f:"), "fingerprint"))
    keyed = listing.withColumn("_key", key)
    joined = keyed.filter("_key is not null").join(keyed_manifest, ["run_id", "_key"], "left")
    bare = keyed.filter("_key is null").withColumn("_e", F.lit(None).cast(keyed_manifest.schema["_e"].dataType))
    rows = joined.unionByName(bare)
    return rows.select(*listing.columns, "_e.*", F.when(F.col("_e").isNotNull(), F.when(
        F.col("tag").isNotNull(), "tag").otherwise("fingerprint")).alias("matched_by"))


def ambiguous_matches(matched: DataFrame) -> DataFrame:
    """Entries that more than one file claims."""
    return (matched.filter("entry_tag is not null").groupBy("correction_id", "run_id", "entry_tag")
            .agg(F.count(F.lit(1)).alias("files")).filter("files > 1")
            .withColumn("code", F.lit("E_CORRECTION_AMBIGUOUS_IDENTITY")))


def move_kind(known: Column, is_type: Column) -> Column:
    """First match; a move counts whether or not its folder was checked."""
    return (F.when(~known, "unresolved_folder")
            .when((F.col("destination_folder") == k.REVIEW_FOLDER) & is_type, "human_label")
            .when(is_type, "misfile")
            .when((F.col("folder") == k.REVIEW_FOLDER) & (F.col("rule") == "R1"), "should_not_have_been_auto_filed")
            .otherwise("other_move"))


def diff_correction(listing: DataFrame, manifest: DataFrame, corrections: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Every listed file with its facet, plus the manifest entries no file claims.

    Facets: ignored, unmatched, move (with ``kind``), confirmation, unchecked, deleted. ``folder_known`` is false for
    folders that are neither a type nor reserved.
    """
    matched, ignored = _matched(listing, manifest, sidecars)
    facts = corrections.select("correction_id", "type_ids", "checked_folders")
    is_type = F.array_contains("type_ids", F.col("folder"))
    known = is_type | F.col("folder").isin(k.RESERVED_FOLDERS)
    moved = F.col("folder") != F.col("destination_folder")
    facet = (F.when(F.col("entry_tag").isNull(), "unmatched").when(moved, "move")
             .when(known & F.array_contains("checked_folders", F.col("folder")), "confirmation").otherwise("unchecked"))
    files = (matched.join(facts, "correction_id").withColumns({"folder_known": known, "facet": facet})
             .withColumn("kind", F.when(F.col("facet") == "move", move_kind(F.col("folder_known"), is_type))))
    columns = ["correction_id", "run_id", "facet", "kind", "folder", "filename", "tag", "fingerprint", "folder_known",
               "entry_tag", "entry_fingerprint", "destination_folder", "rule", "matched_by"]
    claimed = matched.filter("entry_tag is not null").select("correction_id", F.col("entry_tag"))
    entries = corrections.select("correction_id", "run_id").join(
        manifest.select("run_id", F.col("tag").alias("entry_tag"), F.col("fingerprint").alias("entry_fingerprint"), "destination_folder", "rule"), "run_id")
    deleted = entries.join(claimed, ["correction_id", "entry_tag"], "left_anti").withColumn("facet", F.lit("deleted"))
    return (files.select(*columns)
            .unionByName(ignored.withColumn("facet", F.lit("ignored")).select("correction_id", "run_id", "facet", "folder", "filename", "tag", "fingerprint"), allowMissingColumns=True)
            .unionByName(deleted, allowMissingColumns=True))


def _matched(listing: DataFrame, manifest: DataFrame, sidecars: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = mark_ignored(listing.select(*FILE), sidecars)
    return match_listing(marked.filter("not ignored").select(*FILE), manifest), marked.filter("ignored")


def unknown_folders(diff: DataFrame) -> DataFrame:
    """Folders that need an answer, with how many files they hold (the files are the diff rows themselves)."""
    return (diff.filter("folder_known = false").groupBy("correction_id", "folder").agg(F.count(F.lit(1)).alias("files")))


def facet_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("correction_id", "facet", "kind").agg(F.count(F.lit(1)).alias("files"))


def unmatched_files(diff: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Files without a document; those in folders a person chose to ignore are left out."""
    rows = diff.filter("facet = 'unmatched'")
    if decisions is None:
        return rows
    ignored = decisions.filter("action = 'ignore'").select("correction_id", "folder")
    return rows.join(ignored, ["correction_id", "folder"], "left_anti")
