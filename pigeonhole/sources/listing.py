"""Listings of corrected trees: tags and sidecars recognised from the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pigeonhole import constants as k
from pigeonhole.operators.tree import extension

SUMMARY_FILE = r"^build-summary-[0-9a-f-]{36}\.md$"


def recognise(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Listing rows from raw files (correction_id, run_id, path, fingerprint).

    ``tag`` is the manifest tag the name starts with (followed by ``--`` or a dot), found by joining the possible
    prefixes of a name; ``sidecar`` marks review notes and build summaries. Junk files are left out; a tagged file
    carries no fingerprint.
    """
    name = F.substring_index("path", "/", -1)
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    rows = files.withColumns({"filename": name, "folder": folder}).filter(
        ~F.col("filename").isin(k.JUNK_FILENAMES) & ~F.array_contains(F.split("path", "/"), "__MACOSX"))
    ends = F.filter(F.sequence(F.lit(1), F.length("filename")), lambda i: (F.substring(F.col("filename"), i, F.lit(1)) == ".") | (F.substring(F.col("filename"), i, F.lit(2)) == "--"))
    prefixes = rows.select("correction_id", "run_id", "path", F.explode(F.transform(ends, lambda i: F.substring(F.col("filename"), F.lit(1), i - 1))).alias("tag"))
    tags = manifest.select("run_id", "tag")
    found = prefixes.join(tags, ["run_id", "tag"]).groupBy("correction_id", "path").agg(F.min_by("tag", F.length("tag")).alias("tag"))
    names = manifest.select("run_id", F.explode(F.array(
        F.concat(F.concat_ws("--", "tag", "original_filename"), F.lit(".md")), F.concat("tag", extension(F.col("original_filename")), F.lit(".md")))).alias("filename")).distinct()
    sidecar = rows.select("correction_id", "run_id", "path", "filename").join(names, ["run_id", "filename"], "left_semi").select("correction_id", "path", F.lit(True).alias("_note"))
    out = rows.join(found, ["correction_id", "path"], "left").join(sidecar, ["correction_id", "path"], "left")
    return out.select("correction_id", "run_id", "path", "folder", "filename", "tag", F.when(F.col("tag").isNull(), F.col("fingerprint")).alias("fingerprint"),
                      (F.coalesce("_note", F.lit(False)) | F.col("filename").rlike(SUMMARY_FILE)).alias("sidecar"))


def load_listing(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """A stored listing (parquet: correction_id, run_id, path, fingerprint) with tags and sidecars recognised."""
    return recognise(spark.read.parquet(path), manifest)
