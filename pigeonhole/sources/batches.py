"""Batch request files and batch result files as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from pigeonhole.operators.requests import batch_line
from pigeonhole.session import cut


def write_batch_input(requests: DataFrame, path: str) -> None:
    """One folder per (run, group), one line per request, bodies unchanged.

    ``requests``: run_id, group_index, custom_id, body. Groups are bounded by the plan (8 MiB, or one larger request),
    so a group is one file written by one task.
    """
    lines = requests.select("run_id", "group_index", "custom_id", batch_line(F.col("custom_id"), F.col("body")).alias("value"))
    ordered = lines.repartition("run_id", "group_index").sortWithinPartitions("run_id", "group_index", "custom_id")
    ordered.select("run_id", "group_index", "value").write.mode("errorifexists").partitionBy("run_id", "group_index").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file_id, line_number, line, utf8`` for every line. Large files stay split: lines are stored with their order, so a
    line's number is its distance from the first line of its split and the lines of the splits before. No line is sorted."""
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    rows = cut(raw.select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("_start"),
                          F.monotonically_increasing_id().alias("_order"), F.is_valid_utf8("value").alias("utf8"), F.col("value").alias("line")), "lines")
    before = W.partitionBy("file_id").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    splits = rows.groupBy("file_id", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_order").alias("_first"))
    splits = cut(splits.select("file_id", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift")), "splits")
    return rows.join(splits, ["file_id", "_start"]).withColumn("line_number", F.col("_order") + F.col("_shift")).drop("_start", "_order", "_shift")


def read_batch_results(spark: SparkSession, path: str, line_limit: int | None = None) -> DataFrame:
    """Parsed envelopes with file and line number; unusable lines stay as rows with ``line_code``."""
    from pigeonhole.operators import correlation

    lines = read_lines(spark, path).withColumn("batch_id", F.regexp_extract("file_id", "batch_id=([^/]+)", 1))
    parsed = correlation.parse_result_lines(lines, line_limit) if line_limit else correlation.parse_result_lines(lines)
    return parsed.withColumn("line_code", F.when(~F.col("utf8"), "E_BATCH_UTF8").otherwise(F.col("line_code"))).drop("utf8")
