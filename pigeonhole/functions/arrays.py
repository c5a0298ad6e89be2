"""Array and position helpers that keep ordered work out of unbounded windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK = 512


def running_offsets(lengths: Column) -> Column:
    """Exclusive running sum of an ``array<bigint>`` inside the row, so line offsets need no shuffle.

    Two levels (chunks of a fixed size, then chunk bases) keep the cost close to linear in the array length.
    """
    empty = F.array().cast("array<bigint>")

    def chunk_offsets(base: Column, chunk: Column) -> Column:
        return F.aggregate(
            chunk, F.struct(base.alias("s"), empty.alias("o")),
            lambda a, x: F.struct((a["s"] + x).alias("s"), F.array_append(a["o"], a["s"]).alias("o")))

    chunks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(CHUNK)),
        lambda start: F.slice(lengths, start + 1, CHUNK))

    def add_chunk(acc: Column, chunk: Column) -> Column:
        # chunk_offsets is evaluated once: its struct is bound through a one-element transform
        return F.element_at(F.transform(
            F.array(chunk_offsets(acc["s"], chunk)),
            lambda r: F.struct(r["s"].alias("s"), F.array_append(acc["o"], r["o"]).alias("o"))), 1)

    start = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<array<bigint>>").alias("o"))
    return F.flatten(F.aggregate(chunks, start, add_chunk, lambda acc: acc["o"]))


def block_positions(df: DataFrame, keys: list[str], block: Column, order_by: list, name: str) -> DataFrame:
    """1-based position of each row inside ``keys`` without one window per key.

    ``block`` must rise with the order (a value range of the order key). Rows are numbered inside a block, and
    the block starts come from counts per block, so a key that holds a third of all rows still spreads.
    """
    with_block = df.withColumn("_bp_block", block)
    starts = (with_block.groupBy(*keys, "_bp_block").agg(F.count(F.lit(1)).alias("_bp_n"))
              .withColumn("_bp_start", F.coalesce(F.sum("_bp_n").over(
                  W.partitionBy(*keys).orderBy("_bp_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
              .select(*keys, "_bp_block", "_bp_start"))
    local = F.row_number().over(W.partitionBy(*keys, "_bp_block").orderBy(*order_by))
    return (with_block.withColumn("_bp_local", local).join(starts, [*keys, "_bp_block"])
            .withColumn(name, F.col("_bp_start") + F.col("_bp_local")).drop("_bp_block", "_bp_start", "_bp_local"))


def has_duplicates(c: Column) -> Column:
    return F.size(F.array_distinct(c)) != F.size(c)


def same_set(a: Column, b: Column) -> Column:
    """Both arrays hold exactly the same distinct values."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
