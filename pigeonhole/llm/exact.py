"""Exact deduplication by skew-safe combining: locally, by salted digest, then over salts; content decides at every stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_and_text, salt_of

SALTS = 64


def normal_form(text: str | Column) -> Column:
    """Each run of ASCII white space is one space (runs that are one space already are not touched)."""
    return F.regexp_replace(text, "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+", " ")


def sha256(text: str) -> Column:
    return F.sha2(F.col(text).cast("binary"), 256)


def duplicate_groups(docs: DataFrame, digest: Callable[[str], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id (smallest id of its equals), group_size, kept and its digest.

    Equal means the same normalised text, compared in full; the digest only deals rows out, so a weak digest gives the same
    groups. A null text is empty, and empty texts are equal. Null ids lose against any other; if a group has no other, its
    keep_id is null. Of repeated rows with the id that stays, one is kept. No rows give none.
    """
    rows = id_and_text(docs).select("doc_id", normal_form("text").alias("content"))
    rows = rows.withColumn("digest", digest("content"))
    light = cut(rows.select("doc_id", "digest", salt_of("doc_id", salts=SALTS).alias("salt")), "digests")

    # Equal rows of a task meet in the partial aggregate; equals of a salt then meet, and at most SALTS winners a group after.
    salted = rows.groupBy("digest", salt_of("doc_id", salts=SALTS).alias("salt"), "content").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("digest", "content").agg(F.min("least").alias("keep_id"), F.sum("n").alias("group_size"))
    best = cut(winners.drop("content"), "winners")
    shared = best.groupBy("digest").count().where("count > 1").select("digest")

    parts = light.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("rows")).drop("rows")
    if shared.isEmpty():  # each digest is one content
        members = light.join(parts.join(best, "digest"), ["digest", "salt"])
    else:
        members = rows.join(winners, ["digest", "content"])
    members = members.select("doc_id", "keep_id", "group_size", "digest")
    # One of several rows with the id that stays: they are numbered among themselves only.
    first = F.row_number().over(Window.partitionBy("keep_id", "digest").orderBy("doc_id")) == 1
    stays = members.where("doc_id <=> keep_id").withColumn("kept", first)
    goes = members.where("not (doc_id <=> keep_id)").withColumn("kept", F.lit(False))
    return stays.unionByName(goes)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each text, also where texts share an id or have none."""
    kept = duplicate_groups(docs).where("kept").select("doc_id", "digest")
    own = max(docs.columns, key=len) + "_digest"  # no column has this name
    rows = docs.withColumn(own, F.sha2(normal_form(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256))
    rows = rows.join(kept, rows[id_col].eqNullSafe(kept["doc_id"]) & (rows[own] == kept["digest"]), "left_semi")
    return rows.dropDuplicates([id_col, own]).drop(own)
