"""Type files, their versions, and which definition is in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pigeonhole import constants as k
from pigeonhole.functions.text import blank


def type_version(c: Column) -> Column:
    """Hash of the exact serialised type file."""
    return F.sha2(c, 256)


def validate_types(types: DataFrame, none_options: DataFrame) -> DataFrame:
    """Issue rows per type file.

    ``types``: type_version, position, id, name, what, not_for, examples. ``none_options``: type_version, name, what
    (one row per file, so it also lists files without any type). Repeats are found by counting, with the first
    occurrence left alone; a type file is small, but many files are checked at once.
    """
    firsts = lambda key, name: types.select("type_version", key.alias("_k"), "position").groupBy("type_version", "_k").agg(
        F.min("position").alias(name))
    id_first = firsts(F.col("id"), "_id_first").withColumnRenamed("_k", "id")
    name_first = firsts(F.lower("name"), "_name_first").withColumnRenamed("_k", "_lname")
    rows = (types.withColumn("_lname", F.lower("name")).join(id_first, ["type_version", "id"], "left")
            .join(name_first, ["type_version", "_lname"], "left"))
    bad_id = (~F.col("id").rlike(k.TYPE_ID_PATTERN) | F.col("id").isin(k.RESERVED_TYPE_IDS) | (F.col("position") > F.col("_id_first")))
    checks = [(f, blank(F.col(f)), "a value is required") for f in ("id", "name", "what", "not_for")]
    checks += [
        ("id", F.col("id").isNotNull() & bad_id, "the identifier must be unique, safe and snake_case"),
        ("name", F.col("name").isNotNull() & (F.col("position") > F.col("_name_first")), "type names must be distinct"),
        ("examples", F.coalesce(F.size("examples") < 1, F.lit(True)) | F.exists(F.coalesce("examples", F.array()), blank),
         "at least one example is required and none may be empty"),
    ]
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(detail).alias("detail")))
                                      for field, cond, detail in checks]))
    per_type = rows.select("type_version", "position", F.explode(found).alias("f")).select("type_version", "position", "f.field", "f.detail")
    counts = types.groupBy("type_version").agg(F.count(F.lit(1)).alias("_n"))
    per_file = (none_options.join(counts, "type_version", "left").select(
        "type_version", F.lit(None).cast("int").alias("position"), F.explode(F.array_compact(F.array(
            F.when(~F.coalesce("_n", F.lit(0)).between(1, k.MAX_TYPES), F.struct(
                F.lit("types").alias("field"), F.lit("define between 1 and 254 types").alias("detail"))),
            F.when(blank(F.col("name")) | blank(F.col("what")), F.struct(
                F.lit("none_of_these").alias("field"), F.lit("define the none option").alias("detail")))))).alias("f"))
        .select("type_version", "position", "f.field", "f.detail"))
    return per_type.unionByName(per_file).withColumn("code", F.lit("E_TYPE_FILE"))


def definition_change(base: Column, following: Column) -> Column:
    """Change kind from two type versions (null base: first definition)."""
    return F.when(base.isNull(), "initial").when(base == following, "cosmetic").otherwise("semantic")


def definition_threshold(kind: Column, base: Column, base_status: Column, inherit: Column) -> Column:
    """Struct ``(threshold, status)`` a new definition starts with."""
    def pair(threshold: Column, status: Column) -> Column:
        return F.struct(threshold.cast("double").alias("threshold"), status.alias("status"))
    return (F.when((kind == "cosmetic") & base.isNotNull(), pair(base, base_status))
            .when((kind == "semantic") & base.isNotNull() & inherit, pair(base, F.lit("unverified")))
            .otherwise(pair(F.lit(k.DEFAULT_THRESHOLD), F.lit("untested"))))


def active_definition(revisions: DataFrame, activations: DataFrame, scope: list[str]) -> DataFrame:
    """The revision of the latest activation per scope; derived, never stored."""
    latest = activations.groupBy(*scope).agg(F.max_by(
        F.struct("revision_id", "threshold", "threshold_status", "change_kind", "justification"),
        F.struct("created_at", "activation_id")).alias("a")).select(*scope, "a.*")
    return latest.join(revisions, [*scope, "revision_id"])


def definition_history(revisions: DataFrame, activations: DataFrame, scope: list[str]) -> DataFrame:
    """Activated revisions, newest activation first."""
    taken = activations.select(*scope, "revision_id", "threshold", "threshold_status", "change_kind",
                               F.col("created_at").alias("activated_at"))
    return revisions.join(taken, [*scope, "revision_id"]).orderBy(*scope, F.desc("activated_at"), "revision_id")


def definition_drafts(revisions: DataFrame, activations: DataFrame, scope: list[str]) -> DataFrame:
    """Revisions that were never activated."""
    return revisions.join(activations.select(*scope, "revision_id"), [*scope, "revision_id"], "left_anti")


def stale_drafts(drafts: DataFrame, active: DataFrame, scope: list[str]) -> DataFrame:
    """Drafts with a flag: their base is no longer the active revision (null equals null)."""
    current = active.select(*scope, F.col("revision_id").alias("active_revision_id"))
    return drafts.join(current, scope, "left").withColumn(
        "stale", ~F.col("base_revision_id").eqNullSafe(F.col("active_revision_id")))
