"""Batch result lines against the requests that were sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pigeonhole import constants as k
from pigeonhole.functions import json as js
from pigeonhole.operators.models import model_accepted, pin_valid


def parse_result_lines(lines: DataFrame, line_limit: int = k.BATCH_LINE_BYTES) -> DataFrame:
    """Envelope columns of each line, with ``line_code`` for lines that cannot be used.

    Input: batch_id, file_id, line_number, line. Adds custom_id, status_code, has_response, has_error, body, line_code and
    what the body says about itself (has_model, model, error_code, error_param), so that nothing parses it again.
    """
    def read(v: Column) -> Column:
        text = lambda path: F.when(js.is_string(v, path), F.try_variant_get(v, path, "string"))
        # malformed: absent, not an object, no integer status or no body; or neither a response nor an error
        enveloped = F.coalesce(js.json_token(v, "$.response.status_code").rlike("^-?[0-9]+$") & js.present(v, "$.response.body"), F.lit(False))
        no_response = js.present(v, "$.response") & F.coalesce(js.json_token(v, "$.response") == "null", F.lit(False))
        failed = js.present(v, "$.error") & ~F.coalesce(js.json_token(v, "$.error") == "null", F.lit(False))

        def columns(custom_id: Column, here: Column) -> Column:
            code = (F.when(F.length("line") == 0, "E_BATCH_RESULT")
                    .when(F.octet_length("line") > line_limit, "E_BATCH_RESULT_LIMIT")
                    .when(custom_id.isNull(), "E_BATCH_RESULT")
                    .when(~here & ~(no_response & failed), "E_BATCH_RESULT"))
            return F.struct(
                custom_id.alias("custom_id"), F.when(here, F.try_variant_get(v, "$.response.status_code", "int")).alias("status_code"),
                here.alias("has_response"), failed.alias("has_error"), js.json_token(v, "$.response.body").alias("body"), code.alias("line_code"),
                js.present(v, "$.response.body.model").alias("has_model"), text("$.response.body.model").alias("model"),
                text("$.response.body.error.code").alias("error_code"), text("$.response.body.error.param").alias("error_param"))
        return js.let(text("$.custom_id"), lambda c: js.let(enveloped, lambda e: columns(c, e)))

    rows = lines.withColumn("line", F.regexp_replace("line", "\r$", "")).withColumn("_r", js.let(js.parse(F.col("line")), read))
    return rows.select(*lines.columns, "_r.*")


def _known(parsed: DataFrame, expected: DataFrame) -> DataFrame:
    wanted = expected.select("batch_id", "custom_id", F.lit(True).alias("_expected"))
    return parsed.join(wanted, ["batch_id", "custom_id"], "left")


def correlation_blockers(parsed: DataFrame, expected: DataFrame, batches: DataFrame) -> DataFrame:
    """Lines that stop the whole correlation: malformed or unknown lines, drifted models, refused credentials;
    also batches that are not terminal. ``batches``: batch_id, status, pin, pin_policy."""
    rows = _known(parsed, expected).join(batches, "batch_id")
    accepted = F.coalesce(model_accepted(F.col("model"), F.col("pin"), F.col("pin_policy")), F.lit(False))
    code = (F.when(F.col("line_code").isNotNull(), F.col("line_code"))
            .when(F.col("_expected").isNull(), "E_BATCH_RESULT")
            .when(F.col("has_model") & ~pin_valid(F.col("pin"), F.col("pin_policy"), F.lit(k.READER)), "E_MODEL_POLICY")
            .when(F.col("has_model") & ~accepted, k.DRIFT_CODE[k.READER])
            .when(F.col("status_code").isin(401, 403), "E_VENDOR_AUTH")
            .when((F.col("status_code") == 404) | (F.col("error_code") == "model_not_found") | (F.col("error_param") == "model"), "E_MODEL_REJECTED"))
    lines = rows.select("batch_id", "file_id", "line_number", "custom_id", code.alias("code")).filter("code is not null")
    open_batches = batches.filter(~F.col("status").isin(k.BATCH_TERMINAL)).select(
        "batch_id", F.lit(None).cast("string").alias("file_id"), F.lit(None).cast("bigint").alias("line_number"),
        F.lit(None).cast("string").alias("custom_id"), F.lit("E_BATCH_NOT_TERMINAL").alias("code"))
    return lines.unionByName(open_batches).withColumn("kind", F.lit("blocker"))


def request_lines(parsed: DataFrame) -> DataFrame:
    """What the lines of each request say together: usable lines, whether all are good, the last one's place (also as a
    streaming aggregate). Lines without a request count under an empty id."""
    place = F.struct("file_id", "line_number")
    # counted under a condition rather than filtered first: a filter would move below the parse and run it twice
    usable = F.col("line_code").isNull()
    good = F.col("has_response") & F.col("status_code").between(200, 299) & ~F.col("has_error")
    # a key that is never null also keeps the join from adding such a filter (requests have no empty id)
    return parsed.withColumn("custom_id", F.coalesce("custom_id", F.lit(""))).groupBy("batch_id", "custom_id").agg(
        F.count_if(usable).alias("_n"), F.bool_and(F.when(usable, good)).alias("_good"), F.max(F.when(usable, place)).alias("_ref"))


def resolve_requests(seen: DataFrame, expected: DataFrame, batches: DataFrame) -> DataFrame:
    """One row per expected request from what its lines say: its result, or why there is none."""
    absent = (F.when(F.col("status") == "expired", "E_BATCH_EXPIRED").when(F.col("status") == "cancelled", "E_BATCH_CANCELLED")
              .when(F.col("status") == "failed", "E_BATCH_FAILED").otherwise("E_BATCH_MISSING_RESULT"))
    code = (F.when(F.col("_n").isNull(), absent).when(F.col("_n") > 1, "E_BATCH_DUPLICATE_RESULT")
            .when(~F.col("_good"), "E_BATCH_DOCUMENT"))
    reference = F.when(F.col("_ref").isNotNull(), F.concat_ws(":", "_ref.file_id", F.col("_ref.line_number").cast("string")))
    return (expected.join(batches.select("batch_id", "status"), "batch_id").join(seen.filter("_n > 0"), ["batch_id", "custom_id"], "left")
            .select("batch_id", "custom_id", code.alias("code"), reference.alias("reference")))


def correlate_batch(parsed: DataFrame, expected: DataFrame, batches: DataFrame) -> DataFrame:
    """One row per expected request: its result, or why there is none.

    Lines are reduced to one row per request before the join, so repeated lines of one id cannot form a hot group.
    """
    return resolve_requests(request_lines(parsed), expected, batches)


def strict_blockers(parsed: DataFrame, expected: DataFrame) -> DataFrame:
    """Whole-file reading: malformed, unexpected, repeated and missing ids each stop it (empty lines are skipped).

    One pass: lines and expectations are counted per id before they meet, and an id can carry several problems.
    """
    keys = ["batch_id", "custom_id"]
    bad = F.col("line_code").isNotNull()
    lines = parsed.filter(F.length("line") > 0).groupBy(*keys).agg(F.count_if(bad).alias("_bad"), F.count_if(~bad).alias("_good"))
    wanted = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("_wanted"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    problems = F.array_compact(F.array(
        F.when(n("_bad") > 0, "malformed"), F.when((n("_good") > 0) & (n("_wanted") == 0), "unexpected"), F.when((n("_good") > 1) & (n("_wanted") > 0), "duplicate"),
        F.when((n("_good") == 0) & (n("_wanted") > 0), "missing"), F.when(n("_wanted") > 1, "expected_twice")))
    return lines.join(wanted, keys, "full").select(*keys, F.explode(problems).alias("problem")).withColumn("code", F.lit("E_BATCH_RESULT"))


def parse_batch_status(rows: DataFrame) -> DataFrame:
    """Status bodies to columns plus ``code`` (``E_BATCH_SCHEMA`` / ``E_BATCH_ID``), first failing check."""
    def read(v: Column) -> Column:
        text = lambda path: F.when(js.is_string(v, path), F.try_variant_get(v, path, "string"))
        ident = lambda path: F.coalesce(text(path).rlike("^[a-zA-Z0-9_-]+$"), F.lit(False))
        file_ok = lambda path: F.coalesce(js.kind(v, path) == "VOID", F.lit(False)) | ident(path)
        count = lambda name: F.coalesce(js.json_token(v, f"$.request_counts.{name}").rlike("^[0-9]{1,16}$"), F.lit(False))
        head = F.coalesce(text("$.status").isin(k.BATCH_STATUSES) & (text("$.endpoint") == "/v1/responses")
                          & (text("$.completion_window") == "24h"), F.lit(False))
        code = (F.when(~head, "E_BATCH_SCHEMA")
                .when(~(ident("$.id") & ident("$.input_file_id") & file_ok("$.output_file_id") & file_ok("$.error_file_id")), "E_BATCH_ID")
                .when(~(count("total") & count("completed") & count("failed")), "E_BATCH_SCHEMA"))
        number = lambda name: F.try_variant_get(v, f"$.request_counts.{name}", "bigint").alias(name)
        return F.struct(code.alias("code"), text("$.id").alias("batch_id"), text("$.input_file_id").alias("input_file_id"),
                        text("$.status").alias("status"), text("$.output_file_id").alias("output_file_id"),
                        text("$.error_file_id").alias("error_file_id"), number("total"), number("completed"), number("failed"))

    return (rows.withColumn("_r", js.let(js.parse(F.col("body")), read)).select(*rows.columns, "_r.*")
            .withColumn("terminal", F.col("status").isin(k.BATCH_TERMINAL)))


def schema_retry_candidates(validated: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Requests to send again unchanged: first attempts whose reader answer failed its schema."""
    failed = validated.filter((F.col("attempt") == 1) & (F.col("code") == k.SCHEMA_CODE[k.READER])).select(*keys)
    return requests.join(failed, keys, "left_semi").withColumn("attempt", F.lit(2))
