"""Outcomes of recorded request attempts and the waits that response headers ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pigeonhole import constants as k
from pigeonhole.functions import json as js
from pigeonhole.operators.models import check_model_policy, code_by_role


def classify_attempt(attempts: DataFrame) -> DataFrame:
    """First matching outcome of each attempt: ``action`` (decode, retry, document, blocker) and ``code``.

    Input: role, status, network_failure, body, pin, pin_policy, last_attempt (no retry is left); with a column cost_unknown
    (true where the isolating spend policy holds and no cost is verified) such an attempt ends its document before any
    retry, but not before what stops the whole run.
    """
    unknown = F.coalesce(F.col("cost_unknown"), F.lit(False)) if "cost_unknown" in attempts.columns else F.lit(False)
    status, role = F.col("status"), F.col("role")
    pair = lambda action, code: F.struct(F.lit(action).alias("action"), (F.lit(code) if isinstance(code, str) else code).cast("string").alias("code"))

    def judged(v: Column, named: Column, drift: Column) -> Column:
        error = lambda name: F.when(js.is_string(v, f"$.error.{name}"), F.try_variant_get(v, f"$.error.{name}", "string"))
        count = lambda path: js.json_token(v, path).rlike("^[0-9]{1,16}$")
        usage = F.coalesce(count("$.usage.input_tokens") & count("$.usage.output_tokens"), F.lit(False))
        again = F.col("network_failure") | status.isin(408, 409, 429) | (status >= 500)
        refused = status.isNull() | ~status.between(200, 299)
        everywhere = F.coalesce(status.isin(401, 403, 404), F.lit(False)) | F.coalesce(error("code") == "model_not_found", F.lit(False)) | F.coalesce(error("param") == "model", F.lit(False))
        return (
            F.when(named.isNotNull() & drift.isNotNull(), F.struct(drift["kind"].alias("action"), drift["code"].alias("code")))
            .when((role != k.CONFIDENCE) & (status == 429) & error("code").isin(k.QUOTA_CODES), pair("blocker", "E_OPENAI_QUOTA"))
            .when(unknown & ~everywhere, pair("document", "E_VENDOR_COST_UNKNOWN"))
            .when(again & F.col("last_attempt"), pair("document", "E_VENDOR_UNAVAILABLE"))
            .when(again, pair("retry", F.lit(None)))
            .when(status.between(300, 399), pair("document", "E_VENDOR_REDIRECT"))
            .when(status.isin(401, 403), pair("blocker", "E_VENDOR_AUTH"))
            .when((status == 404) | (error("code") == "model_not_found") | (error("param") == "model"), pair("blocker", "E_MODEL_REJECTED"))
            .when(refused & (error("code") == "context_length_exceeded"), pair("document", "E_READER_CONTEXT"))
            .when(refused, pair("document", "E_VENDOR_REQUEST"))
            .when(v.isNull() | js.is_null(v), pair("document", code_by_role(k.SCHEMA_CODE, role)))
            .when(~usage, pair("blocker", "E_VENDOR_USAGE"))
            .otherwise(pair("decode", F.lit(None))))

    def read(v: Column) -> Column:
        named = F.when(js.is_string(v, "$.model"), F.try_variant_get(v, "$.model", "string"))
        return js.let(named, lambda m: js.let(check_model_policy(F.col("pin"), F.col("pin_policy"), role, m), lambda d: judged(v, m, d)))

    rows = attempts.withColumn("_o", js.let(js.parse(F.col("body")), read))
    return rows.select(*attempts.columns, "_o.action", "_o.code")


def http_date_ms(c: Column) -> Column:
    """Epoch milliseconds of an HTTP date or an ISO time; null when it is neither."""
    bare = F.regexp_replace(c, "^[A-Za-z]{3}, ", "")
    http = F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss z"))
    return F.unix_millis(F.coalesce(http, F.try_to_timestamp(c)))


def retry_after_deadline(header: Column, observed_ms: Column) -> Column:
    """Absolute deadline anchored at the response time, or null when the header is invalid or beyond a year."""
    value = F.trim(header)
    plain = value.rlike(r"^[0-9]{1,15}(?:\.[0-9]+)?$")
    odd = value.rlike(r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$")
    until = (F.when(plain, observed_ms + F.ceil(value.try_cast("double") * 1000).cast("bigint"))
             .when(~odd, http_date_ms(value)))
    ok = (observed_ms >= 0) & (until >= 0) & (until - observed_ms <= k.MAX_WAIT_MS)
    return F.when(ok, F.greatest(observed_ms, until))


def batch_read_delay(header: Column, observed_ms: Column) -> Column:
    """Wait before reading a batch again: never below the minimum, null for an invalid header."""
    return (F.when(header.isNull(), F.lit(k.BATCH_MIN_WAIT_MS).cast("bigint"))
            .otherwise(js.let(retry_after_deadline(header, observed_ms) - observed_ms, lambda wait: F.when(
                wait.isNotNull(), F.greatest(F.lit(k.BATCH_MIN_WAIT_MS).cast("bigint"), wait)))))


def cooldowns(calls: DataFrame) -> DataFrame:
    """Winning deadline per provider and the attempt it came from; an equal deadline keeps the earlier one.

    ``calls``: attempt_id, role, status, created_at (ms), retry_after. Combined before the shuffle: two output rows.
    """
    rows = (calls.filter((F.col("status") == 429) & F.col("retry_after").isNotNull())
            .withColumn("until", retry_after_deadline(F.col("retry_after"), F.col("created_at")))
            .filter("until is not null").withColumn("scope", code_by_role(k.SCOPE_OF_ROLE, F.col("role"))))
    first = F.min(F.struct("created_at", "attempt_id"))
    top = rows.groupBy("scope", "until").agg(first.alias("f"))
    return (top.groupBy("scope").agg(F.max("until").alias("until"), F.max_by("f", "until").alias("f"))
            .select("scope", "until", F.col("f.attempt_id").alias("source_attempt_id"), F.col("f.created_at").alias("observed_at")))
