"""Exact call costs, run estimates and cost of reported usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pigeonhole import constants as k
from pigeonhole.functions import checks
from pigeonhole.functions.json import json_token, let, parse
from pigeonhole.functions.money import MONEY_PATTERN, NANO, call_cost, money_text

RATE_FIELDS = ["input_rate", "output_rate", "long_above", "long_in_num", "long_in_den", "long_out_num", "long_out_den"]


def rates(input_rate: int, output_rate: int, long_above: int | None = None, long_in: tuple[int, int] = (1, 1),
          long_out: tuple[int, int] = (1, 1)) -> Column:
    """A literal rate card (nanodollars per million tokens)."""
    values = [input_rate, output_rate, long_above, long_in[0], long_in[1], long_out[0], long_out[1]]
    return F.struct(*[F.lit(v).cast("decimal(19,0)").alias(n) for n, v in zip(RATE_FIELDS, values)])


def add_call_cost(calls: DataFrame, rate: Column, name: str = "cost_nano") -> DataFrame:
    return calls.withColumn(name, money_text(call_cost(F.col("input_tokens"), F.col("output_tokens"), rate)))


def token_findings(input_tokens: Column, cap: Column, measured: Column) -> Column:
    return checks.first_finding([
        ("E_COST_INPUT", checks.BLOCKER, "input tokens must be a nonnegative count", checks.safe_count(input_tokens)),
        ("E_COST_INPUT", checks.BLOCKER, "output cap must be a nonnegative count", checks.safe_count(cap)),
        ("E_COST_INPUT", checks.BLOCKER, "measured output must stay within its cap",
         measured.isNull() | (checks.safe_count(measured) & (measured <= cap))),
    ])


def estimate_documents(docs: DataFrame, rate: dict[str, Column], attempts: dict[str, int] | None = None) -> DataFrame:
    """Worst case (every permitted attempt at its cap) and estimate (one attempt) per document.

    ``docs``: run_id, fingerprint and per role ``<role>_in, <role>_cap, <role>_measured``; no recovery call when
    ``recovery_in`` is null. A measured output lowers only the estimate.
    """
    attempts = attempts or k.CALL_ATTEMPTS
    times = {"confidence": attempts["confidence"], "recovery": attempts["recovery"],
             "reader": attempts["reader_transport"] * attempts["reader_schema"]}
    zero = F.lit(0).cast(NANO)
    worst, likely, measured = zero, zero, F.lit(False)
    for role in ("confidence", "reader", "recovery"):
        tokens, cap, known = F.col(f"{role}_in"), F.col(f"{role}_cap"), F.col(f"{role}_measured")
        full = call_cost(tokens, cap, rate[role])
        once = call_cost(tokens, F.coalesce(known, cap), rate[role])
        if role == "recovery":
            full, once = F.coalesce(full, zero), F.coalesce(once, zero)
        worst = (worst + full * F.lit(times[role]).cast("decimal(4,0)")).cast(NANO)
        likely = (likely + once).cast(NANO)
        measured = measured | (known.isNotNull() & tokens.isNotNull())
    return docs.select("run_id", "fingerprint", worst.alias("worst"), likely.alias("estimate"),
                       measured.alias("measured"), F.lit(times["reader"]).alias("reader_attempts"))


def estimate_run_cost(docs: DataFrame, rate: dict[str, Column], attempts: dict[str, int] | None = None) -> DataFrame:
    """Run totals of ``estimate_documents`` with the basis of the estimate."""
    return (estimate_documents(docs, rate, attempts).groupBy("run_id")
            .agg(F.count(F.lit(1)).alias("documents"), F.sum("worst").cast(NANO).alias("worst"),
                 F.sum("estimate").cast(NANO).alias("estimate"), F.bool_or("measured").alias("_m"))
            .select("run_id", "documents", money_text(F.col("worst")).alias("worst_case_nano"),
                    money_text(F.col("estimate")).alias("estimate_nano"),
                    F.when(F.col("_m"), "one_attempt_measured_outputs_and_caps").otherwise("one_attempt_output_caps")
                    .alias("basis")))


def _count(token: Column) -> Column:
    """A JSON number token that is a safe nonnegative integer, else null (quoted numbers do not count)."""
    whole = F.when(F.regexp_extract(token, r"^([0-9]{1,16})(?:\.0+)?$", 1) != "", F.substring_index(token, ".", 1)).cast("bigint")
    return let(whole, lambda n: F.when(n <= k.MAX_SAFE_INTEGER, n))


def actual_usage_cost(calls: DataFrame, rate: Column, usage: str = "usage_json", cache_policy: str = "cache_policy") -> DataFrame:
    """Cost of reported usage, or null with the reason. Nothing is estimated.

    ``disabled`` needs explicit zero cache counters; ``not_applicable`` has none; another policy is refused.
    """
    def counters(v: Column) -> Column:
        names = {"tokens_in": "$.input_tokens", "tokens_out": "$.output_tokens", "cached": "$.input_tokens_details.cached_tokens",
                 "written": "$.input_tokens_details.cache_write_tokens"}
        return F.struct(*[_count(json_token(v, path)).alias(name) for name, path in names.items()])

    parsed = calls.withColumn("_u", let(parse(F.col(usage)), counters))
    u, policy = F.col("_u"), F.col(cache_policy)
    cache_ok = F.coalesce((u["cached"] == 0) & (u["written"] == 0), F.lit(False))
    code = (F.when(u["tokens_in"].isNull() | u["tokens_out"].isNull(), "E_VENDOR_USAGE")
            .when((policy == "disabled") & ~cache_ok, "E_CACHE_POLICY")
            .when(policy.isNull() | ~policy.isin("disabled", "not_applicable"), "E_CACHE_POLICY"))
    cost = F.when(F.col("usage_code").isNull(), money_text(call_cost(u["tokens_in"], u["tokens_out"], rate)))
    return parsed.withColumn("usage_code", code).withColumn("cost_nano", cost).drop("_u")


def price_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds ``rate`` from the price row of the call's (pack_id, mode, role); a call without a verified price gets
    ``price_code`` E_PRICING_UNVERIFIED and no rate, which stops its run. ``prices`` as in ``price_findings``."""
    keys = ["pack_id", "mode", "role"]
    verified = prices.join(price_findings(prices).select(*keys).distinct(), keys, "left_anti")
    rate = F.struct(*[F.col(n).cast("decimal(19,0)").alias(n) for n in RATE_FIELDS]).alias("rate")
    return calls.join(verified.select(*keys, rate), keys, "left").withColumn("price_code", F.when(F.col("rate").isNull(), "E_PRICING_UNVERIFIED"))


def price_findings(prices: DataFrame) -> DataFrame:
    """Missing or malformed price rows block their (pack, mode, role).

    Columns: pack_id, mode, role, verified_at, source and the rate fields as strings.
    """
    money = lambda n: F.col(n).rlike(MONEY_PATTERN)
    positive = lambda n: money(n) & (F.col(n) != "0")
    no_long = F.col("long_above").isNull()
    rules = [
        ("E_PRICING_UNVERIFIED", checks.BLOCKER, "prices need a date and a source", (F.length(F.trim("verified_at")) > 0) & (F.length(F.trim("source")) > 0)),
        ("E_PRICING_UNVERIFIED", checks.BLOCKER, "rates must be nonnegative integers", money("input_rate") & money("output_rate")),
        ("E_PRICING_UNVERIFIED", checks.BLOCKER, "multipliers must be positive",
         no_long | (positive("long_in_num") & positive("long_in_den") & positive("long_out_num") & positive("long_out_den"))),
    ]
    return checks.explode_findings(prices, ["pack_id", "mode", "role"], checks.all_findings(rules))
