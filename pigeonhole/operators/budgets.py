"""Spending by provider, run limits and admission of new work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pigeonhole import constants as k
from pigeonhole.functions import checks
from pigeonhole.functions.money import MONEY_PATTERN, NANO, nano

DIMENSIONS = ["blended", "openai", "typesafe"]


def vendor_spend(calls: DataFrame) -> DataFrame:
    """Known spend per run and provider. Unknown costs are skipped, never zeroed; metadata calls must cost nothing."""
    known = calls.filter(F.col("cost_nano").isNotNull()).select("run_id", "role", nano(F.col("cost_nano")).alias("cost"))
    wrong = ~F.coalesce(F.col("role").isin(*k.SCOPE_OF_ROLE) | ((F.col("role") == k.METADATA) & (F.col("cost") == 0)), F.lit(False))
    zero = F.lit(0).cast(NANO)
    scope = lambda name: [r for r, s in k.SCOPE_OF_ROLE.items() if s == name]
    cost = F.when(wrong, F.raise_error(F.lit("A recorded cost has an unknown role"))).otherwise(F.col("cost"))
    return (known.withColumn("cost", cost).groupBy("run_id").agg(*[
        F.sum(F.when(F.col("role").isin(scope(name)), F.col("cost")).otherwise(zero)).cast(NANO).alias(name)
        for name in ("openai", "typesafe")])
        .withColumn("blended", (F.col("openai") + F.col("typesafe")).cast(NANO))
        .select("run_id", "blended", "openai", "typesafe"))


def reached_limits(spend: list[Column], limits: list[Column]) -> Column:
    """Names of limits that spending has met (meeting one is enough)."""
    return F.array_compact(F.array(*[F.when(s >= l, F.lit(n)) for n, s, l in zip(DIMENSIONS, spend, limits)]))


def check_run_budget(runs: DataFrame) -> DataFrame:
    """Adds ``reached`` and ``halt`` from columns ``blended, openai, typesafe`` and ``limit_*``."""
    spent = {n: F.coalesce(F.col(n), F.lit(0).cast(NANO)) for n in DIMENSIONS}
    checked = F.when(spent["blended"] == spent["openai"] + spent["typesafe"], reached_limits(
        list(spent.values()), [F.col(f"limit_{n}") for n in DIMENSIONS])).otherwise(
        F.raise_error(F.lit("Recorded provider spending does not equal the blended total")))
    return runs.withColumn("reached", checked).withColumn("halt", F.size("reached") > 0)


def spend_policy(c: Column) -> Column:
    known = F.coalesce(c, F.lit(k.SPEND_HALT))
    return F.when(known.isin(k.SPEND_HALT, k.SPEND_ISOLATE), known).otherwise(
        F.raise_error(F.concat(F.lit("Unknown spending policy: "), known)))


def check_spend_admission(runs: DataFrame) -> DataFrame:
    """Admission verdict: an unknown charge goes before a reached limit.

    Needs the columns of ``check_run_budget`` plus ``spend_policy, budget_mode, unknown_calls``.
    """
    checked = check_run_budget(runs).withColumnRenamed("halt", "_limit")
    blocks = (F.col("unknown_calls") > 0) & (
        (spend_policy(F.col("spend_policy")) == k.SPEND_HALT) | (F.col("budget_mode") != "unlimited"))
    return checked.withColumns({
        "halt": blocks | F.col("_limit"),
        "reason": F.when(blocks, "unknown_spend").when(F.col("_limit"), "limit_reached")}).drop("_limit")


def live_budget_failures(admitted: DataFrame) -> DataFrame:
    """The code a paused run shows for new work."""
    return admitted.withColumn("code", F.when(F.col("reason") == "unknown_spend", "E_SPEND_UNACCOUNTED")
                               .when(F.col("reason") == "limit_reached", "E_LIVE_BUDGET"))


def _amount(c: Column) -> Column:
    return c.isNull() | (c.rlike(MONEY_PATTERN) & (F.length(c) <= 100))


def _is_time(c: Column) -> Column:
    return F.try_to_timestamp(c).isNotNull()


def _budget_rules(value: Column, zero_ok: bool = False) -> list[checks.Rule]:
    limits = [value[f"limit_{n}"] for n in DIMENSIONS]
    any_limit = limits[0].isNotNull() | limits[1].isNotNull() | limits[2].isNotNull()
    positive = [l.isNull() | (l != "0") for l in limits]
    code, kind = "E_RUN_BUDGET", checks.REQUEST
    limited, unlimited = value["mode"] == "limited", value["mode"] == "unlimited"
    return [
        (code, kind, "amounts must be nonnegative integers", _amount(limits[0]) & _amount(limits[1]) & _amount(limits[2])),
        (code, kind, "a limit must be above zero", F.lit(zero_ok) | (positive[0] & positive[1] & positive[2])),
        (code, kind, "choose limited or unlimited", limited | unlimited),
        (code, kind, "limited needs a limit and no acknowledgement",
         ~limited | (any_limit & (value["acknowledged"] == False))),  # noqa: E712
        (code, kind, "unlimited needs no limit and an acknowledgement",
         ~unlimited | (~any_limit & (value["acknowledged"] == True))),  # noqa: E712
        (code, kind, "a person and a time are required", (F.length(F.trim(value["actor"])) > 0) & _is_time(value["decided_at"])),
    ]


def authorize_run_budget(requests: DataFrame) -> DataFrame:
    """Adds ``finding`` (null when the request is acceptable) to budget requests.

    Columns: mode, limit_blended, limit_openai, limit_typesafe (strings or null), acknowledged, actor, decided_at.
    """
    value = F.struct("mode", *[f"limit_{n}" for n in DIMENSIONS], "acknowledged", "actor", "decided_at")
    return requests.withColumn("finding", checks.first_finding(_budget_rules(value)))


def read_run_budget(rows: DataFrame) -> DataFrame:
    """Current and legacy budget records in one shape; a legacy zero limit stays zero.

    Columns: version (null for legacy), status, ceiling, project_limit, legacy_limit, override, plus the columns of
    ``authorize_run_budget``. Adds ``version, budget_mode, limit_*, acknowledged, finding``.
    """
    legacy = F.col("version").isNull()
    mode = F.when(legacy, F.when(F.col("override"), "unlimited").otherwise("limited")).otherwise(F.col("mode"))
    limit = {n: F.when(legacy, F.col("legacy_limit") if n == "blended" else F.lit(None).cast("string"))
             .otherwise(F.col(f"limit_{n}")) for n in DIMENSIONS}
    acknowledged = F.when(legacy, F.col("override")).otherwise(F.col("acknowledged"))
    value = F.struct(mode.alias("mode"), *[limit[n].alias(f"limit_{n}") for n in DIMENSIONS],
                     acknowledged.alias("acknowledged"), "actor", "decided_at")
    code, kind = "E_RUN_BUDGET", checks.REQUEST
    legacy_rules = [
        (code, kind, "legacy amounts must be nonnegative integers", ~legacy | (
            F.col("ceiling").rlike(MONEY_PATTERN) & F.col("project_limit").rlike(MONEY_PATTERN))),
        (code, kind, "the legacy record did not authorise the run", ~legacy | (
            (F.col("status") == "allowed") & F.col("override").isNotNull()
            & (F.col("override") == F.col("legacy_limit").isNull()))),
        (code, kind, "the legacy limit is inconsistent", ~legacy | F.col("override")
         | (F.col("legacy_limit") == F.col("project_limit"))),
    ]
    strict, lenient = _budget_rules(value), _budget_rules(value, zero_ok=True)
    found = F.when(legacy, checks.first_finding(legacy_rules + lenient)).otherwise(checks.first_finding(strict))
    return rows.withColumn("_b", value).withColumn("finding", found).select(
        *[c for c in rows.columns if c not in {f"limit_{n}" for n in DIMENSIONS} | {"version", "mode", "acknowledged"}],
        F.coalesce("version", F.lit(0)).alias("version"), F.col("_b.mode").alias("budget_mode"),
        *[F.col(f"_b.limit_{n}") for n in DIMENSIONS], F.col("_b.acknowledged").alias("acknowledged"), "finding")


def authorize_budget(rows: DataFrame) -> DataFrame:
    """Older ceiling policy: allowed when the ceiling fits the project limit, an override lifts the limit."""
    ok = F.col("override") | (nano(F.col("ceiling")) <= nano(F.col("project_limit")))
    return rows.withColumns({"status": F.when(ok, "allowed").otherwise("refused"),
                             "limit": F.when(~F.col("override"), F.col("project_limit"))})


def check_live_budget(rows: DataFrame) -> DataFrame:
    """Older live check: only spending strictly above the limit halts."""
    consistent = F.when((F.col("status") == "refused") | (F.col("override") == F.col("limit").isNull()), F.lit(True)).otherwise(
        F.raise_error(F.lit("Inconsistent stored budget decision")))
    reason = (F.when(F.col("status") == "refused", "budget_refused")
              .when(consistent & (nano(F.col("actual")) > nano(F.col("limit"))), "budget_exceeded"))
    return rows.withColumn("reason", reason).withColumn("halt", F.col("reason").isNotNull())
