"""Queries over costs, budgets, accounting, ledgers and type definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pigeonhole.functions import money
from pigeonhole.operators import accounting, budgets, costs, ledger, taxonomy
from pigeonhole.plans.decision_queries import PENDING_SQL, SPEND_SQL
from pigeonhole.plans.registry import query
from pigeonhole.plans.views import Inputs

# A rate card with fractional results: rounding up matters on both sides.
RATE = dict(input_rate=1_234_567, output_rate=10_000_003, long_above=272_000, long_in=(2, 1), long_out=(3, 2))


def cost_sql(tokens_in: str, tokens_out: str) -> str:
    """Ceilings by integer division on 128-bit integers."""
    i, o = f"cast({tokens_in} as hugeint)", f"cast({tokens_out} as hugeint)"
    return (f"case when {tokens_in} > 272000 then ({i} * 1234567 * 2 + 999999) // 1000000 + ({o} * 10000003 * 3 + 1999999) // 2000000 "
            f"else ({i} * 1234567 + 999999) // 1000000 + ({o} * 10000003 + 999999) // 1000000 end")


@query("call_cost", f"select attempt_id, cast({cost_sql('input_tokens', 'output_tokens')} as varchar) as cost from v_calls")
def _(t: Inputs) -> DataFrame:
    return costs.add_call_cost(t.view("v_calls"), costs.rates(**RATE), "cost").select("attempt_id", "cost")


EST = """select concat('run', cast(doc_id % 4 as string)) as run_id, doc_id, 200000 + n_chars * 3 as tokens, n_chars, doc_id % 3 = 0 as has_recovery,
 case when doc_id % 5 = 0 then n_chars % 400 end as measured from documents"""


@query("estimate_run_cost", f"""
with e as ({EST}), c as (select run_id, has_recovery, measured, {cost_sql('tokens', '500')} as conf, {cost_sql('tokens + 1000', '4000')} as rd,
  {cost_sql('tokens', '900')} as rec, {cost_sql('tokens + 1000', 'coalesce(measured, 4000)')} as rd_once from e)
select run_id, count(*) as documents, cast(sum(conf * 3 + rd * 6 + case when has_recovery then rec * 3 else 0 end) as varchar) as worst_case_nano,
  cast(sum(conf + rd_once + case when has_recovery then rec else 0 end) as varchar) as estimate_nano,
  case when bool_or(measured is not null) then 'one_attempt_measured_outputs_and_caps' else 'one_attempt_output_caps' end as basis
from c group by run_id""")
def _(t: Inputs) -> DataFrame:
    none = F.lit(None).cast("bigint")
    docs = t.sql(EST).withColumns({
        "fingerprint": F.col("doc_id").cast("string"), "confidence_in": F.col("tokens"), "confidence_cap": F.lit(500), "confidence_measured": none,
        "reader_in": F.col("tokens") + 1000, "reader_cap": F.lit(4000), "reader_measured": F.col("measured"),
        "recovery_in": F.when(F.col("has_recovery"), F.col("tokens")), "recovery_cap": F.lit(900), "recovery_measured": none})
    rate = costs.rates(**RATE)
    return costs.estimate_run_cost(docs, {"confidence": rate, "reader": rate, "recovery": rate})


USAGE = """select attempt_id, role, case when event_id % 40 = 0 then '{"input_tokens":"12","output_tokens":3}' when event_id % 41 = 0 then '{"output_tokens":3}'
  when event_id % 43 = 0 then 'broken' when input_tokens is null then null
  else concat('{"input_tokens":', cast(input_tokens as string), ',"output_tokens":', cast(output_tokens as string),
    case when event_id % 11 = 0 then '' else concat(',"input_tokens_details":{"cached_tokens":', case when event_id % 7 = 0 then '5' else '0' end, ',"cache_write_tokens":0}') end, '}') end as usage_json,
  input_tokens, output_tokens, event_id, case when role = 'confidence' then 'not_applicable' else 'disabled' end as cache_policy from v_calls"""


@query("actual_usage_cost", f"""
with u as ({USAGE}), c as (select u.*, case when usage_json is null or event_id % 40 = 0 or event_id % 41 = 0 or event_id % 43 = 0 then 'E_VENDOR_USAGE'
  when cache_policy = 'disabled' and (event_id % 11 = 0 or event_id % 7 = 0) then 'E_CACHE_POLICY' end as usage_code from u)
select attempt_id, usage_code, case when usage_code is null then cast({cost_sql('input_tokens', 'output_tokens')} as varchar) end as cost_nano from c""")
def _(t: Inputs) -> DataFrame:
    return costs.actual_usage_cost(t.sql(USAGE), costs.rates(**RATE)).select("attempt_id", "usage_code", "cost_nano")


# Every call of a pack is priced by its mode and role; the batch price of readers was never verified.
PRICED = """select attempt_id, 'p' as pack_id, case when event_id % 2 = 0 then 'batch' else 'interactive' end as mode, role, input_tokens, output_tokens from v_calls where input_tokens is not null"""


@query("price_calls", f"""
select attempt_id, case when role = 'reader' and mode = 'batch' or role = 'recovery' then 'E_PRICING_UNVERIFIED' end as price_code,
  case when not (role = 'reader' and mode = 'batch' or role = 'recovery') then cast(case when mode = 'batch' then (cast(input_tokens as hugeint) * 1000 + 999999) // 1000000 + (cast(output_tokens as hugeint) * 5000 + 999999) // 1000000
    else {cost_sql('input_tokens', 'output_tokens')} end as varchar) end as cost_nano from ({PRICED}) c""")
def _(t: Inputs) -> DataFrame:
    card = lambda mode, role, verified, rate: (F.lit("p"), F.lit(mode), F.lit(role), F.lit(verified), F.lit("page"), *map(F.lit, rate))
    long, flat = ("1234567", "10000003", "272000", "2", "1", "3", "2"), ("1000", "5000", None, None, None, None, None)
    cards = [card("interactive", "confidence", "2026-01-01", long), card("interactive", "reader", "2026-01-01", long), card("batch", "confidence", "2026-01-01", flat), card("batch", "reader", " ", flat)]
    names = ["pack_id", "mode", "role", "verified_at", "source", *costs.RATE_FIELDS]
    rows = t.table("region").limit(1).select(F.explode(F.array(*[F.struct(*[v.cast("string").alias(n) for n, v in zip(names, c)]) for c in cards])).alias("c")).select("c.*")
    priced = costs.price_calls(t.sql(PRICED), rows)
    return costs.add_call_cost(priced, F.col("rate")).select("attempt_id", "price_code", "cost_nano")


@query("vendor_spend", "select run_id, blended, openai, typesafe from (" + SPEND_SQL.replace("from v_ledger", "from v_ledger where cost_nano is not null") + ") s")
def _(t: Inputs) -> DataFrame:
    s = budgets.vendor_spend(t.view("v_ledger"))
    return s.select("run_id", *[money.money_text(F.col(n)).alias(n) for n in budgets.DIMENSIONS])


@query("vendor_spend_rollup", """
select run_id, case role when 'confidence' then 'typesafe' when 'batch_metadata' then 'none' else 'openai' end as provider, role,
  cast(sum(cast(cost_nano as hugeint)) as varchar) as known, sum(case when cost_nano is null then 1 else 0 end) as unknown_calls, count(*) as calls
from v_ledger group by rollup(run_id, provider, role)""")
def _(t: Inputs) -> DataFrame:
    return accounting_rollup(t.view("v_ledger"))


def accounting_rollup(calls: DataFrame) -> DataFrame:
    provider = F.when(F.col("role") == "confidence", "typesafe").when(F.col("role") == "batch_metadata", "none").otherwise("openai")
    return (calls.withColumn("provider", provider).rollup("run_id", "provider", "role").agg(
        money.money_text(F.sum(money.nano(F.col("cost_nano")))).alias("known"),
        F.count_if(F.col("cost_nano").isNull()).alias("unknown_calls"), F.count(F.lit(1)).alias("calls")))


def _admission_rows(t: Inputs) -> DataFrame:
    calls = t.view("v_ledger")
    runs = t.view("v_runs").withColumns({f"limit_{n}": F.col(f"limit_{n}").cast("decimal(38,0)") for n in budgets.DIMENSIONS})
    return (runs.join(budgets.vendor_spend(calls), "run_id", "left").join(accounting.unaccounted_calls(calls), "run_id", "left")
            .withColumn("unknown_calls", F.coalesce("unaccounted", F.lit(0))))


ADMISSION_SQL = f"""with s as ({SPEND_SQL}), a as (select r.run_id, r.spend_policy, r.budget_mode, coalesce(s.unaccounted, 0) as unknown_calls,
  coalesce(cast(blended as hugeint) >= cast(limit_blended as hugeint), false) as over_b, coalesce(cast(openai as hugeint) >= cast(limit_openai as hugeint), false) as over_o,
  coalesce(cast(typesafe as hugeint) >= cast(limit_typesafe as hugeint), false) as over_t from v_runs r left join s on s.run_id = r.run_id)"""


@query("check_run_budget", f"""{ADMISSION_SQL} select run_id, concat(case when over_b then 'blended ' else '' end, case when over_o then 'openai ' else '' end,
  case when over_t then 'typesafe ' else '' end) as reached, over_b or over_o or over_t as halt from a""")
def _(t: Inputs) -> DataFrame:
    return budgets.check_run_budget(_admission_rows(t)).select(
        "run_id", F.array_join(F.transform("reached", lambda r: F.concat(r, F.lit(" "))), "").alias("reached"), "halt")


@query("check_spend_admission", f"""{ADMISSION_SQL}, b as (select a.*, unknown_calls > 0 and (coalesce(spend_policy, 'halt-on-unknown-v1') = 'halt-on-unknown-v1' or budget_mode <> 'unlimited') as blocks from a)
select run_id, blocks or over_b or over_o or over_t as halt, case when blocks then 'unknown_spend' when over_b or over_o or over_t then 'limit_reached' end as reason,
  case when blocks then 'E_SPEND_UNACCOUNTED' when over_b or over_o or over_t then 'E_LIVE_BUDGET' end as code, unknown_calls from b""")
def _(t: Inputs) -> DataFrame:
    return budgets.live_budget_failures(budgets.check_spend_admission(_admission_rows(t))).select("run_id", "halt", "reason", "code", "unknown_calls")


REQ = """select o_orderkey as request_id, case o_orderkey % 7 when 6 then 'maybe' when 0 then 'unlimited' when 1 then 'unlimited' else 'limited' end as mode,
  case when o_orderkey % 5 = 0 then null when o_orderkey % 11 = 0 then '0' when o_orderkey % 13 = 0 then '1.5' else cast(o_custkey + 1 as string) end as limit_blended,
  case when o_orderkey % 2 = 0 then cast(o_orderkey + 1 as string) end as limit_openai, cast(null as string) as limit_typesafe,
  o_orderkey % 7 < 2 as acknowledged, case when o_orderkey % 17 = 0 then ' ' else concat('c', cast(o_custkey as string)) end as actor,
  case when o_orderkey % 19 = 0 then 'yesterday' else '2026-01-02T03:04:05Z' end as decided_at from orders"""
REQ_CASE = """case when limit_blended = '1.5' then 'amounts must be nonnegative integers' {zero} when mode = 'maybe' then 'choose limited or unlimited'
  when mode = 'limited' and limit_blended is null and limit_openai is null then 'limited needs a limit and no acknowledgement'
  when mode = 'unlimited' and (limit_blended is not null or limit_openai is not null) then 'unlimited needs no limit and an acknowledgement'
  when actor = ' ' or decided_at = 'yesterday' then 'a person and a time are required' end"""


@query("authorize_run_budget", f"with q as ({REQ}) select request_id, {REQ_CASE.format(zero=chr(10) + '''when limit_blended = '0' then 'a limit must be above zero' ''')} as detail from q")
def _(t: Inputs) -> DataFrame:
    return budgets.authorize_run_budget(t.sql(REQ)).select("request_id", F.col("finding.detail").alias("detail"))


LEGACY = """select o_orderkey as request_id, cast(null as int) as version, case when o_orderkey % 9 = 0 then 'refused' else 'allowed' end as status, '100' as ceiling,
  case when o_orderkey % 8 = 0 then '7' else cast(o_custkey as string) end as project_limit, case when o_orderkey % 4 = 0 then null else cast(o_custkey as string) end as legacy_limit,
  o_orderkey % 4 = 0 as override, cast(null as string) as mode, cast(null as string) as limit_blended, cast(null as string) as limit_openai, cast(null as string) as limit_typesafe,
  cast(null as boolean) as acknowledged, 'someone' as actor, '2026-01-02T03:04:05Z' as decided_at from orders"""


@query("read_run_budget", f"""with q as ({LEGACY}) select request_id, 0 as version, case when override then 'unlimited' else 'limited' end as budget_mode,
  legacy_limit as limit_blended, override as acknowledged, case when status <> 'allowed' then 'the legacy record did not authorise the run'
  when not override and legacy_limit <> project_limit then 'the legacy limit is inconsistent' end as detail from q""")
def _(t: Inputs) -> DataFrame:
    return budgets.read_run_budget(t.sql(LEGACY)).select("request_id", "version", "budget_mode", "limit_blended", "acknowledged",
                                                         F.col("finding.detail").alias("detail"))


# Records of today's form beside the legacy ones: every third request has a version of its own.
MIXED = f"""select l.request_id, case when l.request_id % 3 = 0 then 2 end as version, l.status, l.ceiling, l.project_limit, l.legacy_limit, l.override,
  case when l.request_id % 3 = 0 then case l.request_id % 5 when 0 then 'unlimited' when 1 then 'other' else 'limited' end end as mode,
  case when l.request_id % 3 = 0 and l.request_id % 5 > 1 then case when l.request_id % 7 = 0 then '0' when l.request_id % 7 = 1 then '1.5' else '500' end end as limit_blended,
  case when l.request_id % 3 = 0 and l.request_id % 7 = 2 then '40' end as limit_openai, l.limit_typesafe, case when l.request_id % 3 = 0 then l.request_id % 5 = 0 end as acknowledged,
  case when l.request_id % 13 = 0 then ' ' else l.actor end as actor, case when l.request_id % 17 = 0 then 'yesterday' else l.decided_at end as decided_at from ({LEGACY}) l"""


@query("read_run_budget_versions", f"""with q as ({MIXED}), d as (select *, version is null as legacy from q),
 m as (select d.*, case when legacy then case when override then 'unlimited' else 'limited' end else mode end as budget_mode, case when legacy then legacy_limit else limit_blended end as lb,
   case when not legacy then limit_openai end as lo, case when legacy then override else acknowledged end as ack from d)
select request_id, coalesce(version, 0) as version, budget_mode, lb as limit_blended, lo as limit_openai, ack as acknowledged,
 case when legacy and status <> 'allowed' then 'the legacy record did not authorise the run' when legacy and not override and legacy_limit <> project_limit then 'the legacy limit is inconsistent'
  when coalesce(lb, '1') = '1.5' then 'amounts must be nonnegative integers' when not legacy and coalesce(lb, '1') = '0' then 'a limit must be above zero' when budget_mode = 'other' then 'choose limited or unlimited'
  when budget_mode = 'limited' and (coalesce(lb, lo) is null or ack) then 'limited needs a limit and no acknowledgement' when budget_mode = 'unlimited' and (coalesce(lb, lo) is not null or not ack) then 'unlimited needs no limit and an acknowledgement'
  when trim(actor) = '' or decided_at = 'yesterday' then 'a person and a time are required' end as detail from m""")
def _(t: Inputs) -> DataFrame:
    return budgets.read_run_budget(t.sql(MIXED)).select("request_id", "version", "budget_mode", "limit_blended", "limit_openai", "acknowledged", F.col("finding.detail").alias("detail"))


@query("ceiling_budget", """
with q as (select o_orderkey as request_id, o_custkey, o_orderkey % 10 = 0 as override, o_orderkey % 2000 as actual from orders),
 s as (select q.*, case when override or o_custkey <= 900 then 'allowed' else 'refused' end as status from q)
select request_id, status, case when status = 'refused' then 'budget_refused' when not override and actual > 900 then 'budget_exceeded' end as reason from s""")
def _(t: Inputs) -> DataFrame:
    rows = t.table("orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").cast("string").alias("ceiling"),
                                    F.lit("900").alias("project_limit"), (F.col("o_orderkey") % 10 == 0).alias("override"),
                                    (F.col("o_orderkey") % 2000).cast("string").alias("actual"))
    return budgets.check_live_budget(budgets.authorize_budget(rows)).select("request_id", "status", "reason")


@query("money_text", """
select o_orderkey as request_id, cast(round(o_totalprice * 100) as bigint) * 10000000 + 5 as nano_value, concat('$', cast(cents // 100 as varchar), '.',
  lpad(cast(cents % 100 as varchar), 2, '0'), '0000005') as shown
from (select o_orderkey, o_totalprice, cast(round(o_totalprice * 100) as bigint) as cents from orders) o""")
def _(t: Inputs) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    usd = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"), F.lit("0000005"))
    nano = money.usd_to_nano(usd)
    return t.table("orders").select(F.col("o_orderkey").alias("request_id"), nano.cast("bigint").alias("nano_value"), money.format_nano(nano).alias("shown"))


@query("unaccounted_calls", "select run_id, count(*) as unaccounted from v_ledger where role <> 'batch_metadata' and cost_nano is null group by run_id")
def _(t: Inputs) -> DataFrame:
    return accounting.unaccounted_calls(t.view("v_ledger"))


@query("pending_accounting", PENDING_SQL)
def _(t: Inputs) -> DataFrame:
    return accounting.pending_accounting(t.view("v_batches"), t.view("v_events"), t.view("v_checkpoints"), t.view("v_ledger"))


# Staged result lines: every event is a line; a user's lines over an hour repeat one accounting id.
STAGED = """select concat('g-', cast(user_id as string), '-', cast(event_id % 50 as string)) as accounting_id, concat('u', cast(user_id as string)) as run_id,
  concat('file-', cast(event_id % 3 as string)) as file_id, event_id as line_number, event_type, event_id, k,
  case when event_type = 'error' then 500 when event_id % 31 = 0 then null else 200 end as status_code, event_id % 31 = 0 as has_error,
  case when event_type = 'error' then '{"error":{"code":"server_error"}}' when event_id % 31 = 0 then null
    when event_id % 29 = 0 then '{"model":"gpt-6-sol-2026-01-01"}'
    else concat('{"model":"', case when event_id % 37 = 0 then 'other' else 'gpt-6-sol-2026-01-01' end, '","usage":{"input_tokens":', cast(k * 4001 as string), ',"output_tokens":', cast(event_id % 977 as string),
      ',"input_tokens_details":{"cached_tokens":0,"cache_write_tokens":0}}}') end as body, 'gpt-6-sol' as pin, 'owner_approved_alias' as pin_policy
from (select e.*, cast(JSON(props, '$.k') as bigint) as k from events e) x"""
STAGED_SQL = f"""with s as ({STAGED}), d as (select s.*, case when body like '%"usage"%' then 'reported_usage' when event_type = 'error' or event_id % 31 = 0 then 'unsuccessful_no_usage'
    else 'unaccounted_success' end as disposition, case when body like '%"usage"%' and event_id % 37 <> 0 then cast({cost_sql('k * 4001', 'event_id % 977')} as varchar) end as cost_nano from s),
  f as (select d.*, row_number() over (partition by accounting_id order by file_id, line_number) as n, count(*) over (partition by accounting_id) as lines from d)"""


@query("charge_once", f"{STAGED_SQL} select accounting_id, run_id, disposition, cost_nano, file_id, line_number, lines from f where n = 1")
def _(t: Inputs) -> DataFrame:
    return accounting.charge_first(t.sql(STAGED), costs.rates(**RATE)).drop("usage_code")


@query("mark_charged", f"{STAGED_SQL} select accounting_id, file_id, line_number, n = 1 and cost_nano is not null as charged from f")
def _(t: Inputs) -> DataFrame:
    staged = accounting.staged_charges(t.sql(STAGED), costs.rates(**RATE))
    return accounting.mark_charged(staged, accounting.charge_once(staged)).select("accounting_id", "file_id", "line_number", "charged")


@query("batch_cost_failure", """
with s as (select attempt_id, run_id, event_id, case event_id % 11 when 0 then 401 when 1 then 404 when 2 then 429 else 200 end as status_code from v_ledger)
select s.attempt_id, case when coalesce(r.spend_policy, 'x') <> 'isolate-unlimited-v1' then null when s.event_id % 7 = 0 then 'E_TERRA_PIN_DRIFT'
  when status_code = 401 then 'E_VENDOR_AUTH' when status_code = 404 then 'E_MODEL_REJECTED' when status_code = 429 then 'E_OPENAI_QUOTA'
  when s.event_id % 23 = 0 then 'E_VENDOR_LOG' when l.cost_nano is not null then null when r.budget_mode <> 'unlimited' then 'E_SPEND_UNACCOUNTED' else 'E_VENDOR_COST_UNKNOWN' end as code
from s join v_runs r on r.run_id = s.run_id join v_ledger l on l.attempt_id = s.attempt_id""")
def _(t: Inputs) -> DataFrame:
    calls = t.view("v_ledger")
    e = F.col("event_id")
    status = F.when(e % 11 == 0, 401).when(e % 11 == 1, 404).when(e % 11 == 2, 429).otherwise(200)
    body = F.concat(F.lit('{"model":"'), F.when(e % 7 == 0, "other").otherwise("gpt-6-sol"), F.lit('"'),
                    F.when(e % 11 == 2, ',"error":{"code":"insufficient_quota"}').otherwise(""), F.lit("}"))
    staged = calls.select(F.col("attempt_id").alias("accounting_id"), "run_id", status.alias("status_code"), body.alias("body"),
                          F.lit("gpt-6-sol").alias("pin"), F.lit("owner_approved_alias").alias("pin_policy"))
    ledgered = calls.filter("event_id % 23 <> 0").select("attempt_id", "cost_nano")  # the missing rows stand for lost log entries
    out = accounting.batch_cost_failure(staged, ledgered, t.view("v_runs"))
    return out.select(F.col("accounting_id").alias("attempt_id"), "code")


@query("batch_accounting_complete", """
select o_custkey as batch_id, count(*) as retained, sum(case when o_orderstatus = 'F' then 2 else 1 end) as completed,
  case when count(*) < sum(case when o_orderstatus = 'F' then 2 else 1 end) then 'E_BATCH_ACCOUNTING_INCOMPLETE' end as code from orders group by o_custkey""")
def _(t: Inputs) -> DataFrame:
    o = t.table("orders")
    correlated = o.select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("reference"))
    batches = o.groupBy(F.col("o_custkey").alias("batch_id")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", 2).otherwise(1)).alias("completed"))
    return accounting.batch_accounting_complete(correlated, batches)


@query("vendor_health", """
with l as (select run_id, role, status, created_at, row_number() over (partition by run_id order by created_at desc, attempt_id desc) as n from v_ledger where role <> 'batch_metadata'),
 u as (select run_id, sum(case when role <> 'batch_metadata' and cost_nano is null then 1 else 0 end) as unknown_spend from v_ledger group by run_id)
select u.run_id, case when l.run_id is null then 'not_contacted' when l.status is null then 'no_response' when l.status between 200 and 299 then 'response_received' else 'response_failed' end as status,
  l.role as latest_role, l.status as latest_status, l.created_at as latest_at, u.unknown_spend from u left join l on l.run_id = u.run_id and l.n = 1""")
def _(t: Inputs) -> DataFrame:
    return ledger.vendor_health(t.view("v_ledger"), ["run_id"])


@query("vendor_health_overall", """
select case when status is null then 'no_response' when status between 200 and 299 then 'response_received' else 'response_failed' end as status, role as latest_role, status as latest_status,
  created_at as latest_at, (select count(*) from v_ledger where role <> 'batch_metadata' and cost_nano is null) as unknown_spend
from (select * from v_ledger where role <> 'batch_metadata' order by created_at desc, attempt_id desc limit 1) x""")
def _(t: Inputs) -> DataFrame:
    return ledger.vendor_health(t.view("v_ledger"))


@query("stop_reason", """
with since as (select run_id, max(created_at) as since from v_recoveries group by run_id),
 h as (select e.run_id, e.created_at, e.details_json, row_number() over (partition by e.run_id order by e.created_at, e.event_seq) as n
   from v_events e left join since s on s.run_id = e.run_id where stage = 'run' and kind = 'halted' and (s.since is null or e.created_at >= s.since)),
 c as (select run_id, attempt_id, role, status, row_number() over (partition by run_id order by created_at, attempt_id) as n from v_ledger where role <> 'batch_metadata' and cost_nano is null),
 r as (select r.run_id, h.created_at as first_observed, coalesce(JSON(coalesce(h.details_json, r.halt_json, '{}'), '$.code'), 'E_RUN_HALTED') as code,
   JSON(coalesce(h.details_json, r.halt_json, '{}'), '$.message') as message from v_runs r left join h on h.run_id = r.run_id and h.n = 1 where r.status = 'halted')
select r.run_id, r.code, r.message, r.first_observed, case when code = 'E_SPEND_UNACCOUNTED' then c.attempt_id end as attempt_id,
  case when code = 'E_SPEND_UNACCOUNTED' then c.role end as role, case when code = 'E_SPEND_UNACCOUNTED' then c.status end as http_status
from r left join c on c.run_id = r.run_id and c.n = 1""")
def _(t: Inputs) -> DataFrame:
    return ledger.stop_reason(t.view("v_runs"), t.view("v_events"), t.view("v_recoveries"), t.view("v_ledger"))


# What the calls of halted runs left behind: every third run could not keep a response, keys and stored values vary by event.
STOP_CALLS = """select l.*, concat(case when event_id % 5 = 0 then 'other' else l.run_id end, '/', l.fingerprint, '/raw/', l.attempt_id) as raw_key from v_ledger l"""
STOP_RAW = """select raw_key, case when event_id % 4 = 0 then 999 else status end as envelope_status,
  case event_id % 3 when 0 then '{"error_type":"max_tokens_exceeded"}' when 1 then '{"error_type":"max_tokens_exceeded"} and more' end as raw
  from (STOP_CALLS) c where event_id % 11 <> 0""".replace("STOP_CALLS", STOP_CALLS)


@query("stop_diagnosis", f"""
with c as (select *, row_number() over (partition by run_id order by created_at, attempt_id) as n from ({STOP_CALLS}) x where role <> 'batch_metadata' and cost_nano is null),
 s as (select r.run_id, case when r.user_id % 3 = 0 then 'E_INTERNAL' when r.user_id % 3 = 1 then 'E_RAW_PERSIST' else 'E_SPEND_UNACCOUNTED' end as code,
   case when r.user_id % 2 = 0 then 'Durable Object reset because its code was updated.' else 'm' end as message from v_runs r where status = 'halted'),
 j as (select s.*, c.attempt_id, c.role, c.status, c.raw_key, c.fingerprint, w.raw_key is not null as stored, w.envelope_status, w.raw from s
   left join c on c.run_id = s.run_id and c.n = 1 and s.code <> 'E_INTERNAL' left join ({STOP_RAW}) w on w.raw_key = c.raw_key),
 f as (select j.*, coalesce(role = 'confidence' and status = 400, false) as refused, code = 'E_RAW_PERSIST' and attempt_id is not null as persist,
   case when coalesce(role = 'confidence' and status = 400, false) or (code = 'E_RAW_PERSIST' and attempt_id is not null) then
     case when not starts_with(raw_key, concat(run_id, '/')) then 'E_ARTIFACT_SCOPE' when not stored then 'E_ARTIFACT_INVALID' end end as finding_code from j),
 g as (select f.*, finding_code is null and persist and envelope_status is not distinct from status and raw is not null as retained,
   finding_code is null and refused and coalesce(raw = '{{"error_type":"max_tokens_exceeded"}}', false) as oversize from f)
select g.run_id, g.code, g.attempt_id, d.original_filename as document, retained, oversize, finding_code,
  case when oversize then 'size_unknown_usage' when retained then 'retained_response' when code = 'E_INTERNAL' and message <> 'm' then 'runtime_reset' else 'halted' end as headline
from g left join v_docs d on d.run_id = g.run_id and d.fingerprint = g.fingerprint""")
def _(t: Inputs) -> DataFrame:
    halts = t.sql("""select run_id, 0 as event_seq, created_at, 'run' as stage, 'halted' as kind, concat('{"code":"', case when user_id % 3 = 0 then 'E_INTERNAL' when user_id % 3 = 1 then 'E_RAW_PERSIST' else 'E_SPEND_UNACCOUNTED' end,
      '","message":"', case when user_id % 2 = 0 then 'Durable Object reset because its code was updated.' else 'm' end, '"}') as details_json from v_runs""")
    calls = t.sql(STOP_CALLS)
    stopped = ledger.stop_reason(t.view("v_runs"), halts, t.view("v_recoveries").limit(0), calls)
    out = ledger.stop_diagnosis(stopped, calls, t.view("v_docs"), t.sql(STOP_RAW))
    return out.select("run_id", "code", "attempt_id", "document", "retained", "oversize", "finding_code", "headline")


@query("recovery_progress", """
with g as (select run_id, recovery_id, generation, row_number() over (partition by run_id order by generation desc) as n from v_recoveries)
select g.run_id, g.recovery_id, g.generation, count(d.recovery_id) as total, coalesce(sum(case when d.state <> 'started' then 1 else 0 end), 0) as pending
from g left join v_recovery_docs d on d.recovery_id = g.recovery_id where g.n = 1 group by g.run_id, g.recovery_id, g.generation""")
def _(t: Inputs) -> DataFrame:
    return ledger.recovery_progress(t.view("v_recoveries"), t.view("v_recovery_docs"))


ELIGIBLE_SQL = f"""
with p as ({PENDING_SQL}), g as (select run_id, recovery_id, row_number() over (partition by run_id order by generation desc) as n from v_recoveries),
 plan as (select g.run_id, d.fingerprint, d.new_workflow_id, d.state from g join v_recovery_docs d on d.recovery_id = g.recovery_id where g.n = 1),
 infra as (select run_id from v_runs where JSON(halt_json, '$.code') = 'E_WORKFLOW_INTERRUPTED'),
 dw as (select d.run_id, d.workflow_id, plan.new_workflow_id, plan.state, w.status as wstatus from v_run_docs d
   left join plan on plan.run_id = d.run_id and plan.fingerprint = d.fingerprint left join v_workflows w on w.workflow_id = d.workflow_id),
 reasons as (
  select run_id, 'not_halted' as reason from v_runs where status <> 'halted'
  union select run_id, 'needs_review' from v_runs where status = 'halted' and run_id not in (select run_id from infra)
  union select run_id, 'inputs_unavailable' from v_full_runs where not text_held
  union select run_id, 'unaccounted_calls' from v_ledger where role <> 'batch_metadata' and cost_nano is null
  union select run_id, 'pending_accounting' from p
  union select run_id, 'open_checkpoint' from v_checkpoints where status <> 'complete'
  union select run_id, 'open_artifact' from v_artifacts where state <> 'complete'
  union select run_id, 'batch_submitted' from v_batches
  union select run_id, 'request_without_call' from v_checkpoints c where name not like 'batch%' and not exists (select 1 from v_ledger v where v.attempt_id = concat(c.run_id, '-', c.fingerprint, '-', replace(c.name, '-http-', '-')))
  union select run_id, 'plan_mismatch' from dw where new_workflow_id is not null and new_workflow_id <> workflow_id
  union select run_id, 'workflow_not_stopped' from dw where coalesce(state, '') <> 'pending' and coalesce(wstatus, '') not in ('complete', 'errored', 'terminated')
  union select run_id, 'failed_document' from v_run_docs where status <> 'complete' and failure_json is not null
  union select run_id, 'input_missing' from v_run_docs d where status <> 'complete' and not exists (select 1 from v_artifacts a where a.key = d.input_key and a.deleted_at is null))
"""


@query("recovery_refusals", ELIGIBLE_SQL + "select run_id, reason from reasons")
def _(t: Inputs) -> DataFrame:
    return _refusals(t)


def _refusals(t: Inputs) -> DataFrame:
    return ledger.recovery_refusals(*[t.view(v) for v in (
        "v_full_runs", "v_run_docs", "v_recoveries", "v_recovery_docs", "v_checkpoints", "v_artifacts", "v_batches", "v_events", "v_ledger", "v_workflows")])


@query("recovery_eligibility", ELIGIBLE_SQL + "select r.run_id, count(x.reason) as n_reasons, count(x.reason) = 0 as eligible from v_runs r left join reasons x on x.run_id = r.run_id group by r.run_id")
def _(t: Inputs) -> DataFrame:
    return ledger.recovery_eligibility(t.view("v_runs"), _refusals(t)).select("run_id", F.size("reasons").alias("n_reasons"), "eligible")


@query("retention_set", "select a.key, a.run_id from v_artifacts a join v_runs r on r.run_id = a.run_id where r.status = 'closing' and a.contains_text and a.deleted_at is null")
def _(t: Inputs) -> DataFrame:
    return ledger.retention_set(t.view("v_artifacts"), t.view("v_runs")).select("key", "run_id")


@query("runs_holding_text", "select sum(case when text_held then 1 else 0 end) as runs_holding_text from v_runs")
def _(t: Inputs) -> DataFrame:
    return ledger.runs_holding_text(t.view("v_runs"))


NOW_MS = 1_704_090_000_000


@query("provider_waits", f"""
with w as (select run_id, JSON(details_json, '$.scope') as scope, JSON(details_json, '$.until') as until from v_events where stage = 'provider_cooldown' and kind = 'waiting')
select run_id, scope, max(cast(until as bigint)) as until from w where scope in ('openai', 'typesafe') and until <> 'soon'
  and run_id in (select run_id from v_runs where status = 'running') group by run_id, scope having max(cast(until as bigint)) > {NOW_MS}""")
def _(t: Inputs) -> DataFrame:
    return ledger.provider_waits(t.view("v_events"), t.view("v_runs"), NOW_MS)


STREAKS_SQL = """with o as (select o.*, sum(case when exhausted then 0 else 1 end) over (partition by run_id, vendor order by created_ms, outcome_id rows unbounded preceding) as g from v_outcomes o),
 c as (select o.*, sum(case when exhausted then 1 else 0 end) over (partition by run_id, vendor, g order by created_ms, outcome_id rows unbounded preceding) as consecutive,
   row_number() over (partition by run_id, vendor order by created_ms desc, outcome_id desc) as n from o)"""


@query("consecutive_failures", STREAKS_SQL + " select run_id, vendor, outcome_id, consecutive from c")
def _(t: Inputs) -> DataFrame:
    return ledger.consecutive_failures(t.view("v_outcomes"), ["run_id", "vendor"], F.floor(F.col("created_ms") / 3_600_000)).select(
        "run_id", "vendor", "outcome_id", "consecutive")


@query("circuit_state", STREAKS_SQL + """ select run_id, vendor, max(case when n = 1 then consecutive end) as failures, max(consecutive) as longest,
  case when max(consecutive) >= 3 then 'E_VENDOR_CIRCUIT' end as code from c group by run_id, vendor""")
def _(t: Inputs) -> DataFrame:
    return ledger.circuit_state(t.view("v_outcomes"))


REFS = """select concat('ref-', cast(event_id as string)) as reference_id, concat('u', cast(user_id as string)) as run_id,
  concat('u', cast((user_id + event_id % 3) % 150 as string)) as source_run_id, concat('rev', cast(event_id % 3 as string)) as definition_revision_id,
  concat('owner', cast(user_id % 7 as string)) as confirmed_by, event_type from events"""


@query("lineage_check", f"""
with f as ({REFS}) select f.run_id, f.reference_id, case when event_type = 'click' then 'reference_missing' when f.confirmed_by <> r.actor then 'different_owner'
  when f.run_id = f.source_run_id then 'same_run' when r.status <> 'uploading' then 'already_started' when f.definition_revision_id <> r.definition_revision_id then 'different_definition' end as finding
from f join v_runs r on r.run_id = f.run_id""")
def _(t: Inputs) -> DataFrame:
    rows = t.sql(REFS)
    return ledger.lineage_check(t.view("v_runs"), rows.select("run_id", "reference_id"),
                                rows.filter("event_type <> 'click'").select("reference_id", "source_run_id", "definition_revision_id", "confirmed_by"))


@query("validate_types", """
with x as (select t.*, row_number() over (partition by type_version, id order by position) as id_n, row_number() over (partition by type_version, lower(name) order by position) as name_n from v_types t),
 n as (select type_version, count(*) as n from v_types group by type_version)
select type_version, position, field from (
  select type_version, position, 'name' as field from x where trim(name) = ''
  union all select type_version, position, 'not_for' from x where trim(not_for) = ''
  union all select type_version, position, 'id' from x where id_n > 1 or id = 'con' or id like '%!'
  union all select type_version, position, 'name' from x where name_n > 1
  union all select type_version, position, 'examples' from x where example is null
  union all select o.type_version, null, 'types' from v_none_options o left join n on n.type_version = o.type_version where coalesce(n.n, 0) not between 1 and 254
  union all select type_version, null, 'none_of_these' from v_none_options where trim(what) = '') f""")
def _(t: Inputs) -> DataFrame:
    types = t.view("v_types").withColumn("examples", F.array("example"))
    return taxonomy.validate_types(types, t.view("v_none_options")).select("type_version", "position", "field")


TYPE_FILE = """select type_version, count(*) as n, min(id) as first_id from v_types group by type_version"""


@query("type_version", f"with f as ({TYPE_FILE}) select type_version as brand, SHA(concat('{{\"n\":', cast(n as varchar), ',\"first\":\"', first_id, '\"}}')) as version from f")
def _(t: Inputs) -> DataFrame:
    return t.sql(TYPE_FILE).select(F.col("type_version").alias("brand"), taxonomy.type_version(
        F.concat(F.lit('{"n":'), F.col("n").cast("string"), F.lit(',"first":"'), F.col("first_id"), F.lit('"}'))).alias("version"))


@query("definition_change", """
select r.revision_id, case when b.revision_id is null then 'initial' when b.type_version = r.type_version then 'cosmetic' else 'semantic' end as kind,
  case when b.revision_id is null then 0.9e0 when b.type_version = r.type_version then 0.85e0 when r.revision_id % 2 = 0 then 0.85e0 else 0.9e0 end as threshold,
  case when b.revision_id is null then 'untested' when b.type_version = r.type_version then 'calibrated' when r.revision_id % 2 = 0 then 'unverified' else 'untested' end as status
from v_revisions r left join v_revisions b on b.revision_id = r.base_revision_id""")
def _(t: Inputs) -> DataFrame:
    r = t.view("v_revisions")
    base = r.select(F.col("revision_id").alias("base_revision_id"), F.col("type_version").alias("base_version"))
    kind = taxonomy.definition_change(F.col("base_version"), F.col("type_version"))
    base_threshold = F.when(F.col("base_version").isNotNull(), F.lit(0.85))
    return (r.join(base, "base_revision_id", "left").withColumn("kind", kind)
            .withColumn("p", taxonomy.definition_threshold(F.col("kind"), base_threshold, F.lit("calibrated"), F.col("revision_id") % 2 == 0))
            .select("revision_id", "kind", "p.threshold", "p.status"))


@query("active_definition", """
select project_id, revision_id, threshold, threshold_status from (select a.*, row_number() over (partition by project_id order by created_at desc, activation_id desc) as n from v_activations a) x where n = 1""")
def _(t: Inputs) -> DataFrame:
    return taxonomy.active_definition(t.view("v_revisions"), t.view("v_activations"), ["project_id"]).select(
        "project_id", "revision_id", "threshold", "threshold_status")


@query("definition_history", "select r.project_id, r.revision_id, a.created_at as activated_at, a.change_kind from v_revisions r join v_activations a on a.revision_id = r.revision_id")
def _(t: Inputs) -> DataFrame:
    return taxonomy.definition_history(t.view("v_revisions"), t.view("v_activations"), ["project_id"]).select(
        "project_id", "revision_id", "activated_at", "change_kind")


@query("definition_drafts", "select project_id, revision_id from v_revisions r where not exists (select 1 from v_activations a where a.revision_id = r.revision_id)")
def _(t: Inputs) -> DataFrame:
    return taxonomy.definition_drafts(t.view("v_revisions"), t.view("v_activations"), ["project_id"]).select("project_id", "revision_id")


@query("stale_drafts", """
with active as (select project_id, revision_id from (select a.*, row_number() over (partition by project_id order by created_at desc, activation_id desc) as n from v_activations a) x where n = 1)
select r.project_id, r.revision_id, r.base_revision_id is distinct from a.revision_id as stale from v_revisions r left join active a on a.project_id = r.project_id
where not exists (select 1 from v_activations v where v.revision_id = r.revision_id)""")
def _(t: Inputs) -> DataFrame:
    revisions, activations = t.view("v_revisions"), t.view("v_activations")
    return taxonomy.stale_drafts(taxonomy.definition_drafts(revisions, activations, ["project_id"]),
                                 taxonomy.active_definition(revisions, activations, ["project_id"]), ["project_id"]).select("project_id", "revision_id", "stale")
