"""Streaming guards over the event table; each must give what its batch question gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pigeonhole.functions import money
from pigeonhole.operators import budgets
from pigeonhole.plans import response_queries as rq
from pigeonhole.plans.ledger_queries import ADMISSION_SQL, STREAKS_SQL
from pigeonhole.plans.registry import query
from pigeonhole.plans.views import Inputs
from pigeonhole.session import new_folder
from pigeonhole.sources import ledger as store
from pigeonhole.streaming import guards, maintained


def replayed(calls: DataFrame) -> DataFrame:
    """Every fiftieth call is delivered twice."""
    again = F.explode(F.when(F.pmod(F.hash("attempt_id"), F.lit(50)) == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return calls.withColumn("copy", again).drop("copy")


@query("stream_charge_once", "select attempt_id, run_id, role, status from v_calls")
def _(t: Inputs) -> DataFrame:
    calls = replayed(t.stream("select attempt_id, run_id, role, status from v_calls"))
    return guards.stream_charge_once(calls, new_folder(t.spark, "charge-once"))


@query("stream_live_spend", f"""{ADMISSION_SQL}, b as (select a.*, unknown_calls > 0 and (coalesce(spend_policy, 'halt-on-unknown-v1') = 'halt-on-unknown-v1' or budget_mode <> 'unlimited') as blocks from a)
select run_id, blocks or over_b or over_o or over_t as halt, case when blocks then 'unknown_spend' when over_b or over_o or over_t then 'limit_reached' end as reason, unknown_calls from b""")
def _(t: Inputs) -> DataFrame:
    runs = t.view("v_runs").select("run_id", "spend_policy", "budget_mode", *[F.col(f"limit_{n}").cast("decimal(38,0)").alias(f"limit_{n}") for n in budgets.DIMENSIONS])
    calls = replayed(t.stream("select attempt_id, run_id, role, cost_nano from v_ledger"))
    return guards.stream_live_spend(calls, runs, new_folder(t.spark, "live-spend")).select("run_id", "halt", "reason", "unknown_calls")


@query("stream_cooldowns", """
with r as (select case role when 'confidence' then 'typesafe' else 'openai' end as scope, MS(created_at) + (event_id % 40) * 1000 as until, MS(created_at) as observed_at, attempt_id,
  row_number() over (partition by case role when 'confidence' then 'typesafe' else 'openai' end order by MS(created_at) + (event_id % 40) * 1000 desc, MS(created_at), attempt_id) as n from v_calls where status = 429 and role <> 'batch_metadata')
select scope, until, attempt_id as source_attempt_id, observed_at from r where n = 1""")
def _(t: Inputs) -> DataFrame:
    calls = t.stream("select attempt_id, role, status, MS(created_at) as created_ms, cast(event_id % 40 as string) as retry_after from v_calls where role <> 'batch_metadata'")
    return guards.run_available(guards.stream_cooldowns(calls), new_folder(t.spark, "cooldowns"), "update", ["scope"])


@query("stream_circuit_breaker", STREAKS_SQL + " select run_id, vendor, max(case when n = 1 then consecutive end) as failures, max(consecutive) as longest, max(consecutive) >= 3 as tripped from c group by run_id, vendor")
def _(t: Inputs) -> DataFrame:
    folder = new_folder(t.spark, "circuit")
    # outcomes arrive in four appends that cross each other in time, some of them twice
    source, rows = f"{folder}/source", t.view("v_outcomes")
    part = F.pmod(F.xxhash64("outcome_id"), F.lit(4))
    for n in range(4):
        rows.filter((part == n) | ((part == 0) & (F.pmod(F.col("created_ms"), F.lit(5)) == n))).write.mode("append").parquet(source)
        out = guards.stream_circuit_breaker(t.spark.readStream.schema(rows.schema).parquet(source), f"{folder}/state", block_ms=3_600_000)
    return out


@query("stream_run_progress", """
with d as (select concat('u', cast(user_id as varchar)) as run_id, count(*) as n from events where event_type = 'view' group by user_id)
select r.run_id, d.n as completed, case when r.user_id % 3 = 0 then d.n else d.n + 1 end as expected_count, r.user_id % 3 = 0 as complete from v_runs r join d on d.run_id = r.run_id""")
def _(t: Inputs) -> DataFrame:
    done = t.stream("select concat('u', cast(user_id as string)) as run_id, cast(event_id as string) as fingerprint from events where event_type = 'view'")
    runs = t.sql("""select r.run_id, case when r.user_id % 3 = 0 then d.n else d.n + 1 end as expected_count from v_runs r
        join (select concat('u', cast(user_id as string)) as run_id, count(*) as n from events where event_type = 'view' group by user_id) d on d.run_id = r.run_id""")
    again = done.unionByName(done.filter("cast(fingerprint as bigint) % 7 = 0"))  # every seventh completion is reported twice
    return guards.stream_run_progress(again, runs, new_folder(t.spark, "progress")).select("run_id", "completed", "expected_count", "complete")


@query("stream_first_halt", """
with g as (select run_id, max(created_at) as since from v_recoveries group by run_id),
 h as (select e.run_id, e.created_at, JSON(e.details_json, '$.code') as code, row_number() over (partition by e.run_id order by e.created_at, e.event_seq) as n, count(*) over (partition by e.run_id) as c
   from v_events e left join g on g.run_id = e.run_id where e.stage = 'run' and (g.since is null or e.created_at >= g.since))
select run_id, created_at as halted_at, code, c - 1 as observed from h where n = 1""")
def _(t: Inputs) -> DataFrame:
    events = t.stream("select run_id, event_seq, created_at, stage, kind, details_json from v_events", stored_first=True)
    recoveries = t.view("v_recoveries").groupBy("run_id").agg(F.max("created_at").alias("recovered_at"))
    return guards.run_available(guards.stream_first_halt(events, recoveries), new_folder(t.spark, "first-halt"), "update", ["run_id"])


@query("stream_batch_results", f"""
select o_custkey as batch_id, count(*) filter (kind = 'absent') as absent, count(*) filter (kind = 'twice') as duplicates, count(*) filter (kind in ('error', 'http')) as failed, count(*) filter (kind = 'good') as good
from (select o.*, {rq.LINE_KIND} as kind from orders o) x group by o_custkey""")
def _(t: Inputs) -> DataFrame:
    folder = new_folder(t.spark, "result-stream")
    lines = rq.result_lines(t)
    lines.select(F.col("batch_id").alias("part"), F.col("line").alias("value")).withColumn("part", F.col("part") % 8).repartition(8, "part").write.partitionBy("part").option("lineSep", "\n").text(f"{folder}/in")
    guards.run_batches(guards.read_result_stream(t.spark, f"{folder}/in", 4), folder, guards.result_stager(f"{folder}/staged"))
    # the batch of a line is the batch its request was sent in
    expected = rq.expected_requests(t)
    schema = "file_id string, block_start bigint, line string, row_order bigint"
    staged = t.spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 8).parquet(f"{folder}/staged")
    ids = staged.withColumn("custom_id", F.get_json_object("line", "$.custom_id")).join(expected, "custom_id").drop("custom_id")
    out = guards.stream_correlation(ids, expected, rq.batch_states(t), f"{folder}/correlation")
    return out.groupBy("batch_id").agg(
        F.count_if(F.col("reference").isNull()).alias("absent"), F.count_if(F.col("code") == "E_BATCH_DUPLICATE_RESULT").alias("duplicates"),
        F.count_if(F.col("code") == "E_BATCH_DOCUMENT").alias("failed"), F.count_if(F.col("code").isNull()).alias("good"))


@query("maintained_run_calls", """
with l as (select run_id, role, status, created_at, row_number() over (partition by run_id order by created_at desc, attempt_id desc) as n from v_ledger where role <> 'batch_metadata'),
 u as (select run_id, cast(coalesce(sum(case when role in ('reader', 'recovery') then cast(cost_nano as hugeint) end), 0) as varchar) as openai, cast(coalesce(sum(case when role = 'confidence' then cast(cost_nano as hugeint) end), 0) as varchar) as typesafe,
   cast(coalesce(sum(case when role <> 'batch_metadata' then cast(cost_nano as hugeint) end), 0) as varchar) as blended, sum(case when role <> 'batch_metadata' and cost_nano is null then 1 else 0 end) as unaccounted from v_ledger group by run_id)
select u.run_id, blended, openai, typesafe, unaccounted, case when l.run_id is null then 'not_contacted' when l.status is null then 'no_response' when l.status between 200 and 299 then 'response_received' else 'response_failed' end as status,
  l.role as latest_role, l.created_at as latest_at from u left join l on l.run_id = u.run_id and l.n = 1""")
def _(t: Inputs) -> DataFrame:
    folder = new_folder(t.spark, "maintained")
    calls = t.view("v_ledger").select("run_id", "attempt_id", "role", "status", "cost_nano", "created_at")
    for part in range(2):  # a refresh after each append
        store.append_immutable(calls.filter(F.pmod(F.xxhash64("attempt_id"), F.lit(2)) == part), f"{folder}/calls", ["attempt_id"])
        out = maintained.run_calls(t.spark, f"{folder}/calls", f"{folder}/figures")
    return out.select("run_id", *[money.money_text(F.col(n)).alias(n) for n in budgets.DIMENSIONS], "unaccounted", "status", "latest_role", "latest_at")
