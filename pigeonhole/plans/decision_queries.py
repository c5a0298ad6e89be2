"""Queries over decisions, tags, uploads and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pigeonhole import constants as k
from pigeonhole.operators import decisions, results
from pigeonhole.plans.registry import query
from pigeonhole.plans.views import Inputs

TYPES = ["type_de", "type_en", "type_es", "type_fr"]


def type_ids():
    return F.array(*[F.lit(t) for t in TYPES])


def decision_inputs(t: Inputs, view: str = "v_model") -> DataFrame:
    m = t.view(view)
    return m.withColumns({
        "type_ids": type_ids(),
        "threshold": F.lit(0.9),
        "failures": F.array_compact(F.array("failure")),
        "notes": F.array_compact(F.array("note")),
        "note_policy": F.lit(k.NOTES_STRUCTURAL_INFO),
        "state_policy": F.lit(k.STATE_V3),
        "noul": F.create_map(*[x for s in ("de", "en", "es", "fr") for x in (F.lit(f"type_{s}"), F.col(f"noul_{s}"))]),
        "reader_yes": F.array_distinct(F.array_compact(F.array("yes_1", "yes_2"))),
    })


def decided(t: Inputs) -> DataFrame:
    return decisions.decide(decision_inputs(t))


@query("decide_documents", "select run_id, fingerprint, rule_id, destination_folder from v_decided")
def _(t: Inputs) -> DataFrame:
    return decided(t).select("run_id", "fingerprint", "rule_id", "destination_folder")


@query("decide_summary", """
select run_id, rule_id, count(*) as documents, cast(sum(case when destination_folder = 'human_review' then 1 else 0 end) as bigint) as reviewed
from v_decided group by run_id, rule_id""")
def decide_summary(t: Inputs) -> DataFrame:
    return decided(t).groupBy("run_id", "rule_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum((F.col("destination_folder") == k.REVIEW_FOLDER).cast("bigint")).alias("reviewed"))


@query("validate_decision_inputs", """
select run_id, fingerprint, 'E_DECISION_INPUT' as code, 'certainty must be between zero and one' as detail
from v_model where failure is null and coalesce(note, 'N_NO_OUTLINE') = 'N_NO_OUTLINE' and certainty > 0.97e0""")
def _(t: Inputs) -> DataFrame:
    # scores above 0.97 are scaled out of range to stand for a broken output
    rows = decision_inputs(t).withColumn("certainty", F.when(F.col("certainty") > 0.97, F.col("certainty") * 2).otherwise(F.col("certainty")))
    return decisions.validate_decision_inputs(rows, ["run_id", "fingerprint"]).select("run_id", "fingerprint", "code", "detail")


@query("assign_tags", "select run_id, fingerprint, tag from v_manifest")
def _(t: Inputs) -> DataFrame:
    return decisions.assign_tags(t.view("v_ids").withColumnRenamed("doc_id", "preflight_order"), block_size=256).select("run_id", "fingerprint", "tag")


@query("reader_yes", """
select run_id, fingerprint, case when yes_2 is null or yes_2 = yes_1 then coalesce(yes_1, '') when yes_1 is null then yes_2
  when yes_1 < yes_2 then concat(yes_1, ',', yes_2) else concat(yes_2, ',', yes_1) end as yes from v_model""")
def _(t: Inputs) -> DataFrame:
    verdicts = F.array(*[F.struct(F.lit(x).alias("type_id"), (F.coalesce(F.col("yes_1") == x, F.lit(False))
                                                              | F.coalesce(F.col("yes_2") == x, F.lit(False))).alias("is_type")) for x in TYPES])
    return t.view("v_model").select("run_id", "fingerprint", F.array_join(decisions.reader_yes(verdicts), ",").alias("yes"))


@query("admit_uploads", """
with up as (select concat('run', cast(doc_id % 4 as string)) as run_id, SHA(text) as fingerprint,
    case when doc_id % 25 = 0 then SHA(concat(text, source)) else SHA(text) end as input_hash,
    case when doc_id % 10 = 0 then 'E_UNSUPPORTED_FORMAT' end as failure_code from documents),
 g as (select run_id, fingerprint, count(*) as copies, count(distinct input_hash) as hashes, max(failure_code) as failure_code from up group by run_id, fingerprint),
 pre as (select run_id, fingerprint, doc_id % 10 = 0 as failed from v_ids where true_type <> 'type_es'),
 s as (select g.run_id, g.fingerprint, g.copies, g.failure_code, case when p.fingerprint is null then 'not_in_preflight'
   when g.hashes > 1 then 'conflict' when (g.failure_code is not null) <> p.failed then 'preflight_differs'
   when g.failure_code is not null then 'failed_locally' else 'uploaded' end as status
   from g left join pre p on p.run_id = g.run_id and p.fingerprint = g.fingerprint)
select run_id, fingerprint, copies, status, failure_code, case when status = 'failed_locally' then 'R0' end as rule_id from s""")
def _(t: Inputs) -> DataFrame:
    uploads = t.sql("""select concat('run', cast(doc_id % 4 as string)) as run_id, SHA(text) as fingerprint,
        case when doc_id % 25 = 0 then SHA(concat(text, source)) else SHA(text) end as input_hash,
        'same.docx' as original_filename, case when doc_id % 10 = 0 then 'E_UNSUPPORTED_FORMAT' end as failure_code from documents""")
    preflight = t.view("v_ids").filter("true_type <> 'type_es'").select(
        "run_id", "fingerprint", F.lit("same.docx").alias("original_filename"), (F.col("doc_id") % 10 == 0).alias("failed"))
    return decisions.admit_uploads(uploads, preflight)


@query("manifest_entries", """
select run_id, fingerprint, tag, destination_folder, rule, case when note is null then 0 else 1 end as n_notes,
  case when failure is null then 0 else 1 end as n_failures, case when failure is null then choice end as checked_choice,
  case when failure is null then noul_en end as checked_noul_en, case when failure is null then case when yes_1 = 'type_fr' then 1 else 0 end end as reader_fr
from v_manifest""")
def _(t: Inputs) -> DataFrame:
    inputs = decision_inputs(t)
    tagged = decisions.assign_tags(decisions.decide(inputs).withColumnRenamed("doc_id", "preflight_order"), block_size=256)
    answered = inputs.filter("failure is null")
    confidence = answered.select("run_id", "fingerprint", "choice", "certainty", "noul")
    reader = answered.select("run_id", "fingerprint", F.array(*[F.struct(
        F.lit(x).alias("type_id"), F.coalesce(F.col("yes_1") == x, F.lit(False)).alias("is_type")) for x in TYPES]).alias("verdicts"))
    m = results.manifest_entries(tagged, confidence, reader)
    return m.select("run_id", "fingerprint", "tag", "destination_folder", "rule", F.size("notes").alias("n_notes"),
                    F.size("failures").alias("n_failures"), F.col("confidence_check.choice").alias("checked_choice"),
                    F.try_element_at("confidence_check.noul", F.lit("type_en")).alias("checked_noul_en"),
                    F.when(F.col("reader").isNotNull(), F.exists("reader", lambda v: (v["type_id"] == "type_fr") & v["is_type"]).cast("int")).alias("reader_fr"))


@query("present_results", """
select run_id, fingerprint, doc_id as position, case when rule_id = 'R1' then 'Filed' when rule_id = 'R0' then 'Could not process' else 'Human review' end as outcome,
  case when rule_id = 'R1' then 'filed' when rule_id = 'R0' then 'failed' else 'review' end as tone, destination_folder as destination,
  case when rule_id = 'R5' then 'Review first' else '' end as priority, rule_id as rule, rule_id = 'R5' as first,
  concat(case rule_id when 'R0' then 'A processing stage failed.' when 'R0n' then 'The document carries notes that need a person.'
    when 'R1' then 'Both opinions agree at the required certainty.' when 'R2' then 'Both opinions agree below the required certainty.'
    when 'R3' then 'The reader saw more than one type.' when 'R4' then 'Neither opinion found a defined type.'
    else 'The two opinions disagree.' end, case when failure is not null then concat(' ', failure, ': stopped ', failure) else '' end,
    case when note is not null then concat(' ', note) else '' end) as reason
from v_decided""")
def _(t: Inputs) -> DataFrame:
    rows = decided(t).withColumns({"status": F.lit("complete"), "failure_code": F.col("failure"), "position": F.col("doc_id"),
                                   "failure_message": F.when(F.col("failure").isNotNull(), "stopped")})
    return results.present_results(rows).drop("filename")


@query("manifest_readiness", """
select r.run_id, r.status, r.expected_count, count(d.rule_id) as decided,
  r.status in ('complete', 'closed') and count(d.rule_id) = r.expected_count as ready,
  case when r.status in ('complete', 'closed') and count(d.rule_id) = r.expected_count then null else 'E_MANIFEST_INCOMPLETE' end as code
from v_full_runs r left join v_run_docs d on d.run_id = r.run_id group by r.run_id, r.status, r.expected_count""")
def _(t: Inputs) -> DataFrame:
    return results.manifest_readiness(t.view("v_full_runs"), t.view("v_run_docs"))


@query("finalize_runs", """
select r.run_id, case when r.status = 'running' and sum(case when d.status = 'complete' then 1 else 0 end) = r.expected_count then 'complete' else r.status end as status
from v_full_runs r left join v_run_docs d on d.run_id = r.run_id group by r.run_id, r.status, r.expected_count""")
def _(t: Inputs) -> DataFrame:
    return results.finalize_runs(t.view("v_full_runs"), t.view("v_run_docs")).select("run_id", "status")


SPEND_SQL = """select run_id, cast(coalesce(sum(cast(cost_nano as hugeint)), 0) as varchar) as blended,
  cast(coalesce(sum(case when role in ('reader', 'recovery') then cast(cost_nano as hugeint) end), 0) as varchar) as openai,
  cast(coalesce(sum(case when role = 'confidence' then cast(cost_nano as hugeint) end), 0) as varchar) as typesafe,
  sum(case when role <> 'batch_metadata' and cost_nano is null then 1 else 0 end) as unaccounted from v_ledger group by run_id"""
PENDING_SQL = """select run_id, count(*) as pending from (
  select run_id from v_batches b where remote_batch_id is not null and not exists (
    select 1 from v_events e where e.run_id = b.run_id and e.stage = 'batch_accounting' and e.kind = 'reconciled'
      and JSON(e.details_json, '$.batchKey') = b.batch_key)
  union all
  select run_id from v_checkpoints c where status <> 'complete' and name not like 'batch%' and not exists (
    select 1 from v_ledger v where v.attempt_id = concat(c.run_id, '-', c.fingerprint, '-', replace(c.name, '-http-', '-')))) x group by run_id"""


@query("run_summary", f"""
with s as ({SPEND_SQL}), p as ({PENDING_SQL}),
d as (select run_id, sum(case when status = 'complete' then 1 else 0 end) as completed from v_run_docs group by run_id)
select r.run_id, r.status, r.created_at, r.expected_count as total, coalesce(d.completed, 0) as completed, coalesce(s.blended, '0') as blended,
  coalesce(s.openai, '0') as openai, coalesce(s.typesafe, '0') as typesafe, coalesce(s.unaccounted, 0) as unaccounted,
  coalesce(p.pending, 0) as pending, r.text_held, r.mode
from v_full_runs r left join d on d.run_id = r.run_id left join s on s.run_id = r.run_id left join p on p.run_id = r.run_id""")
def _(t: Inputs) -> DataFrame:
    return results.run_summary(t.view("v_full_runs"), t.view("v_run_docs"), t.view("v_ledger"), t.view("v_batches"),
                               t.view("v_events"), t.view("v_checkpoints"))


@query("manifest_headers", f"""
with s as ({SPEND_SQL}), p as ({PENDING_SQL})
select r.run_id, r.threshold, r.mode, coalesce(s.blended, '0') as known_subtotal, coalesce(s.unaccounted, 0) as unresolved_calls,
  coalesce(p.pending, 0) as pending_accounting
from v_full_runs r left join s on s.run_id = r.run_id left join p on p.run_id = r.run_id""")
def _(t: Inputs) -> DataFrame:
    return results.manifest_headers(t.view("v_full_runs"), t.view("v_ledger"), t.view("v_batches"), t.view("v_events"), t.view("v_checkpoints"))


@query("document_evidence", """
select m.run_id, m.fingerprint, m.rule_id, m.note, case when m.failure is null and m.doc_id % 47 <> 0 then m.choice end as choice,
  case when m.failure is null then coalesce(m.yes_1, 'none') end as reader,
  case when m.failure is null and m.doc_id % 47 = 0 then 'E_ARTIFACT_INVALID' end as code
from v_decided m""")
def _(t: Inputs) -> DataFrame:
    d = decided(t).withColumns({
        "confidence_key": F.when(F.col("failure").isNull(), F.concat_ws("/", "run_id", F.lit("confidence"), "fingerprint")),
        "reader_key": F.when(F.col("failure").isNull(), F.concat_ws("/", "run_id", F.lit("reader"), "fingerprint"))})
    # validated outputs as their own stored tables; every 47th confidence value was lost
    stored = d.filter("failure is null")
    confidence = stored.filter("doc_id % 47 <> 0").select(F.col("confidence_key").alias("key"), F.col("choice").alias("value"))
    reader = stored.select(F.col("reader_key").alias("key"), F.coalesce("yes_1", F.lit("none")).alias("value"))
    out = results.document_evidence(d.select("run_id", "fingerprint", "rule_id", "note", "confidence_key", "reader_key"), confidence, reader)
    return out.select("run_id", "fingerprint", "rule_id", "note", F.col("confidence").alias("choice"), "reader", "code")
