"""Queries over request bodies, batch groups, estimates, folder plans and retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pigeonhole import constants as k
from pigeonhole.functions import text as tx
from pigeonhole.operators import batching, requests, states, tree
from pigeonhole.plans.outline_queries import COMPACT_SQL, KEYS, PARTS_SQL, STRUCTURED_SQL, nested
from pigeonhole.plans.registry import query
from pigeonhole.plans.views import Inputs

# Short stand-ins for the prompts a pack carries.
PROMPTS = {"choice_full": "Pick one type.", "score_full": "Does it fit \"definition\"?", "choice_sections": "Pick one type from the sections.",
           "score_sections": "Do the sections fit?", "score_false": "It does not fit.", "reader_prompt": "Read everything.\nQuote exactly.", "recovery_prompt": "List the headings."}
PINS = {"confidence_pin": "jev-1.2.3", "confidence_policy": "versioned", "reader_pin": "gpt-6-sol", "reader_policy": "owner_approved_alias",
        "recovery_pin": "gpt-6-luna", "recovery_policy": "owner_approved_alias", "effort": "low"}
NONE_JSON = '{"name":"None","what":"Fits nothing"}'


def pack_rows(t: Inputs) -> DataFrame:
    return t.sql("select distinct run_id from v_ids").withColumns({
        **{n: F.lit(v) for n, v in {**PROMPTS, **PINS}.items()}, "none_json": F.lit(NONE_JSON), "reader_cap": F.lit(4000), "recovery_cap": F.lit(900)})


def type_rows(t: Inputs) -> DataFrame:
    langs = t.sql("select distinct run_id, lang from (select concat('run', cast(doc_id % 4 as string)) as run_id, lang from documents) d")
    return langs.select("run_id", F.col("lang").alias("position"), F.concat(F.lit("type_"), "lang").alias("id"), F.upper("lang").alias("name"),
                        F.concat(F.lit("Text in "), "lang").alias("what"), F.lit("Other \"text\"").alias("not_for"), F.array(F.lit("a"), F.col("lang")).alias("examples"))


TYPE_JSON = """concat('{{"id":"type_', {0}, '","name":"', upper({0}), '","what":"Text in ', {0}, '","not_for":"Other \\"text\\"","examples":["a","', {0}, '"]}}')"""
TYPES_SQL = f"""ty as (select run_id, string_agg({TYPE_JSON.format('lang')}, ',' order by lang) as jsons, string_agg(concat('"type_', lang, '":', {TYPE_JSON.format('lang')}), ',' order by lang) as criteria,
  string_agg(concat('"type_', lang, '"'), ',' order by lang) as ids, cast(count(*) as varchar) as n,
  string_agg(concat('"is_type_', lang, '":{{"type":"noul","instructions":{{"question":"Does it fit \\"definition\\"?","definition":', {TYPE_JSON.format('lang')}, '}},"criteria":{{"true":', {TYPE_JSON.format('lang')}, ',"false":"It does not fit."}}}}'), ',' order by lang) as scores
  from (select distinct concat('run', cast(doc_id % 4 as varchar)) as run_id, lang from documents) g group by run_id)"""


@query("build_confidence_requests", PARTS_SQL + f""", {TYPES_SQL}
select st.run_id, st.fingerprint, sha256(concat('{{"model":"jev-1.2.3","state":', {COMPACT_SQL}, ',"questions":{{"classification":{{"type":"choice","instructions":"Pick one type.","criteria":{{', criteria, ',"none_of_these":{NONE_JSON}}}}},', scores, '}}}}')) as body
from st join ty on ty.run_id = st.run_id""")
def _(t: Inputs) -> DataFrame:
    rows = states.build_compact_state(nested(t)).select(*KEYS, "serialized")
    return requests.build_confidence_requests(rows, type_rows(t), pack_rows(t), "run_id").select(*KEYS, tx.sha256(F.col("body")).alias("body"))


# States with sections get the other wording; every ninth state lacks a field.
SECTION_SCORES = f"""sc as (select run_id, string_agg(concat('"is_type_', lang, '":{{"type":"noul","instructions":{{"question":"Do the sections fit?","definition":', {TYPE_JSON.format('lang')}, '}},"criteria":{{"true":', {TYPE_JSON.format('lang')},
  ',"false":"It does not fit."}}}}'), ',' order by lang) as section_scores from (select distinct concat('run', cast(doc_id % 4 as varchar)) as run_id, lang from documents) g group by run_id)"""


@query("build_confidence_requests_sections", PARTS_SQL + f""", {TYPES_SQL}, {SECTION_SCORES}
select st.run_id, st.fingerprint, case when doc_id % 9 = 0 then 'E_DIGEST_STATE' end as code, case when doc_id % 9 <> 0 then sha256(concat('{{"model":"jev-1.2.3","state":', {STRUCTURED_SQL},
  ',"questions":{{"classification":{{"type":"choice","instructions":"Pick one type from the sections.","criteria":{{', criteria, ',"none_of_these":{NONE_JSON}}}}},', section_scores, '}}}}')) end as body
from st join ty on ty.run_id = st.run_id join sc on sc.run_id = st.run_id""")
def _(t: Inputs) -> DataFrame:
    rows = states.build_structured_state(nested(t)).select(*KEYS, F.when(F.col("doc_id") % 9 == 0, F.replace("serialized", F.lit('{"fullText":'), F.lit('{"whole":'))).otherwise(F.col("serialized")).alias("serialized"))
    return requests.build_confidence_requests(rows, type_rows(t), pack_rows(t), "run_id").select(*KEYS, "code", tx.sha256(F.col("body")).alias("body"))


READER_BODY = """concat('{"model":"gpt-6-sol","reasoning":{"effort":"low"},"max_output_tokens":4000,"store":false,"truncation":"disabled","prompt_cache_options":{"mode":"explicit"},"input":[{"role":"system","content":',
  to_json(concat('Read everything.', chr(10), 'Quote exactly.', chr(10), 'Output schema:', chr(10), sc, chr(10), 'Type definitions:', chr(10), '{"types":[', jsons, '],"none_of_these":%s}')),
  '},{"role":"user","content":', to_json(text), '}],"text":{"format":{"type":"json_schema","name":"document_type_verdicts","strict":true,"schema":', sc, '}}}')""" % NONE_JSON
READER_SCHEMA_SQL = """sx as (select ty.*, concat('{"type":"object","additionalProperties":false,"required":["verdicts"],"properties":{"verdicts":{"type":"array","minItems":', n, ',"maxItems":', n, ',"items":{"type":"object","additionalProperties":false,"required":["type_id","is_type","rationale","evidence","closest_alternative"],"properties":{"type_id":{"type":"string","enum":[', ids,
  ']},"is_type":{"type":"boolean"},"rationale":{"type":"string"},"evidence":{"type":"array","maxItems":3,"items":{"type":"string"}},"closest_alternative":{"type":["string","null"],"enum":[', ids, ',null]}}}}}}') as sc from ty)"""


def reader_requests(t: Inputs) -> DataFrame:
    return requests.build_reader_requests(t.view("v_docs").withColumnRenamed("text", "full_text"), type_rows(t), pack_rows(t), "run_id")


@query("build_reader_requests", f"with {TYPES_SQL}, {READER_SCHEMA_SQL} select d.run_id, d.fingerprint, sha256({READER_BODY}) as body, length({READER_BODY}) as n from v_docs d join sx on sx.run_id = d.run_id")
def _(t: Inputs) -> DataFrame:
    return reader_requests(t).select(*KEYS, tx.sha256(F.col("body")).alias("body"), F.length("body").alias("n"))


RECOVERY_SCHEMA = '{"type":"object","additionalProperties":false,"required":["headings"],"properties":{"headings":{"type":"array","items":{"type":"string"}}}}'


@query("build_recovery_requests", f"""
select run_id, fingerprint, sha256(concat('{{"model":"gpt-6-luna","reasoning":{{"effort":"low"}},"max_output_tokens":900,"store":false,"truncation":"disabled","prompt_cache_options":{{"mode":"explicit"}},"input":[{{"role":"system","content":',
  to_json(concat('List the headings.', chr(10), 'Output schema:', chr(10), '{RECOVERY_SCHEMA}')), '}},{{"role":"user","content":', to_json(text), '}}],"text":{{"format":{{"type":"json_schema","name":"document_headings","strict":true,"schema":{RECOVERY_SCHEMA}}}}}}}')) as body
from v_docs where original_filename like '%.pdf'""")
def _(t: Inputs) -> DataFrame:
    docs = t.view("v_docs").withColumnRenamed("text", "full_text").withColumn("needs_outline_recovery", F.col("original_filename").endswith(".pdf"))
    return requests.build_recovery_requests(docs, pack_rows(t), "run_id").select(*KEYS, tx.sha256(F.col("body")).alias("body"))


@query("batch_lines", f"""with {TYPES_SQL}, {READER_SCHEMA_SQL}, b as (select d.run_id, d.fingerprint, concat('{{"custom_id":"', d.fingerprint, '","method":"POST","url":"/v1/responses","body":', {READER_BODY}, '}}') as line from v_docs d join sx on sx.run_id = d.run_id)
select run_id, fingerprint, octet_length(encode(line)) + 1 as bytes from b""")
def _(t: Inputs) -> DataFrame:
    rows = reader_requests(t)
    line = requests.batch_line(F.col("fingerprint"), F.col("body"))
    return rows.select(*KEYS, (F.octet_length(line) + 1).alias("bytes"))


@query("validate_batch_input", """
select o_custkey as batch_id, count(*) as requests, sum(length(cast(o_orderkey as varchar)) + length(o_orderpriority) + 1) as input_bytes,
  case when count(*) > 12 then 'E_BATCH_INPUT_LIMIT' when bool_or(o_orderkey % 97 = 0) then 'E_BATCH_MODEL' when sum(length(cast(o_orderkey as varchar)) + length(o_orderpriority) + 1) > 150 then 'E_BATCH_INPUT_LIMIT' end as code
from orders group by o_custkey""")
def _(t: Inputs) -> DataFrame:
    o = t.table("orders").select(F.col("o_custkey").alias("batch_id"), F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("custom_id"),
                                 F.concat(F.col("o_orderkey").cast("string"), "o_orderpriority").alias("line"), F.lit("reader").alias("role"),
                                 F.when(F.col("o_orderkey") % 97 == 0, "other").otherwise("gpt-6-sol").alias("model"), F.lit("owner_approved_alias").alias("model_policy"),
                                 F.lit("gpt-6-sol").alias("pin"), F.lit("owner_approved_alias").alias("pin_policy"))
    return batching.validate_batch_input(o, max_bytes=150, max_requests=12)


# The packing as a recursive walk: one request after the other, in fingerprint order.
@query("plan_batch_groups", """
with recursive r as (select run_id, fingerprint, bytes, row_number() over (partition by run_id order by fingerprint) as n from v_requests),
 w as (select run_id, fingerprint, n, bytes as held, cast(1 as bigint) as cnt, cast(0 as bigint) as group_index, bytes > 8388608 as closed, bytes from r where n = 1
  union all select r.run_id, r.fingerprint, r.n, case when w.closed or w.held + r.bytes > 8388608 then r.bytes else w.held + r.bytes end, case when w.closed or w.held + r.bytes > 8388608 then 1 else w.cnt + 1 end,
   case when w.closed or w.held + r.bytes > 8388608 then w.group_index + 1 else w.group_index end, r.bytes > 8388608, r.bytes from w join r on r.run_id = w.run_id and r.n = w.n + 1)
select run_id, fingerprint, bytes, group_index from w""")
def _(t: Inputs) -> DataFrame:
    return batching.plan_batch_groups(t.view("v_requests"), block_rows=1_000)


@query("group_findings", """
select run_id, fingerprint, case when bytes % 50 = 0 then 'E_BATCH_GROUP' else 'E_BATCH_GROUP_MEMORY' end as code from v_requests where bytes % 50 = 0 or bytes > 8500000""")
def _(t: Inputs) -> DataFrame:
    rows = t.view("v_requests").withColumn("bytes", F.when(F.col("bytes") % 50 == 0, 0).when(F.col("bytes") > 8500000, F.col("bytes") * 4).otherwise(F.col("bytes")))
    return batching.group_findings(rows).select("run_id", "fingerprint", "code")


@query("suggest_run_mode", "select user_id, case when user_id % 4 = 0 then 'interactive' when n_events >= 70 then 'batch' else 'interactive' end as mode from v_runs")
def _(t: Inputs) -> DataFrame:
    rows = t.view("v_runs").select("user_id", F.when(F.col("user_id") % 4 == 0, "interactive").alias("choice"), F.col("n_events").alias("document_count"),
                                   F.lit("interactive").alias("default_mode"), F.lit(70).alias("batch_cutoff"))
    return batching.suggest_run_mode(rows).select("user_id", "mode")


@query("estimate_run", """
with d as (select source, case when doc_id % 9 = 0 then true else false end as failed, case when source like '%3' and doc_id % 4 = 0 then null else n_chars end as tok from documents),
 g as (select source, count(*) filter (not failed) as documents, bool_and(tok is not null) filter (not failed) as known, coalesce(sum(tok) filter (not failed), 0) as tokens from d group by source)
select source, documents, case when coalesce(known, true) then case when documents = 0 then 0 else cast(ceil(greatest(documents / 1200.0e0, documents / 500.0e0, (tokens + documents * 4000) / 400000.0e0) * 60) as bigint) end end as interactive_seconds,
  case when coalesce(known, true) and tokens > 60000 then 'E_BATCH_CAPACITY' end as code from g""")
def _(t: Inputs) -> DataFrame:
    d = t.table("documents")
    docs = d.select("source", (F.col("doc_id") % 9 == 0).alias("failed"), F.when(~(F.col("source").endswith("3") & (F.col("doc_id") % 4 == 0)), F.col("n_chars")).alias("reader_input_tokens"))
    packs = d.select("source").distinct().withColumns({"mode": F.lit("batch"), "reader_max_output_tokens": F.lit(4000), "confidence_rpm": F.lit(1200.0),
                                                       "reader_rpm": F.lit(500.0), "reader_tpm": F.lit(400000.0), "batch_allowance": F.lit(60000)})
    return batching.estimate_run(docs, packs, "source").select("source", "documents", "interactive_seconds", "code")


def plan(t: Inputs) -> DataFrame:
    return tree.plan_tree(t.view("v_manifest"), "original", "/home/someone/built", 90, 80)


PLAN_SQL = """with p as (select run_id, tag, fingerprint, doc_id, destination_folder, concat(destination_folder, '/', tag, '--', original_filename) as path,
  case when destination_folder in ('human_review', 'could_not_process') then concat(destination_folder, '/', tag, '--', original_filename, '.md') end as sidecar_path from v_manifest)"""


@query("plan_tree", PLAN_SQL + " select run_id, tag, path, sidecar_path, case when length(coalesce(sidecar_path, path)) + 21 > 90 then 'long_path' end as warning, cast(null as varchar) as error from p")
def _(t: Inputs) -> DataFrame:
    return plan(t).select("run_id", "tag", "path", "sidecar_path", "warning", "error")


@query("plan_tree_short", "select run_id, tag, concat(destination_folder, '/', tag, case when doc_id % 4 = 0 then '' else concat('.', string_split(original_filename, '.')[2]) end) as path, case when doc_id % 7 = 0 then 'unsafe_name' end as error from v_manifest")
def _(t: Inputs) -> DataFrame:
    m = t.view("v_manifest").withColumn("original_filename", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("."), F.substring_index("original_filename", ".", 1))).otherwise(F.col("original_filename")))
    m = m.withColumn("original_filename", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("a?"), "original_filename")).otherwise(F.col("original_filename")))
    out = tree.plan_tree(m, "short", "/b", 500, 200)
    return out.select("run_id", "tag", F.when(F.col("doc_id") % 28 == 0, F.concat_ws("/", "destination_folder", "tag")).otherwise(F.col("path")).alias("path"), "error")


@query("duplicate_tags", "select concat('run', cast(doc_id % 4 as varchar)) as run_id, source as tag, count(*) as entries from documents group by 1, 2 having count(*) > 1")
def _(t: Inputs) -> DataFrame:
    d = t.table("documents").select(F.concat(F.lit("run"), (F.col("doc_id") % 4).cast("string")).alias("run_id"), F.when(F.col("doc_id") % 3 == 0, F.upper("source")).otherwise(F.col("source")).alias("tag"))
    return tree.duplicate_tags(d)


SOURCE_FILES = "select concat('in/', source, '/', cast(doc_id as string)) as path, SHA(text) as fingerprint, doc_id from documents"


@query("match_sources", f"with f as ({SOURCE_FILES}), m as (select fingerprint, min(path) as source_path from f where doc_id % 6 <> 0 group by fingerprint) select p.run_id, p.tag, m.source_path from v_manifest p left join m on m.fingerprint = p.fingerprint")
def _(t: Inputs) -> DataFrame:
    files = t.sql(SOURCE_FILES).filter("doc_id % 6 <> 0")  # the other files were moved away
    return tree.match_sources(t.view("v_manifest"), files).select("run_id", "tag", "source_path")


RECONCILE_SQL = PLAN_SQL + f""", f as ({SOURCE_FILES}), m as (select fingerprint, min(path) as source_path from f where doc_id % 6 <> 0 group by fingerprint), s as (select path, doc_id from f),
 x as (select p.*, m.source_path, s.doc_id as src from p left join m on m.fingerprint = p.fingerprint left join s on s.path = m.source_path),
 y as (select x.*, case when doc_id % 5 = 0 then 'already_present' when doc_id % 5 = 1 then 'destination_conflict' when source_path is null then 'not_found' when src % 8 = 0 then 'source_changed' else 'copied' end as status from x)"""


def reconciled(t: Inputs, sidecars: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    planned = tree.match_sources(plan(t), t.sql(SOURCE_FILES).filter("doc_id % 6 <> 0"))
    sources = t.sql(SOURCE_FILES).select("path", F.when(F.col("doc_id") % 8 == 0, F.sha2(F.col("path"), 256)).otherwise(F.col("fingerprint")).alias("current_fingerprint"))
    there = plan(t).filter("doc_id % 5 < 2").select("path", F.when(F.col("doc_id") % 5 == 0, F.col("fingerprint")).otherwise(F.sha2("path", 256)).alias("fingerprint"))
    return tree.reconcile_tree(planned, sources, there if sidecars is None else there.unionByName(sidecars), notes)


@query("reconcile_tree", RECONCILE_SQL + " select run_id, tag, path, status from y")
def _(t: Inputs) -> DataFrame:
    return reconciled(t).select("run_id", "tag", "path", "status")


# Notes beside reviewed documents: some lie there with the same text, some with another one.
@query("reconcile_sidecars", RECONCILE_SQL + """ select run_id, tag, path, case when status in ('copied', 'already_present') and sidecar_path is not null and doc_id % 7 = 2 then 'sidecar_conflict' else status end as status from y""")
def _(t: Inputs) -> DataFrame:
    planned, there = plan(t).filter("sidecar_path is not null and doc_id % 7 in (2, 3)"), F.col("doc_id") % 7
    notes = t.view("v_manifest").select("run_id", "tag", F.concat(F.lit("note on "), "tag").alias("note"))
    sidecars = planned.select(F.col("sidecar_path").alias("path"), F.sha2(F.concat(F.when(there == 2, F.lit("another ")).otherwise(F.lit("")), F.lit("note on "), "tag"), 256).alias("fingerprint"))
    return reconciled(t, sidecars, notes).select("run_id", "tag", "path", "status")


@query("build_summary", RECONCILE_SQL + ", c as (select run_id, bool_and(status in ('copied', 'already_present')) as complete from y group by run_id) select y.run_id, y.status, count(*) as entries, any_value(c.complete) as complete from y join c on c.run_id = y.run_id group by y.run_id, y.status")
def _(t: Inputs) -> DataFrame:
    return tree.build_summary(reconciled(t))


@query("render_review_notes", r"""
with e as (select run_id, tag, regexp_replace(tag, '([_*])', '\\\1', 'g') as tag_md, fingerprint, original_filename, rule, destination_folder, failure, choice, certainty, noul_de, yes_1 from v_manifest)
select run_id, tag, sha256(concat_ws(chr(10), '# Document decision', '', concat('Original filename: ', original_filename), concat('Tag: ', tag_md), concat('Fingerprint: ', fingerprint), concat('Decision rule: ', rule), '', '## Reasoning note', '',
  'see \*rules\* &lt;here&gt; &amp; there', case when failure is not null then concat_ws(chr(10), '', '## Reported failure', '', '    {', concat('      "code": "', failure, '",'), '      "message": "stopped \"early\""', '    }') end,
  '', '## Confidence check', '', case when failure is not null then 'No validated output is available. See the reasoning note.' else concat_ws(chr(10), '    {', concat('      "choice": "', choice, '",'),
    concat('      "certainty": ', case when certainty in (0, 1) then cast(cast(certainty as int) as varchar) else cast(certainty as varchar) end, ','), '      "noul": {', concat('        "type_de": ', case when noul_de in (0, 1) then cast(cast(noul_de as int) as varchar) else cast(noul_de as varchar) end), '      }', '    }') end,
  '', '## Reader', '', case when failure is not null then 'No validated output is available. See the reasoning note.' when yes_1 is null then '    []' else concat_ws(chr(10), '    [', '      {', concat('        "typeId": "', yes_1, '",'), '        "isType": true,', '        "rationale": "why",', '        "evidence": [', '          "one",', '          "two"', '        ],', '        "closestAlternative": null', '      }', '    ]') end,
  '', '## What to decide', '', case when destination_folder = 'could_not_process' then 'Resolve the reported problem, then explicitly start a new run for this document if needed.' else 'Choose the appropriate type folder and move this document there, or leave it for further review.' end, '')) as note
from e""")
def _(t: Inputs) -> DataFrame:
    ok = F.col("failure_code").isNull()
    rows = t.view("v_manifest").withColumnRenamed("failure", "failure_code").withColumns({
        "reasoning_note": F.lit("see *rules* <here> & there"),
        "failure": F.when(~ok, F.struct(F.col("failure_code").alias("code"), F.lit('stopped "early"').alias("message"))),
        "confidence_check": F.when(ok, F.struct("choice", "certainty", F.create_map(F.lit("type_de"), F.col("noul_de")).alias("noul"))),
        "reader": F.when(ok, F.when(F.col("yes_1").isNull(), F.array().cast("array<struct<type_id:string,is_type:boolean,rationale:string,evidence:array<string>,closest_alternative:string>>")).otherwise(F.array(F.struct(
            F.col("yes_1").alias("type_id"), F.lit(True).alias("is_type"), F.lit("why").alias("rationale"), F.array(F.lit("one"), F.lit("two")).alias("evidence"), F.lit(None).cast("string").alias("closest_alternative")))))})
    return tree.render_review_notes(rows).select("run_id", "tag", tx.sha256(F.col("note")).alias("note"))


@query("retry_candidates", "select run_id as parent_run_id, fingerprint from v_manifest where rule = 'R0'")
def _(t: Inputs) -> DataFrame:
    return tree.retry_candidates(t.view("v_manifest")).select("parent_run_id", "fingerprint")


@query("retry_session_findings", """
select concat('s', cast(o_custkey as varchar)) as session_id, case when o_custkey % 10 = 0 then 'run' when o_custkey % 10 = 1 then 'time' when count(*) filter (o_orderstatus = 'F') = 0 then 'empty' when bool_or(o_orderkey % 41 = 0) filter (o_orderstatus = 'F') then 'document' end as problem
from orders group by o_custkey having o_custkey % 10 in (0, 1) or count(*) filter (o_orderstatus = 'F') = 0 or bool_or(o_orderkey % 41 = 0) filter (o_orderstatus = 'F')""")
def _(t: Inputs) -> DataFrame:
    o = t.table("orders")
    sid = F.concat(F.lit("s"), F.col("o_custkey").cast("string"))
    sessions = o.select("o_custkey").distinct().select(sid.alias("session_id"), F.lit("r1").alias("run_id"), F.when(F.col("o_custkey") % 10 == 0, "r1").otherwise("r0").alias("parent_run_id"),
                                                       F.when(F.col("o_custkey") % 10 == 1, "never").otherwise("2026-01-02T00:00:00Z").alias("created_at"))
    documents = o.filter("o_orderstatus = 'F'").select(sid.alias("session_id"), F.when(F.col("o_orderkey") % 41 == 0, "xyz").otherwise(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("fingerprint"), F.lit("a.pdf").alias("original_filename"))
    return tree.retry_session_findings(sessions, documents)


RETRY_SQL = f"""with need as (select run_id as session_id, fingerprint from v_manifest where rule = 'R0'), f as (select concat('run', cast(doc_id % 4 as string)) as session_id, path, fingerprint from ({SOURCE_FILES}) s where doc_id % 3 <> 1)"""


def retry_inputs(t: Inputs) -> tuple[DataFrame, DataFrame]:
    need = tree.retry_candidates(t.view("v_manifest")).withColumnRenamed("parent_run_id", "session_id")
    # a third of the files was not offered again
    return need, t.sql(SOURCE_FILES).filter("doc_id % 3 <> 1").withColumn("session_id", F.concat(F.lit("run"), (F.col("doc_id") % 4).cast("string"))).drop("doc_id")


@query("match_retry_sources", RETRY_SQL + """, m as (select f.session_id, f.fingerprint, min(f.path) as path from f join need n on n.session_id = f.session_id and n.fingerprint = f.fingerprint group by f.session_id, f.fingerprint)
select session_id, fingerprint, path, 'matched' as facet from m
union all select session_id, fingerprint, null, 'missing' from need n where not exists (select 1 from m where m.session_id = n.session_id and m.fingerprint = n.fingerprint)
union all select session_id, fingerprint, path, 'excluded' from f where not exists (select 1 from m where m.session_id = f.session_id and m.path = f.path)""")
def _(t: Inputs) -> DataFrame:
    return tree.match_retry_sources(*retry_inputs(t))


@query("retry_completeness", """
with need as (select run_id as session_id, fingerprint, doc_id from v_manifest where rule = 'R0')
select session_id, fingerprint, 'missing' as problem from need where doc_id % 20 = 0 union all select session_id, fingerprint, 'repeated' from need where doc_id % 29 = 0 and doc_id % 20 <> 0
union all select run_id, fingerprint, 'foreign' from v_manifest where rule = 'R3'""")
def _(t: Inputs) -> DataFrame:
    m = t.view("v_manifest").withColumnRenamed("run_id", "session_id")
    have = m.filter("(rule = 'R0' and doc_id % 20 <> 0) or rule = 'R3'").unionByName(m.filter("rule = 'R0' and doc_id % 29 = 0 and doc_id % 20 <> 0"))
    return tree.retry_completeness(m.filter("rule = 'R0'"), have)


@query("resume_action", """
select run_id, concat('in/', cast(doc_id as varchar)) as path, case when doc_id % 5 = 0 then 'extract' when doc_id % 13 = 0 then 'source_changed' when doc_id % 5 = 1 then 'skip' when doc_id % 5 = 2 then 'upload' when doc_id % 5 = 3 then 'failed' else 'extract' end as action from v_ids""")
def _(t: Inputs) -> DataFrame:
    files = t.view("v_ids").withColumn("path", F.concat(F.lit("in/"), F.col("doc_id").cast("string")))
    d = F.col("doc_id") % 5
    state = files.filter("doc_id % 5 <> 0").select("run_id", "path", F.when(F.col("doc_id") % 13 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"),
                                                   F.when(d == 1, "uploaded").when(d == 2, "extracted").when(d == 3, k.FAILED_FOLDER).otherwise("not started").alias("state"))
    return tree.resume_action(files, state).select("run_id", "path", "action")


STEPS = """select o_custkey as run_id, 'p' as path, o_orderkey as step, case o_orderkey % 4 when 0 then 'not started' when 1 then 'extracted' when 2 then 'uploaded' else 'could_not_process' end as state,
  case when o_custkey % 50 = 0 then SHA(cast(o_orderkey as string)) else SHA(cast(o_custkey as string)) end as fingerprint from orders"""


@query("validate_transitions", f"""
with h as ({STEPS}), l as (select h.*, lag(state) over w as p, lag(fingerprint) over w as pf from h window w as (partition by run_id order by step))
select run_id, step, case when pf <> fingerprint then 'identity_changed' else 'transition' end as problem from l where p is not null and (pf <> fingerprint or not case p when 'not started' then state in ('not started', 'extracted', 'could_not_process') when 'extracted' then state in ('extracted', 'uploaded') else state = p end)""")
def _(t: Inputs) -> DataFrame:
    return tree.validate_transitions(t.sql(STEPS).withColumn("document_fingerprint", F.lit(None).cast("string"))).select("run_id", "step", "problem")
