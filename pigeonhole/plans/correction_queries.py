"""Queries over corrected trees, proposals, references and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pigeonhole.operators import corrections, proposals, references
from pigeonhole.plans.decision_queries import type_ids
from pigeonhole.plans.registry import query
from pigeonhole.plans.views import Inputs
from pigeonhole.session import cut

CHECKED = ["type_en", "type_fr", "human_review"]


def correction_rows(t: Inputs) -> DataFrame:
    return t.sql("select concat('c-', run_id) as correction_id, run_id from v_ids group by run_id").withColumns({
        "type_ids": type_ids(), "checked_folders": F.array(*[F.lit(c) for c in CHECKED]), "threshold": F.lit(0.9),
        "minimum_filed": F.lit(10), "type_version": F.lit("v1")})


def manifest(t: Inputs) -> DataFrame:
    return t.view("v_manifest").select("run_id", "fingerprint", "tag", "original_filename", "destination_folder", "rule")


def sidecars(t: Inputs) -> DataFrame:
    return t.view("v_manifest").filter("destination_folder in ('human_review', 'could_not_process')").select(
        F.concat(F.lit("c-"), "run_id").alias("correction_id"), F.concat("destination_folder", F.lit("/"), "tag", F.lit("--"), "original_filename", F.lit(".md")).alias("path"))


def diff(t: Inputs) -> DataFrame:
    return corrections.diff_correction(t.view("v_listing"), manifest(t), correction_rows(t), sidecars(t))


DIFF_SQL = """
with f as (select * from v_listing where filename <> '.DS_Store' and filename not like '%.md'),
 j as (select f.correction_id, f.run_id, f.folder, f.filename, f.tag, f.fingerprint, m.tag as entry_tag, m.fingerprint as entry_fp, m.destination_folder, m.rule, m.doc_id, m.certainty, m.choice
   from f left join v_manifest m on m.run_id = f.run_id and ((f.tag is not null and m.tag = f.tag) or (f.tag is null and m.fingerprint = f.fingerprint))),
 k as (select j.*, folder in ('type_de', 'type_en', 'type_es', 'type_fr') as is_type, folder in ('type_de', 'type_en', 'type_es', 'type_fr', 'human_review', 'could_not_process') as known from j),
 d as (select k.*, case when entry_tag is null then 'unmatched' when folder <> destination_folder then 'move' when known and folder in ('type_en', 'type_fr', 'human_review') then 'confirmation' else 'unchecked' end as facet,
   case when entry_tag is null or folder = destination_folder then null when not known then 'unresolved_folder' when destination_folder = 'human_review' and is_type then 'human_label'
     when is_type then 'misfile' when folder = 'human_review' and rule = 'R1' then 'should_not_have_been_auto_filed' else 'other_move' end as kind from k)"""


@query("check_listing", """
select concat('c-', run_id) as correction_id, 'E_CORRECTION_PATH' as code, count(*) as n from v_manifest where doc_id % 71 = 0 group by run_id
union all select concat('c-', run_id), 'E_CORRECTION_DUPLICATE_PATH', count(*) from v_manifest where doc_id % 73 = 0 and doc_id % 71 <> 0 group by run_id
union all select concat('c-', run_id), 'E_CORRECTION_ROOT_FOLDER', 1 from v_manifest group by run_id""")
def _(t: Inputs) -> DataFrame:
    m = t.view("v_manifest")
    files = m.select(F.concat(F.lit("c-"), "run_id").alias("correction_id"), "run_id",
                     F.when(F.col("doc_id") % 71 == 0, F.concat("destination_folder", F.lit("/../x"))).otherwise(F.col("destination_folder")).alias("folder"),
                     F.col("fingerprint").alias("filename"), "tag", "fingerprint", "doc_id")
    files = files.unionByName(files.filter("doc_id % 73 = 0 and doc_id % 71 <> 0")).drop("doc_id")  # the same path listed twice
    rooted = correction_rows(t).withColumn("checked_folders", F.array(F.lit(""), F.lit("type_en")))
    return corrections.check_listing(files, rooted, manifest(t), sidecars(t)).groupBy("correction_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query("ignored_files", "select correction_id, folder, filename from v_listing where filename = '.DS_Store' or filename like '%.md'")
def _(t: Inputs) -> DataFrame:
    return corrections.mark_ignored(t.view("v_listing"), sidecars(t)).filter("ignored").select("correction_id", "folder", "filename")


@query("match_listing", DIFF_SQL + " select correction_id, filename, entry_tag, case when entry_tag is not null then case when tag is not null then 'tag' else 'fingerprint' end end as matched_by from d")
def _(t: Inputs) -> DataFrame:
    files = corrections.mark_ignored(t.view("v_listing"), sidecars(t)).filter("not ignored")
    return corrections.match_listing(files, manifest(t)).select("correction_id", "filename", "entry_tag", "matched_by")


@query("ambiguous_matches", "select concat('c-', run_id) as correction_id, tag as entry_tag, 2 as files from v_manifest where doc_id % 9 = 0")
def _(t: Inputs) -> DataFrame:
    # the same document kept twice: once under its tag, once without
    m = t.view("v_manifest").select(F.concat(F.lit("c-"), "run_id").alias("correction_id"), "run_id", "tag", "fingerprint", "doc_id")
    copies = m.unionByName(m.filter("doc_id % 9 = 0").withColumn("tag", F.lit(None).cast("string")))
    return corrections.ambiguous_matches(corrections.match_listing(copies, manifest(t))).select("correction_id", "entry_tag", "files")


@query("classify_moves", DIFF_SQL + " select correction_id, entry_tag, destination_folder as moved_from, folder as moved_to, kind from d where facet = 'move'")
def _(t: Inputs) -> DataFrame:
    return diff(t).filter("facet = 'move'").select("correction_id", "entry_tag", F.col("destination_folder").alias("moved_from"), F.col("folder").alias("moved_to"), "kind")


@query("confirmations_and_unchecked", DIFF_SQL + " select correction_id, entry_tag, facet from d where facet in ('confirmation', 'unchecked')")
def _(t: Inputs) -> DataFrame:
    return diff(t).filter("facet in ('confirmation', 'unchecked')").select("correction_id", "entry_tag", "facet")


@query("deleted_entries", DIFF_SQL + " select concat('c-', run_id) as correction_id, tag as entry_tag, destination_folder from v_manifest m where not exists (select 1 from d where d.run_id = m.run_id and d.entry_tag = m.tag)")
def _(t: Inputs) -> DataFrame:
    return diff(t).filter("facet = 'deleted'").select("correction_id", "entry_tag", "destination_folder")


DECISIONS = """select concat('c-', run_id) as correction_id, 'new_topic' as folder, case when run_id = 'run2' then 'ignore' else 'new_type' end as action from v_ids where run_id <> 'run3' group by run_id
union all select concat('c-', run_id), 'Other Things!', case when run_id = 'run1' then 'new_type' else 'ignore' end from v_ids where run_id in ('run0', 'run1') group by run_id"""


@query("unmatched_files", DIFF_SQL + f", a as ({DECISIONS}) select correction_id, folder, filename from d where facet = 'unmatched' and not exists (select 1 from a where a.correction_id = d.correction_id and a.folder = d.folder and a.action = 'ignore')")
def _(t: Inputs) -> DataFrame:
    return corrections.unmatched_files(diff(t), t.sql(DECISIONS)).select("correction_id", "folder", "filename")


@query("unknown_folders", DIFF_SQL + " select correction_id, folder, count(*) as files from d where not known group by correction_id, folder")
def _(t: Inputs) -> DataFrame:
    return corrections.unknown_folders(diff(t))


@query("correction_counts", DIFF_SQL + """ select correction_id, facet, kind, count(*) as files from d group by correction_id, facet, kind
union all select correction_id, 'ignored', null, count(*) from v_listing where filename = '.DS_Store' or filename like '%.md' group by correction_id
union all select concat('c-', run_id), 'deleted', null, count(*) from v_manifest m where not exists (select 1 from d where d.run_id = m.run_id and d.entry_tag = m.tag) group by run_id""")
def _(t: Inputs) -> DataFrame:
    return corrections.facet_counts(diff(t))


INCLUDED_SQL = DIFF_SQL + f", a as ({DECISIONS}), i as (select d.*, a.action, known or coalesce(a.action = 'new_type', false) as included from d left join a on a.correction_id = d.correction_id and a.folder = d.folder)"


def decided_diff(t: Inputs) -> DataFrame:
    return proposals.apply_folder_decisions(diff(t), t.sql(DECISIONS))


@query("apply_folder_decisions", INCLUDED_SQL + " select correction_id, filename, action, included from i")
def _(t: Inputs) -> DataFrame:
    return decided_diff(t).filter("facet not in ('ignored', 'deleted')").select("correction_id", "filename", "action", "included")


@query("folder_decision_findings", DIFF_SQL + f""", a as ({DECISIONS} union all select correction_id, 'never_seen', 'ignore' from ({DECISIONS}) x group by correction_id union all select correction_id, folder, 'drop' from ({DECISIONS}) y),
 u as (select distinct correction_id, folder from d where not known)
select correction_id, folder, 'not_unknown' as problem from a where not exists (select 1 from u where u.correction_id = a.correction_id and u.folder = a.folder)
union all select correction_id, folder, 'action' from a where action not in ('ignore', 'new_type') union all select correction_id, folder, 'repeated' from a group by correction_id, folder having count(*) > 1""")
def _(t: Inputs) -> DataFrame:
    a = t.sql(DECISIONS)
    wrong = a.unionByName(a.select("correction_id", F.lit("never_seen").alias("folder"), F.lit("ignore").alias("action")).distinct()).unionByName(a.withColumn("action", F.lit("drop")))
    return proposals.folder_decision_findings(cut(wrong, "decisions"), corrections.unknown_folders(diff(t)))


def evidence(t: Inputs) -> DataFrame:
    return t.sql("""select run_id, tag, case when failure is null then certainty end as certainty, case when rule = 'R2' then choice end as agreed_type,
        original_filename as title from v_manifest""")


@query("filed_check", INCLUDED_SQL + """, n as (select correction_id, count(*) as checked, sum(case when facet = 'move' then 1 else 0 end) as wrong,
   max(case when facet = 'move' then certainty end) as max_wrong, min(case when facet = 'confirmation' then certainty end) as min_correct
   from i where included and facet in ('confirmation', 'move') and rule = 'R1' group by correction_id)
select c.correction_id, coalesce(checked, 0) as checked, coalesce(wrong, 0) as wrong, coalesce(checked, 0) - coalesce(wrong, 0) as correct,
  case when coalesce(checked, 0) < 10 then 'insufficient_sample' when wrong = 0 then 'no_errors' when max_wrong < min_correct and min_correct > 0.9e0 then 'raise_proposed' else 'cannot_separate' end as status
from (select distinct correction_id from v_listing) c left join n on n.correction_id = c.correction_id""")
def _(t: Inputs) -> DataFrame:
    labelled = proposals.with_evidence(decided_diff(t), evidence(t))
    return proposals.filed_check(labelled, correction_rows(t)).select("correction_id", "checked", "wrong", "correct", "status")


@query("evidence_findings", INCLUDED_SQL + """
select correction_id, entry_tag, case when doc_id % 8 = 0 then 'missing' when rule in ('R1', 'R2') then 'certainty_required' end as problem from i
where included and facet in ('confirmation', 'move') and (doc_id % 8 = 0 or (doc_id % 8 = 1 and (rule = 'R1' or (rule = 'R2' and facet = 'move' and destination_folder = 'human_review' and (kind = 'human_label' or action = 'new_type')))))""")
def _(t: Inputs) -> DataFrame:
    # part of the recorded evidence is missing, part has lost its number
    ev = t.sql("select run_id, tag, case when doc_id % 8 = 1 then null else certainty end as certainty, case when rule = 'R2' then choice end as agreed_type, original_filename as title from v_manifest where doc_id % 8 <> 0")
    return proposals.evidence_findings(proposals.with_evidence(decided_diff(t), ev), correction_rows(t))


# One correction per event user, so that thresholds of many corrections are proposed at once.
LABELLED = """select concat('c', cast(user_id as string)) as correction_id, cast(event_id as string) as entry_tag, rule, c as certainty,
  case when rule = 'R1' then 'type_en' else 'human_review' end as destination_folder, 'type_en' as agreed_type, cast(null as string) as action,
  case when rule = 'R2' then case when c < cast(user_id % 10 as double)/10 then 'type_fr' else 'type_en' end when c < 0.9e0 + cast(user_id % 7 as double)/70 then 'type_fr' else 'type_en' end as folder
from (select user_id, event_id, case when event_type in ('view', 'click') then 'R1' else 'R2' end as rule,
  case when event_type in ('view', 'click') then 0.9e0 + cast((event_id * 37) % 101 as double)/1000 else cast((event_id * 37) % 101 as double)/100 end as c from events) x"""
THRESHOLD_SQL = f"""with l as (select *, folder <> destination_folder as moved from ({LABELLED}) y),
 n as (select correction_id, sum(case when rule = 'R1' then 1 else 0 end) as checked, sum(case when rule = 'R1' and moved then 1 else 0 end) as wrong,
   max(case when rule = 'R1' and moved then certainty end) as max_wrong, min(case when rule = 'R1' and not moved then certainty end) as min_correct from l group by correction_id)"""


def labelled_events(t: Inputs) -> tuple[DataFrame, DataFrame]:
    rows = t.sql(LABELLED)
    moved = F.col("folder") != F.col("destination_folder")
    rows = rows.withColumns({"facet": F.when(moved, "move").otherwise("confirmation"),
                             "kind": F.when(moved & (F.col("rule") == "R2"), "human_label").when(moved, "misfile")})
    bounds = rows.select("correction_id").distinct().withColumns({"threshold": F.lit(0.9), "minimum_filed": F.lit(15)})
    return rows, bounds


@query("propose_raise", THRESHOLD_SQL + " select correction_id, 'raise' as direction, min_correct as threshold, wrong as wrong_sent_to_review, 0 as correct_sent_to_review from n where checked >= 15 and wrong > 0 and max_wrong < min_correct and min_correct > 0.9e0")
def _(t: Inputs) -> DataFrame:
    rows, bounds = labelled_events(t)
    return proposals.propose_raise(proposals.filed_check(rows, bounds))


# The sweep as written: every candidate certainty is tried, the lowest without an error above it wins.
@query("propose_lower", THRESHOLD_SQL + """, r as (select l.* from l join n on n.correction_id = l.correction_id where n.checked >= 15 and l.rule = 'R2'),
 s as (select r.*, sum(case when folder <> agreed_type then 1 else 0 end) over (partition by correction_id order by certainty desc range unbounded preceding) as errors,
   sum(case when certainty < 0.9e0 then 1 else 0 end) over (partition by correction_id order by certainty desc range unbounded preceding) as affected from r),
 w as (select correction_id, min(certainty) as threshold from s where folder = agreed_type and certainty < 0.9e0 and errors = 0 group by correction_id)
select w.correction_id, 'lower' as direction, w.threshold, max(s.affected) as additional_automatic_labels, 0 as observed_errors from w join s on s.correction_id = w.correction_id and s.certainty = w.threshold group by w.correction_id, w.threshold""")
def _(t: Inputs) -> DataFrame:
    rows, bounds = labelled_events(t)
    return proposals.propose_lower(rows, proposals.filed_check(rows, bounds))


@query("threshold_evidence", INCLUDED_SQL + """ select correction_id, entry_tag, 'raise' as direction from i where included and facet in ('confirmation', 'move') and rule = 'R1'
union all select correction_id, entry_tag, 'lower' from i where included and facet = 'move' and rule = 'R2' and destination_folder = 'human_review' and (kind = 'human_label' or action = 'new_type')""")
def _(t: Inputs) -> DataFrame:
    return proposals.threshold_evidence(proposals.with_evidence(decided_diff(t), evidence(t)))


@query("candidate_examples", INCLUDED_SQL + " select correction_id, entry_tag, folder as type_id from i where included and is_type and facet in ('confirmation', 'move')")
def _(t: Inputs) -> DataFrame:
    return proposals.candidate_examples(proposals.with_evidence(decided_diff(t), evidence(t)), correction_rows(t)).select("correction_id", "entry_tag", "type_id")


@query("candidate_exclusions", INCLUDED_SQL + """ select correction_id, destination_folder as from_type, folder as to_type, count(*) as moves,
  concat('Do not use "Name ', destination_folder, '" when "Name ', folder, '" is the closer fit under this definition: "What ', folder, '".') as candidate
from i where included and facet = 'move' and is_type and destination_folder like 'type_%' group by correction_id, destination_folder, folder""")
def _(t: Inputs) -> DataFrame:
    types = t.sql("select distinct concat('type_', lang) as id from documents").select(
        F.lit("v1").alias("type_version"), "id", F.concat(F.lit("Name "), "id").alias("name"), F.concat(F.lit("What "), "id").alias("what"), F.lit("none").alias("not_for"))
    return proposals.candidate_exclusions(decided_diff(t), types, correction_rows(t)).select("correction_id", "from_type", "to_type", "moves", "candidate")


@query("candidate_exclusions_sentence", INCLUDED_SQL + """ select correction_id, destination_folder as from_type, folder as to_type, concat('Name ', folder, ' (What ', folder, ') comes before Name ', destination_folder) as candidate
from i where included and facet = 'move' and is_type and destination_folder like 'type_%' group by correction_id, destination_folder, folder""")
def _(t: Inputs) -> DataFrame:
    types = t.sql("select distinct concat('type_', lang) as id from documents").select(
        F.lit("v1").alias("type_version"), "id", F.concat(F.lit("Name "), "id").alias("name"), F.concat(F.lit("What "), "id").alias("what"), F.lit("none").alias("not_for"))
    found = proposals.candidate_exclusions(decided_diff(t), types, correction_rows(t), sentence="%2$s (%3$s) comes before %1$s")
    return found.select("correction_id", "from_type", "to_type", "candidate")


@query("new_type_stubs", DIFF_SQL + f""", a as ({DECISIONS}) select d.correction_id, d.folder, case d.folder when 'new_topic' then 'new_topic' else 'other_things' end as id, count(*) as files
from d join a on a.correction_id = d.correction_id and a.folder = d.folder and a.action = 'new_type' where not known group by d.correction_id, d.folder""")
def _(t: Inputs) -> DataFrame:
    return proposals.new_type_stubs(corrections.unknown_folders(diff(t)), t.sql(DECISIONS), correction_rows(t)).select("correction_id", "folder", "id", "files")


@query("new_type_examples", INCLUDED_SQL + """ select i.correction_id, i.folder, case when facet = 'move' then entry_tag end as tag, case when facet = 'move' then m.original_filename else filename end as title
from i left join v_manifest m on m.run_id = i.run_id and m.tag = i.entry_tag where not known and action = 'new_type'""")
def _(t: Inputs) -> DataFrame:
    return proposals.new_type_examples(decided_diff(t), evidence(t))


@query("proposal_evidence", """
select run_id, tag, case when failure is null then certainty end as certainty, case when rule = 'R2' and failure is null then choice end as agreed_type,
  case when doc_id % 4 = 0 and doc_id % 6 <> 0 and doc_id % 5 <> 0 then concat('Title ', original_filename) else original_filename end as title,
  not (doc_id % 4 = 0 and doc_id % 6 <> 0 and doc_id % 5 <> 0) as unavailable from v_manifest""")
def _(t: Inputs) -> DataFrame:
    m = t.view("v_manifest")
    key = F.concat_ws("/", "run_id", "fingerprint")
    docs = m.select("run_id", "tag", "fingerprint", "original_filename", "rule", key.alias("digest_key"))
    confidence = m.filter("failure is null").select("run_id", "fingerprint", "choice", "certainty")
    artifacts = m.select(key.alias("key"), (F.col("doc_id") % 6 == 0).alias("deleted"), (F.col("doc_id") % 5 == 0).alias("contains_text"))
    digests = m.select(key.alias("key"), F.when(F.col("doc_id") % 4 == 0, "named-fields-json-v1").otherwise("full-text-outline-v3").alias("policy"),
                       F.concat(F.lit("Title "), "original_filename").alias("title"), F.array("original_filename").alias("lines"))
    return proposals.proposal_evidence(docs, confidence, artifacts, digests).select("run_id", "tag", "certainty", "agreed_type", "title", "unavailable")


# Owner decisions come from the labels table; unusable ones are kept out of the reference and reported on their own.
OWNER = """select concat('c-', v.run_id) as correction_id, v.fingerprint, case when l.toxic = 1 then 'excluded' when l.quality = 1 then 'label' else 'ambiguous' end as status,
  case when l.toxic = 1 then '' when l.quality = 1 then v.true_type else concat(v.true_type, ',', case when v.true_type = 'type_en' then 'type_fr' else 'type_en' end) end as labels
from v_manifest v join labels l on l.doc_id = v.doc_id"""
GOOD_OWNER = OWNER + " where v.rule <> 'R0'"


def owner_decisions(t: Inputs, sql: str = GOOD_OWNER) -> DataFrame:
    return t.sql(sql).withColumn("labels", F.when(F.col("labels") == "", F.array().cast("array<string>")).otherwise(F.split("labels", ",")))


def reference(t: Inputs) -> DataFrame:
    source = t.view("v_manifest").select(F.concat(F.lit("c-"), "run_id").alias("correction_id"), "fingerprint", "destination_folder", "rule")
    reviewed = diff(t).filter("facet in ('confirmation', 'move')").select("correction_id", F.col("entry_fingerprint").alias("fingerprint"), "folder")
    runs = correction_rows(t)
    labels = runs.filter("run_id <> 'run3'").select("correction_id", F.lit("new_topic").alias("folder"), F.lit("type_es").alias("type_id"))
    ignored = runs.select("correction_id", F.lit("Other Things!").alias("folder"))
    return references.build_reference(source, reviewed, owner_decisions(t), labels, ignored, runs)


REFERENCE_SQL = DIFF_SQL + f""", o as ({GOOD_OWNER}), v as (select * from d where facet in ('confirmation', 'move')),
 r as (select concat('c-', m.run_id) as correction_id, m.run_id, m.fingerprint, m.destination_folder as previous_folder, m.rule as previous_rule, v.folder as corrected_folder,
   coalesce(v.folder <> m.destination_folder, false) as moved,
   case when m.rule = 'R0' then 'failure' when o.status is not null then o.status when v.folder = 'Other Things!' then 'excluded' when v.folder like 'type_%' or (v.folder = 'new_topic' and m.run_id <> 'run3') then 'label' else 'unconfirmed' end as status,
   case when m.rule = 'R0' then '' when o.status is not null then o.labels when v.folder = 'new_topic' and m.run_id <> 'run3' then 'type_es' when v.folder like 'type_%' then v.folder else '' end as labels
   from v_manifest m left join v on v.run_id = m.run_id and v.entry_tag = m.tag left join o on o.correction_id = concat('c-', m.run_id) and o.fingerprint = m.fingerprint)"""


@query("build_reference", REFERENCE_SQL + " select correction_id, fingerprint, previous_folder, previous_rule, corrected_folder, moved, status, labels from r")
def _(t: Inputs) -> DataFrame:
    return reference(t).withColumn("labels", F.array_join("labels", ","))


@query("label_decision_findings", f"""with o as ({OWNER}) select o.correction_id, o.fingerprint, case when o.labels = 'type_de' then 'invalid_labels' when m.rule = 'R0' then 'failure_override' end as problem
from o join v_manifest m on concat('c-', m.run_id) = o.correction_id and m.fingerprint = o.fingerprint where m.rule = 'R0' or o.labels = 'type_de'""")
def _(t: Inputs) -> DataFrame:
    # here the German type is no longer defined
    source = t.view("v_manifest").select(F.concat(F.lit("c-"), "run_id").alias("correction_id"), "fingerprint", "rule")
    runs = correction_rows(t).withColumn("type_ids", F.array_remove("type_ids", "type_de"))
    found = references.label_decision_findings(owner_decisions(t, OWNER).withColumn(
        "labels", F.when(F.col("status") == "ambiguous", F.array(F.lit("type_en"), F.lit("type_fr"))).otherwise(F.col("labels"))), source, runs)
    return found


COMPARE_SQL = REFERENCE_SQL + """, x as (select r.*, n.rule as actual_rule, n.destination_folder as actual_folder, n.fingerprint is not null as present from r left join v_next_run n on n.run_id = r.run_id and n.fingerprint = r.fingerprint),
 y as (select x.*, case when status = 'failure' then 'sourceFailures' when status <> 'label' then status when not present then 'missing' when actual_rule is null then 'pending' when actual_rule = 'R0' then 'failures' end as reason from x),
 z as (select y.*, reason is null and coalesce(actual_folder = labels, false) as matches, reason is null and coalesce(actual_rule = 'R1' and actual_folder = previous_folder, false) as same from y)"""


def next_run(t: Inputs) -> DataFrame:
    return t.view("v_next_run").select(F.concat(F.lit("c-"), "run_id").alias("correction_id"), "fingerprint", "rule", "destination_folder")


@query("comparison_details", COMPARE_SQL + " select correction_id, fingerprint, reason, matches, same from z")
def _(t: Inputs) -> DataFrame:
    return references.comparison_details(reference(t), next_run(t), ["correction_id", "fingerprint"]).select("correction_id", "fingerprint", "reason", "matches", "same")


def _counts_sql() -> str:
    cols = ["count(*) as source_total"]
    for name, inside in (("moved", "moved"), ("filed", "previous_rule = 'R1'")):
        cols += [f"count(*) filter ({inside}) as {name}_total", f"count(*) filter ({inside} and reason is null) as {name}_comparable", f"count(*) filter ({inside} and matches) as {name}_matched"]
        cols += [f"count(*) filter ({inside} and reason = '{r}') as {name}_{r}" for r in references.REASONS]
    cols.append("count(*) filter (previous_rule = 'R1' and same) as filed_same")
    cols += ["count(*) filter (not present) as missing", "count(*) filter (present and actual_rule is null) as pending", "count(*) filter (actual_rule = 'R0') as failures"]
    cols += [f"count(*) filter (status = '{s}') as {n}" for s, n in (("ambiguous", "ambiguous"), ("excluded", "excluded"), ("unconfirmed", "unconfirmed"), ("failure", "source_failures"))]
    return (COMPARE_SQL + f", g as (select correction_id, {', '.join(cols)} from z group by correction_id), "
            "t as (select concat('c-', run_id) as correction_id, count(*) as next_total, count(*) filter (not exists (select 1 from v_ids i where i.run_id = n.run_id and i.fingerprint = n.fingerprint)) as new_documents from v_next_run n group by run_id) "
            "select g.*, t.next_total, t.new_documents from g join t on t.correction_id = g.correction_id")


@query("compare_reference", _counts_sql())
def _(t: Inputs) -> DataFrame:
    keys = ["correction_id", "fingerprint"]
    ref, following = cut(reference(t), "reference"), next_run(t)
    return references.compare_reference(references.comparison_details(ref, following, keys), ref, following, ["correction_id"], keys)


@query("apply_findings", """
select o_orderkey, case when o_orderstatus = 'P' then 'no_such_correction' when o_orderkey % 5 = 0 then 'different_definition' when o_orderkey % 3 = 0 then 'not_the_stored_proposal' end as finding from orders""")
def _(t: Inputs) -> DataFrame:
    o = t.table("orders")
    t1 = F.col("o_orderkey") % 100 / 100
    applications = o.select("o_orderkey", F.col("o_orderkey").alias("correction_id"), F.lit("raise").alias("direction"), t1.alias("threshold"),
                            F.when(F.col("o_orderkey") % 5 == 0, "rev-old").otherwise("rev-1").alias("active_revision_id"))
    proposed = o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("correction_id"), F.lit("raise").alias("direction"),
                                                      F.when(F.col("o_orderkey") % 3 == 0, t1 + 1).otherwise(t1).alias("threshold"))
    known = o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("correction_id"), F.lit("rev-1").alias("definition_revision_id"))
    return references.apply_findings(applications, proposed, known).select("o_orderkey", "finding")


@query("threshold_timeline", """
with h as (select o_custkey as project_id, o_orderkey, MS(o_orderdate) as created_at, cast(o_orderkey % 100 as double)/100 as threshold from orders),
 n as (select h.*, row_number() over (partition by project_id order by created_at desc, o_orderkey desc) as n from h where created_at <= 946684800000)
select p.project_id, coalesce(n.threshold, 0.9e0) as threshold, coalesce(cast(n.o_orderkey as varchar), 'initial_design_threshold') as justification
from (select distinct project_id from h) p left join n on n.project_id = p.project_id and n.n = 1""")
def _(t: Inputs) -> DataFrame:
    h = t.table("orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("history_id"), F.col("o_orderkey").alias("correction_id"),
                                 F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_at"), (F.col("o_orderkey") % 100 / 100).alias("threshold"))
    return references.threshold_in_force(h, 0.9, ["project_id"], F.lit(946684800000))
