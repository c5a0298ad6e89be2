"""The registered queries of the corpus operators: thin calls over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chains, chat, decontaminate, exact, importance, langid, minhash, packing, phrases, pii, tokenfiles, toxicity, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.encode_round_trip(table(spark, sf_dir, "documents"))


@query
def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op3_exact_dedup"] = """
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
       doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256 from t"""


@query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_substring_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_revisits(table(spark, sf_dir, "pages"))


@query
def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key="pseudonyms of the registered query")


@query
def op10_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_conversations(table(spark, sf_dir, "conversations"))


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


SQL["op11_phrase_collocations"] = """
with w as (select doc, coalesce(lang, 'und') as lang, piece, unnest(words) as word, generate_subscripts(words, 1) as i from (
    select doc, lang, generate_subscripts(pieces, 1) as piece, regexp_extract_all(unnest(pieces), '[^\\x20\\x09]+') as words from (
      select row_number() over () as doc, lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') as pieces from documents))),
 s as (select lang, word as w1, lead(word) over o as w2, lead(word, 2) over o as w3 from w window o as (partition by doc, piece order by i)),
 n1 as (select lang, w1, count(*) as f from s group by all),
 n2 as (select lang, w1, w2, count(*) as f from s where w2 is not null group by all),
 n3 as (select lang, w1, w2, w3, count(*) as f from s where w3 is not null group by all having count(*) >= 10),
 inside as (select lang, w1, w2, max(f) as f from (select lang, w1, w2, f from n3 union all select lang, w2, w3, f from n3) group by all),
 cuts as (
   select c.lang, concat_ws(' ', c.w1, c.w2) as phrase, 1 as k, c.f as a, l.f as l, r.f as r from n2 c join n1 l on l.lang = c.lang and l.w1 = c.w1 join n1 r on r.lang = c.lang and r.w1 = c.w2
     left join inside i on i.lang = c.lang and i.w1 = c.w1 and i.w2 = c.w2 where c.f >= 10 and (i.f is null or 100 * i.f < 50 * c.f)
   union all select c.lang, concat_ws(' ', c.w1, c.w2, c.w3), 1, c.f, l.f, r.f from n3 c join n1 l on l.lang = c.lang and l.w1 = c.w1 join n2 r on r.lang = c.lang and r.w1 = c.w2 and r.w2 = c.w3
   union all select c.lang, concat_ws(' ', c.w1, c.w2, c.w3), 2, c.f, l.f, r.f from n3 c join n2 l on l.lang = c.lang and l.w1 = c.w1 and l.w2 = c.w2 join n1 r on r.lang = c.lang and r.w1 = c.w3),
 scored as (select *, cast(1000000::hugeint * a * a // (l::hugeint * r) as bigint) as score from cuts),
 best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
 ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select ranked.lang, rank, phrase, a, l, r, n, score from ranked join (select lang, cast(sum(f) as bigint) as n from n1 group by lang) t on t.lang = ranked.lang where rank <= 2000"""


@query
def op12_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op13_importance_resampling"] = """
with recursive bits as (select i::bigint as i, i::bigint as c, 0 as step from range(256) t(i)
   union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, step + 1 from bits where step < 8),
 crc as (select list(c order by i) as t from bits where step = 8),
 raw as (select 'd' as kind, row_number() over () as doc, doc_id, text from documents union all select 'b', row_number() over (), null, text from benchmark),
 w as (select kind, doc, unnest(words) as word, generate_subscripts(words, 1) as i from (
   select kind, doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from raw)),
 f as (select kind, doc, word as feature, 1 as size from w union all select kind, doc, concat(word, ' ', next), 2 from (select *, lead(word) over (partition by kind, doc order by i) as next from w) where next is not null),
 hashed as (select feature, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(h) // 2 + 1), lambda k: ('0x' || substr(h, 2 * k - 1, 2))::bigint)),
     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) % 10000 as bucket
   from (select feature, hex(encode(feature)) as h from (select distinct feature from f)), crc),
 g as (select f.kind, f.doc, f.size, h.bucket from f join hashed h using (feature)),
 counts as (select bucket, count(*) filter (kind = 'd') as s, count(*) filter (kind = 'b') as t from g group by bucket),
 totals as (select coalesce(sum(s), 0) as s, coalesce(sum(t), 0) as t from counts),
 gain as (select bucket, cast(floor(1000 * ln((c.t + 1)::double * (a.s + 10000)::double / ((c.s + 1)::double * (a.t + 10000)::double))) as bigint) as gain from counts c, totals a),
 per as (select doc, count(*) as n, count(*) filter (size = 1) as words, sum(gain) as total from g join gain using (bucket) where kind = 'd' group by doc),
 scored as (select r.doc_id, coalesce(n, 0) as n_features, coalesce(words, 0) as n_words, coalesce(cast(floor(total::bigint / n) as bigint), 0) as weight,
     cast(floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(r.doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double))) as bigint) as noise
   from raw r left join per p on p.doc = r.doc where r.kind = 'd'),
 ranked as (select *, weight + noise as score, row_number() over (partition by n_words >= 20 order by weight + noise desc, doc_id nulls last) as place, count(*) over (partition by n_words >= 20) as able from scored)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 25 * able // 100 then place end as rank, n_words from ranked"""
