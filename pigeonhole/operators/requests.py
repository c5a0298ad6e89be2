"""Request bodies. Everything shared by a pack is built once per pack; a document only adds its state or text.

Prompt texts belong to the pack and are passed in; none is built in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pigeonhole import constants as k
from pigeonhole.functions.arrays import same_set
from pigeonhole.operators.models import pin_valid
from pigeonhole.operators.states import json_text


def json_string(c: Column) -> Column:
    """One JSON string literal."""
    boxed = json_text(F.array(c))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def type_json(types: DataFrame) -> DataFrame:
    """Adds ``json``: one type as stored (id, name, what, not_for, examples)."""
    return types.withColumn("json", json_text(F.struct("id", "name", "what", "not_for", "examples")))


def _per_pack(types: DataFrame, pack_key: str) -> DataFrame:
    """Types of a pack in file order, as arrays. A pack holds at most a few hundred types."""
    listed = type_json(types).groupBy(pack_key).agg(F.array_sort(F.collect_list(F.struct("position", "id", "json"))).alias("_t"))
    return listed.select(pack_key, F.transform("_t", lambda t: t["id"]).alias("ids"), F.transform("_t", lambda t: t["json"]).alias("jsons"))


SHARES = 256  # of all packs together


def _with_parts(rows: DataFrame, parts: DataFrame, pack_key: str) -> DataFrame:
    """Rows with the parts of their pack. Where packs are few, each one's rows are dealt into shares with a copy of its parts,
    so the texts of a pack never meet in one task."""
    shares = max(SHARES // max(parts.select(pack_key).limit(SHARES).count(), 1), 1)
    plain = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    dealt = rows.withColumn("_share", F.pmod(F.xxhash64(*plain), F.lit(shares)))
    return dealt.join(parts.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shares - 1).cast("bigint")))), [pack_key, "_share"]).drop("_share")


def confidence_questions(types: DataFrame, packs: DataFrame, pack_key: str) -> DataFrame:
    """Per pack the question text for complete-text states and for sectioned states.

    ``packs``: pack key, none_json and the prompts ``choice_full, score_full, choice_sections, score_sections, score_false``.
    """
    rows = _per_pack(types, pack_key).join(packs, pack_key)
    pairs = F.zip_with("ids", "jsons", lambda i, j: F.struct(i.alias("i"), j.alias("j")))
    criteria = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(json_string(p["i"]), F.lit(":"), p["j"])), ","),
                        F.lit(f',"{k.NONE_OPTION}":'), "none_json", F.lit("}"))

    def questions(choice: str, score: str) -> Column:
        one = lambda p: F.concat(F.lit('"is_'), p["i"], F.lit('":{"type":"noul","instructions":{"question":'), json_string(F.col(score)), F.lit(',"definition":'), p["j"],
                                 F.lit('},"criteria":{"true":'), p["j"], F.lit(',"false":'), json_string(F.col("score_false")), F.lit("}}"))
        return F.concat(F.lit('{"classification":{"type":"choice","instructions":'), json_string(F.col(choice)), F.lit(',"criteria":'), criteria, F.lit("},"),
                        F.array_join(F.transform(pairs, one), ","), F.lit("}"))
    return rows.select(pack_key, questions("choice_full", "score_full").alias("questions_full"), questions("choice_sections", "score_sections").alias("questions_sections"))


def build_confidence_requests(states: DataFrame, types: DataFrame, packs: DataFrame, pack_key: str) -> DataFrame:
    """Adds ``body`` and ``code`` to serialised states; the state text goes in unchanged.

    The wording follows the state's own named fields; a state without its exact fields is ``E_DIGEST_STATE``.
    ``states``: pack key, serialized. ``packs`` also carries ``confidence_pin, confidence_policy``.
    """
    parts = confidence_questions(types, packs, pack_key).join(packs.select(pack_key, "confidence_pin", "confidence_policy"), pack_key)
    rows = _with_parts(states, parts, pack_key)
    names = F.json_object_keys("serialized")
    fields = lambda *n: same_set(F.col("_keys"), F.array(*[F.lit(x) for x in n]))
    compact = fields("fullText", "title", "headings", "tables")
    sectioned = fields("title", "headings", "tables", "sections") | fields("fullText", "title", "headings", "tables", "sections")
    rows = rows.withColumn("_keys", names).withColumn("code", F.when(
        ~pin_valid(F.col("confidence_pin"), F.col("confidence_policy"), F.lit(k.CONFIDENCE)), "E_MODEL_POLICY").when(
        ~F.coalesce(compact | sectioned, F.lit(False)), "E_DIGEST_STATE"))
    body = F.concat(F.lit('{"model":'), json_string(F.col("confidence_pin")), F.lit(',"state":'), "serialized", F.lit(',"questions":'),
                    F.when(compact, F.col("questions_full")).otherwise(F.col("questions_sections")), F.lit("}"))
    return rows.withColumn("body", F.when(F.col("code").isNull(), body)).drop("_keys", "questions_full", "questions_sections", "confidence_pin", "confidence_policy")


def _response_parts(prompt: Column, name: str, schema: Column, pin: str, effort: str, cap: str) -> tuple[Column, Column]:
    """Head and tail of a reader-family body; the document text goes between them."""
    head = F.concat(F.lit('{"model":'), json_string(F.col(pin)), F.lit(',"reasoning":{"effort":'), json_string(F.col(effort)), F.lit('},"max_output_tokens":'),
                    F.col(cap).cast("string"), F.lit(',"store":false,"truncation":"disabled","prompt_cache_options":{"mode":"explicit"},"input":[{"role":"system","content":'),
                    json_string(prompt), F.lit('},{"role":"user","content":'))
    tail = F.concat(F.lit('}],"text":{"format":{"type":"json_schema","name":"' + name + '","strict":true,"schema":'), schema, F.lit("}}}"))
    return head, tail


def _configuration(effort: str, cap: str, pin: str, policy: str, role: str) -> Column:
    return (F.when(~pin_valid(F.col(pin), F.col(policy), F.lit(role)), "E_MODEL_POLICY")
            .when(~F.coalesce((F.col(cap) >= 1) & F.col(effort).isin(k.EFFORTS), F.lit(False)), "E_READER_CONFIGURATION"))


def reader_parts(types: DataFrame, packs: DataFrame, pack_key: str) -> DataFrame:
    """Per pack the fixed parts of a reader body.

    ``packs``: pack key, none_json, reader_prompt, reader_pin, reader_policy, effort, reader_cap.
    """
    rows = _per_pack(types, pack_key).join(packs, pack_key)
    ids = F.concat(F.lit("["), F.array_join(F.transform("ids", json_string), ","), F.lit("]"))
    or_null = F.concat(F.lit("["), F.array_join(F.transform("ids", json_string), ","), F.lit(",null]"))
    n = F.size("ids").cast("string")
    schema = F.concat(
        F.lit('{"type":"object","additionalProperties":false,"required":["verdicts"],"properties":{"verdicts":{"type":"array","minItems":'), n, F.lit(',"maxItems":'), n,
        F.lit(',"items":{"type":"object","additionalProperties":false,"required":["type_id","is_type","rationale","evidence","closest_alternative"],"properties":{"type_id":{"type":"string","enum":'), ids,
        F.lit('},"is_type":{"type":"boolean"},"rationale":{"type":"string"},"evidence":{"type":"array","maxItems":3,"items":{"type":"string"}},"closest_alternative":{"type":["string","null"],"enum":'),
        or_null, F.lit("}}}}}}"))
    type_file = F.concat(F.lit('{"types":['), F.array_join("jsons", ","), F.lit('],"none_of_these":'), "none_json", F.lit("}"))
    rows = rows.withColumns({"_schema": schema, "_file": type_file})
    prompt = F.concat("reader_prompt", F.lit("\nOutput schema:\n"), "_schema", F.lit("\nType definitions:\n"), "_file")
    head, tail = _response_parts(prompt, "document_type_verdicts", F.col("_schema"), "reader_pin", "effort", "reader_cap")
    code = _configuration("effort", "reader_cap", "reader_pin", "reader_policy", k.READER)
    return rows.select(pack_key, head.alias("_head"), tail.alias("_tail"), code.alias("code"))


def build_reader_requests(docs: DataFrame, types: DataFrame, packs: DataFrame, pack_key: str, text: str = "full_text") -> DataFrame:
    """Adds ``body`` and ``code``: prompt, schema and type file of the pack, then the complete text."""
    rows = _with_parts(docs, reader_parts(types, packs, pack_key), pack_key)
    body = F.concat("_head", json_string(F.col(text)), "_tail")
    return rows.withColumn("body", F.when(F.col("code").isNull(), body)).drop("_head", "_tail")


def build_recovery_requests(docs: DataFrame, packs: DataFrame, pack_key: str, text: str = "full_text") -> DataFrame:
    """Bodies for documents that need an outline, and only for those."""
    schema = F.lit('{"type":"object","additionalProperties":false,"required":["headings"],"properties":{"headings":{"type":"array","items":{"type":"string"}}}}')
    prompt = F.concat("recovery_prompt", F.lit("\nOutput schema:\n"), schema)
    head, tail = _response_parts(prompt, "document_headings", schema, "recovery_pin", "effort", "recovery_cap")
    parts = packs.select(pack_key, head.alias("_head"), tail.alias("_tail"), _configuration("effort", "recovery_cap", "recovery_pin", "recovery_policy", k.RECOVERY).alias("code"))
    rows = _with_parts(docs.filter("needs_outline_recovery"), parts, pack_key)
    return rows.withColumn("body", F.when(F.col("code").isNull(), F.concat("_head", json_string(F.col(text)), "_tail"))).drop("_head", "_tail")


def batch_line(custom_id: Column, body: Column) -> Column:
    """One JSONL request line; the body is copied byte for byte."""
    return F.concat(F.lit('{"custom_id":'), json_string(custom_id), F.lit(',"method":"POST","url":"/v1/responses","body":'), body, F.lit("}"))
