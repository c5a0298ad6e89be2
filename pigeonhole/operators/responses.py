"""Strict reading of recorded model responses.

Each decoder adds a ``finding`` struct (null when the response is good) and typed outputs. Text is parsed to a
variant once, and every type is tested before it is cast, so a quoted number never passes for a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pigeonhole import constants as k
from pigeonhole.functions import checks, json as js
from pigeonhole.functions.arrays import has_duplicates, same_set
from pigeonhole.functions.text import blank, canonical_evidence, evidence_policy
from pigeonhole.operators.models import check_model_policy

NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$"
VERDICT_KEYS = ["type_id", "is_type", "rationale", "evidence", "closest_alternative"]
VERDICT_TYPE = "array<struct<type_id:string,is_type:boolean,rationale:string,evidence:array<string>,closest_alternative:string>>"


def _strings(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _is_number(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(NUMBER), F.lit(False))


def _document(code: str, detail: str, must_hold: Column) -> checks.Rule:
    return (code, checks.DOCUMENT, detail, must_hold)


def _model_finding(v: Column, role: str) -> Column:
    named = F.when(js.is_string(v, "$.model"), F.try_variant_get(v, "$.model", "string"))
    return js.let(named, lambda m: check_model_policy(F.col("pin"), F.col("pin_policy"), F.lit(role), m))


def number_map(v: Column) -> Column:
    """``map<string,double>`` from an object whose values are all numbers; other values become null."""
    entries = F.try_variant_get(v, "$", "map<string,variant>")
    return F.transform_values(entries, lambda _, x: F.when(_is_number(x), F.try_variant_get(x, "$", "double")))


def confidence_rules(choice: Column, certainty: Column, probabilities: Column, nouls: Column, type_ids: Column) -> list[checks.Rule]:
    """Shape rules of a normalised confidence answer, in order. Null map values count as non-numbers."""
    code = k.SCHEMA_CODE[k.CONFIDENCE]
    choices = F.array_append(type_ids, F.lit(k.NONE_OPTION))
    # summed in the stored order of the object
    total = F.aggregate(F.map_values(probabilities), F.lit(0.0), lambda a, x: a + x)
    return [
        _document(code, "choice must be a defined option", F.array_contains(choices, choice)),
        _document(code, "certainty must be between zero and one", checks.unit(certainty)),
        _document(code, "probabilities must cover the options", same_set(F.map_keys(probabilities), choices)),
        _document(code, "probabilities must be between zero and one", F.forall(F.map_values(probabilities), checks.unit)),
        _document(code, "probabilities must sum to one", total.between(0.98, 1.02)),
        _document(code, "scores must cover the types", same_set(F.map_keys(nouls), type_ids)),
        _document(code, "scores must be between zero and one", F.forall(F.map_values(nouls), checks.unit)),
    ]


def validate_confidence(rows: DataFrame) -> DataFrame:
    """Checks a normalised answer: model, choice, probabilities, certainty, nouls against type_ids and pin."""
    code = k.SCHEMA_CODE[k.CONFIDENCE]
    configured = (F.length(F.trim("pin")) > 0) & (F.size("type_ids") > 0) & ~has_duplicates(F.col("type_ids")) & ~F.array_contains("type_ids", k.NONE_OPTION)
    rules = [
        ("E_VALIDATOR_CONFIGURATION", checks.BLOCKER, "a pin and unique types are required", configured),
        _document(code, "the response must name its model", F.length("model") > 0),
        (k.DRIFT_CODE[k.CONFIDENCE], checks.BLOCKER, "returned model differs from the pin", F.col("model") == F.col("pin")),
        *confidence_rules(F.col("choice"), F.col("certainty"), F.col("probabilities"), F.col("nouls"), F.col("type_ids")),
    ]
    return rows.withColumn("finding", checks.first_finding(rules))


def _text(v: Column, path: str) -> Column:
    return F.when(js.is_string(v, path), F.try_variant_get(v, path, "string"))


def _number(v: Column, path: str) -> Column:
    return F.when(_is_number(F.try_variant_get(v, path, "variant")), F.try_variant_get(v, path, "double"))


def decode_confidence(responses: DataFrame) -> DataFrame:
    """Raw answer bodies to ``choice, certainty, probabilities, noul`` plus ``finding``.

    Input: body, pin, pin_policy, type_ids (and any key columns).
    """
    code, ids, base = k.SCHEMA_CODE[k.CONFIDENCE], F.col("type_ids"), "$.answers.classification"
    question = lambda i: F.concat(F.lit("is_"), i)
    tagged = lambda x, tag: F.coalesce(_text(x, "$.type") == tag, F.lit(False))

    def read(v: Column, answers: Column) -> Column:
        values = F.struct(
            _text(v, f"{base}.choice").alias("choice"), _number(v, f"{base}.confidence").alias("certainty"),
            number_map(F.try_variant_get(v, f"{base}.probabilities", "variant")).alias("probabilities"),
            F.map_from_arrays(ids, F.transform(ids, lambda i: _number(F.try_element_at(answers, question(i)), "$.noul"))).alias("noul"))
        first = checks.first_finding([_document(code, "the response must be an object", js.is_object(v))])

        def judged(o: Column) -> Column:
            rest = checks.first_finding([
                _document(code, "answers must match every question", same_set(
                    F.map_keys(answers), F.array_prepend(F.transform(ids, question), F.lit("classification")))),
                _document(code, "the classification must be a choice", tagged(F.try_variant_get(v, base, "variant"), "choice")),
                _document(code, "each type answer must be a score", F.forall(ids, lambda i: tagged(F.try_element_at(answers, question(i)), "noul"))),
                *confidence_rules(o["choice"], o["certainty"], o["probabilities"], o["noul"], ids),
            ])
            return F.struct(o.alias("o"), F.coalesce(first, _model_finding(v, k.CONFIDENCE), rest).alias("finding"))
        return js.let(values, judged)

    result = js.let(js.parse(F.col("body")), lambda v: js.let(F.try_variant_get(v, "$.answers", "map<string,variant>"), lambda a: read(v, a)))
    kept = [c for c in responses.columns if c not in ("choice", "certainty", "probabilities", "noul")]
    return responses.withColumn("_r", result).select(*kept, "_r.o.*", "_r.finding")


def structured_output(body: Column, role: str) -> Column:
    """Struct ``(value, finding)``: the single JSON object inside a response body, or why there is none."""
    code = k.SCHEMA_CODE[role]
    message = lambda i: F.coalesce((_text(i, "$.type") == "message") & (_text(i, "$.role") == "assistant")
                                   & (_text(i, "$.status") == "completed") & js.is_array(i, "$.content"), F.lit(False))
    spoken = lambda c: F.coalesce((_text(c, "$.type") == "output_text") & js.is_string(c, "$.text"), F.lit(False))
    none = F.array().cast("array<variant>")

    def judged(v: Column, items: Column, contents: Column, value: Column) -> Column:
        first = checks.first_finding([_document(code, "the response must be an object", js.is_object(v))])
        rest = checks.first_finding([
            _document(code, "the response is not complete", (_text(v, "$.status") == "completed") & js.is_null(v, "$.error")),
            _document(code, "the response has no output items", js.is_array(v, "$.output")),
            _document(code, "unexpected output item", F.forall(items, message)),
            _document(code, "refused or non-text output", F.forall(contents, spoken)),
            _document(code, "exactly one output text is expected", F.size(contents) == 1),
            _document(code, "the output is not a JSON object", js.is_object(value)),
        ])
        return F.struct(value.alias("value"), F.coalesce(first, _model_finding(v, role), rest).alias("finding"))

    def read(v: Column) -> Column:
        items = F.filter(F.try_variant_get(v, "$.output", "array<variant>"), lambda i: ~F.coalesce(_text(i, "$.type") == "reasoning", F.lit(False)))
        return js.let(items, lambda it: js.let(
            F.flatten(F.transform(it, lambda i: F.coalesce(F.try_variant_get(i, "$.content", "array<variant>"), none))),
            lambda c: js.let(js.parse(_text(F.try_element_at(c, F.lit(1)), "$.text")), lambda value: judged(v, it, c, value))))

    return js.let(js.parse(body), read)


def quotes_found(verdicts: Column, text: Column, policy: Column) -> Column:
    """Every quote of every verdict occurs in the text. The text is canonicalised once per row, not per quote."""
    exact = evidence_policy(policy) == k.EVIDENCE_EXACT
    source = F.when(exact, text).otherwise(canonical_evidence(text))
    quotes = F.flatten(F.transform(verdicts, lambda v: F.coalesce(v["evidence"], F.array().cast("array<string>"))))
    quotes = F.when(exact, quotes).otherwise(F.transform(quotes, canonical_evidence))
    bound = F.array(F.struct(source.alias("t"), quotes.alias("q")))
    return F.element_at(F.transform(bound, lambda b: F.forall(b["q"], lambda q: (F.length(q) > 0) & F.contains(b["t"], q))), 1)


def reader_rules(raw: Column, verdicts: Column, type_ids: Column, text: Column, policy: Column) -> list[checks.Rule]:
    """Shape rules of reader verdicts. ``raw``: array of variants, ``verdicts``: the same typed."""
    code = k.SCHEMA_CODE[k.READER]
    ids = F.transform(verdicts, lambda v: v["type_id"])
    every = lambda test: F.forall(raw, lambda v: F.coalesce(test(v), F.lit(False)))
    string_array = lambda v: (F.try_variant_get(v, "$.evidence", "variant").isNotNull()
                              & js.kind(v, "$.evidence").isin("ARRAY<STRING>", "ARRAY<VOID>", "ARRAY<NULL>"))
    return [
        _document(code, "one verdict per type is required", F.size(raw) == F.size(type_ids)),
        _document(code, "a verdict has missing or unexpected fields", every(lambda v: js.exact_keys(v, _strings(VERDICT_KEYS)))),
        _document(code, "verdicts must cover each type once", every(lambda v: js.is_string(v, "$.type_id")) & same_set(ids, type_ids)),
        _document(code, "the answer must be a boolean", every(lambda v: js.kind(v, "$.is_type") == "BOOLEAN")),
        _document(code, "a rationale is required", every(lambda v: js.is_string(v, "$.rationale")) & F.forall(verdicts, lambda v: ~blank(v["rationale"]))),
        _document(code, "the alternative must be a type or null", every(
            lambda v: js.is_null(v, "$.closest_alternative") | (js.is_string(v, "$.closest_alternative")
            & F.array_contains(type_ids, F.try_variant_get(v, "$.closest_alternative", "string"))))),
        _document(code, "at most three quotes are allowed", every(string_array) & F.forall(verdicts, lambda v: F.size(v["evidence"]) <= 3)),
        _document(code, "quotes must be nonempty", F.forall(verdicts, lambda v: F.forall(v["evidence"], lambda q: q.isNotNull() & (F.length(q) > 0)))),
        _document(code, "each quote must occur in the text", quotes_found(verdicts, text, policy)),
    ]


def decode_reader(responses: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """Raw reader bodies to typed ``verdicts`` plus ``finding``; quotes are checked against the joined text.

    ``responses``: keys, body, pin, pin_policy, type_ids, evidence_policy. ``docs``: keys, text. Both sides are keyed
    by document, so storing them bucketed on the keys makes this join shuffle-free.
    """
    code = k.SCHEMA_CODE[k.READER]

    def judged(s: Column, raw: Column, verdicts: Column) -> Column:
        shape = checks.first_finding([
            _document(code, "unexpected fields in the output", js.exact_keys(s["value"], _strings(["verdicts"]))),
            _document(code, "verdicts must be an array", js.is_array(s["value"], "$.verdicts")),
            *reader_rules(raw, verdicts, F.col("type_ids"), F.col("text"), F.col("evidence_policy")),
        ])
        return F.struct(verdicts.alias("verdicts"), F.coalesce(s["finding"], shape).alias("finding"))

    result = js.let(structured_output(F.col("body"), k.READER), lambda s: js.let(
        F.try_variant_get(s["value"], "$.verdicts", "array<variant>"), lambda raw: js.let(
            F.try_variant_get(s["value"], "$.verdicts", VERDICT_TYPE), lambda verdicts: judged(s, raw, verdicts))))
    rows = responses.join(docs.select(*keys, "text"), keys).withColumn("_r", result)
    return rows.select(*responses.columns, "_r.verdicts", "_r.finding")


def decode_recovery(responses: DataFrame) -> DataFrame:
    """Raw recovery bodies to ``headings`` (array of strings) plus ``finding``."""
    def judged(s: Column) -> Column:
        shape = checks.first_finding([_document(
            k.SCHEMA_CODE[k.RECOVERY], "the output must contain only heading strings",
            js.exact_keys(s["value"], _strings(["headings"]))
            & F.coalesce(js.kind(s["value"], "$.headings").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False)))])
        return F.struct(F.try_variant_get(s["value"], "$.headings", "array<string>").alias("headings"),
                        F.coalesce(s["finding"], shape).alias("finding"))
    rows = responses.withColumn("_r", js.let(structured_output(F.col("body"), k.RECOVERY), judged))
    return rows.select(*responses.columns, "_r.headings", "_r.finding")


def decode_by_role(responses: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """The decoder named by the ``role`` column, as one table of findings."""
    role = lambda name: responses.filter(F.col("role") == name)
    parts = [decode_confidence(role(k.CONFIDENCE)), decode_reader(role(k.READER), docs, keys), decode_recovery(role(k.RECOVERY))]
    first, *rest = [p.select(*keys, "role", "finding") for p in parts]
    for part in rest:
        first = first.unionByName(part)
    return first


def explode_evidence(reader: DataFrame, keys: list[str]) -> DataFrame:
    """One row per quote with its verdict and quote index; order and repeats are kept."""
    verdicts = reader.select(*keys, "artifact_key", F.posexplode("verdicts").alias("verdict_index", "v"))
    return verdicts.select(*keys, "artifact_key", "verdict_index", F.col("v.type_id").alias("type_id"),
                           F.col("v.is_type").alias("is_type"), F.posexplode("v.evidence").alias("quote_index", "quote"))
