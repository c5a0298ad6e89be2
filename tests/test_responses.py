import json

import pytest
from pyspark.sql import functions as F

from pigeonhole.functions import json as js
from pigeonhole.operators import attempts, correlation, responses

IDS = ["type_a", "type_b"]


def confidence(**change):
    a = {"classification": {"type": "choice", "choice": "type_a", "probabilities": {"type_a": 0.8, "type_b": 0.1, "none_of_these": 0.1}, "confidence": 0.9},
         "is_type_a": {"type": "noul", "noul": 0.7}, "is_type_b": {"type": "noul", "noul": 0.1}}
    a["classification"].update(change)
    return {"model": "jev-1.2.3", "answers": a}


def run_confidence(spark, bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string").withColumns({
        "pin": F.lit("jev-1.2.3"), "pin_policy": F.lit("versioned"), "type_ids": F.array(*[F.lit(i) for i in IDS])})
    return [r["code"] for r in responses.decode_confidence(df).orderBy("id").select("finding.code").collect()]


def test_confidence_shapes(spark):
    p = lambda a, b, n: {"type_a": a, "type_b": b, "none_of_these": n}
    drifted = {**confidence(), "model": "jev-1.2.4"}
    extra = confidence()
    extra["answers"]["is_type_c"] = {"type": "noul", "noul": 0}
    text = json.dumps(confidence())
    cases = [
        (text, None), (json.dumps(confidence(probabilities=p(0.5, 0.25, 0.23))), None), (json.dumps(confidence(probabilities=p(0.5, 0.25, 0.27))), None),
        (json.dumps(confidence(probabilities=p(0.5, 0.25, 0.2299))), "E_JEV_SCHEMA"), (json.dumps(confidence(probabilities=p(0.5, 0.25, 0.2701))), "E_JEV_SCHEMA"),
        (json.dumps(confidence(probabilities={"type_a": 1})), "E_JEV_SCHEMA"), (json.dumps(confidence(confidence="0.9")), "E_JEV_SCHEMA"), (json.dumps(confidence(confidence=1.01)), "E_JEV_SCHEMA"),
        (json.dumps(confidence(choice="type_c")), "E_JEV_SCHEMA"), (json.dumps(confidence(choice=["type_a"])), "E_JEV_SCHEMA"), (json.dumps(drifted), "E_JEV_PIN_DRIFT"),
        (json.dumps(extra), "E_JEV_SCHEMA"), (text + "x", "E_JEV_SCHEMA"), (text + "," + text, "E_JEV_SCHEMA"), ("[1]", "E_JEV_SCHEMA"), ("null", "E_JEV_SCHEMA"), ("", "E_JEV_SCHEMA"), (None, "E_JEV_SCHEMA"),
    ]
    assert run_confidence(spark, [c[0] for c in cases]) == [c[1] for c in cases]


def verdict(i, **change):
    return {"type_id": i, "is_type": i == "type_a", "rationale": "because", "evidence": ["ABC\nT"], "closest_alternative": None, **change}


def reader_body(verdicts, outer=None, **response):
    text = json.dumps(outer if outer is not None else {"verdicts": verdicts})
    item = {"type": "message", "role": "assistant", "status": "completed", "content": [{"type": "output_text", "text": text}]}
    return json.dumps({"model": "gpt-6-sol", "status": "completed", "output": [{"type": "reasoning"}, item], **response})


@pytest.mark.parametrize("policy", [None, "whitespace-quotes-v1"])
def test_reader_shapes(spark, policy):
    good = [verdict("type_a"), verdict("type_b")]
    w = lambda **c: [verdict("type_a", **c), verdict("type_b")]
    spacing = None if policy else "E_READER_SCHEMA"
    bad = "E_READER_SCHEMA"
    cases = [
        (reader_body(good), None), (reader_body(w(evidence=[])), None), (reader_body(w(evidence=["ABC T"])), spacing), (reader_body(w(evidence=["ABX"])), bad),
        (reader_body(w(evidence=["A"] * 4)), bad), (reader_body(w(evidence=[""])), bad), (reader_body(w(evidence=[1])), bad), (reader_body(w(evidence="A")), bad), (reader_body(w(is_type="true")), bad),
        (reader_body(w(rationale="  ")), bad), (reader_body(w(rationale=5)), bad), (reader_body(w(closest_alternative="type_b")), None), (reader_body(w(closest_alternative="x")), bad),
        (reader_body(w(more=1)), bad), (reader_body(good[:1]), bad), (reader_body([good[0], good[0]]), bad), (reader_body(None, {"verdicts": good, "x": 1}), bad), (reader_body(None, [1]), bad),
        (reader_body(good, status="incomplete"), bad), (reader_body(good, error={"code": "x"}), bad), (reader_body(good, error=None), None), (reader_body(good, model="gpt-6-sol-2026-01-02"), None),
        (reader_body(good, model="gpt-6-luna"), "E_TERRA_PIN_DRIFT"), (reader_body(good, model=""), bad), (reader_body(good, output=[]), bad),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, body string").withColumns({
        "pin": F.lit("gpt-6-sol"), "pin_policy": F.lit("owner_approved_alias"), "type_ids": F.array(*[F.lit(i) for i in IDS]), "evidence_policy": F.lit(policy).cast("string")})
    docs = spark.range(len(cases)).select(F.col("id").cast("int").alias("id"), F.lit("the ABC\nT text").alias("text"))
    out = [r["code"] for r in responses.decode_reader(rows, docs, ["id"]).orderBy("id").select("finding.code").collect()]
    assert out == [c[1] for c in cases]


def test_parse_refuses_trailing_text(spark):
    values = ['{"a":1}', ' {"a":1} ', '{"a":1}}', '{"a":1},{"b":2}', "", "nul", "null"]
    out = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", F.to_json(js.parse(F.col("v"))).alias("j")).orderBy("i").collect()
    assert [r.j for r in out] == ['{"a":1}', '{"a":1}', None, None, None, None, "null"]


def test_result_lines(spark):
    ok = '{"custom_id":"a","response":{"status_code":200,"request_id":null,"body":{}},"error":null}'
    cases = [(ok, None), (ok + "\r", None), ("", "E_BATCH_RESULT"), ("{", "E_BATCH_RESULT"), (ok.replace('"a"', "7"), "E_BATCH_RESULT"), (ok.replace("200", '"200"'), "E_BATCH_RESULT"),
             (ok.replace(',"body":{}', ""), "E_BATCH_RESULT"), ('{"custom_id":"a","response":null,"error":{"code":"x"}}', None), ('{"custom_id":"a","response":null,"error":null}', "E_BATCH_RESULT"),
             ('{"custom_id":"a","error":{"code":"x"}}', "E_BATCH_RESULT"), (ok + " " * 200, "E_BATCH_RESULT_LIMIT")]
    df = spark.createDataFrame([("b", "f", i, c[0]) for i, c in enumerate(cases)], "batch_id string, file_id string, line_number int, line string")
    assert [r.line_code for r in correlation.parse_result_lines(df, 200).orderBy("line_number").collect()] == [c[1] for c in cases]


def test_retry_after(spark):
    at = 1_700_000_000_000
    rows = [("0", at), ("2.0001", at + 2001), ("-1", None), ("1.", None), (".5", None), ("Tue, 14 Nov 2023 22:13:25 GMT", at + 5000), ("Mon, 13 Nov 2023 22:13:25 GMT", at), ("31536000", at + 31536000000), ("31536001", None), ("later", None)]
    for r in spark.createDataFrame(rows, "h string, want bigint").select("h", "want", attempts.retry_after_deadline(F.col("h"), F.lit(at)).alias("got")).collect():
        assert r.got == r.want, r
