"""Tool-call linking and revisits against plain loops."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from pigeonhole.llm import chat, warc

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>, extra string"
CALL_ROWS = [
    (1, 1, "a", "search", '{"q": "x", "n": 3}', [], "-"), (1, 3, "b", "search", '{ "n":2.5 , "q":"é\\n" }', ["a"], "-"), (1, 2, "c", "search", '{"q": 5}', ["b", "a", None], "-"),
    (1, 9, "a", "later", "{}", [], "-"), (2, 1, "d", "unknown", "{}", ["zz"], "-"), (2, 2, "e", "search", "not json", None, "-"), (2, 3, "f", "search", '{"q":"t","z":{"b":1,"a":[true,null]}}', ["g"], "-"),
    (2, 4, "g", "search", '[1]', ["f"], "-"), (2, 5, "h", None, None, ["g"], "-"), (None, 1, "i", "search", '{"q":"only"}', [], "-"), (3, 1, None, "search", '{}', [], "-"), (2, 6, "j", "search", '{"q":""}', ["j"], "-")]
RESULT_ROWS = [("a", 4, "found"), ("a", 2, "first"), ("b", 5, None), ("x", 7, "lost"), (None, 1, "none")]
SCHEMA_ROWS = [("search", "q", "string", True), ("search", "n", "integer", False), ("search", "z", "object", False), (None, "q", "string", True)]


def linked(spark):
    return chat.link_tool_calls(spark.createDataFrame(CALL_ROWS, CALLS), spark.createDataFrame(RESULT_ROWS, "call_id string, turn long, content string"), spark.createDataFrame(SCHEMA_ROWS, "name string, param string, type string, required boolean"))


def test_links_order_and_errors(spark):
    got = {r.call_id: r for r in linked(spark).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "linked", "b": "linked", "x": "no_call", **{k: "no_result" for k in "cdefghij"}}
    assert {k: (r.level, r.position) for k, r in got.items() if r.level is not None} == {"a": (0, 1), "b": (1, 2), "c": (2, 3), "d": (0, 1), "e": (0, 2), "i": (0, 1)}
    assert (got["a"].calls, got["a"].results, got["a"].turn, got["a"].result_turn, got["x"].calls) == (2, 2, 1, 2, 0)
    assert {k: r.errors for k, r in got.items() if r.errors} == {
        "b": "n: number for integer", "c": "q: integer for string", "d": "name: unknown tool; needs: no call zz", "e": "arguments: not an object", "g": "arguments: not an object", "h": "arguments: not an object"}


def test_messages_are_canonical(spark):
    for r in linked(spark).collect():
        value = json.loads(r.message)
        assert r.message == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False), r.message
        assert value["id"] == r.call_id and value.get("name") == r.name
    got = {r.call_id: json.loads(r.message) for r in linked(spark).collect()}
    assert got["a"] == {"arguments": {"n": 3, "q": "x"}, "id": "a", "name": "search", "result": "first"}
    assert got["f"]["arguments"] == {"q": "t", "z": {"a": [True, None], "b": 1}} and got["e"]["arguments"] == "not json"


def test_long_chains_and_hot_parents(spark):
    rows = [(1, i, f"c{i}", "t", "{}", [f"c{i - 1}"] if 0 < i < 12 else ["c0"] if i else [], "") for i in range(300)]
    got = {r.call_id: (r.level, r.position) for r in chat.link_tool_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], "call_id string, turn long, content string"), spark.createDataFrame(SCHEMA_ROWS, "name string, param string, type string, required boolean")).collect()}
    order = sorted(rows, key=lambda r: (r[1] if r[1] < 12 else 1, r[1]))
    assert got == {r[2]: (r[1] if r[1] < 12 else 1, k + 1) for k, r in enumerate(order)}


def test_native_plan_and_conversations(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    found = chat.link_conversations(turns.withColumn("level", F.lit("clash")))
    assert not any(word in found._jdf.queryExecution().toString() for word in ("Python", "Arrow", "Pandas"))
    rows = {r.call_id: r for r in found.collect()}
    source = {(t.conv_id, t.turn): t for t in turns.collect()}
    calls = {f"call-{c}-{t}" for (c, t), r in source.items() if r.role == "assistant"}
    answers = {f"call-{c}-{t - 1}": r.text for (c, t), r in source.items() if r.role == "user" and t > 0}
    assert set(rows) == calls | set(answers)
    for call_id, r in rows.items():
        assert r.status == ("no_call" if call_id not in calls else "linked" if call_id in answers else "no_result")
        assert json.loads(r.message).get("result") == answers.get(call_id)
        if r.status != "no_call" and r.turn % 11 != 9:
            assert json.loads(r.message)["arguments"]["query"] == source[r.conv_id, r.turn].text
        if r.turn is not None and 1 < r.turn < 8 and f"call-{r.conv_id}-{r.turn - 2}" in calls:
            assert r.level == rows[f"call-{r.conv_id}-{r.turn - 2}"].level + 1
    assert chat.link_conversations(turns.limit(0)).count() == 0


def test_canonical_urls(spark):
    cases = {"HTTP://www.Example.com:80/a/?b=2&a=1#top": "example.com/a?a=1&b=2", "https://example.com/a?a=1&b=2": "example.com/a?a=1&b=2", "example.com": "example.com", "https://m.x.org:8080/P//": "m.x.org:8080/P", "https://x.org/?": "x.org", None: None, "": "",
             "https://x.org:80/a": "x.org:80/a", "http://x.org:443/a": "x.org:443/a", "https://x.org:443/%7Eme%2f?q=%41%zz%": "x.org/~me%2F?q=A%zz%", "x.org:80": "x.org"}
    rows = spark.createDataFrame([(k,) for k in cases], "url string").select("url", warc.canonical_url("url").alias("c")).collect()
    assert {r.url: r.c for r in rows} == cases


def capture(record_id, kind, url, day, status=200, hour=0, **headers):
    return (record_id, kind, url, None if day is None else datetime(2024, 1, day, hour), status, {k.replace("_", "-"): v for k, v in headers.items()}, "x")


def test_revisits(spark):
    rows = [capture("r1", "response", "http://a.org/x", 1, etag='"1"', content_type="text/html", date="d1", vary="old"), capture("r2", "response", "https://www.a.org/x#f", 5, etag='"2"', last_modified="m"),
            capture("r2b", "response", "http://a.org/x", 5, hour=3, etag='"3"'), capture("bad", "response", "http://a.org/x", 6, 500, etag='"9"'),
            capture("v1", "revisit", "http://A.org/x/", 2, 304, etag='W/"1"', date="d2", content_type="no"), capture("v2", "revisit", "http://a.org/x", 5, 304, hour=1, etag='"2"', last_modified="other"),
            capture("v3", "revisit", "http://a.org/x", 7, 304), capture("v4", "revisit", "http://a.org/x", 1, 304, etag='"1"'), capture("v5", "revisit", "http://b.org", 3, 304), capture("v6", "revisit", None, 3, 304),
            capture("v7", "revisit", "http://a.org/x", None, 304), capture("v8", "revisit", "http://a.org/x", 9, 304, etag='"3"'), capture("v8", "revisit", "http://a.org/x", 9, 304, etag='"3"'), capture(None, "revisit", "http://a.org/x", 9, 304, etag='"3"')]
    frame = spark.createDataFrame(rows, "record_id string, kind string, url string, fetched timestamp, status int, headers map<string,string>, page string")
    got = warc.resolve_revisits(frame).collect()
    assert len(got) == 10
    by = {r.record_id: (r.outcome, r.response_id) for r in got}
    assert by == {"v1": ("resolved", "r1"), "v2": ("changed", "r2"), "v3": ("unchecked", "r2b"), "v4": ("no_response", None), "v5": ("no_response", None), "v6": ("undated", None), "v7": ("undated", None), "v8": ("resolved", "r2b"), None: ("resolved", "r2b")}
    assert next(r.headers for r in got if r.record_id == "v1") == {"etag": 'W/"1"', "content-type": "text/html", "date": "d2", "vary": "old"}
    assert warc.resolve_revisits(frame.limit(0)).count() == 0


def test_records_survive_the_format(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {f"{p.page_id:012d}-0": p.html for p in pages.collect()}
    parsed = warc.parse_records(warc.page_records(pages)).collect()
    assert len(parsed) == 5 * len(html) and {r.record_id: r.payload for r in parsed if r.kind == "response"} == html
    got = warc.page_revisits(pages).groupBy("outcome").count().collect()
    assert {r.outcome for r in got} <= {"resolved", "changed", "unchecked", "no_response"} and sum(r["count"] for r in got) == 4 * len(html)
    odd = spark.createDataFrame([(1, None, "h"), (2, "http://a.org", None), (None, "u", "h")], "page_id long, url string, html string")
    assert warc.page_revisits(odd).count() == 8


def plain_revisits(rows):
    """Every revisit by a plain loop over all captures."""
    out = []
    tag = lambda h: h.get("etag", "").removeprefix("W/") or None
    for rid, kind, page, at, status, headers in rows:
        if kind != "revisit":
            continue
        if page is None or at is None:
            out.append((rid, "undated", None, None))
            continue
        earlier = [r for r in rows if r[1] == "response" and 200 <= r[4] < 300 and r[2] == page and r[3] is not None and r[3] < at and r[0] is not None]
        if not earlier:
            out.append((rid, "no_response", None, None))
            continue
        last = max((r[3], r[0]) for r in earlier)
        stored = dict(min(sorted(r[5].items()) for r in earlier if (r[3], r[0]) == last))
        pairs = [(tag(headers), tag(stored)), (headers.get("last-modified"), stored.get("last-modified"))]
        both = [a == b for a, b in pairs if a is not None and b is not None]
        outcome = "changed" if False in both else "resolved" if both else "unchecked"
        merged = {**stored, **{k: v for k, v in headers.items() if k in warc.PERMITTED}}
        out.append((rid, outcome, last[1], tuple(sorted(merged.items())) if outcome == "resolved" else None))
    return sorted(out, key=repr)


def test_revisits_equal_a_plain_loop_in_any_order(spark):
    import random

    r = random.Random(8)
    rows = []
    for i in range(400):
        kind = r.choice(["response", "revisit", "revisit"])
        headers = {k: v for k, v in (("etag", r.choice(['"1"', 'W/"1"', '"2"', None])), ("last-modified", r.choice(["m", "n", None])), ("date", f"d{i}"), ("content-type", f"t{i}")) if v}
        at = None if r.random() < 0.03 else datetime(2024, 1, r.choice([1, 1, 1, 2, 5]), r.randrange(6), r.choice([0, 30]))
        rows.append((None if r.random() < 0.03 else f"r{i // 2 if i % 5 == 0 else i}", kind, r.choice(["a.org", "a.org", "a.org/x", "b.org", None]), at, r.choice([200, 200, 204, 500]) if kind == "response" else 304, headers))
    rows += [("same", "response", "a.org", datetime(2024, 1, 9), 200, {"etag": t}) for t in ('"1"', '"2"')] + [("late", "revisit", "a.org", datetime(2024, 1, 10), 304, {"etag": t}) for t in ('"1"', '"2"')]
    want = plain_revisits(rows)
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        frame = spark.createDataFrame(rows, "record_id string, kind string, url string, fetched timestamp, status int, headers map<string,string>").repartition(3)
        got = [(x.record_id, x.outcome, x.response_id, None if x.headers is None else tuple(sorted(x.headers.items()))) for x in warc.resolve_revisits(frame).collect()]
        assert sorted(got, key=repr) == want
    assert {o for _, o, _, _ in want} == {"resolved", "changed", "unchecked", "no_response", "undated"}
