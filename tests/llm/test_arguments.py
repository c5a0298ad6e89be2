"""Arguments of tool calls: strict reading, canonical numbers and schema errors against a plain reader."""

import json
import random
from decimal import Decimal

import pytest

from pigeonhole.llm import chat

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>"
RESULTS = "call_id string, turn long, content string"
SCHEMA = [("t", "a", "integer", True), ("t", "b", "number", False), ("t", "s", "string", False), ("t", "o", "object", False), ("t", "l", "array", False)]


class Number:
    """A JSON number kept as a decimal: canonical text by value."""

    def __init__(self, text):
        self.value = Decimal(text)

    def __str__(self):
        sign, digits, exponent = self.value.as_tuple()
        digits = "".join(map(str, digits)).lstrip("0")
        kept = digits.rstrip("0")
        if not kept:
            return "0"
        n = exponent + len(digits)
        k = len(kept)
        if k <= n <= 100:
            text = kept + "0" * (n - k)
        elif 0 < n < k:
            text = f"{kept[:n]}.{kept[n:]}"
        elif -6 < n <= 0:
            text = "0." + "0" * -n + kept
        else:
            text = kept[0] + (f".{kept[1:]}" if k > 1 else "") + f"e{n - 1:+d}"
        return "-" * sign + text


def no_repeats(pairs):
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("repeated key")
    return dict(pairs)


def plain_read(text):
    try:
        return json.loads(text, parse_int=Number, parse_float=Number, parse_constant=lambda _: 1 / 0, object_pairs_hook=no_repeats)
    except (ValueError, TypeError, ZeroDivisionError):
        return None


def plain_text(v):
    if isinstance(v, Number):
        return str(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{plain_text(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(plain_text, v)) + "]"
    return json.dumps(v, ensure_ascii=False)


def plain_kind(v):
    if isinstance(v, Number):
        return "integer" if v.value == v.value.to_integral_value() else "number"
    return {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}[type(v)]


def plain_errors(v):
    if not isinstance(v, dict):
        return ["arguments: not an object"]
    types, found = {p: (t, r) for _, p, t, r in SCHEMA}, []
    for p, (_, required) in types.items():
        if required and p not in v:
            found.append(f"{p}: missing")
    for p, x in v.items():
        kind = plain_kind(x)
        if p not in types:
            found.append(f"{p}: not expected")
        elif kind != types[p][0] and (kind, types[p][0]) != ("integer", "number"):
            found.append(f"{p}: {kind} for {types[p][0]}")
    return sorted(found)


GOOD = ['{"a":1e0}', '{"a":1.0}', '{"a":1}', '{"a":-0.0}', '{"a":12345678901234567890123456789012345678901}', '{"a":1e400,"b":-1.5E-400}', '{"a":100e-2,"b":0.00000012}', '{"a":' + "7" * 150 + "}",
        '{"a":1,"s":"1e0 \\" 5 \\\\"}', '{"a":10,"l":[1.50,{"z":2e1,"a":["3"]},-7],"o":{"y":1,"x":"2"}}', ' { "s" : "a:b" , "a" : 3 } ', '{"a":"1"}', '{"b":2.5}', '{"a":true}', '{"a":null,"x":[]}', '{"é":1.10,"a":0}', '{"a":1.5e1}', '{"a":12.5e-1,"s":"\\u00e9\\n"}']
BAD = ['{"a":1} garbage', '{"a":1},{"a":2}', '{"a":1,"a":2}', '{"a":1,"o":{"k":1,"k":1}}', '{"a":01}', '{"a":1.}', '{"a":+1}', "", "not json", '{"a":NaN}', '{"a":1', "[1]", "5", '"x"', '{"a":1}]', '{"a":1}}', "{'a':1}", None]


def linked(spark, texts):
    calls = spark.createDataFrame([(1, i, f"c{i}", "t", t, []) for i, t in enumerate(texts)], CALLS)
    rows = chat.link_tool_calls(calls, spark.createDataFrame([], RESULTS), spark.createDataFrame(SCHEMA, "name string, param string, type string, required boolean")).collect()
    return {r.call_id: r for r in rows}


def some_json(r, depth=0):
    kind = r.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return r.choice(["1", "0", "-3", "2.50", "1e3", "1E-9", "120e-1", "9007199254740993", "0.1e1", "-0"])
    if kind == 2:
        return json.dumps(r.choice(["", "a", "1", 'q"', "x:y", "\\", "é"]))
    if kind == 3:
        return r.choice(["true", "null", "false"])
    if kind == 4:
        return "[" + ",".join(some_json(r, depth + 1) for _ in range(r.randrange(3))) + "]"
    return "{" + " , ".join(f'"{r.choice("abslo")}": {some_json(r, depth + 1)}' for _ in range(r.randrange(4))) + "}"


@pytest.mark.parametrize("repeats", ["true", "false"])
def test_arguments_equal_a_plain_reader(spark, repeats):
    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", repeats)
    try:
        r = random.Random(4)
        texts = GOOD + BAD + [some_json(r) for _ in range(150)] + ['{"a":1,"s":"' + 'long \\" text: ' * 20_000 + '"}']
        got = linked(spark, texts)
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", before)
    for i, text in enumerate(texts):
        value, row = plain_read(text or ""), got[f"c{i}"]
        assert row.errors == "; ".join(plain_errors(value)), (text or "")[:200]
        written = plain_text(value) if value is not None or (text or "").strip() == "null" else json.dumps(text, ensure_ascii=False)
        own = f'"arguments":{written},' if text is not None else ""
        assert row.message == f'{{{own}"id":"c{i}","name":"t"}}', (text or "")[:200]


def test_order_and_status_equal_a_plain_loop(spark):
    r = random.Random(9)
    calls, results = [], []
    for c in range(6):
        for t in range(25):
            needs = [f"{c}-{r.randrange(25)}" if r.random() < 0.1 else f"{c}-{r.randrange(t)}" for _ in range(r.randrange(3)) if t]
            calls.append((c, t, f"{c}-{t}", "t", '{"a":1}', needs))
    results = [(r.choice(calls)[2], r.randrange(50), "x") for _ in range(60)] + [("lost", 1, "x")]
    rows = {x.call_id: x for x in chat.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame(SCHEMA, "name string, param string, type string, required boolean")).collect()}
    level, left = {}, {c[2]: set(c[5]) for c in calls}
    while ready := [c for c, needs in left.items() if needs <= set(level)]:
        for c, n in [(c, max((level[x] + 1 for x in left[c]), default=0)) for c in ready]:
            level[c] = n
            del left[c]
    for c in range(6):
        order = sorted((x for x in level if x.startswith(f"{c}-")), key=lambda x: (level[x], int(x.split("-")[1])))
        assert [rows[x].position for x in order] == list(range(1, len(order) + 1))
    answered = {x[0] for x in results}
    for _, _, call_id, *_ in calls:
        assert rows[call_id].level == level.get(call_id) and rows[call_id].status == ("linked" if call_id in answered else "no_result")
    assert rows["lost"].status == "no_call"
