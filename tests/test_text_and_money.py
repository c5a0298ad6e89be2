import random

from pyspark.sql import functions as F

from pigeonhole.functions import money, text as tx
from pigeonhole.functions.arrays import block_positions, running_offsets
from pigeonhole.operators import costs, outline, states, tree


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_utf16_and_white_space(spark):
    assert one(spark, tx.utf16_len, "a😀b") == 4
    assert one(spark, tx.canonical_evidence, "  ‘a’   “b”﻿\r\n c  ") == "'a' \"b\" c"
    assert one(spark, tx.blank, "  　\t﻿") is True and one(spark, tx.blank, " x ") is False
    assert one(spark, tx.words, "L'été 2024: Straße—x") == ["l", "été", "2024", "straße", "x"]
    assert one(spark, tx.words_nfkc, "１２ ﬁne") == ["12", "fine"]


def test_evidence_policies(spark):
    df = spark.createDataFrame([
        ("one\r\n two", "one two", None, False), ("one\r\n two", "one two", "whitespace-quotes-v1", True), ("a “b”", 'a "b"', "whitespace-quotes-v1", True),
        ("abc", "", None, False), ("abc", "  ", "whitespace-quotes-v1", False), ("abc", "abd", "whitespace-quotes-v1", False), ("ABCT", "ABCT", "exact-substring-v1", True)],
        "t string, q string, p string, want boolean")
    for r in df.withColumn("got", tx.evidence_matches(F.col("t"), F.col("q"), F.col("p"))).collect():
        assert r.got == r.want, r


def test_line_positions_against_python(spark):
    rng = random.Random(7)
    texts = ["", "\n", "a", "a\r\n\r\nb\rc\n", "x y\nz"] + ["".join(rng.choice("ab😀 \n\r\t") for _ in range(rng.randrange(60))) for _ in range(200)]
    got = {}
    for r in outline.split_lines(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), ["id"]).collect():
        got.setdefault(r.id, []).append((r.position, r.line))
    for i, text in enumerate(texts):
        want, at, line, start = [], 0, "", 0
        units = lambda s: len(s.encode("utf-16-be")) // 2
        j = 0
        while j <= len(text):
            c = text[j] if j < len(text) else None
            if c in ("\r", "\n", None):
                if line:
                    want.append((start, line))
                width = 2 if c == "\r" and text[j + 1:j + 2] == "\n" else 1
                at += units(line) + width
                j, line, start = j + width, "", at
            else:
                line, j = line + c, j + 1
        assert sorted(got.get(i, [])) == want, repr(text)


def test_running_offsets_over_chunks(spark):
    row = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(1300)), lambda x: x.cast("bigint")).alias("a")).select("a", running_offsets(F.col("a")).alias("o")).first()
    assert row.o == [sum(row.a[:i]) for i in range(1300)]
    assert spark.range(1).select(running_offsets(F.array().cast("array<bigint>"))).first()[0] == []


def test_block_positions(spark):
    df = spark.range(1_000).select((F.col("id") % 2).alias("k"), ((F.col("id") * 7919) % 1_000).alias("o"))
    out = block_positions(df, ["k"], F.floor(F.col("o") / 37), ["o"], "n").collect()
    for key in (0, 1):
        rows = sorted((r for r in out if r.k == key), key=lambda r: r.o)
        assert [r.n for r in rows] == list(range(1, len(rows) + 1))


def test_money(spark):
    assert one(spark, money.usd_to_nano, "12.5") == "12500000000" and one(spark, money.usd_to_nano, " ") is None
    assert one(spark, money.usd_to_nano, "0.000000001") == "1" and one(spark, money.usd_to_nano, "9" * 30) == "9" * 30 + "0" * 9
    for value, want in (("0", "$0.00"), ("5", "$0.000000005"), ("1500000000", "$1.50"), ("1" * 40, "$" + "1" * 31 + ".111111111")):
        assert one(spark, money.format_nano, value) == want


COST = "run_id string, fingerprint string, confidence_in bigint, confidence_cap bigint, confidence_measured bigint, reader_in bigint, reader_cap bigint, reader_measured bigint, recovery_in bigint, recovery_cap bigint, recovery_measured bigint"


def test_cost_literals(spark):
    flat = costs.rates(2_000_000_000, 10_000_000_000)
    long = costs.rates(2_000_000_000, 10_000_000_000, 272_000, (2, 1), (3, 2))
    run = lambda row, **rate: costs.estimate_run_cost(spark.createDataFrame([("r", "1", *row)], COST), {**{n: flat for n in ("confidence", "reader", "recovery")}, **rate}).first()
    first = run((100, 0, None, 1000, 100, None, 200, 50, None))
    assert (first.worst_case_nano, first.estimate_nano, first.basis) == ("21300000", "4100000", "one_attempt_output_caps")
    assert run((100, 0, None, 1000, 100, None, None, None, None)).worst_case_nano == "18600000"
    assert run((0, 0, None, 272_000, 100, None, None, None, None), reader=long).worst_case_nano == "3270000000"
    assert run((0, 0, None, 272_001, 100, None, None, None, None), reader=long).worst_case_nano == "6537024000"
    tiny = run((1, 0, None, 0, 0, 0, None, None, None), confidence=costs.rates(1, 0))
    assert (tiny.worst_case_nano, tiny.estimate_nano, tiny.basis) == ("3", "1", "one_attempt_measured_outputs_and_caps")


def test_usage_codes(spark):
    rows = [('{"input_tokens":1,"output_tokens":2,"input_tokens_details":{"cached_tokens":0,"cache_write_tokens":0}}', "disabled", None),
            ('{"input_tokens":1,"output_tokens":2,"input_tokens_details":{"cached_tokens":1,"cache_write_tokens":0}}', "disabled", "E_CACHE_POLICY"),
            ('{"input_tokens":1,"output_tokens":2}', "disabled", "E_CACHE_POLICY"), ('{"input_tokens":1,"output_tokens":2}', "not_applicable", None),
            ('{"input_tokens":"1","output_tokens":2}', "not_applicable", "E_VENDOR_USAGE"), ('{"input_tokens":1.5,"output_tokens":2}', "not_applicable", "E_VENDOR_USAGE"),
            ('{"input_tokens":-1,"output_tokens":2}', "not_applicable", "E_VENDOR_USAGE"), (None, "disabled", "E_VENDOR_USAGE"), ('{"input_tokens":1,"output_tokens":2}', "other", "E_CACHE_POLICY")]
    out = costs.actual_usage_cost(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, usage_json string, cache_policy string, want string"), costs.rates(1_000_000, 1_000_000)).collect()
    for r in out:
        assert r.usage_code == r.want and (r.cost_nano == "3") == (r.want is None), r


def test_js_numbers_and_json_text(spark):
    rows = [(1.0, "1"), (0.5, "0.5"), (0.0001, "0.0001"), (1e-7, "1e-7"), (0.0, "0"), (0.123456789, "0.123456789")]
    for r in spark.createDataFrame(rows, "v double, want string").select(tree.js_number(F.col("v")).alias("got"), "want").collect():
        assert r.got == r.want
    assert one(spark, lambda c: states.json_text(F.array(c)), 'a"\\\x1f\x01/é \\u001F') == '["a\\"\\\\\\u001f\\u0001/é \\\\u001F"]'
