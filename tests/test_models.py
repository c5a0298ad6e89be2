"""Operators with carried state or search against small independent Python models."""

import functools
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pigeonhole.operators import batching, corrections, ledger, outline, proposals, requests, states
from pigeonhole.streaming import guards


def greedy(rows, limit, most):
    groups, held, count, index = {}, 0, 0, -1
    for fp, size in sorted(rows):
        if count == 0 or held + size > limit or count >= most:
            index, held, count = index + 1, 0, 0
        groups[fp], held, count = index, held + size, count + 1
        if size > limit:
            held = count = 0
    return groups


@pytest.mark.parametrize("seed,most,block", [(1, 1000, 50), (2, 3, 20), (3, 5, 10), (4, 40, 9), (5, 1000, 5000)])
def test_batch_groups(spark, seed, most, block):
    rng, limit = random.Random(seed), 100
    rows, want = [], {}
    for run in ("a", "b", "c"):
        part = [(hashlib.sha256(f"{seed}{run}{i}".encode()).hexdigest(), rng.choice([1, 5, 20, 60, 99, 100, 101, 250])) for i in range(rng.randrange(1, 400))]
        rows += [(run, fp, size) for fp, size in part]
        want.update({(run, fp): g for fp, g in greedy(part, limit, most).items()})
    out = batching.plan_batch_groups(spark.createDataFrame(rows, "run_id string, fingerprint string, bytes bigint"), block, limit, most).collect()
    assert {(r.run_id, r.fingerprint): r.group_index for r in out} == want


@settings(deadline=None, max_examples=200)
@given(st.lists(st.lists(st.sampled_from([1, 5, 20, 60, 99, 100, 101, 250]), min_size=1, max_size=12), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 100), st.integers(0, 9))
def test_block_tables_join_like_one_block(blocks, most, held, count):
    whole = batching.BlockTable.of_rows(np.array(sum(blocks, [])), 100, most)
    joined = functools.reduce(lambda a, b: a.then(b, 100, most), (batching.BlockTable.of_rows(np.array(b), 100, most) for b in blocks))
    for name in ("before", "bytes", "rows", "out_bytes", "out_rows", "opened"):
        assert np.array_equal(getattr(whole, name), getattr(joined, name)), name
    if count <= most and (count or not held):
        one = [int(x[0]) for x in whole.after(np.array([held]), np.array([count]), 100, most)]
        want_held, want_count, opened = held, count, 0
        for size in sum(blocks, []):
            if want_count == 0 or want_held + size > 100 or want_count >= most:
                want_held, want_count, opened = 0, 0, opened + 1
            want_held, want_count = (0, 0) if size > 100 else (want_held + size, want_count + 1)
        assert one == [want_held, want_count, opened]


def test_a_run_of_a_million_requests(spark):
    """Many blocks in two levels of tables, none larger than its share; as the sequential packing has it."""
    n = 1_000_000
    rows = spark.range(n).selectExpr("if(id % 50 = 7, 'small', 'hot') as run_id", "sha2(cast(id as string), 256) as fingerprint", "1 + id * 7919 % 400000 as bytes")
    out = batching.plan_batch_groups(rows, block_rows=20_000)
    got = out.groupBy("run_id", "group_index").agg(F.count(F.lit(1)).alias("n"), F.min("fingerprint").alias("first")).toPandas()
    for run, part in rows.toPandas().groupby("run_id"):
        part = part.sort_values("fingerprint")
        firsts, held = [], 1 << 60
        for fp, size in zip(part["fingerprint"].tolist(), part["bytes"].tolist()):
            if held + size > 8 << 20:
                firsts.append(fp)
                held = 0
            held += size
        mine = got[got.run_id == run].sort_values("group_index")
        assert mine["first"].tolist() == firsts and mine["group_index"].tolist() == list(range(len(firsts))) and mine["n"].sum() == len(part)


def nested(spark, docs):
    schema = ("id int, full_text string, title string, headings array<struct<id:string,text:string,level:int,position:bigint>>, tables array<struct<position:bigint,headers:array<string>>>, "
              "blocks array<struct<headingId:string,position:bigint,text:string>>, vocabulary array<string>, budget int")
    return spark.createDataFrame(docs, schema)


def test_digest_native_equals_codec(spark):
    rng, docs = random.Random(11), []
    for i in range(60):
        heads = [(f"h{j}", rng.choice(["Method", "A method, here", "Results", "methods"]), 1, j * 100) for j in range(rng.randrange(4))]
        blocks = [(rng.choice([h[0] for h in heads] + [None]), j * 10, "".join(rng.choice('ab"\\\n\x01é😀 ') for _ in range(rng.randrange(50)))) for j in range(rng.randrange(1, 7))]
        docs.append((i, "t", rng.choice([None, "Title"]), heads, [(5, ["x", "y"])], blocks, ["method"], rng.randrange(60, 700)))
    df = nested(spark, docs)
    native = {r.id: r for r in states.build_budgeted_digest(df).select("id", "serialized", "token_count", "code").collect()}
    other = {r.id: r for r in states.build_digest_with_codec(df, states.CodePoints(), ["id"]).collect()}
    for i in native:
        assert (native[i].serialized, native[i].code) == (other[i].serialized, other[i].code), docs[i]
    assert {r.code for r in native.values()} == {None, "E_DIGEST_OUTLINE_BUDGET"}


def test_digest_literal(spark):
    heads = [("a", "Section A", 1, 0), ("b", "Method", 2, 30)]
    blocks = [("a", 10, "a" * 80), ("b", 40, "b" * 80)]
    table = [(20, ["Column A", "Column B"])]
    base = states.build_budgeted_digest(nested(spark, [(0, "t", None, heads, table, [], ["method"], 10_000)])).first().token_count
    rows = states.build_budgeted_digest(nested(spark, [(0, "t", None, heads, table, blocks, ["method"], 10_000), (1, "t", None, heads, table, blocks, ["method"], base + 60), (2, "t", None, heads, table, blocks, ["method"], 1)])).orderBy("id").collect()
    assert [s.headingId for s in rows[0].sections] == ["b", "a"] and rows[0].token_count == len(rows[0].serialized)
    assert rows[1].token_count <= base + 60 and rows[1].sections[0].headingId == "b" and rows[1].taken[1] == 0 and 0 < rows[1].taken[0] < 80
    assert rows[2].code == "E_DIGEST_OUTLINE_BUDGET"


def test_digest_cuts_a_long_block_without_pricing_its_characters(spark, capsys):
    heads, docs = [("h", "Method", 1, 0)], []
    for i, unit in enumerate(["a", '"', "😀\n", "ab\x01", "\\"]):
        for budget in (200, 1_500):
            docs.append((10 * i + budget, "t", "T", heads, [], [("h", 10, unit * 20_000), (None, 20, "b")], ["method"], budget))
    df = nested(spark, docs)
    out = states.build_budgeted_digest(df)
    native = {r.id: (r.serialized, r.taken[0] > 0) for r in out.collect()}
    assert native == {r.id: (r.serialized, True) for r in states.build_digest_with_codec(df, states.CodePoints(), ["id"]).collect()}
    out.explain(True)
    assert "split(" not in capsys.readouterr().out


def test_texts_of_one_pack_are_dealt_over_tasks(spark):
    types = spark.createDataFrame([("p", 0, "a", "A", "w", "n", ["x"])], "pack string, position int, id string, name string, what string, not_for string, examples array<string>")
    packs = spark.createDataFrame([("p", "{}", "Read.", "gpt-6-sol", "owner_approved_alias", "low", 9)], "pack string, none_json string, reader_prompt string, reader_pin string, reader_policy string, effort string, reader_cap int")
    docs = spark.range(400).selectExpr("'p' as pack", "id", "concat('text ', id) as full_text")
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for key, value in zip(held, ("-1", "false")):
            spark.conf.set(key, value)
        rows = requests.build_reader_requests(docs, types, packs, "pack").select("id", "code", F.spark_partition_id().alias("task")).collect()
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)
    assert sorted(r.id for r in rows) == list(range(400)) and {r.code for r in rows} == {None}
    assert len({r.task for r in rows}) > 1


def test_layout_literal(spark):
    lines = [(0, "w0", 1, 30.0, 15.0, False, 0)] + [(n + 1, f"w{n + 1}", 1, 70.0 + n * 12, 10.0, False, n + 1) for n in range(4)] + [(5, "w5", 1, 300.0, 10.0, True, 5), (6, "w6", 1, 312.0, 10.0, True, 6)]
    df = spark.createDataFrame(lines, "seq int, text string, page int, y double, font_size double, bold boolean, position bigint").withColumns(
        {"doc": F.lit("d"), "page_height": F.lit(800.0), "item_font_sizes": F.lit(None).cast("array<double>")})
    policy = {"large_font_ratio": 1.2, "maximum_heading_characters": 100, "top_page_fraction": 0.1, "gap_ratio": 1.5, "minimum_headings": 1}
    out = outline.infer_layout_headings(df, ["doc"], policy).orderBy("position").collect()
    assert [(r.position, r.level) for r in out] == [(0, 1), (5, 2)]
    with pytest.raises(ValueError):
        outline.infer_layout_headings(df, ["doc"], {**policy, "gap_ratio": 0})


def streaks(flags):
    out, n = [], 0
    for f in flags:
        n = n + 1 if f else 0
        out.append(n)
    return out


def test_failure_counters_fold_like_one_pass(spark):
    rng, rows = random.Random(5), []
    for run in range(6):
        rows += [(f"r{run}", "reader", i * 1_000 + run, i, rng.random() < 0.7) for i in range(rng.randrange(0, 60))]
    df = spark.createDataFrame(rows, "run_id string, vendor string, created_ms bigint, outcome_id bigint, exhausted boolean")
    once = {(r.run_id, r.outcome_id): r.consecutive for r in ledger.consecutive_failures(df, ["run_id", "vendor"], F.floor(F.col("created_ms") / 7_000)).collect()}
    folded = {r.run_id: (r.failures, r.longest, r.tripped) for r in guards.circuit_counters(guards.circuit_blocks(df, 4_000), days=3).collect()}
    for run in {r[0] for r in rows}:
        want = streaks([r[4] for r in rows if r[0] == run])
        assert [once[(run, i)] for i in range(len(want))] == want
        assert folded[run] == (want[-1], max(want), max(want) >= 3)


def correction(spark, manifest, files, checked=("type_a",), sidecars=()):
    m = spark.createDataFrame([("r", *x) for x in manifest], "run_id string, fingerprint string, tag string, destination_folder string, rule string")
    l = spark.createDataFrame([("c", "r", *x) for x in files], "correction_id string, run_id string, folder string, filename string, tag string, fingerprint string")
    c = spark.createDataFrame([("c", "r", ["type_a", "type_b"], list(checked))], "correction_id string, run_id string, type_ids array<string>, checked_folders array<string>")
    s = spark.createDataFrame([("c", x) for x in sidecars], "correction_id string, path string")
    return l, m, c, s


def test_correction_identity_and_kinds(spark):
    manifest = [("f1", "t1", "type_a", "R1"), ("f2", "t2", "type_a", "R1"), ("f3", "t3", "human_review", "R2"), ("f4", "t4", "type_b", "R1"), ("f5", "t5", "type_b", "R1"), ("f6", "t6", "type_a", "R1"), ("f7", "t7", "type_a", "R1"), ("f8", "t8", "type_b", "R1")]
    files = [("type_a", "1", "t1", "f2"), ("type_b", "2", None, "f2"), ("type_b", "3", "t3", None), ("human_review", "4", "t4", None), ("elsewhere", "5", "t5", None),
             ("type_a", "6", "unknown", "f6"), ("type_a", "7", "", "f7"), ("type_b", "8", "t8", None), ("type_a", "notes.md", None, None), ("type_a", "8.md", None, None), ("x/__MACOSX", "y", "t6", None)]
    out = {r.filename or r.entry_tag: r for r in corrections.diff_correction(*correction(spark, manifest, files, sidecars=["type_a/8.md"])).collect()}
    assert (out["1"].facet, out["1"].entry_tag, out["1"].matched_by) == ("confirmation", "t1", "tag")
    assert (out["2"].kind, out["2"].matched_by) == ("misfile", "fingerprint")
    assert [out[n].kind for n in ("3", "4", "5")] == ["human_label", "should_not_have_been_auto_filed", "unresolved_folder"]
    assert out["6"].facet == out["7"].facet == out["notes.md"].facet == "unmatched"
    assert out["8"].facet == "unchecked" and out["8.md"].facet == out["y"].facet == "ignored"
    assert out["t6"].facet == out["t7"].facet == "deleted"


def test_threshold_proposals_literal(spark):
    filed = [("c", f"t{i}", "R1", "move" if i == 0 else "confirmation", "misfile" if i == 0 else None, "type_b" if i == 0 else "type_a", "type_a", None, 0.91 if i == 0 else 0.98, None) for i in range(50)]
    labels = [("c", "l1", "R2", "move", "human_label", "type_a", "human_review", None, 0.7, "type_a"), ("c", "l2", "R2", "move", "human_label", "type_b", "human_review", None, 0.6, "type_a")]
    df = spark.createDataFrame(filed + labels, "correction_id string, entry_tag string, rule string, facet string, kind string, folder string, destination_folder string, action string, certainty double, agreed_type string")
    bounds = spark.createDataFrame([("c", 0.9, 50)], "correction_id string, threshold double, minimum_filed int")
    check = proposals.filed_check(df, bounds)
    up, down = proposals.propose_raise(check).first(), proposals.propose_lower(df, check).first()
    assert (check.first().status, up.threshold, up.wrong_sent_to_review) == ("raise_proposed", 0.98, 1)
    assert (down.threshold, down.additional_automatic_labels, down.observed_errors) == (0.7, 1, 0)
    short = proposals.filed_check(df.filter("entry_tag <> 't9'"), bounds)
    assert short.first().status == "insufficient_sample" and proposals.propose_raise(short).count() == proposals.propose_lower(df, short).count() == 0


def lower_model(labels, current):
    for t in sorted({c for c, agrees in labels if agrees and c < current}):
        if not any(c >= t and not agrees for c, agrees in labels):
            return t, sum(t <= c < current for c, _ in labels)
    return None


def test_lower_against_sweep(spark):
    rng, rows, want = random.Random(3), [], {}
    for i in range(40):
        labels = [(rng.randrange(100) / 100, rng.random() < 0.9) for _ in range(rng.randrange(1, 12))]
        want[f"c{i}"] = lower_model(labels, 0.9)
        rows += [(f"c{i}", "R2", "move", "human_label", "type_a" if ok else "type_b", "human_review", None, c, "type_a") for c, ok in labels]
    df = spark.createDataFrame(rows, "correction_id string, rule string, facet string, kind string, folder string, destination_folder string, action string, certainty double, agreed_type string")
    check = df.select("correction_id").distinct().withColumns({"threshold": F.lit(0.9), "enough": F.lit(True)})
    got = {r.correction_id: (r.threshold, r.additional_automatic_labels) for r in proposals.propose_lower(df, check).collect()}
    assert got == {c: v for c, v in want.items() if v}
