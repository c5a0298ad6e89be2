"""Admission over several micro-batches: replays, rows far behind the newest one, repeated batches and missing state."""

import glob
import os
import random
import shutil

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pigeonhole.functions import json as j
from pigeonhole.operators import ledger
from pigeonhole.session import new_folder, shared_folder
from pigeonhole.streaming import guards

CALLS = "attempt_id string, run_id string, role string, cost_nano string, created_at timestamp_ntz"


def arrivals(spark, parts, schema):
    """Each part is handled before the next arrives; the last step is returned with its folder."""
    source, folder = new_folder(spark, "source"), new_folder(spark, "stream")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        yield spark.readStream.schema(schema).parquet(source), folder


def test_late_calls_and_replays_are_charged_once(spark):
    from datetime import datetime
    day = lambda d: datetime(2024, 1, d)
    parts = [[("a", "r", "reader", "100", day(20)), ("a", "r", "reader", "100", day(20))], [("b", "r", "reader", "7", day(1)), ("a", "r", "reader", "100", day(20))], [("a", "r", "reader", "100", day(20)), ("c", "q", "reader", None, day(2))]]
    runs = spark.sql("select run_id, policy as spend_policy, 'limited' as budget_mode, cast(l as decimal(38,0)) as limit_blended, cast(null as decimal(38,0)) as limit_openai, cast(null as decimal(38,0)) as limit_typesafe from values ('r', 'continue-v1', 150), ('q', null, 1) as t(run_id, policy, l)")
    seen = []
    for stream, folder in arrivals(spark, parts, CALLS):
        seen.append(sorted(r.attempt_id for r in guards.stream_charge_once(stream, folder).collect()))
    assert seen == [["a"], ["a", "b"], ["a", "b", "c"]]
    for stream, folder in arrivals(spark, parts, CALLS):
        spend = {r.run_id: (int(r.blended), r.unknown_calls) for r in guards.stream_live_spend(stream, runs, folder).collect()}
    assert spend == {"r": (107, 0), "q": (0, 1)}


def last_progress(query):
    return [p for p in query.recentProgress if p["numInputRows"]]


def test_a_repeated_micro_batch_admits_the_same_rows(spark):
    for stream, folder in arrivals(spark, [[("a",), ("b",)], [("b",), ("c",)]], "k string"):
        guards.admit_once(stream, folder, ["k"])
    read = lambda: sorted(r.k for r in guards.admitted(spark, f"{folder}/ledger").collect())
    assert read() == ["a", "b", "c"]
    for files in ("kept", "lost"):  # the job ended before the last epoch was committed, after or before its files were written
        for side in glob.glob(f"{folder}/checkpoint/commits/*1") + glob.glob(f"{folder}/checkpoint/commits/.1*"):
            os.remove(side)
        before = set(glob.glob(f"{folder}/ledger/*/*"))
        if files == "lost":
            shutil.rmtree(f"{folder}/ledger/epoch=1")
        guards.admit_once(stream, folder, ["k"])
        assert read() == ["a", "b", "c"] and (files == "lost" or set(glob.glob(f"{folder}/ledger/*/*")) == before)


def test_the_first_arrival_counts(spark):
    """A later or larger row of one id never replaces the first, whatever it says."""
    seen = []
    for stream, folder in arrivals(spark, [[("a", "r", "reader", "7", None), ("a", "r", "reader", "5", None)], [("a", "r", "reader", "1", None), ("b", "r", "reader", "2", None)]], CALLS):
        seen.append({r.attempt_id: r.cost_nano for r in guards.stream_charge_once(stream, folder, ["cost_nano"]).collect()})
    assert seen == [{"a": "5"}, {"a": "5", "b": "2"}]


def test_work_of_a_batch_does_not_grow_with_the_ledger(spark):
    source, folder = new_folder(spark, "source"), new_folder(spark, "stream")
    found = []
    for n in range(4):
        spark.range(n * 3000, n * 3000 + (3000 if n < 3 else 50)).selectExpr("concat('k', id) as k", "id % 7 as run_id").coalesce(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, run_id bigint").parquet(source)
        query = guards.run_batches(guards.first_arrivals(stream, ["k"]), folder, guards.admission_writer(f"{folder}/ledger"), "update")
        step = last_progress(query)[-1]
        state = step["stateOperators"][0]
        found.append((step["numInputRows"], state["numRowsUpdated"], state["numRowsTotal"]))
        assert "RocksDB" in spark.conf.get(guards.STATE_STORE)
    assert found == [(3000, 3000, 3000), (3000, 3000, 6000), (3000, 3000, 9000), (50, 50, 9050)]
    once, path = guards.admitted(spark, f"{folder}/ledger"), folder
    first = {r.run_id: r.n for r in guards.running(once, path, ["run_id"], F.count(F.lit(1)).alias("n")).collect()}
    spark.createDataFrame([("new", 3), ("k5", 3)], "k string, run_id bigint").write.mode("append").parquet(source)
    guards.admit_once(spark.readStream.schema("k string, run_id bigint").parquet(source), folder, ["k"])
    again = {r.run_id: r.n for r in guards.running(once, path, ["run_id"], F.count(F.lit(1)).alias("n")).collect()}
    assert again == {**first, 3: first[3] + 1}
    assert spark.read.parquet(f"{folder}/running/rows/epoch={guards.epochs(spark, f'{folder}/running/rows')[-1]}").count() == 1  # only the touched run


def test_snapshots_of_updates(spark, monkeypatch):
    monkeypatch.setattr(guards, "KEEP_EPOCHS", 3)
    path, want = new_folder(spark, "updates"), {}
    for epoch in range(8):
        rows = [(k, epoch * 10 + k) for k in range(epoch % 3, 5)]
        guards.update_writer(path)(spark.createDataFrame(rows, "k int, v int"), epoch)
        want.update(rows)
        assert {r.k: r.v for r in guards.newest(spark, path, ["k"]).collect()} == want
    assert guards.epochs(spark, f"{path}-whole") == [2, 5]


def test_progress_completes_with_a_late_row(spark):
    runs = spark.createDataFrame([("r", 3)], "run_id string, expected_count bigint")
    states = []
    for stream, folder in arrivals(spark, [[("r", "x"), ("r", "y")], [("r", "x")], [("r", "z")]], "run_id string, fingerprint string"):
        states += [(r.completed, r.complete) for r in guards.stream_run_progress(stream, runs, folder).collect()]
    assert states == [(2, False), (2, False), (3, True)]


OUTCOMES = "run_id string, vendor string, created_ms bigint, outcome_id string, exhausted boolean"


def test_late_outcomes_find_their_place(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice("uv"), rng.randrange(0, 4_000_000), str(i), rng.random() < 0.7) for i in range(300)]
    parts = [rows[i::5] + rows[:20] for i in range(5)]  # in no order of time, some again and again
    for n, (stream, folder) in enumerate(arrivals(spark, parts, OUTCOMES)):
        got = guards.stream_circuit_breaker(stream, folder, block_ms=50_000).collect()
        so_far = spark.createDataFrame(sorted({r for p in parts[:n + 1] for r in p}), OUTCOMES)
        want = {(r.run_id, r.vendor): (r.failures, r.longest, r.code is not None) for r in ledger.circuit_state(so_far).collect()}
        assert {(r.run_id, r.vendor): (r.failures, r.longest, r.tripped) for r in got} == want


def test_circuit_writes_touched_blocks_only(spark):
    for stream, folder in arrivals(spark, [[("r", "v", t, str(t), True) for t in range(0, 500_000, 10_000)], [("r", "v", 70_001, "late", False)]], OUTCOMES):
        out = guards.stream_circuit_breaker(stream, folder).collect()
    assert [(r.failures, r.longest, r.tripped) for r in out] == [(42, 42, True)]
    assert [r.block for r in spark.read.parquet(f"{folder}/blocks/epoch=1").collect()] == [1]


@settings(deadline=None, max_examples=25)
@given(st.lists(st.booleans(), max_size=12), st.integers(0, 12))
def test_summaries_join_in_any_grouping(spark, outcomes, cut):
    def of(rows):
        n, reset = len(rows), not all(rows)
        runs = [len(x) for x in "".join("x" if r else " " for r in rows).split()]
        lead = next((i for i, r in enumerate(rows) if not r), n)
        tail = next((i for i, r in enumerate(rows[::-1]) if not r), n)
        return n, lead, tail, max(runs, default=0), reset

    one = lambda rows: guards.summary(*map(F.lit, of(rows)))
    assert tuple(spark.range(1).select(guards.joined(one(outcomes[:cut]), one(outcomes[cut:])).alias("s")).first().s) == of(outcomes)


def test_correlation_reads_each_line_once(spark):
    line = lambda i, status: f'{{"custom_id":"c{i}","response":{{"status_code":{status},"body":{{}}}},"error":null}}'
    schema = "batch_id bigint, file_id string, row_order bigint, line string"
    parts = [[(i % 3, "f", i, line(i, 200 if i % 4 else 500)) for i in range(lo, lo + 20)] for lo in (0, 20, 40)] + [[(1, "g", 1, line(4, 200)), (2, "g", 2, "broken")]]
    expected = spark.createDataFrame([(i % 3, f"c{i}") for i in range(70)], "batch_id bigint, custom_id string")
    batches = spark.createDataFrame([(0, "completed"), (1, "expired"), (2, "in_progress")], "batch_id bigint, status string")
    for n, (stream, folder) in enumerate(arrivals(spark, parts, schema)):
        got = {tuple(r) for r in guards.stream_correlation(stream, expected, batches, folder).collect()}
        so_far = spark.createDataFrame([r for p in parts[:n + 1] for r in p], schema)
        assert got == {tuple(r) for r in guards.correlate_staged(so_far, expected, batches).collect()}
    assert spark.read.parquet(f"{folder}/requests/epoch=3").count() == 2  # only what the last part touched
    assert {c for _, _, c, _ in got} == {None, "E_BATCH_DOCUMENT", "E_BATCH_MISSING_RESULT", "E_BATCH_EXPIRED", "E_BATCH_DUPLICATE_RESULT"}


def test_json_is_one_whole_value(spark):
    good = ['{"a":1}', "[1,2]", "1", '"x"', "null", ' {"a":1} ']
    good += ['["\ue000end"]', '{"\ue000end":["\ue000end"]}', '"]"', '"a, \\"b\\""']
    bad = ['1,"\ue000end"', '1,"\ue000end"],[2', '{"a":1},"\ue000end"', '[1],"\ue000end"]', '1,"\\ue000end"', '"a"b', '1 //', '[1,]', '{"a":1],"b":[2}', "01", "+1", "NaN", "'a'", '{a:1}', '1,"\ue000', '{"a":1}],[garbage', '{"a":1}] trailing', "1,2", '{"a":1},"w":2', '{"a":1}}', '{"a":1} x', "", '{"a":1},{"b":2}', '{"a":1}],"q":[2', "[1]],[[1]"]
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", j.parse(F.col("t")).isNotNull().alias("ok")).collect()
    assert {r.t for r in rows if r.ok} == set(good)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host"})

    with pytest.raises(ValueError):
        shared_folder(Fake())


LEDGER = "run_id string, attempt_id string, role string, status int, cost_nano string, created_at timestamp_ntz"


def test_a_refresh_reads_only_what_was_appended(spark, monkeypatch):
    from datetime import datetime

    from pigeonhole.operators import accounting, budgets
    from pigeonhole.sources import ledger as store
    from pigeonhole.streaming import maintained

    monkeypatch.setattr(maintained, "KEEP_PARTS", 3)
    rng, folder, opened, rows = random.Random(4), new_folder(spark, "maintained"), [], []
    real = store.read_appends
    monkeypatch.setattr(store, "read_appends", lambda s, path, log, *a: opened.append((path.rpartition("/")[2], len(log))) or real(s, path, log, *a))
    assert maintained.run_calls(spark, f"{folder}/calls", f"{folder}/figures") is None
    for part in range(6):
        new = [(f"r{rng.randrange(4)}", f"a{part}-{i}", rng.choice(["reader", "confidence", "recovery", "batch_metadata"]), rng.choice([200, 500, None]), None, datetime(2024, 1, 1 + rng.randrange(20))) for i in range(12)]
        new = [(r, a, role, s, "0" if role == "batch_metadata" else rng.choice(["5", "12345678901234567890", None]), t) for r, a, role, s, _, t in new]
        rows += new
        store.append_immutable(spark.createDataFrame(new, LEDGER), f"{folder}/calls", ["attempt_id"])
        opened.clear()
        got = {r.run_id: r for r in maintained.run_calls(spark, f"{folder}/calls", f"{folder}/figures").collect()}
        assert [x for x in opened if x[0] == "calls"] == [("calls", 1)] and all(n <= 5 for _, n in opened)
        all_rows = spark.createDataFrame(rows, LEDGER)
        spend = {r.run_id: (r.blended, r.openai, r.typesafe) for r in budgets.vendor_spend(all_rows).collect()}
        unknown = {r.run_id: r.unaccounted for r in accounting.unaccounted_calls(all_rows).collect()}
        health = {r.run_id: (r.status, r.latest_role, r.latest_at) for r in ledger.vendor_health(all_rows, ["run_id"]).collect()}
        assert {k: (r.blended, r.openai, r.typesafe) for k, r in got.items() if r.blended} == {k: v for k, v in spend.items() if v[0]}
        assert {k: r.unaccounted for k, r in got.items() if r.unaccounted} == unknown and {k: (r.status, r.latest_role, r.latest_at) for k, r in got.items()} == health
    assert [c.least[0] for c in store.commits(spark, f"{folder}/figures")].count("whole") == 1
