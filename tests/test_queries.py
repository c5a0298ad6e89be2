"""Every registered query against its SQL in DuckDB, on the smallest data folder."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import check
from pigeonhole.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    _, _, status = check.compare(spark, con, FOLDER, name, QUERIES[name], SQL.get(name))
    assert status in ("ok", "rows only"), status


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["run_id", "rule_id", "documents", "reviewed"] and df.count() > 0


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_entry_registers_them():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_suggested_headings_are_chosen_inside_the_row(spark):
    from pigeonhole.plans import outline_queries, views

    plan = outline_queries.candidates(views.Inputs(spark, FOLDER))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # text with its identity


def test_verified_headings_shuffle_the_texts_only(spark):
    plan = QUERIES["recovered_notes"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the same one for either side


def test_verified_headings_of_odd_rows(spark):
    from pigeonhole.operators import outline

    docs = spark.createDataFrame([("r", "a", "x\r\ny\nx"), ("r", "b", None), ("r", None, "x")], "run_id string, fingerprint string, text string")
    asked = spark.createDataFrame([("r", "a", 0, "x"), ("r", "a", 0, "x"), ("r", "a", 1, "y "), ("r", "a", 2, None), ("r", "a", None, "y"), ("r", "a", 3, "x"),
                                   ("r", "b", 0, "x"), ("r", "c", 0, "x"), ("r", None, 0, "x")], "run_id string, fingerprint string, candidate_index int, candidate string")
    found = outline.verify_recovered_headings(docs, asked, ["run_id", "fingerprint"]).collect()
    assert sorted(((r.fingerprint, r.candidate_index, r.candidate, r.positions, r.reason) for r in found), key=repr) == sorted([
        ("a", 0, "x", [0, 5], None), ("a", 1, "y ", [], "not_an_exact_line"), ("a", 2, None, [], "not_an_exact_line"), ("a", None, "y", [3], None),
        ("a", 3, "x", [0, 5], None), ("b", 0, "x", [], "not_an_exact_line")], key=repr)


def test_states_take_texts_that_are_shuffled_by_their_keys_only(spark):
    from pigeonhole.plans import outline_queries, views

    t = views.Inputs(spark, FOLDER)
    plan = outline_queries.nested(t)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan and "v_ids" not in plan
    named = views.texts(t).select("run_id", "fingerprint", "doc_id", "text", outline_queries.file_name().alias("original_filename"))
    docs = t.view("v_docs").select(*named.columns)
    assert named.exceptAll(docs).isEmpty() and docs.exceptAll(named).isEmpty()
