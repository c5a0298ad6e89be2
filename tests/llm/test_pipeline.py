"""The pipeline's stages on small data, each held against brute force on its own input."""

import re

import duckdb
import pytest

import check
import corpus_pipeline as pipeline
from pigeonhole.llm import queries

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text.lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {}
    for name, stage in pipeline.STAGES[:-1]:
        held[name] = [r for r in stage(spark, docs, SF).collect()]
        before = {r.doc_id: r.text for r in docs.collect()}
        after = {r.doc_id: r.text for r in held[name]}
        assert set(after.items()) <= set(before.items()) and len(after) == len(held[name])
        if name == "exact dedup":
            norm = lambda t: re.sub("[\x20\x09-\x0D]+", " ", t)
            first = {}
            for d in sorted(before):
                first.setdefault(norm(before[d]), d)
            assert set(after) == set(first.values())
        if name == "near dedup":
            sets = {d: shingles(t) for d, t in before.items()}
            near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0
            for d in before:
                assert (d in after) != any(e < d and near(d, e) for e in before), d  # no longer chains in these data
        if name == "decontamination":
            assert set(after) == {d for d, t in before.items() if not any(i in t.lower() for i in items)}
        docs = spark.createDataFrame(held[name], docs.schema)
    packed = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in held["decontamination"]}


def test_registered_queries():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    assert check.compare(spark, con, SF, name, queries.QUERIES[name], queries.SQL[name])[2] == "ok"
