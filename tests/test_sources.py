import glob

import pytest
from pyspark.sql import functions as F

from pigeonhole.functions.checks import BlockerError
from pigeonhole.session import new_folder
from pigeonhole.sources import batches, config, files, ledger


def test_append_is_create_only(spark):
    folder = new_folder(spark, "append")
    rows = lambda *ids: spark.createDataFrame([("r", i) for i in ids], "run_id string, key string")
    ledger.append_immutable(rows("a", "b"), f"{folder}/t", ["key"], f"{folder}/receipts")
    with pytest.raises(BlockerError):
        ledger.append_immutable(rows("b", "c"), f"{folder}/t", ["key"])
    with pytest.raises(BlockerError):
        ledger.append_immutable(rows("d", "d"), f"{folder}/t", ["key"])
    assert sorted(r.key for r in ledger.read_committed(spark, f"{folder}/t").collect()) == ["a", "b"]
    assert {r.state for r in ledger.artifact_states(spark.read.parquet(f"{folder}/receipts"), ["key"]).collect()} == {"complete"}


def test_of_two_writers_of_one_key_one_fails_without_a_trace(spark, monkeypatch):
    path = new_folder(spark, "append")
    rows = lambda *ids: spark.createDataFrame([("r", i) for i in ids], "run_id string, key string")
    real, others = ledger.commit, [("b", "x"), ("d",)]

    def late(spark, place, number, entry):
        if others:  # both writers have passed the first test and written; the other one commits first
            ids = others.pop(0)
            monkeypatch.setattr(ledger, "commit", real)
            ledger.append_immutable(rows(*ids), place, ["key"])
            monkeypatch.setattr(ledger, "commit", late)
        return real(spark, place, number, entry)

    monkeypatch.setattr(ledger, "commit", late)
    with pytest.raises(BlockerError):
        ledger.append_immutable(rows("a", "b"), path, ["key"])
    ledger.append_immutable(rows("e"), path, ["key"])  # the other writer's key is another one: the next number is taken
    assert sorted(r.key for r in ledger.read_committed(spark, path).collect()) == ["b", "d", "e", "x"]
    assert [int(c.number) for c in ledger.commits(spark, path)] == [0, 1, 2]
    assert len(glob.glob(f"{path}/appends/*")) == 3  # what was refused is gone


def test_an_append_opens_only_what_may_hold_its_keys(spark, monkeypatch):
    path, opened = new_folder(spark, "append"), []
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("'r' as run_id", "lpad(id, 4, '0') as key")
    for lo in range(0, 500, 100):
        ledger.append_immutable(rows(lo, lo + 100), path, ["run_id", "key"])
    real = ledger.read_appends
    monkeypatch.setattr(ledger, "read_appends", lambda *a: opened.append([c.number for c in a[2]]) or real(*a))
    ledger.append_immutable(rows(900, 950), path, ["run_id", "key"])
    assert opened == []
    with pytest.raises(BlockerError):
        ledger.append_immutable(rows(299, 300), path, ["run_id", "key"])
    assert opened == [["00000002"]]


def test_files_of_a_ledger_grow_with_its_rows_and_not_with_its_runs(spark):
    folder = new_folder(spark, "append")
    rows = spark.range(600).selectExpr("lpad(id % 300, 3, '0') as run_id", "cast(id as string) as key")  # 300 runs, named by digits
    ledger.append_immutable(rows, f"{folder}/calls", ["key"])
    ledger.save_ledger(rows, folder, "saved")
    for place in ("calls/appends", "saved"):
        assert len(glob.glob(f"{folder}/{place}/**/*.parquet", recursive=True)) <= 8
    assert {(r.run_id, r.key) for r in ledger.read_committed(spark, f"{folder}/calls").collect()} == {(f"{i % 300:03}", str(i)) for i in range(600)}
    assert sorted(r.key for r in ledger.load_ledger(spark, folder, "saved", ["007", "011"]).collect()) == ["11", "307", "311", "7"]


def test_manifest_is_written_once(spark):
    folder = new_folder(spark, "manifest")
    entries = spark.createDataFrame([("r", "t")], "run_id string, tag string")
    headers = spark.createDataFrame([("r", 1)], "run_id string, entries int")
    ledger.write_manifest(entries, headers, folder)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        ledger.write_manifest(entries, headers, folder)


def test_lines_numbers_and_utf8(spark, tmp_path):
    place = tmp_path / "batch_id=b1"
    place.mkdir()
    (place / "out.jsonl").write_bytes(b'{"custom_id":"a","response":null,"error":{"c":1}}\r\n\n\xff\xfe\n{"custom_id":"b","response":{"status_code":200,"body":{}},"error":null}')
    out = batches.read_batch_results(spark, str(tmp_path)).orderBy("line_number").collect()
    assert [(r.line_number, r.custom_id, r.line_code) for r in out] == [(1, "a", None), (2, None, "E_BATCH_RESULT"), (3, None, "E_BATCH_UTF8"), (4, "b", None)]
    assert {r.batch_id for r in out} == {"b1"}


def test_trees_need_name_and_header(spark, tmp_path):
    run = "0123abcd-0000-0000-0000-0123456789ab"
    for folder, name, text in (("good", f"build-summary-{run}.md", f"# Local build summary\n\nRun: {run}\nx"), ("fake", f"build-summary-{run}.md", "# Other"), ("named", "summary.md", f"# Local build summary\n\nRun: {run}\n")):
        (tmp_path / folder / "in").mkdir(parents=True)
        (tmp_path / folder / name).write_text(text)
        (tmp_path / folder / "in" / "a.pdf").write_text("x")
    found = files.scan_source_folder(spark, str(tmp_path))
    trees = files.discover_generated_trees(found)
    assert [(r.path, r.run_id) for r in trees.collect()] == [("good", run)]
    left = {r.path for r in files.exclude_generated_trees(found.select("path"), trees.select("path")).collect()}
    assert "good/in/a.pdf" not in left and {"fake/in/a.pdf", "named/in/a.pdf"} <= left


def test_any_bytes_after_the_header(spark):
    run = "0123abcd-0000-0000-0000-0123456789ab"
    head = f"# Local build summary\n\nRun: {run}\n".encode()
    rows = [(f"f{i}/build-summary-{run}.md", bytearray(head + b"x" * i + tail)) for i in range(2) for tail in ("é".encode() * 200,)] + [(f"g/build-summary-{run}.md", bytearray(head + b"\xff\xfe\x80" * 100))]
    found = files.discover_generated_trees(spark.createDataFrame(rows, "path string, content binary"))
    assert {(r.path, r.run_id) for r in found.collect()} == {("f0", run), ("f1", run), ("g", run)}


def test_type_files(spark):
    text = '{"types":[{"id":"a","name":"A","what":"w","not_for":"n","examples":["e"]}],"none_of_these":{"name":"None","what":"x"}}'
    df = spark.createDataFrame([(text,)], "value string")
    assert [(r.position, r.id, r.examples) for r in config.type_rows(df).collect()] == [(0, "a", ["e"])]
    assert config.none_rows(df).first().what == "x" and config.type_rows(df).first().type_version == config.none_rows(df).first().type_version


def test_load_types_and_packs(spark, tmp_path):
    types = '{"types":[{"id":"a","name":"A","what":"w","not_for":"n","examples":["e"]},{"id":"b","name":"B","what":"w","not_for":"n","examples":["e"]}],"none_of_these":{"name":"None","what":"x"}}'
    (tmp_path / "types").mkdir()
    (tmp_path / "types" / "one.json").write_text(types)
    (tmp_path / "packs").mkdir()
    (tmp_path / "packs" / "pack.json").write_text(
        '{\n "id":"p", "structuralVocabulary":["method"],\n "settings":{"minimumFiledCount":50,"pdfPolicy":{"gapRatio":1.5}},\n "limits":{"readerContextTokens":1050000},\n'
        ' "pins":{"reader":{"id":"gpt-6-sol","policy":"owner_approved_alias","date":"d","reason":"r"}},\n "typeFile":' + types + "}")
    assert [(r.position, r.id) for r in config.load_types(spark, str(tmp_path / "types")).orderBy("position").collect()] == [(0, "a"), (1, "b")]
    pack = config.load_packs(spark, str(tmp_path / "packs")).first()
    assert pack.structuralVocabulary == ["method"] and pack.settings["minimumFiledCount"] == "50" and pack.pins["reader"].policy == "owner_approved_alias"
    assert [x.id for x in pack.typeFile.types] == ["a", "b"] and pack.limits["readerContextTokens"] == "1050000"


def test_bucketed_tables_join_without_shuffle(spark):
    keys = ["run_id", "fingerprint"]
    df = spark.range(200).select(F.lit("r").alias("run_id"), F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"), F.lit("text").alias("text"))
    ledger.save_bucketed(df, "texts_bucketed", keys, 4)
    ledger.save_bucketed(df.withColumnRenamed("text", "answer"), "answers_bucketed", keys, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("texts_bucketed").join(spark.table("answers_bucketed"), keys)
        assert joined.count() == 200
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_files_are_hashed_in_pieces(spark, tmp_path):
    """A sparse file beyond what one value can hold, and the same hash for either way of reading."""
    import hashlib

    size = (3 << 30) + 5
    with open(tmp_path / "large.bin", "wb") as f:
        f.seek(size - 3)
        f.write(b"end")
    (tmp_path / "a b%.txt").write_bytes(b"x" * 1000)
    digest, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range(3 << 10):
        digest.update(zeros)
    digest.update(b"\0\0end")
    found = {r.path: (r.length, r.fingerprint) for r in files.scan_source_folder(spark, str(tmp_path)).select("path", "length", "fingerprint").collect()}
    assert found["large.bin"] == (size, digest.hexdigest())
    pieces = {r.path: r.fingerprint for r in files.scan_source_folder(spark, str(tmp_path), large=10).filter("length < 2000").select("path", "fingerprint").collect()}
    assert {p: f for p, (n, f) in found.items() if n < 2000} == pieces


def test_folders_are_listed_in_shares_and_texts_are_whole_files(spark):
    folder = new_folder(spark, "texts")
    rows = spark.range(400).select(F.concat(F.lit("a b%2F/part="), F.expr("id % 100").cast("string"), F.lit("/t.txt")).alias("path"), "id",
                                   F.when(F.col("id") % 7 > 0, F.concat(F.lit("é"), F.col("id").cast("string"))).alias("value"))
    files.write_texts(rows, folder, ["id"])
    group = folder.rsplit("/", 1)[1]
    spark.sparkContext.setJobGroup(group, "listing")
    found = files.scan_source_folder(spark, folder)
    spark.sparkContext.setJobGroup("", "")
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism
    line = lambda i: (f"é{i}" if i % 7 else "") + "\n"
    assert {r.path: bytes(r.content).decode() for r in found.collect()} == {
        f"a b%2F/part={p}/t.txt": "".join(line(i) for i in range(p, 400, 100)) for p in range(100)}


def test_lines_of_split_files_are_numbered_without_sorting_them(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(1, 4001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        read = batches.read_lines(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "hashpartitioning" not in plan
    found = read.collect()
    assert len(found) == 8000 and all(r.line[1:] == str(r.line_number) and r.file_id.endswith(r.line[0]) for r in found)
