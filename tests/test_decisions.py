import itertools

import pytest
from pyspark.sql import functions as F

from pigeonhole import constants as k
from pigeonhole.operators import decisions

SCHEMA = ("id int, type_ids array<string>, threshold double, failures array<string>, notes array<string>, note_policy string, state_policy string, "
          "choice string, certainty double, noul map<string,double>, reader_yes array<string>")


def frame(spark, rows):
    base = dict(type_ids=["type_a", "type_b"], threshold=0.9, failures=[], notes=[], note_policy=None, state_policy=k.STATE_V3,
                choice="type_a", certainty=0.9, noul={"type_a": 0.5, "type_b": 0.0}, reader_yes=["type_a"])
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({**base, "id": i, **r}[n] for n in names) for i, r in enumerate(rows)], SCHEMA)


def test_all_combinations(spark):
    rows, want = [], []
    for failed, noted, choice, certainty, a, b, yes in itertools.product(
            (False, True), (False, True), ("type_a", "type_b", "none_of_these"), (0.0, 0.899999, 0.9, 1.0), (0.0, 0.499999, 0.5, 1.0),
            (0.0, 0.499999, 0.5, 1.0), ([], ["type_a"], ["type_b"], ["type_a", "type_b"])):
        rows.append(dict(failures=["E_ONE"] if failed else [], notes=["N_ONE"] if noted else [], choice=choice, certainty=certainty,
                         noul={"type_a": a, "type_b": b}, reader_yes=yes))
        agrees = yes == [choice] and {"type_a": a, "type_b": b}[choice] >= 0.5
        want.append("R0" if failed else "R0n" if noted else ("R1" if certainty >= 0.9 else "R2") if agrees else "R3" if len(yes) > 1
                    else "R4" if not yes and choice == "none_of_these" and max(a, b) < 0.5 else "R5")
    assert len(rows) == 3072
    out = decisions.decide(frame(spark, rows)).orderBy("id").select("rule_id", "outcome", "destination_folder", "choice", "priority").collect()
    assert [r.rule_id for r in out] == want
    for r in out:
        assert (r.outcome == "filed") == (r.rule_id == "R1")
        assert r.destination_folder == {"R0": "could_not_process", "R1": r.choice}.get(r.rule_id, "human_review")
        assert r.priority == (1 if r.rule_id == "R5" else None)


@pytest.mark.parametrize("policy,note,rule", [
    (None, "N_NO_OUTLINE", "R0n"), (k.NOTES_STRUCTURAL_INFO, "N_NO_OUTLINE", "R1"), (k.NOTES_STRUCTURAL_INFO, "N_OUTLINE_RECOVERED", "R1"),
    (k.NOTES_STRUCTURAL_INFO, "N_EXTRACTOR_VERSION_MIXED", "R0n"), (k.NOTES_ALL, "N_OUTLINE_RECOVERED", "R0n")])
def test_note_policies(spark, policy, note, rule):
    assert decisions.decide(frame(spark, [dict(notes=[note], note_policy=policy)])).first().rule_id == rule


def test_unknown_note_policy_raises(spark):
    with pytest.raises(Exception, match="Unknown note policy"):
        decisions.decide(frame(spark, [dict(notes=["N_X"], note_policy="v9")])).collect()


def test_input_findings(spark):
    nan = float("nan")
    rows = [{}, dict(certainty=nan), dict(threshold=1.1), dict(type_ids=["type_a", "type_a"]), dict(type_ids=["none_of_these"]), dict(choice="type_c"),
            dict(noul={"type_a": 0.1}), dict(noul={"type_a": nan, "type_b": 0.1}), dict(reader_yes=["type_a", "type_a"]), dict(reader_yes=["type_x"]),
            dict(note_policy="v9"), dict(note_policy=k.NOTES_STRUCTURAL_INFO, state_policy=None),
            dict(failures=["E_X"], choice=None, certainty=None, noul=None, reader_yes=None), dict(notes=[""])]
    found = {r.id: r.detail for r in decisions.validate_decision_inputs(frame(spark, rows), ["id"]).collect()}
    assert sorted(found) == [i for i in range(14) if i not in (0, 12)]
    assert found[1] == found[1] and "certainty" in found[1] and "scores" in found[7]


def test_tags_grow_past_four_digits(spark):
    docs = spark.range(12_000).select(F.lit("run-abcdefgh-more").alias("run_id"), (F.col("id") * 3).alias("preflight_order"))
    out = decisions.assign_tags(docs, block_size=1_000).orderBy("preflight_order").select("tag").collect()
    assert out[0].tag == "rrun-abcd-0001" and out[9_999].tag == "rrun-abcd-10000" and out[11_999].tag == "rrun-abcd-12000"
    assert len({r.tag for r in out}) == 12_000
