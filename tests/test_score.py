import pytest
from conftest import ENT, ent
from pyspark.sql import functions as F

from spanlake.operators.score import (EntityGate, compare, record_score, record_score_stats, split_records, split_summary)


def recs(spark, *lists):
    return spark.createDataFrame([(i, [ent("L", score=s) for s in xs]) for i, xs in enumerate(lists)], f"row_idx long, entities {ENT}")


@pytest.mark.parametrize("how,want", [("mean", 0.5), ("max", 0.8), ("median", 0.5), ("p75", 0.6)])
def test_aggregations(spark, how, want):
    df = recs(spark, [0.2, 0.4, 0.6, 0.8])
    assert record_score(df, how=how).head().record_score == pytest.approx(want)


def test_p75_is_half_even(spark):
    # positions (n-1)*0.75 = 1.5 and 4.5 round to 2 and 4
    df = recs(spark, [0.1, 0.2, 0.3], [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7])
    assert [r.record_score for r in record_score(df, how="p75").orderBy("row_idx").collect()] == [0.3, 0.5]


def test_empty_policies_and_trace(spark):
    df = recs(spark, [], [None, 0.5])
    r = record_score(df, alias="score_relato").orderBy("row_idx").collect()
    assert (r[0].record_score, r[0]._record_score_meta.is_empty) == (0.0, True)
    assert (r[1].score_relato, r[1]._record_score_meta.valid_scores, r[1]._record_score_meta.invalid_scores) == (0.5, 1, 1)
    assert record_score(df, empty="null").orderBy("row_idx").head().record_score is None
    with pytest.raises(Exception, match="no valid entity score"):
        record_score(df, empty="error").collect()
    s = record_score_stats(record_score(df)).head()
    assert (s.records_total, s.records_empty, s.valid_scores, s.invalid_scores, s.score_max) == (2, 1, 1, 1, 0.5)


def test_ner_fallback(spark):
    df = spark.createDataFrame([(0, None, [ent(score=0.4)]), (1, [], [ent(score=0.9)])], f"row_idx long, entities {ENT}, ner {ENT}")
    assert [r.record_score for r in record_score(df).orderBy("row_idx").collect()] == [0.4, 0.0]


def test_operators_and_nan(spark):
    df = spark.createDataFrame([(0.3,), (0.5,), (float("nan"),), (None,)], "v double")
    got = {op: [r.x for r in df.select(compare(F.col("v"), 0.5, op).alias("x")).collect()] for op in ("ge", "gt", "le", "lt")}
    assert got == {"ge": [False, True, False, False], "gt": [False] * 4, "le": [True, True, False, False], "lt": [True, False, False, False]}
    with pytest.raises(ValueError):
        compare(F.col("v"), 0.5, "eq")


def test_fallback_only_when_key_absent(spark):
    raw = ['{"id":0,"record_score":"bad","fb":0.9}', '{"id":1,"fb":0.9}', '{"id":2}', '{"id":3,"record_score":null,"fb":0.9}', '{"id":4,"fb":"x"}']
    df = spark.createDataFrame([(r,) for r in raw], "_raw string").withColumn(
        "p", F.from_json("_raw", "id int, record_score string, fb string")).select("_raw", "p.*")
    rows = {r.id: r for r in split_records(df, threshold=0.5, fallback="fb", missing="zero", raw="_raw").collect()}
    assert {i: (r.decision, r._split.score_source, r._split.missing_reason) for i, r in rows.items()} == {
        0: ("discarded", "implicit_zero", "invalid_primary_score"), 1: ("kept", "fb", None),
        2: ("discarded", "implicit_zero", "missing_score_fields"), 3: ("discarded", "implicit_zero", "invalid_primary_score"),
        4: ("discarded", "implicit_zero", "invalid_fallback_score")}
    dropped = split_records(df, threshold=0.5, missing="discard", raw="_raw")
    assert split_summary(dropped).head().missing_scores == 5
    with pytest.raises(Exception, match="missing or invalid"):
        split_records(df, missing="error", raw="_raw").collect()


def test_gate(spark):
    df = spark.createDataFrame([(0, 0.7, [ent("Location", score=0.4), ent("Person", score=0.9)]), (1, 0.35, [ent("Location", score=0.61)]),
                                (2, 0.9, [ent("Person", score=0.9)]), (3, 0.1, [ent("Location", score=0.1)])],
                               f"id int, record_score double, entities {ENT}")
    out = split_records(df, threshold=0.3, gate=EntityGate(labels=["Location"], threshold=0.5, how="max"))
    rows = {r.id: r for r in out.collect()}
    assert {i: r.decision for i, r in rows.items()} == {0: "discarded", 1: "kept", 2: "discarded", 3: "discarded"}
    assert rows[2]._split.entity_gate.gate_missing_reason == "no_matching_entities"
    assert rows[3]._split.entity_gate.gate_decision is None  # not evaluated
    assert rows[1]._split.entity_gate.matched_entities[0].score == 0.61
    s = split_summary(out).head()
    assert (s.records_total, s.kept_count, s.discarded_count, s.entity_gate_rejections) == (4, 1, 3, 2)
    assert (s.kept_score_mean, s.discarded_score_max) == (0.35, 0.9)
