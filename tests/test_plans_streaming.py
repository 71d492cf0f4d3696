import json

import pytest
from conftest import ENT, ent
from pyspark.sql import functions as F

from spanlake.operators.boost import BoostConfig
from spanlake.operators.calibrate import Calibrator
from spanlake.operators.score import EntityGate
from spanlake.plans.cycle import CycleConfig, prepare_next_iteration, pseudolabel_cycle, score_and_split
from spanlake.plans.evaluation import evaluate_predictions
from spanlake.plans.training import training_manifest, training_windows
from spanlake.streaming import accumulate_kept, dedupe_stream, score_stream, write_decisions
from test_extract import capital_tagger


@pytest.fixture
def corpus(spark):
    rows = [(i, f"Rua Faia {i % 3} no Centro", "Centro" if i % 2 else None, [ent("Location", "Centro", score=0.3 + 0.05 * i), ent("Person", "Ana", score=.5)]) for i in range(10)]
    return spark.createDataFrame(rows, f"row_idx long, relato string, bairroLocal string, entities {ENT}").withColumn("text", F.col("relato"))


def test_cycle(corpus):
    cfg = CycleConfig(calibrator=Calibrator("temperature", temperature=1.0), threshold=0.55, gate=EntityGate(threshold=0.5, score_field="score_context_boosted"))
    c = pseudolabel_cycle(corpus, cfg)
    s = c.summary.head()
    assert s.records_total == 10 and s.kept_count + s.discarded_count == 10 and 0 < s.kept_count < 10
    assert c.boost_stats.head().records_with_context_match == 5 and c.boost_details.count() == 10
    assert c.score_stats.head().valid_scores == 20
    src = {e._context_boost_score_source for r in c.records.collect() for e in r.entities}
    assert src == {"score_calibrated"}


def test_cycle_with_tagger(spark):
    df = spark.createDataFrame([(0, "Ana foi", "Centro"), (1, "nada", None)], "row_idx long, relato string, bairroLocal string")
    out = pseudolabel_cycle(df, CycleConfig(boost=None, threshold=0.5), capital_tagger).records.orderBy("row_idx").collect()
    assert [e.text for e in out[0].entities] == ["Ana", "Centro"] and [r.decision for r in out] == ["kept", "discarded"]


def test_plan_has_no_shuffle(corpus):
    import io
    from contextlib import redirect_stdout
    text = io.StringIO()
    with redirect_stdout(text):
        score_and_split(corpus, CycleConfig()).explain()
    assert "Exchange" not in text.getvalue() and "Python" not in text.getvalue()


def test_next_iteration(spark):
    df = spark.createDataFrame([(0, "a", " x ", "c"), (1, "a", " ", "c"), (2, "b", " x ", "c"), (3, "a", " x ", "c"), (4, None, None, None)],
                               "row_idx long, assunto string, relato string, bairroLocal string")
    out, counts = prepare_next_iteration(df, ["assunto", "relato", "bairroLocal"], dedupe_on=["assunto", "relato"])
    assert sorted(r.row_idx for r in out.collect()) == [0, 2]
    c = counts.head()
    assert (c.input_rows, c.dropped_missing_required, c.dropped_duplicate, c.output_rows) == (5, 2, 1, 2)
    per = prepare_next_iteration(df.withColumn("file", F.when(F.col("row_idx") < 3, "f1").otherwise("f2")), ["relato"], [], ["relato"], per_file="file")
    assert {r.file: (r.dropped_empty_relato, r.output_rows) for r in per.counts.collect()} == {"f1": (1, 1), "f2": (1, 1)}


def test_manifest(spark):
    raw = "array<struct<start:int,end:int,label:string>>"
    mk = lambda p, n: spark.createDataFrame([(i, f"{p}{i}", [(0, 1, "Person")] if i % 5 else []) for i in range(n)], f"row_idx long, text string, entities {raw}")
    m = training_manifest(mk("s", 20), mk("p", 10), sample_ratio=0.5, ratio=0.25)
    got = {(r.role, r.training_source): r.n for r in m.sources.collect()}
    assert got == {("train", "supervised"): 12, ("validation", "supervised"): 4, ("train", "pseudolabel"): 4}
    assert {(r.source, r.reason): r.n for r in m.counts.collect()}["supervised", "kept_records"] == 16
    v = training_manifest(mk("s", 20), None, "supervised_only", validation=mk("v", 5))
    assert {(r.role, r.training_source): r.n for r in v.sources.collect()} == {("train", "supervised"): 16, ("validation", "validation"): 4}
    with pytest.raises(ValueError):
        training_manifest(None, mk("p", 3))


def test_windows_and_folds(spark):
    sp = "array<struct<start:int,end:int,label:string>>"
    df = spark.createDataFrame([(f"s{i}", "aa bb cc dd ee", [(0, 2, "A"), (12, 14, "B")]) for i in range(6)] + [("e", "x", [])], f"sample_id string, text string, spans {sp}")
    w = training_windows(df, k=3, max_length=3, overlap=1)
    rows = w.collect()
    assert len(rows) == 12 and {r.fold for r in rows} == {1, 2, 3}
    assert all(len({r.fold for r in rows if r.sample_id == s}) == 1 for s in {r.sample_id for r in rows})


def test_evaluation_plan(spark):
    g = spark.createDataFrame([(0, 0, 4, "Person"), (1, 0, 4, "Person")], "row_idx long, start int, end int, label string")
    p = spark.createDataFrame([(0, 0, 4, "Person", .8), (1, 0, 4, "Person", .3), (1, 9, 12, "Person", .2)], "row_idx long, start int, end int, label string, score double")
    e = evaluate_predictions(g, p, ["Person"])
    assert e.thresholds.head().best_threshold == .25 and {r.label: r.f1 for r in e.metrics.collect()}["micro"] == 1.0
    assert e.review.count() == 2 and e.outcomes.head().tp == 2


def stream_of(spark, corpus, tmp_path, parts=3):
    folder = str(tmp_path / "in")
    corpus.repartition(parts).write.parquet(folder)
    return spark.readStream.schema(corpus.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_equals_batch(spark, corpus, tmp_path):
    cfg = CycleConfig(threshold=0.5)
    q = write_decisions(score_stream(stream_of(spark, corpus, tmp_path), cfg), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    batch = {(r.row_idx, r.decision, r.record_score) for r in score_and_split(corpus, cfg).collect()}
    assert {(r.row_idx, r.decision, r.record_score) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch


def test_accumulated_set_has_each_text_once(spark, corpus, tmp_path):
    scored = score_stream(stream_of(spark, corpus, tmp_path), CycleConfig(threshold=0.0))
    accumulate_kept(scored, str(tmp_path / "acc"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "acc"))
    assert rows.count() == 3 and rows.select("text").distinct().count() == 3
    # a second run over the same input has nothing new
    accumulate_kept(scored, str(tmp_path / "acc"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "acc")).count() == 3


def test_dedupe_stream(spark, corpus, tmp_path):
    q = (dedupe_stream(score_stream(stream_of(spark, corpus, tmp_path))).writeStream.format("parquet").option("path", str(tmp_path / "o"))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3


def test_accumulated_set_over_many_batches(spark, corpus, tmp_path):
    """One file a batch, copies across batches: every text once, whatever came before, and nothing twice after a restart."""
    folder, out, cp = tmp_path / "in", str(tmp_path / "acc"), str(tmp_path / "cp")
    for i in range(3):
        corpus.withColumn("text", F.concat("text", F.lit(f" {i // 2}"))).coalesce(1).write.mode("append").json(str(folder))
    source = spark.readStream.schema(corpus.schema).option("maxFilesPerTrigger", 1).json(str(folder))
    scored = score_stream(source, CycleConfig(threshold=0.0))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    query = accumulate_kept(scored, out, cp)
    query.awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    assert [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]][-1] == 6  # digests, not rows
    rows = spark.read.parquet(out)
    assert rows.count() == 6 == rows.select("text").distinct().count() and rows.select("batch_id").distinct().count() >= 2
    corpus.withColumn("text", F.concat("text", F.lit(" 0"))).coalesce(1).write.mode("append").json(str(folder))
    accumulate_kept(scored, out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == 6


def test_a_repeated_batch_changes_nothing(spark, corpus, tmp_path):
    """The last batch is done again, as after a crash between its write and its commit."""
    folder, out, cp = str(tmp_path / "in"), str(tmp_path / "acc"), tmp_path / "cp"
    corpus.coalesce(1).write.json(folder)
    scored = score_stream(spark.readStream.schema(corpus.schema).json(folder), CycleConfig(threshold=0.0))
    accumulate_kept(scored, out, str(cp)).awaitTermination()
    first = sorted(r.text for r in spark.read.parquet(out).collect())
    for done in (cp / "commits").iterdir():
        if not done.name.startswith("."):
            done.rename(tmp_path / done.name)
    for crc in (cp / "commits").glob(".*.crc"):
        crc.rename(tmp_path / f"crc-{crc.name}")
    accumulate_kept(scored, out, str(cp)).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == first


def test_observed_measures(spark, monkeypatch):
    from spanlake.operators import staging
    df = spark.range(1000, numPartitions=7).withColumn("k", F.col("id") % 3)
    measures = {"rows": F.count(F.lit(1)), "zeros": F.count_if(F.col("k") == 0), "total": F.sum("id")}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", "mine")
    table, got = staging.observed(df, "watched", **measures)
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "mine"
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {"rows": 1000, "zeros": 334, "total": 499500} and table.count() == 1000
    monkeypatch.setattr(staging, "_ran_once", lambda *_: False)  # a task ran again: the table itself is asked
    assert staging.observed(df, "watched", **measures)[1] == got


def test_repeated_tasks_are_noticed(spark):
    from types import SimpleNamespace as N
    from spanlake.operators.staging import _ran_once
    stage = lambda **k: N(**{"currentAttemptId": 0, "numFailedTasks": 0, "numCompletedTasks": 4, "numTasks": 4, **k})
    context = lambda s: N(statusTracker=lambda: N(getJobIdsForGroup=lambda g: [1], getJobInfo=lambda j: N(stageIds=[5]), getStageInfo=lambda i: s))
    assert _ran_once(context(stage()), "g")
    assert not any(_ran_once(context(stage(**k)), "g") for k in ({"currentAttemptId": 1}, {"numFailedTasks": 1}, {"numCompletedTasks": 5}))


def test_training_windows_read_the_records_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(i, f"g{i % 5}", "Ana mora em Rio", [(0, 3, "Person"), (12, 15, "Location")]) for i in range(20)],
                               "row_idx int, sample_id string, text string, spans array<struct<start:int,end:int,label:string>>")
    w = training_windows(df.mapInArrow(count, df.schema), k=3, max_length=3, overlap=1).collect()
    assert seen.value == 20
    assert len(w) == 40 and {r.fold for r in w} == {1, 2, 3} and len({(r.sample_id, r.fold) for r in w}) == 5
