import json
import os

import pytest
from pyspark.sql import functions as F

from spanlake import sources as src
from spanlake.operators.splits import assign_chunks
from spanlake.sources.records import ground_truth_violations, with_sample_id
from spanlake.sources.sinks import chunk_manifest
from spanlake.sources.tables import calibration_rows


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return str(path)


ROWS = [{"id": 1, "text": "olá"}, {"id": 2, "text": "b\nc"}]


def test_three_layouts(spark, tmp_path):
    lines = write(tmp_path / "a.jsonl", "\n" + "\n\n".join(json.dumps(r, ensure_ascii=False) for r in ROWS) + "\n")
    array = write(tmp_path / "b.json", json.dumps(ROWS, indent=2))
    single = write(tmp_path / "c.json", json.dumps(ROWS[0], indent=2))
    get = lambda p: [(r.row_idx, r.id, r.text) for r in src.read_records(spark, p).orderBy("row_idx").collect()]
    assert get(lines) == get(array) == [(0, 1, "olá"), (1, 2, "b\nc")] and get(single) == [(0, 1, "olá")]
    assert get(write(tmp_path / "d.jsonl", json.dumps(ROWS[0]))) == [(0, 1, "olá")]


def test_bad_lines(spark, tmp_path):
    p = write(tmp_path / "x.jsonl", '{"a":1}\n\nnope\n[1]\n')
    with pytest.raises(ValueError, match="invalid JSONL at line 3; .*not a JSON object at line 4"):
        src.read_records_strict(spark, p)
    with pytest.raises(Exception, match="invalid JSON in row"):
        src.read_records(spark, p, layout="lines").collect()


def test_row_idx_is_input_order_over_many_splits(spark, tmp_path):
    n = 0
    for f, size in (("p1", 300), ("p2", 5), ("p3", 900)):
        write(tmp_path / "in" / f"{f}.jsonl", "".join(json.dumps({"n": n + i, "pad": "x" * 40}) + "\n" for i in range(size)))
        n += size
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = src.read_records(spark, str(tmp_path / "in"), schema=None)
        rows = df.collect()
        assert df.rdd.getNumPartitions() > 3 and len(rows) == n and all(r.row_idx == r.n for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_many_files_and_counts(spark, tmp_path):
    write(tmp_path / "m" / "a.jsonl", '{"t":"1"}\n{"t":"2"}\n')
    write(tmp_path / "m" / "b.jsonl", '{"t":"3"}\n')
    rows, counts = src.read_many(spark, str(tmp_path / "m" / "*.jsonl"))
    assert [r.t for r in rows.orderBy("row_idx").collect()] == ["1", "2", "3"]
    assert {os.path.basename(r.file): r.input_rows for r in counts.collect()} == {"a.jsonl": 2, "b.jsonl": 1}


def test_ground_truth(spark, tmp_path):
    good = {"text": "John in Rio", "spans": [{"start": 0, "end": 4, "label": "Person"}]}
    p = write(tmp_path / "g.jsonl", json.dumps(good) + "\n")
    assert [tuple(s) for s in src.read_ground_truth(spark, p).head().spans] == [(0, 4, "Person")]
    bad = [{"text": " ", "spans": []}, {"text": "a"}, {"text": "a", "spans": [{"start": 0, "end": 1, "label": "x"}, {"start": 1, "label": "x"}]},
           {"text": "a", "spans": [{"start": 2, "end": 2, "label": "x"}]}]
    q = write(tmp_path / "q.jsonl", "\n".join(json.dumps(r) for r in [good, *bad]))
    kept = [r.problem for r in src.read_ground_truth(spark, q, on_error="quarantine").orderBy("row_idx").collect()]
    assert kept == [None, "missing non-empty 'text'", "missing list field 'spans'", "span[1] missing start/end/label", "span[0] has invalid range"]
    with pytest.raises(Exception, match="row 2: missing non-empty"):
        src.read_ground_truth(spark, q).collect()


def test_calibration_csv(spark, tmp_path):
    head = "RowId,Label,Entidade_Referencia,Entidade_Predita,Start,End,Score,Validacao\n"
    p = write(tmp_path / "c.csv", "﻿" + head + '1,Organization,,"ONU, Rio",0,3,0.9,0\n2,Person,Ana,Ana,0,3,1.5,1.9\n3,Person,,x,0,1,bad,1\n4,Person,,x,0,1,0.5,2\n5,Other,,x,0,1,0.5,1\n')
    rows = src.read_calibration_csv(spark, p).collect()
    assert sorted((r.label, r.target, r.score) for r in rows) == [("Organization", 0, 0.9), ("Person", 1, 1 - 1e-6)]
    with pytest.raises(ValueError, match="no column"):
        src.read_calibration_csv(spark, p, score_col="Nope")
    with pytest.raises(ValueError, match="no valid row"):
        src.read_calibration_csv(spark, p, labels=["Zzz"])
    assert calibration_rows(spark.read.csv(p, header=True), labels=None).count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, "kept", "é", 0.5), (1, "discarded", None, None), (2, "kept", "x", 0.25)], "row_idx long, decision string, text string, score double")
    src.write_jsonl(df, str(tmp_path / "j"))
    back = {json.loads(r.value)["row_idx"]: json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()}
    assert back[0]["text"] == "é" and "text" not in back[1]
    src.write_csv(df, str(tmp_path / "c"), ["score", "row_idx"], {"score": 3})
    got = spark.read.csv(str(tmp_path / "c"), header=True)
    assert got.columns == ["score", "row_idx"] and sorted((r.row_idx, r.score) for r in got.collect()) == [("0", "0.500"), ("1", None), ("2", "0.250")]
    src.write_kept_discarded(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s" / "decision=kept")).count() == 2
    chunks = assign_chunks(df, 2)
    manifest = src.write_chunks(chunks, str(tmp_path / "k")).orderBy("chunk_id").collect()
    assert [(r.chunk_name, r.row_count, r.start_index, r.end_index_exclusive) for r in manifest] == [("chunk_01", 2, 0, 2), ("chunk_02", 1, 2, 3)]
    assert len([f for f in os.listdir(tmp_path / "k" / "chunk_id=1") if f.startswith("part")]) == 1
    assert chunk_manifest(chunks).count() == 2


def test_sample_ids(spark):
    df = spark.createDataFrame([(0, None), (1, "x"), (2, "x")], "row_idx long, sample_id string")
    assert [r.sample_id for r in with_sample_id(df).orderBy("row_idx").collect()] == ["sample_0", "x", "x"]
    assert [tuple(r) for r in src.duplicate_ids(df).collect()] == [("x", 2)]
    assert with_sample_id(df.drop("sample_id")).count() == 3


RUN = "multi_with_negatives_chunk{:02d}_50k_t0{}_cuda_v12"


@pytest.fixture
def runs(tmp_path):
    root = tmp_path / "runs"
    done, part = RUN.format(2, 37), RUN.format(3, 40)
    delta = {"base": .4, "refit": .45, "delta": .05}
    write(root / done / "05_split" / "summary.json", json.dumps({"summary": {"records_total": 200, "kept_count": 120, "discarded_count": 80, "kept_score_mean": .6, "entity_gate_rejections": 1}}, indent=1))
    write(root / done / "09_base_vs_refit_comparison.json", json.dumps({"micro_f1": delta, "macro_f1": delta, "per_label": {"Person": {"f1": delta}}}))
    write(root / done / "05_split" / "kept.jsonl", "".join(json.dumps({"relato": "a", "entities": [{"label": "Location", "score": s}], "_split": {"score_used": s}}) + "\n" for s in (.9, .4)))
    write(root / "context_boost_audit_v12_chunk02" / "summary.json", json.dumps({"records_with_boosted_entities": 0, "entity_boosts_total": 0, "records_with_context_match": 3}))
    write(root / part / "01_predictions.jsonl", "{}\n")
    return str(root), done, part


def test_chunk_runs_and_quality(spark, runs):
    from spanlake.plans.evaluation import chunk_quality
    root, done, part = runs
    gone = RUN.format(9, 50)
    rows = {r.run_name: r for r in chunk_quality(spark, root, [done, part, gone]).collect()}
    assert {n: r.status for n, r in rows.items()} == {done: "completed", part: "partial", gone: "missing"}
    d = rows[done]
    assert (d.chunk, d.threshold, d.version, d.kept_rate, d.micro_delta, d.person_f1_delta) == (2, .37, "v12", .6, .05, .05)
    assert (d.duplicate_text_rate, d.avg_record_score_in_kept, d.top_label, d.top_label_count) == (.5, .65, "Location", 2)
    assert d.flags == "high_kept_count,duplicate_texts,no_context_boost,strong_positive_delta"
    assert src.read_chunk_runs(spark, root).count() == 2


def test_run_artifacts(spark, tmp_path):
    from spanlake.operators.summarize import baseline_table, pseudolabel_table, run_table, runtime_table
    base, cyc = tmp_path / "base", tmp_path / "cyc"
    write(base / "e1" / "nested_cv_results.json", json.dumps({"config": {"model_base": "m"}, "summary": {"mean_test_f1": .5, "runtime_seconds": 3.0}}))
    write(base / "e2" / "eval_final" / "metrics.json", json.dumps({"micro": {"f1": .7}, "macro_f1": .6, "per_label": {"Person": {"f1": .8}}}))
    write(base / "e2" / "eval_final" / "run_stats.json", json.dumps({"config": {"model_path": "x", "map_location": "cuda"}, "runtime_hms": "00:01:00", "runtime_seconds": 60}))
    write(base / "e2" / "other" / "metrics.json", json.dumps({"macro_f1": .1}))
    write(cyc / "r" / "cycle_summary.json", json.dumps({"config": {"refit_mode": "supervised_only", "evaluate_refit": True}, "runtime_seconds": 9}))
    write(cyc / "r" / "05_split" / "summary.json", json.dumps({"summary": {"kept_count": 4, "discarded_count": 6}}))
    write(cyc / "r" / "06_refit_stats.json", json.dumps({"data_summary": {"train_size": 11, "train_source_breakdown": {"pseudolabel": 4}}}))
    write(cyc / "r2" / "cycle_summary.json", json.dumps({"config": {}}))
    a = src.read_run_artifacts(spark, str(base), str(cyc))
    n, h = a.nested_cv.head(), a.holdout.collect()
    assert (n.experiment_id, n.mean_test_f1, n.keep_empty_samples) == ("e1", .5, False)
    assert [(r.experiment_id, r.micro_f1, r.person_f1, r.map_location) for r in h] == [("e2__eval_final", .7, .8, "cuda")]
    c = {r.experiment_id: r for r in a.cycles.collect()}
    assert (c["r"].kept_count, c["r"].pseudolabel_train_size, c["r"].status, c["r2"].status) == (4, 4, "final", "exploratory")
    assert run_table(*a).count() == 4 and runtime_table(*a).count() == 4 and pseudolabel_table(a.cycles).count() == 2
    assert baseline_table(a.holdout, {"e2": "Final"}).head().model == "Final"


def test_layouts_may_differ_from_file_to_file(spark, tmp_path):
    write(tmp_path / "mix" / "a.jsonl", '{"id": 1}\n\n{"id": 2}\n')
    write(tmp_path / "mix" / "b.json", json.dumps([{"id": 3}, {"id": 4, "text": "x\ny"}], indent=1))
    write(tmp_path / "mix" / "c.json", json.dumps({"id": 5, "text": None}, indent=2))
    write(tmp_path / "mix" / "d.jsonl", '{"id": 6}')
    write(tmp_path / "mix" / "e.json", "[]")
    write(tmp_path / "mix" / "f.json", '[{"id": 7}]\n')
    write(tmp_path / "mix" / "g.jsonl", "\n \n")
    rows = src.read_records(spark, str(tmp_path / "mix")).orderBy("row_idx").collect()
    assert [(r.row_idx, r.id) for r in rows] == [(i, i + 1) for i in range(7)] and rows[3].text == "x\ny"
    typed = src.read_records(spark, str(tmp_path / "mix"), spark.createDataFrame([], "id long").schema, keep_raw=True).orderBy("row_idx").collect()
    assert [r.id for r in typed] == list(range(1, 8)) and json.loads(typed[4]._raw) == {"id": 5, "text": None}


@pytest.mark.parametrize("text", ['{\n"id": 1}\n{\n"id": 2}', '[{"id": 1}]\n{"id": 2}', '[{"id": 1}]\n[{"id": 2}]', '{"id": 1}\n[{"id": 2}]', '{"id": 1}\n7', '[{"id": 1}, 7]', '[{"id": 1}', '{"id": 1} {"id": 2}'])
def test_what_is_not_one_layout_is_an_error(spark, tmp_path, text):
    path = write(tmp_path / "x.json", text)
    schema = spark.createDataFrame([], "id long").schema
    with pytest.raises(Exception, match="not one JSON array or object|invalid JSON"):
        src.read_records(spark, path, schema).collect()
