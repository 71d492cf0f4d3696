"""Readers and writers: every query writes data derived from the tables to the shared folder and reads it back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from catalog import query
from catalog.boosting import CYCLE_SQL, cycle
from catalog.calibration import CAL, _cal
from catalog.evaluation import _KEPT
from catalog.fixtures import ENTS_SQL, annotated, slim, table, tidy
from spanlake import sources as src
from spanlake.operators import summarize as sm
from spanlake.operators.score import record_score
from spanlake.operators import sketches as sk
from spanlake.operators.splits import assign_chunks
from spanlake.plans.evaluation import chunk_quality as run_quality
from spanlake.schema import CALIBRATION_COLUMNS
from spanlake.session import scratch_path
from spanlake.sources.records import bad_lines as find_bad_lines
from spanlake.sources.tables import read_chunk_runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _put(spark, path: str, payload: dict) -> None:
    """One small JSON file through the session's file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(json.dumps(payload, ensure_ascii=False, indent=1), "utf-8"))
    out.close()


_TOTALS = "SELECT lang, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang"


def _totals(df):
    return tidy(df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")))


@query("read_json_lines", _TOTALS)
def read_json_lines(spark, sf):
    path = scratch_path(spark, "jsonl")
    src.write_jsonl(_docs(spark, sf), path)
    return _totals(src.read_records_strict(spark, path, spark.createDataFrame([], DOCS).schema))


@query("read_json_arrays", _TOTALS)
def read_json_arrays(spark, sf):
    """Array files of 40 documents each."""
    path = scratch_path(spark, "arrays")
    chunks = assign_chunks(_docs(spark, sf).withColumn("row_idx", F.col("doc_id")), 40)
    arrays = chunks.groupBy("chunk_id").agg(F.to_json(F.collect_list(F.struct("doc_id", "text", "lang"))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return _totals(src.read_records(spark, path, spark.createDataFrame([], "doc_id long, text string, lang string").schema))


@query("read_split_arrays", "SELECT doc_id, md5(text) AS digest, (row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) - 1)::BIGINT AS place FROM documents")
def read_split_arrays(spark, sf):
    """Three array files, each a third of the corpus, cut into the splits that Spark makes of them; the place of every item in its array."""
    path = scratch_path(spark, "split-arrays")
    docs = _docs(spark, sf).select("doc_id", "text", F.pmod("doc_id", F.lit(3)).alias("file"))
    first = docs.groupBy("file").agg(F.min("doc_id").alias("first"))
    items = docs.join(F.broadcast(first), "file").select("file", "doc_id", F.concat(F.when(F.col("doc_id") == F.col("first"), "[").otherwise(","), F.to_json(F.struct("doc_id", "text"))).alias("value"))
    ends = first.select("file", F.lit(1 << 62).alias("doc_id"), F.lit("]").alias("value"))
    ordered = items.unionByName(ends).repartition("file").sortWithinPartitions("file", "doc_id")
    ordered.select("file", "value").write.partitionBy("file").text(path)
    rows = src.read_records(spark, [f"{path}/file={i}" for i in range(3)], spark.createDataFrame([], "doc_id long, text string").schema, layout="document")
    start = rows.groupBy(F.pmod("doc_id", F.lit(3)).alias("file")).agg(F.min("row_idx").alias("start"))
    return tidy(rows.withColumn("file", F.pmod("doc_id", F.lit(3))).join(F.broadcast(start), "file").select("doc_id", F.md5("text").alias("digest"), (F.col("row_idx") - F.col("start")).alias("place")))


@query("read_mixed_layouts", "SELECT doc_id, md5(text) AS digest, lang FROM documents")
def read_mixed_layouts(spark, sf):
    """One folder of JSON lines, array files and pretty-printed single objects."""
    path = scratch_path(spark, "mixed")
    row = F.struct("doc_id", "text", "lang")
    kind = F.when(F.col("doc_id") % 50 == 0, "object").when(F.col("doc_id") % 2 == 1, "line").otherwise("array")
    docs = _docs(spark, sf).withColumn("kind", kind)
    docs.filter("kind = 'line'").select(F.to_json(row).alias("value")).write.text(path)
    arrays = docs.filter("kind = 'array'").groupBy("source", F.floor(F.col("doc_id") / 256)).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(F.to_json(row)), ",\n"), F.lit("\n]\n")).alias("value"))
    arrays.select("value").write.mode("append").option("maxRecordsPerFile", 1).text(path)
    objects = docs.filter("kind = 'object'").select(F.to_json(row, {"pretty": "true"}).alias("value"))
    objects.write.mode("append").option("maxRecordsPerFile", 1).text(path)
    return src.read_records(spark, path, spark.createDataFrame([], "doc_id long, text string, lang string").schema).select("doc_id", F.md5("text").alias("digest"), "lang")


@query("row_positions", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS row_idx FROM documents")
def row_positions(spark, sf):
    """Input order across files and splits."""
    path = scratch_path(spark, "ordered")
    src.write_jsonl(_docs(spark, sf).select("doc_id", "text").repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id"), path)
    return tidy(src.read_records(spark, path, spark.createDataFrame([], "doc_id long, text string").schema).select("doc_id", "row_idx"))


@query("bad_lines", """SELECT CASE WHEN doc_id % 50 = 0 THEN 'invalid JSONL' ELSE 'not a JSON object' END AS problem, count(*)::BIGINT AS n FROM documents WHERE doc_id % 50 = 0 OR doc_id % 35 = 0 GROUP BY 1""")
def bad_lines(spark, sf):
    path = scratch_path(spark, "broken")
    k = F.col("doc_id")
    line = F.when(k % 50 == 0, F.lit('{"doc_id": ')).when(k % 35 == 0, F.lit("[1]")).otherwise(F.to_json(F.struct("doc_id", "text")))
    _docs(spark, sf).select(line.alias("value")).write.text(path)
    return tidy(find_bad_lines(spark, path).groupBy("problem").agg(F.count(F.lit(1)).alias("n")))


@query("read_ground_truth", f"""WITH {ENTS_SQL}, n AS (SELECT d.doc_id, (SELECT count(*) FROM ents WHERE ents.doc_id = d.doc_id) AS n FROM documents d)
SELECT CASE WHEN doc_id % 9 = 0 THEN 'missing non-empty ''text''' WHEN doc_id % 9 = 1 THEN 'missing list field ''spans''' WHEN doc_id % 9 = 2 AND n > 1 THEN 'span[1] missing start/end/label' WHEN doc_id % 9 = 3 AND n > 0 THEN 'span[0] has invalid range' ELSE 'ok' END AS problem,
  count(*)::BIGINT AS n FROM n GROUP BY 1""")
def read_ground_truth(spark, sf):
    path = scratch_path(spark, "truth")
    k = F.col("row_idx") % 9
    rows = slim(annotated(spark, sf)).select(
        F.when(k == 0, "  ").otherwise(F.col("text")).alias("text"),
        F.when(k != 1, F.transform("entities", lambda e, i: F.struct(
            e["start"].alias("start"), F.when((k == 3) & (i == 0), e["start"]).when(~((k == 2) & (i == 1)), e["end"]).alias("end"), e["label"].alias("label")))).alias("spans"))
    src.write_jsonl(rows, path)
    out = src.read_ground_truth(spark, path, on_error="quarantine", layout="lines")
    return tidy(out.groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count(F.lit(1)).alias("n")))


@query("read_many_files", "SELECT source, count(*)::BIGINT AS input_rows FROM documents GROUP BY source")
def read_many_files(spark, sf):
    path = scratch_path(spark, "many")
    _docs(spark, sf).select("doc_id", "source", F.col("source").alias("part")).write.partitionBy("part").json(path)
    _, counts = src.read_many(spark, path + "/*/*.json", spark.createDataFrame([], "doc_id long, source string").schema)
    per = counts.groupBy(F.regexp_extract("file", "part=([^/]+)/", 1).alias("source")).agg(F.sum("input_rows").alias("input_rows"))
    return tidy(per)


@query("calibration_csv", f"""{CAL} SELECT label, count(*)::BIGINT AS n, sum(target)::BIGINT AS positives, round(sum(score), 5) AS total FROM cal WHERE label <> 'Organization' AND doc_id % 11 > 1 GROUP BY label""")
def calibration_csv(spark, sf):
    """Some rows carry an unparsable score or an impossible target and are skipped."""
    path = scratch_path(spark, "csv")
    k = F.col("row_idx") % 11
    rows = _cal(spark, sf).select(
        F.col("row_idx").alias("RowId"), F.col("label").alias("Label"), F.lit("a, \"b\"").alias("Entidade_Referencia"), F.lit("ç").alias("Entidade_Predita"), F.lit(0).alias("Start"), F.lit(1).alias("End"),
        F.when(k == 0, "n/a").otherwise(F.col("score").cast("string")).alias("Score"), F.when(k == 1, "2").otherwise((F.col("target") + 0.5).cast("string")).alias("Validacao"))
    src.write_csv(rows, path, CALIBRATION_COLUMNS)
    out = src.read_calibration_csv(spark, path, labels=["Person", "Location"])
    return tidy(out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("positives"), F.round(F.sum("score"), 5).alias("total")))


@query("write_kept_discarded", CYCLE_SQL + " SELECT CASE WHEN keep THEN 'kept' ELSE 'discarded' END AS decision, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS ids FROM cy GROUP BY 1")
def write_kept_discarded(spark, sf):
    path = scratch_path(spark, "split")
    src.write_kept_discarded(cycle(spark, sf).records.select("row_idx", "text", "decision"), path)
    back = spark.read.schema("row_idx long, text string, decision string").json(path)
    return tidy(back.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.sum("row_idx").alias("ids")))


@query("write_chunks", """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) SELECT (pos // 60 + 1)::BIGINT AS chunk_id, count(*)::BIGINT AS row_count, min(pos)::BIGINT AS start_index, (max(pos) + 1)::BIGINT AS end_index_exclusive,
  sum(doc_id)::BIGINT AS ids FROM p GROUP BY 1""")
def write_chunks(spark, sf):
    path = scratch_path(spark, "chunks")
    chunks = assign_chunks(_docs(spark, sf).withColumn("row_idx", F.col("doc_id")), 60)
    manifest = src.write_chunks(chunks, path)
    back = spark.read.json(path).groupBy("chunk_id").agg(F.sum("doc_id").alias("ids"))
    return tidy(manifest.join(back, "chunk_id").select("chunk_id", "row_count", "start_index", "end_index_exclusive", "ids"))


# --------------------------------------------------------------------------- runs
def _lang_scores(spark, sf):
    """Mean record score per language: one row per language."""
    rows = record_score(slim(annotated(spark, sf)), empty="null").groupBy("lang").agg(F.avg("record_score").alias("m"), F.count(F.lit(1)).alias("n"))
    return sorted((r.lang, r.m, r.n) for r in rows.collect())


@query("run_table", f"""WITH {ENTS_SQL}, r AS (SELECT lang, d.doc_id, avg(score) AS v FROM documents d LEFT JOIN ents USING (doc_id) GROUP BY ALL), m AS (SELECT lang, avg(v) AS m, count(*) AS n FROM r GROUP BY lang)
SELECT 'cv__' || lang AS experiment_id, 'base_nested_cv' AS family, NULL::DOUBLE AS macro_f1, round(m, 6) AS mean_test_f1, NULL::BIGINT AS kept_count, round(n, 6)::DOUBLE AS runtime_seconds, 'final' AS status FROM m
UNION ALL SELECT lang || '__eval_final', 'holdout_eval', round(m, 6), NULL, NULL, round(n, 6)::DOUBLE, 'final' FROM m UNION ALL SELECT lang, 'pseudolabel_cycle', NULL, NULL, n::BIGINT, round(n, 6)::DOUBLE, CASE WHEN lang = 'en' THEN 'final' ELSE 'exploratory' END FROM m""")
def run_table(spark, sf):
    out = sm.run_table(*_artifacts(spark, sf))
    return tidy(out.select("experiment_id", "family", "macro_f1", "mean_test_f1", "kept_count", "runtime_seconds", "status"))


_LANG = f"""WITH {ENTS_SQL}, r AS (SELECT lang, d.doc_id, avg(score) AS v FROM documents d LEFT JOIN ents USING (doc_id) GROUP BY ALL), m AS (SELECT lang, avg(v) AS m, count(*) AS n FROM r GROUP BY lang)"""


@query("baseline_table", _LANG + """ SELECT CASE WHEN lang = 'en' THEN 'English base' ELSE lang || '__eval_final' END AS model, '' AS model_path, round(m, 6) AS micro_f1, round(m, 6) AS macro_f1,
  NULL::DOUBLE AS person_f1, NULL::DOUBLE AS location_f1, NULL::DOUBLE AS organization_f1, '' AS holdout FROM m""")
def baseline_table(spark, sf):
    return tidy(sm.baseline_table(_artifacts(spark, sf).holdout, {"en__eval": "English base"}))


@query("pseudolabel_table", _LANG + """ SELECT lang AS experiment_id, n::BIGINT AS kept_count, '' AS refit_mode, '' AS prediction_map_location, NULL::BIGINT AS entities_total, NULL::DOUBLE AS micro_f1_delta FROM m""")
def pseudolabel_table(spark, sf):
    return tidy(sm.pseudolabel_table(_artifacts(spark, sf).cycles).select("experiment_id", "kept_count", "refit_mode", "prediction_map_location", "entities_total", "micro_f1_delta"))


@query("runtime_table", _LANG + """ SELECT 'cv__' || lang AS experiment, 'base_nested_cv' AS family, round(n, 6)::DOUBLE AS runtime_seconds, '' AS device FROM m
  UNION ALL SELECT lang || '__eval_final', 'holdout_eval', round(n, 6)::DOUBLE, '' FROM m UNION ALL SELECT lang, 'pseudolabel_cycle', round(n, 6)::DOUBLE, '' FROM m""")
def runtime_table(spark, sf):
    runs = _artifacts(spark, sf)
    return tidy(sm.runtime_table(*runs).select("experiment", "family", "runtime_seconds", "device"))


def _artifacts(spark, sf):
    base, runs = scratch_path(spark, "base"), scratch_path(spark, "runs")
    for lang, m, n in _lang_scores(spark, sf):
        _put(spark, f"{base}/cv/{lang}/nested_cv_results.json", {"config": {"model_base": lang}, "summary": {"mean_test_f1": m, "runtime_seconds": float(n)}})
        _put(spark, f"{base}/{lang}/eval_final/metrics.json", {"micro": {"f1": m}, "macro_f1": m, "per_label": {}})
        _put(spark, f"{base}/{lang}/eval_final/run_stats.json", {"runtime_seconds": float(n)})
        _put(spark, f"{runs}/{lang}/cycle_summary.json", {"config": {"evaluate_refit": lang == "en"}, "runtime_seconds": float(n)})
        _put(spark, f"{runs}/{lang}/05_split/summary.json", {"summary": {"kept_count": n}})
    return src.read_run_artifacts(spark, base, runs)


def _run_name(i: int) -> str:
    return f"multi_with_negatives_chunk{i + 1:02d}_50k_t0{30 + i}_cuda_v{i}"


def _write_runs(spark, sf) -> str:
    """One run per language with split summary, comparison, boost audit and kept rows."""
    root = scratch_path(spark, "chunk-runs")
    records = cycle(spark, sf).records.select("lang", "decision", "relato", "record_score", "_context_boost_trace", F.transform("entities", lambda e: F.struct(
        e["label"].alias("label"), e["text"].alias("text"), e["score_context_boosted"].alias("score_context_boosted"))).alias("entities"), F.struct("_split.score_used").alias("_split"))
    staged = scratch_path(spark, "staged")
    records.write.partitionBy("lang").parquet(staged)
    records = spark.read.parquet(staged)
    t = "_context_boost_trace"
    per = records.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "kept").alias("kept"), F.count_if(F.col(f"{t}.boosted_entities") > 0).alias("recs"),
                                      F.sum(f"{t}.boosted_entities").alias("ents"), F.count_if(F.col(f"{t}.record_context_match")).alias("matched"), F.avg("record_score").alias("m"))
    for i, r in enumerate(sorted(per.collect(), key=lambda r: r.lang)):  # one row per language
        run = f"{root}/{_run_name(i)}"
        if i < 3:
            _put(spark, f"{run}/05_split/summary.json", {"summary": {"records_total": r.n, "kept_count": r.kept, "kept_score_mean": r.m}})
            _put(spark, f"{run}/09_base_vs_refit_comparison.json", {"micro_f1": {"delta": r.m - 0.5}, "macro_f1": {"delta": r.m}, "per_label": {"Person": {"f1": {"delta": r.m}}}})
            _put(spark, f"{root}/context_boost_audit_v{i}_chunk{i + 1:02d}/summary.json", {"records_with_boosted_entities": r.recs, "entity_boosts_total": r.ents, "records_with_context_match": r.matched})
        kept = records.filter((F.col("lang") == r.lang) & (F.col("decision") == "kept")).withColumn("decision", F.lit("kept"))
        src.write_kept_discarded(kept.select("relato", "entities", "_split", "decision"), f"{run}/05_split", mode="append")
    return root


_RUNS = CYCLE_SQL + """, lg AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS i, count(*) AS n, count(CASE WHEN keep THEN 1 END) AS kept, count(CASE WHEN boosted > 0 THEN 1 END) AS recs, sum(boosted) AS ents, avg(record_score) AS m FROM cy JOIN documents USING (doc_id) GROUP BY lang),
nm AS (SELECT *, 'multi_with_negatives_chunk' || lpad((i + 1)::VARCHAR, 2, '0') || '_50k_t0' || (30 + i) || '_cuda_v' || i AS run_name FROM lg)"""


@query("chunk_runs", _RUNS + """ SELECT run_name, (i + 1)::BIGINT AS chunk, round((30 + i) / 100, 6) AS threshold, CASE WHEN i < 3 THEN 'completed' ELSE 'partial' END AS status, CASE WHEN i < 3 THEN kept END::BIGINT AS kept_count,
  CASE WHEN i < 3 THEN round(kept / n, 6) END AS kept_rate, CASE WHEN i < 3 THEN round(m - 0.5, 6) END AS micro_delta, CASE WHEN i < 3 THEN recs END::BIGINT AS boosted_records FROM nm UNION ALL
  SELECT 'multi_with_negatives_chunk99_50k_t099_cuda_v9', 99, 0.99, 'missing', NULL, NULL, NULL, NULL""")
def chunk_runs(spark, sf):
    names = [_run_name(i) for i in range(4)] + ["multi_with_negatives_chunk99_50k_t099_cuda_v9"]
    return tidy(read_chunk_runs(spark, _write_runs(spark, sf), names).select("run_name", "chunk", "threshold", "status", "kept_count", "kept_rate", "micro_delta", "boosted_records"))


@query("chunk_quality", _KEPT + """, li AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS i FROM (SELECT DISTINCT lang FROM documents)) SELECT (i + 1)::BIGINT AS chunk, kept_rows, unique_texts, round(avg_n, 6) AS avg_entities_per_kept, round(avg_weak, 6) AS avg_weak_entities_per_kept,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM bx JOIN kr ON kr.doc_id = bx.doc_id WHERE kr.lang = kq.lang GROUP BY label))::BIGINT AS top_label_count FROM kq JOIN li USING (lang)""")
def chunk_quality(spark, sf):
    out = run_quality(spark, _write_runs(spark, sf)).filter("kept_rows is not null")
    return tidy(out.select("chunk", "kept_rows", "unique_texts", "avg_entities_per_kept", "avg_weak_entities_per_kept", "top_label_count"))


_SKETCH_LABELS = f"""WITH {ENTS_SQL}, n AS (SELECT label, count(*) AS n FROM ents GROUP BY label)"""


@query("sketched_runs", _SKETCH_LABELS + """ SELECT (SELECT count(*) FROM documents)::BIGINT AS rows, (SELECT count(*) FROM ents)::BIGINT AS scored, 1::BIGINT AS texts_close, 1::BIGINT AS median_close,
  (SELECT label FROM n ORDER BY n.n DESC, label LIMIT 1) AS top_label, (SELECT max(n.n) FROM n)::BIGINT AS top_label_count""")
def sketched_runs(spark, sf):
    """One sketched run per language, merged from their stored rows; estimates against the exact numbers (2 % of the texts, 1 % of the ranks)."""
    df, folder = slim(annotated(spark, sf)), scratch_path(spark, "sketched")
    sk.sketch_run(df, ["lang"]).write.partitionBy("lang").parquet(folder)
    report = sk.sketch_report(sk.merge_runs(spark.read.parquet(folder)))
    texts = df.filter(F.trim("text") != "").agg(F.count_distinct("text")).scalar()
    ents = df.select(F.explode("entities.score").alias("s"))
    below = ents.join(F.broadcast(report.select("p50"))).agg(F.avg((F.col("s") < F.col("p50")).cast("double"))).scalar()
    return tidy(report.select("rows", "scored", (F.abs(F.col("unique_texts") - texts) <= 0.02 * texts).alias("texts_close"), (F.abs(below - 0.5) <= 0.01).alias("median_close"), "top_label", "top_label_count"))
