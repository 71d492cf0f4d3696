"""Calibration CSV files and the JSON artifacts that runs leave behind."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.text import clip01, safe_double
from spanlake.schema import LABELS, SCORE_EPS
from spanlake.sources.records import with_row_idx

# File and folder names of the run layout.
NESTED_CV_FILE = "nested_cv_results.json"
METRICS_FILE = "metrics.json"
RUN_STATS_FILE = "run_stats.json"
CYCLE_FILE = "cycle_summary.json"
COMPARISON_FILE = "09_base_vs_refit_comparison.json"
REFIT_STATS_FILE = "06_refit_stats.json"
PREDICTION_STATS_FILE = "01_predictions_stats.json"
SUMMARY_FILE = "summary.json"
KEPT_FILE = "kept.jsonl"
RUN_NAME = r"multi_with_negatives_chunk(\d+)_50k_t(\d+)_cuda_(v\d+)"
AUDIT_NAME = r"context_boost_audit_(v\d+)_chunk(\d+)"


def calibration_rows(raw: DataFrame, score_col: str = "Score", label_col: str = "Validacao",
                     class_col: str | None = "Label", labels: Sequence[str] | None = LABELS) -> DataFrame:
    """(score clipped, target 0/1, label) of the valid rows of a string-typed table."""
    needed = [score_col, label_col] + ([class_col] if class_col else [])
    for name in needed:
        if name not in raw.columns:
            raise ValueError(f"calibration table has no column '{name}'")
    target = safe_double(F.col(label_col)).try_cast("int")  # truncates like int(float(x))
    rows = raw.select(
        clip01(safe_double(F.col(score_col)), SCORE_EPS).alias("score"), target.alias("target"),
        (F.trim(F.coalesce(F.col(class_col), F.lit(""))) if class_col else F.lit("")).alias("label"),
        safe_double(F.col(score_col)).isNotNull().alias("_ok"))
    rows = rows.filter(F.col("_ok") & F.col("target").isin(0, 1)).drop("_ok")
    return rows.filter(F.col("label").isin(*labels)) if labels and class_col else rows


def read_calibration_csv(spark: SparkSession, path: str, score_col: str = "Score", label_col: str = "Validacao",
                         class_col: str | None = "Label", labels: Sequence[str] | None = LABELS) -> DataFrame:
    """Calibration CSV (byte-order mark tolerated); bad rows are skipped, zero valid rows is an error."""
    raw = spark.read.csv(path, header=True, escape='"', multiLine=False)
    rows = calibration_rows(raw, score_col, label_col, class_col, labels)
    if rows.isEmpty():
        raise ValueError("the calibration table has no valid row")
    return rows


# --------------------------------------------------------------------------- run artifacts
class RunArtifacts(NamedTuple):
    nested_cv: DataFrame
    holdout: DataFrame
    cycles: DataFrame


def _artifact(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """All files called ``name`` below ``root`` with their folder; each file is one small JSON object."""
    return (spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", name).json(root)
            .select("*", F.col("_metadata.file_path").alias("artifact_path"))
            .withColumn("folder", F.regexp_replace("artifact_path", r"/[^/]*$", "")))


def _experiment(root: str) -> Column:
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = F.substring_index(F.col("folder"), base + "/", -1)
    return F.replace(relative, F.lit("/"), F.lit("__"))


def read_run_artifacts(spark: SparkSession, base_root: str, cycle_root: str) -> RunArtifacts:
    """One row per nested cross-validation, per final holdout evaluation and per pseudolabel cycle."""
    nested = _artifact(spark, base_root, NESTED_CV_FILE, """
        config STRUCT<model_base: STRING, keep_empty_samples: BOOLEAN>,
        summary STRUCT<best_overall_test_f1: DOUBLE, mean_test_f1: DOUBLE, std_test_f1: DOUBLE,
          mean_seen_entity_test_f1: DOUBLE, mean_unseen_entity_test_f1: DOUBLE,
          runtime_hms: STRING, runtime_seconds: DOUBLE>""")
    nested_cv = nested.select(
        _experiment(base_root).alias("experiment_id"), F.lit("base_nested_cv").alias("family"), "artifact_path",
        F.coalesce("config.model_base", F.lit("")).alias("backbone"),
        F.coalesce("config.keep_empty_samples", F.lit(False)).alias("keep_empty_samples"),
        "summary.*", F.lit("final").alias("status"))

    metrics = _artifact(spark, base_root, METRICS_FILE, """
        micro STRUCT<f1: DOUBLE>, macro_f1 DOUBLE,
        per_label STRUCT<Person: STRUCT<f1: DOUBLE>, Location: STRUCT<f1: DOUBLE>, Organization: STRUCT<f1: DOUBLE>>
        """).filter(F.col("artifact_path").contains("eval_final"))
    stats = _artifact(spark, base_root, RUN_STATS_FILE, """
        config STRUCT<model_path: STRING, map_location: STRING, gt_jsonl: STRING>,
        summary STRUCT<runtime_hms: STRING>, runtime_hms STRING, runtime_seconds DOUBLE""").drop("artifact_path")
    holdout = metrics.join(stats, "folder", "left").select(
        _experiment(base_root).alias("experiment_id"), F.lit("holdout_eval").alias("family"), "artifact_path",
        F.coalesce("config.model_path", F.lit("")).alias("model_path"),
        F.coalesce("config.map_location", F.lit("")).alias("map_location"),
        F.coalesce("config.gt_jsonl", F.lit("")).alias("holdout"),
        F.col("micro.f1").alias("micro_f1"), "macro_f1", F.col("per_label.Person.f1").alias("person_f1"),
        F.col("per_label.Location.f1").alias("location_f1"),
        F.col("per_label.Organization.f1").alias("organization_f1"),
        F.coalesce("summary.runtime_hms", "runtime_hms").alias("runtime_hms"), "runtime_seconds",
        F.lit("final").alias("status"))

    cycle = _artifact(spark, cycle_root, CYCLE_FILE, """
        config STRUCT<model_path: STRING, prediction_map_location: STRING, prediction_model_max_length: INT,
          refit_mode: STRING, evaluate_refit: BOOLEAN>, runtime_hms STRING, runtime_seconds DOUBLE""")
    cycles = (
        cycle.join(_split_summaries(spark, cycle_root), "folder", "left")
        .join(_comparisons(spark, cycle_root), "folder", "left")
        .join(_artifact(spark, cycle_root, REFIT_STATS_FILE, """
            data_summary STRUCT<train_size: BIGINT, train_source_breakdown: STRUCT<pseudolabel: BIGINT>>""")
              .select("folder", "data_summary.train_size",
                      F.col("data_summary.train_source_breakdown.pseudolabel").alias("pseudolabel_train_size")),
              "folder", "left")
        .join(_artifact(spark, cycle_root, PREDICTION_STATS_FILE, """
            runtime_hms STRING, runtime_seconds DOUBLE, summary STRUCT<total_entities: BIGINT>""")
              .select("folder", F.col("runtime_hms").alias("prediction_runtime_hms"),
                      F.col("runtime_seconds").alias("prediction_runtime_seconds"),
                      F.col("summary.total_entities").alias("entities_total")), "folder", "left"))
    evaluated = F.coalesce("config.evaluate_refit", F.lit(False))
    cycles = cycles.select(
        _experiment(cycle_root).alias("experiment_id"), F.lit("pseudolabel_cycle").alias("family"), "artifact_path",
        F.coalesce("config.model_path", F.lit("")).alias("model_path"),
        F.coalesce("config.prediction_map_location", F.lit("")).alias("prediction_map_location"),
        F.col("config.prediction_model_max_length").alias("prediction_model_max_length"),
        F.coalesce("config.refit_mode", F.lit("")).alias("refit_mode"), evaluated.alias("evaluate_refit"),
        "runtime_hms", "runtime_seconds", "prediction_runtime_hms", "prediction_runtime_seconds",
        "entities_total", "kept_count", "discarded_count", "kept_score_mean", "train_size",
        "pseudolabel_train_size", "base_micro_f1", "refit_micro_f1", "micro_f1_delta",
        "base_macro_f1", "refit_macro_f1", "macro_f1_delta",
        F.when(evaluated, "final").otherwise("exploratory").alias("status"))
    return RunArtifacts(nested_cv, holdout, cycles)


def _split_summaries(spark: SparkSession, root: str) -> DataFrame:
    found = _artifact(spark, root, SUMMARY_FILE, """
        summary STRUCT<records_total: BIGINT, kept_count: BIGINT, discarded_count: BIGINT,
          kept_score_mean: DOUBLE, entity_gate_rejections: BIGINT>""")
    return (found.filter(F.col("folder").endswith("/05_split"))
            .select(F.regexp_replace("folder", "/05_split$", "").alias("folder"), "summary.*"))


def _comparisons(spark: SparkSession, root: str) -> DataFrame:
    pair = "STRUCT<base: DOUBLE, refit: DOUBLE, delta: DOUBLE>"
    found = _artifact(spark, root, COMPARISON_FILE, f"""
        micro_f1 {pair}, macro_f1 {pair}, per_label STRUCT<Person: STRUCT<f1: {pair}>,
          Location: STRUCT<f1: {pair}>, Organization: STRUCT<f1: {pair}>>""")
    return found.select(
        "folder", *[F.col(f"{m}_f1.{s}").alias(f"{s}_{m}_f1") for m in ("micro", "macro") for s in ("base", "refit")],
        F.col("micro_f1.delta").alias("micro_f1_delta"), F.col("macro_f1.delta").alias("macro_f1_delta"),
        *[F.col(f"per_label.{n}.f1.delta").alias(f"{n.lower()}_f1_delta") for n in LABELS])


# --------------------------------------------------------------------------- chunk runs
def run_name_parts(name: Column) -> list[Column]:
    """chunk number, threshold (hundredths in the name) and version; NULL when the name has another form."""
    part = lambda i: F.nullif(F.regexp_extract(name, f"^{RUN_NAME}$", i), F.lit(""))
    return [part(1).cast("int").alias("chunk"), (part(2).cast("int") / 100).alias("threshold"),
            part(3).alias("version")]


def read_chunk_runs(spark: SparkSession, root: str, run_names: Sequence[str] | None = None) -> DataFrame:
    """One row per chunk run below ``root`` with its split, comparison and boost-audit summaries.

    ``status``: ``completed`` with split and comparison summaries, ``partial`` with any other file,
    ``missing`` for a name in ``run_names`` without files.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder")))
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    name = F.substring_index(F.substring_index(F.col("folder"), base + "/", -1), "/", 1)
    present = files.select(name.alias("run_name")).filter(F.col("run_name").rlike(f"^{RUN_NAME}$")).distinct()
    present = present.withColumn("_present", F.lit(True))
    if run_names is not None:
        asked = spark.createDataFrame([(n,) for n in run_names], "run_name string")
        present = asked.join(present, "run_name", "left")
    by_name = lambda df: df.withColumn("run_name", F.regexp_extract("folder", r"([^/]+)$", 1)).drop("folder")
    audit = (_artifact(spark, root, SUMMARY_FILE,
                       "records_with_boosted_entities BIGINT, entity_boosts_total BIGINT, records_with_context_match BIGINT")
             .withColumn("_name", F.regexp_extract("folder", r"([^/]+)$", 1))
             .filter(F.col("_name").rlike(f"^{AUDIT_NAME}$"))
             .select(F.regexp_extract("_name", AUDIT_NAME, 2).cast("int").alias("chunk"),
                     F.regexp_extract("_name", AUDIT_NAME, 1).alias("version"),
                     F.col("records_with_boosted_entities").alias("boosted_records"),
                     F.col("entity_boosts_total").alias("boosted_entities_total"), "records_with_context_match"))
    runs = present.select("run_name", "_present", *run_name_parts(F.col("run_name")))
    split = by_name(_split_summaries(spark, root)).withColumn("_split_there", F.lit(True))
    compared = by_name(_comparisons(spark, root)).withColumn("_compared", F.lit(True))
    out = runs.join(split, "run_name", "left").join(compared, "run_name", "left").join(audit, ["chunk", "version"], "left")
    done = F.col("_split_there") & F.col("_compared")
    gated = lambda c: F.when(done, F.col(c)).alias(c)
    return out.select(
        "run_name", "chunk", "threshold", "version",
        F.when(done, "completed").when(F.col("_present"), "partial").otherwise("missing").alias("status"),
        gated("kept_count"), F.when(done & (F.col("records_total") > 0),
                                    F.col("kept_count") / F.col("records_total")).alias("kept_rate"),
        gated("kept_score_mean"), gated("entity_gate_rejections"),
        F.when(done, F.col("micro_f1_delta")).alias("micro_delta"),
        F.when(done, F.col("macro_f1_delta")).alias("macro_delta"),
        *[gated(f"{n.lower()}_f1_delta") for n in LABELS],
        "boosted_records", "boosted_entities_total", "records_with_context_match")


def read_kept_rows(spark: SparkSession, root: str) -> DataFrame:
    """All kept rows below ``root`` with their run name and ``row_idx`` (input order): ``05_split/kept.jsonl`` files and the
    ``05_split/decision=kept`` folders that ``write_kept_discarded`` leaves."""
    entity = ("ARRAY<STRUCT<start: INT, end: INT, label: STRING, text: STRING, score: DOUBLE, score_calibrated: DOUBLE, "
              "score_context_boosted: DOUBLE>>")
    schema = f"relato STRING, text STRING, texto STRING, entities {entity}, _split STRUCT<score_value: DOUBLE, score_used: DOUBLE>"
    patterns = [f"{root.rstrip('/')}/*/05_split/{KEPT_FILE}", f"{root.rstrip('/')}/*/05_split/decision=kept/*.json"]
    there = [p for p in patterns if path_exists(spark, p)]
    if not there:
        return spark.createDataFrame([], f"{schema}, run_name STRING, row_idx BIGINT")
    rows = spark.read.schema(schema).json(there).select(
        "*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/05_split/", 1).alias("run_name"),
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return with_row_idx(rows).drop("_file", "_block")


def path_exists(spark: SparkSession, pattern: str) -> bool:
    """Does a path or glob match anything on its file system?"""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0
