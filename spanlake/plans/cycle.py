"""One pseudolabel cycle: (calibrate) -> boost -> score -> split -> input of the next iteration.

The stages are column expressions over the same rows, so Catalyst runs them as a few projections in one pass;
only the keep-first deduplication of the next input shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions.udfs import Tagger
from spanlake.operators.boost import BoostConfig, context_boost, context_boost_details, context_boost_stats
from spanlake.operators.calibrate import Calibrator, apply_calibrator, fit_calibrator, pseudo_targets, scored_entities
from spanlake.operators.extract import extract_entities, tagging_stats
from spanlake.operators.fields import project_fields
from spanlake.operators.filters import drop_reasons
from spanlake.operators.ordering import keep_first
from spanlake.operators.staging import observed
from spanlake.operators.score import EntityGate, record_score, record_score_stats, split_records, split_summary
from spanlake.schema import INFERENCE_FIELDS, LABELS
from spanlake.functions.text import inference_text


@dataclass(frozen=True)
class CycleConfig:
    boost: BoostConfig | None = field(default_factory=BoostConfig)
    calibrator: Calibrator | None = None
    score_field: str = "score_context_boosted"
    score_how: str = "mean"
    score_empty: str = "zero"
    threshold: float = 0.5
    op: str = "ge"
    fallback: str | None = "record_score_context_boosted"
    missing: str = "zero"
    gate: EntityGate | None = None


class Cycle(NamedTuple):
    records: DataFrame
    boost_stats: DataFrame | None
    boost_details: DataFrame | None
    score_stats: DataFrame
    summary: DataFrame


def score_and_split(df: DataFrame, cfg: CycleConfig = CycleConfig()) -> DataFrame:
    """All stateless stages; the same function serves batch and streaming input."""
    out, boost = df, cfg.boost
    if cfg.calibrator:
        out = apply_calibrator(out, cfg.calibrator)
        if boost and boost.base_score_field == "score":  # a calibrated corpus is boosted on the calibrated score
            boost = replace(boost, base_score_field="score_calibrated")
    if boost:
        out = context_boost(out, boost)
    field_name = cfg.score_field if boost else ("score_calibrated" if cfg.calibrator else "score")
    out = record_score(out, field_name, cfg.score_how, cfg.score_empty)
    fallback = cfg.fallback if cfg.fallback in out.columns else None
    return split_records(out, "record_score", cfg.threshold, cfg.op, fallback, cfg.missing, cfg.gate)


def pseudolabel_cycle(df: DataFrame, cfg: CycleConfig = CycleConfig(), tagger: Callable[[], Tagger] | None = None,
                      labels: Sequence[str] = LABELS, text_fields: Sequence[str] = INFERENCE_FIELDS,
                      id_col: str = "row_idx") -> Cycle:
    """Tag (when a tagger is given), then score and split, with the statistics of every stage."""
    if tagger:
        there = [f for f in text_fields if f in df.columns]
        df = extract_entities(df.withColumn("_inference", inference_text(there)), tagger, labels, "_inference").drop("_inference")
    records = score_and_split(df, cfg)
    boosted = cfg.boost is not None
    return Cycle(records, context_boost_stats(records) if boosted else None,
                 context_boost_details(records, id_col) if boosted else None, record_score_stats(records), split_summary(records))


class NextInput(NamedTuple):
    records: DataFrame
    counts: DataFrame


def prepare_next_iteration(discarded: DataFrame, keep: Sequence[str], required: Sequence[str] = ("relato",),
                           dedupe_on: Sequence[str] = (), coerce: str = "stringify", fill: str = "",
                           drop_empty: Sequence[str] = ("relato",), id_col: str = "row_idx", per_file: str | None = None) -> NextInput:
    """Project, require, deduplicate (inside each file when ``per_file`` is set); counters per file."""
    projected = drop_reasons(project_fields(discarded, keep, coerce, fill), required, drop_empty)
    usable = projected.filter(F.col("drop_reason").isNull()).drop("drop_reason")
    files = [per_file] if per_file else []
    records = keep_first(usable, [*files, *dedupe_on], order=(id_col,)) if dedupe_on else usable
    by = [F.col(per_file)] if per_file else []
    dropped = projected.groupBy(*by).agg(
        F.count(F.lit(1)).alias("input_rows"), F.count_if(F.col("drop_reason") == "dropped_missing_required").alias("dropped_missing_required"),
        F.count_if(F.col("drop_reason") == "dropped_empty_relato").alias("dropped_empty_relato"))
    out = records.groupBy(*by).agg(F.count(F.lit(1)).alias("output_rows"))
    if per_file:
        counts = dropped.join(out, per_file, "left").na.fill(0, ["output_rows"])
    else:
        counts = dropped.withColumn("output_rows", out.scalar())
    counts = counts.withColumn("dropped_duplicate", F.col("input_rows") - F.col("dropped_missing_required")
                               - F.col("dropped_empty_relato") - F.col("output_rows"))
    return NextInput(records, counts)


class CycleRun(NamedTuple):
    records: DataFrame
    next_input: DataFrame
    stages: DataFrame
    calibrator: Calibrator | None


def run_cycle(df: DataFrame, cfg: CycleConfig, tagger: Callable[[], Tagger], keep: Sequence[str], labels: Sequence[str] = LABELS,
              text_fields: Sequence[str] = INFERENCE_FIELDS, calibrate: str | None = "temperature", target_threshold: float = 0.5,
              dedupe_on: Sequence[str] = ("relato",), required: Sequence[str] = ("relato",), id_col: str = "row_idx",
              threshold: float = 0.0, max_tokens: int = 384, batch_size: int = 4) -> CycleRun:
    """One cycle from raw records to the next cycle's input: tag, calibrate, boost, score, split, prepare.

    The records of every stage are written to the shared folder: the calibrator's fit and the scoring read the tagged ones, and
    the user's tagger runs once.  ``stages`` has a row per stage (stage, samples, processed, failed, entities, error); its counts are
    observed while the stages are written.
    """
    there = [f for f in text_fields if f in df.columns]
    staged = df.withColumn("_inference", inference_text(there))
    tagged = extract_entities(staged, tagger, labels, "_inference", threshold, batch_size, max_tokens).drop("_inference")
    ok, rows = F.coalesce(F.col("tagger_ok"), F.lit(False)), F.count(F.lit(1))
    tagged, tag = observed(tagged, "cycle-tagged", samples=rows, processed=F.count_if(ok), failed=F.count_if(~ok), entities=F.coalesce(F.sum(F.size("entities")), F.lit(0)))
    calibrator = cfg.calibrator
    if calibrate and calibrator is None:
        fit_on = pseudo_targets(scored_entities(tagged, "score", labels, id_col), threshold=target_threshold)
        calibrator = fit_calibrator(fit_on, calibrate, fallback=False)
    decided = lambda d: F.count_if(F.col("decision") == d)
    records, split = observed(score_and_split(tagged, replace(cfg, calibrator=calibrator)), "cycle-scored", kept=decided("kept"), discarded=decided("discarded"))
    following = prepare_next_iteration(records.filter("decision = 'discarded'"), keep, required, dedupe_on, drop_empty=required, id_col=id_col)
    prepared, after = observed(following.records, "cycle-next", rows=rows)
    error = tagging_stats(tagged).first()["common_error"] if tag["failed"] else None  # one more pass only where something failed
    counted = [("tag", tag["samples"], tag["processed"], tag["failed"], tag["entities"], error),
               *[(name, n, n, 0, None, None) for name, n in (("kept", split["kept"]), ("discarded", split["discarded"]), ("next", after["rows"]))]]
    stages = df.sparkSession.createDataFrame(counted, "stage string, samples long, processed long, failed long, entities long, error string")
    return CycleRun(records, prepared, stages, calibrator)
