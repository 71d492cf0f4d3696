"""Evaluation of predictions and of chunk runs."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.operators import evaluate as ev
from spanlake.operators.summarize import kept_quality, quality_flags, top_label
from spanlake.schema import LABELS
from spanlake.sources.tables import read_chunk_runs, read_kept_rows


class Evaluation(NamedTuple):
    thresholds: DataFrame
    outcomes: DataFrame
    metrics: DataFrame
    review: DataFrame


def evaluate_predictions(gold: DataFrame, pred: DataFrame, labels: Sequence[str] = LABELS, grid: Sequence[float] | None = None,
                         top_n: int = 100, id_col: str = "row_idx") -> Evaluation:
    """Best threshold per label, outcomes at those thresholds, span metrics and the worst records."""
    best = ev.threshold_sweep(gold, pred, labels, grid, id_col)
    chosen = {r.label: r.best_threshold for r in best.collect()}  # one row per requested label
    outcomes = ev.count_outcomes(gold, pred, chosen, id_col)
    passed = pred.filter(ev.passes_threshold(chosen))
    return Evaluation(best, outcomes, ev.span_metrics(gold, passed, labels, id_col), ev.review_rows(gold, passed, top_n, id_col))


def chunk_quality(spark: SparkSession, root: str, run_names: Sequence[str] | None = None, strong: float = 0.8, weak: float = 0.5) -> DataFrame:
    """Chunk runs with their summaries, kept-record quality, top label and flags."""
    runs = read_chunk_runs(spark, root, run_names)
    kept = read_kept_rows(spark, root)
    quality = kept_quality(kept, strong, weak, ["run_name"])
    best = top_label(kept, ["run_name"])
    return quality_flags(runs.join(quality, "run_name", "left").join(best, "run_name", "left"))
