"""Training data: manifests, windows and folds."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.operators.extract import sliding_token_windows, tokenized_samples
from spanlake.operators.filters import filter_empty, prepare_training_records
from spanlake.operators.merge import REFIT_MODES, merge_training
from spanlake.operators.splits import assign_folds, group_folds, refit_splits, sample_pseudolabels
from spanlake.operators.staging import written
from spanlake.schema import LABELS


class Manifest(NamedTuple):
    rows: DataFrame
    sources: DataFrame
    counts: DataFrame


def training_manifest(supervised: DataFrame | None, pseudolabels: DataFrame | None, mode: str = "supervised_plus_pseudolabels",
                      labels: Sequence[str] = LABELS, ratio: float = 0.2, seed: int = 42, sample_ratio: float = 1.0,
                      max_pseudolabels: int = 0, dedupe: bool = True, validation: DataFrame | None = None,
                      id_col: str = "row_idx") -> Manifest:
    """Cleaned, sampled, split training rows (``role``), a source breakdown and the cleaning counters.

    A given ``validation`` set replaces the split: everything else trains.
    """
    if mode not in REFIT_MODES:
        raise ValueError(f"unsupported refit mode: {mode}")
    use_sup, use_pseudo = REFIT_MODES[mode]
    if use_sup and supervised is None:
        raise ValueError(f"refit mode {mode} needs supervised records")
    counts, sup, pseudo = [], None, None
    if use_pseudo and pseudolabels is not None:
        ready = prepare_training_records(pseudolabels, labels, "pseudolabel")
        counts.append(ready.counts)
        pseudo = sample_pseudolabels(ready.records, sample_ratio, max_pseudolabels, seed, id_col)
    if use_sup:
        ready = prepare_training_records(supervised, labels, "supervised")
        counts.append(ready.counts)
        sup = ready.records
    if validation is not None:
        ready = prepare_training_records(validation, labels, "validation")
        counts.append(ready.counts)
        train = merge_training(sup, pseudo, dedupe, id_col) if sup is not None else merge_training(pseudo.limit(0), pseudo, dedupe, id_col)
        rows = train.withColumn("role", F.lit("train")).unionByName(
            ready.records.withColumn("role", F.lit("validation")).withColumn("training_source", F.lit("validation")), allowMissingColumns=True)
    else:
        rows = refit_splits(sup, pseudo, mode, ratio, seed, dedupe, id_col)
    sources = rows.groupBy("role", "training_source").agg(F.count(F.lit(1)).alias("n"))
    merged = counts[0]
    for c in counts[1:]:
        merged = merged.unionByName(c)
    return Manifest(rows, sources, merged)


def training_windows(df: DataFrame, text: str = "text", spans: str = "spans", group: str = "sample_id", k: int = 0, seed: int = 42,
                     strategy: str = "whitespace", max_length: int = 384, overlap: int = 50, keep_empty: bool = False) -> DataFrame:
    """Tokenize, align, window; with ``k`` also group-safe folds over the windows."""
    samples = filter_empty(tokenized_samples(df, text, spans, strategy), keep_empty).drop(text, spans)
    windows = sliding_token_windows(samples, max_length, overlap, keep_empty)
    if k <= 0:
        return windows
    windows = written(windows, "training-windows")  # made once, for the folds and for the result
    labelled = windows.select(group, F.transform("ner", lambda s: s["label"]).alias("labels"))
    return assign_folds(windows, group_folds(labelled, group, k, seed), group)
