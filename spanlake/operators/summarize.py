"""Grouped summaries over records, systems and runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.arrays import bind
from spanlake.functions.text import not_blank, safe_double
from spanlake.operators.evaluate import long_spans, match_spans
from spanlake.operators.fields import resolve_entities, struct_fields, text_of
from spanlake.operators.prune import first_score
from spanlake.operators.staging import once
from spanlake.schema import QUALITY_SCORE_FIELDS

SPAN_LISTS = ("spans", "entities", "ner")


def label_counts(df: DataFrame, keys: Sequence[str] = SPAN_LISTS, label: str = "label") -> DataFrame:
    """(label, n) of the first present list per record; a missing label counts as UNKNOWN."""
    rows = resolve_entities(df, keys, "_ents").select(F.explode("_ents").alias("e"))
    return rows.groupBy(F.coalesce(f"e.{label}", F.lit("UNKNOWN")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def corpus_totals(df: DataFrame, keys: Sequence[str] = SPAN_LISTS) -> DataFrame:
    """One row: records, entities, mean and largest entity count."""
    n = F.size("_ents")
    return resolve_entities(df, keys, "_ents").agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(n.cast("bigint")), F.lit(0)).alias("entities"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_entities"), F.coalesce(F.max(n), F.lit(0)).alias("max_entities"))


def distinct_labels(df: DataFrame, keys: Sequence[str] = ("entities", "ner", "spans")) -> DataFrame:
    """(label, n) of non-blank labels over all present lists, most frequent first."""
    labels = [F.coalesce(F.transform(k, lambda e: e["label"]), F.array().cast("array<string>")) for k in keys if k in df.columns]
    rows = df.select(F.explode(F.concat(*labels)).alias("label")).filter(not_blank(F.col("label")))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def duplicate_text_stats(df: DataFrame, text: Column | None = None, approximate: bool = False) -> DataFrame:
    """One row: records, distinct texts, duplicate rows and their rate.  Blank texts are no texts.

    Texts are grouped by digest, counted before the shuffle, so a copy that fills a third of the corpus is one
    partial count per task.  ``approximate`` uses a sketch instead of a shuffle.
    """
    if text is None:
        text, _ = text_of(df, ("relato", "text", "texto"))
    rows = df.select(F.when(text != "", F.sha2(text, 256)).alias("_d"))
    if approximate:
        per = rows.agg(F.count(F.lit(1)).alias("rows"), F.count("_d").alias("_t"), F.approx_count_distinct("_d", 0.01).alias("unique_texts"))
    else:
        per = rows.groupBy("_d").agg(F.count(F.lit(1)).alias("n")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("_d").isNotNull(), F.col("n"))), F.lit(0)).alias("_t"),
            F.count("_d").alias("unique_texts"))
    dup = F.greatest(F.col("_t") - F.col("unique_texts"), F.lit(0))
    return per.select("rows", "unique_texts", dup.alias("duplicate_text_rows"),
                      F.when(F.col("rows") > 0, dup / F.col("rows")).otherwise(0.0).alias("duplicate_text_rate"))


def kept_quality(df: DataFrame, strong: float = 0.8, weak: float = 0.5, groups: Sequence[str] = ()) -> DataFrame:
    """Quality of kept records (per group): entity, strong and weak counts, scores and duplicate texts.

    Records need ``entities`` and may have ``_split`` with ``score_value`` or ``score_used``.  First level: one
    partial aggregate per (group, text digest); second level: per group.
    """
    known = struct_fields(df, "entities")
    text, _ = text_of(df, ("relato", "text", "texto"))
    split = df.schema["_split"].dataType.fieldNames() if "_split" in df.columns else []
    record = F.coalesce(*[safe_double(F.col(f"_split.{f}")) for f in ("score_value", "score_used") if f in split],
                        F.lit(None).cast("double"))
    scores = F.filter(F.transform("entities", lambda e: first_score(e, QUALITY_SCORE_FIELDS, known)), lambda s: s.isNotNull())
    rows = once(df, _s=F.coalesce(scores, F.array().cast("array<double>"))).select(
        *groups, F.when(text != "", F.sha2(text, 256)).alias("_d"), record.alias("_r"),
        F.coalesce(F.size("entities"), F.lit(0)).alias("_n"), "_s")
    rows = rows.select(*groups, "_d", "_r", F.greatest("_n", F.lit(0)).alias("_n"),
                       F.size(F.filter("_s", lambda s: s >= strong)).alias("_strong"),
                       F.size(F.filter("_s", lambda s: s < weak)).alias("_weak"), F.array_max("_s").alias("_max"),
                       F.aggregate("_s", F.lit(0.0), lambda a, s: a + s).alias("_sum"), F.size("_s").alias("_scored"))
    first = rows.groupBy(*groups, "_d").agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in ("_n", "_strong", "_weak", "_max", "_sum", "_scored", "_r")],
        F.count("_max").alias("_maxn"), F.count("_r").alias("_rn"))
    n = F.sum("rows")
    dup = F.coalesce(F.sum(F.when(F.col("_d").isNotNull(), F.col("rows") - 1)), F.lit(0))
    ratio = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b))
    return first.groupBy(*groups).agg(
        n.alias("kept_rows"), F.count("_d").alias("unique_texts"), dup.alias("duplicate_text_rows"),
        (dup / n).alias("duplicate_text_rate"), (F.sum("_n") / n).alias("avg_entities_per_kept"),
        (F.sum("_strong") / n).alias("avg_strong_entities_per_kept"), (F.sum("_weak") / n).alias("avg_weak_entities_per_kept"),
        ratio("_max", "_maxn").alias("avg_max_entity_score"), ratio("_sum", "_scored").alias("avg_entity_score"),
        ratio("_r", "_rn").alias("avg_record_score_in_kept"))


def quality_flags(df: DataFrame, name: str = "flags") -> DataFrame:
    """Comma-joined warnings; NULL inputs raise none.  Missing columns count as NULL."""
    c = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("double")
    # The flag limits.
    tests = [("high_kept_count", c("kept_count") >= 100), ("duplicate_texts", c("duplicate_text_rate") >= 0.1),
             ("many_weak_entities", c("avg_weak_entities_per_kept") >= 1.0), ("no_context_boost", c("boosted_records") == 0),
             ("strong_negative_delta", c("micro_delta") <= -0.01), ("strong_positive_delta", c("micro_delta") >= 0.01)]
    return df.withColumn(name, F.array_join(F.array(*[F.when(t, F.lit(n)) for n, t in tests]), ","))


def top_label(df: DataFrame, groups: Sequence[str] = (), order: str = "row_idx", entities: str = "entities") -> DataFrame:
    """Most frequent label and its count (per group); the first seen wins ties."""
    rows = df.select(*groups, order, F.posexplode(entities).alias("_i", "e"))
    per = rows.groupBy(*groups, F.coalesce("e.label", F.lit("")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(order, "_i")).alias("_first"))
    # The largest count and, among equals, the smallest first position.
    best = F.min(F.struct((-F.col("n")).alias("k"), "_first", "label")).alias("b")
    return per.groupBy(*groups).agg(best).select(*groups, F.col("b.label").alias("top_label"), (-F.col("b.k")).alias("top_label_count"))


# --------------------------------------------------------------------------- runs
def run_table(*parts: DataFrame) -> DataFrame:
    """All run families in one wide table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def baseline_table(holdout: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Holdout scores; ``names`` maps a part of the experiment id to a display name."""
    model = F.lit(None).cast("string")
    for part, shown in (names or {}).items():
        model = F.coalesce(model, F.when(F.col("experiment_id").contains(part), F.lit(shown)))
    return holdout.select(F.coalesce(model, "experiment_id").alias("model"), "model_path", "micro_f1", "macro_f1", "person_f1",
                          "location_f1", "organization_f1", "holdout")


def pseudolabel_table(cycles: DataFrame) -> DataFrame:
    return cycles.select("experiment_id", "refit_mode", "prediction_map_location", "prediction_runtime_hms", "entities_total",
                         "kept_count", "kept_score_mean", "pseudolabel_train_size", "base_micro_f1", "refit_micro_f1",
                         "micro_f1_delta", "base_macro_f1", "refit_macro_f1", "macro_f1_delta")


def runtime_table(nested: DataFrame, holdout: DataFrame, cycles: DataFrame) -> DataFrame:
    pick = lambda df, device: df.select(F.col("experiment_id").alias("experiment"), "family", "runtime_hms", "runtime_seconds",
                                        device.alias("device"))
    return pick(holdout, F.col("map_location")).unionByName(pick(cycles, F.col("prediction_map_location"))).unionByName(
        pick(nested, F.lit("")))


# --------------------------------------------------------------------------- systems side by side
def compare_systems(systems: Mapping[str, DataFrame], id_col: str = "row_idx", entities: str = "entities") -> DataFrame:
    """One row per record: ``<system>_entities`` and ``<system>_entity_count`` of every system."""
    out = None
    for name, df in systems.items():
        one = df.select(id_col, F.col(entities).alias(f"{name}_entities"))
        out = one if out is None else out.join(one, id_col, "full")
    for name in systems:
        out = out.withColumn(f"{name}_entity_count", F.greatest(F.coalesce(F.size(f"{name}_entities"), F.lit(0)), F.lit(0)))
    return out


def system_label_counts(systems: Mapping[str, DataFrame], entities: str = "entities") -> DataFrame:
    """(system, label, n) over non-blank labels; one explode and one aggregation over the union."""
    rows = None
    for name, df in systems.items():
        one = df.select(F.lit(name).alias("system"), F.explode(entities).alias("e")).select("system", F.col("e.label").alias("label"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.filter(F.coalesce("label", F.lit("")) != "").groupBy("system", "label").agg(F.count(F.lit(1)).alias("n"))


def system_agreement(left: DataFrame, right: DataFrame, id_col: str = "row_idx", entities: str = "entities") -> DataFrame:
    """(label, both, left_only, right_only) exact spans of two systems."""
    m = match_spans(long_spans(left, entities, id_col), long_spans(right, entities, id_col), id_col)
    count = lambda s: F.count_if(F.col("status") == s)
    return m.groupBy("label").agg(count("TP").alias("both"), count("FN").alias("left_only"), count("FP").alias("right_only"))
