"""Record scores, the kept/discarded split and its entity gate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.arrays import array_mean, array_median, array_p75, bind
from spanlake.functions.text import safe_double
from spanlake.operators.fields import resolve_entities, struct_fields
from spanlake.operators.staging import once

AGGREGATIONS = {"mean": array_mean, "max": F.array_max, "min": F.array_min, "median": array_median, "p75": array_p75}


def _entity_keys(first: str) -> list[str]:
    return [first, *[k for k in ("ner", "entities") if k != first]]


def _scores(df: DataFrame, list_col: str, field_name: str) -> Column:
    """Parsable scores of an entity list as an array<double>."""
    if field_name not in struct_fields(df, list_col):
        return F.array().cast("array<double>")
    return F.filter(F.transform(list_col, lambda e: safe_double(e[field_name])), lambda s: s.isNotNull())


def record_score(df: DataFrame, field_name: str = "score", how: str = "mean", empty: str = "zero",
                 entities: str = "entities", output: str = "record_score", alias: str | None = None,
                 trace: str | None = "_record_score_meta") -> DataFrame:
    """Aggregate the entity scores of each record.

    ``how``: mean, max, median or p75.  ``empty`` (no valid score): zero, null or error.  ``trace``
    adds valid and invalid counts; ``alias`` repeats the score under a second name.
    """
    if how not in ("mean", "max", "median", "p75"):
        raise ValueError(f"unsupported aggregation: {how}")
    if empty not in ("zero", "null", "error"):
        raise ValueError(f"unknown policy for empty records: {empty}")
    staged = resolve_entities(df, _entity_keys(entities), "_ents")
    staged = once(staged, _valid=_scores(staged, "_ents", field_name))
    value = AGGREGATIONS[how](F.col("_valid"))
    if empty == "zero":
        value = F.coalesce(value, F.lit(0.0))
    elif empty == "error":
        value = F.when(F.size("_valid") == 0, F.raise_error(F.lit(
            f"a record has no valid entity score in '{field_name}'")).cast("double")).otherwise(value)
    out = staged.withColumn(output, value)
    if alias:
        out = out.withColumn(alias, F.col(output))
    if trace:
        out = out.withColumn(trace, F.struct(
            F.lit(field_name).alias("score_field"), F.lit(how).alias("aggregation"),
            F.size("_valid").alias("valid_scores"), (F.size("_ents") - F.size("_valid")).alias("invalid_scores"),
            (F.size("_valid") == 0).alias("is_empty")))
    return out.drop("_ents", "_valid")


def record_score_stats(df: DataFrame, output: str = "record_score", trace: str = "_record_score_meta") -> DataFrame:
    """One row: records, empty records, valid and invalid scores, mean, min and max score."""
    return df.agg(
        F.count(F.lit(1)).alias("records_total"), F.count_if(F.col(f"{trace}.is_empty")).alias("records_empty"),
        F.coalesce(F.sum(F.col(f"{trace}.valid_scores").cast("bigint")), F.lit(0)).alias("valid_scores"),
        F.coalesce(F.sum(F.col(f"{trace}.invalid_scores").cast("bigint")), F.lit(0)).alias("invalid_scores"),
        F.avg(output).alias("score_mean"), F.min(output).alias("score_min"), F.max(output).alias("score_max"))


# --------------------------------------------------------------------------- split
def compare(value: Column, threshold: float, op: str) -> Column:
    """``ge``, ``gt``, ``le`` or ``lt``; false for NULL and NaN."""
    t = F.lit(float(threshold))
    tests = {"ge": value >= t, "gt": value > t, "le": value <= t, "lt": value < t}
    if op not in tests:
        raise ValueError(f"unsupported operator: {op}")
    return F.coalesce(tests[op] & ~F.isnan(value), F.lit(False))


def _has_key(df: DataFrame, name: str, raw: str | None) -> Column:
    """Is the key present?  With the raw JSON line an absent key differs from a null value."""
    if raw and raw in df.columns:
        return F.coalesce(F.array_contains(F.json_object_keys(F.col(raw)), name), F.lit(False))
    return F.lit(name in df.columns)


def resolve_score(df: DataFrame, score_field: str = "record_score", fallback: str | None = None,
                  missing: str = "zero", raw: str | None = None, name: str = "_score") -> DataFrame:
    """struct(value, source, reason).  The fallback counts only when the primary key is absent; a
    present but unparsable primary does not fall back.  ``missing``: zero, discard or error."""
    if missing not in ("zero", "discard", "error"):
        raise ValueError(f"unknown policy for missing scores: {missing}")

    def parsed(col: str | None) -> Column:
        return safe_double(F.col(col)) if col and col in df.columns else F.lit(None).cast("double")

    primary, second = _has_key(df, score_field, raw), _has_key(df, fallback, raw) if fallback else F.lit(False)
    value = F.when(primary, parsed(score_field)).when(second, parsed(fallback))
    source = F.when(primary, F.lit(score_field)).when(second, F.lit(fallback))
    reason = (F.when(primary & parsed(score_field).isNull(), "invalid_primary_score")
              .when(~primary & second & parsed(fallback).isNull(), "invalid_fallback_score")
              .when(~primary & ~second, "missing_score_fields"))
    out = df.withColumn("_v", value).withColumn("_why", reason)
    if missing == "zero":
        source = F.when(F.col("_v").isNull(), F.lit("implicit_zero")).otherwise(source)
        used = F.coalesce("_v", F.lit(0.0))
    elif missing == "discard":
        used = F.col("_v")
    else:
        used = F.coalesce("_v", F.raise_error(F.concat(
            F.lit(f"score '{score_field}' is missing or invalid: "), F.col("_why"))).cast("double"))
    return out.withColumn(name, F.struct(used.alias("value"), source.alias("source"),
                                         F.col("_why").alias("reason"))).drop("_v", "_why")


@dataclass(frozen=True)
class EntityGate:
    """Second test of a record that passed: an aggregate over the scores of some labels."""

    labels: Sequence[str] = field(default=("Location",))
    threshold: float = 0.5
    op: str = "ge"
    how: str = "max"
    score_field: str = "score"
    label_field: str = "label"
    entities: str = "entities"


def entity_gate(df: DataFrame, gate: EntityGate, name: str = "_gate") -> DataFrame:
    """struct(score, passed, reason, matched) of the gate for every record."""
    if gate.how not in ("mean", "max", "min"):
        raise ValueError(f"unsupported gate aggregation: {gate.how}")
    staged = resolve_entities(df, _entity_keys(gate.entities), "_ents")
    known = struct_fields(staged, "_ents")
    score = (lambda e: safe_double(e[gate.score_field])) if gate.score_field in known else (
        lambda e: F.lit(None).cast("double"))
    text = (lambda e: F.coalesce(e["text"], F.lit(""))) if "text" in known else (lambda e: F.lit(""))
    matched = F.filter(F.transform("_ents", lambda e: F.struct(
        text(e).alias("text"), e[gate.label_field].alias("label"), score(e).alias("score"))),
        lambda m: F.coalesce(m["label"], F.lit("")).isin(*gate.labels) & m["score"].isNotNull())
    staged = once(staged, _m=matched)
    value = AGGREGATIONS[gate.how](F.transform("_m", lambda m: m["score"]))
    staged = staged.withColumn("_v", value)
    return staged.withColumn(name, F.struct(
        F.col("_v").alias("score"), compare(F.col("_v"), gate.threshold, gate.op).alias("passed"),
        F.when(F.col("_v").isNull(), "no_matching_entities").alias("reason"), F.col("_m").alias("matched"))
    ).drop("_ents", "_m", "_v")


def split_records(df: DataFrame, score_field: str = "record_score", threshold: float = 0.5, op: str = "ge",
                  fallback: str | None = None, missing: str = "zero", gate: EntityGate | None = None,
                  raw: str | None = None, trace: str = "_split") -> DataFrame:
    """Adds ``decision`` (kept / discarded) and the full trace.  One projection, no shuffle."""
    staged = resolve_score(df, score_field, fallback, missing, raw)
    passed = F.col("_score.value").isNotNull() & compare(F.col("_score.value"), threshold, op)
    fields = [F.lit(score_field).alias("score_field"), F.lit(fallback).cast("string").alias("fallback_score_field"),
              F.col("_score.source").alias("score_source"), F.col("_score.value").alias("score_used"),
              F.lit(float(threshold)).alias("threshold"), F.lit(op).alias("operator"),
              F.col("_score.reason").alias("missing_reason")]
    keep = passed
    if gate:
        staged = entity_gate(staged.withColumn("_passed", passed), gate)
        keep = F.col("_passed") & F.col("_gate.passed")
        only = lambda c: F.when(F.col("_passed"), c)  # the gate counts only for records that passed
        fields.append(F.struct(
            F.array(*[F.lit(x) for x in gate.labels]).alias("labels"), F.lit(gate.how).alias("aggregation"),
            F.lit(gate.score_field).alias("score_field"), F.lit(float(gate.threshold)).alias("threshold"),
            F.lit(gate.op).alias("operator"), only(F.col("_gate.score")).alias("gate_score_used"),
            only(F.col("_gate.passed")).alias("gate_decision"),
            only(F.col("_gate.reason")).alias("gate_missing_reason"),
            only(F.col("_gate.matched")).alias("matched_entities")).alias("entity_gate"))
    out = staged.withColumn("decision", F.when(keep, "kept").otherwise("discarded"))
    out = out.withColumn(trace, F.struct(*fields, F.col("decision")))
    return out.drop("_score", "_passed", "_gate")


def split_summary(df: DataFrame, trace: str = "_split") -> DataFrame:
    """One row: totals, missing scores, gate rejections, score statistics of both sides.

    Records without a score are discarded but counted in neither score statistic.
    """
    kept = F.col("decision") == "kept"
    score = F.col(f"{trace}.score_used")
    gated = "entity_gate" in df.schema[trace].dataType.fieldNames()
    rejected = F.count_if(F.col(f"{trace}.entity_gate.gate_decision") == F.lit(False)) if gated else F.lit(0)
    side = lambda cond, name: [f(F.when(cond, score)).alias(f"{name}_score_{n}")
                               for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return df.agg(F.count(F.lit(1)).alias("records_total"), F.count_if(kept).alias("kept_count"),
                  F.count_if(~kept).alias("discarded_count"), F.count_if(score.isNull()).alias("missing_scores"),
                  rejected.cast("bigint").alias("entity_gate_rejections"), *side(kept, "kept"), *side(~kept, "discarded"))
