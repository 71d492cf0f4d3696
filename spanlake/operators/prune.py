"""Prune pseudolabel entities and rank records for review."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlake.functions.arrays import array_mean, bind
from spanlake.functions.text import preview, safe_double
from spanlake.operators.fields import resolve_entities, struct_fields, text_of
from spanlake.operators.filters import label_count_map
from spanlake.operators.ordering import top_n
from spanlake.operators.staging import once
from spanlake.schema import RANK_SCORE_FIELDS, TEXT_FIELDS


def entity_length(e: Column, known: Sequence[str]) -> Column:
    """end - start when that is positive, else the length of the mention, else 0."""
    text = F.coalesce(F.length(e["text"]), F.lit(0)) if "text" in known else F.lit(0)
    if "start" not in known or "end" not in known:
        return text
    return F.when(e["end"] > e["start"], e["end"] - e["start"]).otherwise(text)


def first_score(e: Column, fields: Sequence[str], known: Sequence[str]) -> Column:
    tries = [safe_double(e[f]) for f in fields if f in known]
    return F.coalesce(*tries) if tries else F.lit(None).cast("double")


# --------------------------------------------------------------------------- prune
def prune_entities(df: DataFrame, min_score: float = 0.0, label_min: Mapping[str, float] | None = None, max_k: int = 0,
                   score_fields: Sequence[str] = RANK_SCORE_FIELDS, labels: Sequence[str] | None = None,
                   drop_over_max: bool = False, trace: str = "_pseudolabel_prune") -> DataFrame:
    """Drop entities by label and score floor, then cap each record at ``max_k``.

    A missing score is below every floor.  Over the cap a record keeps its best ``max_k`` (score, length,
    start, end, label, position) or, with ``drop_over_max``, loses all entities.  Drop empty records
    afterwards with :func:`drop_pruned_empty` so the summary still sees them.
    """
    staged = resolve_entities(df, ("entities", "spans", "ner"), "_ents", key_name="_key")
    known = struct_fields(staged, "_ents")
    floor = F.lit(float(min_score))
    if label_min:
        table = F.create_map(*[F.lit(x) for k, v in label_min.items() for x in (k, float(v))])
    floors = (lambda e: F.coalesce(F.try_element_at(table, e["label"]), floor)) if label_min else (lambda e: floor)
    allowed = (lambda e: F.coalesce(e["label"].isin(*labels), F.lit(False))) if labels else (lambda e: F.lit(True))

    def mark(e: Column, i: Column) -> Column:
        return bind(first_score(e, score_fields, known), lambda s: F.struct(
            e.alias("e"), s.alias("s"), i.alias("i"), entity_length(e, known).alias("n"),
            F.when(~allowed(e), "label").when(F.coalesce(s, F.lit(float("-inf"))) < floors(e), "score").alias("why")))

    big = F.lit(10 ** 9)
    pos = lambda x, f: F.coalesce(x["e"][f], big) if f in known else big

    def rank(x: Column) -> Column:
        return F.struct((-F.coalesce(x["s"], F.lit(-1.0))).alias("a"), (-x["n"]).alias("b"), pos(x, "start").alias("c"),
                        pos(x, "end").alias("d"), F.coalesce(x["e"]["label"], F.lit("")).alias("f"), x["i"].alias("i"))

    def best(kept: Column) -> Column:
        chosen = F.slice(F.array_sort(F.transform(kept, lambda x: F.struct(rank(x).alias("k"), x["i"].alias("i")))), 1, max_k)
        return F.transform(chosen, lambda c: F.get(F.col("_m"), c["i"])["e"])

    staged = once(staged, _m=F.transform("_ents", mark))
    staged = once(staged, _kept=F.filter("_m", lambda x: x["why"].isNull()))
    over = (F.size("_kept") > max_k) if max_k > 0 else F.lit(False)
    plain = F.transform("_kept", lambda x: x["e"])
    if max_k > 0:
        capped = F.slice(plain, 1, 0) if drop_over_max else best(F.col("_kept"))
        staged = once(staged, _out=F.when(over, capped).otherwise(plain))
    else:
        staged = once(staged, _out=plain)
    gone = lambda why: F.size(F.filter("_m", lambda x: x["why"] == why))
    staged = staged.withColumn(trace, F.struct(
        F.col("_key").alias("entity_key"), F.size("_ents").alias("entities_before"), F.size("_out").alias("entities_after"),
        gone("score").alias("dropped_by_score"), gone("label").alias("dropped_by_label"),
        F.size(F.filter("_m", lambda x: x["s"].isNull() & F.coalesce(x["why"] != "label", F.lit(True)))).alias("missing_score"),
        (F.lit(0) if drop_over_max else F.size("_kept") - F.size("_out")).cast("int").alias("pruned_by_cap"),
        (over & F.lit(drop_over_max)).alias("dropped_tip_over_cap")))
    return staged.withColumn("entities", F.col("_out")).drop("_ents", "_key", "_m", "_kept", "_out")


def drop_pruned_empty(df: DataFrame) -> DataFrame:
    return df.filter(F.size("entities") > 0)


def prune_summary(df: DataFrame, drop_empty: bool = False, trace: str = "_pseudolabel_prune") -> DataFrame:
    """One row of totals, averages and drops by reason over a pruned (not yet emptied) DataFrame."""
    t = lambda f: F.coalesce(F.sum(F.col(f"{trace}.{f}").cast("bigint")), F.lit(0))
    total = F.count(F.lit(1))
    empty = F.count_if(F.col(f"{trace}.entities_after") == 0) if drop_empty else F.lit(0).cast("bigint")
    before, after = t("entities_before"), t("entities_after")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return df.agg(
        total.alias("tips_total"), (total - empty).alias("tips_kept"), empty.alias("tips_dropped_empty"),
        before.alias("entities_before"), after.alias("entities_after"), (before - after).alias("entities_removed"),
        ratio(before, total).alias("avg_entities_per_tip_before"), ratio(after, total - empty).alias("avg_entities_per_tip_after"),
        *[t(f).alias(f) for f in ("dropped_by_score", "dropped_by_label", "missing_score", "pruned_by_cap")],
        F.count_if(F.col(f"{trace}.dropped_tip_over_cap")).alias("dropped_tip_over_cap"))


def top_k_per_record(ents: DataFrame, k: int, id_col: str = "row_idx") -> DataFrame:
    """Long-form cap: the best ``k`` entities of each record (a record is a bounded group)."""
    w = W.partitionBy(id_col).orderBy(F.coalesce("score", F.lit(-1.0)).desc(), (F.col("end") - F.col("start")).desc(),
                                      "start", "end", "label", "ent_idx")
    return ents.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# --------------------------------------------------------------------------- rank
class RankConfig(NamedTuple):
    record_score_fields: Sequence[str] = ("record_score", "record_score_context_boosted", "score_relato_confianca")
    entity_score_fields: Sequence[str] = RANK_SCORE_FIELDS
    short_span_max_chars: int = 3
    high_score: float = 0.8
    low_score: float = 0.6
    min_record_score: float = 0.0
    max_entities: int = 0
    max_short_span_ratio: float = 1.0
    required_labels: Sequence[str] = ()


def candidate_quality(m: Column) -> Column:
    """Weighted quality of a feature struct; the weights are fixed values of the ranking rule."""
    density = F.least(m["entity_density_per_1k_chars"] / 30.0, F.lit(1.0))
    overload = F.least(F.greatest(m["organization_ratio"] - 0.5, F.lit(0.0)) / 0.5, F.lit(1.0))
    return (0.45 * F.coalesce(m["record_score"], m["mean_entity_score"]) + 0.30 * m["mean_entity_score"]
            + 0.15 * m["high_score_share"] + 0.10 * m["location_max_score"] - 0.20 * m["low_score_share"]
            - 0.20 * m["short_span_ratio"] - 0.15 * density - 0.10 * overload)


def candidate_features(df: DataFrame, cfg: RankConfig = RankConfig(), id_col: str = "row_idx",
                       text_fields: Sequence[str] = TEXT_FIELDS, name: str = "_candidate_rank") -> DataFrame:
    """Adds the feature struct (with ``candidate_quality_score``) to every record."""
    text, _ = text_of(df, text_fields, stripped=False)
    staged = resolve_entities(df, ("entities", "spans", "ner"), "_ents")
    known = struct_fields(staged, "_ents")
    slim = F.transform("_ents", lambda e: F.struct(
        F.coalesce(e["label"], F.lit("UNKNOWN")).alias("label"), first_score(e, cfg.entity_score_fields, known).alias("s"),
        entity_length(e, known).alias("n")))
    staged = once(staged, _slim=slim).withColumn("_len", F.length(text))
    staged = staged.withColumn("_sc", F.transform(F.filter("_slim", lambda x: x["s"].isNotNull()), lambda x: x["s"]))
    n = F.size("_slim")
    share = lambda cond: F.when(n > 0, F.size(F.filter("_slim", cond)) / n).otherwise(0.0)
    there = [f for f in cfg.record_score_fields if f in df.columns]
    record = F.coalesce(*[safe_double(F.col(f)) for f in there]) if there else F.lit(None).cast("double")
    used = F.coalesce(*[F.when(safe_double(F.col(f)).isNotNull(), F.lit(f)) for f in there], F.lit(""))
    places = F.transform(F.filter("_slim", lambda x: (x["label"] == "Location") & x["s"].isNotNull()), lambda x: x["s"])
    meta = F.struct(
        (F.col(id_col) + 1).alias("row_index_1based"), record.alias("record_score"), used.alias("record_score_field"),
        n.alias("entity_count"), F.col("_len").alias("text_length"),
        F.when(F.col("_len") > 0, n * 1000.0 / F.col("_len")).otherwise(0.0).alias("entity_density_per_1k_chars"),
        F.coalesce(array_mean(F.col("_sc")), F.lit(0.0)).alias("mean_entity_score"),
        F.array_min("_sc").alias("min_entity_score"), F.array_max("_sc").alias("max_entity_score"),
        share(lambda x: x["s"] >= cfg.high_score).alias("high_score_share"),
        share(lambda x: x["s"] < cfg.low_score).alias("low_score_share"),
        share(lambda x: x["n"] <= cfg.short_span_max_chars).alias("short_span_ratio"),
        F.coalesce(F.array_max(places), F.lit(0.0)).alias("location_max_score"),
        share(lambda x: x["label"] == "Organization").alias("organization_ratio"),
        label_count_map(F.col("_ents")).alias("label_counts"))
    return (once(staged, _meta=meta)
            .withColumn(name, F.col("_meta").withField("candidate_quality_score", candidate_quality(F.col("_meta"))))
            .drop("_ents", "_slim", "_len", "_sc", "_meta"))


def candidate_drop_reasons(df: DataFrame, cfg: RankConfig = RankConfig(), name: str = "_candidate_rank") -> DataFrame:
    """``drop_reason``: first failing filter, NULL when the candidate stays.  A missing record score passes."""
    m = lambda f: F.col(f"{name}.{f}")
    reason = F.when(m("record_score") < cfg.min_record_score, "record_score")
    if cfg.max_entities > 0:
        reason = reason.when(m("entity_count") > cfg.max_entities, "entity_count")
    reason = reason.when(m("short_span_ratio") > cfg.max_short_span_ratio, "short_span_ratio")
    if cfg.required_labels:
        reason = reason.when(~F.arrays_overlap(F.map_keys(m("label_counts")), F.array(*[F.lit(x) for x in cfg.required_labels])),
                             "required_labels")
    return df.withColumn("drop_reason", reason)


def filter_candidates(df: DataFrame, cfg: RankConfig = RankConfig()) -> DataFrame:
    return candidate_drop_reasons(df, cfg).filter(F.col("drop_reason").isNull()).drop("drop_reason")


def rank_candidates(df: DataFrame, n: int = 100, cfg: RankConfig = RankConfig(), id_col: str = "row_idx",
                    name: str = "_candidate_rank") -> DataFrame:
    """The best ``n`` candidates with ``rank`` 1..n (n = 0: all, numbered in range partitions).

    The top-n cut is Spark's bounded per-partition heap; only the n surviving rows are numbered together.
    """
    m = lambda f: F.col(f"{name}.{f}")
    order = [m("candidate_quality_score").desc(), F.coalesce(m("record_score"), F.lit(-1.0)).desc(),
             m("mean_entity_score").desc(), m("entity_count").asc(), F.col(id_col).asc()]
    if n <= 0:
        from spanlake.operators.ordering import with_position
        return with_position(df, order, "_pos").withColumn("rank", F.col("_pos") + 1).drop("_pos")
    best = df.orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)).cast("bigint"))


def candidate_report(ranked: DataFrame, text_fields: Sequence[str] = TEXT_FIELDS, name: str = "_candidate_rank") -> DataFrame:
    """The flat review table of ranked candidates."""
    m = lambda f: F.col(f"{name}.{f}")
    text, _ = text_of(ranked, text_fields, stripped=False)
    plain = ["row_index_1based", "candidate_quality_score", "record_score", "record_score_field", "entity_count", "text_length",
             "entity_density_per_1k_chars", "mean_entity_score", "min_entity_score", "max_entity_score", "high_score_share",
             "low_score_share", "short_span_ratio", "location_max_score", "organization_ratio"]
    counts = [F.coalesce(F.try_element_at(m("label_counts"), F.lit(x)), F.lit(0)).alias(f"{x.lower()}_count")
              for x in ("Location", "Organization", "Person")]
    return ranked.select("rank", *[m(f).alias(f) for f in plain], *counts, preview(text).alias("text_preview"))


def candidate_summary(selected: DataFrame, name: str = "_candidate_rank") -> DataFrame:
    """Averages over the selected rows."""
    m = lambda f: F.col(f"{name}.{f}")
    return selected.agg(F.count(F.lit(1)).alias("rows_selected"), F.avg(m("candidate_quality_score")).alias("avg_quality_score"),
                        F.avg(m("record_score")).alias("avg_record_score"), F.avg(m("entity_count")).alias("avg_entities_per_tip"),
                        F.max(m("entity_count")).alias("max_entities_per_tip"))


def candidate_drops(df: DataFrame, cfg: RankConfig = RankConfig()) -> DataFrame:
    """(outcome, n): kept rows and drops by first failing filter."""
    rows = candidate_drop_reasons(df, cfg)
    return rows.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
