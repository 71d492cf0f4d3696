"""Metadata-aware score boost: one projection per record, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.arrays import array_mean, bind
from spanlake.functions.text import informative_tokens, metadata_values, normalize_text, pick_score, safe_double
from spanlake.operators.fields import resolve_entities, struct_fields, text_of
from spanlake.operators.ordering import top_n
from spanlake.operators.staging import once
from spanlake.schema import BOOST_FALLBACK_FIELDS, METADATA_FIELDS

SCOPES = ("all-entities", "location-only", "matched-only", "location-matched-only")
POLICIES = ("any-metadata-in-text", "entity-metadata-overlap")

# Fixed values of the matching rule.
MIN_SCORE_FOR_MATCH = 0.5
MIN_SHARED_TOKENS = 2


@dataclass(frozen=True)
class BoostConfig:
    text_fields: Sequence[str] = ("relato", "text")
    metadata_fields: Sequence[str] = METADATA_FIELDS
    base_score_field: str = "score"
    fallback_score_fields: Sequence[str] = BOOST_FALLBACK_FIELDS
    output_score_field: str = "score_context_boosted"
    output_record_score_field: str = "record_score_context_boosted"
    factor: float = 1.2
    per_match: bool = False
    clamp: bool = True
    scope: str = "location-matched-only"
    match_policy: str = "any-metadata-in-text"
    location_labels: Sequence[str] = ("Location",)
    legacy_fields: bool = False

    def __post_init__(self) -> None:
        if self.factor <= 0:
            raise ValueError("the boost factor must be positive")
        if self.scope not in SCOPES:
            raise ValueError(f"unsupported boost scope: {self.scope}")
        if self.match_policy not in POLICIES:
            raise ValueError(f"unsupported match policy: {self.match_policy}")


def record_context_match(df: DataFrame, text_fields: Sequence[str], metadata_fields: Sequence[str],
                         name: str = "_match") -> DataFrame:
    """struct(text_field_used, matched array<field, value, norm, tokens>) - metadata found in the text."""
    text, used = text_of(df, text_fields)
    there = [f for f in metadata_fields if f in df.columns]
    none = F.array().cast("array<struct<field:string,value:string,norm:string,tokens:array<string>>>")
    staged = once(df.withColumn("_used", used), _norm=normalize_text(text))
    if there:
        folded = F.transform(metadata_values(there), lambda p: bind(normalize_text(p["value"]), lambda n: F.struct(
            p["field"].alias("field"), p["value"].alias("value"), n.alias("norm"), informative_tokens(n).alias("tokens"))))
        staged = once(staged, _meta=folded)
        found = F.filter("_meta", lambda m: (m["norm"] != "") & F.contains(F.col("_norm"), m["norm"]))
    else:
        staged, found = staged.withColumn("_meta", none), F.col("_meta")
    return staged.withColumn(name, F.struct(F.col("_used").alias("text_field_used"), found.alias("matched"))) \
        .drop("_used", "_norm", "_meta")


def entity_matches_metadata(entity: Column, matched: Column, fields: Sequence[str]) -> Column:
    """Does the mention name one of the matched metadata values?

    Needs a non-blank mention with informative tokens and a score of at least 0.5 (first available
    of boosted, calibrated, raw); then exact normalised equality or two shared informative tokens.
    """
    scores = [safe_double(entity[f]) for f in ("score_context_boosted", "score_calibrated", "score") if f in fields]
    score = F.coalesce(*scores, F.lit(-1.0))

    def body(norm: Column) -> Column:
        return bind(informative_tokens(norm), lambda tokens: (F.size(tokens) > 0) & F.exists(
            matched, lambda m: (m["norm"] == norm) | (F.size(F.array_intersect(tokens, m["tokens"])) >= MIN_SHARED_TOKENS)))

    return F.when(score >= MIN_SCORE_FOR_MATCH, bind(normalize_text(entity["text"]), body)).otherwise(F.lit(False))


def _in_scope(label: Column, matches: Column, cfg: BoostConfig) -> Column:
    place = F.coalesce(label.isin(*cfg.location_labels), F.lit(False))
    return {"all-entities": F.lit(True), "location-only": place, "matched-only": matches,
            "location-matched-only": place & matches}[cfg.scope]


def context_boost(df: DataFrame, cfg: BoostConfig = BoostConfig()) -> DataFrame:
    """Multiply entity scores where the record's metadata occurs in its text.

    Adds the output score and the trace fields to every scored entity, the mean boosted score to
    the record, and ``_context_boost_trace``.  Entities without a score stay as they are.
    """
    staged = resolve_entities(df, ("entities", "ner"), "_ents")
    known = struct_fields(staged, "_ents")
    order = [f for f in [cfg.base_score_field, *[x for x in cfg.fallback_score_fields if x != cfg.base_score_field]]
             if f in known]
    label = (lambda e: e["label"]) if "label" in known else (lambda e: F.lit(None).cast("string"))
    has_text = "text" in known
    staged = record_context_match(staged, cfg.text_fields, cfg.metadata_fields)
    count = F.size("_match.matched")
    power = F.pow(F.lit(float(cfg.factor)), F.greatest(F.lit(1), count)) if cfg.per_match else F.lit(float(cfg.factor))
    staged = (staged.withColumn("_hit", count > 0)
              .withColumn("_mult", F.when(count > 0, power).otherwise(F.lit(1.0))))

    reason = {
        "all-entities": "record-context-match", "location-only": "location-label-in-context-matched-record",
        "matched-only": "entity-overlaps-metadata", "location-matched-only": "location-entity-overlaps-metadata",
    }[cfg.scope]
    picked = (lambda e: pick_score(e, order)) if order else (
        lambda e: F.struct(F.lit(None).cast("double").alias("score"), F.lit("").alias("source")))

    def enrich(e: Column) -> Column:
        matches = entity_matches_metadata(e, F.col("_match.matched"), known) if has_text else F.lit(False)
        return bind(F.struct(picked(e).alias("p"), matches.alias("m")), lambda s: finish(e, s["p"], s["m"]))

    def finish(e: Column, p: Column, matches: Column) -> Column:
        on = F.col("_hit") & _in_scope(label(e), matches, cfg)
        scaled = p["score"] * F.when(on, F.col("_mult")).otherwise(F.lit(1.0))
        if cfg.clamp:
            scaled = F.when(p["score"].isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))
        scored = lambda c: F.when(p["score"].isNotNull(), c)
        return F.struct(
            e.alias("e"), p["score"].alias("before"), scaled.alias("after"), scored(p["source"]).alias("source"),
            scored(on).alias("on"), scored(F.when(on, F.col("_mult")).otherwise(F.lit(1.0))).alias("mult"),
            scored(matches).alias("matches"), scored(F.when(on, reason).otherwise("no-boost")).alias("why"))

    staged = once(staged, _x=F.transform("_ents", enrich))

    def rebuilt(x: Column) -> Column:
        added = {cfg.output_score_field: x["after"], "_context_boost_score_source": x["source"],
                 "_context_boost_applied": x["on"], "_context_boost_multiplier": x["mult"],
                 "_context_entity_metadata_match": x["matches"], "_context_boost_reason": x["why"]}
        if cfg.legacy_fields:
            added |= {"score_confianca": x["after"], "score_confianca_from": x["source"],
                      "score_confianca_factor": x["mult"]}
        old = {f: x["e"][f] for f in known}
        if cfg.output_score_field in old:  # an unscored entity keeps what it had
            added[cfg.output_score_field] = F.coalesce(x["after"], old[cfg.output_score_field])
        return F.struct(*[c.alias(n) for n, c in (old | added).items()])

    scored = F.filter("_x", lambda x: x["before"].isNotNull())
    mean = F.coalesce(array_mean(F.transform(scored, lambda x: x["after"])), F.lit(0.0))
    trace = F.struct(
        F.col("_match.text_field_used").alias("text_field_used"),
        F.transform("_match.matched", lambda m: m["field"]).alias("matched_metadata_fields"),
        F.transform("_match.matched", lambda m: m["value"]).alias("matched_metadata_values"),
        count.alias("match_count"), F.col("_hit").alias("record_context_match"),
        F.col("_mult").alias("boost_multiplier"), F.lit(cfg.scope).alias("boost_scope"),
        F.lit(cfg.match_policy).alias("match_policy"), F.size(F.filter("_x", lambda x: x["on"])).alias("boosted_entities"),
        F.size("_ents").alias("total_entities"),
        F.transform(scored, lambda x: F.struct(
            (x["e"]["text"] if has_text else F.lit("")).alias("text"), label(x["e"]).alias("label"),
            x["before"].alias("score_before"), x["after"].alias("score_after"), x["source"].alias("score_source"),
            x["on"].alias("boost_applied"), x["mult"].alias("boost_multiplier"),
            x["matches"].alias("entity_matches_metadata"), x["why"].alias("boost_reason"))).alias("entity_trace"))
    out = (staged.withColumn("entities", F.transform("_x", rebuilt))
           .withColumn(cfg.output_record_score_field, mean).withColumn("_context_boost_trace", trace))
    if cfg.legacy_fields:
        out = out.withColumn("score_relato_confianca", F.col(cfg.output_record_score_field))
    return out.drop("_ents", "_match", "_hit", "_mult", "_x")


def context_boost_stats(df: DataFrame, record_score: str = "record_score_context_boosted") -> DataFrame:
    """One row of totals and shares; denominators are at least 1."""
    t = "_context_boost_trace"
    total = F.greatest(F.count(F.lit(1)), F.lit(1))
    ents = F.coalesce(F.sum(F.col(f"{t}.total_entities").cast("bigint")), F.lit(0))
    boosted = F.coalesce(F.sum(F.col(f"{t}.boosted_entities").cast("bigint")), F.lit(0))
    matched = F.count_if(F.col(f"{t}.record_context_match"))
    return df.agg(
        F.count(F.lit(1)).alias("records_total"), ents.alias("entities_total"), boosted.alias("entities_boosted"),
        matched.alias("records_with_context_match"), (matched / total).alias("pct_records_with_context_match"),
        (boosted / F.greatest(ents, F.lit(1))).alias("pct_entities_boosted"),
        (F.coalesce(F.sum(record_score), F.lit(0.0)) / total).alias("avg_record_score"),
        (F.coalesce(F.sum(F.col(f"{t}.match_count").cast("bigint")), F.lit(0)) / total).alias("avg_metadata_matches_per_record"))


def context_boost_details(df: DataFrame, id_col: str = "row_idx") -> DataFrame:
    """One audit row per record."""
    extra = [c for c in ("sample_id", "id") if c in df.columns]
    return df.select((F.col(id_col) + 1).alias("row_index"), *extra, "_context_boost_trace.*")


# --------------------------------------------------------------------------- audit
def boosted_rows(details: DataFrame) -> DataFrame:
    """One flat row per boosted entity."""
    extra = [c for c in ("sample_id", "id") if c in details.columns]
    hits = details.select("row_index", *extra, "text_field_used",
                          F.array_join("matched_metadata_fields", ",").alias("matched_metadata_fields"),
                          F.array_join("matched_metadata_values", " | ").alias("matched_metadata_values"),
                          F.explode(F.filter("entity_trace", lambda e: e["boost_applied"])).alias("e"))
    return hits.select("row_index", *extra, "text_field_used", "matched_metadata_fields", "matched_metadata_values",
                       F.col("e.text").alias("entity_text"), F.col("e.label").alias("entity_label"),
                       "e.score_before", "e.score_after", "e.boost_multiplier", "e.score_source",
                       "e.entity_matches_metadata", "e.boost_reason")


def boost_audit_counts(details: DataFrame) -> DataFrame:
    """(kind, key, n): boosts by reason and by label, records by matched metadata field."""
    applied = F.filter("entity_trace", lambda e: e["boost_applied"])
    pairs = F.concat(
        F.transform(applied, lambda e: F.struct(F.lit("boost_reason").alias("kind"), e["boost_reason"].alias("key"))),
        F.transform(applied, lambda e: F.struct(F.lit("boosted_label").alias("kind"), e["label"].alias("key"))),
        F.transform("matched_metadata_fields", lambda f: F.struct(F.lit("matched_field").alias("kind"), f.alias("key"))))
    return details.select(F.explode(pairs).alias("p")).groupBy("p.kind", "p.key").agg(F.count(F.lit(1)).alias("n"))


def boost_audit_summary(details: DataFrame) -> DataFrame:
    """One row: records, matched records, records with boosts, candidates, boosts."""
    boosted = F.size(F.filter("entity_trace", lambda e: e["boost_applied"]))
    return details.agg(
        F.count(F.lit(1)).alias("records_total"), F.count_if("record_context_match").alias("records_with_context_match"),
        F.count_if(boosted > 0).alias("records_with_boosted_entities"),
        F.sum(F.size("entity_trace").cast("bigint")).alias("entity_candidates_total"),
        F.sum(boosted.cast("bigint")).alias("entity_boosts_total"))


def top_boosted_records(details: DataFrame, n: int = 20) -> DataFrame:
    """Records with most boosted entities, then highest boosted score, then input order."""
    hits = F.filter("entity_trace", lambda e: e["boost_applied"])
    rows = details.withColumn("_hits", hits).filter(F.size("_hits") > 0)
    extra = [c for c in ("sample_id", "id") if c in details.columns]
    rows = rows.select("row_index", *extra, F.size("_hits").alias("boosted_record_entities"),
                       "matched_metadata_fields", "matched_metadata_values",
                       F.array_max(F.transform("_hits", lambda e: F.coalesce(e["score_after"], F.lit(0.0))))
                       .alias("max_boosted_score_after"), F.slice("_hits", 1, 5).alias("boosted_entity_preview"))
    rows = rows.withColumnRenamed("boosted_record_entities", "boosted_entities")
    return top_n(rows, n, F.desc("boosted_entities"), F.desc("max_boosted_score_after"), F.col("row_index"))
