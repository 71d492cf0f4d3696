"""Entity and record filters.  All work inside the record unless a top-n is asked for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.arrays import bind
from spanlake.functions.text import _SPACE, _WORD, fold_exact, mention_in, normalize_text, not_blank, strip, text_blocks
from spanlake.operators.fields import resolve_entities, struct_fields, text_of
from spanlake.operators.ordering import top_n
from spanlake.operators.staging import once
from spanlake.schema import GENERIC_TERMS, MODEL_MARKERS, TEXT_FIELDS, TRAINING_TEXT_FIELDS

#: Mentions made of word characters, spaces, hyphens, dots and apostrophes only.
VALID_MENTION = rf"^[{_WORD}À-ÿ{_SPACE}\-.']+\z"


def clean_entities(entities: Column, chunk_length: Column, check_text: bool = True) -> Column:
    """Drop model markers, offsets outside the chunk and (optionally) odd mentions."""

    def ok(e: Column) -> Column:
        text = F.coalesce(e["text"], F.lit(""))
        inside = (F.coalesce(e["start"], F.lit(-1)) >= 0) & (F.coalesce(e["end"], F.lit(0)) <= chunk_length)
        keep = ~strip(text).isin(*MODEL_MARKERS) & inside
        return keep & text.rlike(VALID_MENTION) if check_text else keep

    return F.filter(entities, ok)


def sanitize_spans(spans: Column, text: Column) -> Column:
    """Valid (start, end, label stripped) spans inside the text, sorted by start, end."""

    def body(n: Column) -> Column:
        valid = F.filter(spans, lambda s: F.coalesce(
            (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= n) & not_blank(s["label"]), F.lit(False)))
        slim = F.transform(valid, lambda s, i: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), i.alias("i"), strip(s["label"]).alias("label")))
        return F.transform(F.array_sort(slim), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))

    return bind(F.length(text), body)


# --------------------------------------------------------------------------- training input
def _reject_reason(e: Column, labels: Sequence[str] | None) -> Column:
    start, end = e["start"].try_cast("int"), e["end"].try_cast("int")
    reason = F.when(~not_blank(e["label"]), "invalid_label")
    if labels:
        reason = reason.when(~strip(e["label"]).isin(*labels), "filtered_by_label")
    return reason.when(start.isNull() | end.isNull() | (end <= start), "invalid_span")


def normalize_training_entities(df: DataFrame, labels: Sequence[str] | None = None,
                                keys: Sequence[str] = ("entities", "ner", "spans")) -> DataFrame:
    """Typed ``entities`` from the first present list, plus ``rejects`` (one reason per dropped
    entity) and ``entity_source``."""
    there = [k for k in keys if k in df.columns]
    source = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in there], F.lit(keys[-1]))
    slim = lambda k: F.transform(F.col(k), lambda e: F.struct(
        e["start"].cast("string").alias("start"), e["end"].cast("string").alias("end"), e["label"].alias("label")))
    raw = F.coalesce(*[slim(k) for k in there])

    def body(arr: Column) -> Column:
        marked = F.transform(arr, lambda e: F.struct(
            e["start"].try_cast("int").alias("start"), e["end"].try_cast("int").alias("end"),
            strip(e["label"]).alias("label"), _reject_reason(e, labels).alias("why")))
        good = F.transform(F.filter(marked, lambda m: m["why"].isNull()), lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["label"].alias("label")))
        why = F.transform(F.filter(marked, lambda m: m["why"].isNotNull()), lambda m: m["why"])
        return F.struct(good.alias("good"), why.alias("why"))

    out = once(df.withColumn("entity_source", source), _n=bind(raw, body))
    none = F.array().cast("array<struct<start:int,end:int,label:string>>")
    listed = raw.isNotNull()
    reasons = F.concat(F.coalesce("_n.why", F.array().cast("array<string>")),
                       F.when(~listed, F.array(F.lit("missing_entity_list")))
                       .when(F.size("_n.good") == 0, F.array(F.lit("no_valid_entities")))
                       .otherwise(F.array().cast("array<string>")))
    return (out.withColumn("rejects", reasons)
            .withColumn("entities", F.coalesce("_n.good", none)).drop("_n"))


def reject_counts(df: DataFrame) -> DataFrame:
    """(reason, n) over the ``rejects`` arrays."""
    return df.select(F.explode("rejects").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


class Prepared(NamedTuple):
    records: DataFrame
    counts: DataFrame


def prepare_training_records(df: DataFrame, labels: Sequence[str] | None = None, source: str = "unknown",
                             fields: Sequence[str] = TRAINING_TEXT_FIELDS) -> Prepared:
    """Records with text and at least one valid entity, their origin in ``_refit_input_meta``,
    and one row of counters by reason."""
    text, used = text_of(df, fields)
    staged = normalize_training_entities(df.withColumn("_text", text).withColumn("_used", used), labels)
    has_text, has_entity = F.col("_text") != "", F.size("entities") > 0
    records = staged.filter(has_text & has_entity).withColumn("text", F.col("_text")).withColumn(
        "_refit_input_meta", F.struct(F.col("_used").alias("text_source"), F.col("entity_source"),
                                      F.lit(source).alias("training_source")))
    per_record = F.concat(
        F.array(F.lit("input_records")),
        F.when(~has_text, F.array(F.lit("missing_text")))
        .when(~has_entity, F.concat(F.col("rejects"), F.array(F.lit("dropped_no_entities"))))
        .otherwise(F.concat(F.col("rejects"), F.array(F.lit("kept_records")))))
    counts = reject_counts(staged.select(per_record.alias("rejects"))).withColumn("source", F.lit(source))
    return Prepared(records.drop("_text", "_used", "rejects", "entity_source"), counts)


def drop_reasons(df: DataFrame, required: Sequence[str], drop_empty: Sequence[str] = ("relato",)) -> DataFrame:
    """``drop_reason``: first failing check of a projected record, NULL when it may stay."""
    reason = F.lit(None).cast("string")
    if drop_empty:
        blank = [~not_blank(F.col(c)) if c in df.columns else F.lit(True) for c in drop_empty]
        reason = F.when(_any(blank), "dropped_empty_relato")
    if required:
        reason = F.when(_any([~not_blank(F.col(c)) if c in df.columns else F.lit(True) for c in required]),
                        "dropped_missing_required").otherwise(reason)
    return df.withColumn("drop_reason", reason)


def require_fields(df: DataFrame, required: Sequence[str], drop_empty: Sequence[str] = ("relato",)) -> DataFrame:
    """Rows whose required fields are not blank."""
    return drop_reasons(df, required, drop_empty).filter(F.col("drop_reason").isNull()).drop("drop_reason")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


# --------------------------------------------------------------------------- generic terms
class Cleaned(NamedTuple):
    records: DataFrame
    removed: DataFrame


def remove_banned_spans(df: DataFrame, banlist: Mapping[str, Sequence[str]] | None = None,
                        id_col: str = "row_idx", lists: Sequence[str] = ("spans", "entities", "ner"),
                        fields: Sequence[str] = ("text", "relato", "texto", "description", "descricao")) -> Cleaned:
    """Remove spans whose normalised mention is a banned term of its normalised label.

    The ban list is configuration held in the plan as a label -> terms map; records never leave their
    row.  ``removed`` is the long report of what was taken out.
    """
    terms = {fold_exact(k, "NFKD"): sorted({fold_exact(t, "NFKD") for t in v} - {""})
             for k, v in (GENERIC_TERMS if banlist is None else banlist).items()}
    table = F.create_map(*[x for k, v in terms.items() if v
                           for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    there = [c for c in lists if c in df.columns]
    text = F.coalesce(*[F.when(F.col(f) != "", F.col(f)) for f in fields if f in df.columns], F.lit(""))
    staged = df.withColumn("_text", text)
    staged = once(staged, _blocks=text_blocks(F.col("_text")), _n=F.length("_text"))

    def marker(has_text: bool):
        own = (lambda e: e["text"]) if has_text else (lambda e: F.lit(None).cast("string"))

        def marked(e: Column) -> Column:
            mention = mention_in(F.col("_blocks"), F.col("_n"), e["start"], e["end"], own(e))
            terms_of = F.try_element_at(table, normalize_text(e["label"], "NFKD"))
            return bind(F.struct(mention.alias("m"), normalize_text(mention, "NFKD").alias("n")), lambda s: F.struct(
                e.alias("e"), s["m"].alias("mention"), s["n"].alias("norm"),
                F.coalesce((s["n"] != "") & F.array_contains(terms_of, s["n"]), F.lit(False)).alias("banned")))

        return marked

    staged = once(staged, **{f"_m_{c}": F.transform(F.col(c), marker("text" in struct_fields(df, c))) for c in there})
    records = staged.select(*[
        F.transform(F.filter(f"_m_{c}", lambda m: ~m["banned"]), lambda m: m["e"]).alias(c) if c in there else F.col(c)
        for c in df.columns])
    report = None
    for c in there:
        part = staged.select(F.col(id_col), F.lit(c).alias("span_key"),
                             F.explode(F.filter(f"_m_{c}", lambda m: m["banned"])).alias("m"))
        part = part.select(id_col, "span_key", F.col("m.e.label").alias("label"), F.col("m.mention").alias("mention"),
                           F.col("m.norm").alias("mention_normalized"), F.col("m.e.start").alias("start"),
                           F.col("m.e.end").alias("end"), F.lit("generic_term_banlist").alias("reason"))
        report = part if report is None else report.unionByName(part)
    return Cleaned(records, report)


def removed_terms(removed: DataFrame, n: int = 0) -> DataFrame:
    """Removed spans by label and term, most frequent first."""
    counts = removed.groupBy("label", "mention_normalized").agg(F.count(F.lit(1)).alias("removed"))
    return top_n(counts, n, F.desc("removed"), F.col("label"), F.col("mention_normalized"))


# --------------------------------------------------------------------------- mention rules
class SpanRule(NamedTuple):
    """One mention rule: ``full`` must match the whole mention, ``partial`` any part of it."""

    pattern: str
    mode: str = "full"
    exclude: bool = False
    ignore_case: bool = False


def filter_spans_by_regex(entities: Column, rules: Sequence[SpanRule]) -> Column:
    """Entities whose text passes every rule."""

    def ok(e: Column) -> Column:
        keep = F.lit(True)
        for r in rules:
            if r.mode not in ("full", "partial"):
                raise ValueError(f"unknown rule mode: {r.mode}")
            body = rf"\A(?:{r.pattern})\z" if r.mode == "full" else r.pattern
            hit = F.coalesce(e["text"], F.lit("")).rlike(f"(?i){body}" if r.ignore_case else body)
            keep = keep & (~hit if r.exclude else hit)
        return keep

    return F.filter(entities, ok)


def filter_empty(df: DataFrame, keep_empty: bool = False, entities: str = "ner") -> DataFrame:
    """Drop records without entities unless they are wanted."""
    return df if keep_empty else df.filter(F.coalesce(F.size(entities), F.lit(0)) > 0)


def dense_records(df: DataFrame, min_entities: int = 1, n: int = 0, id_col: str = "row_idx",
                  fields: Sequence[str] = TEXT_FIELDS) -> DataFrame:
    """Records with many entities: count desc, text length desc, input order; ``_dense_tip`` holds the features."""
    text, _ = text_of(df, fields, stripped=False)
    rows = resolve_entities(df, ("entities", "spans", "ner"), "_ents")
    meta = F.struct(F.col(id_col).alias("row_idx"), F.size("_ents").alias("entity_count"),
                    label_count_map(F.col("_ents")).alias("label_counts"), F.length(text).alias("text_length"))
    kept = rows.filter(F.size("_ents") >= min_entities).withColumn("_dense_tip", meta).drop("_ents")
    return top_n(kept, n, F.desc("_dense_tip.entity_count"), F.desc("_dense_tip.text_length"), F.col(id_col))


def label_count_map(entities: Column, missing: str = "UNKNOWN") -> Column:
    """label -> count of one entity array."""

    def body(labels: Column) -> Column:
        return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(labels)), lambda k: F.struct(
            k.alias("key"), F.size(F.filter(labels, lambda v: v == k)).cast("bigint").alias("value"))))

    return bind(F.transform(entities, lambda e: F.coalesce(e["label"], F.lit(missing))), body)
