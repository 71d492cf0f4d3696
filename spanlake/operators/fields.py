"""Field resolution and label mapping on records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.text import primary_text
from spanlake.operators.staging import once


def struct_fields(df: DataFrame, column: str) -> list[str]:
    """Field names of an array-of-struct column."""
    kind = df.schema[column].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)):
        raise TypeError(f"'{column}' must be an array of structs")
    return kind.elementType.fieldNames()


def field_or_null(df: DataFrame, column: str, field: str, kind: str):
    """Accessor for a struct field that may be absent from the element type."""
    present = field in struct_fields(df, column)
    return (lambda e: e[field]) if present else (lambda e: F.lit(None).cast(kind))


def text_of(df: DataFrame, fields: Sequence[str], stripped: bool = True) -> tuple[Column, Column]:
    """``primary_text`` over those of ``fields`` that the DataFrame has."""
    there = [f for f in fields if f in df.columns]
    return primary_text(there, stripped) if there else (F.lit(""), F.lit(""))


def resolve_entities(df: DataFrame, keys: Sequence[str] = ("entities", "ner"), name: str = "entities",
                     key_name: str | None = None) -> DataFrame:
    """First list among ``keys`` (an absent or NULL column does not count); empty when none.

    The caller gives the order, e.g. entities, ner / entities, spans, ner / spans, entities, ner.
    All present columns must share one element type.
    """
    there = [k for k in keys if k in df.columns]
    if not there:
        raise ValueError(f"none of the columns {list(keys)} exists")
    kind = df.schema[there[0]].dataType.simpleString()
    out = df
    if key_name:
        out = out.withColumn(key_name, F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in there],
                                                  F.lit("entities")))
    return out.withColumn(name, F.coalesce(*[F.col(k).cast(kind) for k in there], F.array().cast(kind)))


def project_fields(df: DataFrame, keep: Sequence[str], coerce: str = "stringify", fill: str = "") -> DataFrame:
    """Only ``keep`` as strings: NULL or absent becomes ``fill``; other types follow ``coerce``
    (``stringify``, ``empty`` or ``error``)."""
    if coerce not in ("stringify", "empty", "error"):
        raise ValueError(f"unknown coercion: {coerce}")

    def one(name: str) -> Column:
        if name not in df.columns:
            return F.lit(fill).alias(name)
        if isinstance(df.schema[name].dataType, (T.StringType, T.NullType)):
            return F.coalesce(F.col(name).cast("string"), F.lit(fill)).alias(name)
        kind = df.schema[name].dataType
        text = F.to_json(F.col(name)) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else F.col(name).cast("string")
        if coerce == "stringify":
            value = text
        elif coerce == "empty":
            value = F.lit(None).cast("string")
        else:
            value = F.when(F.col(name).isNotNull(), F.raise_error(F.lit(f"field '{name}' has a non-string value"))).cast("string")
        return F.coalesce(value, F.lit(fill)).alias(name)

    extra = [c for c in ("row_idx", "file") if c in df.columns and c not in keep]
    return df.select(*extra, *[one(n) for n in keep])


def rename_label(df: DataFrame, source: str, target: str, ignore_case: bool = False,
                 entities: str = "entities", replaced: str | None = "labels_replaced") -> DataFrame:
    """Replace a label inside the entity array; ``replaced`` counts the changes per record."""
    hit = (lambda e: F.lower(e["label"]) == source.lower()) if ignore_case else (lambda e: e["label"] == source)
    out = df
    if replaced:
        out = out.withColumn(replaced, F.coalesce(F.size(F.filter(entities, hit)), F.lit(0)))
    return out.withColumn(entities, F.transform(entities, lambda e: e.withField(
        "label", F.when(hit(e), F.lit(target)).otherwise(e["label"]))))


def map_labels(df: DataFrame, mapping: Mapping[str, str], drop_unmapped: bool = False,
               fold_case: bool = False, entities: str = "entities") -> DataFrame:
    """Translate labels; unmapped ones pass through or are dropped.

    ``fold_case`` looks labels up stripped and lower-cased (for model labels such as ``person``).
    """
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    key = (lambda e: F.lower(F.trim(e["label"]))) if fold_case else (lambda e: e["label"])
    found = lambda e: F.try_element_at(table, key(e))
    arr = F.col(entities)
    if drop_unmapped:
        arr = F.filter(arr, lambda e: F.coalesce(found(e), F.lit("")) != "")
    return df.withColumn(entities, F.transform(arr, lambda e: e.withField("label", F.coalesce(found(e), e["label"]))))


def normalize_entity_shapes(df: DataFrame, payload: str, name: str = "entities") -> DataFrame:
    """One sorted list of (label, text, start, end) strings from a JSON payload column.

    Accepted shapes: list of objects, list of strings, or label -> mention / list of mentions /
    object.  A mention object's own label wins over the map key.
    """
    fields = ("label", "text", "start", "end")
    is_object = lambda v: F.trim(v).startswith("{")

    def from_object(v: Column, label: Column) -> Column:
        m = F.from_json(v, "map<string,string>")
        values = {f: F.try_element_at(m, F.lit(f)) for f in fields}
        values["label"] = F.coalesce(values["label"], label)
        return F.struct(*[F.coalesce(values[f], F.lit("")).alias(f) for f in fields])

    def from_text(v: Column, label: Column) -> Column:
        return F.struct(label.alias("label"), v.alias("text"), F.lit("").alias("start"), F.lit("").alias("end"))

    one = lambda v, label: F.when(is_object(v), from_object(v, label)).otherwise(from_text(v, label))
    listed = lambda v, label: F.transform(F.from_json(v, "array<string>"), lambda x: one(x, label))
    src = F.trim(F.col(payload))
    by_label = F.flatten(F.transform(
        F.map_entries(F.from_json(src, "map<string,string>")),
        lambda kv: F.when(F.trim(kv["value"]).startswith("["), listed(kv["value"], kv["key"]))
        .otherwise(F.array(one(kv["value"], kv["key"])))))
    empty = F.array().cast("array<struct<label:string,text:string,start:string,end:string>>")
    shaped = (F.when(src.startswith("["), listed(src, F.lit("")))
              .when(src.startswith("{"), by_label).otherwise(empty))
    return once(df, **{name: F.array_sort(F.coalesce(shaped, empty))})
