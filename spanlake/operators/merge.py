"""Union, deduplication and cross-set leakage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.text import dedupe_key
from spanlake.operators.ordering import keep_first

REFIT_MODES = {  # mode -> (supervised, pseudolabels)
    "supervised_only": (True, False), "supervised_plus_pseudolabels": (True, True), "pseudolabel_only": (False, True)}


# --------------------------------------------------------------------------- merge
def tagged_union(sources: Sequence[tuple[str, DataFrame]], id_col: str = "row_idx") -> DataFrame:
    """Union with ``training_source`` and ``source_rank`` (earlier sources win ties)."""
    out = None
    for rank, (name, df) in enumerate(sources):
        one = df.withColumn("training_source", F.lit(name)).withColumn("source_rank", F.lit(rank))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def merge_training(supervised: DataFrame, pseudolabels: DataFrame | None, dedupe: bool = True, id_col: str = "row_idx",
                   text: str = "text") -> DataFrame:
    """Supervised rows first; equal texts (spaces collapsed, case folded) keep the first, blank texts all stay."""
    sources = [("supervised", supervised)] + ([("pseudolabel", pseudolabels)] if pseudolabels is not None else [])
    rows = tagged_union(sources, id_col)
    if not dedupe:
        return rows
    key = dedupe_key(F.col(text))
    return keep_first(rows, [key], order=("source_rank", id_col), passthrough=key == "")


def merge_counts(sources: Sequence[tuple[str, DataFrame]], merged: DataFrame) -> DataFrame:
    """(training_source, input, kept, dropped_duplicate)."""
    before = tagged_union(sources).groupBy("training_source").agg(F.count(F.lit(1)).alias("input"))
    after = merged.groupBy("training_source").agg(F.count(F.lit(1)).alias("kept"))
    return before.join(after, "training_source", "left").select(
        "training_source", "input", F.coalesce("kept", F.lit(0)).alias("kept"),
        (F.col("input") - F.coalesce("kept", F.lit(0))).alias("dropped_duplicate"))


def select_sources(mode: str, supervised: DataFrame, pseudolabels: DataFrame) -> list[tuple[str, DataFrame]]:
    """The training sources of a refit mode."""
    if mode not in REFIT_MODES:
        raise ValueError(f"unsupported refit mode: {mode}")
    use_sup, use_pseudo = REFIT_MODES[mode]
    return ([("supervised", supervised)] if use_sup else []) + ([("pseudolabel", pseudolabels)] if use_pseudo else [])


def accumulate(kept: Sequence[DataFrame], id_col: str = "row_idx", text: str = "text") -> DataFrame:
    """Kept records of several iterations, earlier ones winning equal texts; adds ``iteration``."""
    rows = None
    for i, df in enumerate(kept):
        one = df.withColumn("iteration", F.lit(i + 1))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    key = dedupe_key(F.col(text))
    return keep_first(rows, [key], order=("iteration", id_col), passthrough=key == "")


def dedupe_exact(df: DataFrame, keys: Sequence[str], id_col: str = "row_idx", per_file: str | None = None) -> DataFrame:
    """First row per exact key, within each file when ``per_file`` names the file column."""
    return keep_first(df, [*([per_file] if per_file else []), *keys], order=(id_col,))


# --------------------------------------------------------------------------- leakage between sets
def _sorted_fields(col: Column, kind: T.DataType) -> Column:
    """The value with struct fields in name order at every depth."""
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[
            _sorted_fields(col[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _sorted_fields(x, kind.elementType))
    return col


def row_digest(df: DataFrame, ignore: Sequence[str] = ("row_idx",)) -> Column:
    """SHA-256 of the row's JSON with sorted keys; the technical columns in ``ignore`` do not count."""
    names = sorted(c for c in df.columns if c not in ignore)
    return F.sha2(F.to_json(F.struct(*[_sorted_fields(F.col(c), df.schema[c].dataType).alias(c) for c in names])), 256)


def drop_seen_in(test: DataFrame, train: DataFrame, ignore: Sequence[str] = ("row_idx",)) -> DataFrame:
    """Test rows that do not occur, as a whole, in train.

    Train digests are made distinct first and test digests are looked up once per distinct digest; the rows
    are then picked by their unique id, so a row copied millions of times is no hot join key.
    """
    ids = [c for c in ignore if c in test.columns]
    if not ids:
        raise ValueError("the test rows need an id column")
    seen = train.select(row_digest(train, ignore).alias("_d"), F.lit(1).alias("_train"), F.lit(0).alias("_test"))
    mine = test.select(row_digest(test, ignore).alias("_d"), F.lit(0).alias("_train"), F.lit(1).alias("_test"))
    shared = seen.unionByName(mine).groupBy("_d").agg(F.max("_train").alias("a"), F.max("_test").alias("b")).filter("a = 1 and b = 1")
    from spanlake.operators.ordering import lookup_join
    marked = lookup_join(test.select(*ids, row_digest(test, ignore).alias("_d")), shared.select("_d", F.lit(True).alias("_hit")), ["_d"], salts=16)
    clean = marked.filter(F.col("_hit").isNull()).select(*ids)
    return test.join(clean, ids, "left_semi")


def common_rows(test: DataFrame, train: DataFrame, ignore: Sequence[str] = ("row_idx",)) -> DataFrame:
    """One row: number of distinct rows in both sets (one aggregation, no join)."""
    a = train.select(row_digest(train, ignore).alias("_d"), F.lit(1).alias("_train"), F.lit(0).alias("_test"))
    b = test.select(row_digest(test, ignore).alias("_d"), F.lit(0).alias("_train"), F.lit(1).alias("_test"))
    per = a.unionByName(b).groupBy("_d").agg(F.max("_train").alias("a"), F.max("_test").alias("b"))
    return per.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("common_rows"))
