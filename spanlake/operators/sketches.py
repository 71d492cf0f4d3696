"""Summaries of a run that can be merged with those of other runs without reading any record again.

Per group a run leaves one row: counts, an HLL sketch of the distinct texts, a KLL sketch of the scores, and the entities by label.  Rows of any
number of runs (or batches of a stream) merge into the same kind of row; sketches have a fixed size whatever they have seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.text import safe_double

#: log2 of the registers of a text sketch (standard error about 1.04 / 2^(LG_K / 2): 0.8 %), and the KLL parameter (rank error about 0.35 %).
LG_K, KLL_K = 14, 800


def sketch_run(df: DataFrame, groups: Sequence[str] = (), text: str = "text", entities: str = "entities", score: str = "score") -> DataFrame:
    """(groups, rows, texts, text_sketch, scored, score_sketch, labels): one pass and one partial aggregate per task and group.

    Blank and NULL texts are no texts; scores that are no number don't count; ``labels`` maps a label (NULL as UNKNOWN) to its entities.
    """
    digest = F.when(F.trim(F.col(text)) != "", F.sha2(F.col(text), 256))
    per = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), F.count(digest).alias("texts"), F.hll_sketch_agg(digest, F.lit(LG_K)).alias("text_sketch"))
    ents = df.select(*groups, F.explode(entities).alias("e")).select(*groups, F.coalesce("e.label", F.lit("UNKNOWN")).alias("label"), safe_double(F.col(f"e.{score}")).alias("s"))
    by_label = ents.groupBy(*groups, "label").agg(F.count(F.lit(1)).alias("n"), F.count("s").alias("scored"), F.kll_sketch_agg_double("s", F.lit(KLL_K)).alias("k"))
    return _beside(per, _labels(by_label, groups), groups)


def _labels(by_label: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows per (groups, label) as one row per group; as many entries as there are labels."""
    return by_label.groupBy(*groups).agg(F.sum("scored").alias("scored"), F.kll_merge_agg_double(F.when(F.col("scored") > 0, F.col("k")), F.lit(KLL_K)).alias("score_sketch"),
                                         F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"))


def _beside(per: DataFrame, more: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Join of two tables with one row per group, NULL groups included."""
    key = F.struct(*[F.col(g) for g in groups], F.lit(0).alias("_"))
    found = per.withColumn("_g", key).join(more.select(key.alias("_g"), "scored", "score_sketch", "labels"), "_g", "left").drop("_g")
    return found.withColumn("scored", F.coalesce("scored", F.lit(0))).withColumn("labels", F.coalesce("labels", F.create_map().cast("map<string,bigint>")))


def store_run(sketches: DataFrame, folder: str, run: str) -> None:
    """Keep the sketches of a run below ``folder``; storing a run again replaces it."""
    sketches.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/run={run}")


def stored_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The sketches of all runs, with their ``run``."""
    return spark.read.parquet(folder).withColumn("run", F.col("run").cast("string"))


def merge_runs(sketches: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Sketches of many runs as one row per group; the records themselves aren't read."""
    per = sketches.groupBy(*groups).agg(F.sum("rows").alias("rows"), F.sum("texts").alias("texts"), F.hll_union_agg("text_sketch").alias("text_sketch"))
    scores = sketches.groupBy(*groups).agg(F.sum("scored").alias("scored"), F.kll_merge_agg_double(F.when(F.col("scored") > 0, F.col("score_sketch")), F.lit(KLL_K)).alias("score_sketch"))
    labels = sketches.select(*groups, F.explode("labels").alias("label", "n")).groupBy(*groups, "label").agg(F.sum("n").alias("n"))
    maps = labels.groupBy(*groups).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"))
    key = F.struct(*[F.col(g) for g in groups], F.lit(0).alias("_"))
    both = scores.withColumn("_g", key).join(maps.select(key.alias("_g"), "labels"), "_g", "left").drop("_g")
    return _beside(per, both, groups)


def sketch_report(sketches: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75), groups: Sequence[str] = ()) -> DataFrame:
    """(groups, rows, unique_texts, duplicate_text_rows, scored, p25.., top_label, top_label_count) of sketched groups.

    Texts are estimates, at most the texts seen; a quantile is a score whose rank is off by ``KLL_K``'s error at most; labels are exact, of equal
    counts the first by name.
    """
    unique = F.least(F.hll_sketch_estimate("text_sketch"), F.col("texts"))
    entries = F.map_entries("labels")
    top = F.array_max(F.transform(entries, lambda e: F.struct(e["value"].alias("n"), e["key"].alias("label"))))
    first = F.array_min(F.transform(F.filter(entries, lambda e: e["value"] == top["n"]), lambda e: e["key"]))
    return sketches.select(
        *groups, "rows", unique.alias("unique_texts"), (F.col("texts") - unique).alias("duplicate_text_rows"), "scored",
        *[quantile("score_sketch", p).alias(f"p{round(100 * p)}") for p in probs], first.alias("top_label"), top["n"].alias("top_label_count"))


def quantile(sketch: str, p: float) -> Column:
    """A quantile of a KLL sketch; NULL for an empty or missing one."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(p))))
