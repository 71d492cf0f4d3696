"""Writers.  Every output is a folder of part files written in parallel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """UTF-8 JSON lines; absent (NULL) fields stay absent, non-ASCII text is kept as is."""
    df.write.mode(mode).option("ignoreNullFields", True).json(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], fixed: Mapping[str, int] | None = None,
              mode: str = "overwrite") -> None:
    """CSV with header and column order; ``fixed`` gives decimals for fixed-width numbers."""
    fixed = fixed or {}
    out = [F.format_string(f"%.{fixed[c]}f", F.col(c)).alias(c) if c in fixed else F.col(c) for c in columns]
    cells = [F.when(F.col(c).isNull(), "").otherwise(o).alias(c) if c in fixed else o for c, o in zip(columns, out)]
    df.select(*cells).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_kept_discarded(df: DataFrame, folder: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Both decisions in one pass: ``folder/decision=kept`` and ``folder/decision=discarded``."""
    df.write.mode(mode).partitionBy("decision").format(fmt).save(folder)


def write_chunks(df: DataFrame, folder: str, fmt: str = "json", mode: str = "overwrite") -> DataFrame:
    """One sub-folder per ``chunk_id`` (see ``assign_chunks``); returns the manifest.

    Chunks have a fixed size by construction, so hashing on the chunk id cannot be skewed.
    """
    spread = df.repartition("chunk_id").sortWithinPartitions("chunk_id", "pos")
    spread.write.mode(mode).partitionBy("chunk_id").format(fmt).save(folder)
    return chunk_manifest(df)


def chunk_manifest(df: DataFrame) -> DataFrame:
    """chunk_id, name, row_count, start_index, end_index_exclusive."""
    per = df.groupBy("chunk_id", "chunk_name").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("pos").alias("start_index"), F.max("pos").alias("_last"))
    return per.select("chunk_id", "chunk_name", "row_count", "start_index",
                      (F.col("_last") + 1).alias("end_index_exclusive"))
