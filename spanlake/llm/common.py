"""What the corpus operators share: words, row keys, tables kept in the shared folder, Python workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.session import scratch_path, ship_package

#: White space between words: space and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Planned bytes up to which Spark may broadcast a table of ids.  Spark goes by the size of the files, in which an id takes two bytes and more; on
#: the driver its row takes 90, so its own limit of 10 MB would let through 400 MB.
BROADCAST_BYTES = 256 << 10


def words_of(text: Column) -> Column:
    """The words of a text, in order; an empty list for NULL and for blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN, -1), "")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the folder all executors share, and read back.

    Cuts the lineage: a lost executor re-reads the files instead of computing the steps before again, and
    Spark knows the size of what it joins, so it broadcasts below its threshold only and
    can split the large partitions of a skewed join.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(side: DataFrame) -> DataFrame:
    """The smaller side of a join, for tables that grow with the corpus: a broadcast up to ``BROADCAST_BYTES`` only, sorted and merged above."""
    planned = int(str(side._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return side if planned <= BROADCAST_BYTES else side.hint("merge")


def row_key(*columns: Column) -> Column:
    """A 64-bit key of values; NULLs count (``xxhash64`` alone skips them)."""
    return F.xxhash64(*[x for c in columns for x in (c, c.isNull())])


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``docs`` doesn't have in any spelling."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def keep_rows(docs: DataFrame, verdicts: DataFrame, id_col: str, key: Column) -> DataFrame:
    """The rows of ``docs`` whose id and key are among the kept ``verdicts`` (_id, _key, kept), all columns as they are, whatever their names."""
    own, id_, kept = fresh(docs, "_key", "_kept_id", "_kept_key")
    stay = verdicts.filter("kept").select(F.col("_id").alias(id_), F.col("_key").alias(kept))
    return docs.withColumn(own, key).join(stay, F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(kept)), "left_semi").drop(own)


def python_ready(spark: SparkSession) -> None:
    """Python workers can import this package."""
    ship_package(spark)


def model_bytes(spark: SparkSession, path: str):
    """A tokenizer file of the driver (a few MB at most) as a broadcast value for the Python workers."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())
