"""Shards by a k-d tree over metadata, of nearly equal bytes.

Equal texts are one point with the weight of all their copies.  A node is split at the weighted median along its widest
dimension; ties there are ordered by a hash of the text, so a median exists even where all points agree.  All
nodes of a level are split together: their medians come from three rounds of weight histograms, which
are summed before they are shuffled.  The texts are read once.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlake.llm.common import stored

#: Bits of a dimension's scale and of the tie hash in a point's place; bits that a histogram round resolves.
SCALE_BITS, TIE_BITS, ROUND_BITS = 20, 42, 14
#: Rows numbered by one window.
NUMBERED = 1024


def value_ranks(rows: DataFrame, name: str) -> DataFrame:
    """(_value, _rank): the distinct strings of a column, numbered in order from 0; dealt by ranges and numbered inside them."""
    values = stored(rows.select(F.col(name).alias("_value")).distinct().repartitionByRange("_value").withColumn("_part", F.spark_partition_id()), "values")
    counts = values.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")  # one row a range
    offsets = stored(counts.withColumn("_before", before).select("_part", "_before"), "value-offsets")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_value")) - 1
    return stored(values.withColumn("_at", inside).join(offsets, "_part").select("_value", (F.col("_at") + F.col("_before")).cast("double").alias("_rank")), "ranks")


def _numbered(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with the columns ``names`` as numbers: of strings the rank among all values."""
    for name in names:
        if dict(rows.dtypes)[name] == "string":
            # Both sides are plain tables or come from them: Spark splits the partition of a frequent value.
            ranks = value_ranks(rows, name)
            rows = rows.join(ranks, F.col(name) == F.col("_value")).withColumn(name, F.col("_rank")).drop("_value", "_rank")
    return rows


def _dimension(df: DataFrame, name: str) -> Column:
    """A dimension's value; NULL counts as empty."""
    if dict(df.dtypes)[name] == "string":
        return F.coalesce(F.col(name), F.lit(""))
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def kd_leaves(points: DataFrame, dims: list[str], leaves: int) -> DataFrame:
    """``points`` (key, weight, dims..) -> (key, leaf) with ``leaves`` leaves of nearly equal weight, numbered from 0.

    The tree has as many levels as ``leaves`` has bits; a node of n leaves is split in the ratio of n // 2 to the rest.
    """
    spans = points.agg(*[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).first()
    scale = {d: ((spans[f"hi_{d}"] or 0) - (spans[f"lo_{d}"] or 0)) or 1.0 for d in dims}
    tie = F.xxhash64("key").bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    at = points.withColumn("leaf", F.lit(0)).withColumn("n", F.lit(leaves))
    for _ in range(max(0, (leaves - 1).bit_length())):
        at = stored(at, "kd-level")
        bounds = [f(d).alias(f"{x}_{d}") for d in dims for x, f in (("lo", F.min), ("hi", F.max))]
        nodes = at.filter("n > 1").groupBy("leaf", "n").agg(F.sum("weight").alias("total"), *bounds)
        width = F.array(*[F.struct(((F.col(f"hi_{d}") - F.col(f"lo_{d}")) / F.lit(float(scale[d]))).alias("width"), F.lit(-i).alias("dim")) for i, d in enumerate(dims)])
        nodes = nodes.withColumn("dim", -F.array_max(width)["dim"])
        pick = lambda x: F.coalesce(*[F.when(F.col("dim") == i, F.col(f"{x}{d}")) for i, d in enumerate(dims)])
        nodes = stored(nodes.select("leaf", "n", "dim", pick("lo_").alias("lo"), pick("hi_").alias("hi"),
                                    (F.col("total") * F.floor(F.col("n") / 2) / F.col("n")).alias("goal")), "kd-nodes")
        # As many nodes as shards at most; Spark broadcasts them if their files are small.
        placed = at.join(nodes.drop("n"), "leaf", "left")
        share = F.when(F.col("hi") > F.col("lo"), (pick("") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
        place = F.shiftleft(F.floor(share * ((1 << SCALE_BITS) - 1)).cast("long"), TIE_BITS).bitwiseOR(tie)
        placed = stored(placed.withColumn("place", place).drop("lo", "hi", "dim", "goal"), "kd-places")
        cuts = nodes.select("leaf", "goal", F.lit(0).cast("long").alias("prefix"))
        for k in range((SCALE_BITS + TIE_BITS) // ROUND_BITS - 1):
            low = SCALE_BITS + TIE_BITS - ROUND_BITS * (k + 1)
            cell = F.shiftright("place", low)
            inside = placed.join(cuts, "leaf").filter(F.shiftright("place", low + ROUND_BITS) == F.col("prefix"))
            cells = inside.groupBy("leaf", "goal", cell.alias("cell")).agg(F.sum("weight").alias("w"))
            running = F.sum("w").over(Window.partitionBy("leaf").orderBy("cell"))  # 2^14 cells a node at most
            reach = cells.withColumn("upto", running).filter(F.col("upto") >= F.col("goal") - 0.5).groupBy("leaf").agg(
                F.min(F.struct("cell", "upto", "w", "goal")).alias("c"))
            cuts = stored(reach.select("leaf", F.col("c.cell").alias("prefix"), (F.col("c.goal") - (F.col("c.upto") - F.col("c.w"))).alias("goal"), F.col("c.w").alias("w")), "kd-cuts")
            keep = cuts.select("leaf", "prefix", (F.col("goal") * 2 >= F.col("w")).alias("with_cell"))
            cuts = cuts.drop("w")
        # The cell at the median goes to the side that it leaves more even.
        side = placed.join(keep, "leaf", "left")
        first = F.when(F.col("with_cell"), F.shiftright("place", low) <= F.col("prefix")).otherwise(F.shiftright("place", low) < F.col("prefix"))
        half = F.floor(F.col("n") / 2).cast("int")
        at = side.select("key", "weight", *dims, F.when(F.col("n") == 1, F.col("leaf")).when(first, F.col("leaf")).otherwise(F.col("leaf") + half).alias("leaf"),
                         F.when(F.col("n") == 1, F.col("n")).when(first, half).otherwise(F.col("n") - half).alias("n"))
    return at.select("key", "leaf")


def number_rows(rows: DataFrame, by: str, order: list[str], name: str, batch: int = NUMBERED) -> DataFrame:
    """``rows`` with ``name``: gapless numbers from 0 within each ``by``, in an order that the columns ``order`` decide.

    Rows are dealt into buckets of about ``batch`` by a hash; a bucket's rows are numbered together, after the
    rows of the buckets before it.
    """
    rows = stored(rows, "unnumbered")
    parts = max(1, ceil(rows.count() / batch))
    bucket = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = bucket.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_bucket")) - F.col("_n")
    offsets = stored(counts.withColumn("_before", before).select(by, "_bucket", "_before"), "offsets")
    inside = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*order)) - 1
    return bucket.withColumn("_at", inside).join(offsets, [by, "_bucket"]).withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_bucket", "_at", "_before")


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = ("source", "lang"),
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard of nearly equal bytes; give ``shards`` or the ``target_bytes`` of one.

    id, ``size`` (UTF-8 bytes of the text plus 1; a NULL text has none), ``text_crc32`` (unsigned; 0 for NULL), ``law`` ('bytes'), ``shard``, ``slot``
    (gapless from 0 in a shard), ``grown_shard`` (NULL under this law).  Equal texts, NULLs too, share a shard, so one text
    with more than a shard's bytes makes its shard larger.  Metadata are the text's bytes and the columns ``dims`` (of
    copies the smallest; NULL counts as empty; strings by their rank among all values); other columns play no part.  An empty table gives no rows.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give shards or target_bytes")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
                       F.coalesce(F.sha2(text_col, 256), F.lit("")).alias("key"), *[_dimension(docs, d).alias(f"dim_{i}") for i, d in enumerate(dims)])
    rows = stored(rows.withColumn("dim_bytes", F.log2(F.col("size").cast("double"))), "rows")
    names = ["dim_bytes", *[f"dim_{i}" for i in range(len(dims))]]
    points = stored(_numbered(rows.drop("id", "text_crc32"), names).groupBy("key").agg(F.sum("size").alias("weight"), *[F.min(d).alias(d) for d in names]), "points")
    if shards is None:
        total = points.agg(F.sum("weight")).first()[0] or 0
        shards = max(1, ceil(total / target_bytes))
    leaves = stored(kd_leaves(points, names, shards), "leaves")
    # Both sides are plain tables: Spark splits the partition of a text with very many copies.
    placed = rows.select("id", "size", "text_crc32", "key").join(leaves, "key").select("id", "size", "text_crc32", F.col("leaf").cast("int").alias("shard"))
    out = number_rows(placed, "shard", ["id", "text_crc32", "size"], "slot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
