"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of bytes.  In the order of (64-bit key, bytes) a block's integer name is its
key together with its rank among the different blocks of that key, so two blocks have one name if and only if they hold
the same bytes.  Only blocks whose key belongs to another block too are sorted; for all others the rank is 0.  Names of adjacent blocks are then named as
pairs in the same way, level by level, until every document has a single name.  No name rests on a
hash alone: blocks that share a key are told apart by their bytes, pairs by the names they are made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spanlake.llm.common import fresh, stored

#: Bytes of a block.
BLOCK = 4096


def _blocks(data: Column, size: int) -> Column:
    """The blocks of a binary value with their keys; an empty value is one empty block."""
    last = F.floor(F.greatest(F.octet_length(data) - 1, F.lit(0)) / size).cast("int")
    block = lambda i: F.substring(data, i * size + 1, F.lit(size))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(block(i)).alias("key"), block(i).alias("value")))


def shared_ranks(values: DataFrame, name: str) -> DataFrame:
    """(key, value, rank) of the values whose key also belongs to another value; mostly empty.

    Copies are combined before the shuffle.  The table is kept in the shared folder, so its size is known.
    """
    clash = stored(values.groupBy("key").agg(F.count_distinct("value").alias("n")).filter("n > 1").select("key"), f"{name}-keys")
    ranked = values.join(clash, "key", "left_semi").distinct()
    order = Window.partitionBy("key").orderBy("value")
    return stored(ranked.withColumn("rank", F.row_number().over(order) - 1), name)


def name_values(items: DataFrame, name: str) -> DataFrame:
    """``items`` (.., key, value) -> (.., key, rank): one name for equal values, different names for others."""
    ranks = shared_ranks(items.select("key", "value"), name)
    named = items.join(ranks, ["key", "value"], "left")
    kept = [c for c in items.columns if c not in ("key", "value")]
    return named.select(*kept, "key", F.coalesce("rank", F.lit(0)).alias("rank"))


def document_identities(docs: DataFrame, by: list[str], text: str, block: int = BLOCK) -> DataFrame:
    """(.., blocks, key, rank): the last three are equal for equal texts and for these only.

    ``by`` has to decide the text (an id and a digest, say); one row comes back per distinct ``by``.  NULL
    counts as empty.  There are log2(longest text / block) rounds, each on half the names of the one before.
    """
    source = docs.select(*by, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_data"))
    n = (F.floor(F.greatest(F.octet_length("_data") - 1, F.lit(0)) / block) + 1).cast("int")
    items = source.select(*by, n.alias("blocks"), F.posexplode(_blocks(F.col("_data"), block)).alias("pos", "b"))
    items = items.select(*by, "blocks", F.col("blocks").alias("left"), "pos", "b.key", "b.value")
    names, level, done = stored(name_values(items, "blocks"), "names"), 0, []
    while True:
        done.append(names.filter("left = 1").select(*by, "blocks", "key", "rank"))
        rest = names.filter("left > 1")
        if rest.isEmpty():
            break
        side = lambda c, odd: F.max(F.when(F.col("pos") % 2 == odd, F.col(c)))
        half = rest.groupBy(*by, "blocks", "left", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            side("key", 0).alias("k0"), side("rank", 0).alias("r0"), side("key", 1).alias("k1"), side("rank", 1).alias("r1"))
        # A last name without a partner is paired with a rank that no name has.
        pair = F.struct("k0", "r0", F.coalesce("k1", F.lit(0)).alias("k1"), F.coalesce("r1", F.lit(-1)).alias("r1"))
        paired = half.withColumn("value", pair).select(
            *by, "blocks", F.ceil(F.col("left") / 2).cast("int").alias("left"), "pos", F.xxhash64("value.*").alias("key"), "value")
        level += 1
        names = stored(name_values(stored(paired, f"pairs-{level}"), f"ranks-{level}"), f"names-{level}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.distinct()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Group equal texts; of each group the row with the largest id stays.

    One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.  A NULL text counts as empty.
    Of rows repeated with the same id and text only the first counts as kept; a NULL id loses against any other,
    and a group without ids keeps one row.  Other columns of ``docs`` play no part.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_sha", F.sha2("_text", 256))
    known = F.coalesce("_id", F.lit(0)), F.col("_id").isNull()
    rows = rows.select("_sha", "_text", known[0].alias("_id"), known[1].alias("_no_id"))
    by = ["_id", "_no_id", "_sha"]
    ids = document_identities(rows, by, "_text", block)
    copies = rows.groupBy(*by).agg(F.count("*").alias("_copies"))
    named = stored(copies.join(ids, by), "identities")
    same = ["blocks", "key", "rank"]
    groups = stored(named.groupBy(*same).agg(
        F.max(F.when(~F.col("_no_id"), F.col("_id"))).alias("keep_id"), F.sum("_copies").alias("group_size")), "groups")
    # Both sides are plain tables: Spark splits the partition of a group that holds much of the corpus.
    out = named.join(groups, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    real = F.when(~F.col("_no_id"), F.col("_id"))
    return out.select(real.alias(id_col), "keep_id", "group_size", (real.eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
                      F.col("_sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns as they are.

    Of rows repeated with the same id and text the smallest by all columns stays.
    """
    own, id_, sha, n = fresh(docs, "_sha", "_kept_id", "_kept_sha", "_n")
    found = exact_duplicates(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias(id_), F.col("text_sha256").alias(sha)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(sha))
    stay = docs.withColumn(own, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).join(found, same, "left_semi")
    again = stored(stay.groupBy(id_col, own).agg(F.count("*").alias(n)).filter(F.col(n) > 1).drop(n), "repeated")
    again = again.select(F.col(id_col).alias(id_), F.col(own).alias(sha))
    once = stay.join(again, same, "left_anti").drop(own)
    first = stay.join(again, same, "left_semi").groupBy(id_col, own).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return once.unionByName(first)
