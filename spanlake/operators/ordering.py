"""Order-dependent operators without a global one-task sort.

Two ways to number rows at scale:

* *hash order* - the order key is a uniform 128-bit digest, so its first four hex digits cut
  the rows into 65536 even buckets.  A histogram of at most 65536 rows gives every bucket its
  offset, and each bucket is ranked by its own task.
* *value order* - any sort columns ending in a unique id.  Rows are range-partitioned, the
  partitions are written once to reliable storage, and per-partition totals give the offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlake.functions.text import digest
from spanlake.session import stable

BUCKET_DIGITS = 4


# --------------------------------------------------------------------------- hash order
def _histogram(digests: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, bucket, n, before, total): at most 65536 rows per group value."""
    hist = (digests.groupBy(*groups, F.substring("_d", 1, BUCKET_DIGITS).alias("_b"))
            .agg(F.count(F.lit(1)).alias("n")))
    w = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    run = w.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (hist.withColumn("before", F.sum("n").over(run) - F.col("n"))
            .withColumn("total", F.sum("n").over(w)))


def with_hash_position(df: DataFrame, ids: Sequence[str], seed: int | str = 42,
                       groups: Sequence[str] = (), name: str = "pos", total: str | None = None) -> DataFrame:
    """Number the rows 0.. in seeded-hash order, within each value of ``groups``.

    ``ids`` must identify a row; NULL groups are groups like any other.  A group that holds most of the rows is still ranked by
    65536 tasks, because the window is partitioned by group *and* hash bucket.
    """
    rows = df.withColumn("_d", digest(seed, *[F.col(c) for c in ids])) \
             .withColumn("_b", F.substring("_d", 1, BUCKET_DIGITS))
    hist = _histogram(rows.select("_d", *groups), groups).select(_packed(groups), "_b", "before", F.col("total").alias("_total"))
    keys = ["_g", "_b"]
    ranked = rows.withColumn("_g", _packed(groups)).withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("_d", *ids)) - 1)
    # One histogram row per (group, bucket); the large side already sits in the window's
    # partitioning, so it is not shuffled again.
    out = ranked.join(hist, keys).withColumn(name, F.col("before") + F.col("_r"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.select(*df.columns, name, *([total] if total else []))


def _packed(groups: Sequence[str]) -> Column:
    """The groups as one join key ``_g``: inside a struct NULL equals NULL, so no group is lost in a join."""
    return F.struct(*[F.col(g) for g in groups], F.lit(0).alias("_")).alias("_g")


def hash_threshold(df: DataFrame, ids: Sequence[str], target: Callable[[Column], Column],
                   seed: int | str = 42) -> Column:
    """The digest of the ``target(row count)``-th row in hash order, as a scalar subquery.

    ``digest(seed, ids) <= hash_threshold(...)`` then selects exactly that many rows with a plain
    filter: no sort, no join and no shuffle of the rows themselves.  NULL when the target is < 1.
    Only the one bucket that contains the boundary (1/65536 of the ids) is ranked.
    """
    d = df.select(digest(seed, *[F.col(c) for c in ids]).alias("_d"))
    hist = _histogram(d, ())
    edge = (hist.withColumn("want", target(F.col("total")).cast("bigint"))
            .filter((F.col("before") < F.col("want")) & (F.col("want") <= F.col("before") + F.col("n")))
            .select(F.col("_b"), (F.col("want") - F.col("before")).alias("k")))
    inside = d.withColumn("_b", F.substring("_d", 1, BUCKET_DIGITS)).join(F.broadcast(edge), "_b")  # <= 1 row
    ranked = inside.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy("_d")))
    return ranked.filter(F.col("_r") == F.col("k")).agg(F.max("_d")).scalar()


def below_threshold(df: DataFrame, ids: Sequence[str], target: Callable[[Column], Column],
                    seed: int | str = 42, population: DataFrame | None = None) -> Column:
    """Boolean column: is the row among the first ``target(n)`` in hash order?"""
    cut = hash_threshold(population if population is not None else df, ids, target, seed)
    return F.coalesce(digest(seed, *[F.col(c) for c in ids]) <= cut, F.lit(False))


# --------------------------------------------------------------------------- value order
def _ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-partition on the order columns and freeze the layout on reliable storage."""
    return stable(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))


def with_position(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Number rows 0.. in the given order; the order must end in a unique id.

    The offset table has one row per partition, a size the partition count bounds, so it is broadcast.
    """
    parts = _ranged(df, order)
    run = W.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = (parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
               .select("_p", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_off")))
    ranked = parts.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1)
    return (ranked.join(F.broadcast(offsets), "_p")
            .withColumn(name, (F.col("_off") + F.col("_r")).cast("bigint"))
            .select(*df.columns, name))


def running_totals(counts: DataFrame, groups: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """Add ``<s>_before`` and ``<s>_total`` for each column in ``sums``, per group in value order.

    ``counts`` holds one row per (groups, value), NULL groups included: hot values were already added up, so the range
    partitions are even.  Totals per (group, partition) are at most #groups x #partitions rows.
    """
    order = [*[F.col(g) for g in groups], F.col(value)]
    parts = _ranged(counts, order)
    per = parts.groupBy(*groups, "_p").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    base = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    before = base.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select(
        _packed(groups), "_p",
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(base).alias(f"{s}_total") for s in sums])
    parts = parts.withColumn("_g", _packed(groups))
    inside = W.partitionBy("_g", "_p").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    for s in sums:
        parts = parts.withColumn(f"_r_{s}", F.coalesce(F.sum(s).over(inside), F.lit(0)))
    out = parts.join(offsets, ["_g", "_p"])
    return out.select(*counts.columns,
                      *[(F.col(f"_o_{s}") + F.col(f"_r_{s}")).alias(f"{s}_before") for s in sums],
                      *[f"{s}_total" for s in sums])


def group_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one row per (groups, prob).

    The built-in ``percentile`` keeps all distinct values of a group in one task's buffer.  Here the
    distinct values are counted, ranked in range partitions, and only the rows on either
    side of each quantile position are kept.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_totals(counts, groups, value, ["_c"])
    asked = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    hits = (ranked.withColumn("prob", asked)
            .withColumn("_at", (F.col("_c_total") - 1) * F.col("prob"))
            .withColumn("_lo", F.floor("_at"))
            .withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_c_total") - 1)))
    covers = lambda k: (F.col("_c_before") <= F.col(k)) & (F.col(k) < F.col("_c_before") + F.col("_c"))
    return (hits.filter(covers("_lo") | covers("_hi"))
            .groupBy(*groups, "prob")
            .agg(F.max(F.when(covers("_lo"), F.col(value))).alias("_l"),
                 F.max(F.when(covers("_hi"), F.col(value))).alias("_h"),
                 F.first(F.col("_at") - F.col("_lo")).alias("_w"))
            .select(*groups, "prob", (F.col("_l") * (1 - F.col("_w")) + F.col("_h") * F.col("_w")).alias("quantile")))


# --------------------------------------------------------------------------- first per key, top n
def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str] = ("row_idx",),
               passthrough: Column | None = None) -> DataFrame:
    """First row per key in ``order`` (unique ids).  Rows where ``passthrough`` holds always stay.

    A hot key would make ``row_number`` sort all its rows in one task.  The smallest id per key is a
    plain partial aggregate instead, and the rows are picked by a semi join on that unique id.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select(*[(F.col(k) if isinstance(k, str) else k).cast("string").alias(n) for k, n in zip(keys, names)],
                      *[F.col(o) for o in order],
                      (passthrough if passthrough is not None else F.lit(False)).alias("_free"))
    # Length-prefixed parts: no two different key tuples give the same text.
    parts = [F.coalesce(F.concat(F.length(n).cast("string"), F.lit(":"), F.col(n)), F.lit("-")) for n in names]
    keyed = keyed.select(F.sha2(F.concat(*parts), 256).alias("_key"), *order, "_free")
    pick = F.min(F.struct(*order)) if len(order) > 1 else F.min(order[0])
    firsts = keyed.filter(~F.col("_free")).groupBy("_key").agg(pick.alias("_first"))
    firsts = firsts.select("_first.*") if len(order) > 1 else firsts.select(F.col("_first").alias(order[0]))
    if passthrough is None:
        return df.join(firsts, list(order), "left_semi")
    free = keyed.filter(F.col("_free")).select(*order)
    return df.join(firsts.unionByName(free), list(order), "left_semi")


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Ordered limit (``TakeOrderedAndProject``); ``n <= 0`` keeps every row, sorted."""
    ordered = df.orderBy(*order)
    return ordered.limit(n) if n > 0 else ordered


# --------------------------------------------------------------------------- joins with a lookup table
def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", salts: int = 0, null_safe: bool = False) -> DataFrame:
    """Join with a lookup table that has one row per key.

    Without ``salts`` Spark chooses: it broadcasts ``small`` by the size of its files or, at run time, of its shuffle, and splits
    the partition of a hot key otherwise.  With ``salts`` the lookup rows are repeated that often and both sides are
    hashed on (key, salt), for a ``small`` that is made by an aggregation and a key that holds much of ``big``.
    ``null_safe`` lets NULL keys meet.
    """
    keys = list(on)
    if null_safe:
        packed = F.struct(*keys, F.lit(0).alias("_"))
        big, small, keys = big.withColumn("_key", packed), small.withColumn("_key", packed).drop(*on), ["_key"]
    if salts:
        small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hashable = [c for c, t in big.dtypes if "map<" not in t and "variant" not in t]
        big = big.withColumn("_salt", F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int"))
        keys.append("_salt")
    return big.join(small, keys, how).drop("_salt", "_key")
