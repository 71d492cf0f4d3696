"""Samples, splits, folds, batches and chunks - exact sizes, reproducible, leakage-safe.

Membership is decided by seeded hash order.  Wherever a split is "the first n in hash order", the n-th digest
is computed as a scalar and the split is a filter on it: the records are neither sorted nor joined,
and a group holding a third of them is no problem.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlake.functions.text import digest
from spanlake.operators.merge import merge_training, tagged_union
from spanlake.operators.ordering import below_threshold, lookup_join, with_hash_position, with_position
from spanlake.operators.staging import written


def _rounded(total: Column, ratio: float) -> Column:
    """round-half-even(n * ratio) as in Python."""
    return F.bround(total * F.lit(float(ratio))).cast("bigint")


# --------------------------------------------------------------------------- chunks
def assign_chunks(df: DataFrame, size: int, shuffle: bool = False, seed: int = 42, id_col: str = "row_idx",
                  prefix: str = "chunk", dense: bool = False) -> DataFrame:
    """Adds ``pos``, ``chunk_id`` (from 1) and ``chunk_name`` (number padded to the chunk total, at least 2).

    Without ``shuffle`` positions follow ``id_col``; ``dense`` says it already counts 0.. and saves the numbering.
    """
    if size < 1:
        raise ValueError("the chunk size must be at least 1")
    if shuffle:
        numbered = with_hash_position(df, [id_col], seed)
    elif dense:
        numbered = df.withColumn("pos", F.col(id_col))
    else:
        numbered = with_position(df, [F.col(id_col)])
    chunks = df.agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("n")).scalar()
    width = F.greatest(F.lit(2), F.length(chunks.cast("string")))
    number = (F.floor(F.col("pos") / size) + 1).cast("bigint")
    return numbered.withColumn("chunk_id", number).withColumn("_w", width).withColumn("chunk_name", F.concat(
        F.lit(f"{prefix}_"), F.when(F.length(F.col("chunk_id").cast("string")) >= F.col("_w"), F.col("chunk_id").cast("string"))
        .otherwise(F.lpad(F.col("chunk_id").cast("string"), F.col("_w"), F.lit("0"))))).drop("_w")


# --------------------------------------------------------------------------- samples
def sample_rows(df: DataFrame, n: int, seed: int = 42, id_col: str = "row_idx", strict: bool = True) -> DataFrame:
    """Exactly ``n`` reproducible rows; asking for more than there are is an error when ``strict``."""
    if n < 1:
        raise ValueError("the sample size must be at least 1")
    if strict:
        target = lambda total: F.when(total < n, F.raise_error(F.concat(
            F.lit(f"sample size {n} exceeds the row count "), total.cast("string"))).cast("bigint")).otherwise(F.lit(n))
    else:
        target = lambda total: F.least(total, F.lit(n))
    return df.filter(below_threshold(df, [id_col], target, seed))


def sample_pseudolabels(df: DataFrame, ratio: float = 1.0, max_records: int = 0, seed: int = 42, id_col: str = "row_idx") -> DataFrame:
    """A share of the rows (at least 1), then at most ``max_records`` of those, drawn with seed + 1."""
    share = lambda n: F.greatest(F.lit(1), _rounded(n, ratio))
    if ratio >= 1.0:
        return sample_rows(df, max_records, seed + 1, id_col, strict=False) if max_records > 0 else df
    if max_records <= 0:
        return df.filter(below_threshold(df, [id_col], share, seed))
    # Both cuts are found on the ids alone, written once: the records are read for these and for the result.
    ids = written(df.select(id_col), "sample-ids")
    first = below_threshold(ids, [id_col], share, seed)
    second = below_threshold(df, [id_col], lambda n: F.least(n, F.lit(max_records)), seed + 1, population=ids.filter(first))
    return df.filter(below_threshold(df, [id_col], share, seed, population=ids) & second)


# --------------------------------------------------------------------------- splits
def split_train_val(df: DataFrame, ratio: float = 0.2, seed: int = 42, id_col: str = "row_idx", name: str = "role") -> DataFrame:
    """``validation`` for max(1, round(n * ratio)) rows, else ``train``; all train when nothing else would be left."""
    def target(n: Column) -> Column:
        val = F.greatest(F.lit(1), _rounded(n, ratio))
        return F.when(val >= n, F.lit(0)).otherwise(val)

    return df.withColumn(name, F.when(below_threshold(df, [id_col], target, seed), "validation").otherwise("train"))


def refit_splits(supervised: DataFrame, pseudolabels: DataFrame | None, mode: str = "supervised_plus_pseudolabels",
                 ratio: float = 0.2, seed: int = 42, dedupe: bool = True, id_col: str = "row_idx") -> DataFrame:
    """Training and validation rows with ``role`` and ``training_source``.

    Validation stays supervised-only and does not depend on the pseudolabels; these join train only.
    Pseudolabel-only mode splits the pseudolabels themselves.
    """
    if mode == "pseudolabel_only":
        return split_train_val(tagged_union([("pseudolabel", pseudolabels)]), ratio, seed, id_col)
    if mode not in ("supervised_only", "supervised_plus_pseudolabels"):
        raise ValueError(f"unsupported refit mode: {mode}")
    parted = split_train_val(supervised, ratio, seed, id_col)
    extra = pseudolabels if mode == "supervised_plus_pseudolabels" else None
    train = merge_training(parted.filter("role = 'train'").drop("role"), extra, dedupe, id_col).withColumn("role", F.lit("train"))
    val = tagged_union([("supervised", parted.filter("role = 'validation'").drop("role"))]).withColumn("role", F.lit("validation"))
    return train.unionByName(val, allowMissingColumns=True)


def group_split(df: DataFrame, group: str, val_size: float = 0.2, seed: int = 42, id_col: str = "row_idx", name: str = "role") -> DataFrame:
    """Group-safe split: ceil(groups * val_size) whole groups are validation.

    With a single group the first rounded share of rows (in id order) is validation instead, and all rows
    serve as both when that leaves no training row.
    """
    groups = df.select(group).distinct()
    if groups.limit(2).count() < 2:
        placed = with_position(df, [F.col(id_col)], "_pos")
        total = df.agg(F.count(F.lit(1))).scalar()
        placed = placed.withColumn("_n", F.greatest(F.lit(1), _rounded(total, val_size))).withColumn("_all", total)
        role = F.when(F.col("_pos") < F.col("_n"), F.when(F.col("_n") >= F.col("_all"), "both").otherwise("validation")).otherwise("train")
        return placed.withColumn(name, role).drop("_pos", "_n", "_all")
    target = lambda n: F.least(F.ceil(n * F.lit(float(val_size))).cast("bigint"), n - 1)
    pick = below_threshold(df, [group], target, seed, population=groups)
    return df.withColumn(name, F.when(pick, "validation").otherwise("train"))


def reshuffle_split(train: DataFrame, test: DataFrame, seed: int = 42, id_col: str = "row_idx") -> DataFrame:
    """Pool both sets and split again at the original sizes (``role``; ``origin`` says where a row came from)."""
    pool = train.withColumn("origin", F.lit("train")).unionByName(test.withColumn("origin", F.lit("test")), allowMissingColumns=True)
    size = train.agg(F.count(F.lit(1)).alias("n")).scalar()
    pick = below_threshold(pool, ["origin", id_col], lambda n: size, seed)
    return pool.withColumn("role", F.when(pick, "train").otherwise("test"))


def calibration_split(df: DataFrame, ratio: float = 0.5, seed: int = 42, mode: str = "random", id_col: str = "row_idx",
                      spans: str = "spans", name: str = "role") -> DataFrame:
    """``calibration`` for max(1, min(n - 1, round(n * ratio))) rows, else ``final_test``.

    ``heuristic`` balances labels: strata are label signatures, each gets its share of the target by largest
    remainder (so the total is exact), and rows are taken in hash order inside the stratum.
    """
    if not 0.0 < ratio < 1.0:
        raise ValueError("the calibration ratio must be between 0 and 1")
    size = lambda n: F.greatest(F.lit(1), F.least(n - 1, _rounded(n, ratio)))
    if mode == "random":
        return df.withColumn(name, F.when(below_threshold(df, [id_col], size, seed), "calibration").otherwise("final_test"))
    if mode != "heuristic":
        raise ValueError(f"unknown split mode: {mode}")
    labels = F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.coalesce(s["label"], F.lit("")))))
    rows = df.withColumn("_stratum", F.coalesce(F.to_json(labels), F.lit("[]")))
    counts = rows.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_n"))  # one row per label combination
    every = W.partitionBy(F.lit(0))
    share = counts.withColumn("_goal", size(F.sum("_n").over(every))) \
        .withColumn("_exact", F.col("_n") * F.col("_goal") / F.sum("_n").over(every)) \
        .withColumn("_base", F.floor("_exact"))
    left = F.col("_goal") - F.sum("_base").over(every)
    by_rest = every.orderBy((F.col("_exact") - F.col("_base")).desc(), F.col("_n").desc(), "_stratum")
    quota = share.withColumn("_left", left).withColumn("_quota", F.col("_base") + (F.row_number().over(by_rest) <= F.col("_left")).cast("int"))
    placed = with_hash_position(rows, [id_col], seed, ["_stratum"], "_pos")
    joined = lookup_join(placed, quota.select("_stratum", "_quota"), ["_stratum"], salts=16)
    return joined.withColumn(name, F.when(F.col("_pos") < F.col("_quota"), "calibration").otherwise("final_test")) \
        .drop("_stratum", "_pos", "_quota")


# --------------------------------------------------------------------------- folds
def group_profiles(df: DataFrame, group: str, labels: str = "labels") -> DataFrame:
    """(group, examples, spans, counts map label -> spans); ``labels`` is an array of span labels per record.

    Records and labels are counted in one pass, first per (group, label), so that a group with a third of all records is a
    partial sum per task.
    """
    named = F.transform(F.coalesce(labels, F.array()), lambda x: F.struct(F.lit(False).alias("record"), F.coalesce(x, F.lit(NO_LABEL)).alias("label")))
    record = F.array(F.struct(F.lit(True).alias("record"), F.lit("").alias("label")))
    per = df.select(group, F.explode(F.concat(record, named)).alias("_x")).groupBy(group, "_x").agg(F.count(F.lit(1)).alias("n"))
    span = ~F.col("_x.record")
    counts = F.array_sort(F.collect_list(F.when(span, F.struct(F.col("_x.label").alias("label"), "n"))))
    return per.groupBy(group).agg(
        F.sum(F.when(~span, F.col("n"))).alias("examples"), F.coalesce(F.sum(F.when(span, F.col("n"))), F.lit(0)).alias("spans"),
        F.map_from_entries(counts).alias("counts"))


def fold_count(df: DataFrame, group: str, requested: int) -> int:
    """The requested fold number, at most the number of groups; fewer than 2 groups is an error."""
    groups = df.select(group).distinct().limit(requested).count()
    if groups < 2:
        raise ValueError(f"at least 2 groups are needed, found {groups}")
    return min(requested, groups)


def group_folds(df: DataFrame, group: str, k: int = 5, seed: int = 42, labels: str = "labels") -> DataFrame:
    """(group, fold 1..k, examples, spans, counts): every group in one fold, balanced by labels and size.

    Groups are ordered by their rarest label, rarity, spans and examples and dealt round-robin: no fold is
    empty, group counts differ by at most one, and a label that is the rarest one of k groups is in every fold.
    """
    if k < 2:
        raise ValueError("at least 2 folds are needed")
    profiles = written(group_profiles(df, group, labels), "group-profiles")  # the records are read once
    if profiles.limit(k).count() < k:
        raise ValueError(f"need at least {k} groups")
    label_groups = profiles.select(F.explode(F.map_keys("counts")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("g"))
    # One row per label: the label inventory, read as a map in a scalar subquery.
    presence = label_groups.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "g")))).alias("m")).scalar()
    staged = profiles.withColumn("_m", presence)
    keys = F.transform(F.map_keys("counts"), lambda x: F.struct(F.element_at(F.col("_m"), x).alias("g"), x.alias("label")))
    staged = staged.withColumn("_keys", F.array_sort(keys)).drop("_m")
    rare = F.get("_keys", F.lit(0))
    rarity = F.aggregate("_keys", F.lit(0.0), lambda a, x: a + 1.0 / F.greatest(F.lit(1), x["g"]))
    staged = (staged.withColumn("_rare", F.coalesce(rare["g"], F.lit(2 ** 62))).withColumn("_label", F.coalesce(rare["label"], F.lit("")))
              .withColumn("_rarity", rarity).withColumn("_h", digest(seed, F.col(group))).drop("_keys"))
    order = [F.col("_rare").asc(), F.col("_label").asc(), F.col("_rarity").desc(), F.col("spans").desc(),
             F.col("examples").desc(), F.col("_h").asc(), F.col(group).asc()]
    placed = with_position(staged, order, "_pos")
    return placed.select(group, (F.pmod("_pos", F.lit(k)) + 1).cast("int").alias("fold"), "examples", "spans", "counts")


def assign_folds(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """Records with their ``fold``; records without a group share the fold of the NULL group.

    Salted keys spread a hot group.  A group that has no fold raises: no record is lost.
    """
    placed = lookup_join(df, folds.select(group, F.col("fold").alias("_fold")), [group], "left", salts=16, null_safe=True)
    missing = F.raise_error(F.concat(F.lit("no fold for group "), F.coalesce(F.col(group).cast("string"), F.lit("NULL")))).cast("int")
    return placed.withColumn("fold", F.coalesce("_fold", missing)).drop("_fold")


def fold_report(folds: DataFrame) -> DataFrame:
    """(fold, groups, examples, label, groups_with_label, label_spans); labels absent from a fold show 0."""
    per_fold = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("groups"), F.sum("examples").alias("examples"))
    pairs = folds.select("fold", F.explode("counts").alias("label", "n")).groupBy("fold", "label").agg(
        F.count(F.lit(1)).alias("groups_with_label"), F.sum("n").alias("label_spans"))
    names = pairs.agg(F.array_sort(F.collect_set("label")).alias("l")).scalar()
    frame = per_fold.withColumn("_names", names).select("*", F.explode_outer("_names").alias("label")).drop("_names")
    return frame.join(pairs, ["fold", "label"], "left").select(
        "fold", "groups", "examples", "label", F.coalesce("groups_with_label", F.lit(0)).alias("groups_with_label"),
        F.coalesce("label_spans", F.lit(0)).alias("label_spans"))


def fold_cost(folds: DataFrame, k: int) -> DataFrame:
    """One row: the balance cost (1 group + 1 example + 3 presence + 2 span + 10 missing + 1e6 empty).

    Lower is better; used to compare fold assignments.
    """
    report = fold_report(folds)
    per = report.select("fold", "groups", "examples").distinct()
    off = lambda v, goal, floor: F.pow((v - goal) / (F.greatest(F.lit(floor), goal) if floor else goal), 2)
    goal = lambda c: F.sum(c).over(W.partitionBy(F.lit(0))) / k
    sized = per.select(off(F.col("groups"), goal("groups"), 1.0).alias("g"), off(F.col("examples"), goal("examples"), 1.0).alias("e"))
    size_cost = sized.agg((F.sum("g") + F.sum("e")).alias("size"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("label")
    labelled = report.filter(F.col("label").isNotNull()).withColumn("_p", F.sum("groups_with_label").over(w) / k).withColumn("_s", F.sum("label_spans").over(w) / k)
    terms = labelled.groupBy("fold").agg(
        F.avg(off(F.col("groups_with_label"), F.col("_p"), None)).alias("p"), F.avg(off(F.col("label_spans"), F.col("_s"), None)).alias("s"),
        F.count_if(F.col("groups_with_label") == 0).alias("missing"))
    label_cost = terms.agg(F.coalesce(3 * F.sum("p") + 2 * F.sum("s") + 10 * F.sum("missing"), F.lit(0.0)).alias("c")).scalar()
    # A fold that holds no group at all never shows up above: it deviates by a full share everywhere.
    return size_cost.select((F.col("size") + label_cost + (F.lit(k) - F.col("n")) * (1e6 + 2)).alias("cost"))


def fold_pairs(df: DataFrame, k: int, keep: Sequence[str] = ("row_idx",)) -> DataFrame:
    """Every (record, split 1..k) with its role: ``test`` in its own fold's split, else ``train``.

    Only the columns ``keep`` and the fold are repeated k times, not whole records.
    """
    return df.select(*keep, "fold").withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn(
        "role", F.when(F.col("fold") == F.col("split"), "test").otherwise("train"))


# --------------------------------------------------------------------------- sampling weights, batches
#: Stands for a missing label as a map key, which can't be NULL.
NO_LABEL = "\u0000"


def sampling_weights(df: DataFrame, labels: str = "labels", name: str = "weight") -> DataFrame:
    """Per record the sum of 1 / (span count of label) over its distinct labels; 1.0 without labels.

    The label totals are one row per label, read as a map in a scalar subquery: no join, no shuffle of records.
    """
    named = F.transform(labels, lambda x: F.coalesce(x, F.lit(NO_LABEL)))  # a missing label counts like any other
    totals = df.select(F.explode(named).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    table = totals.agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m")).scalar()
    staged = df.withColumn("_m", table)
    total = F.aggregate(F.array_sort(F.array_distinct(named)), F.lit(0.0), lambda a, x: a + 1.0 / F.element_at(F.col("_m"), x))
    value = F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, F.greatest(total, F.lit(1e-8))).otherwise(1.0)
    return staged.withColumn(name, value).drop("_m")


def weighted_resample(df: DataFrame, draws: int | None = None, seed: int = 42, id_col: str = "row_idx", weight: str = "weight",
                      buckets: int = 4096) -> DataFrame:
    """``draws`` rows (default: as many as there are) with replacement, proportional to ``weight``.

    Returns (draw, id).  Records lie end to end on the weight axis, draw i points at a hashed spot of it.
    The axis is cut into ``buckets`` pieces; a record is copied into each piece it overlaps, and inside a piece
    one sorted pass carries the last record start forward to the draws: no pairs are formed.
    """
    ids = df.select(id_col, F.col(weight).cast("double").alias("_w")).withColumn("_d", digest(seed, F.col(id_col)))
    ids = ids.withColumn("_b", F.substring("_d", 1, 4))
    per = ids.groupBy("_b").agg(F.sum("_w").alias("_bw"))
    run = W.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select("_b", F.coalesce(F.sum("_bw").over(run), F.lit(0.0)).alias("_off"), F.sum("_bw").over(W.partitionBy(F.lit(0))).alias("_all"))
    inner = W.partitionBy("_b").orderBy("_d", id_col).rowsBetween(W.unboundedPreceding, -1)
    placed = ids.withColumn("_in", F.coalesce(F.sum("_w").over(inner), F.lit(0.0))).join(offsets, "_b")
    lo = (F.col("_off") + F.col("_in")) / F.col("_all")
    hi = (F.col("_off") + F.col("_in") + F.col("_w")) / F.col("_all")
    piece = lambda x: F.least(F.floor(x * buckets), F.lit(buckets - 1)).cast("int")
    starts = placed.select(F.col(id_col).alias("_id"), lo.alias("_lo"), F.explode(F.sequence(piece(lo), piece(hi))).alias("_p"))
    starts = starts.select("_p", F.greatest(F.col("_lo"), F.col("_p") / F.lit(float(buckets))).alias("_at"), F.lit(0).alias("_kind"), "_id",
                           F.col("_lo"), F.lit(None).cast("bigint").alias("draw"))
    if draws is None:
        draws = df.count()
    shots = df.sparkSession.range(draws).select(F.col("id").alias("draw"), hashed_uniform(F.col("id"), seed).alias("_at"))
    shots = shots.select(piece(F.col("_at")).alias("_p"), "_at", F.lit(1).alias("_kind"),
                         F.lit(None).cast(df.schema[id_col].dataType).alias("_id"), F.col("_at").alias("_lo"), "draw")
    w = W.partitionBy("_p").orderBy("_at", "_kind", "_lo").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = starts.unionByName(shots).withColumn("_hit", F.last("_id", ignorenulls=True).over(w))
    return carried.filter(F.col("_kind") == 1).select("draw", F.col("_hit").alias(id_col))


def hashed_uniform(i: Column, seed: int) -> Column:
    """A reproducible number in [0, 1) from 48 bits of the digest of ``seed:draw:i``."""
    hexa = F.md5(F.concat(F.lit(f"{seed}:draw:"), i.cast("string")))
    return F.conv(F.substring(hexa, 1, 12), 16, 10).cast("double") / F.lit(float(2 ** 48))


def assign_batches(df: DataFrame, batch_size: int, seed: int = 42, id_col: str = "row_idx", positive: Column | None = None) -> DataFrame:
    """Adds ``batch`` (from 0); every batch has at least one positive record.

    Negatives are capped at positives * (batch_size - 1), the rule of the batch sampler itself; an input without
    positives is an error.  The first positives in hash order open the batches and the rest are dealt in turn.
    """
    flag = positive if positive is not None else F.size("ner") > 0
    rows = df.withColumn("_pos", F.coalesce(flag, F.lit(False)))
    counts = rows.agg(F.count_if("_pos").alias("p"), F.count_if(~F.col("_pos")).alias("n"))
    p, n = F.col("p"), F.least(F.col("n"), F.col("p") * max(0, batch_size - 1))
    plan = counts.select(F.struct(p.alias("p"), n.alias("n"), F.least(F.greatest(F.lit(1), F.ceil((p + n) / batch_size)), p).alias("b")).alias("s")).scalar()
    ranked = with_hash_position(rows, [id_col], seed, ["_pos"], "_rank").withColumn("_plan", plan)
    none = F.raise_error(F.lit("a training set needs at least one record with entities")).cast("boolean")
    wanted = F.when(F.col("_plan.p") == 0, none).otherwise(F.col("_pos") | (F.col("_rank") < F.col("_plan.n")))
    kept = ranked.filter(wanted).withColumn("_b", F.col("_plan.b"))
    dealt = F.when(F.col("_pos"), F.col("_rank") - F.col("_b")).otherwise(F.col("_plan.p") - F.col("_b") + F.col("_rank"))
    batch = F.when(F.col("_pos") & (F.col("_rank") < F.col("_b")), F.col("_rank")).otherwise(F.pmod(dealt, F.col("_b")))
    return kept.withColumn("batch", batch.cast("bigint")).drop("_pos", "_rank", "_plan", "_b")
