"""Fit, apply and judge score calibrators.

Fits are aggregations: the temperature grid is an array exploded next to each row and summed
with map-side partial aggregation, so only (label, temperature) sums are shuffled.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.arrays import bind, block_heads, sorted_rank
from spanlake.functions.text import clip01, safe_double
from spanlake.operators.fields import resolve_entities, struct_fields
from spanlake.operators.ordering import group_quantiles, lookup_join, running_totals, with_hash_position
from spanlake.operators.sketches import KLL_K, quantile
from spanlake.operators.staging import once, written
from spanlake.schema import LABELS, NLL_EPS, SCORE_EPS
from spanlake.session import stable

# Bounds and size of the temperature grid.
T_MIN, T_MAX, GRID = 0.5, 5.0, 181


# --------------------------------------------------------------------------- column math
def logit(p: Column) -> Column:
    x = clip01(p, SCORE_EPS)
    return F.ln(x / (1 - x))


def apply_temperature(p: Column, temperature: Column | float) -> Column:
    """sigmoid(logit(clipped p) / temperature)."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    c = clip01(p, SCORE_EPS)
    return 1 / (1 + F.exp(-F.ln(c / (1 - c)) / t))


def temperature_grid(t_min: float = T_MIN, t_max: float = T_MAX, size: int = GRID) -> list[float]:
    return [float(t) for t in np.linspace(t_min, t_max, size)]


# --------------------------------------------------------------------------- pairs and targets
def calibration_pairs(pred: DataFrame, gold: DataFrame, id_col: str = "row_idx") -> DataFrame:
    """One row per predicted entity with ``Validacao`` = 1 iff the exact span is gold.

    ``pred``: long (id, start, end, label, text, score); ``gold``: long (id, start, end, label, text).
    """
    keys = [id_col, "start", "end", "label"]
    truth = gold.groupBy(*keys).agg(F.min("text").alias("_ref"))
    joined = pred.join(truth, keys, "left")
    return joined.select(
        (F.col(id_col) + 1).alias("RowId"), F.col("label").alias("Label"),
        F.coalesce("_ref", F.lit("")).alias("Entidade_Referencia"), F.col("text").alias("Entidade_Predita"),
        F.col("start").alias("Start"), F.col("end").alias("End"), F.coalesce("score", F.lit(1.0)).alias("Score"),
        F.col("_ref").isNotNull().cast("int").alias("Validacao"))


def calibration_pairs_in_records(df: DataFrame, pred: str = "pred", gold: str = "gold", id_col: str = "row_idx") -> DataFrame:
    """``calibration_pairs`` for records that carry both entity lists: matched inside the record, no shuffle.

    Of several gold spans at one place the smallest text is the reference.
    """
    def side(column: str, number: int) -> Column:
        score = (lambda e: e["score"].cast("double")) if number else (lambda e: F.lit(None).cast("double"))
        return F.transform(F.coalesce(F.col(column), F.array().cast(df.schema[column].dataType)), lambda e: F.struct(
            e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label"), F.lit(number).alias("side"), e["text"].alias("text"), score(e).alias("score")))

    def paired(both: Column) -> Column:
        """Runs of one place, gold spans first; every predicted span of a run meets the run's first gold span."""
        same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["label"] == b["label"])
        firsts = F.filter(F.sequence(F.lit(0), F.size(both) - 1), lambda i: (i == 0) | ~F.coalesce(same(F.get(both, i - 1), F.get(both, i)), F.lit(False)))

        def run(starts: Column, at: Column, i: Column) -> Column:
            members = F.slice(both, at + 1, F.coalesce(F.get(starts, i + 1), F.size(both)) - at)
            head = F.get(both, at)
            gold_text = F.when(head["side"] == 0, F.struct(head["text"].alias("text")))
            return F.transform(F.filter(members, lambda m: m["side"] == 1), lambda m: F.struct(m.alias("p"), gold_text.alias("g")))

        return bind(firsts, lambda starts: F.flatten(F.transform(starts, lambda at, i: run(starts, at, i))))

    both = F.array_sort(F.concat(side(gold, 0), side(pred, 1)))
    staged = once(df.select(id_col, gold, pred), _b=both).filter(F.size("_b") > 0)
    rows = once(staged.select(id_col, "_b"), _m=paired(F.col("_b"))).select(id_col, F.explode("_m").alias("m"))
    return rows.select(
        (F.col(id_col) + 1).alias("RowId"), F.col("m.p.label").alias("Label"), F.coalesce("m.g.text", F.lit("")).alias("Entidade_Referencia"),
        F.col("m.p.text").alias("Entidade_Predita"), F.col("m.p.start").alias("Start"), F.col("m.p.end").alias("End"),
        F.coalesce("m.p.score", F.lit(1.0)).alias("Score"), F.col("m.g").isNotNull().cast("int").alias("Validacao"))


def scored_entities(df: DataFrame, score_field: str = "score", labels: Sequence[str] | None = LABELS,
                    id_col: str = "row_idx", entities: str = "entities") -> DataFrame:
    """Long (id, ent_idx, label, score clipped) of entities with a parsable score and an allowed label."""
    rows = df.select(id_col, F.posexplode(entities).alias("ent_idx", "e"))
    rows = rows.select(id_col, "ent_idx", F.coalesce("e.label", F.lit("")).alias("label"),
                       safe_double(F.col(f"e.{score_field}")).alias("score")).filter(F.col("score").isNotNull())
    rows = rows.filter(F.col("label").isin(*labels)) if labels else rows
    return rows.withColumn("score", clip01(F.col("score"), SCORE_EPS))


def pseudo_targets(ents: DataFrame, mode: str = "score-threshold", threshold: float = 0.9,
                   lower: float = 30.0, upper: float = 70.0) -> DataFrame:
    """Adds ``target`` and keeps the rows to fit on.

    ``score-threshold``: target = score >= threshold, all rows.  ``quantile-bands``: only scores at or beyond the
    two percentiles, target = score >= the upper one.
    """
    if mode == "score-threshold":
        return ents.withColumn("target", (F.col("score") >= threshold).cast("int"))
    if mode != "quantile-bands":
        raise ValueError(f"unsupported label source: {mode}")
    cuts = group_quantiles(ents.select("score"), [], "score", [lower / 100, upper / 100])
    low = cuts.filter(F.col("prob") == lower / 100).agg(F.max("quantile")).scalar()
    high = cuts.filter(F.col("prob") == upper / 100).agg(F.max("quantile")).scalar()
    return (ents.withColumn("_high", high).filter((F.col("score") <= low) | (F.col("score") >= F.col("_high")))
            .withColumn("target", (F.col("score") >= F.col("_high")).cast("int")).drop("_high"))


# --------------------------------------------------------------------------- temperature
def _grid_losses(df: DataFrame, groups: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """(groups, idx, t, loss_sum, n) - binary cross-entropy of every grid temperature in one pass.

    The loss of a row is log(1 + exp(-u / t)) with u the logit, negated for target 0, within the bounds that clipped
    probabilities give.  u is computed before the grid is exploded; the rest is generated code, and the partial
    aggregation leaves (groups, temperature) sums for the shuffle.
    """
    z = logit(F.col("score"))
    rows = once(df.select(*groups, "target", "score"), _u=F.when(F.col("target") == 1, z).otherwise(-z)).drop("score")
    rows = rows.select("*", F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("idx", "t"))
    loss = F.least(F.greatest(F.log1p(F.exp(-F.col("_u") / F.col("t"))), F.lit(-math.log1p(-SCORE_EPS))), F.lit(-math.log(SCORE_EPS)))
    return rows.groupBy(*groups, "idx", "t").agg(
        F.sum(loss).alias("loss_sum"), F.count(F.lit(1)).alias("n"), F.sum("target").alias("positives"))


def _best(losses: DataFrame, groups: Sequence[str]) -> DataFrame:
    """First minimum per group; groups with one target class are left out."""
    usable = losses.filter((F.col("positives") > 0) & (F.col("positives") < F.col("n")))
    pick = F.min(F.struct((F.col("loss_sum") / F.col("n")).alias("loss"), "idx", "t"))
    best = usable.groupBy(*groups).agg(pick.alias("_b"), F.first("n").alias("support")).filter(F.col("_b").isNotNull())
    return best.select(*groups, F.col("_b.t").alias("temperature"), F.col("_b.loss").alias("fit_loss"), "support")


def fit_temperature(df: DataFrame, t_min: float = T_MIN, t_max: float = T_MAX, size: int = GRID) -> DataFrame:
    """One row (temperature, fit_loss, support) from ``score`` and ``target``; no row with one target class."""
    return _best(_grid_losses(df, [], temperature_grid(t_min, t_max, size)), [])


def fit_temperature_per_class(df: DataFrame, t_min: float = T_MIN, t_max: float = T_MAX, size: int = GRID,
                              fallback: bool = True) -> DataFrame:
    """(label, temperature, fit_loss, support, overall, source) per label; ``overall`` is the global temperature.

    A label with one target class takes the global temperature (``global-fallback``), or none at all
    (``identity``) when there is no global one or ``fallback`` is off.  The global sums are the label sums
    added up: one pass over the rows serves both.
    """
    losses = _grid_losses(df, ["label"], temperature_grid(t_min, t_max, size))
    overall = _best(losses.groupBy("idx", "t").agg(*[F.sum(c).alias(c) for c in ("loss_sum", "n", "positives")]), [])
    own = _best(losses, ["label"]).drop("support")
    support = losses.groupBy("label").agg(F.max("n").alias("support"))
    joined = lookup_join(support, own, ["label"], null_safe=True).withColumn("_g", overall.select("temperature").scalar() if fallback
                                                           else F.lit(None).cast("double"))
    return joined.select(
        "label", F.coalesce("temperature", "_g").alias("temperature"), "fit_loss", "support", F.col("_g").alias("overall"),
        F.when(F.col("temperature").isNotNull(), "per-class").when(F.col("_g").isNotNull(), "global-fallback")
        .otherwise("identity").alias("source"))


# --------------------------------------------------------------------------- isotonic
#: Neighbouring stacks of blocks that one task merges.
FAN = 8


def _pool(blocks: list[list[float]], lo: float, hi: float, y: float, w: float) -> None:
    """Append a block (lowest and highest score, targets, rows) and pool it with the ones before while these are not below."""
    while blocks and blocks[-1][2] * w >= y * blocks[-1][3]:
        last = blocks.pop()
        lo, y, w = last[0], y + last[2], w + last[3]
    blocks.append([lo, hi, y, w])


_BLOCKS = "fold int, part long, lo double, hi double, y double, w double"


def isotonic_blocks(df: DataFrame, folds: int = 1, fan: int = FAN) -> DataFrame:
    """(fold, lo, hi, y, w): blocks of the monotone fit of ``target`` on ``score``, for each fold from the rows of all other ones.

    Rows of equal score are added up, the distinct scores are range-partitioned, and one pass pools adjacent violators in every
    partition for all folds.  Neighbouring partitions are then merged ``fan`` by ``fan``, as pooling the blocks of both gives the fit of
    both together: the order of pooling does not matter.  Every round is written; only the number of stacks and the totals of each
    fold come back to the driver.  There are as many blocks as the fit has steps, at most the two-thirds power of the scores in order of size.
    """
    own = (lambda f: F.lit(True)) if folds == 1 else (lambda f: F.col("fold") != f)
    pooled = df.groupBy("score").agg(
        *[F.sum(F.when(own(f), F.col("target").cast("double")).otherwise(0.0)).alias(f"y{f}") for f in range(folds)],
        *[F.sum(F.when(own(f), 1.0).otherwise(0.0)).alias(f"w{f}") for f in range(folds)])

    def frame(found: list[list[list[float]]], part: int):
        return pd.DataFrame([(f, part, *b) for f, blocks in enumerate(found) for b in blocks], columns=["fold", "part", "lo", "hi", "y", "w"])

    def blocks_of(batches):
        from pyspark import TaskContext
        found: list[list[list[float]]] = [[] for _ in range(folds)]
        for batch in batches:
            x = batch["score"].to_numpy()
            for f, blocks in enumerate(found):
                w = batch[f"w{f}"].to_numpy()
                there = w > 0
                for s, y, n in zip(x[there].tolist(), batch[f"y{f}"].to_numpy()[there].tolist(), w[there].tolist()):
                    _pool(blocks, s, s, y, n)
        yield frame(found, TaskContext.get().partitionId())

    def merge(group):
        blocks: list[list[float]] = []
        for lo, hi, y, w in group.sort_values("lo")[["lo", "hi", "y", "w"]].itertuples(index=False, name=None):
            _pool(blocks, lo, hi, y, w)
        return frame([blocks], int(group["part"].iloc[0]) // fan).assign(fold=int(group["fold"].iloc[0]))

    ranged = pooled.repartitionByRange("score").sortWithinPartitions("score")
    parts = written(ranged.mapInPandas(blocks_of, _BLOCKS), "isotonic-blocks")
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        # Numbers of stacks shrink by ``fan`` a round; neighbours stay neighbours.
        parts = written(parts.groupBy("fold", F.floor(F.col("part") / fan)).applyInPandas(merge, _BLOCKS), "isotonic-blocks")
    totals = {r["fold"]: (r["y"], r["w"]) for r in parts.groupBy("fold").agg(F.sum("y").alias("y"), F.sum("w").alias("w")).collect()}
    if not all(f in totals and 0 < totals[f][0] < totals[f][1] for f in range(folds)):
        raise ValueError("isotonic fitting needs both positive and negative targets")
    return parts.drop("part")


def _knots(blocks: DataFrame) -> DataFrame:
    """(fold, x, y) of blocks: both ends of every block, one knot where they are the same."""
    ends = F.when(F.col("lo") < F.col("hi"), F.array("lo", "hi")).otherwise(F.array("lo"))
    return blocks.select("fold", F.explode(ends).alias("x"), (F.col("y") / F.col("w")).alias("y"))


def isotonic_knots(df: DataFrame, folds: int = 1) -> list[tuple[tuple[float, ...], tuple[float, ...]]]:
    """``isotonic_blocks`` as (x, y) knots of each fold on the driver: parameters, to be stored and put into plans."""
    rows = _knots(isotonic_blocks(df, folds)).collect()
    out = []
    for f in range(folds):
        knots = sorted((r.x, r.y) for r in rows if r.fold == f)
        out.append((tuple(x for x, _ in knots), tuple(y for _, y in knots)))
    return out


def fit_isotonic(df: DataFrame) -> DataFrame:
    """Knot table (x, y) of the monotone fit of ``target`` on ``score``; the knots stay in the cluster."""
    return _knots(isotonic_blocks(df)).drop("fold")


def interpolate(score: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Linear interpolation between knots, flat outside; NULL for NULL and NaN.

    The knots are two literals of the plan, folded from text when it is made.
    """
    knots_x, knots_y = (F.split(F.lit(",".join(repr(float(v)) for v in vals)), ",").cast("array<double>") for vals in (xs, ys))

    def body(s: Column) -> Column:
        return bind(F.struct(knots_x.alias("x"), knots_y.alias("y")), lambda k: bind(
            sorted_rank(k["x"], block_heads(k["x"]), s, inclusive=True), lambda n: _segment(s, k["x"], k["y"], n, len(xs))))

    return F.when(score.isNotNull() & ~F.isnan(score), bind(score, body))


def _segment(s: Column, xs: Column, ys: Column, n: Column, size: int) -> Column:
    """Value at ``s`` when ``n`` knots are <= s."""
    at = lambda arr, i: F.get(arr, i.cast("int"))
    slope = (at(ys, n) - at(ys, n - 1)) / (at(xs, n) - at(xs, n - 1))
    inner = slope * (s - at(xs, n - 1)) + at(ys, n - 1)
    return F.when(n <= 0, at(ys, F.lit(0))).when(n >= size, at(ys, F.lit(size - 1))).otherwise(inner)


# --------------------------------------------------------------------------- calibrators
@dataclass(frozen=True)
class Calibrator:
    """Fitted parameters: a temperature, one per label, or isotonic knots (all driver-size)."""

    method: str
    temperature: float | None = None
    per_class: dict[str, dict] = field(default_factory=dict)
    fallback: float | None = None
    knots: tuple[tuple[float, ...], tuple[float, ...]] = ((), ())

    def to_json(self) -> str:
        parameters = {
            "temperature": lambda: {"temperature": self.temperature},
            "temperature-per-class": lambda: {"per_class_temperature": self.per_class,
                                              "global_fallback_temperature": self.fallback},
            "isotonic": lambda: {"isotonic_x_thresholds": list(self.knots[0]), "isotonic_y_thresholds": list(self.knots[1])},
        }[self.method]()
        return json.dumps({"version": 1, "method": self.method, "parameters": parameters}, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Calibrator:
        payload = json.loads(text)
        p, method = payload["parameters"], payload["method"]
        if method == "temperature":
            return Calibrator(method, temperature=float(p["temperature"]))
        if method == "temperature-per-class":
            return Calibrator(method, per_class=dict(p["per_class_temperature"]), fallback=p.get("global_fallback_temperature"))
        if method == "isotonic":
            return Calibrator(method, knots=(tuple(p["isotonic_x_thresholds"]), tuple(p["isotonic_y_thresholds"])))
        raise ValueError(f"unsupported calibrator method: {method}")

    def column(self, score: Column, label: Column) -> Column:
        """Calibrated score; the clipped score where no temperature applies."""
        clipped = clip01(score, SCORE_EPS)
        if self.method == "temperature":
            return apply_temperature(score, self.temperature)
        if self.method == "isotonic":
            return interpolate(clipped, *self.knots)
        if self.method != "temperature-per-class":
            raise ValueError(f"unsupported calibrator method: {self.method}")
        known = {k: v["temperature"] for k, v in self.per_class.items() if v and v.get("temperature") is not None}
        t = F.lit(self.fallback).cast("double")
        if known:
            table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
            t = F.coalesce(F.try_element_at(table, label), t)
        return bind(t, lambda v: F.when(v.isNotNull(), apply_temperature(score, v)).otherwise(clipped))


def fit_calibrator(df: DataFrame, method: str = "temperature", fallback: bool = True, **grid) -> Calibrator:
    """Fit on (score, target, label); the parameter rows are one per label, or the isotonic knots."""
    if method == "temperature":
        row = fit_temperature(df, **grid).head()
        if row is None:
            raise ValueError("temperature fitting needs both positive and negative targets")
        return Calibrator(method, temperature=row.temperature)
    if method == "temperature-per-class":
        rows = fit_temperature_per_class(df, fallback=fallback, **grid).collect()
        return Calibrator(method, per_class={
            r.label: {"temperature": r.temperature, "fit_loss": r.fit_loss, "support": r.support, "source": r.source}
            for r in rows}, fallback=rows[0].overall if rows else None)
    if method == "isotonic":
        return Calibrator(method, knots=isotonic_knots(df)[0])
    raise ValueError(f"unsupported calibrator method: {method}")


def apply_calibrator(df: DataFrame, calibrator: Calibrator, score_field: str = "score",
                     output: str = "score_calibrated", original: str = "score_original",
                     entities: str = "entities", labels: Sequence[str] | None = None) -> DataFrame:
    """Calibrated scores inside the entity array; ``original`` keeps the raw score where it was absent.

    Entities without a parsable score (or outside ``labels``) stay as they are.
    """
    known = struct_fields(df, entities)

    def one(e: Column) -> Column:
        def body(s: Column) -> Column:
            ok = s.isNotNull() & (e["label"].isin(*labels) if labels else F.lit(True))
            new = F.when(ok, calibrator.column(s, e["label"]))
            before = e[original] if original in known else F.lit(None).cast("double")
            values = {f: e[f] for f in known}
            values[output] = F.coalesce(new, e[output]) if output in known else new
            values[original] = F.coalesce(before, F.when(ok, s))
            return F.struct(*[v.alias(k) for k, v in values.items()])

        return bind(safe_double(e[score_field]), body)

    return once(df, **{entities: F.transform(entities, one)})


def calibrate_corpus(df: DataFrame, method: str = "temperature", label_source: str = "score-threshold",
                     calibration: DataFrame | None = None, score_field: str = "score",
                     labels: Sequence[str] | None = LABELS, id_col: str = "row_idx", **targets
                     ) -> tuple[DataFrame, DataFrame, Calibrator]:
    """Fit and apply in one go: (records, one-row stats, calibrator).

    Fits on ``calibration`` (score, target, label) when given, else on pseudo targets derived from the
    scores themselves; in that case a label with one target class is left uncalibrated.
    """
    ents = scored_entities(df, score_field, labels, id_col)
    own = calibration is None
    fit_on = pseudo_targets(ents, label_source, **targets) if own else calibration
    calibrator = fit_calibrator(fit_on, method, fallback=not own)
    after = calibrator.column(F.col("score"), F.col("label"))
    stats = fit_on.select("score", "target", after.alias("_after")).agg(
        F.count(F.lit(1)).alias("fit_rows"), F.avg("target").alias("positive_rate"),
        F.avg(F.pow(F.col("score") - F.col("target"), 2)).alias("brier_before"),
        F.avg(F.pow(F.col("_after") - F.col("target"), 2)).alias("brier_after"))
    return apply_calibrator(df, calibrator, score_field, labels=labels), stats, calibrator


# --------------------------------------------------------------------------- quality measures
def brier(score: Column, target: Column) -> Column:
    """Aggregate: mean squared distance of score and target."""
    return F.avg(F.pow(clip01(score, 0.0) - target, 2))


def nll(score: Column, target: Column) -> Column:
    """Aggregate: mean negative log-likelihood."""
    p = clip01(score, NLL_EPS)
    return -F.avg(target * F.ln(p) + (1 - target) * F.ln(1 - p))


def bin_edges(bins: int) -> list[float]:
    return [float(e) for e in np.linspace(0.0, 1.0, bins + 1)]


def bin_number(score: Column, bins: int = 10) -> Column:
    """Number of interior edges below the score: bins are (lower, upper]."""
    out = F.lit(0)
    for edge in bin_edges(bins)[1:-1]:
        out = out + (score > edge).cast("int")
    return out


def _binned(df: DataFrame, groups: Sequence[str], bins: int) -> DataFrame:
    per = df.groupBy(*groups, bin_number(F.col("score"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("score").alias("conf_mean"), F.avg("target").alias("acc"))
    return per.withColumn("gap", F.abs(F.col("acc") - F.col("conf_mean")))


def reliability_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """All bins with edges, count, mean confidence, accuracy and gap; empty bins have NULL means."""
    edges = bin_edges(bins)
    frame = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        F.get(F.array(*[F.lit(e) for e in edges]), F.col("id").cast("int")).alias("bin_lower"),
        F.get(F.array(*[F.lit(e) for e in edges]), (F.col("id") + 1).cast("int")).alias("bin_upper"))
    out = frame.join(_binned(df, [], bins), "bin", "left")
    return out.withColumn("count", F.coalesce("count", F.lit(0)))


def ece_mce(binned: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Count-weighted mean gap and largest gap of a bin table."""
    return binned.groupBy(*groups).agg(
        (F.sum(F.col("count") * F.col("gap")) / F.sum("count")).alias("ece"), F.max("gap").alias("mce"))


def auc(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """ROC AUC per group (NULL with one class): rank sum over distinct scores, ties at their mean rank."""
    counts = df.groupBy(*groups, "score").agg(
        F.sum((F.col("target") == 1).cast("bigint")).alias("pos"), F.sum((F.col("target") == 0).cast("bigint")).alias("neg"))
    ranked = running_totals(counts, groups, "score", ["pos", "neg"])
    wins = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)
    per = ranked.groupBy(*groups).agg(F.sum(wins).alias("_u"), F.max("pos_total").alias("_p"), F.max("neg_total").alias("_n"))
    return per.select(*groups, F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                                      F.col("_u") / (F.col("_p").cast("double") * F.col("_n"))).alias("auc"))


def _measures(df: DataFrame, groups: Sequence[str], bins: int) -> DataFrame:
    """(groups, rows, positive_rate, brier, nll, ece, mce) of score against target."""
    score, target, n = F.col("score"), F.col("target"), F.sum("_n")
    # One pass: every measure is a sum over the bins.
    per = df.groupBy(*groups, bin_number(score, bins).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("score").alias("_s"), F.sum("target").alias("_t"),
        (brier(score, target) * F.count(F.lit(1))).alias("_b"), (nll(score, target) * F.count(F.lit(1))).alias("_l"))
    per = per.withColumn("_gap", F.abs(F.col("_t") - F.col("_s")) / F.col("_n"))
    return per.groupBy(*groups).agg(
        n.alias("rows"), (F.sum("_t") / n).alias("positive_rate"), (F.sum("_b") / n).alias("brier"), (F.sum("_l") / n).alias("nll"),
        (F.sum(F.col("_gap") * F.col("_n")) / n).alias("ece"), F.max("_gap").alias("mce"))


def _unpivoted(df: DataFrame, keep: Sequence[str], columns: dict[str, str], name: str) -> DataFrame:
    """Long form: one row per (row, source column) with the value as ``score``."""
    pairs = F.array(*[F.struct(F.lit(k).alias(name), F.col(c).alias("score")) for k, c in columns.items()])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, f"p.{name}", "p.score")


def evaluate_calibrator(df: DataFrame, calibrator: Calibrator, bins: int = 10) -> DataFrame:
    """(scope, label, scores, rows, positive_rate, brier, nll, ece, mce): raw against calibrated,
    overall (scope ``overall``, label ``*``) and per label.  Input: score, target, label."""
    staged = df.withColumn("cal", calibrator.column(F.col("score"), F.col("label")))
    long = _unpivoted(staged, ["label", "target"], {"raw": "score", "calibrated": "cal"}, "scores")
    scopes = F.explode(F.array(F.struct(F.lit("overall").alias("scope"), F.lit("*").alias("key")),
                               F.struct(F.lit("label").alias("scope"), F.col("label").alias("key"))))
    long = long.withColumn("s", scopes).select("s.scope", F.col("s.key").alias("label"), "scores", "score", "target")
    return _measures(long, ["scope", "label", "scores"], bins)


def audit_by_label(df: DataFrame, threshold: float = 0.8, calibrator: Calibrator | None = None, approximate: bool = False) -> DataFrame:
    """Score distribution per (scope, label, scores, target): count, mean, min, quartiles, max and the
    share at or above ``threshold``.  Input: score (raw), target, label.

    With ``approximate`` the quartiles are scores from a sketch in the same aggregate (rank error below 1 %): the data are read once and
    nothing is sorted.
    """
    columns = {"raw": "score"}
    if calibrator:
        df = df.withColumn("cal", calibrator.column(F.col("score"), F.col("label")))
        columns["calibrated"] = "cal"
    elif "score_calibrated" in df.columns:
        columns["calibrated"] = "score_calibrated"
    long = _unpivoted(df, ["label", "target"], columns, "scores").filter(F.col("score").isNotNull())
    scopes = F.explode(F.array(F.struct(F.lit("overall").alias("scope"), F.lit("*").alias("key")),
                               F.struct(F.lit("label").alias("scope"), F.col("label").alias("key"))))
    groups = ["scope", "label", "scores", "target"]
    long = long.withColumn("s", scopes).select("s.scope", F.col("s.key").alias("label"), "scores", "target", "score")

    def cell(t: int) -> Column:
        """The measures of one target; a (scope, label, scores) without it counts 0."""
        of = lambda c: F.when(F.col("target") == t, c)
        score = of(F.col("score"))
        return F.struct(F.lit(t).cast(df.schema["target"].dataType).alias("target"), F.count(score).alias("count"), F.avg(score).alias("mean"), F.min(score).alias("min"),
                        F.max(score).alias("max"), F.avg(of((F.col("score") >= threshold).cast("double"))).alias("share_ge_threshold"),
                        *([F.kll_sketch_agg_double(score, F.lit(KLL_K)).alias("k")] if approximate else []))

    cells = long.groupBy(*groups[:-1]).agg(F.array(cell(0), cell(1)).alias("c")).withColumn("c", F.explode("c")).select(*groups[:-1], "c.*")
    if approximate:
        found = cells.withColumns({n: quantile("k", p) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))})
        return found.drop("k").withColumn("threshold", F.lit(float(threshold)))
    quart = group_quantiles(long, groups, "score", [0.25, 0.5, 0.75])
    wide = quart.groupBy(*groups).agg(*[
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return lookup_join(cells, wide, groups, null_safe=True).withColumn("threshold", F.lit(float(threshold)))


# --------------------------------------------------------------------------- cross-validation
def cv_scores(df: DataFrame, id_col: str, k: int = 5, seed: int = 42, isotonic: bool = True) -> DataFrame:
    """(fold, method, score, target): every row scored by calibrators fitted on the other folds.

    Temperature: one pass gives the losses per (fold, temperature); the training loss of a fold is the
    total minus its own.  Isotonic: one job for the fits of all folds.  ``k`` <= 1 fits and scores in sample.
    """
    if k <= 1:
        folded = df.withColumn("fold", F.lit(0))
    else:
        folded = with_hash_position(df, [id_col], seed, name="_pos").withColumn(
            "fold", F.pmod("_pos", F.lit(k)).cast("int")).select("fold", "score", "target")
        folded = stable(folded)  # read by the temperature fit, every isotonic fit and the scoring
    losses = _grid_losses(folded, ["fold"], temperature_grid())
    if k > 1:
        rest = W.partitionBy("idx")
        losses = losses.select("fold", "idx", "t", *[
            (F.sum(c).over(rest) - F.col(c)).alias(c) for c in ("loss_sum", "n", "positives")])
    temps = _best(losses, ["fold"]).select("fold", "temperature")
    scored = folded.join(F.broadcast(temps), "fold", "left")  # k rows
    scored = scored.withColumn("ts", apply_temperature(F.col("score"), F.col("temperature")))
    columns = {"raw": "score", "temperature": "ts"}
    if isotonic:
        iso = F.lit(None).cast("double")
        for f, knots in enumerate(isotonic_knots(folded, max(k, 1))):
            iso = F.when(F.col("fold") == f, interpolate(F.col("score"), *knots)).otherwise(iso)
        scored = scored.withColumn("iso", clip01(iso, 0.0))
        columns["isotonic"] = "iso"
    return _unpivoted(scored, ["fold", "target"], columns, "method")


def cv_summary(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(method, metric, mean, std, n_folds) over folds; sample standard deviation, 0 for one fold."""
    per = _measures(scored, ["method", "fold"], bins).join(auc(scored, ["method", "fold"]), ["method", "fold"], "left")
    long = per.select("method", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("ece", "mce", "brier", "nll", "auc")])).alias("x"))
    return long.select("method", "x.metric", "x.value").groupBy("method", "metric").agg(
        F.avg("value").alias("mean"),
        F.when(F.count("value") > 1, F.stddev_samp("value")).when(F.count("value") == 1, 0.0).alias("std"),
        F.count("value").alias("n_folds"))


def cv_reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(method, bin, count, conf_mean, acc): counts summed, means averaged over the folds."""
    return _binned(scored, ["method", "fold"], bins).groupBy("method", "bin").agg(
        F.sum("count").alias("count"), F.avg("conf_mean").alias("conf_mean"), F.avg("acc").alias("acc"))
