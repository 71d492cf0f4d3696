"""Exact-span evaluation.

Gold and predicted spans are put side by side by one grouped aggregation on
(record, start, end, label) - deduplicating and matching in the same shuffle.  A long record spreads over
its offsets, so no key is hot, and everything after it is counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.arrays import bind, bind_all
from spanlake.functions.text import cut_text, surface_key, text_blocks
from spanlake.operators.ordering import lookup_join, top_n
from spanlake.operators.staging import once
from spanlake.schema import LABELS

KEYS = ("start", "end", "label")


def long_spans(df: DataFrame, column: str, id_col: str = "row_idx", extra: Sequence[str] = ()) -> DataFrame:
    """Entity array -> long rows (id, start, end, label, extra...)."""
    return df.select(id_col, F.explode(column).alias("s")).select(
        id_col, *[F.col(f"s.{k}").alias(k) for k in (*KEYS, *extra)])


def require_same_records(gold: DataFrame, pred: DataFrame, id_col: str = "row_idx") -> None:
    """Raise unless both tables hold the same records, each as often: spans of a record that one side lacks would
    count as errors of the model.  One aggregation; only the differences are looked at."""
    side = lambda df, n: df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).select(id_col, (F.col("n") * n).alias("n"))
    off = side(gold, 1).unionByName(side(pred, -1)).groupBy(id_col).agg(F.sum("n").alias("n")).filter(F.col("n") != 0)
    first = off.orderBy(id_col).limit(5).collect()
    if first:
        raise ValueError("gold and predictions cover different records: " + ", ".join(
            f"{id_col}={r[id_col]} ({'gold' if r.n > 0 else 'predictions'} only)" for r in first))


def match_spans(gold: DataFrame, pred: DataFrame, id_col: str = "row_idx", carry: Mapping[str, str] | None = None) -> DataFrame:
    """Distinct spans with ``status`` TP, FP or FN.  Tables of records are checked by :func:`require_same_records` first.

    ``carry``: extra predicted columns to keep, name -> aggregate (``max``, ``min``), e.g. the best score.
    """
    carry = carry or {}
    keys = [id_col, *KEYS]
    side = lambda df, g, p: df.select(*keys, F.lit(g).alias("_g"), F.lit(p).alias("_p"), *[
        (F.col(c) if p else F.lit(None).cast(pred.schema[c].dataType)).alias(c) for c in carry])
    both = side(gold, 1, 0).unionByName(side(pred, 0, 1))
    grouped = both.groupBy(*keys).agg(F.max("_g").alias("_g"), F.max("_p").alias("_p"), *[
        getattr(F, how)(c).alias(c) for c, how in carry.items()])
    status = F.when((F.col("_g") == 1) & (F.col("_p") == 1), "TP").when(F.col("_p") == 1, "FP").otherwise("FN")
    return grouped.withColumn("status", status).drop("_g", "_p")


def match_in_records(df: DataFrame, gold: str, pred: str, id_col: str = "row_idx", score: bool = False) -> DataFrame:
    """:func:`match_spans` for gold and predicted arrays of the same record, without any shuffle.

    Both lists are sorted together by (start, end, label, side); a gold span directly followed by the same predicted
    span is a hit.  ``score`` carries the best predicted score.  Everything after it aggregates counts.
    """
    worst = F.lit(None).cast("double")

    def side(column: str, number: int) -> Column:
        points = (lambda s: -s["score"].cast("double")) if score and number else (lambda s: worst)
        return F.transform(F.coalesce(F.col(column), F.array().cast(df.schema[column].dataType)), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), F.lit(number).alias("side"), points(s).alias("neg")))

    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & a["label"].eqNullSafe(b["label"])

    def unique(both: Column) -> Column:
        return F.filter(both, lambda x, i: (i == 0) | ~F.coalesce(
            same(F.get(both, i - 1), x) & (F.get(both, i - 1)["side"] == x["side"]), F.lit(False)))

    def judged(both: Column) -> Column:
        def status(x: Column, i: Column) -> Column:
            hit = F.coalesce((F.get(both, i - 1)["side"] == 0) & same(F.get(both, i - 1), x), F.lit(False)) & (i > 0)
            lost = ~F.coalesce(same(F.get(both, i + 1), x), F.lit(False))
            return F.when(x["side"] == 1, F.when(hit, "TP").otherwise("FP")).when(lost, "FN")

        named = F.transform(both, lambda x, i: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label"), (-x["neg"]).alias("score"), status(x, i).alias("status")))
        return F.filter(named, lambda x: x["status"].isNotNull())

    staged = once(df.select(id_col, gold, pred), _m=bind(bind(F.array_sort(F.concat(side(gold, 0), side(pred, 1))), unique), judged))
    fields = [*KEYS, *(["score"] if score else []), "status"]
    return staged.select(id_col, F.explode("_m").alias("m")).select(id_col, *[f"m.{f}" for f in fields])


def _matched(gold: DataFrame, pred: DataFrame | None, id_col: str, carry: Mapping[str, str] | None = None) -> DataFrame:
    """The first argument when it already is a match table, else the match of both."""
    return gold if pred is None else match_spans(gold, pred, id_col, carry)


def _count(status: str, name: str) -> Column:
    return F.count_if(F.col("status") == status).alias(name)


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    # 2pr/(p+r); zero when nothing was hit
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def _label_frame(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(x,) for x in labels], "label string")


def label_counts_by_status(matched: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """(label, tp, fp, fn); with ``labels`` exactly those, zeros included."""
    per = matched.groupBy("label").agg(_count("TP", "tp"), _count("FP", "fp"), _count("FN", "fn"))
    if labels is None:
        return per
    full = _label_frame(matched, labels).join(per, "label", "left")
    return full.select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])


def span_metrics(gold: DataFrame, pred: DataFrame | None = None, labels: Sequence[str] = LABELS, id_col: str = "row_idx") -> DataFrame:
    """(label, precision, recall, f1, support, fp, fn) for every label, then ``micro`` and ``macro`` rows.

    Takes gold and predicted long spans, or one match table (``match_spans``, ``match_in_records``).  Macro F1 is the mean over the requested labels; its other measures are NULL.
    """
    per = label_counts_by_status(_matched(gold, pred, id_col), labels)
    micro = per.agg(F.lit("micro").alias("label"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select(
        "label", "tp", "fp", "fn")
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    rows = per.unionByName(micro).select(
        "label", p.alias("precision"), r.alias("recall"), f.alias("f1"), (F.col("tp") + F.col("fn")).alias("support"), "fp", "fn")
    f_label = _prf(F.col("tp"), F.col("fp"), F.col("fn"))[2]
    none = F.lit(None)
    macro = per.agg(F.avg(f_label).alias("f1")).select(
        F.lit("macro").alias("label"), none.cast("double").alias("precision"), none.cast("double").alias("recall"),
        "f1", *[none.cast("bigint").alias(c) for c in ("support", "fp", "fn")])
    return rows.unionByName(macro)


def macro_f1(gold: DataFrame, pred: DataFrame | None = None, labels: Sequence[str] = LABELS, id_col: str = "row_idx") -> DataFrame:
    """One row: mean F1 over the requested labels."""
    per = label_counts_by_status(_matched(gold, pred, id_col), labels)
    return per.agg(F.avg(_prf(F.col("tp"), F.col("fp"), F.col("fn"))[2]).alias("macro_f1"))


def _totals(matched: DataFrame) -> DataFrame:
    return matched.agg(_count("TP", "tp"), _count("FP", "fp"), _count("FN", "fn"))


def micro_f1(gold: DataFrame, pred: DataFrame | None = None, id_col: str = "row_idx") -> DataFrame:
    """One row: micro F1, 1.0 when there is nothing on either side."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return _totals(_matched(gold, pred, id_col)).select(
        F.when(tp + fp + fn == 0, 1.0).otherwise(_prf(tp, fp, fn)[2]).alias("micro_f1"))


def _membership(tp: Column, fp: Column, fn: Column) -> Column:
    """Span membership as a 0/1 task averaged over classes: class 0 can never be hit."""
    return F.when(fp + fn == 0, 1.0).otherwise(F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0) / 2)


def membership_f1(gold: DataFrame, pred: DataFrame | None = None, id_col: str = "row_idx") -> DataFrame:
    """One row: macro F1 of span membership over the union of spans."""
    return _totals(_matched(gold, pred, id_col)).select(
        _membership(F.col("tp"), F.col("fp"), F.col("fn")).alias("membership_f1"))


# --------------------------------------------------------------------------- thresholds
def passes_threshold(thresholds: float | Mapping[str, float] | None) -> Column:
    """Predicted rows at or above a scalar or per-label threshold (0.5 for other labels); no score passes."""
    if thresholds is None:
        return F.lit(True)
    if isinstance(thresholds, Mapping):
        table = F.create_map(*[F.lit(x) for k, v in thresholds.items() for x in (k, float(v))])
        cut = F.coalesce(F.try_element_at(table, F.col("label")), F.lit(0.5))
    else:
        cut = F.lit(float(thresholds))
    return F.col("score").isNull() | (F.col("score") >= cut)


def count_outcomes(gold: DataFrame, pred: DataFrame, thresholds: float | Mapping[str, float] | None = None,
                   id_col: str = "row_idx") -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of the predictions that pass their threshold."""
    per = label_counts_by_status(match_spans(gold, pred.filter(passes_threshold(thresholds)), id_col))
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return per.select("label", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def outcome_summary(outcomes: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """One row: accuracy TP/(TP+FP+FN) and macro F1 over the requested labels that occur."""
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    return outcomes.agg((tp / F.greatest(tp + fp + fn, F.lit(1))).alias("accuracy"),
                        F.avg(F.when(F.col("label").isin(*labels), F.col("f1"))).alias("macro_f1"))


def threshold_sweep(gold: DataFrame, pred: DataFrame | None = None, labels: Sequence[str] = LABELS,
                    grid: Sequence[float] | None = None, id_col: str = "row_idx") -> DataFrame:
    """(label, best_threshold, best_f1): first best threshold per label, (0.5, 0.0) when nothing beats 0.

    A span passes threshold t iff its best score does, so each matched span falls into one cell "passes
    the first j thresholds".  Counting cells and summing from the top gives every threshold at once:
    the spans are aggregated once and never multiplied by the grid.
    """
    grid = [round(i * 0.05, 2) for i in range(21)] if grid is None else list(grid)
    ordered = sorted(set(grid))
    always = lambda df: df.withColumn("_s", F.coalesce(F.col("score").cast("double"), F.lit(float("inf"))))
    if pred is None:  # a match table with the best predicted score
        matched = always(gold).withColumn("_s", F.when(F.col("status") != "FN", F.col("_s")))
    else:
        matched = match_spans(gold, always(pred), id_col, carry={"_s": "max"})
    matched = matched.filter(F.col("label").isin(*labels))
    passed = F.lit(0)
    for t in ordered:
        passed = passed + (F.coalesce("_s", F.lit(float("-inf"))) >= t).cast("int")
    cells = matched.groupBy("label", passed.alias("level")).agg(
        F.count_if(F.col("status") == "TP").alias("hit"), F.count_if(F.col("status") == "FP").alias("false"),
        F.count_if(F.col("status") != "FP").alias("gold"))
    # A cell at level j counts for the thresholds 0..j-1; gold spans count for all of them.
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("t"),
                                         F.lit(grid.index(t)).alias("pos")) for i, t in enumerate(ordered)]))
    per = cells.withColumn("g", steps).groupBy("label", "g.t", "g.pos").agg(
        F.sum(F.when(F.col("level") > F.col("g.i"), F.col("hit")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("level") > F.col("g.i"), F.col("false")).otherwise(0)).alias("fp"),
        F.sum("gold").alias("gold"))
    f1 = _prf(F.col("tp"), F.col("fp"), F.col("gold") - F.col("tp"))[2]
    top = per.withColumn("f1", f1).filter(F.col("f1") > 0).groupBy("label").agg(
        F.max_by(F.struct("t", "f1"), F.struct("f1", -F.col("pos"))).alias("b"))
    return _label_frame(gold, labels).join(top, "label", "left").select(
        "label", F.coalesce("b.t", F.lit(0.5)).alias("best_threshold"), F.coalesce("b.f1", F.lit(0.0)).alias("best_f1"))


def best_threshold(scores: DataFrame) -> DataFrame:
    """One row: the threshold with the highest mean ``f1`` over folds; the first (smallest) wins ties."""
    means = scores.groupBy("threshold").agg(F.avg("f1").alias("mean_f1"))
    return means.agg(F.max_by(F.struct("threshold", "mean_f1"), F.struct("mean_f1", -F.col("threshold"))).alias("b")) \
        .select(F.col("b.threshold").alias("best_threshold"), F.col("b.mean_f1").alias("best_score"))


# --------------------------------------------------------------------------- seen and unseen
def training_surfaces(train: DataFrame, tokens: str = "tokenized_text", ner: str = "ner") -> DataFrame:
    """Distinct (label, surface) of token-span training samples."""
    valid = F.filter(ner, lambda s: (s["start_tok"] >= 0) & (s["start_tok"] <= s["end_tok"]) & (s["end_tok"] < F.size(tokens)))
    rows = train.select(F.explode_outer(F.transform(valid, lambda s: F.struct(
        s["label"].alias("label"), surface_key(F.array_join(
            F.slice(tokens, s["start_tok"] + 1, s["end_tok"] - s["start_tok"] + 1), " ")).alias("surface")))).alias("k"))
    return rows.filter(F.col("k").isNotNull()).select("k.label", "k.surface").distinct()


def span_surfaces(df: DataFrame, column: str, text: str = "text", id_col: str = "row_idx") -> DataFrame:
    """Long spans clamped to the text, with their normalised ``surface``; empty ones drop.

    Surfaces are cut inside the record, so the text is not repeated for every span.
    """
    def cut(blocks: Column, n: Column) -> Column:
        def one(s: Column) -> Column:
            a, b = F.greatest(F.lit(0), s["start"]), F.least(n, s["end"])
            return F.struct(*[s[k].alias(k) for k in KEYS], F.when(b > a, surface_key(cut_text(blocks, a, b - a))).alias("surface"))

        return F.filter(F.transform(column, one), lambda s: s["surface"].isNotNull())

    rows = once(df.select(id_col, text, column), _s=bind_all([text_blocks(F.col(text)), F.length(text)], cut))
    return rows.select(id_col, F.explode("_s").alias("s")).select(id_col, *[f"s.{k}" for k in KEYS], "s.surface")


def mark_seen(spans: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Adds ``seen``: does (label, surface) occur in training?  A frequent surface is no hot key (see lookup_join)."""
    known = surfaces.select("label", "surface", F.lit(True).alias("seen"))
    return lookup_join(spans, known, ["label", "surface"], "left", salts=16).withColumn("seen", F.coalesce("seen", F.lit(False)))


def seen_unseen_f1(gold: DataFrame, pred: DataFrame, surfaces: DataFrame, id_col: str = "row_idx") -> DataFrame:
    """(part, f1, gold_support) for seen and unseen spans; F1 is NULL when a part has no span.

    ``gold`` and ``pred`` are long spans with ``surface``.  Outcomes are first added up per
    (label, surface), so the join with the training surfaces meets each key once.
    """
    keys = [id_col, *KEYS]
    both = gold.select(*keys, "surface", F.lit(1).alias("_g"), F.lit(0).alias("_p")).unionByName(
        pred.select(*keys, "surface", F.lit(0).alias("_g"), F.lit(1).alias("_p")))
    spans = both.groupBy(*keys).agg(F.min("surface").alias("surface"), F.sum("_g").alias("_g"), F.sum("_p").alias("_p"))
    per = spans.groupBy("label", "surface").agg(
        F.count_if((F.col("_g") > 0) & (F.col("_p") > 0)).alias("tp"), F.count_if(F.col("_g") == 0).alias("fp"),
        F.count_if(F.col("_p") == 0).alias("fn"), F.sum("_g").alias("gold"))
    flagged = per.join(surfaces.select("label", "surface", F.lit(1).alias("_in")), ["label", "surface"], "left")
    parts = flagged.groupBy(F.when(F.col("_in") == 1, "seen").otherwise("unseen").alias("part")).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "gold")])
    frame = gold.sparkSession.createDataFrame([("seen",), ("unseen",)], "part string")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return frame.join(parts, "part", "left").select(
        "part", F.when(tp + fp + fn > 0, _membership(tp, fp, fn)).alias("f1"), F.coalesce("gold", F.lit(0)).alias("gold_support"))


# --------------------------------------------------------------------------- review and summaries
def review_rows(gold: DataFrame, pred: DataFrame, n: int = 0, id_col: str = "row_idx", records: DataFrame | None = None) -> DataFrame:
    """Per record gold, pred, TP, FP, FN and errors, worst first.  ``records`` adds those without spans."""
    keys = [id_col, *KEYS]
    both = gold.select(*keys, F.lit(1).alias("_g"), F.lit(0).alias("_p")).unionByName(
        pred.select(*keys, F.lit(0).alias("_g"), F.lit(1).alias("_p")))
    spans = both.groupBy(*keys).agg(F.sum("_g").alias("_g"), F.sum("_p").alias("_p"))
    hit, wrong, lost = (F.col("_g") > 0) & (F.col("_p") > 0), F.col("_g") == 0, F.col("_p") == 0
    per = spans.groupBy(id_col).agg(
        F.sum("_g").alias("gold_count"), F.sum("_p").alias("pred_count"),
        F.count_if(hit).alias("tp"), F.count_if(wrong).alias("fp"), F.count_if(lost).alias("fn"))
    if records is not None:
        per = records.select(id_col).join(per, id_col, "left").na.fill(0)
    per = per.withColumn("error_count", F.col("fp") + F.col("fn"))
    return top_n(per, n, F.desc("error_count"), F.desc("fp"), F.desc("fn"), F.desc("pred_count"), F.col(id_col))


def review_summary(reviewed: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """One row: records, errors per record, and with ``metrics`` (of :func:`span_metrics`) micro and macro F1."""
    f1 = lambda name: metrics.filter(F.col("label") == name).agg(F.max("f1")).scalar().alias(f"{name}_f1")
    scores = [f1("micro"), f1("macro")] if metrics is not None else []
    counted = reviewed.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.avg("error_count"), F.lit(0.0)).alias("avg_errors_per_record"),
                           F.coalesce(F.max("error_count"), F.lit(0)).alias("max_errors_in_record"))
    return counted.select("*", *scores)


def fold_summary(metrics: DataFrame) -> DataFrame:
    """One row: mean and population deviation of ``test_f1`` over folds, mean seen and unseen F1; NULLs skipped."""
    return metrics.agg(F.avg("test_f1").alias("mean_test_f1"), F.stddev_pop("test_f1").alias("std_test_f1"),
                       F.max("test_f1").alias("best_test_f1"),
                       F.avg("seen_f1").alias("mean_seen_entity_test_f1"), F.avg("unseen_f1").alias("mean_unseen_entity_test_f1"))


def compare_metrics(base: DataFrame, refit: DataFrame) -> DataFrame:
    """(label, metric, base, refit, delta) over the union of labels of two ``span_metrics`` results.

    Labels carry precision, recall, f1 and support; ``micro`` and ``macro`` only f1.  A missing side counts 0
    in the delta; support has no delta.
    """
    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"))
                          for m in ("precision", "recall", "f1", "support")])
        rows = df.select("label", F.explode(pairs).alias("x")).select("label", "x.metric", F.col("x.v").alias(name))
        return rows.filter(~F.col("label").isin("micro", "macro") | (F.col("metric") == "f1"))

    both = long(base, "base").join(long(refit, "refit"), ["label", "metric"], "full")
    delta = F.coalesce("refit", F.lit(0.0)) - F.coalesce("base", F.lit(0.0))
    return both.select("label", "metric", "base", "refit", F.when(F.col("metric") != "support", delta).alias("delta"))
