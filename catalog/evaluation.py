"""Span evaluation, system comparison and quality summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.boosting import CYCLE_SQL, cycle
from catalog.fixtures import ENTS_SQL, GOLD_PRED_SQL, annotated, doc, gold_and_pred, long, slim, table, tidy
from spanlake.operators import evaluate as ev
from spanlake.operators import extract as ex
from spanlake.operators import summarize as sm
from spanlake.operators.ordering import lookup_join
from spanlake.operators.staging import once
from spanlake.plans.evaluation import evaluate_predictions
from spanlake.schema import LABELS

G = f"WITH {GOLD_PRED_SQL}"


def prf(tp="tp", fp="fp", fn="fn"):
    p = f"(CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0 END)"
    r = f"(CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0 END)"
    return p, r, f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END)"


P, R, F1 = prf()
COUNTS = "sum(CASE WHEN g = 1 AND p = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN g = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN p = 0 THEN 1 ELSE 0 END) AS fn"


def per_label(spans="spans", name="pl"):
    """All requested labels plus one that never occurs."""
    return f"{name} AS (SELECT l.label, coalesce(tp, 0)::DOUBLE AS tp, coalesce(fp, 0)::DOUBLE AS fp, coalesce(fn, 0)::DOUBLE AS fn FROM (VALUES ('Person'), ('Location'), ('Organization'), ('Event')) l(label) LEFT JOIN (SELECT label, {COUNTS} FROM {spans} GROUP BY label) c USING (label))"


def metrics_sql(pl="pl"):
    return f"""SELECT label, round({P}, 6) AS precision, round({R}, 6) AS recall, round({F1}, 6) AS f1, (tp + fn)::BIGINT AS support, fp::BIGINT AS fp, fn::BIGINT AS fn FROM {pl}
  UNION ALL SELECT 'micro', round({P}, 6), round({R}, 6), round({F1}, 6), (tp + fn)::BIGINT, fp::BIGINT, fn::BIGINT FROM (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM {pl}) t
  UNION ALL SELECT 'macro', NULL, NULL, round(avg({F1}), 6), NULL, NULL, NULL FROM {pl}"""


FOUR = [*LABELS, "Event"]


def _sides(spark, sf):
    df = gold_and_pred(spark, sf)
    return long(df, "gold"), long(df, "pred")


def _judged(spark, sf, score=False):
    """The match table of gold and predicted arrays that sit in the same record."""
    return ev.match_in_records(gold_and_pred(spark, sf), "gold", "pred", score=score)


@query("match_in_records", f"{G} SELECT label, CASE WHEN g = 1 AND p = 1 THEN 'TP' WHEN p = 1 THEN 'FP' ELSE 'FN' END AS status, count(*)::BIGINT AS n, sum(s)::BIGINT AS starts, round(sum(score), 5) AS scores FROM spans GROUP BY ALL")
def match_in_records(spark, sf):
    return tidy(_judged(spark, sf, True).groupBy("label", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.round(F.sum("score"), 5).alias("scores")))


@query("match_spans", f"{G} SELECT label, CASE WHEN g = 1 AND p = 1 THEN 'TP' WHEN p = 1 THEN 'FP' ELSE 'FN' END AS status, count(*)::BIGINT AS n, sum(s)::BIGINT AS starts FROM spans GROUP BY ALL")
def match_spans(spark, sf):
    return tidy(ev.match_spans(*_sides(spark, sf)).groupBy("label", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts")))


@query("span_metrics", f"{G}, {per_label()} {metrics_sql()}")
def span_metrics(spark, sf):
    return tidy(ev.span_metrics(_judged(spark, sf), labels=FOUR))


@query("macro_f1", f"{G}, {per_label()} SELECT round(avg({F1}), 6) AS macro_f1 FROM pl")
def macro_f1(spark, sf):
    return tidy(ev.macro_f1(_judged(spark, sf), labels=FOUR))


@query("micro_f1", f"{G}, t AS (SELECT {COUNTS} FROM spans) SELECT round({F1}, 6) AS micro_f1 FROM t")
def micro_f1(spark, sf):
    return tidy(ev.micro_f1(_judged(spark, sf)))


@query("membership_f1", f"{G}, t AS (SELECT {COUNTS} FROM spans) SELECT round(CASE WHEN fp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fp + fn) / 2 END, 6) AS membership_f1 FROM t")
def membership_f1(spark, sf):
    return tidy(ev.membership_f1(_judged(spark, sf)))


CUTS = {"Person": 0.3, "Location": 0.6}
_PASSED = f"""{G}, ps AS (SELECT doc_id, s, e, label, max(g) AS g, max(p) AS p FROM (SELECT doc_id, s, e, label, 1 AS g, 0 AS p FROM gold UNION ALL SELECT doc_id, s, e, label, 0, 1 FROM pred
  WHERE score >= CASE label WHEN 'Person' THEN 0.3 WHEN 'Location' THEN 0.6 ELSE 0.5 END) x GROUP BY doc_id, s, e, label), oc AS (SELECT label, {COUNTS} FROM ps GROUP BY label)"""


@query("count_outcomes", f"{_PASSED} SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round({P}, 6) AS precision, round({R}, 6) AS recall, round({F1}, 6) AS f1 FROM oc")
def count_outcomes(spark, sf):
    return tidy(ev.count_outcomes(*_sides(spark, sf), CUTS))


@query("outcome_summary", f"{_PASSED} SELECT round(sum(tp) / sum(tp + fp + fn), 6) AS accuracy, round(avg({F1}), 6) AS macro_f1 FROM oc")
def outcome_summary(spark, sf):
    return tidy(ev.outcome_summary(ev.count_outcomes(*_sides(spark, sf), CUTS)))


SWEEP = f"""{G}, gr AS (SELECT i, round(i * 0.05, 2)::DOUBLE AS t FROM range(21) r(i)),
sw AS (SELECT label, i, t, sum(CASE WHEN g = 1 AND p = 1 AND score >= t THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN g = 0 AND score >= t THEN 1 ELSE 0 END)::DOUBLE AS fp,
  sum(CASE WHEN g = 1 AND NOT (p = 1 AND score >= t) THEN 1 ELSE 0 END)::DOUBLE AS fn FROM spans, gr GROUP BY ALL),
sf AS (SELECT *, {F1} AS f1 FROM sw), sb AS (SELECT label, t, f1 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, i) AS rn FROM sf WHERE f1 > 0) WHERE rn = 1)"""


@query("threshold_sweep", f"{SWEEP} SELECT l.label, coalesce(round(t, 6), 0.5) AS best_threshold, coalesce(round(f1, 6), 0.0) AS best_f1 FROM (VALUES ('Person'), ('Location'), ('Organization'), ('Event')) l(label) LEFT JOIN sb USING (label)")
def threshold_sweep(spark, sf):
    return tidy(ev.threshold_sweep(_judged(spark, sf, True), labels=FOUR))


@query("evaluate_predictions", f"""{SWEEP}, ps AS (SELECT doc_id, s, e, label, max(g) AS g, max(p) AS p FROM (SELECT doc_id, s, e, label, 1 AS g, 0 AS p FROM gold UNION ALL SELECT doc_id, s, e, pred.label, 0, 1 FROM pred
  LEFT JOIN sb USING (label) WHERE pred.score >= coalesce(sb.t, 0.5)) x GROUP BY doc_id, s, e, label), {per_label('ps')} {metrics_sql()}""")
def evaluate(spark, sf):
    """Sweep, then metrics at the best thresholds."""
    return tidy(evaluate_predictions(*_sides(spark, sf), FOUR).metrics)


_FOLDED = f"""{G}, ft AS (SELECT doc_id % 3 AS fold, t, sum(CASE WHEN g = 1 AND p = 1 AND score >= t THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN g = 0 AND score >= t THEN 1 ELSE 0 END)::DOUBLE AS fp,
  sum(CASE WHEN g = 1 AND NOT (p = 1 AND score >= t) THEN 1 ELSE 0 END)::DOUBLE AS fn FROM spans, (SELECT round(i * 0.05, 2)::DOUBLE AS t FROM range(21) r(i)) c(t) GROUP BY ALL), fs AS (SELECT fold, t, {F1} AS f1 FROM ft)"""


def _fold_scores(spark, sf):
    """F1 per (fold, threshold): best score per span, counted per fold and cut."""
    gold, pred = _sides(spark, sf)
    m = ev.match_spans(gold, pred, carry={"score": "max"}).withColumn("fold", F.col("row_idx") % 3)
    cut = m.withColumn("threshold", F.explode(F.array(*[F.lit(round(i * 0.05, 2)) for i in range(21)])))
    on = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    per = cut.groupBy("fold", "threshold").agg(F.count_if((F.col("status") == "TP") & on).alias("tp"), F.count_if((F.col("status") == "FP") & on).alias("fp"),
                                               F.count_if((F.col("status") == "FN") | ((F.col("status") == "TP") & ~on)).alias("fn"))
    return per.withColumn("f1", ev._prf(F.col("tp"), F.col("fp"), F.col("fn"))[2])


@query("best_threshold", f"{_FOLDED}, mt AS (SELECT t, avg(f1) AS f1 FROM fs GROUP BY t) SELECT round(t::DOUBLE, 6) AS best_threshold, round(f1, 6) AS best_score FROM mt ORDER BY f1 DESC, t LIMIT 1")
def best_threshold(spark, sf):
    return tidy(ev.best_threshold(_fold_scores(spark, sf)))


@query("fold_summary", f"""{_FOLDED}, w AS (SELECT fold, max(CASE WHEN t = 0.1 THEN f1 END) AS a, max(CASE WHEN t = 0.2 AND fold > 0 THEN f1 END) AS b FROM fs GROUP BY fold)
SELECT round(avg(a), 6) AS mean_test_f1, round(stddev_pop(a), 6) AS std_test_f1, round(max(a), 6) AS best_test_f1, round(avg(b), 6) AS mean_seen_entity_test_f1, NULL::DOUBLE AS mean_unseen_entity_test_f1 FROM w""")
def fold_summary(spark, sf):
    at = lambda t: F.max(F.when(F.col("threshold") == t, F.col("f1")))
    w = _fold_scores(spark, sf).groupBy("fold").agg(at(0.1).alias("test_f1"), at(0.2).alias("_b"))
    w = w.select("test_f1", F.when(F.col("fold") > 0, F.col("_b")).alias("seen_f1"), F.lit(None).cast("double").alias("unseen_f1"))
    return tidy(ev.fold_summary(w))


# --------------------------------------------------------------------------- seen and unseen
_SURF = "trim(regexp_replace(lower(t), '\\s+', ' ', 'g'))"
_SEEN = f"""{G}, keys AS (SELECT DISTINCT label, {_SURF} AS surface FROM gold WHERE doc_id % 2 = 0),
ts AS (SELECT s.*, trim(regexp_replace(lower(substr(text, s + 1, e - s)), '\\s+', ' ', 'g')) AS surface FROM spans s JOIN documents d USING (doc_id) WHERE doc_id % 2 = 1),
tk2 AS (SELECT ts.*, CASE WHEN keys.label IS NULL THEN 'unseen' ELSE 'seen' END AS part FROM ts LEFT JOIN keys USING (label, surface))"""


def _seen(spark, sf):
    df = gold_and_pred(spark, sf)
    train = ex.tokenized_samples(df.filter("row_idx % 2 = 0"), spans="gold")
    test = df.filter("row_idx % 2 = 1")
    return ev.training_surfaces(train), ev.span_surfaces(test, "gold"), ev.span_surfaces(test, "pred")


@query("training_surfaces", f"{_SEEN} SELECT label, surface FROM keys")
def training_surfaces(spark, sf):
    return _seen(spark, sf)[0]


@query("mark_seen", f"{_SEEN} SELECT label, (part = 'seen')::INT::BIGINT AS seen, count(*)::BIGINT AS n FROM tk2 WHERE g = 1 GROUP BY ALL")
def mark_seen(spark, sf):
    keys, gold, _ = _seen(spark, sf)
    return tidy(ev.mark_seen(gold, keys).groupBy("label", "seen").agg(F.count(F.lit(1)).alias("n")))


@query("seen_unseen_f1", f"{_SEEN}, c AS (SELECT part, {COUNTS}, sum(g) AS support FROM tk2 GROUP BY part) SELECT part, round(CASE WHEN fp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fp + fn) / 2 END, 6) AS f1, support::BIGINT AS gold_support FROM c")
def seen_unseen_f1(spark, sf):
    keys, gold, pred = _seen(spark, sf)
    return tidy(ev.seen_unseen_f1(gold, pred, keys))


# --------------------------------------------------------------------------- review and comparison
_REVIEW = f"""{G}, rv AS (SELECT d.doc_id, coalesce(sum(g), 0) AS gold, coalesce(sum(p), 0) AS pred, count(CASE WHEN g = 1 AND p = 1 THEN 1 END) AS tp, count(CASE WHEN g = 0 THEN 1 END) AS fp, count(CASE WHEN p = 0 THEN 1 END) AS fn
  FROM documents d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id)"""


def _review(spark, sf, n):
    df = gold_and_pred(spark, sf)
    return ev.review_rows(long(df, "gold"), long(df, "pred"), n, records=table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx")))


@query("review_rows", f"""{_REVIEW} SELECT doc_id, gold::BIGINT AS gold_count, pred::BIGINT AS pred_count, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, (fp + fn)::BIGINT AS error_count
FROM rv ORDER BY fp + fn DESC, fp DESC, fn DESC, pred DESC, doc_id LIMIT 50""")
def review_rows(spark, sf):
    return tidy(_review(spark, sf, 50).withColumnRenamed("row_idx", "doc_id"))


@query("review_summary", f"""{_REVIEW}, {per_label()}, me AS ({metrics_sql()}) SELECT count(*)::BIGINT AS records, round(avg(fp + fn), 6) AS avg_errors_per_record, max(fp + fn)::BIGINT AS max_errors_in_record,
  (SELECT f1 FROM me WHERE label = 'micro') AS micro_f1, (SELECT f1 FROM me WHERE label = 'macro') AS macro_f1 FROM rv""")
def review_summary(spark, sf):
    return tidy(ev.review_summary(_review(spark, sf, 0), ev.span_metrics(*_sides(spark, sf), FOUR)))


_TWO = f"""{G}, s2 AS (SELECT doc_id, s, e, label, max(g) AS g, max(p) AS p FROM (SELECT doc_id, s, e, label, 1 AS g, 0 AS p FROM gold UNION ALL SELECT doc_id, s, e, label, 0, 1 FROM pred WHERE score >= 0.3) x GROUP BY doc_id, s, e, label),
{per_label()}, {per_label('s2', 'pl2')}, a AS ({metrics_sql().replace(', 6)', ', 12)')}), b AS ({metrics_sql('pl2').replace(', 6)', ', 12)')})"""


@query("compare_metrics", _TWO + """, la AS (SELECT label, 'precision' AS metric, precision AS v FROM a UNION ALL SELECT label, 'recall', recall FROM a UNION ALL SELECT label, 'f1', f1 FROM a UNION ALL SELECT label, 'support', support FROM a),
lb AS (SELECT label, 'precision' AS metric, precision AS v FROM b UNION ALL SELECT label, 'recall', recall FROM b UNION ALL SELECT label, 'f1', f1 FROM b UNION ALL SELECT label, 'support', support FROM b)
SELECT label, metric, round(la.v::DOUBLE, 6) AS base, round(lb.v::DOUBLE, 6) AS refit, CASE WHEN metric <> 'support' THEN round(lb.v - la.v, 6) + 0.0 END AS delta FROM la JOIN lb USING (label, metric) WHERE label NOT IN ('micro', 'macro') OR metric = 'f1'""")
def compare_metrics(spark, sf):
    gold, pred = _sides(spark, sf)
    out = ev.compare_metrics(ev.span_metrics(gold, pred, FOUR), ev.span_metrics(gold, pred.filter("score >= 0.3"), FOUR))
    return tidy(out)


def _systems(spark, sf):
    df = gold_and_pred(spark, sf)
    return {n: df.select("row_idx", F.col(n).alias("entities")) for n in ("gold", "pred")}


@query("compare_systems", f"""{G} SELECT d.doc_id, (SELECT count(*) FROM gold g WHERE g.doc_id = d.doc_id)::BIGINT AS gold_entity_count, (SELECT count(*) FROM pred p WHERE p.doc_id = d.doc_id)::BIGINT AS pred_entity_count FROM documents d""")
def compare_systems(spark, sf):
    return tidy(sm.compare_systems(_systems(spark, sf)).select(doc(), "gold_entity_count", "pred_entity_count"))


@query("system_label_counts", f"{G} SELECT 'gold' AS system, label, count(*)::BIGINT AS n FROM gold GROUP BY label UNION ALL SELECT 'pred', label, count(*) FROM pred GROUP BY label")
def system_label_counts(spark, sf):
    return tidy(sm.system_label_counts(_systems(spark, sf)))


@query("system_agreement", f"{G} SELECT label, count(CASE WHEN g = 1 AND p = 1 THEN 1 END)::BIGINT AS both, count(CASE WHEN p = 0 THEN 1 END)::BIGINT AS left_only, count(CASE WHEN g = 0 THEN 1 END)::BIGINT AS right_only FROM spans GROUP BY label")
def system_agreement(spark, sf):
    s = _systems(spark, sf)
    return tidy(sm.system_agreement(s["gold"], s["pred"]))


@query("lookup_join", f"WITH {ENTS_SQL} SELECT w.word, count(*)::BIGINT AS n, round(sum(score), 5) AS total FROM ents JOIN (SELECT DISTINCT t AS word FROM ents WHERE doc_id % 10 = 0) w ON w.word = ents.t GROUP BY w.word")
def salted_lookup_join(spark, sf):
    """The salted form of the lookup join (the size check is set to fail)."""
    rows = annotated(spark, sf).select("row_idx", F.explode("entities").alias("e")).select("row_idx", F.col("e.start").alias("start"), F.col("e.text").alias("word"), F.col("e.score").alias("score"))
    words = rows.filter("row_idx % 10 = 0").select("word").distinct()
    return tidy(lookup_join(rows, words, ["word"], "inner", salts=16).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 5).alias("total")))


# --------------------------------------------------------------------------- quality of kept records
_KEPT = CYCLE_SQL + """, kr AS (SELECT cy.doc_id, cy.record_score, d.lang, regexp_replace(d.text, '^\\s+|\\s+$', '', 'g') AS text FROM cy JOIN documents d USING (doc_id) WHERE keep),
ke AS (SELECT kr.doc_id, count(bx.i) AS n, count(CASE WHEN after >= 0.8 THEN 1 END) AS strong, count(CASE WHEN after < 0.5 THEN 1 END) AS weak, max(after) AS best, sum(after) AS total FROM kr LEFT JOIN bx USING (doc_id) GROUP BY kr.doc_id),
kq AS (SELECT lang, count(*)::BIGINT AS kept_rows, count(DISTINCT text)::BIGINT AS unique_texts, (count(*) - count(DISTINCT text))::BIGINT AS duplicate_text_rows, (count(*) - count(DISTINCT text)) / count(*) AS dup_rate, avg(n) AS avg_n, avg(strong) AS avg_strong,
  avg(weak) AS avg_weak, avg(best) AS avg_best, sum(total) / sum(n) AS avg_score, avg(record_score) AS avg_record FROM kr JOIN ke USING (doc_id) GROUP BY lang)"""


def _kept(spark, sf):
    return cycle(spark, sf).records.filter("decision = 'kept'")


@query("kept_quality", _KEPT + """ SELECT lang, kept_rows, unique_texts, duplicate_text_rows, round(dup_rate, 6) AS duplicate_text_rate, round(avg_n, 6) AS avg_entities_per_kept, round(avg_strong, 6) AS avg_strong_entities_per_kept,
  round(avg_weak, 6) AS avg_weak_entities_per_kept, round(avg_best, 6) AS avg_max_entity_score, round(avg_score, 6) AS avg_entity_score, round(avg_record, 6) AS avg_record_score_in_kept FROM kq""")
def kept_quality(spark, sf):
    return tidy(sm.kept_quality(_kept(spark, sf), groups=["lang"]))


@query("quality_flags", _KEPT + """ SELECT lang, concat_ws(',', CASE WHEN kept_rows >= 100 THEN 'high_kept_count' END, CASE WHEN dup_rate >= 0.1 THEN 'duplicate_texts' END, CASE WHEN avg_weak >= 1 THEN 'many_weak_entities' END,
  CASE WHEN avg_best - avg_score <= -0.01 THEN 'strong_negative_delta' END, CASE WHEN avg_best - avg_score >= 0.01 THEN 'strong_positive_delta' END) AS flags FROM kq""")
def quality_flags(spark, sf):
    q = sm.kept_quality(_kept(spark, sf), groups=["lang"]).withColumnRenamed("kept_rows", "kept_count")
    return sm.quality_flags(q.withColumn("micro_delta", F.col("avg_max_entity_score") - F.col("avg_entity_score"))).select("lang", "flags")


@query("top_label", f"""WITH {ENTS_SQL}, c AS (SELECT source, label, count(*) AS n, min(doc_id * 100000 + i) AS first FROM ents JOIN documents USING (doc_id) GROUP BY ALL)
SELECT source, label AS top_label, n::BIGINT AS top_label_count FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS rn FROM c) WHERE rn = 1""")
def top_label(spark, sf):
    return tidy(sm.top_label(slim(annotated(spark, sf)), ["source"]))
