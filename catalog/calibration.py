"""Calibration: pairs, fits, application and quality measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.fixtures import CALIBRATION_SQL, ENTS_SQL, GOLD_PRED_SQL, annotated, calibration_pairs, doc, gold_and_pred, long, slim, tidy
from spanlake.operators import calibrate as ca

CLIP = "greatest(least({0}, 1 - 1e-6), 1e-6)"
LOGIT = f"ln({CLIP.format('score')} / (1 - {CLIP.format('score')}))"


def _sig(t: str) -> str:
    return f"(1 / (1 + exp(-({LOGIT}) / {t})))"


def grid_sql(rows: str, by: str = "") -> str:
    """CTEs gl (mean loss per temperature) and bt (best temperature), optionally per group."""
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    p = CLIP.format(_sig("t"))
    return f"""grid AS (SELECT i, 0.5 + i * 0.025::DOUBLE AS t FROM range(181) r(i)),
gl AS (SELECT {g}i, t, avg(-ln(CASE WHEN target = 1 THEN {p} ELSE 1 - {p} END)) AS loss, count(*) AS n, sum(target) AS pos FROM {rows}, grid GROUP BY {g}i, t),
bt AS (SELECT * FROM (SELECT *, row_number() OVER ({part}ORDER BY loss, i) AS rn FROM gl WHERE pos > 0 AND pos < n) WHERE rn = 1)"""


def measures_sql(score: str) -> str:
    p = f"greatest(least({score}, 1 - 1e-12), 1e-12)"
    return (f"count(*)::BIGINT AS rows, round(avg(target), 6) AS positive_rate, round(avg(pow({score} - target, 2)), 6) AS brier, "
            f"round(-avg(target * ln({p}) + (1 - target) * ln(1 - {p})), 6) AS nll")


def bin_sql(score: str) -> str:
    return " + ".join(f"({score} > {i} * 0.1::DOUBLE)::INT" for i in range(1, 10))


FIXED = ca.Calibrator.from_json('{"method": "temperature-per-class", "parameters": {"per_class_temperature": {"Person": {"temperature": 2.0}, '
                                '"Location": {"temperature": 0.8}}, "global_fallback_temperature": 1.5}}')
FIXED_T = "CASE label WHEN 'Person' THEN 2.0 WHEN 'Location' THEN 0.8 ELSE 1.5 END"


def _cal(spark, sf):
    return calibration_pairs(spark, sf).withColumn("score", ca.clip01(F.col("score"), 1e-6))


CAL = f"WITH {CALIBRATION_SQL.replace("i AS row_key, doc_id, score,", "i AS row_key, doc_id, greatest(least(score, 1 - 1e-6), 1e-6) AS score,")}"


# The entities are worked out once, not once for each side of the join.
_SIDES_SQL = GOLD_PRED_SQL.split(",\nspans AS")[0].replace("ents AS (", "ents AS MATERIALIZED (").replace("gold AS (", "gold AS MATERIALIZED (").replace("pred AS (", "pred AS MATERIALIZED (")
PAIRS_SQL = f"""WITH {_SIDES_SQL} SELECT (p.doc_id + 1)::BIGINT AS row_id, p.label, coalesce(g.t, '') AS reference, p.t AS predicted, p.s::BIGINT AS span_start, p.e::BIGINT AS span_end, round(p.score, 6) AS score,
  (g.doc_id IS NOT NULL)::INT::BIGINT AS valid FROM pred p LEFT JOIN gold g ON g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e AND g.label = p.label"""


@query("calibration_pairs", PAIRS_SQL)
def pairs(spark, sf):
    df = gold_and_pred(spark, sf)
    return _pairs(ca.calibration_pairs_in_records(df))


@query("calibration_pairs_joined", PAIRS_SQL)
def pairs_joined(spark, sf):
    """The same pairs from two long tables."""
    df = gold_and_pred(spark, sf)
    return _pairs(ca.calibration_pairs(long(df, "pred"), long(df, "gold")))


def _pairs(out):
    return tidy(out.select(F.col("RowId").alias("row_id"), F.col("Label").alias("label"), F.col("Entidade_Referencia").alias("reference"), F.col("Entidade_Predita").alias("predicted"),
                           F.col("Start").alias("span_start"), F.col("End").alias("span_end"), F.col("Score").alias("score"), F.col("Validacao").alias("valid")))


@query("scored_entities", f"WITH {ENTS_SQL} SELECT label, count(*)::BIGINT AS n, round(sum({CLIP.format('score')}), 6) AS total, sum(i)::BIGINT AS positions FROM ents WHERE label <> 'Organization' GROUP BY label")
def scored_entities(spark, sf):
    out = ca.scored_entities(slim(annotated(spark, sf)), labels=["Person", "Location"])
    return tidy(out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"), F.sum("ent_idx").alias("positions")))


@query("pseudo_targets_threshold", f"WITH {ENTS_SQL} SELECT (score >= 0.6)::INT::BIGINT AS target, count(*)::BIGINT AS n, round(sum(score), 5) AS total FROM ents GROUP BY 1")
def pseudo_targets_threshold(spark, sf):
    out = ca.pseudo_targets(ca.scored_entities(slim(annotated(spark, sf))), threshold=0.6)
    return tidy(out.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 5).alias("total")))


@query("pseudo_targets_bands", f"""WITH {ENTS_SQL}, q AS (SELECT quantile_cont(score, 0.3) AS lo, quantile_cont(score, 0.7) AS hi FROM ents)
SELECT (score >= hi)::INT::BIGINT AS target, count(*)::BIGINT AS n, round(sum(score), 5) AS total FROM ents, q WHERE score <= lo OR score >= hi GROUP BY 1""")
def pseudo_targets_bands(spark, sf):
    out = ca.pseudo_targets(ca.scored_entities(slim(annotated(spark, sf))), "quantile-bands")
    return tidy(out.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 5).alias("total")))


# --------------------------------------------------------------------------- fits
@query("fit_temperature", f"{CAL}, {grid_sql('cal')} SELECT round(t, 6) AS temperature, round(loss, 6) AS fit_loss, n::BIGINT AS support FROM bt")
def fit_temperature(spark, sf):
    return tidy(ca.fit_temperature(_cal(spark, sf)))


_ONE_CLASS = CAL + ", c1 AS (SELECT doc_id, score, label, CASE WHEN label = 'Organization' THEN 1 ELSE target END AS target FROM cal)"


@query("fit_temperature_per_class", f"""{_ONE_CLASS}, {grid_sql('c1', 'label')}, {grid_sql('c1').replace('grid AS', 'grid2 AS').replace(', grid GROUP', ', grid2 GROUP').replace('gl AS', 'gl2 AS').replace('FROM gl WHERE', 'FROM gl2 WHERE').replace('bt AS', 'bt2 AS')}
SELECT s.label, round(coalesce(bt.t, bt2.t), 6) AS temperature, round(bt.loss, 6) AS fit_loss, s.n::BIGINT AS support, CASE WHEN bt.t IS NULL THEN 'global-fallback' ELSE 'per-class' END AS source
FROM (SELECT label, count(*) AS n FROM c1 GROUP BY label) s LEFT JOIN bt USING (label), bt2""")
def fit_temperature_per_class(spark, sf):
    df = _cal(spark, sf).withColumn("target", F.when(F.col("label") == "Organization", 1).otherwise(F.col("target")))
    return tidy(ca.fit_temperature_per_class(df).drop("overall"))


def pav_sql(rows: str, by: str = "k") -> str:
    """CTEs pav .. iso: pool adjacent violators in rounds (all runs of violators at once), then the fit at every score.

    Sums are whole numbers, so the comparisons are exact.  ``rows`` has the columns ``by``, score and target.
    """
    return f"""u AS (SELECT {by}, score, sum(target)::HUGEINT AS y, count(*)::HUGEINT AS w FROM {rows} GROUP BY {by}, score),
pav AS (
  SELECT 0 AS it, {by}, score AS lo, y, w FROM u
  UNION ALL
  SELECT it + 1, {by}, min(lo), sum(y)::HUGEINT, sum(w)::HUGEINT FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY {by} ORDER BY lo) AS g, min(fresh) OVER () AS open FROM (
      SELECT *, CASE WHEN lag(y) OVER o * w >= y * lag(w) OVER o THEN 0 ELSE 1 END AS fresh FROM pav WINDOW o AS (PARTITION BY {by} ORDER BY lo)) a) b
  WHERE open = 0 GROUP BY it, {by}, g),
blocks AS (SELECT {by}, lo, y::DOUBLE / w::DOUBLE AS v FROM pav WHERE it = (SELECT max(it) FROM pav)),
iso AS (SELECT u.{by}, u.score, b.v FROM u ASOF JOIN blocks b ON b.{by} = u.{by} AND u.score >= b.lo)"""


CAL_PAV = CAL.replace("WITH ", "WITH RECURSIVE ", 1)
ISOTONIC_SQL = f"{CAL_PAV}, one AS (SELECT 0 AS k, score, target FROM cal), {pav_sql('one')}"


@query("fit_isotonic", ISOTONIC_SQL + " SELECT round(score, 6) AS score, round(v, 6) AS fitted FROM iso")
def fit_isotonic(spark, sf):
    """The monotone fit at every distinct score."""
    df = _cal(spark, sf)
    c = ca.fit_calibrator(df, "isotonic")
    return tidy(df.select("score").distinct().select("score", c.column(F.col("score"), F.lit("")).alias("fitted")))


@query("isotonic_calibrated", ISOTONIC_SQL + " SELECT label, count(*)::BIGINT AS n, round(sum(v), 5) AS total, round(avg(pow(v - target, 2)), 6) AS brier FROM cal JOIN iso USING (score) GROUP BY label")
def isotonic_calibrated(spark, sf):
    df = _cal(spark, sf)
    v = ca.fit_calibrator(df, "isotonic").column(F.col("score"), F.col("label"))
    return tidy(df.select("label", "target", v.alias("v")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 5).alias("total"), F.avg(F.pow(F.col("v") - F.col("target"), 2)).alias("brier")))


# --------------------------------------------------------------------------- application
@query("apply_temperature", f"WITH {ENTS_SQL} SELECT label, round(sum({_sig('2.5')}), 6) AS total, round(max({_sig('2.5')}), 6) AS top FROM ents GROUP BY label")
def apply_temperature(spark, sf):
    rows = annotated(spark, sf).select(F.explode("entities").alias("e")).select("e.label", ca.apply_temperature(F.col("e.score"), 2.5).alias("p"))
    return tidy(rows.groupBy("label").agg(F.sum("p").alias("total"), F.max("p").alias("top")))


@query("apply_calibrator", f"WITH {ENTS_SQL} SELECT doc_id, count(*)::BIGINT AS n, round(sum({_sig(FIXED_T)}), 6) AS calibrated, round(sum(score), 6) AS original FROM ents GROUP BY doc_id")
def apply_calibrator(spark, sf):
    out = ca.apply_calibrator(slim(annotated(spark, sf)), FIXED).filter(F.size("entities") > 0)
    total = lambda f: F.aggregate("entities", F.lit(0.0), lambda a, e: a + e[f])
    return tidy(out.select(doc(), F.size("entities").alias("n"), total("score_calibrated").alias("calibrated"), total("score_original").alias("original")))


_OWN = f"WITH {ENTS_SQL}, own AS (SELECT doc_id, {CLIP.format('score')} AS score, label, (score >= 0.6)::INT AS target FROM ents)"


@query("calibrate_corpus_stats", f"""{_OWN}, {grid_sql('own', 'label')} SELECT count(*)::BIGINT AS fit_rows, round(avg(target), 6) AS positive_rate, round(avg(pow(score - target, 2)), 6) AS brier_before,
  round(avg(pow({_sig('t')} - target, 2)), 6) AS brier_after FROM own JOIN bt USING (label)""")
def calibrate_corpus_stats(spark, sf):
    return tidy(ca.calibrate_corpus(slim(annotated(spark, sf)), "temperature-per-class", threshold=0.6)[1])


@query("calibrate_corpus", f"{CAL}, {grid_sql('cal')} SELECT label, count(*)::BIGINT AS n, round(sum(1 / (1 + exp(-ln({CLIP.format('ents.score')} / (1 - {CLIP.format('ents.score')})) / bt.t))), 5) AS calibrated FROM ents, bt GROUP BY label")
def calibrate_corpus(spark, sf):
    """Fit on labelled calibration rows, apply to the corpus."""
    out = ca.calibrate_corpus(slim(annotated(spark, sf)), "temperature", calibration=_cal(spark, sf))[0]
    rows = out.select(F.explode("entities").alias("e")).groupBy("e.label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("e.score_calibrated"), 5).alias("calibrated"))
    return tidy(rows)


# --------------------------------------------------------------------------- measures
@query("brier_nll", f"{CAL} SELECT label, {measures_sql('score')} FROM cal GROUP BY label")
def brier_nll(spark, sf):
    s, t = F.col("score"), F.col("target")
    return tidy(_cal(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.avg(t).alias("positive_rate"), ca.brier(s, t).alias("brier"), ca.nll(s, t).alias("nll")))


_BINS = f"""{CAL}, low AS (SELECT greatest(score * 0.72, 1e-6) AS score, target FROM cal), bins AS (SELECT ({bin_sql('score')}) AS bin, count(*) AS n, avg(score) AS conf, avg(target) AS acc FROM low GROUP BY 1)"""


def _lowered(spark, sf):
    """All rows, their scores scaled so that the highest bins stay empty."""
    return _cal(spark, sf).withColumn("score", F.greatest(F.col("score") * 0.72, F.lit(1e-6)))


@query("reliability_bins", _BINS + """ SELECT i::BIGINT AS bin, round(i / 10, 6) AS bin_lower, round((i + 1) / 10, 6) AS bin_upper, coalesce(n, 0)::BIGINT AS count, round(conf, 6) AS conf_mean, round(acc, 6) AS acc, round(abs(acc - conf), 6) AS gap
FROM range(10) r(i) LEFT JOIN bins ON bin = i""")
def reliability_bins(spark, sf):
    return tidy(ca.reliability_bins(_lowered(spark, sf)))


@query("ece_mce", _BINS + " SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece, round(max(abs(acc - conf)), 6) AS mce FROM bins")
def ece_mce(spark, sf):
    return tidy(ca.ece_mce(ca.reliability_bins(_lowered(spark, sf))))


def auc_sql(rows: str, by: str) -> str:
    return f"""SELECT {by}, round((sum(CASE WHEN target = 1 THEN r END) - p * (p + 1) / 2.0) / (p * n), 6) AS auc FROM (
  SELECT {by}, target, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0 AS r, sum(target) OVER (PARTITION BY {by}) AS p, sum(1 - target) OVER (PARTITION BY {by}) AS n FROM {rows}) x GROUP BY {by}, p, n"""


@query("auc", f"{CAL} {auc_sql('cal', 'label')}")
def auc(spark, sf):
    return tidy(ca.auc(_cal(spark, sf), ["label"]))


_EVAL = f"""{CAL}, pair AS (SELECT 'raw' AS scores, label, target, score FROM cal UNION ALL SELECT 'calibrated', label, target, {_sig(FIXED_T)} FROM cal),
sc AS (SELECT 'overall' AS scope, '*' AS label, scores, target, score FROM pair UNION ALL SELECT 'label', label, scores, target, score FROM pair)"""


@query("evaluate_calibrator", f"""{_EVAL}, b AS (SELECT scope, label, scores, ({bin_sql('score')}) AS bin, count(*) AS n, abs(avg(target) - avg(score)) AS gap FROM sc GROUP BY ALL),
e AS (SELECT scope, label, scores, round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM b GROUP BY ALL), m AS (SELECT scope, label, scores, {measures_sql('score')} FROM sc GROUP BY ALL)
SELECT * FROM m JOIN e USING (scope, label, scores)""")
def evaluate_calibrator(spark, sf):
    return tidy(ca.evaluate_calibrator(_cal(spark, sf), FIXED))


@query("audit_by_label", f"""{_EVAL} SELECT scope, label, scores, target::BIGINT AS target, count(*)::BIGINT AS count, round(avg(score), 6) AS mean, round(min(score), 6) AS min, round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS p50,
  round(quantile_cont(score, 0.75), 6) AS p75, round(max(score), 6) AS max, round(avg((score >= 0.8)::INT), 6) AS share_ge_threshold, 0.8::DOUBLE AS threshold FROM sc GROUP BY ALL""")
def audit_by_label(spark, sf):
    return tidy(ca.audit_by_label(_cal(spark, sf), 0.8, FIXED))


@query("audit_empty_cells", _ONE_CLASS + """, g AS (SELECT label, target, count(*) AS n, avg(score) AS m FROM c1 GROUP BY ALL), l AS (SELECT DISTINCT label FROM g)
SELECT l.label, t.t::BIGINT AS target, coalesce(n, 0)::BIGINT AS count, round(m, 6) AS mean FROM l CROSS JOIN (VALUES (0), (1)) t(t) LEFT JOIN g ON g.label = l.label AND g.target = t.t""")
def audit_empty_cells(spark, sf):
    """A label whose entities are all true still has a row for the false ones."""
    df = _cal(spark, sf).withColumn("target", F.when(F.col("label") == "Organization", 1).otherwise(F.col("target")))
    return tidy(ca.audit_by_label(df, 0.8).filter("scope = 'label'").select("label", "target", "count", "mean"))


# --------------------------------------------------------------------------- cross-validation
_FOLDS = f"{CAL}, fo AS (SELECT *, (row_number() OVER (ORDER BY md5('42:' || row_key)) - 1) % 5 AS fold FROM cal)"
_CV = f"""{_FOLDS.replace('WITH ', 'WITH RECURSIVE ', 1)}, tr AS (SELECT f.k AS fold, score, target FROM fo JOIN range(5) f(k) ON fo.fold <> f.k), {grid_sql('tr', 'fold')}, {pav_sql('tr', 'fold')},
sides AS (SELECT t.fold, t.target, t.score, coalesce(l.score, h.score) AS x0, coalesce(h.score, l.score) AS x1, coalesce(l.v, h.v) AS y0, coalesce(h.v, l.v) AS y1
  FROM fo t ASOF LEFT JOIN iso l ON l.fold = t.fold AND t.score >= l.score ASOF LEFT JOIN iso h ON h.fold = t.fold AND t.score <= h.score),
scored AS (SELECT fold, 'isotonic' AS method, CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * (score - x0) / (x1 - x0) ELSE y0 END AS score, target FROM sides
  UNION ALL SELECT fold, 'raw', score, target FROM fo UNION ALL SELECT fo.fold, 'temperature', {_sig('bt.t')}, target FROM fo JOIN bt ON bt.fold = fo.fold)"""
_CV_MEASURES = f"""mb AS (SELECT method, fold, ({bin_sql('score')}) AS bin, count(*) AS n, avg(score) AS conf, avg(target) AS acc FROM scored GROUP BY ALL),
e AS (SELECT method, fold, sum(n * abs(acc - conf)) / sum(n) AS ece, max(abs(acc - conf)) AS mce FROM mb GROUP BY ALL),
m AS (SELECT method, fold, avg(pow(score - target, 2)) AS brier, -avg(target * ln(greatest(least(score, 1 - 1e-12), 1e-12)) + (1 - target) * ln(1 - greatest(least(score, 1 - 1e-12), 1e-12))) AS nll FROM scored GROUP BY ALL),
au AS ({auc_sql('scored', 'method, fold').replace('round((sum', '((sum').replace(', 6) AS auc', ') AS auc')}),
f AS (SELECT * FROM m JOIN e USING (method, fold) JOIN au USING (method, fold)),
l AS (SELECT method, 'ece' AS metric, ece AS v FROM f UNION ALL SELECT method, 'mce', mce FROM f UNION ALL SELECT method, 'brier', brier FROM f UNION ALL SELECT method, 'nll', nll FROM f UNION ALL SELECT method, 'auc', auc FROM f)"""


@query("cv_summary", f"{_CV}, {_CV_MEASURES} SELECT method, metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(*)::BIGINT AS n_folds FROM l GROUP BY ALL")
def cv_summary(spark, sf):
    return tidy(ca.cv_summary(ca.cv_scores(_cal(spark, sf), "row_key")))


@query("cv_reliability", f"{_CV}, {_CV_MEASURES} SELECT method, bin::BIGINT AS bin, sum(n)::BIGINT AS count, round(avg(conf), 6) AS conf_mean, round(avg(acc), 6) AS acc FROM mb GROUP BY method, bin")
def cv_reliability(spark, sf):
    return tidy(ca.cv_reliability(ca.cv_scores(_cal(spark, sf), "row_key")))


@query("cv_isotonic", f"""{_CV} SELECT fold::BIGINT AS fold, count(*)::BIGINT AS n, round(avg(score), 5) AS mean, round(avg(pow(score - target, 2)), 5) AS brier FROM scored WHERE method = 'isotonic' GROUP BY fold""")
def cv_isotonic(spark, sf):
    """Each fold scored by the isotonic fit of the others."""
    out = ca.cv_scores(_cal(spark, sf), "row_key").filter("method = 'isotonic'")
    return tidy(out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 5).alias("mean"), F.round(F.avg(F.pow(F.col("score") - F.col("target"), 2)), 5).alias("brier")))
