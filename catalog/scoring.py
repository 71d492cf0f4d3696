"""Record scores, split, pruning and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.fixtures import ENTS_SQL, annotated, doc, slim, table, tidy
from spanlake.operators import prune as pr
from spanlake.operators import score as sc

PER_DOC_SQL = f"""WITH {ENTS_SQL}, sc AS (SELECT d.doc_id, d.text, list(e.score ORDER BY e.score) FILTER (e.score IS NOT NULL) AS v, count(e.score) AS n FROM documents d LEFT JOIN ents e USING (doc_id) GROUP BY d.doc_id, d.text)"""


@query("record_score", PER_DOC_SQL + """ SELECT doc_id, round(coalesce(list_avg(v), 0), 6) AS mean, round(coalesce(list_max(v), 0), 6) AS max, round(coalesce(list_median(v), 0), 6) AS median,
  round(coalesce(v[1 + round_even((n - 1) * 0.75, 0)::BIGINT], 0), 6) AS p75, n::BIGINT AS valid FROM sc""")
def record_score(spark, sf):
    df = slim(annotated(spark, sf))
    for how in ("mean", "max", "median", "p75"):
        df = sc.record_score(df, how=how, output=how, trace="_meta")
    return tidy(df.select(doc(), "mean", "max", "median", "p75", F.col("_meta.valid_scores").alias("valid")))


@query("record_score_stats", PER_DOC_SQL + """ SELECT count(*)::BIGINT AS records_total, count(CASE WHEN n = 0 THEN 1 END)::BIGINT AS records_empty, sum(n)::BIGINT AS valid_scores,
  0::BIGINT AS invalid_scores, round(avg(list_avg(v)), 6) AS score_mean, round(min(list_avg(v)), 6) AS score_min, round(max(list_avg(v)), 6) AS score_max FROM sc""")
def record_score_stats(spark, sf):
    return tidy(sc.record_score_stats(sc.record_score(slim(annotated(spark, sf)), empty="null")))


@query("resolve_score", """WITH r AS (SELECT doc_id % 5 AS k, n_chars / 1000.0::DOUBLE AS x FROM documents)
SELECT CASE k WHEN 0 THEN 'record_score' WHEN 1 THEN 'fallback' ELSE 'implicit_zero' END AS source,
  CASE k WHEN 2 THEN 'invalid_primary_score' WHEN 3 THEN 'missing_score_fields' WHEN 4 THEN 'invalid_fallback_score' ELSE '' END AS reason,
  count(*)::BIGINT AS n, round(sum(CASE WHEN k < 2 THEN x ELSE 0 END), 6) AS total FROM r GROUP BY k""")
def resolve_score(spark, sf):
    """Raw JSON lines in which the primary key is present, absent, or present and unparsable."""
    x, k = (F.col("n_chars") / 1000.0).cast("string"), F.col("doc_id") % 5
    raw = (F.when(k == 0, F.concat(F.lit('{"record_score": '), x, F.lit("}"))).when(k == 1, F.concat(F.lit('{"fallback": '), x, F.lit("}")))
           .when(k == 2, F.concat(F.lit('{"record_score": "bad", "fallback": '), x, F.lit("}"))).when(k == 3, F.lit("{}")).otherwise(F.lit('{"fallback": null}')))
    df = table(spark, sf, "documents").select(raw.alias("_raw")).withColumn("p", F.from_json("_raw", "record_score string, fallback string")).select("_raw", "p.*")
    out = sc.resolve_score(df, fallback="fallback", raw="_raw")
    return tidy(out.groupBy("_score.source", F.coalesce("_score.reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("_score.value").alias("total")))


@query("compare_operators", """WITH v AS (SELECT CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN 12.5 ELSE value END AS x, event_id % 10 = 2 AS is_nan, event_type FROM events)
SELECT event_type, count(CASE WHEN NOT is_nan AND x >= 12.5 THEN 1 END)::BIGINT AS ge, count(CASE WHEN NOT is_nan AND x > 12.5 THEN 1 END)::BIGINT AS gt,
  count(CASE WHEN NOT is_nan AND x <= 12.5 THEN 1 END)::BIGINT AS le, count(CASE WHEN NOT is_nan AND x < 12.5 THEN 1 END)::BIGINT AS lt FROM v GROUP BY event_type""")
def compare_operators(spark, sf):
    k = F.col("event_id") % 10
    x = F.when(k == 0, None).when(k == 1, 12.5).when(k == 2, float("nan")).otherwise(F.col("value"))
    df = table(spark, sf, "events").select("event_type", x.alias("x"))
    return tidy(df.groupBy("event_type").agg(*[F.count_if(sc.compare(F.col("x"), 12.5, op)).alias(op) for op in ("ge", "gt", "le", "lt")]))


GATE = sc.EntityGate(labels=("Location", "Person"), threshold=0.4, how="mean")


@query("entity_gate", f"""WITH {ENTS_SQL}, g AS (SELECT d.doc_id, avg(e.score) AS v, count(e.score) AS n FROM documents d LEFT JOIN ents e ON e.doc_id = d.doc_id AND e.label IN ('Location', 'Person') GROUP BY d.doc_id)
SELECT doc_id, round(v, 6) AS score, CASE WHEN v >= 0.4 THEN 1 ELSE 0 END::BIGINT AS passed, CASE WHEN v IS NULL THEN 'no_matching_entities' ELSE '' END AS reason, n::BIGINT AS matched FROM g""")
def entity_gate(spark, sf):
    out = sc.entity_gate(slim(annotated(spark, sf)), GATE)
    return tidy(out.select(doc(), "_gate.score", "_gate.passed", F.coalesce("_gate.reason", F.lit("")).alias("reason"), F.size("_gate.matched").alias("matched")))


SPLIT_SQL = f"""WITH {ENTS_SQL}, r AS (SELECT d.doc_id, avg(e.score) AS v, max(CASE WHEN label = 'Location' THEN score END) AS g FROM documents d LEFT JOIN ents e USING (doc_id) GROUP BY d.doc_id),
x AS (SELECT doc_id, v, CASE WHEN v >= 0.45 THEN g END AS g, CASE WHEN v >= 0.45 AND g >= 0.7 THEN 'kept' ELSE 'discarded' END AS decision, v >= 0.45 AND NOT coalesce(g >= 0.7, false) AS rejected FROM r)"""


def _split(spark, sf):
    scored = sc.record_score(slim(annotated(spark, sf)), empty="null")
    return sc.split_records(scored, threshold=0.45, missing="discard", gate=sc.EntityGate(threshold=0.7))


@query("split_records", SPLIT_SQL + " SELECT doc_id, decision, round(v, 6) AS score_used, round(g, 6) AS gate_score FROM x")
def split_records(spark, sf):
    return tidy(_split(spark, sf).select(doc(), "decision", "_split.score_used", F.col("_split.entity_gate.gate_score_used").alias("gate_score")))


@query("split_summary", SPLIT_SQL + """ SELECT count(*)::BIGINT AS records_total, count(CASE WHEN decision = 'kept' THEN 1 END)::BIGINT AS kept_count, count(CASE WHEN decision <> 'kept' THEN 1 END)::BIGINT AS discarded_count,
  count(CASE WHEN v IS NULL THEN 1 END)::BIGINT AS missing_scores, count(CASE WHEN rejected THEN 1 END)::BIGINT AS entity_gate_rejections,
  round(avg(CASE WHEN decision = 'kept' THEN v END), 6) AS kept_score_mean, round(min(CASE WHEN decision = 'kept' THEN v END), 6) AS kept_score_min, round(max(CASE WHEN decision = 'kept' THEN v END), 6) AS kept_score_max,
  round(avg(CASE WHEN decision <> 'kept' THEN v END), 6) AS discarded_score_mean, round(min(CASE WHEN decision <> 'kept' THEN v END), 6) AS discarded_score_min, round(max(CASE WHEN decision <> 'kept' THEN v END), 6) AS discarded_score_max FROM x""")
def split_summary(spark, sf):
    return tidy(sc.split_summary(_split(spark, sf)))


# --------------------------------------------------------------------------- prune
PRUNE_SQL = f"""WITH {ENTS_SQL}, m AS (SELECT doc_id, i, s, e, label, t, score, CASE
   WHEN label NOT IN ('Person', 'Location') THEN 'label' WHEN score < CASE label WHEN 'Location' THEN 0.5 ELSE 0.2 END THEN 'score' END AS why FROM ents),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(t) DESC, s, e, label, i) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM m WHERE why IS NULL),
o AS (SELECT doc_id, count(*) AS after, max(n) AS before_cap, md5(string_agg(t, '|' ORDER BY CASE WHEN n > 4 THEN r ELSE i END)) AS digest FROM k WHERE n <= 4 OR r <= 4 GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n, count(CASE WHEN why = 'score' THEN 1 END) AS by_score, count(CASE WHEN why = 'label' THEN 1 END) AS by_label FROM m GROUP BY doc_id),
z AS (SELECT d.doc_id, coalesce(c.n, 0) AS before, coalesce(o.after, 0) AS after, coalesce(by_score, 0) AS by_score, coalesce(by_label, 0) AS by_label, coalesce(before_cap - after, 0) AS by_cap, coalesce(digest, md5('')) AS digest
  FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id))"""


def _pruned(spark, sf):
    return pr.prune_entities(slim(annotated(spark, sf)), 0.2, {"Location": 0.5}, max_k=4, labels=["Person", "Location"])


@query("prune_entities", PRUNE_SQL + " SELECT doc_id, before::BIGINT AS before, after::BIGINT AS after, by_score::BIGINT AS by_score, by_label::BIGINT AS by_label, by_cap::BIGINT AS by_cap, digest FROM z")
def prune_entities(spark, sf):
    p = "_pseudolabel_prune"
    return tidy(_pruned(spark, sf).select(doc(), F.col(f"{p}.entities_before").alias("before"), F.col(f"{p}.entities_after").alias("after"),
                                          F.col(f"{p}.dropped_by_score").alias("by_score"), F.col(f"{p}.dropped_by_label").alias("by_label"),
                                          F.col(f"{p}.pruned_by_cap").alias("by_cap"), F.md5(F.array_join("entities.text", "|")).alias("digest")))


@query("prune_summary", PRUNE_SQL + """ SELECT count(*)::BIGINT AS tips_total, count(CASE WHEN after > 0 THEN 1 END)::BIGINT AS tips_kept, count(CASE WHEN after = 0 THEN 1 END)::BIGINT AS tips_dropped_empty,
  sum(before)::BIGINT AS entities_before, sum(after)::BIGINT AS entities_after, sum(before - after)::BIGINT AS entities_removed, round(sum(before) / count(*), 6) AS avg_entities_per_tip_before,
  round(sum(after) / count(CASE WHEN after > 0 THEN 1 END), 6) AS avg_entities_per_tip_after, sum(by_score)::BIGINT AS dropped_by_score, sum(by_label)::BIGINT AS dropped_by_label, 0::BIGINT AS missing_score,
  sum(by_cap)::BIGINT AS pruned_by_cap, 0::BIGINT AS dropped_tip_over_cap FROM z""")
def prune_summary(spark, sf):
    return tidy(pr.prune_summary(_pruned(spark, sf), drop_empty=True))


@query("top_k_per_record", f"""WITH {ENTS_SQL}, r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, e - s DESC, s, e, label, i) AS rank FROM ents)
SELECT doc_id, i::BIGINT AS ent_idx, rank::BIGINT AS rank FROM r WHERE rank <= 3""")
def top_k_per_record(spark, sf):
    ents = annotated(spark, sf).select("row_idx", F.posexplode("entities").alias("ent_idx", "e")).select("row_idx", "ent_idx", "e.start", "e.end", "e.label", "e.score")
    return tidy(pr.top_k_per_record(ents, 3).select(doc(), "ent_idx", "rank"))


# --------------------------------------------------------------------------- rank
RANK_SQL = f"""WITH {ENTS_SQL}, f AS (SELECT d.doc_id, d.text, length(d.text) AS text_length, count(e.i) AS n, avg(score) AS m, min(score) AS lo, max(score) AS hi,
  count(CASE WHEN score >= 0.8 THEN 1 END) AS high, count(CASE WHEN score < 0.6 THEN 1 END) AS low, count(CASE WHEN length(t) <= 3 THEN 1 END) AS short,
  coalesce(max(CASE WHEN label = 'Location' THEN score END), 0) AS loc, count(CASE WHEN label = 'Organization' THEN 1 END) AS org, count(CASE WHEN label = 'Location' THEN 1 END) AS locs, count(CASE WHEN label = 'Person' THEN 1 END) AS per
  FROM documents d LEFT JOIN ents e USING (doc_id) GROUP BY d.doc_id, d.text),
g AS (SELECT *, CASE WHEN text_length > 0 THEN n * 1000.0 / text_length ELSE 0 END AS density, coalesce(m, 0) AS mean, CASE WHEN n > 0 THEN high / n ELSE 0 END AS high_share, CASE WHEN n > 0 THEN low / n ELSE 0 END AS low_share,
  CASE WHEN n > 0 THEN short / n ELSE 0 END AS short_ratio, CASE WHEN n > 0 THEN org / n ELSE 0 END AS org_ratio FROM f),
q AS (SELECT *, 0.45 * coalesce(m, mean) + 0.30 * mean + 0.15 * high_share + 0.10 * loc - 0.20 * low_share - 0.20 * short_ratio - 0.15 * least(density / 30.0, 1.0) - 0.10 * least(greatest(org_ratio - 0.5, 0.0) / 0.5, 1.0) AS quality FROM g),
k AS (SELECT *, CASE WHEN m < 0.4 THEN 'record_score' WHEN n > 60 THEN 'entity_count' WHEN short_ratio > 0.6 THEN 'short_span_ratio' WHEN locs + per = 0 THEN 'required_labels' END AS why FROM q),
top AS (SELECT *, row_number() OVER (ORDER BY round(quality, 9) DESC, coalesce(m, -1) DESC, mean DESC, n, doc_id) AS rank FROM k WHERE why IS NULL)"""
CFG = pr.RankConfig(min_record_score=0.4, max_entities=60, max_short_span_ratio=0.6, required_labels=("Location", "Person"))


def _candidates(spark, sf):
    scored = sc.record_score(slim(annotated(spark, sf)), empty="null", trace=None)
    return pr.candidate_features(scored, CFG)


@query("candidate_features", RANK_SQL + """ SELECT doc_id, n::BIGINT AS entity_count, text_length::BIGINT AS text_length, round(density, 6) AS density, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi,
  round(high_share, 6) AS high_share, round(low_share, 6) AS low_share, round(short_ratio, 6) AS short_ratio, round(loc, 6) AS loc, round(org_ratio, 6) AS org_ratio, round(quality, 6) AS quality FROM q""")
def candidate_features(spark, sf):
    m = lambda f, n: F.col(f"_candidate_rank.{f}").alias(n)
    return tidy(_candidates(spark, sf).select(
        doc(), m("entity_count", "entity_count"), m("text_length", "text_length"), m("entity_density_per_1k_chars", "density"), m("mean_entity_score", "mean"),
        m("min_entity_score", "lo"), m("max_entity_score", "hi"), m("high_score_share", "high_share"), m("low_score_share", "low_share"),
        m("short_span_ratio", "short_ratio"), m("location_max_score", "loc"), m("organization_ratio", "org_ratio"), m("candidate_quality_score", "quality")))


@query("candidate_drops", RANK_SQL + " SELECT coalesce(why, 'kept') AS outcome, count(*)::BIGINT AS n FROM k GROUP BY 1")
def candidate_drops(spark, sf):
    return tidy(pr.candidate_drops(_candidates(spark, sf), CFG))


@query("rank_candidates", RANK_SQL + """ SELECT rank::BIGINT AS rank, (doc_id + 1)::BIGINT AS row_index_1based, round(quality, 6) AS quality, locs::BIGINT AS location_count, org::BIGINT AS organization_count, per::BIGINT AS person_count,
  md5(substr(replace(text, E'\\n', ' '), 1, 160)) AS preview FROM top WHERE rank <= 100""")
def rank_candidates(spark, sf):
    best = pr.candidate_report(pr.rank_candidates(pr.filter_candidates(_candidates(spark, sf), CFG), 100))
    return tidy(best.select("rank", "row_index_1based", F.col("candidate_quality_score").alias("quality"), "location_count", "organization_count", "person_count", F.md5("text_preview").alias("preview")))


@query("rank_all_candidates", RANK_SQL + " SELECT doc_id, rank::BIGINT AS rank FROM top")
def rank_all_candidates(spark, sf):
    return tidy(pr.rank_candidates(pr.filter_candidates(_candidates(spark, sf), CFG), 0).select(doc(), "rank"))


@query("candidate_summary", RANK_SQL + """ SELECT count(*)::BIGINT AS rows_selected, round(avg(quality), 6) AS avg_quality_score, round(avg(m), 6) AS avg_record_score, round(avg(n), 6) AS avg_entities_per_tip, max(n)::BIGINT AS max_entities_per_tip
  FROM top WHERE rank <= 100""")
def candidate_summary(spark, sf):
    return tidy(pr.candidate_summary(pr.rank_candidates(pr.filter_candidates(_candidates(spark, sf), CFG), 100)))
