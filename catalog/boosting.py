"""Metadata boost and the full cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.fixtures import ENTS_SQL, annotated, doc, norm_sql, slim, tidy, with_metadata
from spanlake.operators import boost as bo
from spanlake.operators.score import EntityGate
from spanlake.plans.cycle import CycleConfig, prepare_next_iteration, pseudolabel_cycle

_STOP = "('a','ao','as','da','das','de','do','dos','e','em','na','nas','no','nos','o','os','ou','para','por','pra','pro','que','um','uma')"


def _tokens(expr: str) -> str:
    return f"list_distinct([w FOR w IN regexp_extract_all({expr}, '[0-9a-z]+') IF length(w) >= 3 AND w NOT IN {_STOP}])"


BOOST_SQL = f"""WITH {ENTS_SQL}, nd AS (SELECT doc_id, {norm_sql('text')} AS nt, source, lang FROM documents),
mv AS (SELECT doc_id, 1 AS k, 'logradouroLocal' AS f, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS v FROM ents WHERE i = 1 UNION ALL SELECT doc_id, 2, 'bairroLocal', source FROM documents
  UNION ALL SELECT doc_id, 3, 'cidadeLocal', lang FROM documents UNION ALL SELECT doc_id, 4, 'pontodeReferenciaLocal', 'Praça ' || lang FROM documents),
mm AS (SELECT mv.doc_id, k, f, v, {norm_sql('v')} AS nv FROM mv JOIN nd USING (doc_id) WHERE {norm_sql('v')} <> '' AND contains(nt, {norm_sql('v')})),
mc AS (SELECT doc_id, count(*) AS n FROM mm GROUP BY doc_id),
ne AS (SELECT *, {norm_sql('t')} AS ne FROM ents),
em AS (SELECT ne.doc_id, ne.i, ne.label, ne.t, ne.score, coalesce(bool_or(score >= 0.5 AND len({_tokens('ne')}) > 0 AND (nv = ne OR len(list_intersect({_tokens('ne')}, {_tokens('nv')})) >= 2)), false) AS hit
  FROM ne LEFT JOIN mm USING (doc_id) GROUP BY ALL),
b AS (SELECT em.*, coalesce(mc.n, 0) AS n, {{cond}} AS applied FROM em LEFT JOIN mc USING (doc_id)),
bx AS (SELECT *, CASE WHEN applied THEN {{mult}} ELSE 1.0::DOUBLE END AS mult, CASE WHEN applied THEN least(score * {{mult}}, 1.0) ELSE score END AS after FROM b),
rec AS (SELECT d.doc_id, coalesce(mc.n, 0) AS matches, count(bx.i) AS total, count(CASE WHEN applied THEN 1 END) AS boosted, coalesce(avg(after), 0) AS record_score, max(CASE WHEN applied THEN after END) AS best,
  max(CASE WHEN bx.label = 'Location' THEN after END) AS gate FROM documents d LEFT JOIN bx USING (doc_id) LEFT JOIN mc USING (doc_id) GROUP BY d.doc_id, mc.n)"""


def boost_sql(scope: str, per_match: bool = False) -> str:
    cond = {"all-entities": "coalesce(mc.n, 0) > 0", "location-only": "coalesce(mc.n, 0) > 0 AND label = 'Location'", "matched-only": "coalesce(mc.n, 0) > 0 AND hit",
            "location-matched-only": "coalesce(mc.n, 0) > 0 AND hit AND label = 'Location'"}[scope]
    return BOOST_SQL.replace("{cond}", cond).replace("{mult}", "pow(1.2, n)" if per_match else "1.2::DOUBLE")


def _corpus(spark, sf):
    return with_metadata(slim(annotated(spark, sf)))


def _boosted(spark, sf, scope="location-matched-only", **more):
    return bo.context_boost(_corpus(spark, sf), bo.BoostConfig(text_fields=("relato",), scope=scope, **more))


@query("record_context_match", boost_sql("all-entities") + " SELECT d.doc_id, count(mm.k)::BIGINT AS matches, coalesce(string_agg(f || '=' || v, '|' ORDER BY k), '') AS pairs FROM documents d LEFT JOIN mm USING (doc_id) GROUP BY d.doc_id")
def record_context_match(spark, sf):
    out = bo.record_context_match(_corpus(spark, sf), ["relato"], bo.METADATA_FIELDS)
    return tidy(out.select(doc(), F.size("_match.matched").alias("matches"), F.array_join(F.transform("_match.matched", lambda m: F.concat(m["field"], F.lit("="), m["value"])), "|").alias("pairs")))


@query("entity_matches_metadata", boost_sql("all-entities") + " SELECT label, hit::INT::BIGINT AS matches, count(*)::BIGINT AS n, round(sum(score), 6) AS total FROM em GROUP BY label, hit")
def entity_matches_metadata(spark, sf):
    df = bo.record_context_match(_corpus(spark, sf), ["relato"], bo.METADATA_FIELDS)
    rows = df.select(F.explode(F.transform("entities", lambda e: F.struct(e["label"].alias("label"), e["score"].alias("score"), bo.entity_matches_metadata(
        e, F.col("_match.matched"), ["text", "score"]).alias("m")))).alias("x"))
    return tidy(rows.groupBy("x.label", F.col("x.m").alias("matches")).agg(F.count(F.lit(1)).alias("n"), F.sum("x.score").alias("total")))


_PER_RECORD = " SELECT doc_id, matches::BIGINT AS matches, boosted::BIGINT AS boosted, total::BIGINT AS total, round(record_score, 6) AS record_score FROM rec"


def _per_record(df):
    t = "_context_boost_trace"
    return tidy(df.select(doc(), F.col(f"{t}.match_count").alias("matches"), F.col(f"{t}.boosted_entities").alias("boosted"), F.col(f"{t}.total_entities").alias("total"),
                          F.col("record_score_context_boosted").alias("record_score")))


@query("boost_all_entities", boost_sql("all-entities", True) + _PER_RECORD)
def boost_all_entities(spark, sf):
    return _per_record(_boosted(spark, sf, "all-entities", per_match=True))


@query("boost_location_only", boost_sql("location-only") + _PER_RECORD)
def boost_location_only(spark, sf):
    return _per_record(_boosted(spark, sf, "location-only"))


@query("boost_matched_only", boost_sql("matched-only") + _PER_RECORD)
def boost_matched_only(spark, sf):
    return _per_record(_boosted(spark, sf, "matched-only"))


@query("boost_location_matched_only", boost_sql("location-matched-only") + _PER_RECORD)
def boost_location_matched_only(spark, sf):
    return _per_record(_boosted(spark, sf))


@query("context_boost_stats", boost_sql("location-only") + """ SELECT count(*)::BIGINT AS records_total, sum(total)::BIGINT AS entities_total, sum(boosted)::BIGINT AS entities_boosted, count(CASE WHEN matches > 0 THEN 1 END)::BIGINT AS records_with_context_match,
  round(count(CASE WHEN matches > 0 THEN 1 END) / count(*), 6) AS pct_records_with_context_match, round(sum(boosted) / sum(total), 6) AS pct_entities_boosted, round(avg(record_score), 6) AS avg_record_score,
  round(avg(matches), 6) AS avg_metadata_matches_per_record FROM rec""")
def context_boost_stats(spark, sf):
    return tidy(bo.context_boost_stats(_boosted(spark, sf, "location-only")))


@query("context_boost_details", boost_sql("matched-only") + """ SELECT (rec.doc_id + 1)::BIGINT AS row_index, boosted::BIGINT AS boosted_entities, coalesce((SELECT string_agg(f, ',' ORDER BY k) FROM mm WHERE mm.doc_id = rec.doc_id), '') AS fields,
  coalesce((SELECT md5(string_agg(t || ':' || applied::INT, ',' ORDER BY i)) FROM bx WHERE bx.doc_id = rec.doc_id), md5('')) AS trace FROM rec""")
def context_boost_details(spark, sf):
    d = bo.context_boost_details(_boosted(spark, sf, "matched-only"))
    return tidy(d.select("row_index", "boosted_entities", F.array_join("matched_metadata_fields", ",").alias("fields"), F.md5(F.array_join(F.transform(
        "entity_trace", lambda e: F.concat(e["text"], F.lit(":"), e["boost_applied"].cast("int").cast("string"))), ",")).alias("trace")))


@query("boosted_rows", boost_sql("matched-only") + """ SELECT (doc_id + 1)::BIGINT AS row_index, t AS entity_text, label AS entity_label, round(score, 6) AS score_before, round(after, 6) AS score_after,
  'entity-overlaps-metadata' AS boost_reason FROM bx WHERE applied""")
def boosted_rows(spark, sf):
    rows = bo.boosted_rows(bo.context_boost_details(_boosted(spark, sf, "matched-only")))
    return tidy(rows.select("row_index", "entity_text", "entity_label", "score_before", "score_after", "boost_reason"))


@query("boost_audit_counts", boost_sql("matched-only") + """ SELECT 'boosted_label' AS kind, label AS key, count(*)::BIGINT AS n FROM bx WHERE applied GROUP BY label
  UNION ALL SELECT 'boost_reason', 'entity-overlaps-metadata', count(*) FROM bx WHERE applied UNION ALL SELECT 'matched_field', f, count(*) FROM mm GROUP BY f""")
def boost_audit_counts(spark, sf):
    return tidy(bo.boost_audit_counts(bo.context_boost_details(_boosted(spark, sf, "matched-only"))))


@query("boost_audit_summary", boost_sql("matched-only") + """ SELECT count(*)::BIGINT AS records_total, count(CASE WHEN matches > 0 THEN 1 END)::BIGINT AS records_with_context_match, count(CASE WHEN boosted > 0 THEN 1 END)::BIGINT AS records_with_boosted_entities,
  sum(total)::BIGINT AS entity_candidates_total, sum(boosted)::BIGINT AS entity_boosts_total FROM rec""")
def boost_audit_summary(spark, sf):
    return tidy(bo.boost_audit_summary(bo.context_boost_details(_boosted(spark, sf, "matched-only"))))


@query("top_boosted_records", boost_sql("all-entities") + " SELECT (doc_id + 1)::BIGINT AS row_index, boosted::BIGINT AS boosted_entities, round(best, 6) AS best FROM rec WHERE boosted > 0 ORDER BY boosted DESC, best DESC, doc_id LIMIT 20")
def top_boosted_records(spark, sf):
    top = bo.top_boosted_records(bo.context_boost_details(_boosted(spark, sf, "all-entities")), 20)
    return tidy(top.select("row_index", "boosted_entities", F.col("max_boosted_score_after").alias("best")))


# --------------------------------------------------------------------------- the cycle
CYCLE = CycleConfig(boost=bo.BoostConfig(text_fields=("relato",), scope="location-only"), threshold=0.5, fallback=None,
                    gate=EntityGate(threshold=0.7, score_field="score_context_boosted"))
CYCLE_SQL = boost_sql("location-only") + ", cy AS (SELECT *, record_score >= 0.5 AND coalesce(gate >= 0.7, false) AS keep, record_score >= 0.5 AND NOT coalesce(gate >= 0.7, false) AS rejected FROM rec)"


def cycle(spark, sf):
    return pseudolabel_cycle(_corpus(spark, sf), CYCLE)


@query("cycle_summary", CYCLE_SQL + """ SELECT count(*)::BIGINT AS records_total, count(CASE WHEN keep THEN 1 END)::BIGINT AS kept_count, count(CASE WHEN NOT keep THEN 1 END)::BIGINT AS discarded_count, 0::BIGINT AS missing_scores,
  count(CASE WHEN rejected THEN 1 END)::BIGINT AS entity_gate_rejections, round(avg(CASE WHEN keep THEN record_score END), 6) AS kept_score_mean, round(min(CASE WHEN keep THEN record_score END), 6) AS kept_score_min,
  round(max(CASE WHEN keep THEN record_score END), 6) AS kept_score_max, round(avg(CASE WHEN NOT keep THEN record_score END), 6) AS discarded_score_mean, round(min(CASE WHEN NOT keep THEN record_score END), 6) AS discarded_score_min,
  round(max(CASE WHEN NOT keep THEN record_score END), 6) AS discarded_score_max FROM cy""")
def cycle_summary(spark, sf):
    return tidy(cycle(spark, sf).summary)


@query("next_iteration", CYCLE_SQL + """, d AS (SELECT cy.doc_id, lang, text FROM cy JOIN documents USING (doc_id) WHERE NOT keep),
u AS (SELECT * FROM d WHERE regexp_matches(text, '\\S')) SELECT min(doc_id) AS doc_id, lang, md5(text) AS digest FROM u GROUP BY lang, text""")
def next_iteration(spark, sf):
    discarded = cycle(spark, sf).records.filter("decision = 'discarded'")
    out = prepare_next_iteration(discarded, ["lang", "relato"], dedupe_on=["lang", "relato"]).records
    return out.select(doc(), "lang", F.md5("relato").alias("digest"))


@query("next_iteration_counts", CYCLE_SQL + """, d AS (SELECT cy.doc_id, lang, text, regexp_matches(text, '\\S') AS ok FROM cy JOIN documents USING (doc_id) WHERE NOT keep)
SELECT lang AS file, count(*)::BIGINT AS input_rows, count(CASE WHEN NOT ok THEN 1 END)::BIGINT AS dropped_missing_required, 0::BIGINT AS dropped_empty_relato,
  count(DISTINCT CASE WHEN ok THEN text END)::BIGINT AS output_rows, (count(CASE WHEN ok THEN 1 END) - count(DISTINCT CASE WHEN ok THEN text END))::BIGINT AS dropped_duplicate FROM d GROUP BY lang""")
def next_iteration_counts(spark, sf):
    discarded = cycle(spark, sf).records.filter("decision = 'discarded'").withColumn("file", F.col("lang"))
    return tidy(prepare_next_iteration(discarded, ["relato"], dedupe_on=["relato"], per_file="file").counts)
