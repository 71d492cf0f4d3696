"""Field resolution, label mapping, entity filters and corpus summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.fixtures import ENTS_SQL, GOLD_PRED_SQL, annotated, doc, documents, gold_and_pred, norm_sql, slim, table, tidy, with_metadata
from spanlake.functions import text as tx
from spanlake.operators import fields as fd
from spanlake.operators import filters as fl
from spanlake.operators import summarize as sm
from spanlake.operators.staging import once
from spanlake.operators.ordering import keep_first

STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def _patchy(spark, sf):
    """Documents whose ``relato`` is blank, NULL or padded text."""
    k = F.col("doc_id") % 3
    return documents(spark, sf).withColumn(
        "relato", F.when(k == 0, "  \n").when(k == 2, F.concat(F.lit(" "), "text", F.lit("\n "))))


PATCHY = "pd AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN E'  \\n' WHEN 2 THEN ' ' || text || E'\\n ' END AS relato FROM documents)"


@query("primary_text", f"""WITH {PATCHY}
SELECT doc_id, CASE WHEN regexp_matches(coalesce(relato, ''), '\\S') THEN 'relato' WHEN regexp_matches(text, '\\S') THEN 'text' ELSE '' END AS field_used,
  md5(CASE WHEN regexp_matches(coalesce(relato, ''), '\\S') THEN {STRIP.format('relato')} WHEN regexp_matches(text, '\\S') THEN {STRIP.format('text')} ELSE '' END) AS digest
FROM pd""")
def primary_text(spark, sf):
    text, used = tx.primary_text(["relato", "text"])
    return _patchy(spark, sf).select("doc_id", used.alias("field_used"), F.md5(text).alias("digest"))


@query("inference_text", f"""WITH {PATCHY}, parts AS (SELECT doc_id, [x FOR x IN [{STRIP.format("coalesce(relato, '')")}, {STRIP.format('source')}, {STRIP.format("' '")}, {STRIP.format('lang')}] IF x <> ''] AS p FROM pd)
SELECT doc_id, length(array_to_string(p, '. '))::BIGINT AS n, md5(array_to_string(p, '. ')) AS digest FROM parts""")
def inference_text(spark, sf):
    df = _patchy(spark, sf).withColumn("blank", F.lit(" "))
    joined = tx.inference_text(["relato", "source", "blank", "lang"])
    return tidy(df.select("doc_id", F.length(joined).alias("n"), F.md5(joined).alias("digest")))


@query("safe_double", """WITH r AS (SELECT event_id % 6 AS kind, CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN ' 1.5 ' WHEN 2 THEN 'nan' WHEN 3 THEN '1e3'
  WHEN 4 THEN CAST(user_id AS VARCHAR) END AS raw FROM events), p AS (SELECT kind, raw, TRY_CAST(trim(raw) AS DOUBLE) AS v FROM r)
SELECT kind::BIGINT AS kind, count(*)::BIGINT AS n, count(CASE WHEN NOT isnan(v) THEN v END)::BIGINT AS valid,
  round(coalesce(sum(CASE WHEN NOT isnan(v) THEN v END), 0), 6) AS total FROM p GROUP BY kind""")
def safe_double(spark, sf):
    k = F.col("event_id") % 6
    raw = F.when(k == 0, F.col("event_type")).when(k == 1, " 1.5 ").when(k == 2, "nan").when(k == 3, "1e3").when(k == 4, F.col("user_id").cast("string"))
    rows = table(spark, sf, "events").select(k.alias("kind"), tx.safe_double(raw).alias("v"))
    return tidy(rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("valid"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total")))


@query("pick_score", f"""WITH {ENTS_SQL}, s AS (SELECT label, CASE WHEN i % 3 = 0 THEN 'score_calibrated' WHEN i % 3 = 1 THEN 'score' ELSE '' END AS source,
  CASE WHEN i % 3 = 0 THEN score / 2 WHEN i % 3 = 1 THEN score END AS v FROM ents)
SELECT label, source, count(*)::BIGINT AS n, round(sum(v), 6) AS total FROM s GROUP BY label, source""")
def pick_score(spark, sf):
    df = annotated(spark, sf).withColumn("entities", F.transform("entities", lambda e, i: F.struct(
        e["label"].alias("label"), F.when(i % 3 == 0, (e["score"] / 2).cast("string")).when(i % 3 == 1, "n/a").alias("score_calibrated"),
        F.when(i % 3 != 2, e["score"]).alias("score"))))
    rows = df.select(F.explode(F.transform("entities", lambda e: F.struct(
        e["label"].alias("label"), tx.pick_score(e, ["score_calibrated", "score"]).alias("p")))).alias("x"))
    return tidy(rows.groupBy("x.label", "x.p.source").agg(F.count(F.lit(1)).alias("n"), F.sum("x.p.score").alias("total")))


@query("metadata_values", f"""WITH {ENTS_SQL}, m AS (SELECT d.doc_id, [x FOR x IN [{{'f': 'logradouroLocal', 'v': {STRIP.format('e.t')}}}, {{'f': 'bairroLocal', 'v': source}}, {{'f': 'cidadeLocal', 'v': lang}}] IF coalesce(x.v, '') <> ''] AS p
  FROM documents d LEFT JOIN ents e ON e.doc_id = d.doc_id AND e.i = 1)
SELECT doc_id, len(p)::BIGINT AS n, array_to_string([x.f || '=' || x.v FOR x IN p], '|') AS pairs FROM m""")
def metadata_values(spark, sf):
    m = with_metadata(annotated(spark, sf)).select(F.col("row_idx").alias("doc_id"), tx.metadata_values(["logradouroLocal", "bairroLocal", "cidadeLocal"]).alias("m"))
    return tidy(m.select("doc_id", F.size("m").alias("n"), F.array_join(F.transform("m", lambda p: F.concat(p["field"], F.lit("="), p["value"])), "|").alias("pairs")))


@query("mention_text", f"""WITH {ENTS_SQL}, x AS (SELECT e.doc_id, s, CASE WHEN i % 7 = 0 THEN e + 1000000 ELSE e END AS e, i, t, text FROM ents e JOIN documents d USING (doc_id))
SELECT doc_id, count(*)::BIGINT AS n, md5(string_agg(CASE WHEN e <= length(text) THEN substr(text, s + 1, e - s) ELSE 'own:' || t END, '|' ORDER BY i)) AS digest FROM x GROUP BY doc_id""")
def mention_text(spark, sf):
    df = once(annotated(spark, sf), m=F.transform("entities", lambda e, i: tx.mention_text(
        F.col("text"), e["start"], F.when(i % 7 == 0, e["end"] + 1000000).otherwise(e["end"]), F.concat(F.lit("own:"), e["text"]))))
    return tidy(df.filter(F.size("m") > 0).select(F.col("row_idx").alias("doc_id"), F.size("m").alias("n"), F.md5(F.array_join("m", "|")).alias("digest")))


@query("project_fields", """SELECT doc_id, coalesce(lang, '') AS lang, CAST(n_chars AS VARCHAR) AS n_chars, '-' AS missing FROM documents""")
def project_fields(spark, sf):
    out = fd.project_fields(documents(spark, sf).withColumn("row_idx", F.col("doc_id")), ["lang", "n_chars", "missing"], fill="-")
    return out.select(F.col("row_idx").alias("doc_id"), "lang", "n_chars", "missing")


@query("normalize_text", f"SELECT doc_id, md5({norm_sql('text')}) AS digest FROM documents")
def normalize_text(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(tx.normalize_text(F.col("text"))).alias("digest"))


@query("normalize_text_exact", f"SELECT doc_id, md5({norm_sql('text')}) AS digest FROM documents")
def normalize_text_exact(spark, sf):
    from spanlake.functions.udfs import normalize_text_exact as exact
    from spanlake.session import ship_package
    ship_package(spark)
    return documents(spark, sf).select("doc_id", exact(F.col("text")).alias("n")).select("doc_id", F.md5("n").alias("digest"))


@query("sql_functions", f"""WITH n AS (SELECT doc_id, {norm_sql('text')} AS v FROM documents)
SELECT doc_id, md5(v) AS digest, round(1 / (1 + exp(-ln((0.05 + doc_id % 90 / 100.0) / (0.95 - doc_id % 90 / 100.0)) / 2)), 6) AS calibrated,
  (SELECT count(DISTINCT w) FROM (SELECT unnest(regexp_extract_all(v, '[0-9a-z]+')) AS w) WHERE length(w) >= 3 AND w NOT IN ('das','dos','nas','nos','para','por','pra','pro','que','uma'))::BIGINT AS tokens FROM n""")
def sql_functions(spark, sf):
    from spanlake.functions.registry import register_functions
    register_functions(spark)
    documents(spark, sf).createOrReplaceTempView("spanlake_documents")
    return tidy(spark.sql("""
        SELECT doc_id, md5(n) AS digest, apply_temperature(CAST(0.05 + doc_id % 90 / 100.0 AS DOUBLE), 2D) AS calibrated, size(informative_tokens(n)) AS tokens
        FROM (SELECT doc_id, normalize_text(text) AS n FROM spanlake_documents)"""))


# --------------------------------------------------------------------------- labels
@query("rename_label", f"""WITH {ENTS_SQL}
SELECT CASE WHEN label = 'Person' THEN 'Subject' ELSE label END AS label, count(*)::BIGINT AS n, count(CASE WHEN label = 'Person' THEN 1 END)::BIGINT AS replaced FROM ents GROUP BY 1""")
def rename_label(spark, sf):
    df = fd.rename_label(annotated(spark, sf), "PERSON", "Subject", ignore_case=True, replaced=None)
    rows = df.select(F.explode("entities.label").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return tidy(rows.withColumn("replaced", F.when(F.col("label") == "Subject", F.col("n")).otherwise(0)))


@query("map_labels", f"""WITH {ENTS_SQL} SELECT CASE label WHEN 'Person' THEN 'PER' WHEN 'Location' THEN 'GPE' END AS label, count(*)::BIGINT AS n FROM ents WHERE label <> 'Organization' GROUP BY 1""")
def map_labels(spark, sf):
    df = fd.map_labels(annotated(spark, sf), {"Person": "PER", "Location": "GPE"}, drop_unmapped=True)
    return tidy(df.select(F.explode("entities.label").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")))


@query("entity_shapes", f"""WITH {ENTS_SQL}, x AS (SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN '' ELSE label END AS label, t AS text,
  CASE doc_id % 3 WHEN 0 THEN CAST(s AS VARCHAR) ELSE '' END AS start, CASE doc_id % 3 WHEN 0 THEN CAST(e AS VARCHAR) ELSE '' END AS "end" FROM ents)
SELECT doc_id, count(*)::BIGINT AS n, md5(string_agg(label || '/' || text || '/' || start || '/' || "end", '|' ORDER BY label, text, start, "end")) AS digest FROM x GROUP BY doc_id""")
def entity_shapes(spark, sf):
    df = annotated(spark, sf)
    objects = F.to_json(F.transform("entities", lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label"), e["start"].alias("start"), e["end"].alias("end"))))
    strings = F.to_json(F.col("entities.text"))
    labels = F.array_distinct(F.col("entities.label"))
    by_label = F.to_json(F.map_from_entries(F.transform(labels, lambda k: F.struct(k, F.transform(
        F.filter("entities", lambda e: e["label"] == k), lambda e: e["text"])))))
    k = F.col("row_idx") % 3
    rows = df.select("row_idx", F.when(k == 0, objects).when(k == 1, strings).otherwise(by_label).alias("payload"))
    out = fd.normalize_entity_shapes(rows, "payload").filter(F.size("entities") > 0)
    joined = F.array_join(F.transform("entities", lambda e: F.concat_ws("/", e["label"], e["text"], e["start"], e["end"])), "|")
    return tidy(out.select(F.col("row_idx").alias("doc_id"), F.size("entities").alias("n"), F.md5(joined).alias("digest")))


@query("resolve_entities", f"""WITH {GOLD_PRED_SQL}, n AS (SELECT d.doc_id, d.doc_id % 3 AS k, (SELECT count(*) FROM gold g WHERE g.doc_id = d.doc_id) AS g, (SELECT count(*) FROM pred p WHERE p.doc_id = d.doc_id) AS p FROM documents d)
SELECT CASE k WHEN 0 THEN 'entities' WHEN 1 THEN 'ner' ELSE 'none' END AS source, sum(CASE k WHEN 0 THEN g WHEN 1 THEN p ELSE 0 END)::BIGINT AS n FROM n GROUP BY k""")
def resolve_entities(spark, sf):
    k = F.col("row_idx") % 3
    df = gold_and_pred(spark, sf).select("row_idx", F.when(k == 0, F.col("gold")).alias("entities"), F.when(k == 1, F.col("pred")).alias("ner"))
    out = fd.resolve_entities(df, ("entities", "ner"), "found")
    source = F.when(k == 0, "entities").when(k == 1, "ner").otherwise("none")
    return tidy(out.groupBy(source.alias("source")).agg(F.sum(F.size("found")).alias("n")))


# --------------------------------------------------------------------------- filters
@query("clean_entities", f"""WITH {ENTS_SQL}, x AS (SELECT e.*, n_chars // 2 AS room FROM ents e JOIN documents d USING (doc_id))
SELECT doc_id, count(CASE WHEN e <= room THEN 1 END)::BIGINT AS bounded,
  count(CASE WHEN e <= room AND regexp_matches(t, '^[\\p{{L}}\\p{{N}}_À-ÿ\\s\\-.'']+$') THEN 1 END)::BIGINT AS clean FROM x GROUP BY doc_id""")
def clean_entities(spark, sf):
    df = annotated(spark, sf).filter(F.size("entities") > 0)
    room = F.floor(F.length("text") / 2)
    return tidy(df.select(F.col("row_idx").alias("doc_id"), F.size(fl.clean_entities(F.col("entities"), room, False)).alias("bounded"),
                          F.size(fl.clean_entities(F.col("entities"), room)).alias("clean")))


@query("sanitize_spans", f"""WITH {ENTS_SQL}, x AS (SELECT doc_id, s, e, label FROM ents WHERE i % 4 NOT IN (1, 2))
SELECT doc_id, count(*)::BIGINT AS n, md5(string_agg(s || '-' || e || label, ',' ORDER BY s, e)) AS digest FROM x GROUP BY doc_id""")
def sanitize_spans(spark, sf):
    df = annotated(spark, sf).withColumn("spans", F.reverse(F.transform("entities", lambda e, i: F.struct(
        F.when(i % 4 == 1, -1).otherwise(e["start"]).alias("start"), e["end"].alias("end"),
        F.when(i % 4 == 2, F.lit("  ")).otherwise(F.concat(F.lit(" "), e["label"], F.lit("\n"))).alias("label")))))
    out = once(df, s=fl.sanitize_spans(F.col("spans"), F.col("text"))).filter(F.size("s") > 0)
    return tidy(out.select(F.col("row_idx").alias("doc_id"), F.size("s").alias("n"), F.md5(F.array_join(F.transform(
        "s", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"), x["label"])), ",")).alias("digest")))


def _raw_entities(spark, sf):
    return annotated(spark, sf).withColumn("entities", F.transform("entities", lambda e, i: F.struct(
        F.when(i % 5 == 1, F.lit("x")).otherwise(e["start"].cast("string")).alias("start"), e["end"].cast("string").alias("end"),
        F.when(i % 5 == 2, F.lit(" ")).otherwise(e["label"]).alias("label"))))


TRAINING_SQL = f"""WITH {ENTS_SQL}, w AS (SELECT doc_id, CASE WHEN i % 5 = 2 THEN 'invalid_label' WHEN label = 'Organization' THEN 'filtered_by_label' WHEN i % 5 = 1 THEN 'invalid_span' END AS why FROM ents),
d AS (SELECT d.doc_id, regexp_matches(text, '\\S') AS has_text, (SELECT count(*) FROM w WHERE w.doc_id = d.doc_id AND why IS NULL) AS good FROM documents d)"""


@query("training_rejects", TRAINING_SQL + """, r AS (SELECT why AS reason FROM w WHERE why IS NOT NULL UNION ALL SELECT 'no_valid_entities' FROM d WHERE good = 0)
SELECT reason, count(*)::BIGINT AS n FROM r GROUP BY reason""")
def training_rejects(spark, sf):
    return tidy(fl.reject_counts(fl.normalize_training_entities(_raw_entities(spark, sf), ["Person", "Location"])))


@query("prepare_training_records", TRAINING_SQL + """, r AS (
  SELECT 'input_records' AS reason FROM d UNION ALL SELECT 'missing_text' FROM d WHERE NOT has_text UNION ALL SELECT 'kept_records' FROM d WHERE has_text AND good > 0
  UNION ALL SELECT 'dropped_no_entities' FROM d WHERE has_text AND good = 0 UNION ALL SELECT 'no_valid_entities' FROM d WHERE has_text AND good = 0
  UNION ALL SELECT why FROM w WHERE why IS NOT NULL)
SELECT reason, count(*)::BIGINT AS n, 'unknown' AS source FROM r GROUP BY reason""")
def prepare_training_records(spark, sf):
    return tidy(fl.prepare_training_records(_raw_entities(spark, sf), ["Person", "Location"]).counts)


@query("prepared_records", TRAINING_SQL + f""", g AS (SELECT ents.doc_id, string_agg(ents.label || ':' || ents.s || ':' || ents.e, ',' ORDER BY ents.s) AS kept, count(*) AS n FROM ents JOIN (SELECT doc_id, i, label,
    CASE WHEN i % 5 = 2 THEN 'invalid_label' WHEN label = 'Organization' THEN 'filtered_by_label' WHEN i % 5 = 1 THEN 'invalid_span' END AS why FROM ents) w USING (doc_id, i) WHERE why IS NULL GROUP BY ents.doc_id)
SELECT doc_id, n::BIGINT AS entities, md5(text) AS text_digest, md5(kept) AS entity_digest FROM g JOIN documents USING (doc_id) WHERE regexp_matches(text, '\\S')""")
def prepared_records(spark, sf):
    """The records themselves: text and kept spans."""
    rows = fl.prepare_training_records(_raw_entities(spark, sf), ["Person", "Location"]).records
    kept = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["label"], e["start"].cast("string"), e["end"].cast("string"))), ",")
    return tidy(rows.select(doc(), F.size("entities").alias("entities"), F.md5("text").alias("text_digest"), F.md5(kept).alias("entity_digest")))


@query("require_fields", f"""WITH {PATCHY} SELECT coalesce(CASE WHEN lang = 'fr' AND doc_id % 2 = 0 THEN 'dropped_missing_required' WHEN NOT regexp_matches(coalesce(relato, ''), '\\S') THEN 'dropped_empty_relato' END, 'kept') AS outcome,
  count(*)::BIGINT AS n FROM pd GROUP BY 1""")
def require_fields(spark, sf):
    df = _patchy(spark, sf).withColumn("assunto", F.when((F.col("lang") == "fr") & (F.col("doc_id") % 2 == 0), " ").otherwise(F.col("lang")))
    rows = fl.drop_reasons(df, ["assunto"], ["relato"])
    return tidy(rows.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n")))


BAN = {"Person": ["THE", "les", "Der"], "Location": ["is", "and", "DIE", "élle"], "Organization": ["für", "el", "in", "of"]}
BAN_SQL = "WITH " + ENTS_SQL + """, ban(label, term) AS (VALUES ('Person','the'),('Person','les'),('Person','der'),('Location','is'),('Location','and'),('Location','die'),
  ('Location','elle'),('Organization','fur'),('Organization','el'),('Organization','in'),('Organization','of')),
n AS (SELECT doc_id, i, label, trim(regexp_replace(strip_accents(lower(t)), '\\s+', ' ', 'g')) AS term FROM ents)"""


@query("remove_banned_spans", BAN_SQL + """ SELECT d.doc_id, count(n.i)::BIGINT AS kept FROM documents d LEFT JOIN (SELECT * FROM n WHERE (label, term) NOT IN (SELECT label, term FROM ban)) n USING (doc_id) GROUP BY d.doc_id""")
def remove_banned_spans(spark, sf):
    clean = fl.remove_banned_spans(slim(annotated(spark, sf)), BAN).records
    return tidy(clean.select(F.col("row_idx").alias("doc_id"), F.size("entities").alias("kept")))


@query("removed_terms", BAN_SQL + """ SELECT label, term AS mention_normalized, count(*)::BIGINT AS removed FROM n JOIN ban USING (label, term) GROUP BY label, term""")
def removed_terms(spark, sf):
    return tidy(fl.removed_terms(fl.remove_banned_spans(slim(annotated(spark, sf)), BAN).removed))


@query("filter_spans_by_regex", f"""WITH {ENTS_SQL} SELECT label, count(*)::BIGINT AS n FROM ents
WHERE regexp_full_match(t, '[A-Za-z]{{{{3,12}}}}') AND NOT regexp_matches(t, '(?i)^(the|and)') AND regexp_matches(t, '[aeiou]') GROUP BY label""".replace("{{", "{").replace("}}", "}"))
def filter_spans_by_regex(spark, sf):
    rules = [fl.SpanRule("[A-Za-z]{3,12}"), fl.SpanRule("^(the|and)", "partial", exclude=True, ignore_case=True), fl.SpanRule("[aeiou]", "partial")]
    rows = annotated(spark, sf).select(F.explode(fl.filter_spans_by_regex(F.col("entities"), rules)).alias("e"))
    return tidy(rows.groupBy("e.label").agg(F.count(F.lit(1)).alias("n")))


@query("filter_empty", f"WITH {ENTS_SQL} SELECT DISTINCT doc_id FROM ents WHERE label = 'Location'")
def filter_empty(spark, sf):
    df = annotated(spark, sf).select(F.col("row_idx").alias("doc_id"), F.filter("entities", lambda e: e["label"] == "Location").alias("ner"))
    return fl.filter_empty(df).select("doc_id")


@query("dense_records", f"""WITH {ENTS_SQL}, c AS (SELECT doc_id, count(*) AS n, count(CASE WHEN label = 'Person' THEN 1 END) AS p FROM ents GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS entity_count, p::BIGINT AS persons, length(text)::BIGINT AS text_length FROM c JOIN documents USING (doc_id) WHERE n >= 5 ORDER BY n DESC, length(text) DESC, doc_id LIMIT 50""")
def dense_records(spark, sf):
    out = fl.dense_records(slim(annotated(spark, sf)), 5, 50)
    m = "_dense_tip"
    return tidy(out.select(F.col("row_idx").alias("doc_id"), F.col(f"{m}.entity_count").alias("entity_count"),
                           F.coalesce(F.try_element_at(F.col(f"{m}.label_counts"), F.lit("Person")), F.lit(0)).alias("persons"), F.col(f"{m}.text_length").alias("text_length")))


# --------------------------------------------------------------------------- summaries
@query("label_counts", f"WITH {ENTS_SQL} SELECT label, count(*)::BIGINT AS n FROM ents GROUP BY label")
def label_counts(spark, sf):
    return tidy(sm.label_counts(slim(annotated(spark, sf))))


@query("corpus_totals", f"""WITH {ENTS_SQL}, c AS (SELECT d.doc_id, count(e.doc_id) AS n FROM documents d LEFT JOIN ents e USING (doc_id) GROUP BY d.doc_id)
SELECT count(*)::BIGINT AS rows, sum(n)::BIGINT AS entities, round(avg(n), 6) AS avg_entities, max(n)::BIGINT AS max_entities FROM c""")
def corpus_totals(spark, sf):
    return tidy(sm.corpus_totals(slim(annotated(spark, sf))))


@query("distinct_labels", f"WITH {GOLD_PRED_SQL} SELECT label, count(*)::BIGINT AS n FROM (SELECT label FROM gold UNION ALL SELECT label FROM pred) x GROUP BY label")
def distinct_labels(spark, sf):
    df = gold_and_pred(spark, sf).select("row_idx", F.col("gold").alias("entities"), F.col("pred").alias("ner"))
    return tidy(sm.distinct_labels(df))


@query("duplicate_text_stats", """WITH c AS (SELECT regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)
SELECT count(*)::BIGINT AS rows, count(DISTINCT t)::BIGINT AS unique_texts, (count(*) - count(DISTINCT t))::BIGINT AS duplicate_text_rows,
  round((count(*) - count(DISTINCT t)) / count(*), 6) AS duplicate_text_rate FROM c""")
def duplicate_text_stats(spark, sf):
    return tidy(sm.duplicate_text_stats(documents(spark, sf)))


@query("sample_ids", """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'sample_' || doc_id ELSE source END AS sample_id FROM documents), c AS (SELECT sample_id, count(*) AS n FROM s GROUP BY sample_id)
SELECT sample_id, n::BIGINT AS n FROM c WHERE n > 1""")
def sample_ids(spark, sf):
    from spanlake.sources.records import duplicate_ids, with_sample_id
    df = documents(spark, sf).select(F.col("doc_id").alias("row_idx"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("sample_id"))
    return tidy(duplicate_ids(with_sample_id(df)))
