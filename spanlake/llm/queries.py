"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanlake.llm import exact_dedup, language, licenses, main_text, near_dedup, packing, pieces, quality_classifier, quality_rules, sharding, token_counts, variants, whitening

#: Tokenizer files of the registered queries.
PIECE_MODEL, WORD_MODEL = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
WINDOW, SHARDS = 4096, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.known_digests(spark))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.fit_scores(docs, table(spark, sf_dir, "labels").filter("quality = 1")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_MODEL, WINDOW)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants_of(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_quality_rules, op3_exact_dedup, op4_kd_sharding, op5_sentencepiece, op6_packing,
    op7_quality_classifier, op8_near_dedup, op9_language_id, op10_token_counts,
    op11_main_text, op12_spelling_variants, op13_embedding_whitening)}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    body = f"regexp_replace(lower({text}), {_quoted(licenses.COPYRIGHT_LINE.replace('(?md)', '(?m)'))}, '', 'g')"
    out = f"'  ' || regexp_replace({body}, {_quoted(licenses.BETWEEN_WORDS.replace('\\n', ''))}, '  ', 'g') || '  '"
    for old, new in licenses.SPELLINGS:
        if old != new:
            out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


_KNOWN = ", ".join(f"({_quoted(name)}, {str(free).lower()}, {_quoted(text)})" for name, free, text in licenses.KNOWN)

ORACLES = {
    "op1_license_scan": f"""
        WITH known AS (
            SELECT digest, min(license) AS license, arg_min(permissive, license) AS permissive FROM (
                SELECT license, permissive, sha256({_canonical_sql('text')}) AS digest FROM (VALUES {_KNOWN}) v(license, permissive, text))
            GROUP BY digest),
        whole AS (SELECT doc_id, {_canonical_sql("coalesce(text, '')")} AS form FROM documents),
        lines AS (
            SELECT doc_id, {_canonical_sql('line')} AS form
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
        found AS (
            SELECT doc_id, count(*) AS n_lines, count(license) AS n_license_lines, list(license) AS found, min(permissive) AS permissive
            FROM (SELECT doc_id, sha256(form) AS digest FROM lines WHERE form <> '') l LEFT JOIN known USING (digest) GROUP BY doc_id),
        all_ AS (SELECT doc_id, form, sha256(form) AS digest FROM whole)
        SELECT w.doc_id, w.digest AS text_digest, k.license AS text_license, coalesce(n_lines, 0) AS n_lines, coalesce(n_license_lines, 0) AS n_license_lines,
               coalesce(array_to_string(list_sort(list_distinct(list_filter(list_append(found, k.license), lambda x: x IS NOT NULL))), ','), '') AS licenses,
               CASE WHEN k.permissive IS NULL THEN f.permissive WHEN f.permissive IS NULL THEN k.permissive ELSE k.permissive AND f.permissive END AS permissive
        FROM all_ w LEFT JOIN found f USING (doc_id) LEFT JOIN known k ON k.digest = w.digest AND w.form <> ''""",
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op8_near_dedup": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
            FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        parts AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT s.doc_id, len(s.s) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN parts USING (doc_id)""",
}
