"""Merging, deduplication and leakage checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.fixtures import LINES_SQL, doc, documents, order_lines, table, tidy
from spanlake.operators import merge as mg
from spanlake.operators.ordering import keep_first

KEY = "replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')"
SIDES = """sup AS (SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0), pse AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN E' \\n' WHEN doc_id % 5 = 0 THEN upper(text) ELSE text END AS text FROM documents WHERE doc_id % 2 = 1),
un AS (SELECT 'supervised' AS src, 0 AS rk, doc_id, text FROM sup UNION ALL SELECT 'pseudolabel', 1, doc_id, text FROM pse),
mg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rk, doc_id) AS rn FROM (SELECT *, """ + KEY + """ AS key FROM un)) WHERE rn = 1 OR key = '')"""


def _sides(spark, sf):
    df = documents(spark, sf).select(F.col("doc_id").alias("row_idx"), "text")
    k = F.col("row_idx")
    pseudo = df.filter(k % 2 == 1).withColumn("text", F.when(k % 7 == 0, F.lit(" \n")).when(k % 5 == 0, F.upper("text")).otherwise(F.col("text")))
    return df.filter(k % 2 == 0), pseudo


@query("merge_training", f"WITH {SIDES} SELECT src AS training_source, doc_id FROM mg")
def merge_training(spark, sf):
    return mg.merge_training(*_sides(spark, sf)).select("training_source", doc())


@query("merge_counts", f"WITH {SIDES} SELECT u.src AS training_source, count(*)::BIGINT AS input, count(mg.doc_id)::BIGINT AS kept, (count(*) - count(mg.doc_id))::BIGINT AS dropped_duplicate FROM un u LEFT JOIN mg ON mg.src = u.src AND mg.doc_id = u.doc_id GROUP BY u.src")
def merge_counts(spark, sf):
    sides = mg.select_sources("supervised_plus_pseudolabels", *_sides(spark, sf))
    return tidy(mg.merge_counts(sides, mg.merge_training(sides[0][1], sides[1][1])))


@query("select_sources", "SELECT 'supervised_only' AS mode, count(*)::BIGINT AS n FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'supervised_plus_pseudolabels', count(*) FROM documents UNION ALL SELECT 'pseudolabel_only', count(*) FROM documents WHERE doc_id % 2 = 1")
def select_sources(spark, sf):
    sup, pseudo = _sides(spark, sf)
    out = None
    for mode in ("supervised_only", "supervised_plus_pseudolabels", "pseudolabel_only"):
        one = mg.tagged_union(mg.select_sources(mode, sup, pseudo)).agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return tidy(out)


@query("accumulate", f"""WITH un AS (SELECT 1 + doc_id % 3 AS iteration, doc_id, text FROM documents) SELECT iteration::BIGINT AS iteration, doc_id FROM
  (SELECT *, row_number() OVER (PARTITION BY key ORDER BY iteration, doc_id) AS rn FROM (SELECT *, {KEY} AS key FROM un)) WHERE rn = 1 OR key = ''""")
def accumulate(spark, sf):
    df = documents(spark, sf).select(F.col("doc_id").alias("row_idx"), "text")
    return tidy(mg.accumulate([df.filter(F.col("row_idx") % 3 == i) for i in range(3)]).select("iteration", doc()))


@query("dedupe_exact", "SELECT source AS file, min(doc_id) AS doc_id FROM documents GROUP BY source, text, lang")
def dedupe_exact(spark, sf):
    df = documents(spark, sf).select(F.col("doc_id").alias("row_idx"), F.col("source").alias("file"), "text", "lang")
    return mg.dedupe_exact(df, ["text", "lang"], per_file="file").select("file", doc())


@query("keep_first_hot_key", f"WITH {LINES_SQL} SELECT l_returnflag, min(id) AS first FROM li GROUP BY l_returnflag, l_linestatus, l_quantity")
def keep_first_hot_key(spark, sf):
    """Few distinct keys over the largest table: each holds a large share of all rows."""
    firsts = keep_first(order_lines(spark, sf), ["l_returnflag", "l_linestatus", "l_quantity"])
    return firsts.select("l_returnflag", F.col("row_idx").alias("first"))


LEAK = """tr AS (SELECT doc_id, text, lang FROM documents WHERE doc_id % 2 = 0), te AS (SELECT doc_id, text, lang FROM documents WHERE doc_id % 2 = 1)"""


def _train_test(spark, sf):
    df = documents(spark, sf).select(F.col("doc_id").alias("row_idx"), "text", "lang", F.array(F.struct(F.col("lang").alias("l"), F.lit(1).alias("a"))).alias("x"))
    return df.filter("row_idx % 2 = 0"), df.filter("row_idx % 2 = 1")


@query("drop_seen_in", f"WITH {LEAK} SELECT doc_id FROM te WHERE (text, lang) NOT IN (SELECT text, lang FROM tr)")
def drop_seen_in(spark, sf):
    train, test = _train_test(spark, sf)
    return mg.drop_seen_in(test, train).select(doc())


@query("common_rows", f"WITH {LEAK} SELECT count(*)::BIGINT AS common_rows FROM (SELECT text, lang FROM tr INTERSECT SELECT text, lang FROM te)")
def common_rows(spark, sf):
    train, test = _train_test(spark, sf)
    return tidy(mg.common_rows(test, train))


@query("held_out_leak", "SELECT item_id FROM benchmark WHERE text NOT IN (SELECT text FROM documents)")
def held_out_leak(spark, sf):
    """Benchmark items that are no document of the corpus."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("row_idx"), "text")
    docs = documents(spark, sf).select(F.col("doc_id").alias("row_idx"), "text")
    return mg.drop_seen_in(items, docs).select(F.col("row_idx").alias("item_id"))
