"""Positions, samples, splits, folds, weights, batches and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.extraction import ALIGNED_SQL
from catalog.fixtures import ENTS_SQL, LINES_SQL, annotated, doc, order_lines, slim, table, tidy
from catalog.merging import KEY
from spanlake.operators import ordering as od
from spanlake.operators import splits as sp
from spanlake.operators.balance import balance_folds
from spanlake.operators.staging import written
from spanlake.plans.training import training_manifest, training_windows


def h(seed, *cols):
    return "md5('" + str(seed) + ":' || " + " || ':' || ".join(cols) + ")"


# --------------------------------------------------------------------------- positions
@query("hash_positions", f"WITH {LINES_SQL} SELECT id, l_returnflag, (row_number() OVER (PARTITION BY l_returnflag ORDER BY {h(42, 'id')}) - 1)::BIGINT AS pos FROM li")
def hash_positions(spark, sf):
    return tidy(od.with_hash_position(order_lines(spark, sf), ["row_idx"], 42, ["l_returnflag"]).select(F.col("row_idx").alias("id"), "l_returnflag", "pos"))


@query("value_positions", f"WITH {LINES_SQL} SELECT id, (row_number() OVER (ORDER BY l_extendedprice DESC, id) - 1)::BIGINT AS pos FROM li")
def value_positions(spark, sf):
    return tidy(od.with_position(order_lines(spark, sf), [F.desc("l_extendedprice"), F.col("row_idx")]).select(F.col("row_idx").alias("id"), "pos"))


@query("running_totals", f"""WITH {LINES_SQL}, c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM li GROUP BY ALL)
SELECT l_returnflag, round(l_quantity, 6) AS l_quantity, n::BIGINT AS n, (sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - n)::BIGINT AS n_before, (sum(n) OVER (PARTITION BY l_returnflag))::BIGINT AS n_total FROM c""")
def running_totals(spark, sf):
    counts = order_lines(spark, sf).groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    return tidy(od.running_totals(counts, ["l_returnflag"], "l_quantity", ["n"]))


@query("group_quantiles", f"WITH {LINES_SQL} SELECT l_returnflag, p::DOUBLE AS prob, round(quantile_cont(l_extendedprice, p), 6) AS quantile FROM li, (VALUES (0.05), (0.5), (0.95)) v(p) GROUP BY l_returnflag, p".replace("quantile_cont(l_extendedprice, p)", "CASE p WHEN 0.05 THEN quantile_cont(l_extendedprice, 0.05) WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5) ELSE quantile_cont(l_extendedprice, 0.95) END"))
def group_quantiles(spark, sf):
    return tidy(od.group_quantiles(order_lines(spark, sf), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95]))


@query("top_n", f"WITH {LINES_SQL} SELECT id, round(l_extendedprice, 6) AS price FROM li ORDER BY l_extendedprice DESC, id LIMIT 100")
def top_n(spark, sf):
    return tidy(od.top_n(order_lines(spark, sf), 100, F.desc("l_extendedprice"), F.col("row_idx")).select(F.col("row_idx").alias("id"), F.col("l_extendedprice").alias("price")))


# --------------------------------------------------------------------------- chunks and samples
@query("assign_chunks", "WITH " + LINES_SQL + " SELECT id, ((row_number() OVER (ORDER BY id) - 1) // 700 + 1)::BIGINT AS chunk_id FROM li")
def assign_chunks(spark, sf):
    return tidy(sp.assign_chunks(order_lines(spark, sf), 700).select(F.col("row_idx").alias("id"), "chunk_id"))


@query("assign_chunks_shuffled", f"""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY {h(7, 'doc_id')}) - 1 AS pos, count(*) OVER () AS n FROM documents)
SELECT doc_id, (pos // 30 + 1)::BIGINT AS chunk_id, 'part_' || lpad((pos // 30 + 1)::VARCHAR, greatest(2, length(ceil(n / 30)::BIGINT::VARCHAR))::INT, '0') AS chunk_name FROM p""")
def assign_chunks_shuffled(spark, sf):
    df = table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"))
    return tidy(sp.assign_chunks(df, 30, shuffle=True, seed=7, prefix="part").select(doc(), "chunk_id", "chunk_name"))


@query("sample_rows", f"WITH {LINES_SQL} SELECT id FROM li ORDER BY {h(42, 'id')} LIMIT 5000")
def sample_rows(spark, sf):
    return sp.sample_rows(order_lines(spark, sf), 5000).select(F.col("row_idx").alias("id"))


@query("sample_pseudolabels", f"""WITH {LINES_SQL}, a AS (SELECT id, row_number() OVER (ORDER BY {h(42, 'id')}) AS r, count(*) OVER () AS n FROM li), b AS (SELECT id FROM a WHERE r <= greatest(1, round_even(n * 0.35, 0)))
SELECT id FROM b ORDER BY {h(43, 'id')} LIMIT 3000""")
def sample_pseudolabels(spark, sf):
    return sp.sample_pseudolabels(order_lines(spark, sf), 0.35, 3000).select(F.col("row_idx").alias("id"))


# --------------------------------------------------------------------------- splits
@query("split_train_val", f"""WITH {LINES_SQL}, a AS (SELECT id, row_number() OVER (ORDER BY {h(42, 'id')}) AS r, count(*) OVER () AS n FROM li)
SELECT id, CASE WHEN r <= greatest(1, round_even(n * 0.2, 0)) THEN 'validation' ELSE 'train' END AS role FROM a""")
def split_train_val(spark, sf):
    return sp.split_train_val(order_lines(spark, sf), 0.2).select(F.col("row_idx").alias("id"), "role")


REFIT = f"""sup AS (SELECT doc_id, text, row_number() OVER (ORDER BY {h(42, 'doc_id')}) AS r, count(*) OVER () AS n FROM documents WHERE doc_id % 2 = 0), val AS (SELECT * FROM sup WHERE r <= greatest(1, round_even(n * 0.2, 0))),
un AS (SELECT 'supervised' AS src, 0 AS rk, doc_id, text FROM sup WHERE doc_id NOT IN (SELECT doc_id FROM val) UNION ALL SELECT 'pseudolabel', 1, doc_id, text FROM documents WHERE doc_id % 2 = 1),
tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rk, doc_id) AS rn FROM (SELECT *, {KEY} AS key FROM un)) WHERE rn = 1 OR key = '')"""


@query("refit_splits", f"WITH {REFIT} SELECT doc_id, src AS training_source, 'train' AS role FROM tr UNION ALL SELECT doc_id, 'supervised', 'validation' FROM val")
def refit_splits(spark, sf):
    df = table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), "text")
    return sp.refit_splits(df.filter("row_idx % 2 = 0"), df.filter("row_idx % 2 = 1")).select(doc(), "training_source", "role")


@query("training_manifest", f"""WITH {ENTS_SQL}, ok AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents WHERE regexp_matches(text, '\\S') AND doc_id IN (SELECT doc_id FROM ents WHERE label IN ('Person', 'Location'))),
{REFIT.replace('FROM documents', 'FROM ok')} SELECT 'train' AS role, src AS training_source, count(*)::BIGINT AS n FROM tr GROUP BY src UNION ALL SELECT 'validation', 'supervised', count(*) FROM val""")
def manifest(spark, sf):
    df = slim(annotated(spark, sf)).select("row_idx", "text", "entities")
    return tidy(training_manifest(df.filter("row_idx % 2 = 0"), df.filter("row_idx % 2 = 1"), labels=["Person", "Location"]).sources)


@query("group_split", f"""WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY {h(42, 'o_custkey')}) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o_orderkey, CASE WHEN r <= least(ceil(n * 0.3), n - 1) THEN 'validation' ELSE 'train' END AS role FROM orders JOIN g USING (o_custkey)""")
def group_split(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return sp.group_split(df, "o_custkey", 0.3, id_col="o_orderkey").select("o_orderkey", "role")


@query("reshuffle_split", f"""WITH pool AS (SELECT 'train' AS origin, doc_id FROM documents WHERE doc_id % 4 > 0 UNION ALL SELECT 'test', doc_id FROM documents WHERE doc_id % 4 = 0),
r AS (SELECT *, row_number() OVER (ORDER BY {h(42, 'origin', 'doc_id')}) AS r, (SELECT count(*) FROM documents WHERE doc_id % 4 > 0) AS n FROM pool) SELECT doc_id, origin, CASE WHEN r <= n THEN 'train' ELSE 'test' END AS role FROM r""")
def reshuffle_split(spark, sf):
    df = table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"))
    return sp.reshuffle_split(df.filter("row_idx % 4 > 0"), df.filter("row_idx % 4 = 0")).select(doc(), "origin", "role")


@query("calibration_split_random", f"""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY {h(42, 'doc_id')}) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= greatest(1, least(n - 1, round_even(n * 0.3, 0))) THEN 'calibration' ELSE 'final_test' END AS role FROM a""")
def calibration_split_random(spark, sf):
    df = table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"))
    return sp.calibration_split(df, 0.3).select(doc(), "role")


@query("calibration_split_heuristic", f"""WITH {ENTS_SQL}, l AS (SELECT DISTINCT doc_id, label FROM ents), s AS (SELECT d.doc_id, coalesce('[' || string_agg('"' || label || '"', ',' ORDER BY label) || ']', '[]') AS st FROM documents d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id),
c AS (SELECT st, count(*) AS n FROM s GROUP BY st), t AS (SELECT *, sum(n) OVER () AS total, greatest(1, least(sum(n) OVER () - 1, round_even(sum(n) OVER () * 0.3, 0))) AS goal FROM c),
e AS (SELECT *, n * goal / total AS exact, floor(n * goal / total) AS base FROM t), q AS (SELECT st, base + CASE WHEN row_number() OVER (ORDER BY exact - base DESC, n DESC, st) <= goal - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM e),
r AS (SELECT doc_id, st, row_number() OVER (PARTITION BY st ORDER BY {h(42, 'doc_id')}) AS r FROM s) SELECT doc_id, CASE WHEN r <= quota THEN 'calibration' ELSE 'final_test' END AS role FROM r JOIN q USING (st)""")
def calibration_split_heuristic(spark, sf):
    return sp.calibration_split(slim(annotated(spark, sf)), 0.3, mode="heuristic", spans="entities").select(doc(), "role")


# --------------------------------------------------------------------------- folds
FOLDS = f"""ol AS (SELECT o_custkey AS g, o_orderkey, l_returnflag AS label FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
ex AS (SELECT o_custkey AS g, count(*) AS examples FROM orders GROUP BY 1), gl AS (SELECT g, label, count(*) AS n FROM ol GROUP BY ALL), pres AS (SELECT label, count(*) AS p FROM gl GROUP BY label),
pr AS (SELECT ex.g, examples, coalesce(sum(n), 0) AS spans, min({{'p': p, 'label': gl.label}}) AS rare, coalesce(sum(1.0::DOUBLE / p), 0) AS rarity FROM ex LEFT JOIN gl USING (g) LEFT JOIN pres ON pres.label = gl.label GROUP BY ex.g, examples),
fo AS (SELECT g, examples, spans, ((row_number() OVER (ORDER BY coalesce(rare.p, 4611686018427387904), coalesce(rare.label, ''), round(rarity, 12) DESC, spans DESC, examples DESC, {h(42, 'g')}, g) - 1) % 5 + 1)::BIGINT AS fold FROM pr)"""


def _grouped(spark, sf):
    """Orders with the return flags of their lines as labels, customers as groups."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_returnflag").alias("labels"))
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left")
    return df.withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


@query("group_folds", f"WITH {FOLDS} SELECT g AS o_custkey, fold, examples::BIGINT AS examples, spans::BIGINT AS spans FROM fo")
def group_folds(spark, sf):
    return tidy(sp.group_folds(_grouped(spark, sf), "o_custkey", 5).select("o_custkey", "fold", "examples", "spans"))


@query("fold_report", f"""WITH {FOLDS}, pf AS (SELECT fold, count(*) AS groups, sum(examples) AS examples FROM fo GROUP BY fold) SELECT pf.fold, groups::BIGINT AS groups, pf.examples::BIGINT AS examples, gl.label, count(*)::BIGINT AS groups_with_label, sum(n)::BIGINT AS label_spans
FROM pf JOIN fo USING (fold) JOIN gl ON gl.g = fo.g GROUP BY ALL""")
def fold_report(spark, sf):
    return tidy(sp.fold_report(sp.group_folds(_grouped(spark, sf), "o_custkey", 5)))


@query("fold_cost", f"""WITH {FOLDS}, pf AS (SELECT fold, count(*)::DOUBLE AS groups, sum(examples)::DOUBLE AS examples FROM fo GROUP BY fold), fl AS (SELECT fold, gl.label, count(*)::DOUBLE AS p, sum(n)::DOUBLE AS s FROM fo JOIN gl USING (g) GROUP BY ALL),
a AS (SELECT sum(pow((groups - tg) / tg, 2) + pow((examples - te) / te, 2)) AS c FROM (SELECT *, sum(groups) OVER () / 5 AS tg, sum(examples) OVER () / 5 AS te FROM pf)),
b AS (SELECT sum(3 * p + 2 * s) AS c FROM (SELECT fold, avg(pow((p - tp) / tp, 2)) AS p, avg(pow((s - ts) / ts, 2)) AS s FROM (SELECT *, sum(p) OVER (PARTITION BY label) / 5 AS tp, sum(s) OVER (PARTITION BY label) / 5 AS ts FROM fl) GROUP BY fold))
SELECT round(a.c + b.c, 6) AS cost FROM a, b""")
def fold_cost(spark, sf):
    return tidy(sp.fold_cost(sp.group_folds(_grouped(spark, sf), "o_custkey", 5), 5))


@query("balanced_folds", f"WITH {FOLDS} SELECT count(*)::BIGINT AS groups, sum(examples)::BIGINT AS examples, sum(spans)::BIGINT AS spans, count(DISTINCT fold)::BIGINT AS folds, 1::BIGINT AS even, 1::BIGINT AS cheaper FROM fo")
def balanced_folds(spark, sf):
    """The dealt folds after the search: the same groups, group counts as even, and a lower cost."""
    dealt = written(sp.group_folds(_grouped(spark, sf), "o_custkey", 5), "dealt-folds")
    better = written(balance_folds(dealt, "o_custkey", 5), "balanced-folds")
    per = better.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("examples").alias("examples"), F.sum("spans").alias("spans"))
    cost = lambda folds: sp.fold_cost(folds, 5).select("cost").scalar()
    whole = per.agg(F.sum("n").alias("groups"), F.sum("examples").alias("examples"), F.sum("spans").alias("spans"), F.count(F.lit(1)).alias("folds"), (F.max("n") - F.min("n") <= 1).alias("even"))
    return tidy(whole.withColumn("cheaper", cost(better) < cost(dealt)))


@query("fold_pairs", f"""WITH {FOLDS} SELECT i::BIGINT AS split, CASE WHEN fold = i THEN 'test' ELSE 'train' END AS role, count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS groups FROM orders JOIN fo ON fo.g = o_custkey, range(1, 6) r(i) GROUP BY ALL""")
def fold_pairs(spark, sf):
    df = _grouped(spark, sf)
    pairs = sp.fold_pairs(sp.assign_folds(df, sp.group_folds(df, "o_custkey", 5), "o_custkey"), 5, ["o_custkey"])
    per = pairs.groupBy("split", "role", "o_custkey").agg(F.count(F.lit(1)).alias("c"))
    return tidy(per.groupBy("split", "role").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("groups")))


@query("training_windows", ALIGNED_SQL + """, d AS (SELECT doc_id, count(*) AS n FROM ws GROUP BY doc_id),
w AS (SELECT doc_id, k AS win, CASE WHEN n > 64 THEN k * 48 ELSE 0 END AS lo, CASE WHEN n > 64 THEN least(k * 48 + 64, n) ELSE n END AS hi FROM d, unnest(generate_series(0, CASE WHEN n > 64 THEN CAST(ceil((n - 64) / 48.0) AS BIGINT) ELSE 0 END)) g(k)),
win AS (SELECT w.doc_id, win, lo, al.label FROM w JOIN al ON al.doc_id = w.doc_id AND greatest(a, lo) <= least(b, hi - 1)), s AS (SELECT source AS g, win.* FROM win JOIN documents USING (doc_id)),
ex AS (SELECT g, count(*) AS examples FROM (SELECT DISTINCT g, doc_id, win FROM s) GROUP BY g), gl AS (SELECT g, label, count(*) AS n FROM s GROUP BY ALL), pres AS (SELECT label, count(*) AS p FROM gl GROUP BY label),
pr AS (SELECT ex.g, examples, sum(n) AS spans, min({'p': p, 'label': gl.label}) AS rare, sum(1.0::DOUBLE / p) AS rarity FROM ex JOIN gl USING (g) JOIN pres ON pres.label = gl.label GROUP BY ex.g, examples),
fo AS (SELECT g, examples, spans, (row_number() OVER (ORDER BY rare.p, rare.label, round(rarity, 12) DESC, spans DESC, examples DESC, md5('42:' || g), g) - 1) % 4 + 1 AS fold FROM pr)
SELECT g AS sample_id, fold::BIGINT AS fold, examples::BIGINT AS windows, spans::BIGINT AS spans FROM fo""")
def windows_with_folds(spark, sf):
    """Tokenize, align, window and fold; the document source is the leakage group."""
    df = slim(annotated(spark, sf)).withColumnRenamed("source", "sample_id").select("row_idx", "sample_id", "text", "entities")
    out = training_windows(df, spans="entities", k=4, max_length=64, overlap=16)
    return tidy(out.groupBy("sample_id", "fold").agg(F.count(F.lit(1)).alias("windows"), F.sum(F.size("ner")).alias("spans")))


# --------------------------------------------------------------------------- weights and batches
WEIGHTS = f"""{ENTS_SQL}, lc AS (SELECT label, count(*) AS n FROM ents GROUP BY label), dl AS (SELECT DISTINCT doc_id, label FROM ents),
wt AS (SELECT d.doc_id, CASE WHEN count(n) = 0 THEN 1.0::DOUBLE ELSE greatest(sum(1.0::DOUBLE / n), 1e-8) END AS weight FROM documents d LEFT JOIN dl USING (doc_id) LEFT JOIN lc ON lc.label = dl.label GROUP BY d.doc_id)"""


def _weighted(spark, sf):
    return sp.sampling_weights(annotated(spark, sf).select("row_idx", F.col("entities.label").alias("labels")))


@query("sampling_weights", f"WITH {WEIGHTS} SELECT doc_id, round(weight, 9) AS weight FROM wt")
def sampling_weights(spark, sf):
    return _weighted(spark, sf).select(doc(), F.round("weight", 9).alias("weight"))


@query("weighted_resample", f"""WITH {LINES_SQL}, a AS (SELECT id, sum(l_quantity) OVER (ORDER BY {h(42, 'id')}) - l_quantity AS lo, sum(l_quantity) OVER () AS total FROM li),
x AS (SELECT lo / total AS spot, 0 AS kind, id, NULL::BIGINT AS draw FROM a UNION ALL
  SELECT ('0x' || substr(md5('42:draw:' || i), 1, 12))::BIGINT / 281474976710656.0::DOUBLE, 1, NULL, i FROM range((SELECT count(*) FROM li)) r(i)),
y AS (SELECT kind, draw, last_value(id IGNORE NULLS) OVER (ORDER BY spot, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS id FROM x)
SELECT draw, id FROM y WHERE kind = 1""")
def weighted_resample(spark, sf):
    return tidy(sp.weighted_resample(order_lines(spark, sf), weight="l_quantity").select("draw", F.col("row_idx").alias("id")))


@query("assign_batches", f"""WITH {LINES_SQL}, f AS (SELECT id, l_returnflag = 'R' AS pos FROM li), r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY {h(42, 'id')}) - 1 AS rk, count(*) FILTER (pos) OVER () AS p, count(*) FILTER (NOT pos) OVER () AS n0 FROM f),
c AS (SELECT *, least(n0, p * 1) AS n, least(greatest(1, ceil((p + least(n0, p * 1)) / 2)), p)::BIGINT AS b FROM r)
SELECT id, (CASE WHEN pos AND rk < b THEN rk WHEN pos THEN (rk - b) % b ELSE (p - b + rk) % b END)::BIGINT AS batch FROM c WHERE pos OR rk < n""")
def assign_batches(spark, sf):
    df = order_lines(spark, sf)
    return tidy(sp.assign_batches(df, 2, positive=F.col("l_returnflag") == "R").select(F.col("row_idx").alias("id"), "batch"))
