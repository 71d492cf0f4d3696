"""Chunking, tagging and span geometry."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from catalog import query
from catalog.calibration import _sig, grid_sql
from catalog.fixtures import ENTS_SQL, annotated, documents, slim, table, tidy
from spanlake.functions import text as tx
from spanlake.operators import extract as ex
from spanlake.operators.staging import once
from spanlake.plans.cycle import CycleConfig, run_cycle
from spanlake.session import ship_package

WS_SQL = """
wp AS (SELECT doc_id, unnest(p) AS tok, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '\\S+|\\s+') AS p FROM documents)),
wo AS (SELECT doc_id, tok, k, (sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY k) - length(tok))::BIGINT AS s FROM wp),
ws AS (SELECT doc_id, tok, s, s + length(tok) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS n FROM wo WHERE regexp_matches(tok, '\\S'))"""
RX_SQL = WS_SQL.replace("'\\S+|\\s+'", "'[\\p{L}\\p{N}_]+|\\s+|[^\\p{L}\\p{N}_\\s]'").replace("wp", "rp").replace("wo ", "ro ").replace("wo\n", "ro\n").replace("FROM wo", "FROM ro").replace("ws AS", "rx AS")
CHUNKS_SQL = f"""WITH {WS_SQL}, c AS (SELECT doc_id, n // 64 AS chunk, min(s) AS start, max(e) AS e FROM ws GROUP BY ALL)
SELECT c.doc_id, chunk::BIGINT AS chunk, start::BIGINT AS start, md5(substr(text, (start + 1)::BIGINT, (e - start)::BIGINT)) AS digest FROM c JOIN documents USING (doc_id)"""


@query("chunk_text_large", CHUNKS_SQL.replace("64", "900"))
def chunk_text_large(spark, sf):
    """A budget of 900 tokens."""
    rows = once(documents(spark, sf), c=ex.chunk_text(F.col("text"), 900)).select("doc_id", F.posexplode("c").alias("chunk", "c"))
    return tidy(rows.select("doc_id", "chunk", "c.start", F.md5("c.text").alias("digest")))


@query("chunk_text", CHUNKS_SQL)
def chunk_text(spark, sf):
    rows = once(documents(spark, sf), c=ex.chunk_text(F.col("text"), 66, reserved=2)).select("doc_id", F.posexplode("c").alias("chunk", "c"))
    return tidy(rows.select("doc_id", "chunk", "c.start", F.md5("c.text").alias("digest")))


@query("locate_chunks", CHUNKS_SQL)
def locate_chunks(spark, sf):
    parts = F.transform(ex.chunk_text(F.col("text"), 64), lambda c: c["text"])
    docs = once(documents(spark, sf), parts=F.concat(F.array(F.lit("§ not in any text §")), parts))
    rows = once(docs, c=ex.locate_chunks(F.col("text"), F.col("parts"))).select("doc_id", F.posexplode("c").alias("chunk", "c"))
    return tidy(rows.select("doc_id", "chunk", "c.start", F.md5("c.text").alias("digest")))


@query("chunk_profile", f"""WITH {WS_SQL}, c AS (SELECT doc_id, n // 64 AS chunk, max(e) - min(s) AS l FROM ws GROUP BY ALL),
p AS (SELECT d.doc_id, length(text) AS l, count(c.chunk) AS n, coalesce(max(c.l), 0) AS m FROM documents d LEFT JOIN c USING (doc_id) GROUP BY ALL)
SELECT count(*)::BIGINT AS rows, sum(n)::BIGINT AS total_chunks, round(avg(n), 6) AS avg_chunks_per_row, max(n)::BIGINT AS max_chunks_per_row, max(l)::BIGINT AS max_text_length, max(m)::BIGINT AS max_chunk_length FROM p""")
def chunk_profile(spark, sf):
    return tidy(ex.chunk_profile(documents(spark, sf), "text", 64))


# --------------------------------------------------------------------------- taggers
MATCHES_SQL = """WITH g AS (SELECT doc_id, string_split_regex(text, '[A-Z][a-z]+') AS gaps, regexp_extract_all(text, '[A-Z][a-z]+') AS hits FROM documents),
u AS (SELECT doc_id, unnest(hits) AS t, generate_subscripts(hits, 1) AS k, unnest(gaps[1:len(hits)]) AS gap FROM g),
m AS (SELECT doc_id, t, k, (sum(length(gap) + length(t)) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT AS e FROM u)"""


@query("regex_tagger", MATCHES_SQL + " SELECT doc_id, count(*)::BIGINT AS n, sum(e - length(t))::BIGINT AS starts, sum(e)::BIGINT AS ends, md5(string_agg(t, ',' ORDER BY k)) AS digest FROM m GROUP BY doc_id")
def regex_tagger(spark, sf):
    df = once(documents(spark, sf), e=ex.regex_tagger(F.col("text"), {"Word": "[A-Z][a-z]+"})).filter(F.size("e") > 0)
    total = lambda f: F.aggregate("e", F.lit(0).cast("bigint"), lambda a, x: a + x[f])
    return tidy(df.select("doc_id", F.size("e").alias("n"), total("start").alias("starts"), total("end").alias("ends"), F.md5(F.array_join("e.text", ",")).alias("digest")))


def word_tagger():
    """A tagger in the user's Python: capitalised words, long ones with a high score."""
    pattern = re.compile("[A-Z][a-z]+")
    return lambda texts, labels, threshold: [
        [{"start": m.start(), "end": m.end(), "text": m.group(), "label": labels[0], "score": 0.9 if len(m.group()) > 3 else 0.1} for m in pattern.finditer(t)]
        for t in texts]


@query("extract_entities", MATCHES_SQL + " SELECT doc_id, count(*)::BIGINT AS n, sum(e)::BIGINT AS ends, md5(string_agg(t, ',' ORDER BY k)) AS digest FROM m WHERE length(t) > 3 GROUP BY doc_id")
def extract_entities(spark, sf):
    ship_package(spark)
    load = _local(word_tagger)
    out = ex.extract_entities(documents(spark, sf), load, ["Word"], threshold=0.5, max_tokens=64, batch_size=16).filter(F.size("entities") > 0)
    total = F.aggregate("entities", F.lit(0).cast("bigint"), lambda a, x: a + x["end"])
    return tidy(out.select("doc_id", F.size("entities").alias("n"), total.alias("ends"), F.md5(F.array_join("entities.text", ",")).alias("digest")))


_TAGGED_SQL = MATCHES_SQL + f""", own AS (SELECT doc_id, CASE WHEN length(t) > 3 THEN 0.9 ELSE 0.1 END::DOUBLE AS score, (length(t) > 3)::INT AS target FROM m),
{grid_sql('own')}, rec AS (SELECT d.doc_id, d.text, coalesce(avg(CASE WHEN own.score IS NOT NULL THEN {_sig('bt.t')} END), 0) AS rs FROM documents d CROSS JOIN bt LEFT JOIN own ON own.doc_id = d.doc_id GROUP BY d.doc_id, d.text),
cut AS (SELECT *, rs >= 0.8 AS keep FROM rec)"""


def full_cycle(spark, sf):
    ship_package(spark)
    df = documents(spark, sf).select(F.col("doc_id").alias("row_idx"), F.col("text").alias("relato"), "lang")
    cfg = CycleConfig(boost=None, threshold=0.8, fallback=None)
    return run_cycle(df, cfg, _local(word_tagger), ["relato"], ["Word"], ["relato"], max_tokens=600, batch_size=16)


@query("cycle_full", _TAGGED_SQL + """ SELECT 'tag' AS stage, count(*)::BIGINT AS samples, count(*)::BIGINT AS processed, 0::BIGINT AS failed, (SELECT count(*) FROM own)::BIGINT AS entities FROM documents
  UNION ALL SELECT 'kept', count(*)::BIGINT, count(*)::BIGINT, 0::BIGINT, NULL FROM cut WHERE keep UNION ALL SELECT 'discarded', count(*)::BIGINT, count(*)::BIGINT, 0::BIGINT, NULL FROM cut WHERE NOT keep
  UNION ALL SELECT 'next', count(DISTINCT text)::BIGINT, count(DISTINCT text)::BIGINT, 0::BIGINT, NULL FROM cut WHERE NOT keep AND regexp_matches(text, '\\S')""")
def cycle_full(spark, sf):
    """Tag, calibrate, score, split and prepare the next input: the counts of every stage."""
    return tidy(full_cycle(spark, sf).stages.drop("error"))


@query("cycle_full_next", _TAGGED_SQL + " SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM cut WHERE NOT keep AND regexp_matches(text, '\\S') GROUP BY text")
def cycle_full_next(spark, sf):
    """The records of the next cycle."""
    return full_cycle(spark, sf).next_input.select(F.col("row_idx").alias("doc_id"), F.md5("relato").alias("digest"))


@query("tagger_failures", "SELECT count(*)::BIGINT AS samples, count(CASE WHEN doc_id % 7 <> 0 THEN 1 END)::BIGINT AS processed, count(CASE WHEN doc_id % 7 = 0 THEN 1 END)::BIGINT AS failed, 'ValueError: no answer' AS common_error FROM documents")
def tagger_failures(spark, sf):
    """A tagger that fails on every text marked for it; the other records of its batches are kept."""
    ship_package(spark)
    marked = documents(spark, sf).withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("FAILS "), "text")).otherwise(F.col("text")))
    out = ex.extract_entities(marked, _local(moody_tagger), ["Word"], max_tokens=2000, batch_size=16)
    return tidy(ex.tagging_stats(out).select("samples", "processed", "failed", "common_error"))


def moody_tagger():
    """Fails on texts that say so."""
    def tag(texts, labels, threshold):
        if any(t.startswith("FAILS") for t in texts):
            raise ValueError("no answer")
        return [[] for _ in texts]
    return tag


def _local(fn):
    """The same function, pickled by value, so that workers need not import the catalog."""
    from pyspark import cloudpickle
    import sys
    cloudpickle.register_pickle_by_value(sys.modules[fn.__module__])
    return fn


@query("dictionary_tagger", f"""WITH {RX_SQL}, terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{6,}}')) AS term FROM benchmark)
SELECT doc_id, count(*)::BIGINT AS n, sum(s)::BIGINT AS starts FROM rx JOIN terms ON lower(tok) = term GROUP BY doc_id""")
def dictionary_tagger(spark, sf):
    terms = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("term")).distinct()
    ents = ex.dictionary_tagger(documents(spark, sf), terms.withColumn("label", F.lit("Term")), id_col="doc_id", ignore_case=True)
    return tidy(ents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts")))


_RUN = lambda k: " || ' ' || ".join(f"w{i}" for i in range(k))
_PHRASES_SQL = """WITH b AS (SELECT regexp_extract_all(text, '\\S+') AS w FROM benchmark),
terms AS (SELECT DISTINCT array_to_string(w[i + 1:i + k], ' ') AS term FROM b, (VALUES (2), (3), (5), (8)) z(k), range(0, 200, 3) r(i) WHERE i + k <= len(w)),
t AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS i FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents)),
l AS (SELECT doc_id, i, tok AS w0, """ + ", ".join(f"lead(tok, {k}) OVER o AS w{k}" for k in range(1, 8)) + """ FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (""" + " UNION ALL ".join(f"SELECT doc_id, i, {k} AS k, {_RUN(k)} AS term FROM l WHERE w{k - 1} IS NOT NULL" for k in (2, 3, 5, 8)) + """)
SELECT doc_id, count(*)::BIGINT AS n, sum(k)::BIGINT AS words, sum(i)::BIGINT AS places, sum(length(term))::BIGINT AS chars FROM g JOIN terms USING (term) GROUP BY doc_id"""


@query("dictionary_phrases", _PHRASES_SQL)
def dictionary_phrases(spark, sf):
    """Phrases of up to eight words of the benchmark texts, found in the documents; ``places`` are token numbers."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    bench = once(table(spark, sf, "benchmark"), w=w).select("w")
    cut = lambda k: F.transform(F.filter(F.sequence(F.lit(0), F.lit(199), F.lit(3)), lambda i: i + k <= F.size("w")), lambda i: F.array_join(F.slice("w", i + 1, F.lit(k)), " "))
    terms = bench.select(F.explode(F.concat(*[cut(k) for k in (2, 3, 5, 8)])).alias("term")).distinct().withColumn("label", F.lit("Phrase"))
    docs = documents(spark, sf).select("doc_id", "text")
    found = ex.dictionary_tagger(docs, terms, id_col="doc_id", max_words=8, strategy="whitespace")
    found = found.select("doc_id", "start", F.size(F.split("text", r"\s+")).alias("k"), F.regexp_replace("text", r"\s+", " ").alias("term"))
    starts = once(docs, t=tx.tokenize_with_spans(F.col("text"), "whitespace")).select("doc_id", F.posexplode("t").alias("i", "t")).select("doc_id", "i", F.col("t.start").alias("start"))
    out = found.join(starts, ["doc_id", "start"]).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("k").alias("words"), F.sum("i").alias("places"), F.sum(F.length("term")).alias("chars"))
    return tidy(out)


@query("collect_entities", f"""WITH {WS_SQL} SELECT d.doc_id, count(w.n)::BIGINT AS n, md5(coalesce(string_agg(w.s || ':' || w.tok, ',' ORDER BY w.s), '')) AS digest
FROM documents d LEFT JOIN (SELECT * FROM ws WHERE tok IN ('the', 'der', 'les', 'el')) w USING (doc_id) GROUP BY d.doc_id""")
def collect_entities(spark, sf):
    docs = documents(spark, sf).select(F.col("doc_id").alias("row_idx"), "text")
    terms = spark.createDataFrame([(t, "Article") for t in ("the", "der", "les", "el")], "term string, label string")
    out = ex.collect_entities(docs, ex.dictionary_tagger(docs, terms, strategy="whitespace"))
    return tidy(out.select(F.col("row_idx").alias("doc_id"), F.size("entities").alias("n"), F.md5(F.array_join(F.transform(
        "entities", lambda e: F.concat(e["start"].cast("string"), F.lit(":"), e["text"])), ",")).alias("digest")))


@query("dedupe_entities", f"WITH {ENTS_SQL} SELECT doc_id, count(*)::BIGINT AS n, md5(string_agg(s || ':' || t, ',' ORDER BY i)) AS digest FROM ents GROUP BY doc_id")
def dedupe_entities(spark, sf):
    twice = slim(annotated(spark, sf)).withColumn("entities", F.concat("entities", F.reverse("entities")))
    out = once(twice, e=ex.dedupe_entities(F.col("entities"))).filter(F.size("e") > 0)
    return tidy(out.select(F.col("row_idx").alias("doc_id"), F.size("e").alias("n"), F.md5(F.array_join(F.transform(
        "e", lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["text"])), ",")).alias("digest")))


# --------------------------------------------------------------------------- tokens
def _token_sums(tokens):
    total = lambda f: F.aggregate(tokens, F.lit(0).cast("bigint"), lambda a, x: a + x[f])
    return [F.size(tokens).alias("n"), total("start").alias("starts"), total("end").alias("ends")]


@query("tokenize_whitespace", f"WITH {WS_SQL} SELECT doc_id, count(*)::BIGINT AS n, sum(s)::BIGINT AS starts, sum(e)::BIGINT AS ends FROM ws GROUP BY doc_id")
def tokenize_whitespace(spark, sf):
    df = once(documents(spark, sf), t=tx.tokenize_with_spans(F.col("text"))).select("doc_id", "t").filter(F.size("t") > 0)
    return tidy(df.select("doc_id", *_token_sums(F.col("t"))))


@query("tokenize_regex", f"WITH {RX_SQL} SELECT doc_id, count(*)::BIGINT AS n, sum(s)::BIGINT AS starts, sum(e)::BIGINT AS ends FROM rx GROUP BY doc_id")
def tokenize_regex(spark, sf):
    df = once(documents(spark, sf), t=tx.tokenize_with_spans(F.col("text"), "regex")).select("doc_id", "t").filter(F.size("t") > 0)
    return tidy(df.select("doc_id", *_token_sums(F.col("t"))))


ALIGNED_SQL = f"""WITH {ENTS_SQL}, {WS_SQL}, al AS (SELECT x.doc_id, x.i, x.label, min(w.n) AS a, max(w.n) AS b FROM ents x JOIN ws w ON w.doc_id = x.doc_id AND w.s < x.e AND w.e > x.s GROUP BY ALL)"""


@query("align_spans_to_tokens", ALIGNED_SQL + " SELECT doc_id, count(*)::BIGINT AS n, sum(a)::BIGINT AS firsts, sum(b)::BIGINT AS lasts, md5(string_agg(label, ',' ORDER BY i)) AS digest FROM al GROUP BY doc_id")
def align_spans_to_tokens(spark, sf):
    out = ex.tokenized_samples(slim(annotated(spark, sf)), spans="entities").filter(F.size("ner") > 0)
    total = lambda f: F.aggregate("ner", F.lit(0).cast("bigint"), lambda a, x: a + x[f])
    return tidy(out.select(F.col("row_idx").alias("doc_id"), F.size("ner").alias("n"), total("start_tok").alias("firsts"), total("end_tok").alias("lasts"),
                           F.md5(F.array_join("ner.label", ",")).alias("digest")))


@query("tokens_to_char_offsets", ALIGNED_SQL + """, j AS (SELECT doc_id, n, length(tok) AS l, (sum(length(tok) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(tok) - 1)::BIGINT AS p FROM ws)
SELECT al.doc_id, count(*)::BIGINT AS n, sum(f.p)::BIGINT AS starts, sum(g.p + g.l)::BIGINT AS ends FROM al JOIN j f ON f.doc_id = al.doc_id AND f.n = al.a JOIN j g ON g.doc_id = al.doc_id AND g.n = al.b GROUP BY al.doc_id""")
def tokens_to_char_offsets(spark, sf):
    df = ex.tokenized_samples(slim(annotated(spark, sf)), spans="entities").filter(F.size("ner") > 0)
    df = once(df, t=ex.tokens_to_char_offsets(F.col("tokenized_text"), F.col("ner"))).select(F.col("row_idx").alias("doc_id"), "t")
    return tidy(df.select("doc_id", *_token_sums(F.col("t"))))


def _samples(spark, sf):
    return ex.tokenized_samples(slim(annotated(spark, sf)), spans="entities").select(F.col("row_idx").alias("doc_id"), "tokenized_text", "ner")


@query("sliding_token_windows", ALIGNED_SQL + """, d AS (SELECT doc_id, count(*) AS n FROM ws GROUP BY doc_id),
w AS (SELECT doc_id, k AS win, CASE WHEN n > 100 THEN k * 75 ELSE 0 END AS lo, CASE WHEN n > 100 THEN least(k * 75 + 100, n) ELSE n END AS hi
  FROM d, unnest(generate_series(0, CASE WHEN n > 100 THEN CAST(ceil((n - 100) / 75.0) AS BIGINT) ELSE 0 END)) g(k))
SELECT w.doc_id, win::BIGINT AS win, (hi - lo)::BIGINT AS tokens, count(*)::BIGINT AS spans, sum(greatest(a, lo) - lo)::BIGINT AS firsts, sum(least(b, hi - 1) - lo)::BIGINT AS lasts
FROM w JOIN al ON al.doc_id = w.doc_id AND greatest(a, lo) <= least(b, hi - 1) GROUP BY ALL""")
def sliding_token_windows(spark, sf):
    out = ex.sliding_token_windows(_samples(spark, sf), 102, 25, reserved=2)
    total = lambda f: F.aggregate("ner", F.lit(0).cast("bigint"), lambda a, x: a + x[f])
    return tidy(out.select("doc_id", F.col("window").alias("win"), F.size("tokenized_text").alias("tokens"), F.size("ner").alias("spans"),
                           total("start_tok").alias("firsts"), total("end_tok").alias("lasts")))


@query("fitted_token_windows", f"""WITH RECURSIVE {WS_SQL}, t AS (SELECT doc_id, n, (length(tok) + 3) // 4 AS l FROM ws),
tot AS (SELECT doc_id, count(*) AS words, sum(l) AS all_l FROM t GROUP BY doc_id),
p AS (SELECT doc_id, n, sum(l) OVER (PARTITION BY doc_id ORDER BY n) AS upto, l FROM t),
fixed AS (SELECT a.doc_id, a.n AS lo, coalesce(max(CASE WHEN b.upto <= a.upto - a.l + 100 THEN b.n + 1 END), a.n + 1) AS hi
  FROM p a JOIN p b ON b.doc_id = a.doc_id AND b.n BETWEEN a.n AND a.n + 99 GROUP BY a.doc_id, a.n),
chain AS (SELECT f.doc_id, 0::BIGINT AS win, f.lo, f.hi FROM fixed f JOIN tot USING (doc_id) WHERE f.lo = 0 AND all_l > 100
  UNION ALL SELECT c.doc_id, c.win + 1, f.lo, f.hi FROM chain c JOIN tot USING (doc_id) JOIN fixed f ON f.doc_id = c.doc_id AND f.lo = greatest(c.lo + 1, c.hi - 25) WHERE c.hi < words)
SELECT doc_id, win::BIGINT AS win, (hi - lo)::BIGINT AS tokens, lo::BIGINT AS first FROM chain
UNION ALL SELECT doc_id, 0, words::BIGINT, 0 FROM tot WHERE all_l <= 100""")
def fitted_token_windows(spark, sf):
    """Window lengths measured by a tokenizer in the user's Python (four characters per piece)."""
    from spanlake.functions.udfs import token_lengths_udf
    ship_package(spark)
    measure = token_lengths_udf(lambda words: [-(-len(w) // 4) for w in words])
    df = once(documents(spark, sf), tokenized_text=F.transform(tx.tokenize_with_spans(F.col("text")), lambda t: t["token"]))
    df = df.select("doc_id", "tokenized_text").filter(F.size("tokenized_text") > 0).withColumn("len", measure("tokenized_text"))
    df = df.withColumn("ner", F.transform("tokenized_text", lambda t, i: F.struct(i.alias("start_tok"), i.alias("end_tok"), i.cast("string").alias("label"))))
    out = ex.sliding_token_windows(df, 100, 25, keep_empty=True, lengths="len")
    return tidy(out.select("doc_id", F.col("window").alias("win"), F.size("tokenized_text").alias("tokens"), F.get("ner", F.lit(0))["label"].cast("bigint").alias("first")))


@query("bio_tags", f"""WITH {ENTS_SQL}, {RX_SQL}, h AS (SELECT r.doc_id, r.n, min_by(CASE WHEN r.s = x.s THEN 'B-' ELSE 'I-' END || upper(substr(x.label, 1, 3)), x.i) AS tag
  FROM rx r JOIN ents x ON x.doc_id = r.doc_id AND r.s >= x.s AND r.e <= x.e + 2 GROUP BY r.doc_id, r.n)
SELECT r.doc_id, coalesce(tag, 'O') AS tag, count(*)::BIGINT AS n, sum(r.n)::BIGINT AS positions FROM rx r LEFT JOIN h ON h.doc_id = r.doc_id AND h.n = r.n GROUP BY ALL""")
def bio_tags(spark, sf):
    wide = annotated(spark, sf).withColumn("entities", F.transform("entities", lambda e: F.struct(e["start"].alias("start"), (e["end"] + 2).alias("end"), e["label"].alias("label"))))
    rows = ex.bio_tags(wide, spans="entities")
    return tidy(rows.groupBy(F.col("row_idx").alias("doc_id"), "tag").agg(F.count(F.lit(1)).alias("n"), F.sum("tok_idx").alias("positions")))


@query("mention_lists", f"""WITH {ENTS_SQL}, m AS (SELECT doc_id, CASE label WHEN 'Person' THEN 'human' ELSE lower(label) END AS label, t, min(i) AS first FROM (SELECT doc_id, label, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t, i FROM ents) GROUP BY ALL)
SELECT doc_id, label, count(*)::BIGINT AS n, md5(string_agg(t, '|' ORDER BY first)) AS digest FROM m GROUP BY doc_id, label""")
def mention_lists(spark, sf):
    out = ex.to_mention_lists(slim(annotated(spark, sf)).select("row_idx", "text", "entities"), {"Person": "human"}, spans="entities")
    rows = out.select(F.col("row_idx").alias("doc_id"), F.explode("output.entities").alias("label", "m"))
    return tidy(rows.select("doc_id", "label", F.size("m").alias("n"), F.md5(F.array_join("m", "|")).alias("digest")))


@query("segment_text", f"""WITH {ENTS_SQL}, x AS (SELECT doc_id, s, e - 1 AS e, label, coalesce(lag(e - 1) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prev, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS nxt FROM ents),
seg AS (SELECT doc_id, label, s AS a, e AS b FROM x UNION ALL SELECT doc_id, NULL, prev, s FROM x WHERE prev < s
  UNION ALL SELECT x.doc_id, NULL, e, length(text) FROM x JOIN documents d ON d.doc_id = x.doc_id WHERE nxt IS NULL AND e < length(text)
  UNION ALL SELECT doc_id, NULL, 0, length(text) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ents) AND length(text) > 0)
SELECT seg.doc_id, count(*)::BIGINT AS n, count(label)::BIGINT AS marked, md5(string_agg(substr(text, a + 1, b - a), '|' ORDER BY a)) AS digest FROM seg JOIN documents USING (doc_id) GROUP BY seg.doc_id""")
def segment_text(spark, sf):
    """Each entity twice, once a character shorter: the shorter one comes first, the longer one overlaps it."""
    df = annotated(spark, sf).withColumn("spans", F.concat(
        F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label"))),
        F.transform("entities", lambda e: F.struct(e["start"].alias("start"), (e["end"] - 1).alias("end"), e["label"].alias("label")))))
    seg = once(df, g=ex.segment_text(F.col("text"), F.col("spans"))).filter(F.size("g") > 0)
    return tidy(seg.select(F.col("row_idx").alias("doc_id"), F.size("g").alias("n"), F.size(F.filter("g.label", lambda x: x.isNotNull())).alias("marked"),
                           F.md5(F.array_join("g.text", "|")).alias("digest")))
