"""Joins on overlapping intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.extraction import WS_SQL
from catalog.fixtures import ENTS_SQL, annotated, documents, long, slim, table, tidy
from spanlake.functions import text as tx
from spanlake.operators.overlap import overlap_join
from spanlake.operators.staging import once


@query("overlap_in_transit", """WITH t AS (
  SELECT o_custkey AS c, l_shipdate::DATE AS s, l_shipdate::DATE + l_quantity::INTEGER AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT o_custkey AS c, o_orderkey, o_orderdate::DATE AS s, o_orderdate::DATE + 45 AS e FROM orders)
SELECT o_orderkey, count(*)::BIGINT AS lines, sum(least(t.e, n.e) - greatest(t.s, n.s))::BIGINT AS days
FROM n JOIN t ON t.c = n.c AND t.s < n.e AND n.s < t.e GROUP BY o_orderkey""")
def overlap_in_transit(spark, sf):
    """The customer's lines that are in transit while an order is new, and the days that they share with it."""
    day = lambda c: F.to_date(c)
    orders = table(spark, sf, "orders")
    new = orders.select("o_custkey", "o_orderkey", day("o_orderdate").alias("since"), F.date_add(day("o_orderdate"), 45).alias("until"))
    lines = table(spark, sf, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    sent = lines.select("o_custkey", day("l_shipdate").alias("shipped"), F.date_add(day("l_shipdate"), F.col("l_quantity").cast("int")).alias("received"))
    met = overlap_join(new, sent, ["o_custkey"], ("since", "until"), ("shipped", "received"))
    days = F.date_diff(F.least("until", "received"), F.greatest("since", "shipped"))
    return tidy(met.groupBy("o_orderkey").agg(F.count("*").alias("lines"), F.sum(days).alias("days")))


@query("overlap_tokens_spans", f"""WITH {ENTS_SQL}, {WS_SQL} SELECT x.doc_id, x.s AS start, x.label, min(w.n)::BIGINT AS start_tok, max(w.n)::BIGINT AS end_tok, count(*)::BIGINT AS tokens
FROM ents x JOIN ws w ON w.doc_id = x.doc_id AND w.s < x.e AND w.e > x.s GROUP BY ALL""")
def overlap_tokens_spans(spark, sf):
    """The tokens of every entity, from a table of tokens and a table of spans."""
    tokens = once(documents(spark, sf).select(F.col("doc_id").alias("row_idx"), "text"), t=tx.tokenize_with_spans(F.col("text"), "whitespace"))
    tokens = tokens.select("row_idx", F.posexplode("t").alias("n", "t")).select("row_idx", "n", F.col("t.start").alias("tok_start"), F.col("t.end").alias("tok_end"))
    spans = long(slim(annotated(spark, sf)), "entities").select("row_idx", "start", "end", "label")
    met = overlap_join(spans, tokens, ["row_idx"], ("start", "end"), ("tok_start", "tok_end"))
    out = met.groupBy(F.col("row_idx").alias("doc_id"), "start", "label").agg(F.min("n").alias("start_tok"), F.max("n").alias("end_tok"), F.count("*").alias("tokens"))
    return tidy(out)
