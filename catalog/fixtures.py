"""The annotated corpus that queries derive from the ``documents`` table.

A token of the text that starts like a capitalised word is an entity; its label follows from its length, its
score and its gold / predicted flags from the md5 of (document, position).  The same rule is
given as SQL for the oracle statements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.arrays import bind, prefix_sums
from spanlake.functions.text import digest_fraction, regex_matches
from spanlake.operators.staging import once, spread
from spanlake.schema import LABELS


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, on all cores even when the file is a single split."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _label(n: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in LABELS]), F.pmod(n, F.lit(3)).cast("int"))


CAPITALISED = "(?<![^ ])[A-Z][a-z]+[^ ]*"


def _entities(doc: Column, text: Column) -> Column:
    """Tokens (cut at single spaces) that start like a capitalised word; ``pos`` is the token number."""
    words = regex_matches(text, CAPITALISED)

    def number(found: Column) -> Column:
        # Token number = spaces before the token, added up from gap to gap.
        spaces = F.transform(F.slice(F.split(text, CAPITALISED, -1), 1, F.size(found)), lambda g: F.length(g) - F.length(F.replace(g, F.lit(" "), F.lit(""))))
        pos = bind(prefix_sums(F.concat(spaces, F.array(F.lit(0)))), lambda sums: F.slice(sums, 2, F.size(sums) - 1))
        keyed = F.zip_with(found, pos, lambda m, p: F.struct(m.alias("m"), F.md5(F.concat(doc.cast("string"), F.lit(":"), p.cast("string"))).alias("h")))
        return F.transform(keyed, lambda x: F.struct(
            x["m"]["start"].alias("start"), x["m"]["end"].alias("end"), _label(F.length(x["m"]["text"])).alias("label"),
            x["m"]["text"].alias("text"), digest_fraction(x["h"]).alias("score"), x["h"].alias("h")))

    return bind(words, number)


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_idx, text, lang, source, entities (start, end, label, text, score, h); one pass, no shuffle."""
    return annotate(spread(table(spark, sf_dir, "documents"), "doc_id"))


def annotate(documents: DataFrame) -> DataFrame:
    """The same for any batch or stream of documents."""
    docs = documents.select(F.col("doc_id").alias("row_idx"), "text", "lang", "source")
    return once(docs, entities=_entities(F.col("row_idx"), F.col("text")))


def _keep(entities: Column, ok, label) -> Column:
    return F.transform(F.filter(entities, ok), lambda e: F.struct(
        e["start"].alias("start"), e["end"].alias("end"), label(e).alias("label"), e["text"].alias("text"), e["score"].alias("score")))


def gold_and_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_idx, text, gold and pred: two overlapping subsets, some predictions with a wrong label."""
    df = annotated(spark, sf_dir)
    digit = lambda e, i: F.substring(e["h"], i, 1)
    wrong = lambda e: F.when(digit(e, 9) < "2", _label(F.length(e["text"]) + 1)).otherwise(e["label"])
    both = once(df, gold=_keep(F.col("entities"), lambda e: digit(e, 7) < "c", lambda e: e["label"]),
                pred=_keep(F.col("entities"), lambda e: digit(e, 8) < "c", wrong))
    return both.select("row_idx", "text", "lang", "source", "gold", "pred")


def slim(df: DataFrame, column: str = "entities") -> DataFrame:
    """Entities without the digest field."""
    return df.withColumn(column, F.transform(column, lambda e: e.dropFields("h")))


def long(df: DataFrame, column: str) -> DataFrame:
    """row_idx, start, end, label, text, score rows."""
    return df.select("row_idx", F.explode(column).alias("e")).select("row_idx", "e.start", "e.end", "e.label", "e.text", "e.score")


def with_metadata(df: DataFrame) -> DataFrame:
    """Metadata columns: the document's source and language, its second entity, a text that is not in it."""
    return df.select("*", F.col("text").alias("relato"), F.col("lang").alias("cidadeLocal"), F.col("source").alias("bairroLocal"),
                     F.get("entities", F.lit(1))["text"].alias("logradouroLocal"),
                     F.concat(F.lit("Praça "), F.col("lang")).alias("pontodeReferenciaLocal"))


def calibration_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_idx, score, target, label: the score is the entity's, the target follows it through a second digest."""
    ents = annotated(spark, sf_dir).select("row_idx", F.posexplode("entities").alias("ent_idx", "e"))
    noise = F.conv(F.substring("e.h", 10, 6), 16, 10).cast("bigint") / F.lit(16777216.0)
    return ents.select(F.concat_ws(":", "row_idx", "ent_idx").alias("row_key"), "row_idx", F.col("e.score").alias("score"),
                       (noise < F.pow("e.score", 2)).cast("int").alias("target"), F.col("e.label").alias("label"))


def tidy(df: DataFrame) -> DataFrame:
    """Plain result types: integers and booleans as BIGINT, doubles rounded to 6 digits."""
    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            c = c.cast("int").cast("bigint")
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.FractionalType):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        return c.alias(f.name)

    return df.select(*[one(f) for f in df.schema.fields])


# --------------------------------------------------------------------------- the same as SQL
TOKENS_SQL = """
tk AS (SELECT doc_id, unnest(string_split(text, ' ')) AS tok, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents),
ot AS (SELECT doc_id, tok, pos, coalesce(sum(length(tok) + 1) OVER (PARTITION BY doc_id ORDER BY pos
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM tk)"""

ENTS_SQL = TOKENS_SQL + """,
eh AS (SELECT doc_id, pos, s, s + length(tok) AS e, tok AS t, ['Person','Location','Organization'][1 + length(tok) % 3] AS label,
       ['Person','Location','Organization'][1 + (length(tok) + 1) % 3] AS wrong, md5(doc_id || ':' || pos) AS h
       FROM ot WHERE regexp_matches(tok, '^[A-Z][a-z]+')),
ents AS (SELECT *, ('0x' || substr(h, 1, 6))::BIGINT / 16777216.0::DOUBLE AS score,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM eh)"""

GOLD_PRED_SQL = ENTS_SQL + """,
gold AS (SELECT doc_id, s, e, label, t, score FROM ents WHERE substr(h, 7, 1) < 'c'),
pred AS (SELECT doc_id, s, e, CASE WHEN substr(h, 9, 1) < '2' THEN wrong ELSE label END AS label, t, score FROM ents WHERE substr(h, 8, 1) < 'c'),
spans AS (SELECT doc_id, s, e, label, max(g) AS g, max(p) AS p, max(score) AS score FROM (
          SELECT doc_id, s, e, label, 1 AS g, 0 AS p, NULL AS score FROM gold UNION ALL SELECT doc_id, s, e, label, 0, 1, score FROM pred) x
          GROUP BY doc_id, s, e, label)"""

CALIBRATION_SQL = ENTS_SQL + """,
cal AS (SELECT doc_id || ':' || i AS row_key, doc_id, score, label,
        CASE WHEN ('0x' || substr(h, 10, 6))::BIGINT / 16777216.0::DOUBLE < pow(score, 2) THEN 1 ELSE 0 END AS target FROM ents)"""


def norm_sql(expr: str) -> str:
    """SQL for the folded form of Latin text."""
    return f"trim(regexp_replace(strip_accents(lower(replace(coalesce({expr}, ''), 'ß', 'ss'))), '\\s+', ' ', 'g'))"


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with a unique text id (order, line, part and price; order and line alone repeat)."""
    parts = ["l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("bigint")]
    return spread(table(spark, sf_dir, "lineitem")).select(F.concat_ws(":", *parts).alias("row_idx"), "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")


LINES_SQL = """li AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || CAST(round(l_extendedprice * 100) AS BIGINT) AS id,
  l_returnflag, l_linestatus, l_quantity, l_extendedprice FROM lineitem)"""


def doc() -> Column:
    """The record id under the name of the source table."""
    return F.col("row_idx").alias("doc_id")
