"""The scoring stages on a stream of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.boosting import CYCLE, CYCLE_SQL
from catalog.fixtures import annotate, doc, slim, table, tidy, with_metadata
from catalog.merging import KEY
from spanlake import streaming as st
from spanlake.functions.text import dedupe_key
from spanlake.session import scratch_path


def _stream(spark, sf):
    """The documents as four arriving files, one per micro-batch, scored."""
    folder = scratch_path(spark, "arriving")
    docs = table(spark, sf, "documents")
    docs.repartition(4, "doc_id").write.parquet(folder)
    arriving = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return st.score_stream(with_metadata(slim(annotate(arriving))), CYCLE)


@query("stream_decisions", CYCLE_SQL + " SELECT doc_id, CASE WHEN keep THEN 'kept' ELSE 'discarded' END AS decision, round(record_score, 6) AS record_score FROM cy")
def stream_decisions(spark, sf):
    out = scratch_path(spark, "decisions")
    st.write_decisions(_stream(spark, sf).select("row_idx", "record_score", "decision"), out, scratch_path(spark, "cp")).awaitTermination()
    return tidy(spark.read.parquet(out).select(doc(), "decision", "record_score"))


_KEPT_TEXTS = CYCLE_SQL + f""", kt AS (SELECT CASE WHEN doc_id % 9 = 0 THEN '' ELSE {KEY} END AS key FROM cy JOIN documents USING (doc_id) WHERE keep)
SELECT DISTINCT md5(key) AS digest FROM kt WHERE key <> '' UNION ALL SELECT md5(key) FROM kt WHERE key = ''"""


def _with_blanks(spark, sf):
    """Scored arrivals; every ninth text is blank by now."""
    text = F.when(F.col("row_idx") % 9 == 0, F.lit(" \n ")).otherwise(F.col("text"))
    return _stream(spark, sf).select("row_idx", text.alias("text"), "decision")


@query("stream_accumulated", _KEPT_TEXTS)
def stream_accumulated(spark, sf):
    out = scratch_path(spark, "accumulated")
    rows = _with_blanks(spark, sf)
    st.accumulate_kept(rows, out, scratch_path(spark, "cp")).awaitTermination()
    return spark.read.parquet(out).select(F.md5(dedupe_key(F.col("text"))).alias("digest"))


@query("stream_deduplicated", _KEPT_TEXTS)
def stream_deduplicated(spark, sf):
    out = scratch_path(spark, "unique")
    rows = st.dedupe_stream(_with_blanks(spark, sf).filter("decision = 'kept'"))
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.md5(dedupe_key(F.col("text"))).alias("digest"))
