"""The stateless stages on an arriving corpus, and the growing set of kept records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanlake.functions.text import dedupe_key
from spanlake.plans.cycle import CycleConfig, score_and_split


def score_stream(stream: DataFrame, cfg: CycleConfig = CycleConfig()) -> DataFrame:
    """Calibrate, boost, score and split arriving records: the batch expressions on a stream, append mode."""
    return score_and_split(stream, cfg)


def write_decisions(scored: DataFrame, folder: str, checkpoint: str, fmt: str = "parquet", once: bool = True) -> StreamingQuery:
    """Kept and discarded records in one pass; the file sink's log makes each batch exactly once."""
    writer = (scored.writeStream.format(fmt).partitionBy("decision").outputMode("append")
              .option("path", folder).option("checkpointLocation", checkpoint))
    return writer.trigger(availableNow=True).start() if once else writer.start()


#: The state store that keeps its keys on disk; the default one holds all of them in executors' memory.
DISK_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def accumulate_kept(scored: DataFrame, folder: str, checkpoint: str, text: str = "text", id_col: str = "row_idx",
                    once: bool = True, event_time: str | None = None, within: str = "7 days", state_store: str | None = DISK_STATE) -> StreamingQuery:
    """Add the kept records of every batch to an accumulated set, each text once.

    The digests met so far are keyed state (``dedupe_stream``): a batch looks up its own texts only, whatever has been accumulated, and of copies in
    one batch any stays.  Batch n owns the sub-folder ``batch_id=n`` and overwrites it; a repeated batch starts from the
    state before it, so it changes nothing.  ``id_col`` is kept as it is.  ``event_time`` and ``within`` bound the state in time.
    """
    fresh = dedupe_stream(scored.filter(F.col("decision") == "kept"), text, event_time, within)

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    writer = fresh.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(add)
    return _start(writer.trigger(availableNow=True) if once else writer, scored.sparkSession, state_store)


def _start(writer, spark, state_store: str | None) -> StreamingQuery:
    """Start with the given state store; a query keeps the settings of its start."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    if state_store:
        spark.conf.set(name, state_store)
    try:
        return writer.start()
    finally:
        if state_store:
            spark.conf.set(name, before) if before else spark.conf.unset(name)


def dedupe_stream(scored: DataFrame, text: str = "text", event_time: str | None = None, within: str = "7 days") -> DataFrame:
    """Keep one arriving record per text with stream state instead of a table; blank texts all stay.

    The state holds one digest per text for ever.  With ``event_time`` and ``within`` (a watermark delay) it forgets
    digests older than that, and only copies that arrive within it are recognised.
    """
    keyed = scored.withColumn("text_digest", F.sha2(dedupe_key(F.col(text)), 256))
    if event_time:
        keyed = keyed.withWatermark(event_time, within)
    blank = dedupe_key(F.col(text)) == ""
    named = keyed.filter(~blank)
    named = named.dropDuplicatesWithinWatermark(["text_digest"]) if event_time else named.dropDuplicates(["text_digest"])
    return named.unionByName(keyed.filter(blank))
