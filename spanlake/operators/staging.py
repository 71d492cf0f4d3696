"""Evaluate costly columns once.

Catalyst moves filters below projections by copying the column's expression into the filter, and ``explode`` adds
a size check on its input the same way.  For an array expression over a whole text that means computing it two or
three times (and a Python UDF may not be copied into a lambda at all).  A column made by exploding a
one-element array is a boundary that filters on it cannot cross; all other push-downs still happen.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spanlake.session import scratch_path


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` whose results are computed exactly once per row."""
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    keep = [c for c in df.columns if c not in columns]
    staged = df.select(*keep, packed)
    return staged.select(*[F.col(c) if c in keep else F.col(f"_once.{c}").alias(c) for c in
                           [*df.columns, *[n for n in columns if n not in df.columns]]])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: computed once, and kept if an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``written`` with aggregates of the rows that come for free while they are written: (table, measures).

    A task that runs again may count its rows twice.  If any task of the write did, the measures are taken
    from the written table instead.
    """
    context, watch, group = df.sparkSession.sparkContext, Observation(name), f"{name}-{uuid4().hex}"
    before = [context.getLocalProperty(k) for k in _GROUP]
    context.setJobGroup(group, name)
    try:
        out = written(df.observe(watch, *[c.alias(n) for n, c in measures.items()]), name)
    finally:
        for k, v in zip(_GROUP, before):
            context.setLocalProperty(k, v)
    if _ran_once(context, group):
        return out, watch.get
    return out, out.agg(*[c.alias(n) for n, c in measures.items()]).first().asDict()


_GROUP = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")


def _ran_once(context, group: str) -> bool:
    """Did every task of the group's jobs run a single time, as far as Spark still knows?"""
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    stages = [tracker.getStageInfo(s) for j in jobs if j for s in j.stageIds]
    return bool(jobs) and all(jobs) and all(s is None or (s.currentAttemptId == 0 and s.numFailedTasks == 0 and s.numCompletedTasks <= s.numTasks) for s in stages)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition only when the input has fewer splits than the cluster has cores.

    A small file is one split, which would leave a CPU-heavy stage to a single task.  Large inputs come with more
    splits than cores and pass through unchanged.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
