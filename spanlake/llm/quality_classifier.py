"""Document quality by hierarchical empirical Bayes.

A text's words and word shapes give it evidence (log odds of good against bad).  The mean quality of a host, and of the
paths of a host, is estimated from the evidence of all its documents and shrunk towards the level above:
a site with few documents stays near the global rate.  A document's verdict is its evidence on top of its path's rate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import SPACES, keep_rows, python_ready, row_key, stored
from spanlake.llm.pieces import Memo

#: Labelled documents the text model is fitted on, those with the smallest hash of their id.
MAX_TRAIN = 50_000
#: Buckets of the text features, pseudo-count of each; the bucket of repeated words.
BUCKETS, SMOOTHING, REPEAT = 1 << 16, 0.5, 0
#: Words a text's evidence counts for at most, so that long texts leave the site a say.
EVIDENCE_WORDS = 20
#: Documents that the level above counts for: global behind a host, host behind a path.
HOST_STRENGTH, PATH_STRENGTH = 20.0, 10.0
#: Probability of being good from which a document is kept.
MIN_GOOD = 0.5


def word_features(word: str, buckets: int = BUCKETS) -> tuple[int, int]:
    """Buckets of a word and of its shape (runs of lower case, upper case, digits; signs as they are)."""
    from zlib import crc32
    shape, last = [], ""
    for c in word:
        kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "L" if c.isalpha() else c
        if kind != last or kind not in "aA0L":
            shape.append(kind)
        last = kind
    first, rest = REPEAT + 1, buckets - REPEAT - 1
    return first + crc32(b"w" + word.encode()) % rest, first + crc32(b"s" + "".join(shape)[:32].encode()) % rest


def words(text: str | None) -> list[str]:
    """Words between the six ASCII spaces."""
    return _WORD.findall(text or "")


_WORD = re.compile(f"[^{SPACES}]+")


def repeats(found: list[str]) -> int:
    """Words equal to the word before; every one is a feature of its own."""
    return sum(map(eq, found, found[1:]))


def fit_text_model(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, buckets: int = BUCKETS,
                   id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[float]:
    """Log odds (good against bad) of each feature bucket.

    Fitted on a bounded sample: the ``max_train`` labelled ids with the smallest hashes.  ``buckets`` numbers come back
    to the driver.  Without labels of both kinds no feature says anything.
    """
    python_ready(docs.sparkSession)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_good"))
    sample = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(max_train))  # ``max_train`` rows of 12 bytes at most
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(sample, "_id").select("text", F.col("_good").alias("good"))

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        features = Memo(lambda w: word_features(w, buckets))
        sums = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, good in zip(batch.column("text").to_pylist(), batch.column("good").to_pylist()):
                found = words(text)
                if found:
                    sums[good] += np.bincount(np.array([features[w] for w in found]).ravel(), minlength=buckets)
                    sums[good, REPEAT] += repeats(found)
        good, bucket = sums.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(good, pa.int32()), pa.array(sums[good, bucket], pa.int64())], names=["bucket", "good", "n"])

    counts = rows.mapInArrow(count, "bucket long, good int, n long").groupBy("bucket", "good").agg(F.sum("n").alias("n"))
    import numpy as np
    sums = np.zeros((2, buckets))
    for row in counts.collect():  # two rows per bucket at most
        sums[row["good"], row["bucket"]] = row["n"]
    if not sums.sum(axis=1).all():
        return [0.0] * buckets
    logs = np.log(sums + SMOOTHING) - np.log((sums + SMOOTHING).sum(axis=1, keepdims=True))
    return (logs[1] - logs[0]).tolist()


def text_evidence(docs: DataFrame, odds: list[float], keep: list[Column], text_col: str = "text", cap: int = EVIDENCE_WORDS) -> DataFrame:
    """``n_words`` and ``evidence`` of every row, next to the columns ``keep``."""
    python_ready(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(odds)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa
        weights, buckets = model.value, len(model.value)
        value = Memo(lambda w: sum(weights[b] for b in word_features(w, buckets)))
        for batch in batches:
            n, evidence = [], []
            for text in batch.column("_text").to_pylist():
                found = words(text)
                n.append(len(found))
                total = sum(map(value.__getitem__, found)) + weights[REPEAT] * repeats(found)
                evidence.append(total / n[-1] * min(n[-1], cap) if n[-1] else 0.0)
            kept = [(batch.column(i), name) for i, name in enumerate(batch.schema.names) if name != "_text"]
            yield pa.RecordBatch.from_arrays([c for c, _ in kept] + [pa.array(n, pa.int64()), pa.array(evidence, pa.float64())],
                                             names=[name for _, name in kept] + ["n_words", "evidence"])

    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    return rows.mapInArrow(score, f"{kinds}, n_words long, evidence double")


def site_rates(scored: DataFrame, rate: float, host_strength: float = HOST_STRENGTH, path_strength: float = PATH_STRENGTH) -> DataFrame:
    """(host, path, host_rate, path_rate): mean quality by site, from sums over all documents, shrunk level by level."""
    good = 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.lit(rate / (1 - rate))))))
    paths = stored(scored.groupBy("host", "path").agg(F.sum(good).alias("good"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("host_good") + rate * host_strength) / (F.col("host_n") + host_strength)).alias("host_rate"))
    both = paths.join(stored(hosts, "hosts"), F.col("host").eqNullSafe(F.col("_host")))
    return both.select("host", "path", "host_rate", ((F.col("good") + F.col("host_rate") * path_strength) / (F.col("n") + path_strength)).alias("path_rate"))


def classify_quality(docs: DataFrame, labels: DataFrame, min_good: float = MIN_GOOD, host: str = "source", path: str = "lang",
                     id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """Quality of every row: id, ``n_words``, ``evidence``, ``host_rate``, ``path_rate``, ``quality`` (probability of being good), ``kept``.

    ``host`` and ``path`` are expressions over the columns of ``docs``; NULL is a site of its own.  NULL and blank texts have no
    words and aren't kept.  Every row comes back once; equal rows get equal verdicts; other columns play no part.
    """
    return _judged(docs, labels, min_good, host, path, id_col, text_col, max_train).drop("_key").withColumnRenamed("_id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, min_good: float = MIN_GOOD, host: str = "source", path: str = "lang",
              id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that ``classify_quality`` keeps, all their columns as they are."""
    found = _judged(docs, labels, min_good, host, path, id_col, text_col, max_train)
    return keep_rows(docs, found, id_col, _key(host, path, id_col, text_col))


def _key(host: str, path: str, id_col: str, text_col: str) -> Column:
    """What decides the verdict of a row."""
    return row_key(F.col(id_col), F.col(text_col), F.expr(f"cast({host} as string)"), F.expr(f"cast({path} as string)"))


def _judged(docs: DataFrame, labels: DataFrame, min_good: float, host: str, path: str, id_col: str, text_col: str, max_train: int) -> DataFrame:
    odds = fit_text_model(docs, labels, max_train, id_col=id_col, text_col=text_col)
    site = [F.expr(f"cast({x} as string)") for x in (host, path)]
    keep = [F.col(id_col).alias("_id"), _key(host, path, id_col, text_col).alias("_key"), site[0].alias("host"), site[1].alias("path")]
    scored = stored(text_evidence(docs, odds, keep, text_col), "evidence")
    known = labels.filter(F.col("quality").isin(0, 1)).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    rate = min(0.99, max(0.01, 0.5 if known is None else known))
    rates = stored(site_rates(scored, rate).select(F.col("host").alias("_host"), F.col("path").alias("_path"), "host_rate", "path_rate"), "rates")
    # Both sides are plain tables: Spark splits a host that holds much of the corpus.
    fused = scored.join(rates, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    quality = F.round(1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate")))))), 9)
    rounded = [F.round(c, 9).alias(c) for c in ("evidence", "host_rate", "path_rate")]
    return fused.withColumn("quality", quality).select("_id", "_key", "n_words", *rounded, "quality", ((F.col("n_words") > 0) & (F.col("quality") >= min_good)).alias("kept"))
