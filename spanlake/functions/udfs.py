"""The three places where user Python runs: tagger, token lengths, exact normaliser.

Each is an Arrow-batched UDF on one column; the other columns never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.text import fold_exact

#: texts, labels, threshold -> one entity list per text
Tagger = Callable[[list[str], Sequence[str], float], list[list[dict]]]

TAGGED = T.StructType([
    T.StructField("ok", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("found", T.ArrayType(T.StructType([
        T.StructField("chunk", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]))),
])


def tagger_udf(load: Callable[[], Tagger], labels: Sequence[str], threshold: float, batch_size: int = 4):
    """UDF over an ``array<string>`` of chunks.  ``load`` runs once per task.

    Chunks of neighbouring records share tagger batches.  When a batch fails, its records are
    retried one by one; a record that fails again gets ``ok = false``, the error's text and no entities.
    """

    def tag_records(tagger: Tagger, records: list[list[str]]) -> list[tuple[bool, str | None, list[dict]]]:
        flat = [(r, c, text) for r, chunks in enumerate(records) for c, text in enumerate(chunks)]
        found: list[list[dict]] = [[] for _ in records]
        failed: set[int] = set()
        errors: dict[int, str] = {}

        def run(part: list[tuple[int, int, str]]) -> None:
            answers = tagger([t for _, _, t in part], labels, threshold)
            for (r, c, _), entities in zip(part, answers, strict=True):
                for e in entities:
                    found[r].append({
                        "chunk": c, "start": e.get("start", -1), "end": e.get("end", 0), "label": e.get("label"),
                        "text": e.get("text", ""), "score": float(e.get("score", 1.0))})

        for at in range(0, len(flat), batch_size):
            part = flat[at:at + batch_size]
            try:
                run(part)
            except Exception:
                failed.update(r for r, _, _ in part)
        for r in sorted(failed):
            found[r] = []
            try:
                for c, text in enumerate(records[r]):
                    run([(r, c, text)])
            except Exception as problem:
                found[r] = []
                errors[r] = f"{type(problem).__name__}: {problem}"[:300]
                continue
            failed.discard(r)
        return [(r not in failed, errors.get(r), found[r]) for r in range(len(records))]

    @F.pandas_udf(TAGGED)
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = load()
        for chunks in batches:
            rows = tag_records(tagger, [[] if c is None else list(c) for c in chunks])
            yield pd.DataFrame({"ok": [ok for ok, _, _ in rows], "error": [e for _, e, _ in rows], "found": [f for _, _, f in rows]})

    return tag


def token_lengths_udf(length_of: Callable[[list[str]], list[int]]):
    """UDF ``array<string> -> array<int>``: model lengths of the words (at least 1 each)."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def lengths(words: pd.Series) -> pd.Series:
        return words.map(lambda w: [max(1, int(n)) for n in length_of(list(w))])

    return lengths


def normalize_text_exact(col: Column) -> Column:
    """The exact Unicode folding for every script; same result as the native one on Latin text."""

    @F.udf("string", useArrow=True)
    def fold(value):
        return fold_exact(value or "")

    return fold(col)
