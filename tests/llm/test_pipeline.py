"""The pipeline stage by stage on hard rows and on the small tables."""

from __future__ import annotations

import corpus_pipeline as cp
from corpus import SF, empty, frame
from test_dedup import plain_components
from test_tokens import check_packed

from spanlake.llm import near_dedup as nd
from spanlake.llm import queries as q
from spanlake.llm.common import stored


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        before, kept = kept, stored(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns and kept.subtract(before).count() == 0 and 0 < kept.count() <= before.count()
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in kept.collect()]
    assert len({t for _, t, *_ in rows}) == len(rows)
    assert len({*plain_components(rows, 5, 80).values()}) == len(rows)  # no two of them are near copies
    check_packed([r[:2] for r in rows], cp.run(spark, SF).collect(), 4096)


def test_near_stage_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 120")
    data = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    want = {v[1] for v in plain_components(data, 5, 80).values()}
    assert {r.doc_id for r in nd.drop_near_duplicates(docs).collect()} == want


def test_stages_leave_the_other_columns_alone(spark):
    docs = frame(spark)
    before = {repr(tuple(r)) for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and {repr(tuple(r)) for r in kept.collect()} <= before, name


def test_stages_on_hard_and_on_no_rows(spark):
    for docs in (frame(spark), empty(spark)):
        for _, stage in cp.STAGES:
            assert stage(spark, docs, SF).count() >= 0


def test_queries_are_registered():
    names = [*q.QUERIES]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(q.ORACLES) <= set(names)
