import pytest
from conftest import ENT, ent
from pyspark.sql import functions as F

from spanlake.operators import fields as fd
from spanlake.operators import filters as fl
from spanlake.operators import prune as pr
from spanlake.operators import summarize as sm

SP = "array<struct<start:int,end:int,label:string>>"


def test_prune_by_score_and_cap(spark):
    df = spark.createDataFrame([("abc", [ent("Organization", start=0, end=3, boosted=.9), ent("Organization", start=4, end=7, boosted=.8), ent("Person", start=8, end=11, boosted=.2)])],
                               f"relato string, entities {ENT}")
    out = pr.prune_entities(df, 0.5, max_k=1, score_fields=["score_context_boosted"])
    r = out.head()
    assert [e.score_context_boosted for e in r.entities] == [.9]
    assert (r._pseudolabel_prune.dropped_by_score, r._pseudolabel_prune.pruned_by_cap) == (1, 1)
    s = pr.prune_summary(out).head()
    assert (s.tips_total, s.entities_before, s.entities_after, s.entities_removed) == (1, 3, 1, 2)


def test_prune_labels_floors_over_max(spark):
    df = spark.createDataFrame([("a", [ent("Organization", start=0, end=1, boosted=.7)]), ("b", [ent("Person", start=0, end=1, boosted=.8), ent("Person", start=2, end=3)])],
                               f"relato string, entities {ENT}")
    out = pr.prune_entities(df, labels=["Person"])
    s = pr.prune_summary(out, drop_empty=True).head()
    assert (s.dropped_by_label, s.tips_dropped_empty, s.tips_kept, s.missing_score, s.dropped_by_score) == (1, 1, 1, 1, 1)
    assert [r.relato for r in pr.drop_pruned_empty(out).collect()] == ["b"]
    floors = pr.prune_entities(df, 0.5, {"Organization": 0.75}).orderBy("relato").collect()
    assert [len(r.entities) for r in floors] == [0, 1]
    two = spark.createDataFrame([("a", [ent("P", start=0, end=1, score=.9), ent("P", start=2, end=3, score=.8)])], f"relato string, entities {ENT}")
    r = pr.prune_entities(two, max_k=1, drop_over_max=True).head()
    assert r.entities == [] and r._pseudolabel_prune.dropped_tip_over_cap and r._pseudolabel_prune.pruned_by_cap == 0


def test_cap_order_ties(spark):
    es = [ent("B", start=5, end=9, score=.5), ent("A", start=5, end=9, score=.5), ent("A", start=0, end=9, score=.5), ent("A", start=0, end=2, score=.6), ent("A", score=.5, text="longest mention")]
    df = spark.createDataFrame([("a", es)], f"relato string, entities {ENT}")
    got = pr.prune_entities(df, max_k=4).head().entities
    assert [(e.label, e.start, e.score) for e in got] == [("A", 0, .6), ("A", None, .5), ("A", 0, .5), ("A", 5, .5)]
    long = spark.createDataFrame([(0, i, *e[:2], e[2], e[4]) for i, e in enumerate(es[:4])], "row_idx long, ent_idx int, start int, end int, label string, score double")
    assert [r.ent_idx for r in pr.top_k_per_record(long, 2).orderBy("rank").collect()] == [3, 2]


def test_rank_clean_record_first(spark):
    clean = [ent("Location", "Rua Faia", 0, 8, .95), ent("Person", "Ana Maria", 10, 19, .9), ent("Location", "Centro", 21, 27, .92)]
    noisy = [ent("Organization", "x", i, i + 1, .55) for i in range(10)]
    df = spark.createDataFrame([(0, "y" * 60, 0.9, noisy), (1, "x" * 60, 0.9, clean), (2, "", None, [])], f"row_idx long, relato string, record_score double, entities {ENT}")
    feats = pr.candidate_features(df)
    m = {r.row_idx: r._candidate_rank for r in feats.collect()}
    assert m[0].short_span_ratio == 1.0 and m[0].organization_ratio == 1.0 and m[0].low_score_share == 1.0
    assert m[1].label_counts == {"Location": 2, "Person": 1} and m[1].location_max_score == .95
    want = .45 * .9 + .3 * m[1].mean_entity_score + .15 + .1 * .95 - .15 * 1.0
    assert m[1].candidate_quality_score == pytest.approx(want)
    ranked = pr.rank_candidates(feats, 2).collect()
    assert [(r.rank, r.row_idx) for r in ranked] == [(1, 1), (2, 2)]
    assert [(r.rank, r.row_idx) for r in pr.rank_candidates(feats, 0).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 0)]
    cfg = pr.RankConfig(min_record_score=.95, max_entities=5, max_short_span_ratio=.5, required_labels=["Location"])
    assert {r.outcome: r.n for r in pr.candidate_drops(feats, cfg).collect()} == {"record_score": 2, "required_labels": 1}
    assert pr.filter_candidates(feats, cfg._replace(min_record_score=0.0)).head().row_idx == 1
    rep = pr.candidate_report(pr.rank_candidates(feats, 1)).head()
    assert (rep.location_count, rep.organization_count, rep.text_preview) == (2, 0, "x" * 60)
    assert pr.candidate_summary(pr.rank_candidates(feats, 2)).head().avg_record_score == .9


def test_dense(spark):
    df = spark.createDataFrame([(0, "short", [(0, 1, "A")] * 2), (1, "longer text", [(0, 1, "A")] * 2), (2, "x", [(0, 1, "A")] * 3), (3, "x", [])], f"row_idx long, relato string, entities {SP}")
    rows = fl.dense_records(df, 2).collect()
    assert [r.row_idx for r in rows] == [2, 1, 0] and rows[0]._dense_tip.label_counts == {"A": 3}
    assert [r.row_idx for r in fl.dense_records(df, 2, n=1).collect()] == [2]


def test_training_input(spark):
    raw = "array<struct<start:string,end:string,label:string>>"
    df = spark.createDataFrame([
        (0, " Ana ", [("0", "3", " Person "), ("x", "3", "Person"), ("3", "3", "Person"), ("0", "1", " "), ("0", "1", "Z")], None),
        (1, "", [("0", "1", "Person")], None), (2, "t", None, [("0", "1", "Person")]), (3, "t", None, None), (4, "t", [("0", "1", "Z")], None)],
        f"row_idx long, relato string, entities {raw}, ner {raw}")
    out, counts = fl.prepare_training_records(df, ["Person"], "pseudolabel")
    rows = {r.row_idx: r for r in out.collect()}
    assert set(rows) == {0, 2} and [tuple(e) for e in rows[0].entities] == [(0, 3, "Person")] and rows[0].text == "Ana"
    assert rows[2]._refit_input_meta.entity_source == "ner"
    assert {r.reason: r.n for r in counts.collect()} == {
        "input_records": 5, "missing_text": 1, "invalid_span": 2, "invalid_label": 1, "filtered_by_label": 2, "no_valid_entities": 1,
        "missing_entity_list": 1, "dropped_no_entities": 2, "kept_records": 2}


def test_banned_terms(spark):
    df = spark.createDataFrame([(0, "O cidadão foi à CASA e ao Morro", [(2, 9, "Person"), (16, 20, "Location"), (26, 31, "Location"), (16, 20, "Person")])], f"row_idx long, text string, spans {SP}")
    clean, removed = fl.remove_banned_spans(df)
    assert [tuple(s) for s in clean.head().spans] == [(26, 31, "Location"), (16, 20, "Person")]
    assert [(r.label, r.mention, r.mention_normalized) for r in removed.orderBy("start").collect()] == [("Person", "cidadão", "cidadao"), ("Location", "CASA", "casa")]
    assert fl.removed_terms(removed).count() == 2
    custom, _ = fl.remove_banned_spans(df, {"location": ["morro"]})
    assert len(custom.head().spans) == 3


def test_span_rules(spark):
    kind = "array<struct<text:string>>"
    vals = ["john@company.com", "not-an-email", "Test Phone", "iPhone", "Jo"]
    df = spark.createDataFrame([([(v,) for v in vals],)], f"e {kind}")
    run = lambda *rules: [x.text for x in df.select(fl.filter_spans_by_regex(F.col("e"), rules).alias("e")).head().e]
    assert run(fl.SpanRule(r"[\w\.-]+@[\w\.-]+\.\w+")) == ["john@company.com"]
    assert run(fl.SpanRule(r"^(test|demo)", "partial", exclude=True, ignore_case=True), fl.SpanRule(r".{5,50}")) == ["john@company.com", "not-an-email", "iPhone"]


def test_field_operators(spark):
    df = spark.createDataFrame([(0, " x ", 5, None, ["a"])], "row_idx long, relato string, n int, z string, arr array<string>")
    assert fd.project_fields(df, ["relato", "n", "z", "q"]).head()[1:] == (" x ", "5", "", "")
    assert fd.project_fields(df, ["n"], coerce="empty", fill="-").head().n == "-"
    with pytest.raises(Exception, match="non-string"):
        fd.project_fields(df, ["n"], coerce="error").collect()
    e = spark.createDataFrame([([(0, 1, "Comunidade"), (1, 2, "comunidade"), (2, 3, "A")],)], f"entities {SP}")
    assert fd.rename_label(e, "Comunidade", "Location").head().labels_replaced == 1
    assert [x.label for x in fd.rename_label(e, "Comunidade", "Location", ignore_case=True).head().entities] == ["Location", "Location", "A"]
    m = spark.createDataFrame([([(0, 1, "PERSON"), (1, 2, "GPE"), (2, 3, "DATE")],)], f"entities {SP}")
    from spanlake.schema import NER_LABEL_MAP
    assert [x.label for x in fd.map_labels(m, NER_LABEL_MAP, drop_unmapped=True).head().entities] == ["Person", "Location"]
    assert [x.label for x in fd.map_labels(m, {"person": "Person"}, fold_case=True).head().entities] == ["Person", "GPE", "DATE"]


def test_entity_shapes(spark):
    rows = ['[{"text":"b","label":"X","start":3,"end":4},{"text":"a","label":"X"}]', '["z","y"]', '{"person":["Ana",{"text":"Bia","start":1}],"place":"Rio","org":{"text":"ONU","label":"Org"}}', '7']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p string")
    got = [[tuple(e) for e in r.entities] for r in fd.normalize_entity_shapes(df, "p").orderBy("i").collect()]
    assert got == [[("X", "a", "", ""), ("X", "b", "3", "4")], [("", "y", "", ""), ("", "z", "", "")],
                   [("Org", "ONU", "", ""), ("person", "Ana", "", ""), ("person", "Bia", "1", ""), ("place", "Rio", "", "")], []]


def test_summaries(spark):
    df = spark.createDataFrame([(0, "texto a", (.41, None), [ent("Location", boosted=.91), ent("Person", boosted=.32)]), (1, "texto a", (.52, None), [ent("Location", boosted=.81)])],
                               f"row_idx long, relato string, _split struct<score_value:double,score_used:double>, entities {ENT}")
    q = sm.kept_quality(df, 0.8, 0.5).head()
    assert (q.kept_rows, q.unique_texts, q.duplicate_text_rows, q.duplicate_text_rate, q.avg_entities_per_kept) == (2, 1, 1, .5, 1.5)
    assert (q.avg_strong_entities_per_kept, q.avg_weak_entities_per_kept) == (1.0, .5)
    assert q.avg_record_score_in_kept == pytest.approx(.465) and q.avg_max_entity_score == pytest.approx(.86)
    d = sm.duplicate_text_stats(df).head()
    assert tuple(d) == (2, 1, 1, .5) and sm.duplicate_text_stats(df, approximate=True).head().unique_texts == 1
    assert tuple(sm.top_label(df).head()) == ("Location", 2)
    flags = spark.createDataFrame([(100, .1, 1.0, 0, -.01), (1, 0.0, 0.0, 3, .02), (None, None, None, None, None)],
                                  "kept_count int, duplicate_text_rate double, avg_weak_entities_per_kept double, boosted_records int, micro_delta double")
    assert [r.flags for r in sm.quality_flags(flags).collect()] == [
        "high_kept_count,duplicate_texts,many_weak_entities,no_context_boost,strong_negative_delta", "strong_positive_delta", ""]
    lists = spark.createDataFrame([([(0, 1, "A"), (0, 1, None)], [(0, 1, "B")]), (None, [(0, 1, "B"), (0, 1, " ")])], f"entities {SP}, ner {SP}")
    assert {r.label: r.n for r in sm.label_counts(lists).collect()} == {"A": 1, "UNKNOWN": 1, "B": 1, " ": 1}
    assert [tuple(r) for r in sm.distinct_labels(lists).collect()] == [("B", 2), ("A", 1)]


def test_systems(spark):
    a = spark.createDataFrame([(0, [(0, 1, "A"), (2, 3, "B")]), (1, [])], f"row_idx long, entities {SP}")
    b = spark.createDataFrame([(0, [(0, 1, "A")]), (1, [(5, 6, "B")])], f"row_idx long, entities {SP}")
    side = sm.compare_systems({"base": a, "new": b}).orderBy("row_idx").collect()
    assert [(r.base_entity_count, r.new_entity_count) for r in side] == [(2, 1), (0, 1)]
    assert {(r.system, r.label): r.n for r in sm.system_label_counts({"base": a, "new": b}).collect()} == {("base", "A"): 1, ("base", "B"): 1, ("new", "A"): 1, ("new", "B"): 1}
    assert {r.label: (r.both, r.left_only, r.right_only) for r in sm.system_agreement(a, b).collect()} == {"A": (1, 0, 0), "B": (0, 1, 1)}
